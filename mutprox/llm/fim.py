"""Fill-in-middle transformation over UTF-8 bytes with a sparse index of the characters that take more than one.

Cuts are found on bytes or on code points, whichever the unit gives, and the other kind follows from the index: it keeps
the places of multibyte characters only, with the bytes they have in excess, so that a cut between two of them is plain
arithmetic and an ASCII text has an empty index. Nothing is shuffled; a row is cut on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.llm.tokens import slices
from mutprox.session import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that are white space, and what comes first in a character of two, three and four bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LEADS = np.array([0xC0, 0xE0, 0xF0], np.uint8)


class ByteIndex:
    """Places of the multibyte characters of a text: ``byte`` offsets, ``char`` offsets, and excess bytes up to each."""

    def __init__(self, text: np.ndarray) -> None:
        self.byte = np.flatnonzero(text >= _LEADS[0])
        self.excess = np.r_[0, np.cumsum(np.searchsorted(_LEADS, text[self.byte], "right"))]
        self.char = self.byte - self.excess[:-1]
        self.chars = len(text) - int(self.excess[-1])

    def to_byte(self, char: np.ndarray | int) -> np.ndarray:
        """Byte offset of a cut before the code point ``char``."""
        return char + self.excess[np.searchsorted(self.char, char, "left")]

    def to_char(self, byte: np.ndarray | int) -> np.ndarray:
        """Code points before a cut at ``byte``, which must not lie inside a character."""
        return byte - self.excess[np.searchsorted(self.byte, byte, "left")]


def word_ends(text: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens end: a token is white space and the word behind it, the last may be white space alone."""
    space = _SPACE[text]
    return np.r_[np.flatnonzero(~space[:-1] & space[1:]) + 1, len(text)] if len(text) else np.zeros(0, np.int64)


def cuts(text: bytes, h1: int, h2: int, unit: str) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """Units of ``text``, and where prefix and middle end in bytes and in code points."""
    data = np.frombuffer(text, np.uint8)
    index = ByteIndex(data)
    ends = word_ends(data) if unit == "word" else None
    n = index.chars if ends is None else len(ends)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if ends is None:
        chars = np.array([a, b])
        places = index.to_byte(chars)
    else:
        places = np.array([ends[k - 1] if k else 0 for k in (a, b)])
        chars = index.to_char(places)
    return n, tuple(places.tolist()), tuple(chars.tolist())


def _formed(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for b in slices(batches, 256):
        rows = [b.column(c).to_pylist() for c in ("form", "h1", "h2")]
        texts = b.column("text").cast(pa.binary()).to_pylist()
        out: dict[str, list] = {"n": [], "prefix_chars": [], "middle_chars": [], "output": []}
        for form, h1, h2, text in zip(*rows, texts):
            n, (i, j), (p, m) = cuts(text, h1, h2, unit)
            if form == "psm":
                text = b"".join((marks[0], text[:i], marks[1], text[j:], marks[2], text[i:j]))
            elif form == "spm":
                text = b"".join((marks[1], text[j:], marks[0], text[:i], marks[2], text[i:j]))
            out["n"].append(n)
            out["prefix_chars"].append(None if form == "plain" else p)
            out["middle_chars"].append(None if form == "plain" else m - p)
            out["output"].append(text)
        kept = [c for c in b.schema.names if c not in ("text", "h1", "h2")]
        made = [pa.array(out[c], pa.int64()) for c in ("n", "prefix_chars", "middle_chars")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made, pa.array(out["output"], pa.binary()).cast(pa.string())], [*kept, *out])


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "word"
) -> DataFrame:
    """``id, form, n, prefix_chars, middle_chars, output`` for every row of ``docs``.

    ``rate`` of a hundred texts are cut into prefix, middle and suffix, ``spm_rate`` of a hundred of these with the suffix
    first; cuts and choices come from the SHA-256 of ``seed:id``. ``unit`` is "word" (white space and the word behind it)
    or "char" (code points). A null text is empty; empty texts and texts that hold a mark stay plain. A null id hashes like
    an empty one. Rows that repeat an id are cut by the same draws; other columns of ``docs`` play no part. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    text, kind = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (h(2) % 100 >= rate)
    form = F.when(plain, "plain").when(h(3) % 100 < spm_rate, "spm").otherwise("psm")
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest")).select("id", form.alias("form"), "text", h(0).alias("h1"), h(1).alias("h2"))
    schema = f"id {kind}, form string, n long, prefix_chars long, middle_chars long, output string"
    return own.mapInArrow(lambda it: _formed(it, unit), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: a cut text holds no mark of its own, so the three marks part it."""
    part = lambda k: F.element_at(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def transform_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``; rows as in :func:`transform`."""
    made = transform(docs, id_col, text_col)
    text = restored(F.col("output"), F.col("form"))
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), tok AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d
), cut AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tok
), part AS (
  SELECT *, array_to_string(w[1:i], '') AS p, array_to_string(w[i + 1:j], '') AS m, array_to_string(w[j + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM part
"""
