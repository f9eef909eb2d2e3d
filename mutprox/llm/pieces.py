"""SentencePiece encoding and decoding by a table of last tokens.

A merge-type (BPE) encoding has one property that makes it linear: every prefix of a text has exactly one last token,
the one token t that ends there, whose start is a prefix with last token s, so that (s, t) is a compatible pair: the
merges of the two tokens' joined characters give s and t back. An automaton reports the vocabulary pieces that end at
each place; the first compatible one is stored; ids are then recovered from the end backwards.

Texts are cut before each group of spaces and at characters that no longer piece holds: no merge crosses there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from mutprox.llm.tokens import Memo, slices
from mutprox.session import ship

BATCH_ROWS = 512
#: Distinct units and token pairs that one worker remembers, and the longest unit that it does; only speed depends on them.
MEMO_UNITS = 200_000
MEMO_PAIRS = 1_000_000
UNIT_CHARS = 48
SPACE = "▁"
NORMAL, BYTE = 1, 6


class PieceTable:
    """The vocabulary of one model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is expected")
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if len(self.byte_id) != 256 or any(p.type not in (NORMAL, BYTE, 2, 3) for p in model.pieces):
            raise ValueError("byte fallback and no user-defined pieces are expected")
        longer = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece goes on over a space")
        inner = {c for p in longer for c in p}
        #: what stands alone: characters that no longer piece holds (line ends among them)
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        self.unit = re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        self.size = [len(p) for p in self.pieces]
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.number = [str(i) for i in range(len(self.pieces))]
        #: ids of single characters; one outside the vocabulary stands for itself, as the negative of its code point less one
        self.single = {p: i for p, i in self.id.items() if len(p) == 1}
        #: the last merge of each piece that encodes to itself; None if it does not, or a part scores below the whole
        self.split = Memo(self._split, len(self.pieces) + 1)
        #: for each piece that may end a prefix: whether it fits after the token of an id, as far as that was asked
        self.fits: dict[str, dict[int, bool]] = {p: {} for p in longer if self.merge(p) == [p]}
        self.asked = 0
        self.automaton = ahocorasick.Automaton()
        for p, known in self.fits.items():
            self.automaton.add_word(p, (len(p), self.id[p], known))
        self.automaton.make_automaton()
        self.units = Memo(self._unit, MEMO_UNITS, UNIT_CHARS)

    def merge(self, text: str) -> list[str]:
        """The merges in full: again and again the best-scored pair, the leftmost of equals. Used on token pairs only."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _split(self, piece: str) -> tuple[str, str] | None:
        steps = list(piece)
        while len(steps) > 2:
            i = -max((self.score.get(a + b, -float("inf")), -i) for i, (a, b) in enumerate(zip(steps, steps[1:])))[1]
            if steps[i] + steps[i + 1] not in self.score:
                return None
            steps[i : i + 2] = [steps[i] + steps[i + 1]]
        left, right = steps
        fine = all(len(x) == 1 or self.score[x] >= self.score[piece] and self.split[x] for x in steps)
        return (left, right) if fine else None

    def compatible(self, s: str, t: str) -> bool:
        """Whether the merges of the joined characters leave ``s`` and ``t``.

        Time is run backwards: of the two tokens that touch at the boundary, the one made later is taken apart, and the
        two that then touch must not be a pair whose merge would have come before. Pieces made out of score order are
        rare; they are merged in full.
        """
        if any(len(x) > 1 and self.split[x] is None for x in (s, t)):
            return self.merge(s + t) == [s, t]
        score, first = self.score, float("inf")
        a, b = s, t
        if a + b in score:
            return False
        while len(a) > 1 or len(b) > 1:
            made_a, made_b = (score[x] if len(x) > 1 else first for x in (a, b))
            if made_a < made_b:
                a, limit = self.split[a][1], made_a
                if score.get(a + b, -first) > limit:
                    return False
            else:  # of equals the left one is made first
                b, limit = self.split[b][0], made_b
                if score.get(a + b, -first) >= limit:
                    return False
        return True

    def ask(self, left: int, right: int) -> bool:
        """:meth:`compatible` by ids, remembered; a character outside the vocabulary is in no merge."""
        if self.asked >= MEMO_PAIRS:
            self.asked = 0
            for known in self.fits.values():
                known.clear()
        self.asked += 1
        answer = self.fits[self.pieces[right]][left] = left < 0 or self.compatible(self.pieces[left], self.pieces[right])
        return answer

    def last_tokens(self, text: str) -> list[int]:
        """The last token of every prefix of one unit with spaces escaped: the longest piece that ends there and fits what it starts after."""
        last = list(map(self.single.get, text))
        if None in last:
            last = [-1 - ord(c) if i is None else i for i, c in zip(last, text)]
        settled = -1
        for end, (size, piece, known) in self.automaton.iter(text):  # ends in order, the longest piece of an end first
            if end != settled:
                if end >= size:
                    left = last[end - size]
                    fits = known.get(left)
                    if not (self.ask(left, piece) if fits is None else fits):
                        continue
                last[end] = piece
                settled = end
        return last

    def ids(self, text: str) -> list[int]:
        """The encoding of one unit with spaces escaped: last tokens from the end backwards."""
        last, size = self.last_tokens(text), self.size
        out, i = [], len(text) - 1
        while i >= 0:
            t = last[i]
            if t >= 0:
                out.append(t)
                i -= size[t]
            else:
                out += [self.byte_id[b] for b in reversed(chr(-1 - t).encode())]
                i -= 1
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces side by side are read as UTF-8 (each wrong byte gives U+FFFD), the dummy prefix goes."""
        return self._surface(ids)[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else self._surface(ids)

    def _surface(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_read(bytes(run)))
                run.clear()
            if i >= 0:
                out.append(self.surface[i])
        return "".join(out)

    def _unit(self, unit: str) -> tuple[str, int, str]:
        ids = self.ids(unit.replace(" ", SPACE))
        number = self.number
        return ",".join([number[i] for i in ids]), len(ids), self._surface(ids)

    def cut(self, text: str) -> list[str]:
        """Units of a text with its dummy prefix; every one starts with a space or stands alone."""
        return self.unit.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.cut(text) for i in self.ids(u.replace(" ", SPACE))]


def _read(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    """One table for each worker and model."""
    return PieceTable(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = piece_table(path)
    units = table.units
    for b in slices(batches, BATCH_ROWS):
        n, ids_sha, decoded_sha = [], [], []
        for text in b.column("text").to_pylist():
            ids, count, decoded = zip(*[units[u] for u in table.cut(text)]) if text else ((), (), ())
            n.append(sum(count))
            ids_sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256("".join(decoded)[1:].encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = piece_table(path)
    for b in slices(batches, BATCH_ROWS):
        ids = [[int(i) for u in table.cut(t or "") for i in table.units[u][0].split(",")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = piece_table(path)
    for b in slices(batches, BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([table.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["id", "text"])


def _map(df: DataFrame, columns: list[F.Column], run, path: str, out: str) -> DataFrame:  # noqa: ANN001
    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(lambda it: run(it, path), out)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` for every row, without begin or end ids. Null and empty texts have no ids; ids of rows may be null or repeat."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _map(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], _encoded, model, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` for every row; null ids read as the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return _map(encoded, [F.col(id_col).alias("id"), F.col(ids_col).alias("ids")], _decoded, model, f"id {kind}, text string").withColumnRenamed("id", id_col)


def piece_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row: encoded, then decoded, without carrying the ids.

    A null text is empty; an empty text has no ids and decodes to nothing. Rows that repeat and null ids keep a row each; texts of
    any length are encoded whole. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _map(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], _digests, model, out).withColumnRenamed("id", id_col)
