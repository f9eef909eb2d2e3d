"""Best-fit decreasing packing of tokenized documents into windows.

Texts are tokenized where they are read; only pieces (id, place, length, checksum, and the ids if asked for) travel.
Overlong documents are first cut into full windows. Pieces are dealt by a hash to bins of bounded size, and each bin is
packed by itself: longest piece first into the open window that fits it most tightly, which a segment tree indexed by
remaining capacity finds. A bin wastes at most its last windows, so padding does not grow with the number of bins'
rows; windows of different bins have different sequence ids.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutprox.llm.tokens import slices
from mutprox.session import cut, ship

BATCH_ROWS = 512
#: Distinct words that one worker remembers, and the longest word that it does; only speed depends on them.
MEMO_WORDS, WORD_CHARS = 900_000, 64
#: Pieces of one bin.
BIN_ROWS = 40_000


#: Plain letters, then signs: the pre-tokenizer always cuts between the two, and case does not matter to the vocabulary.
PLAIN = re.compile(r"([A-Za-z]+)([^A-Za-z0-9\s\x80-\U0010FFFF]*)")


class WordTokenizer:
    """Ids of a text, put together from its words: the vocabulary's pre-tokenizer never joins across a space or line end."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        one = lambda t: self.model.encode(t, add_special_tokens=False).ids
        signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        if one("ABCxyz") != one("abcxyz") or any(one(f"ab{s}") != one("ab") + one(s) for s in signs) or one("ab cd\nef") != one("ab") + one("cd") + one("ef"):
            raise ValueError("a vocabulary without case that cuts words at blanks, line ends and signs is expected")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        known = self.words
        found = [list(map(known.get, words)) for words in split]  # what is known is looked up once
        new = list(dict.fromkeys(w for words, ids in zip(split, found) for w, x in zip(words, ids) if x is None))
        if len(known) + len(new) > MEMO_WORDS:
            known.clear()
            known[""] = b""
        parts = [(m[1].lower(), m[2]) if (m := PLAIN.fullmatch(w)) else (w,) for w in new]
        ask = list(dict.fromkeys(p for word in parts for p in word if p not in known))
        for at in range(0, len(ask), 10_000):
            some = ask[at : at + 10_000]
            for p, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False)):
                known[p] = array.array("I", e.ids).tobytes()
        for w, word in zip(new, parts):
            known[w] = b"".join([known[p] for p in word])
        out = [b"".join([known[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids) for words, ids in zip(split, found)]
        for w in (*new, *ask):
            if len(w) > WORD_CHARS:
                known.pop(w, None)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    end, step = end_id.to_bytes(4, "little"), 4 * window
    for b in slices(batches, BATCH_ROWS):
        who, start, length, crc, total, ids = [], [], [], [], [], []
        for i, raw in enumerate(tokenizer(path).encode(b.column("text").to_pylist())):
            raw += end
            for at in range(0, len(raw), step):
                part = raw[at : at + step]
                who.append(i)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(len(raw) // 4)
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        cols = [b.column("id").take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over capacities 0 .. size - 1."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.at: dict[int, list[tuple[int, int]]] = {}

    def put(self, capacity: int, sequence: int, used: int) -> None:
        if not capacity:
            return
        self.at.setdefault(capacity, []).append((sequence, used))
        i = capacity + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """The tightest open window with room for ``need``: its capacity, sequence and used length."""
        i = need + self.size
        while not self.tree[i]:
            while i & 1:  # a right child: what follows starts at its parent's right neighbour
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        stack = self.at[capacity]
        sequence, used = stack.pop()
        if not stack:
            self.tree[i] = 0
            i >>= 1
            while i and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
                i >>= 1
        return capacity, sequence, used


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and place in it for each length, given in decreasing order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    spaces, made = OpenWindows(window), 0
    for k, n in enumerate(lengths.tolist()):
        found = spaces.take(n)
        if found is None:
            found = window, made, 0
            made += 1
        capacity, sequence[k], offset[k] = found
        spaces.put(capacity - n, found[1], found[2] + n)
    return sequence, offset


def _bin(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    sequence, offset = best_fit(rows["length"].to_numpy(), window)
    return rows.assign(sequence_id=rows["bin"].to_numpy() * (1 << 32) + sequence, offset=offset).drop(columns="bin")


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their place in windows of ``window`` tokens.

    ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``. Null text is empty: its
    one piece holds the end id. Rows with null or repeated ids are packed one by one. An empty table has no pieces.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cols = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = cut(made.mapInArrow(lambda it: _pieces(it, path, window, end_id, with_ids), cols))
    # the place in the written table spreads pieces that are equal in everything, such as those of null texts without an id
    bins = max(1, -(-made.count() // BIN_ROWS))
    dealt = made.withColumn("bin", F.pmod(F.xxhash64("id", "start", "ids_crc32", "doc_tokens", F.monotonically_increasing_id()), F.lit(bins)))
    packed = dealt.groupBy("bin").applyInPandas(lambda rows: _bin(rows, window), f"{cols}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
