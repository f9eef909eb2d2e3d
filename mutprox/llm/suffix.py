"""Suffix-array dedup: removal of long byte strings that also start earlier, with a run-length index.

A string of ``window`` bytes is removed wherever an equal string starts earlier (smaller id, or same document and
earlier start). Steps:

1. Every window is dealt to its anchor, the smallest of its hashed 32-byte strings. Equal windows have equal anchors.
   Only (anchor hash, hash of its windows' bytes, document, first window, count) is shuffled. Anchors seen once end here;
   where the bytes are the same, all but the earliest are settled here.
2. Documents that lose something or hold an anchor in differing contexts are met with their text, which gives each such
   anchor its context: the bytes of its own windows.
3. Contexts of one anchor meet in one partition. Their Burrows-Wheeler transform is kept as runs with the text places of
   both run ends; the suffix order itself is dropped. Matching statistics are streamed backwards over the runs: inside a
   run a match grows by one byte to the left, at run ends it is measured against the sampled place. Where a match reaches
   ``window`` bytes, all but the earliest of the equal windows are marked.
4. Marked stretches go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutprox.llm.tokens import slices
from mutprox.session import cut, drop_cut, ship

WINDOW = 100
ANCHOR = 32
BATCH_ROWS = 1024
#: Bytes of contexts that one index takes.
INDEX_BYTES = 1 << 19
#: Windows handled at once; positions inside a block fit the low bits of a sort key.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_NO_ID = 2**63 - 1
_FACTOR = 0xA0761D6478BD642F
with np.errstate(over="ignore"):
    _POWER, _INVERSE = (np.cumprod(np.r_[np.uint64(1), np.full(BLOCK + WINDOW * 8, np.uint64(f), np.uint64)], dtype=np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _anchor_hash(text: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each string of ANCHOR bytes."""
    h, width, factor = _RANDOM[text], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while width < ANCHOR:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, width * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = key, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(text: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchor hash, row, first window (offset in its row), number of neighbouring windows and hash of their bytes, for all windows of all rows."""
    n = len(text)
    inside = np.zeros(n + 1, np.int32)
    last = np.maximum(offsets[1:] - window + 1, offsets[:-1])
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside[:-1]) > 0
    span = window - ANCHOR + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n - window + 1, BLOCK):
        part = text[at : at + BLOCK + window - 1]
        h = _anchor_hash(part)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        where = _smallest(key, span) & _LOW
        mine = np.flatnonzero(inside[at : at + len(where)])
        if len(mine):
            where = where[mine]
            heads = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (np.diff(mine) != 1)])
            count = np.diff(np.r_[heads, len(mine)])
            found.append((h[where[heads].astype(np.int64)], mine[heads] + at, count, _context_hash(part, mine[heads], mine[heads] + count + window - 1)))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    h, first, count, context = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, first, "right") - 1
    return h, row, first - offsets[row], count, context


def _context_hash(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A polynomial hash of each stretch, from sums of prefixes; the powers of an odd factor can be divided out."""
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_RANDOM[text] * _POWER[: len(text)], dtype=np.uint64)]
        return (sums[stop] - sums[start]) * _INVERSE[start]


def _pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window, a bit for settled, 7 bits of count; sorts by place."""
    return (first << 8) | count


def _first(pack: np.ndarray) -> np.ndarray:
    return pack >> 8


def _count(pack: np.ndarray) -> np.ndarray:
    return pack & 0x7F


#: All windows of the row are known to start earlier elsewhere.
SETTLED = 0x80


def _later_copies(h: np.ndarray, context: np.ndarray, count: np.ndarray, doc: np.ndarray, mark: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """Which rows repeat the context of an earlier row among these."""
    order = np.lexsort((pack, mark, doc, context, h))
    h, context, count, doc, mark, pack = (x[order] for x in (h, context, count, doc, mark, pack))
    fresh = np.r_[True, (h[1:] != h[:-1]) | (context[1:] != context[:-1]) | (count[1:] != count[:-1])]
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    out = np.zeros(len(h), bool)
    out[order] = (doc != doc[lead]) | (mark != mark[lead]) | (pack != pack[lead])
    return out


def _spread(doc: np.ndarray, pack: np.ndarray) -> np.ndarray:
    return doc * 1_000_003 + (pack >> 8) * 7919


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows ``h, c, doc, mark, pack``: anchor, context hash, document (order key and mark of its text) and place. What an earlier row of the batch settles gets a place of its own for its anchor: hot anchors stay small."""
    for b in slices(batches, BATCH_ROWS):
        h, row, first, count, context = anchors(*_bytes_of(b.column("text")), window)
        doc, mark = b.column("doc").to_numpy()[row], b.column("mark").to_numpy()[row]
        pack, h = _pack(first, count), h.view(np.int64)
        if not len(h):
            continue
        later = _later_copies(h, context, count, doc, mark, pack)
        cols = (np.where(later, _spread(doc, pack), h), context.view(np.int64), doc, mark, np.where(later, pack | SETTLED, pack))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "doc", "mark", "pack"])


def _repeated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled rows, and rows whose anchor stands in different contexts; of equal contexts all but the earliest are settled here."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    h, c, doc, mark, pack = (t.column(k).to_numpy() for k in ("h", "c", "doc", "mark", "pack"))
    settled = pack & SETTLED != 0
    own = np.flatnonzero(~settled)
    later = _later_copies(h[own], c[own], _count(pack[own]), doc[own], mark[own], pack[own]) if len(own) else np.zeros(0, bool)
    pack = pack.copy()
    pack[own[later]] |= SETTLED
    settled[own[later]] = True
    first = own[~later]
    first = first[np.lexsort((_count(pack[first]), c[first], h[first]))]
    s = h[first]
    new = np.r_[True, (s[1:] != s[:-1]) | (c[first][1:] != c[first][:-1]) | (_count(pack[first])[1:] != _count(pack[first])[:-1])][: len(s)]
    kinds = np.zeros(len(s), np.int64)
    if len(s):
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        kinds = np.repeat(np.add.reduceat(new.astype(np.int64), start), np.diff(np.r_[start, len(s)]))
    rows = np.sort(np.r_[np.flatnonzero(settled), first[kinds > 1]])
    out = pa.Table.from_arrays([pa.array(h[rows]), pa.array(doc[rows]), pa.array(mark[rows]), pa.array(pack[rows])], ["h", "doc", "mark", "pack"])
    yield from out.to_batches(1 << 16)


def _contexts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Contexts of rows that are not settled; equal contexts that come later in the batch have a null one."""
    for b in slices(batches, BATCH_ROWS):
        text, offsets = _bytes_of(b.column("text"))
        lists = b.column("found")
        flat = lists.flatten()
        h, pack = flat.field("h").to_numpy(), flat.field("pack").to_numpy()
        doc, mark = (np.repeat(b.column(c).to_numpy(), lists.value_lengths().to_numpy()) for c in ("doc", "mark"))
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        start = offsets[row] + _first(pack)
        stop = start + _count(pack) + window - 1
        raw = text.tobytes()
        earliest: dict[bytes, tuple[int, int, int]] = {}
        sent: list[bytes | None] = [None] * len(h)
        asked = np.flatnonzero(pack & SETTLED == 0).tolist()
        for i, a, z, k in zip(asked, start[asked].tolist(), stop[asked].tolist(), zip(doc[asked].tolist(), mark[asked].tolist(), pack[asked].tolist())):
            c = sent[i] = raw[a:z]
            if k < earliest.setdefault(c, k):
                earliest[c] = k
        for i, k in zip(asked, zip(doc[asked].tolist(), mark[asked].tolist(), pack[asked].tolist())):
            if earliest[sent[i]] != k:
                sent[i] = None
        if asked:
            h, doc, mark, pack, sent = h[asked], doc[asked], mark[asked], pack[asked], [sent[i] for i in asked]
            h = np.where([c is None for c in sent], _spread(doc, pack), h)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(mark), pa.array(pack), pa.array(sent, pa.binary())], ["h", "doc", "mark", "pack", "context"])


def suffix_order(symbols: np.ndarray, text_of: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling. ``symbols``: byte + 1, and 0 after each text; the ends sort first, by text, and no order looks past one."""
    n = len(symbols)
    pad = np.r_[symbols, np.zeros(8, np.uint16)].astype(np.uint64)
    key, over = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(7):  # seven symbols of nine bits
        over |= pad[k : n + k] == 0
        key = key << np.uint64(9) | np.where(over, np.uint64(0), pad[k : n + k])
    order, rank = _ranked(key)
    order, rank = _ranked(rank * (int(text_of[-1]) + 2) + np.where(over, text_of + 1, 0))
    width = 7
    while width <= longest and rank[order[-1]] < n - 1:
        order, rank = _ranked(rank * (n + 1) + np.r_[rank[width:], np.zeros(min(width, n), np.int64)][:n])
        width *= 2
    return order


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys and the rank of each, equal ones alike."""
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
    return order, rank


class RunIndex:
    """Run-length index of several distinct texts: the runs of their Burrows-Wheeler transform and the text places at both ends of each run.

    Nothing else of the suffix order is kept. From a row of the order, a step goes to the row of the suffix that is one
    byte longer (``LF``); rows of one run step side by side.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.n, sizes = len(texts), np.array([len(t) for t in texts])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        #: place of each text's end, and of its start
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.text_of = np.repeat(np.arange(self.n), sizes + 1)
        symbols = raw.astype(np.uint16) + 1
        symbols[self.end] = 0
        order = suffix_order(symbols, self.text_of, int(sizes.max(initial=0)) + 1)
        bwt = np.where(np.isin(order, self.start, assume_unique=True), 0, symbols[order - 1])
        self.row = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.char, length = bwt[self.row], np.diff(np.r_[self.row, len(bwt)])
        self.last_row = self.row + length - 1
        #: sampled run ends: text places of the first and of the last row of each run
        self.first, self.last = order[self.row], order[self.last_row]
        by = np.argsort(self.char, kind="stable")
        self.lf = np.empty(len(by), np.int64)
        self.lf[by] = np.cumsum(length[by]) - length[by]
        #: the run whose last row steps to the row before, or whose first row steps to the row behind, what a run steps to
        self.before, self.behind = np.full(len(by), -1), np.full(len(by), -1)
        self.before[by[1:]], self.behind[by[:-1]] = by[:-1], by[1:]
        self.before[self.char == 0] = -1
        self.before[np.isin(self.before, np.flatnonzero(self.char == 0))] = -1
        self.first_byte = int(order[self.n]) if len(order) > self.n else -1
        #: eight bytes from each place, to compare by
        wide = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
        self.words = wide[: len(raw)] << np.uint64(56)
        for k in range(1, 8):
            self.words |= wide[k : len(raw) + k] << np.uint64(56 - 8 * k)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the texts at places ``p`` and ``q`` have in common from there on, compared byte by byte; none where ``q`` is negative."""
        room = np.where(q < 0, 0, np.minimum(self.end[self.text_of[p]] - p, self.end[self.text_of[q]] - q))
        out, on = np.zeros(len(p), np.int64), np.flatnonzero(room > 0)
        while len(on):
            x = self.words[p[on] + out[on]] ^ self.words[q[on] + out[on]]
            same = np.full(len(on), 8)
            differ = x != 0
            # the place of the highest bit set, by halves
            top, bits = x[differ], np.zeros(int(differ.sum()), np.int64)
            for shift in (32, 16, 8):
                high = top >> np.uint64(shift) != 0
                bits += np.where(high, shift, 0)
                top = np.where(high, top >> np.uint64(shift), top)
            same[differ] = 7 - bits // 8
            out[on] = np.minimum(out[on] + same, room[on])
            on = on[(same == 8) & (out[on] < room[on])]
        return out

    def statistics(self) -> tuple[np.ndarray, ...]:
        """Matching statistics of every text, streamed backwards over the runs, all texts abreast.

        For each place: its row, and the length it has in common with the suffix before it and behind it in the order; the
        longer of the two is the longest match of what starts there with anything that starts elsewhere. Inside a run both
        neighbours step along and a match grows by one byte; at a run's end the neighbour is the sampled end of another
        run, and the match is measured.
        """
        total = int(self.end[-1]) + 1
        row, above, below = (np.zeros(total, np.int64) for _ in range(3))
        text = np.arange(self.n)
        at, now = self.end.copy(), text.copy()
        row[at] = now
        src_a, len_a = np.where(text > 0, self.end[text - 1], -1), np.zeros(self.n, np.int64)
        src_b, len_b = np.r_[self.end[1:], self.first_byte], np.zeros(self.n, np.int64)
        while True:
            live = np.flatnonzero(at > self.start[text])
            text, at, now, src_a, len_a, src_b, len_b = (x[live] for x in (text, at, now, src_a, len_a, src_b, len_b))
            if not len(text):
                return row, above, below
            run = np.searchsorted(self.row, now, "right") - 1
            head, tail = now == self.row[run], now == self.last_row[run]
            now, at = self.lf[run] + now - self.row[run], at - 1
            src_a, len_a, src_b, len_b = src_a - 1, len_a + 1, src_b - 1, len_b + 1
            hop = np.flatnonzero(head)
            near = self.before[run[hop]]
            src_a[hop] = np.where(near >= 0, self.last[near] - 1, self.end[-1])
            len_a[hop] = self.common(at[hop], src_a[hop])
            hop = np.flatnonzero(tail)
            near = self.behind[run[hop]]
            src_b[hop] = np.where(near >= 0, self.first[near] - 1, -1)
            len_b[hop] = self.common(at[hop], src_b[hop])
            row[at], above[at], below[at] = now, len_a, len_b

    def repeated(self, window: int) -> np.ndarray:
        """Places whose ``window`` bytes also start at an earlier place: where a match reaches the window, all but the earliest of equal ones."""
        row, above, below = self.statistics()
        held = np.flatnonzero(np.maximum(above, below) >= window)
        held = held[np.argsort(row[held], kind="stable")]
        if not len(held):
            return held
        heads = np.flatnonzero(above[held] < window)
        earliest = np.minimum.reduceat(held, heads)
        return np.sort(held[held != np.repeat(earliest, np.diff(np.r_[heads, len(held)]))])


def _marked(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Byte stretches to remove, from all contexts of one partition."""
    docs: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    stops: list[np.ndarray] = []

    def out(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        docs.append(doc), marks.append(mark), starts.append(start), stops.append(stop)

    kept: dict[tuple[int, bytes], tuple[int, int, int]] = {}

    def whole(rows: list[tuple[int, int, int]]) -> None:
        if rows:
            doc, mark, pack = (np.array(x, np.int64) for x in zip(*rows))
            out(doc, mark, _first(pack), _first(pack) + _count(pack) + window - 1)

    def found(rows: list[tuple[tuple[int, int, int], bytes]]) -> None:
        """Marks from one index over the contexts ``rows``, in the order of their documents."""
        doc, mark, pack = (np.array(x, np.int64) for x in zip(*(k for k, _ in rows)))
        index = RunIndex([c for _, c in rows])
        hit = index.repeated(window)
        own = index.text_of[hit]
        place = hit - index.start[own]
        if len(own):
            heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (np.diff(place) != 1)])
            tails = np.r_[heads[1:], len(own)] - 1
            first = _first(pack)[own[heads]]
            out(doc[own[heads]], mark[own[heads]], first + place[heads], first + place[tails] + window)

    for b in batches:
        gone = []
        for h, k, c in zip(b.column("h").to_pylist(), zip(b.column("doc").to_pylist(), b.column("mark").to_pylist(), b.column("pack").to_pylist()), b.column("context").to_pylist()):
            if c is None:
                gone.append(k)
                continue
            was = kept.setdefault((h, c), k)
            if k < was:
                kept[h, c] = k
                gone.append(was)
            elif k > was:
                gone.append(k)
        whole(gone)
    per: dict[int, int] = {}
    for h, _ in kept:
        per[h] = per.get(h, 0) + 1
    rows = sorted((h, k, c) for (h, c), k in kept.items() if per[h] > 1)
    kept.clear()
    # contexts of one anchor stay together; an index takes whole anchors up to a bound of bytes
    size, at = 0, 0
    for i, (h, _, c) in enumerate(rows):
        size += len(c)
        if i + 1 == len(rows) or size >= INDEX_BYTES and rows[i + 1][0] != h:
            found(sorted((k, c) for _, k, c in rows[at : i + 1]))
            size, at = 0, i + 1
    if docs:
        names = ["doc", "mark", "start", "stop"]
        yield from pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (docs, marks, starts, stops)], names).to_batches(1 << 16)


def _rest(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """What is left of each document, without its settled windows and the stretches found in step 3."""
    for b in slices(batches, BATCH_ROWS):
        rows = []
        for text, found, cuts in zip(b.column("text").to_pylist(), b.column("found"), b.column("cuts").to_pylist()):
            raw, at, removed, spans, left = text.encode(), 0, 0, 0, []
            end = -1
            pack = found.values.field("pack").to_numpy()  # the values of this row alone
            pack = pack[pack & SETTLED != 0]
            whole = zip(_first(pack).tolist(), (_first(pack) + _count(pack) + window - 1).tolist())
            for c in sorted([*whole, *((c["start"], c["stop"]) for c in cuts or [])]):
                if c[0] > end:
                    left.append(raw[max(at, 0) : c[0]])
                    spans += 1
                    removed += c[1] - c[0]
                    end = c[1]
                elif c[1] > end:
                    removed += c[1] - end
                    end = c[1]
                at = end
            left.append(raw[at:])
            rest = b"".join(left)
            rows.append((removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), b.column("mark"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
            ["doc", "mark", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def _touched(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """``docs``: doc, mark, text. A row for each document that loses bytes."""
    spark = ship(docs.sparkSession)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    every = docs.mapInArrow(lambda it: _anchor_rows(it, window), "h long, c long, doc long, mark long, pack long")
    repeated = cut(every.repartition(n, "h").mapInArrow(_repeated_rows, "h long, doc long, mark long, pack long"))
    lists = repeated.groupBy("doc", "mark").agg(F.collect_list(F.struct("h", "pack")).alias("found"))
    held = cut(docs.join(lists, ["doc", "mark"]))
    drop_cut(repeated)
    met = held.mapInArrow(lambda it: _contexts(it, window), "h long, doc long, mark long, pack long, context binary")
    cuts = met.repartition(n, "h").mapInArrow(lambda it: _marked(it, window), "doc long, mark long, start long, stop long")
    cuts = cut(cuts.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")))
    return held.join(cuts, ["doc", "mark"], "left").mapInArrow(
        lambda it: _rest(it, window, with_text), "doc long, mark long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    ).dropDuplicates(["doc", "mark"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    """Order key of a row and a mark of its text, which tells rows apart that repeat an id."""
    return F.coalesce(F.col(id_col), F.lit(_NO_ID)), F.xxhash64(text_col)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null text is empty. Rows that repeat an id with the same text are one document (they do not remove each other);
    with other text they follow each other in an order fixed by their text. Null ids come after all others.
    """
    doc, mark = _keyed(docs, id_col, text_col)
    own = docs.select(F.col(id_col), doc.alias("doc"), mark.alias("mark"), F.coalesce(text_col, F.lit("")).alias("text"))
    touched = _touched(own.select("doc", "mark", "text"), window, False)
    plain = own.select(id_col, "doc", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return plain.join(touched, ["doc", "mark"], "left").select(
        id_col, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the removed bytes gone from its text; columns as given, ``n_chars`` (if there) counted again.

    A character of which some bytes were removed goes as a whole. Rows whose text becomes empty stay; a null text stays
    null; null and repeated ids are as in :func:`repeat_digest`; an empty table stays empty.
    """
    doc, mark = _keyed(docs, id_col, text_col)
    keyed = docs.select("*", doc.alias("__doc"), mark.alias("__mark"))
    touched = _touched(docs.select(doc.alias("doc"), mark.alias("mark"), F.coalesce(text_col, F.lit("")).alias("text")), window, True)
    touched = touched.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("kept_text").alias("__kept"))
    out = keyed.join(touched, ["__doc", "__mark"], "left").withColumn(text_col, F.coalesce("__kept", text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
