"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows drawn from a bounded sample of labelled
rows. It labels every byte of every text; a document's probabilities are the mean over its positions. Texts are read in
windows of fixed width, laid side by side, so that one step of the recurrence serves thousands of windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.llm.suffix import _bytes_of
from mutprox.llm.tokens import slices
from mutprox.session import ship

UNKNOWN = "und"
BATCH_ROWS = 512
#: Bytes of a window in prediction, windows laid side by side.
WIDTH, LANES = 128, 2048
#: Shares of a language that are ranked apart before its sample is drawn.
SHARES = 64
#: Unicode letters (category L); other word characters, such as superscript digits or Roman numerals, are none.
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and settings of the descent; the bounds hold at every size of the corpus."""

    rows_per_language: int = 300
    windows_per_row: int = 3
    width: int = 64
    hidden: int = 10
    steps: int = 160
    lanes: int = 160
    rate: float = 0.02
    seed: int = 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights: ``x`` bytes to gates (reset, update, candidate), ``u`` state to gates, ``w`` states to labels."""

    def __init__(self, labels: list[str], hidden: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = draw(256, 3 * hidden, scale=0.3)
            self.p["u" + d] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p["c" + d] = np.zeros(hidden, np.float32)
            self.p["w" + d] = draw(hidden, len(labels), scale=0.3)
        self.p["o"] = np.zeros(len(labels), np.float32)

    def states(self, d: str, codes: np.ndarray, live: np.ndarray | None, trace: list | None = None) -> np.ndarray:
        """States after each byte; ``codes``: position by lane. Where ``live`` is 0 the state starts afresh."""
        n, x, u, c = self.hidden, self.p["x" + d], self.p["u" + d], self.p["c" + d]
        h = np.zeros((codes.shape[1], n), np.float32)
        out = np.empty((*codes.shape, n), np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            gx, gh = x[codes[t]], h @ u
            g = _sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
            r, z, k = g[:, :n], g[:, n:], gh[:, 2 * n :] + c
            m = np.tanh(gx[:, 2 * n :] + r * k)
            new = m + z * (h - m)
            if live is not None:
                new *= live[t][:, None]
            if trace is not None:
                trace.append((t, h, r, z, k, m))
            out[t] = h = new
        return out

    def probabilities(self, codes: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every position of every lane."""
        score = self.states("f", codes, live) @ self.p["wf"] + self.states("b", codes, live) @ self.p["wb"] + self.p["o"]
        score = np.exp(score - score.max(axis=-1, keepdims=True))
        return score / score.sum(axis=-1, keepdims=True)

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions, and its gradients by backpropagation through time."""
        n, trace = self.hidden, {"f": [], "b": []}
        states = {d: self.states(d, codes, None, trace[d]) for d in "fb"}
        score = states["f"] @ self.p["wf"] + states["b"] @ self.p["wb"] + self.p["o"]
        prob = np.exp(score - score.max(axis=-1, keepdims=True))
        prob /= prob.sum(axis=-1, keepdims=True)
        lanes, size = np.arange(codes.shape[1]), codes.size
        loss = -float(np.log(prob[:, lanes, target] + 1e-9).mean())
        prob[:, lanes, target] -= 1
        prob /= size
        grads = {"o": prob.sum(axis=(0, 1))}
        for d in "fb":
            grads["w" + d] = np.einsum("tbh,tbk->hk", states[d], prob)
            back = prob @ self.p["w" + d].T
            gx, gu, gc = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["u" + d]), np.zeros_like(self.p["c" + d])
            dh = np.zeros((codes.shape[1], n), np.float32)
            for t, h, r, z, k, m in reversed(trace[d]):
                dh = dh + back[t]
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dk = dm * r
                dr = dm * k * r * (1 - r)
                by_state = np.concatenate([dr, dz, dk], axis=1)
                np.add.at(gx, codes[t], np.concatenate([dr, dz, dm], axis=1))
                gu += h.T @ by_state
                gc += dk.sum(axis=0)
                dh = dh * z + by_state @ self.p["u" + d].T
            grads |= {"x" + d: gx, "u" + d: gu, "c" + d: gc}
        return loss, grads

    def fit(self, windows: list[tuple[np.ndarray, int]], how: Training) -> list[float]:
        """Adam over batches with as many windows of each label; returns the losses."""
        rng = np.random.default_rng(how.seed)
        by_label: dict[int, list[np.ndarray]] = {}
        for codes, label in windows:
            by_label.setdefault(label, []).append(codes)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses, names = [], sorted(by_label)
        for step in range(1, how.steps + 1):
            target = np.array([names[i % len(names)] for i in range(max(how.lanes, len(names)))])
            codes = np.stack([by_label[k][rng.integers(len(by_label[k]))] for k in target], axis=1)
            loss, grads = self.gradients(codes, target)
            losses.append(loss)
            rate = how.rate * min(1.0, 2.2 * (1 - step / (how.steps + 1)))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return losses


def held_out(id_col: str = "doc_id") -> Column:
    """The fold kept from learning: crc32 of the id as text leaves 1 when divided by 3 (a null id counts as no text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of each ``lang`` with the smallest ``x``: first inside each hashed share of a language, then over the shares."""
    best = lambda by: F.row_number().over(W.partitionBy(*by).orderBy("x"))
    shares = rows.withColumn("share", F.pmod(F.xxhash64("x.draw"), F.lit(SHARES)))
    some = shares.withColumn("r", best(["lang", "share"])).filter(F.col("r") <= most)
    return some.withColumn("r", best(["lang"])).filter(F.col("r") <= most).select("lang", "x")


def train(docs: DataFrame, learn: Column, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit a network on a bounded sample of the rows where ``learn`` holds and language and text are there; None if there is none.

    Of each language the ``rows_per_language`` rows with the smallest hash of id and text are taken, however many there
    are, so that neither copies nor the order of the table can push others out; of each row some windows are drawn,
    anywhere in it.
    """
    sound = docs.filter(learn).filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("draw"))
    place = lambda k: F.substring("text", (F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.lit(1), F.length("text") - how.width)) + 1).cast("int"), F.lit(how.width))
    windows_of = F.array(*[place(k) for k in range(how.windows_per_row)])
    # the first rows of each language in the order of a hash of id and text; tasks keep no more than that many themselves
    order = F.struct("draw", windows_of.alias("parts"))
    rows = []
    labels = sorted(r["lang"] for r in sound.groupBy("lang").count().collect())
    if not labels:
        return None
    for k, found in _first_rows(sound.select("lang", order.alias("x")), how.rows_per_language).collect():
        rows.append((k, found["parts"]))
    windows = []
    for lang, parts in rows:
        for part in parts:
            raw = part.encode()[: how.width]
            raw = (raw * -(-how.width // len(raw)))[: how.width]
            windows.append((np.frombuffer(raw, np.uint8), labels.index(lang)))
    windows.sort(key=lambda x: (x[1], zlib.crc32(x[0].tobytes()), x[0].tobytes()))
    net = Network(labels, how.hidden, how.seed)
    net.fit(windows, how)
    return net


def pooled(net: Network, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over all positions of each row; zeros for an empty row."""
    sizes = np.diff(offsets)
    each = -(-sizes // WIDTH)
    row = np.repeat(np.arange(len(sizes)), each)
    first = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[row] + first * WIDTH
    length = np.minimum(WIDTH, offsets[row + 1] - start)
    sums = np.zeros((len(sizes), len(net.labels)))
    padded = np.r_[text, np.zeros(WIDTH, np.uint8)]
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), LANES):
        lane = order[at : at + LANES]
        steps = np.arange(length[lane].max())[:, None]
        codes = padded[start[lane] + steps]
        live = None if length[lane].min() == len(steps) else (steps < length[lane]).astype(np.float32)
        prob = net.probabilities(codes, live)
        if live is not None:
            prob *= live[:, :, None]
        np.add.at(sums, row[lane], prob.sum(axis=0, dtype=np.float64))
    return sums / np.maximum(sizes, 1)[:, None]


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, BATCH_ROWS):
        texts = b.column("text")
        if net is None:
            lang, score = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
        else:
            prob = pooled(net, *_bytes_of(texts))
            best = prob.argmax(axis=1) if len(prob) else []
            letters = [t is not None and LETTER.search(t) is not None for t in texts.to_pylist()]
            lang = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            score = [float(min(1.0, p[k])) if ok else 0.0 for p, k, ok in zip(prob, best, letters)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` for every row, learned from the rows outside the held-out fold.

    Null text and text without a letter give ``und`` with score 0, as does everything where nothing could be learned.
    Repeated rows are predicted alike and each kept; a null id belongs to the fold that learns. Texts are read to their end,
    however long. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    net = train(docs, ~held_out(id_col), how, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _predict(it, net), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
