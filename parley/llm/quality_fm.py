"""Document quality from a factorisation machine (operator 13).

A document is a sparse vector: the distinct words of the whole text hashed to ``WORDS``
buckets (together of length 1), statistics of its structure and given metadata columns,
each as a value and as the quantile bin it falls in. The logit is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with vectors v of ``RANK`` numbers. All pairs cost one pass over the entries, since
their sum is half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2.

Training is numpy on the driver, on at most ``SAMPLE`` labelled rows (the first by a hash of
doc_id); their whole texts become entries in tasks, and only these are collected: at most
``WORDS`` two-byte numbers and some statistics a row. Four fifths of the rows are fitted by
gradient steps on the logistic loss, the others set the slope of the score and the logit
that scores ``CUT``. Scoring needs only the weights (under 1 MB), which are broadcast.

Cases: null and empty texts have no words and statistics of 0, and get a score; null
metadata are a bin of their own; labels that are null are not learned from; without labels
of both kinds every score is the share of positives seen (0 if none); extra columns pass
through; repeated rows are scored alike; a label counts for every row of its doc_id until
SAMPLE rows are taken; an empty table gives an empty result. The score is the last column,
``_quality`` or, where that name is taken, ``_quality`` with underscores appended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import free_name, row_slices, text_bytes

SAMPLE, WORDS, RANK, CUT = 4000, 1 << 14, 8, 0.3
EPOCHS, BATCH, RATE, DECAY = 25, 128, 0.02, 1e-4
#: Weight of one statistic's entries beside words of length 1.
STAT = 0.5
BINS = 8
STATS = ("log_words", "word_bytes", "distinct", "top_word", "echo", "symbols", "marks", "capitals", "digits", "stops", "line_words", "repeat_lines", "beyond_ascii", "lone_symbols")


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS, MARKS, CAPITALS, DIGITS, STOPS = (_set(c) for c in (b"#$%&*|<>+=~^_{}[]\\@", b"!?", bytes(range(65, 91)), b"0123456789", b".,;:"))


def _share(rows: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(rows, minlength=n) / np.maximum(of, 1)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of all distinct words of rows, in order, and the rows' statistics."""
    n = len(offs) - 1
    start, end, rows = tk.words(data, offs)
    n_words = tk.word_counts(rows, n)
    keys = tk.span_hash(tk.LOWER[data], start, end)
    bucket = (tk.mix(keys) >> tk.U(64 - 14)).astype(np.int64)
    pair = np.unique(rows * WORDS + bucket)
    each, inverse, count = np.unique(np.stack([rows.astype(tk.U), keys]), axis=1, return_inverse=True, return_counts=True) if len(rows) else (np.zeros((2, 0), tk.U), None, np.zeros(0, np.int64))
    top = np.zeros(n)
    np.maximum.at(top, each[0].astype(np.int64), count)
    n_bytes = np.diff(offs)
    sums = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offs])
    echo = np.flatnonzero((rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1]))
    l_start, l_end, l_rows = tk.lines(data, offs)
    full = l_end > l_start
    _, later = tk.repeated_within(tk.span_hash(data, l_start[full], l_end[full]), l_rows[full])
    n_lines = np.bincount(l_rows[full], minlength=n)
    high = np.zeros(256, bool)
    high[128:] = True
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    alone = np.flatnonzero((end - start == 1) & SYMBOLS[last])
    stats = [
        np.log1p(n_words), np.bincount(rows, weights=end - start, minlength=n) / np.maximum(n_words, 1), np.bincount(each[0].astype(np.int64), minlength=n) / np.maximum(n_words, 1), top / np.maximum(n_words, 1),
        _share(rows[echo], n, n_words), sums(SYMBOLS) / np.maximum(n_bytes, 1), sums(MARKS) / np.maximum(n_bytes, 1), sums(CAPITALS) / np.maximum(n_bytes, 1), sums(DIGITS) / np.maximum(n_bytes, 1),
        _share(rows[np.flatnonzero(STOPS[last])], n, n_words), np.log1p(n_words / np.maximum(n_lines, 1)), _share(l_rows[full][later], n, n_lines), sums(high) / np.maximum(n_bytes, 1), _share(rows[alone], n, n_words),
    ]
    return pair // WORDS, pair % WORDS, np.stack(stats, axis=1).astype(np.float32).reshape(n, len(STATS))


class Machine:
    """Weights, and the bins and scales of the dense columns (statistics, then metadata)."""

    def __init__(self, dense: np.ndarray) -> None:
        d = dense.shape[1]
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.edges = np.zeros((d, BINS - 1))
        for k in range(d):
            x = dense[np.isfinite(dense[:, k]), k].astype(np.float64)
            if len(x):
                self.mean[k], self.scale[k] = x.mean(), max(x.std(), 1e-6)
                self.edges[k] = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])
        size = WORDS + d * (2 + BINS)
        rng = np.random.default_rng(13)
        self.w, self.v, self.b = np.zeros(size), 0.05 * rng.standard_normal((size, RANK)), 0.0
        self.slope, self.at = 1.0, 0.0

    def entries(self, rows: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column and value of every entry, row by row, and the first entry of each row."""
        n, d = dense.shape
        known = np.isfinite(dense)
        value = np.clip((np.where(known, dense, self.mean) - self.mean) / self.scale, -3, 3)
        cell = np.stack([np.searchsorted(self.edges[k], dense[:, k], "right") for k in range(d)], axis=1) if n else np.zeros((0, d), int)
        cell = np.where(known, cell, BINS)  # a bin for what is missing
        base = WORDS + np.arange(d) * (2 + BINS)
        count = np.bincount(rows, minlength=n)
        total = count + 2 * d
        first = np.cumsum(total) - total
        col, x = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()))
        at = first[rows] + np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
        col[at], x[at] = bucket, 1 / np.sqrt(np.maximum(count, 1))[rows]
        at = (first + count)[:, None] + np.arange(2 * d)
        col[at], x[at] = np.concatenate([np.tile(base, (n, 1)), base + 1 + cell], axis=1), np.concatenate([value * STAT / 2, np.full((n, d), STAT)], axis=1)
        return col, x, first

    def logits(self, col: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and for each row the sum of v_i x_i."""
        if not len(first):
            return np.zeros(0), np.zeros((0, RANK))
        vx = self.v[col] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first)
        return self.b + np.add.reduceat(self.w[col] * x, first) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, logits: np.ndarray) -> np.ndarray:
        z = self.slope * (logits - self.at) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(self, col: np.ndarray, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Columns touched, and the gradient of the mean logistic loss in w, v and b."""
        z, sums = self.logits(col, x, first)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(col))))
        used, at = np.unique(col, return_inverse=True)
        dx = d[row] * x
        g_w = np.bincount(at, weights=dx, minlength=len(used))
        g_v = dx[:, None] * (sums[row] - self.v[col] * x[:, None])
        return used, g_w, np.stack([np.bincount(at, weights=g_v[:, r], minlength=len(used)) for r in range(RANK)], axis=1), float(d.sum())


def fit(buckets: list[np.ndarray], dense: np.ndarray, good: np.ndarray) -> Machine | float:
    """From each sampled document's distinct word buckets, dense columns and label; with one
    kind of label only, the share of positives."""
    good = np.asarray(good, bool)
    if not len(good) or good.all() or not good.any():
        return float(good.mean()) if len(good) else 0.0
    m = Machine(dense)
    part = lambda at: m.entries(np.repeat(np.arange(len(at)), [len(buckets[k]) for k in at]), np.concatenate([np.zeros(0, np.int64), *(buckets[k] for k in at)]).astype(np.int64), dense[at])
    rng = np.random.default_rng(5)
    order = np.concatenate([rng.permutation(np.flatnonzero(good == kind)) for kind in (True, False)])
    check = order[::5] if (~good).sum() >= 10 and good.sum() >= 10 else order
    train = np.setdiff1d(order, check) if len(check) < len(order) else order
    m.b = float(np.log(good[train].mean() / max(1e-3, 1 - good[train].mean())))
    held = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
    steps, step = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(train)
        for a in range(0, len(shuffled), BATCH):
            at = shuffled[a : a + BATCH]
            used, g_w, g_v, g_b = m.gradient(*part(at), good[at])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, g, (first, second) in ((m.w, g_w, held[:2]), (m.v, g_v, held[2:])):
                g = g + DECAY * p[used]
                first[used] += 0.1 * (g - first[used])
                second[used] += 0.02 * (g * g - second[used])
                p[used] -= rate * first[used] / (np.sqrt(second[used]) + 1e-6)
            m.b -= rate * g_b
    logits, _ = m.logits(*part(check))
    m.at = best_cut(logits, good[check])
    spread = logits - m.at
    for _ in range(300):  # the slope that makes scores fit the labels, around the cut
        d = m.score(logits) - good[check]
        m.slope = max(0.2, m.slope - 0.5 * float((d * spread).mean() / max(1e-6, (spread**2).mean())))
    return m


def best_cut(logits: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors, each kind weighed as a half; midway between neighbours, in the middle of ties."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], good[order]
    lost = np.concatenate([[0], np.cumsum(y / max(1, y.sum()))]) + np.concatenate([[0], np.cumsum(~y / max(1, (~y).sum()))])[-1] - np.concatenate([[0], np.cumsum(~y / max(1, (~y).sum()))])
    at = np.flatnonzero(lost <= lost.min() + 1e-12)
    k = int(at[len(at) // 2])
    return float((x[max(0, k - 1)] + x[min(k, len(x) - 1)]) / 2)


def _dense(stats: np.ndarray, meta: Sequence[pa.Array]) -> np.ndarray:
    """Statistics, then the metadata on a log scale; missing ones are NaN."""
    more = [np.asarray(x.to_numpy(zero_copy_only=False), np.float64) for x in meta]
    return np.column_stack([stats, *(np.sign(x) * np.log1p(np.abs(x)) for x in more)]) if more else stats.astype(np.float64)


def _slices(text: pa.Array) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    data, offs = text_bytes(text)
    for a, b in row_slices(offs):
        yield a, b, features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def _meta(docs: DataFrame, metadata: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in metadata if c in docs.columns]


def train(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), label: str = "quality") -> Machine | float:
    """Fit on a bounded sample of ``labels`` (doc_id and the label, 1 for good) joined with their texts."""
    meta = _meta(docs, metadata)
    pick = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, stats = [], [np.zeros((0, len(STATS)))]
            for a, b, (rows, bucket, s) in _slices(batch.column(2)):
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                words += [bucket[i:j].astype(np.uint16).tobytes() for i, j in zip(cut, cut[1:])]
                stats.append(s)
            dense = _dense(np.concatenate(stats), batch.columns[3:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array([x.tobytes() for x in dense], pa.binary())], ["doc_id", "good", "words", "dense"])

    rows = docs.select("doc_id", "text", *(c.alias(f"m{k}") for k, c in enumerate(meta))).join(F.broadcast(pick), "doc_id")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "good", "text", *(f"m{k}" for k in range(len(meta)))).mapInArrow(run, "doc_id long, good int, words binary, dense binary")
    rows = rows.orderBy("doc_id", "good", F.xxhash64("words", "dense")).limit(SAMPLE).toArrow()
    dense = np.frombuffer(b"".join(rows.column("dense").to_pylist()), np.float64).reshape(rows.num_rows, len(STATS) + len(meta))
    return fit([np.frombuffer(x, np.uint16) for x in rows.column("words").to_pylist()], dense, np.array(rows.column("good").to_pylist(), np.int64) == 1)


def with_quality(docs: DataFrame, machine: Machine | float, metadata: Sequence[str] = ("n_chars",)) -> DataFrame:
    """``docs`` plus a last column, the score: a double in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(text: pa.Array, *meta: pa.Array) -> pa.Array:
        m = shared.value
        if isinstance(m, float):
            return pa.array(np.full(len(text), m))
        out = [np.zeros(0)]
        for a, b, (rows, bucket, stats) in _slices(text):
            out.append(m.score(m.logits(*m.entries(rows, bucket, _dense(stats, [x.slice(a, b - a) for x in meta])))[0]))
        return pa.array(np.concatenate(out))

    return docs.withColumn(free_name(docs.columns, "_quality"), F.arrow_udf(run, "double")(F.col("text"), *_meta(docs, metadata)))
