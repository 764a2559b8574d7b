"""Hard negatives by angular triangle filtering (operator 11).

Every vector becomes integers, floor(256 x). An index table stores its norm and its
angles to a few reference directions. For an anchor a and a row x with angles s and t to
one direction, the angle between a and x lies in [abs(s - t), min(s + t, 2 pi - s - t)];
cosines of these ends times both norms bound the integer score, with room for every
rounding. Only rows whose bounds overlap a window that an anchor still asks for get an
integer product: first the best rows of the anchor's own label (its positives), then rows
of other labels within the window that each positive opens. Bounds are taken for groups of
rows with similar angles first, then for the single rows of the groups left.

Anchors come in blocks of at most about ``BLOCK_BYTES``; a block is broadcast and all rows
are read past it where they lie, so no vector is shuffled. Each task keeps the best few
rows of each anchor and window and only these are shuffled; each block's result is a
written table. Reference directions are picked from at most ``SAMPLE`` rows (the least by a
hash); they decide how much is pruned, never what is found.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; a zero or empty vector scores 0 with every row of its length; rows whose vectors have
other lengths than the anchor's have no score with it; rows with the anchor's id are not
other rows, whatever they hold; repeated candidate rows rank one after the other; equal
anchor rows count once, and unequal ones under one id are anchors each; components beyond
2**62 are cut to it and scores to the ends of a long; extra columns are not read; an empty
table or one without anchors gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import materialize, release

SAMPLE, REFERENCES, GROUP = 2048, 12, 256
BLOCK_BYTES, PAIRS = 16 << 20, 1 << 21
#: Stored angles are floats and arccos is inexact near 0: bounds give way by this share of both norms.
SLACK = 1e-5
LONG = np.iinfo(np.int64)

INDEX = "vec_id long, label long, vector array<double>, norm double, angles array<float>"
FOUND = "anchor_id long, number int, slot int, positive_id long, positive_score long, vec_id long, score long"


def vectors_of(col: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each vector length; rows with nulls or non-finite components are left out."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    start = np.asarray(col.offsets)
    size = np.diff(start)
    values = col.values
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = np.asarray(col.is_valid()) & (bad[start[1:]] == bad[start[:-1]])
    out = []
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        out.append((int(d), rows, x[start[rows][:, None] + np.arange(d)]))
    return out


def as_integers(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * 256), -(2.0**62), 2.0**62)


def angles_to(x: np.ndarray, norm: np.ndarray, refs: np.ndarray | None) -> np.ndarray:
    """Angles of rows to unit directions; a right angle, which bounds nothing, for zero rows and unknown lengths."""
    if refs is None or not x.shape[1]:
        return np.full((len(x), REFERENCES), np.pi / 2, np.float32)
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1)
    cos = (x / scale) @ refs.T / np.maximum(norm[:, None] / scale, 1e-300)
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), np.pi / 2).astype(np.float32)


def norms(x: np.ndarray) -> np.ndarray:
    scale = np.maximum(np.abs(x).max(axis=1, initial=0), 1)
    return scale * np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1))


def directions(sample: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Unit directions for each vector length: each next one is the row farthest from those before."""
    out = {}
    for d, _, x in vectors_of(sample):
        x = as_integers(x)
        n = norms(x)
        x = x[n > 0] / n[n > 0, None]
        if not d or not len(x):
            continue
        pick, near = [0], np.full(len(x), -np.inf)
        while len(pick) < REFERENCES:
            near = np.maximum(near, x @ x[pick[-1]])
            pick.append(int(near.argmin()))
        out[d] = x[pick]
    return out


def build_index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The stored table of usable rows: integer vector, norm and angles to the directions."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null")
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).select("vector").limit(SAMPLE).toArrow()
    refs = rows.sparkSession.sparkContext.broadcast(directions(sample.column("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for d, at, x in vectors_of(batch.column("vector")):
                x = as_integers(x)
                n = norms(x)
                angles = angles_to(x, n, refs.value.get(d))
                at = pa.array(at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.reshape(-1)))
                angle_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * REFERENCES), pa.array(angles.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), lists, pa.array(n), angle_lists], ["vec_id", "label", "vector", "norm", "angles"])

    return materialize(rows.mapInArrow(run, INDEX), "angles")


@dataclass
class Rows:
    """Index rows of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.x[at], self.norm[at], self.angles[at])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, Rows]]:
    ids, labels, norm = (batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
    angles = batch.column("angles")
    angles = (angles.combine_chunks() if isinstance(angles, pa.ChunkedArray) else angles).flatten().to_numpy(zero_copy_only=False).reshape(-1, REFERENCES)
    for d, at, x in vectors_of(batch.column("vector")):
        yield d, at, Rows(ids[at], labels[at], x, norm[at], angles[at].astype(np.float64))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, cut to the ends of a long."""
    top = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = np.dot(whole(a), whole(x).T) if a.shape[1] else np.zeros((len(a), len(x)), object)
    return np.clip(out, LONG.min, LONG.max).astype(np.int64)


def bounds(gap: np.ndarray, reach: np.ndarray, na: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper score bounds from the least and largest angle and the rows' norms."""
    high, low = np.cos(gap), np.cos(reach)
    room = SLACK * na * most + 1
    low, high = na * np.where(low > 0, low * least, low * most) - room, na * np.where(high > 0, high * most, high * least) + room
    return np.minimum(low, LONG.max), np.maximum(high, LONG.min)  # as scores are cut


def reach_of(s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest angle possible for angles ``s`` and some angle in [low, high] to one direction."""
    return np.where(s + high <= np.pi, s + high, np.where(s + low >= np.pi, 2 * np.pi - s - low, np.pi))


@dataclass
class Anchors:
    """Anchors of one vector length, numbered within their block, and the same number of score
    windows [low, high] for each: the best ``keep`` rows of every window are held, of the
    anchor's label (``same``) or of others."""

    rows: Rows
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive_ids: np.ndarray
    positive_scores: np.ndarray
    same: bool
    keep: int

    def start(self) -> None:
        shape = (*self.low.shape, self.keep)
        self.score, self.id, self.n = np.full(shape, LONG.min), np.full(shape, LONG.max), np.zeros(self.low.shape, np.int64)

    def floor(self) -> np.ndarray:
        """What a score must reach in each window now: its low end, or that of the worst row held where all places are taken."""
        return np.where(self.n == self.keep, np.maximum(self.low, self.score[:, :, -1]), self.low)

    def scan(self, x: Rows) -> None:
        home = x.angles.argmin(axis=1)
        x = x.take(np.lexsort((x.angles[np.arange(len(home)), home], home)))
        first = np.arange(0, len(x.ids), GROUP)
        least, most = (f.reduceat(x.angles, first, axis=0) for f in (np.minimum, np.maximum))
        n_least, n_most = (f.reduceat(x.norm, first) for f in (np.minimum, np.maximum))
        group = np.arange(len(x.ids)) // GROUP
        home = x.angles.argmin(axis=1)
        step = max(1, PAIRS // max(1, len(x.ids)))
        for a in range(0, len(self.number), step):
            self._scan(np.arange(a, min(a + step, len(self.number))), x, group, home, least, most, n_least, n_most)

    def _scan(self, at: np.ndarray, x: Rows, group: np.ndarray, home: np.ndarray, least: np.ndarray, most: np.ndarray, n_least: np.ndarray, n_most: np.ndarray) -> None:
        s, na = self.rows.angles[at], self.rows.norm[at][:, None]
        floor, top = self.floor()[at].min(axis=1)[:, None], self.high[at].max(axis=1)[:, None]
        gap, reach = np.zeros((len(at), len(least))), np.full((len(at), len(least)), np.pi)
        for r in range(s.shape[1]):
            sr = s[:, r, None]
            gap = np.maximum(gap, np.maximum(sr - most[:, r], least[:, r] - sr))
            reach = np.minimum(reach, reach_of(sr, least[:, r], most[:, r]))
        low, high = bounds(gap, reach, na, n_least, n_most)
        alive = (high >= floor) & (low <= top)
        near, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0)[group])
        if not len(near) or not len(cols):
            return
        # single rows, by the direction next to the anchor and the one next to the row
        s, na, floor, top = s[near], na[near], floor[near], top[near]
        t1, t2 = x.angles[cols].T[s.argmin(axis=1)], x.angles[cols, home[cols]]
        s1, s2 = s.min(axis=1)[:, None], s[:, home[cols]]
        gap = np.maximum(np.abs(s1 - t1), np.abs(s2 - t2))
        reach = np.minimum(reach_of(s1, t1, t1), reach_of(s2, t2, t2))
        low, high = bounds(gap, reach, na, x.norm[cols], x.norm[cols])
        ask = alive[np.ix_(near, group[cols])] & (high >= floor) & (low <= top)
        ask &= (self.rows.labels[at[near]][:, None] == x.labels[cols]) == self.same
        ask &= self.rows.ids[at[near]][:, None] != x.ids[cols]
        keep_a, keep_x = np.flatnonzero(ask.any(axis=1)), np.flatnonzero(ask.any(axis=0))
        if len(keep_a) and len(keep_x):
            at, cols = at[near[keep_a]], cols[keep_x]
            self._hold(at, x.ids[cols], products(self.rows.x[at], x.x[cols]), ask[np.ix_(keep_a, keep_x)])

    def _hold(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, ask: np.ndarray) -> None:
        floor = self.floor()[at]
        for w in range(self.low.shape[1]):
            full = self.n[at, w] == self.keep
            last = np.where(full, self.id[at, w, -1], LONG.max)[:, None]
            f = floor[:, w, None]
            hit = ask & (scores <= self.high[at, w][:, None]) & (scores >= f) & ((scores > f) | ~full[:, None] | (ids < last))
            a, c = np.nonzero(hit)
            if not len(a):
                continue
            touched = np.unique(a)
            old_a, old_k = np.nonzero(np.arange(self.keep) < self.n[at[touched], w][:, None])
            all_a = np.concatenate([touched[old_a], a])
            all_s = np.concatenate([self.score[at[touched[old_a]], w, old_k], scores[a, c]])
            all_i = np.concatenate([self.id[at[touched[old_a]], w, old_k], ids[c]])
            order = np.lexsort((all_i, ~all_s, all_a))  # ~ turns the order of longs around without overflow
            all_a, all_s, all_i = all_a[order], all_s[order], all_i[order]
            rank = np.arange(len(all_a)) - np.searchsorted(all_a, all_a)
            best = rank < self.keep
            to = (at[all_a[best]], w, rank[best])
            self.score[to], self.id[to] = all_s[best], all_i[best]
            self.n[at[touched], w] = np.minimum(self.keep, np.bincount(all_a, minlength=len(at))[touched])

    def found(self) -> pa.RecordBatch:
        a, w, k = np.nonzero(np.arange(self.keep) < self.n[:, :, None])
        cols = [self.rows.ids[a], self.number[a], w.astype(np.int32), self.positive_ids[a, w], self.positive_scores[a, w], self.id[a, w, k], self.score[a, w, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "number", "slot", "positive_id", "positive_score", "vec_id", "score"])


def search(index: DataFrame, anchors: dict[int, Anchors], keep: int) -> DataFrame:
    """The best rows of every anchor and window over all of the index."""
    shared = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for a in mine.values():
            a.start()
        for batch in batches:
            release()
            for d, _, rows in rows_of(batch):
                if d in mine:
                    mine[d].scan(rows)
        for a in mine.values():
            yield a.found()

    best = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "vec_id")
    return index.mapInArrow(run, FOUND).withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)


def whole_label(block: pa.Table, keep: int) -> dict[int, Anchors]:
    """Anchors that ask for the best rows of their own label, whatever the score."""
    out = {}
    for d, at, r in rows_of(block):
        k = (len(at), 1)
        out[d] = Anchors(r, at.astype(np.int32), np.full(k, LONG.min), np.full(k, LONG.max), np.zeros(k, np.int64), np.zeros(k, np.int64), True, keep)
    return out


def windows(anchors: dict[int, Anchors], best: pa.Table, slots: int, keep: int, low: int, high: int) -> dict[int, Anchors]:
    """The same anchors asking for rows of other labels in the window of each positive."""
    number, place = best.column("number").to_numpy(), best.column("place").to_numpy() - 1
    ids, scores = best.column("vec_id").to_numpy(), best.column("score").to_numpy()
    # Python integers: percentages of a long do not overflow
    least = np.array([min(max(-(-low * p // 100), LONG.min), LONG.max) for p in scores.tolist()], np.int64)
    most = np.array([min(max(high * p // 100, LONG.min), LONG.max) for p in scores.tolist()], np.int64)
    out = {}
    for d, a in anchors.items():
        row = np.full(int(max(a.number.max(), number.max(initial=0))) + 1, -1)
        row[a.number] = np.arange(len(a.number))
        mine = row[number] >= 0
        at = (row[number[mine]], place[mine])
        shape = (len(a.number), slots)
        full = [np.full(shape, v, np.int64) for v in (LONG.max, LONG.min, 0, 0)]  # places without a positive ask for nothing
        for to, values in zip(full, (least, most, ids, scores)):
            to[at] = values[mine]
        out[d] = Anchors(a.rows, a.number, *full, False, keep)
    return out


def mine(index: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score from a table of ``build_index``.

    A negative of a positive with score p has low * p <= 100 * score <= high * p."""
    rows = index.where(is_anchor).dropDuplicates(["vec_id", "label", "vector"])
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = -(-n * max(1, width or 0) * 8 // BLOCK_BYTES)
    out = index.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == b).toArrow()
        first = whole_label(block, positives)
        best = search(index, first, positives).select("number", "place", "vec_id", "score").toArrow()
        found = search(index, windows(first, best, positives, negatives, low, high), negatives)
        found = found.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(materialize(found, f"negatives-{b}"))
    return out
