"""Katz backoff language model (operator 3).

Tokens are lower-cased (A-Z) words and one end token for each text. Counts are exact
over all training texts, and no word or pair is left out:

* ``unigrams``: every word with its count, in a table partitioned by hash bucket;
* ``bigrams``: the count of every (history, event) pair, in a table partitioned by
  history (a frequent history is divided by event into as many buckets as its count fills).

Both levels are Good-Turing discounted (counts to 5; absolute discounting where
the counts of counts do not allow it), and each history's backoff weight is
(1 - discounted mass of its seen events) / (1 - unigram mass of the same events),
so that the events of every history sum to one exactly. A history whose counts are all
too large to be discounted gives up a small share, so nothing has probability 0. A token is scored
recursively: bigram, else weight times unigram, else weight times the unseen mass,
which is shared by as many unseen types as Chao's estimate names.

The most frequent words and pairs, at most CACHE and PAIR_CACHE of them, are broadcast: tables
of bounded size that keep hot keys out of the shuffle and change no result. A histogram of the
counts gives the count from which on they fit, so nothing is sorted to find them. A word in the cache has a small number as
its code, any other its 63-bit hash. Pairs outside the cache meet the bigram table by
bucket; what has to back off to a word outside the cache goes on to the unigram table.

Cases: null text is empty (one end token); a null ``doc_id`` is not learned from and
not held out where the caller's ``learn`` is null for it; every row is scored by itself,
whatever doc_ids repeat; an empty table gives an empty result; extra columns are not read.
Words are told apart by 64-bit hashes of their bytes (see ``textkernel.span_hash``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import BLOBS, blob_batch, materialize, pack, portions, row_slices, text_column, unpack, unpack_all

CACHE, PAIR_CACHE, TOP_COUNT, PARTS = 1 << 19, 1 << 19, 5, 64
#: Share of the Witten-Bell estimate that every history leaves to unseen events at least.
FLOOR = 0.25
END = int(tk.mix(np.array([20_24], tk.U))[0])
#: The code of a text's beginning, and the bit of codes that are hashes.
BEGIN, RARE = tk.U(0), tk.U(1 << 63)
#: Partial scores travel as integers of this unit.
UNIT = 1e7
HISTOGRAM = "edge long, n long, c long"
#: Bytes of text whose pairs a task counts, or scores, at once.
COUNTED, SCORED = 24 << 20, 12 << 20


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and rows, each row closed by the end token."""
    data = tk.LOWER[data]
    starts, ends, rows = tk.words(data, offs)
    n = len(offs) - 1
    out = np.full(len(rows) + n, END, tk.U)
    out[np.arange(len(rows)) + rows] = tk.span_hash(data, starts, ends)
    return out, np.repeat(np.arange(n), tk.word_counts(rows, n) + 1)


def discounts(n: dict[int, int]) -> np.ndarray:
    """Good-Turing factors d[0..5] (d[0] unused) from counts of counts, all in (0, 1]."""
    k = TOP_COUNT
    d = np.ones(k + 1)
    n1, n2 = n.get(1, 0), n.get(2, 0)
    step = n1 / (n1 + 2 * n2) if n1 else 0.05
    step = min(max(step, 0.05), 0.95)
    common = (k + 1) * n.get(k + 1, 0) / n1 if n1 else 1.0
    for r in range(1, k + 1):
        d[r] = 0
        if common < 1 and n.get(r, 0):
            d[r] = ((r + 1) * n.get(r + 1, 0) / n[r] / r - common) / (1 - common)
        if not 0 < d[r] < 1:
            d[r] = (r - step) / r
    return d


class Unigram:
    """The lowest level: discounted probabilities by count, and the unseen mass."""

    def __init__(self, total: int, types: int, n: dict[int, int]) -> None:
        self.total, self.types = total, types
        self.d = discounts(n)
        used = sum((1 - self.d[r]) * r * n.get(r, 0) for r in range(1, TOP_COUNT + 1)) / total if total else 1.0
        self.scale = 1.0
        if used < 1e-9:
            self.scale, used = total / (total + 1), 1 / (total + 1)
        n1, n2 = n.get(1, 0), n.get(2, 0)
        self.unseen_types = max(1, math.ceil(n1 * n1 / (2 * n2) if n2 else n1 * (n1 - 1) / 2))
        self.unseen = used / self.unseen_types

    def p(self, count: np.ndarray) -> np.ndarray:
        c = np.asarray(count, np.int64)
        if not self.total:
            return np.full(len(c), self.unseen)
        return np.where(c > 0, self.scale * self.d[np.where(c <= TOP_COUNT, c, 0)] * c / self.total, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(count, np.float64) + 1) / (self.total + self.types + 1))


def _totals(*keys: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Group by equal key tuples and add weights."""
    order = np.lexsort(keys[::-1])
    keys, weight = [k[order] for k in keys], weight[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(weight, first) if len(first) else weight


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    data, offs = text_column(batch)
    for a, b in row_slices(offs):
        yield slice(a, b), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def histogram(c: np.ndarray) -> pa.RecordBatch:
    """Counts by log-linear bucket, exact below 64: lower edge, how many, and their sum."""
    step = np.left_shift(1, np.maximum(0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) - 5))
    edge, inverse = np.unique(c - c % step, return_inverse=True)
    n = np.bincount(inverse, minlength=len(edge))
    total = np.bincount(inverse, weights=c, minlength=len(edge))
    return pa.RecordBatch.from_arrays([pa.array(edge.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.rint(total).astype(np.int64))], ["edge", "n", "c"])


def merged(histograms: DataFrame) -> dict[int, tuple[int, int]]:
    """edge: (how many, sum) over all tasks; some thousand rows at most."""
    return {x.edge: (x.n, x.c) for x in histograms.groupBy("edge").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()}


def least_count(by_edge: dict[int, tuple[int, int]], most: int) -> int:
    """The least count such that at most ``most`` entries have it or more."""
    have, least = 0, max(by_edge, default=0) + 1
    for edge in sorted(by_edge, reverse=True):
        have += by_edge[edge][0]
        if have > most:
            break
        least = edge
    return least


def pair_key(history: np.ndarray, event: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(history) + event)


class Pairs:
    """A table of pairs with counts that is searched by pair."""

    def __init__(self, history: np.ndarray, event: np.ndarray, count: np.ndarray) -> None:
        key = pair_key(history, event)
        order = np.argsort(key)
        self.key, self.history, self.event, self.count = key[order], history[order], event[order], count[order]

    def find(self, history: np.ndarray, event: np.ndarray) -> np.ndarray:
        """Counts, 0 where a pair is absent."""
        if not len(self.key):
            return np.zeros(len(history), np.int64)
        at = np.minimum(np.searchsorted(self.key, pair_key(history, event)), len(self.key) - 1)
        return np.where((self.history[at] == history) & (self.event[at] == event), self.count[at], 0)


def weights(c: np.ndarray, cut: np.ndarray, seen: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and factor of the seen events, from a history's count, the discounted
    sum of its pair counts, the unigram mass of its events and their number.

    A history with large counts only has nothing discounted: it keeps a share for what it
    has not been followed by."""
    kept = np.minimum(cut, c * (1 - FLOOR * types / np.maximum(c + types, 1)))
    rest = 1 - seen
    open_ = rest > 1e-9
    alpha = np.where(open_, (1 - kept / np.maximum(c, 1)) / np.where(open_, rest, 1), 0)
    return alpha, np.where(open_, kept, c) / np.maximum(cut, 1e-300)


def shares_of(counts: np.ndarray, total: int, buckets: int) -> np.ndarray:
    """Buckets over which the pairs of a cached history are spread: about two for each bucket's
    worth of tokens that it has, so that no bucket holds much more of a hot one than of others."""
    return np.clip(np.ceil(2.0 * counts * buckets / max(1, total)), 1, buckets).astype(np.int64)


def train_and_score(docs: DataFrame, learn: F.Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learn`` is a boolean column: which texts are training texts (default: all)."""
    sc = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size >> 24)
    learns = F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)).alias("learn")
    training = docs.select("text", learns).where("learn")

    def word_bucket(h: np.ndarray) -> np.ndarray:
        return (((h | RARE) >> tk.U(30)) % tk.U(buckets)).astype(np.int64)

    # 1. exact unigram counts
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tokens(data, offs)[0] for _, data, offs in _slices(batch)]
            if got:
                (h,), n = _totals(np.concatenate(got), weight=np.ones(sum(map(len, got)), np.int64))
                yield blob_batch(word_bucket(h), (h, n.astype(np.uint32)), buckets)

    def add_words(table: pa.Table) -> pa.Table:
        h, n = unpack_all(table, "u8", "u4")
        (h,), n = _totals(h, weight=n.astype(np.int64))
        b = table.column("bucket")[0].as_py()
        return pa.table({"part": pa.array([b % PARTS], pa.int32()), "bucket": pa.array([b], pa.int32()), "n": pa.array([len(h)], pa.int32()), "blob": pa.array([pack(h, n)], pa.binary())})

    unigrams = training.mapInArrow(count_words, BLOBS).groupBy("bucket").applyInArrow(add_words, f"part int, {BLOBS}")
    unigrams = materialize(unigrams, "katz-unigrams", ["part"]).select("bucket", "n", "blob")

    def word_counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield unpack(blob, n, "u8", "i8")

    def by_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in word_counts_of(batches):
            yield histogram(c)

    stats = merged(unigrams.mapInArrow(by_count, HISTOGRAM))
    uni = Unigram(sum(c for _, c in stats.values()), sum(n for n, _ in stats.values()), {r: stats.get(r, (0, 0))[0] for r in range(1, TOP_COUNT + 2)})
    from_count = least_count(stats, CACHE)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in word_counts_of(batches):
            pick = c >= from_count
            yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(c[pick])], ["word", "c"])

    top = unigrams.mapInArrow(frequent, "word long, c long").toArrow()
    words = top.column("word").to_numpy().view(tk.U)
    order = np.argsort(words)
    words, counts = words[order], top.column("c").to_numpy()[order]
    n_top = len(words) + 1
    texts = counts[words == tk.U(END)]  # a text's beginning is as frequent as its end
    shares = shares_of(np.concatenate([texts if len(texts) else [0], counts]), uni.total, buckets)
    vocab = sc.broadcast((words, np.concatenate([[0], counts]), np.concatenate([[0.0], uni.p(counts)]), shares))

    def codes_of(h: np.ndarray) -> np.ndarray:
        words = vocab.value[0]
        if not len(words):
            return h | RARE
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        return np.where(words[at] == h, (at + 1).astype(tk.U), h | RARE)

    def pairs_of(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        event = codes_of(h)
        history = np.full_like(event, BEGIN)
        same = r[1:] == r[:-1]
        history[1:][same] = event[:-1][same]
        return history, event

    def pair_bucket(history: np.ndarray, event: np.ndarray) -> np.ndarray:
        share = vocab.value[3][np.where(history < RARE, history, BEGIN).astype(np.int64)].astype(tk.U)
        sub = np.where(history < RARE, tk.mix(event) % share, tk.U(0))
        return ((tk.mix(tk.mix(history) + sub) >> tk.U(33)) % tk.U(buckets)).astype(np.int64)

    # 2. exact bigram counts
    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, COUNTED):
            got = [pairs_of(*tokens(data, offs)) for _, data, offs in _slices(batch)]
            if got:
                history, event = (np.concatenate(x) for x in zip(*got))
                (history, event), n = _totals(history, event, weight=np.ones(len(event), np.int64))
                yield blob_batch(pair_bucket(history, event), (history, event, n.astype(np.uint32)), buckets)

    def add_pairs(table: pa.Table) -> pa.Table:
        history, event, n = unpack_all(table, "u8", "u8", "u4")
        (history, event), n = _totals(history, event, weight=n.astype(np.int64))
        b = table.column("bucket")[0].as_py()
        return pa.table({"part": pa.array([b % PARTS], pa.int32()), "bucket": pa.array([b], pa.int32()), "n": pa.array([len(event)], pa.int32()), "blob": pa.array([pack(history, event, n)], pa.binary())})

    bigrams = training.mapInArrow(count_pairs, BLOBS).groupBy("bucket").applyInArrow(add_pairs, f"part int, {BLOBS}")
    bigrams = materialize(bigrams, "katz-bigrams", ["part"]).select("bucket", "n", "blob")

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if n:
                    yield unpack(blob, n, "u8", "u8", "i8")

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, c in blobs(batches):
            yield histogram(c)

    d2 = discounts({r: n for r, (n, _) in merged(bigrams.mapInArrow(pair_counts, HISTOGRAM)).items()})

    def discounted(c: np.ndarray) -> np.ndarray:
        return c * d2[np.where(c <= TOP_COUNT, c, 0)]

    def masses_of(history: np.ndarray, event: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        """By history, in order: count, discounted count, unigram mass of cached events, types."""
        first = np.flatnonzero(np.append(True, history[1:] != history[:-1])) if len(history) else np.zeros(0, np.int64)
        p = np.where(event < RARE, vocab.value[2][np.where(event < RARE, event, BEGIN).astype(np.int64)], 0.0)
        return [history[first], *(np.add.reduceat(x, first) if len(first) else x for x in (c, discounted(c), p, np.ones(len(c), np.int64)))]

    # 3. backoff weights. Unigram masses of events outside the cache come from their own buckets.
    SEEN = f"{BLOBS}, h long, p double"

    def rare_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for history, event, _ in blobs(batches):
            pick = event >= RARE
            yield blob_batch(word_bucket(event[pick]), (event[pick], history[pick]), buckets)

    def counts_in(right: pa.Table, event: np.ndarray) -> np.ndarray:
        word, c = unpack_all(right, "u8", "i8")
        word = word | RARE
        order = np.argsort(word)
        word, c = word[order], c[order]
        if not len(word):
            return np.zeros(len(event), np.int64)
        at = np.minimum(np.searchsorted(word, event), len(word) - 1)
        return np.where(word[at] == event, c[at], 0)

    def rare_masses(left: pa.Table, right: pa.Table) -> pa.Table:
        event, history = unpack_all(left, "u8", "u8")
        (history,), p = _totals(history, weight=uni.p(counts_in(right, event)))
        hot = history < RARE
        out = blob_batch(pair_bucket(history[~hot], history[~hot]), (history[~hot], p[~hot]), buckets)
        rows = out.append_column("h", pa.nulls(out.num_rows, pa.int64())).append_column("p", pa.nulls(out.num_rows, pa.float64()))
        none = pa.nulls(int(hot.sum()), pa.int32())
        more = pa.RecordBatch.from_arrays([none, none, pa.nulls(len(none), pa.binary()), pa.array(history[hot].astype(np.int64)), pa.array(p[hot])], ["bucket", "n", "blob", "h", "p"])
        return pa.Table.from_batches([rows, more])

    seen = bigrams.mapInArrow(rare_events, BLOBS).groupBy("bucket").cogroup(unigrams.groupBy("bucket")).applyInArrow(rare_masses, SEEN)
    seen = materialize(seen, "katz-seen")

    def top_masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for history, event, c in blobs(batches):
            pick = history < RARE
            h, *sums = masses_of(history[pick], event[pick], c[pick])
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *map(pa.array, sums)], ["h", "c", "cut", "seen", "types"])

    # at most one row for each cached word and the beginning
    got = bigrams.mapInArrow(top_masses, "h long, c long, cut double, seen double, types long").groupBy("h").agg(*(F.sum(x).alias(x) for x in ("c", "cut", "seen", "types"))).toArrow()
    far = seen.where("h is not null").groupBy("h").agg(F.sum("p").alias("p")).toArrow()
    mass = {x: np.zeros(n_top) for x in ("c", "cut", "seen", "types")}
    for x, values in mass.items():
        values[got.column("h").to_numpy()] = got.column(x).to_numpy()
    mass["seen"][far.column("h").to_numpy()] += far.column("p").to_numpy()
    alpha, scale = weights(**mass)

    # 4. the hottest pairs of cached words, a table of fixed size
    def cached_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for history, event, c in blobs(batches):
            yield histogram(c[(history < RARE) & (event < RARE)])

    from_pairs = least_count(merged(bigrams.mapInArrow(cached_pairs, HISTOGRAM)), PAIR_CACHE)

    def hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for history, event, c in blobs(batches):
            pick = (history < RARE) & (event < RARE) & (c >= from_pairs)
            yield pa.RecordBatch.from_arrays([pa.array(x[pick].astype(np.int64)) for x in (history, event, c)], ["h", "e", "c"])

    hot = bigrams.mapInArrow(hottest, "h long, e long, c long").toArrow()
    cached = Pairs(*(hot.column(x).to_numpy().astype(tk.U) for x in "he"), hot.column("c").to_numpy())
    model = sc.broadcast((mass["c"], alpha, scale, cached))

    # 5. score: cached pairs and words in place, the rest by bucket
    PIECES = "bucket int, n int, blob binary, row long, doc_id long, n_tokens long, n_known long, base long, score long"
    NAMES = ["bucket", "n", "blob", "row", "doc_id", "n_tokens", "n_known", "base", "score"]

    def fixed(x: np.ndarray) -> np.ndarray:
        return np.rint(x * UNIT).astype(np.int64)

    def only_blobs(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, pa.int64())] * 6], NAMES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, SCORED):
            row_ids, pair_parts, word_parts = batch.column(0).to_numpy(), [], []
            for at, data, offs in _slices(batch):
                n, mine = len(offs) - 1, row_ids[at]
                h, r = tokens(data, offs)
                history, event = pairs_of(h, r)
                h_count, _, scale, cached = model.value
                c = cached.find(history, event)
                hit, near = np.flatnonzero(c), event < RARE
                of = history[hit].astype(np.int64)
                p = np.log10(scale[of] * discounted(c[hit]) / np.maximum(h_count[of], 1))
                base = uni.base(vocab.value[1][event[near].astype(np.int64)])
                columns = [mine, batch.column(1)[at], tk.word_counts(r, n), np.bincount(r[near], minlength=n), fixed(np.bincount(r[near], weights=base, minlength=n)), fixed(np.bincount(r[hit], weights=p, minlength=n))]
                nil = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([nil, nil, pa.nulls(n, pa.binary()), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)], NAMES)
                pair_parts.append((history[c == 0], event[c == 0], mine[r[c == 0]]))
                word_parts.append((event[~near], mine[r[~near]]))
            if pair_parts:
                history, event, row = (np.concatenate(x) for x in zip(*pair_parts))
                (history, event, row), n = _totals(history, event, row, weight=np.ones(len(row), np.int64))
                yield only_blobs(blob_batch(pair_bucket(history, event), (history, event, row, n.astype(np.int32)), buckets))
                event, row = (np.concatenate(x) for x in zip(*word_parts))
                (event, row), n = _totals(event, row, weight=np.ones(len(row), np.int64))
                yield only_blobs(blob_batch(buckets + word_bucket(event), (event, row, n.astype(np.int32)), buckets))

    def per_row(row: np.ndarray, known: np.ndarray, base: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        keys, inverse = np.unique(row, return_inverse=True)
        known, base, total = (np.bincount(inverse, weights=x, minlength=len(keys)) for x in (known, base, total))
        block = (tk.mix(keys.view(tk.U)) >> tk.U(33)) % tk.U(buckets)
        return blob_batch(block.astype(np.int64), (keys, np.rint(known).astype(np.int64), fixed(base), fixed(total)), buckets)

    def join_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        history, event, row, n = unpack_all(left, "u8", "u8", "i8", "i4")
        is_seen = np.array(right.column("seen").to_pylist(), bool)
        t_history, t_event, t_count = unpack_all(right.filter(pa.array(~is_seen)), "u8", "u8", "i8")
        own, p = unpack_all(right.filter(pa.array(is_seen)), "u8", "f8")
        c = Pairs(t_history, t_event, t_count).find(history, event)
        # histories outside the cache have all their pairs in this bucket
        far = t_history >= RARE
        h, count, cut, mass, types = masses_of(t_history[far], t_event[far], t_count[far])
        if len(own):
            np.add.at(mass, np.searchsorted(h, own), p)
        own_alpha, own_scale = weights(count, cut, mass, types)
        top_count, top_alpha, top_scale, _ = model.value
        at = np.minimum(np.searchsorted(h, history), max(0, len(h) - 1))
        found = (h[at] == history) if len(h) else np.zeros(len(history), bool)

        def of(top: np.ndarray, mine: np.ndarray, absent: float) -> np.ndarray:
            near = history < RARE
            out = np.where(near, top[np.where(near, history, BEGIN).astype(np.int64)], absent)
            out[found] = mine[at[found]]
            return out

        # a history that was never seen backs off with weight 1
        total, a, s = of(top_count, count, 0.0), of(top_alpha, own_alpha, 1.0), of(top_scale, own_scale, 1.0)
        a = np.where(total > 0, a, 1.0)
        near = event < RARE
        p = np.where(near, vocab.value[2][np.where(near, event, BEGIN).astype(np.int64)], 1.0)
        value = np.log10(np.where(c > 0, s * discounted(c) / np.maximum(total, 1), np.maximum(a * p, 1e-300)))
        rest = (c == 0) & ~near
        out = [per_row(row, np.zeros(len(row)), np.zeros(len(row)), n * value), blob_batch(buckets + word_bucket(event[rest]), (event[rest], row[rest], -n[rest]), buckets)]
        return pa.Table.from_batches(out)

    def join_words(left: pa.Table, right: pa.Table) -> pa.Table:
        event, row, n = unpack_all(left, "u8", "i8", "i4")
        c = counts_in(right, event)
        known = n > 0  # negative numbers ask for the backed-off probability
        return pa.Table.from_batches([per_row(row, n * (known & (c > 0)), n * known * uni.base(c), -n * ~known * np.log10(np.maximum(uni.p(c), 1e-300)))])

    def add_rows(table: pa.Table) -> pa.Table:
        row, known, base, total = unpack_all(table, "i8", "i8", "i8", "i8")
        keys, inverse = np.unique(row, return_inverse=True)
        out = [np.zeros(len(keys), np.int64) for _ in range(3)]
        for o, v in zip(out, (known, base, total)):
            np.add.at(o, inverse, v)
        return pa.table({"row": pa.array(keys), **{k: pa.array(v) for k, v in zip(("n_known", "base", "score"), out)}})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(rows.select("row", "doc_id", "text").mapInArrow(score, PIECES), "katz-pieces")
    asked = pieces.where("bucket is not null").select("bucket", "n", "blob")
    tables = bigrams.withColumn("seen", F.lit(False)).unionByName(seen.where("bucket is not null").select("bucket", "n", "blob", F.lit(True).alias("seen")))
    late = asked.where(F.col("bucket") < buckets).groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(join_pairs, BLOBS)
    late = materialize(late, "katz-late")
    shifted = unigrams.withColumn("bucket", F.col("bucket") + buckets)
    by_word = asked.unionByName(late).where(F.col("bucket") >= buckets).groupBy("bucket").cogroup(shifted.groupBy("bucket")).applyInArrow(join_words, BLOBS)
    sums = late.where(F.col("bucket") < buckets).unionByName(by_word).groupBy("bucket").applyInArrow(add_rows, "row long, n_known long, base long, score long")
    early = pieces.where("bucket is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    none = {"doc_id": F.lit(None).cast("long"), "n_tokens": F.lit(0).cast("long")}
    each = early.unionByName(sums.withColumns(none)).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return each.select("doc_id", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), (F.col("base") / UNIT).alias("base_score"), (F.col("score") / UNIT).alias("score"))
