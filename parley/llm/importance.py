"""Importance resampling towards a target distribution (operator 12).

Word n-grams fall into hashed buckets. A bucket's gain is a thousand times the log ratio of
its smoothed share in the target texts to that in the documents; a document's weight is the
sum of the gains of its n-grams, and Gumbel noise from a hash of its doc_id makes the
highest scores a weighted draw without replacement.

N-grams of a slice of texts are interned in an open-addressed table of numpy arrays: the
slot sought first is the low bits of xxhash64 of the n-gram's bytes, an occupied slot is
taken for the same n-gram only if the bytes agree, otherwise the next slot is tried. A slot
stores the bucket and the count, so the bucket's hash is taken once for each distinct
n-gram; occurrences keep their slot ids and gather gains by them. Counting adds the slots
of all slices of a task to one row for each bucket that occurs; the bucket counts of a
corpus (``BUCKETS`` rows at most) and the gains are all that the driver sees.

Ranks need no sort in one task: the narrow table of scores is dealt by ranges of the score
and written, each range numbers its own rows, and the counts of the ranges before it are
added.

Cases: null, empty and blank texts have no words, no features and weight 0; a null doc_id
draws its noise as an empty one and comes last among ties; rows that share a doc_id are
documents each, equal ones rank one after the other; an empty table gives an empty result,
empty target texts leave only the smoothing; extra columns pass through. The struct
``n_words, n_features, weight, score`` is the last column, ``_i`` or, where that name is
taken, ``_i`` with underscores appended; ``draw`` adds its rank to it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import free_name, join_small, materialize, row_slices, text_bytes

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
U = np.uint64
#: Bytes that end a word once A-Z are lower-case: ASCII other than digits and letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:0x30] = OUTSIDE[0x3A:0x61] = OUTSIDE[0x7B:0x80] = True
# The five 64-bit constants of xxhash64, and the reflected polynomial of CRC-32.
P1, P2, P3, P4, P5 = map(U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
CRC = 0xEDB88320


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def xxhash64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of many byte ranges; the short ones all at once."""
    size = end - start
    eight = _eights(data)
    h = P5 + size.astype(U)
    at, left = start.copy(), np.where(size < 32, size, 0)
    while len(todo := np.flatnonzero(left >= 8)):
        lane = _turn(eight[at[todo]] * P2, 31) * P1
        h[todo] = _turn(h[todo] ^ lane, 27) * P1 + P4
        at[todo] += 8
        left[todo] -= 8
    todo = np.flatnonzero(left >= 4)
    h[todo] = _turn(h[todo] ^ ((eight[at[todo]] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[todo] += 4
    left[todo] -= 4
    while len(todo := np.flatnonzero(left > 0)):
        h[todo] = _turn(h[todo] ^ ((eight[at[todo]] & U(0xFF)) * P5), 11) * P1
        at[todo] += 1
        left[todo] -= 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    h ^= h >> U(32)
    for k in np.flatnonzero(size >= 32):
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return h


def _crc_steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CRC), table >> np.uint32(1))
    return table


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte ranges; the short ones all at once."""
    steps, size = _crc_steps(), end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    todo = np.flatnonzero((size > 0) & (size <= 64))
    k = 0
    while len(todo):
        out[todo] = steps[(out[todo] ^ data[start[todo] + k]) & np.uint32(0xFF)] ^ (out[todo] >> np.uint32(8))
        k += 1
        todo = todo[size[todo] > k]
    out = ~out
    for k in np.flatnonzero(size > 64):
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    return out


def _same(data: np.ndarray, eight: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges of the same size from ``a`` and from ``b`` on hold the same bytes."""
    same, at = np.ones(len(a), bool), 0
    todo = np.flatnonzero(size > 0)
    while len(todo):
        low = U(64) - U(8) * np.minimum(size[todo] - at, 8).astype(U)
        same[todo] = ((eight[a[todo] + at] ^ eight[b[todo] + at]) << low) == 0
        at += 8
        todo = todo[same[todo] & (size[todo] > at)]
    return same


@dataclass
class Table:
    """Interned byte ranges: the slot of every occurrence, and bucket and count of every slot."""

    slot: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def intern(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int = BUCKETS, keys: np.ndarray | None = None) -> Table:
    """All occurrences advance together, so equal ones stand at the same slot in every turn."""
    keys = xxhash64(data, start, end) if keys is None else keys
    size, eight = end - start, _eights(data)
    n = 1 << max(4, (2 * len(start)).bit_length())
    owner = np.full(n, -1, np.int64)
    at = (keys & U(n - 1)).astype(np.int64)
    slot, todo = np.zeros(len(start), np.int64), np.arange(len(start))
    while len(todo):
        s = at[todo]
        free = owner[s] < 0
        owner[s[free]] = todo[free]
        held = owner[s]
        same = (keys[held] == keys[todo]) & (size[held] == size[todo])
        same[same] = _same(data, eight, start[held[same]], start[todo[same]], size[todo[same]])
        slot[todo[same]] = s[same]
        todo = todo[~same]
        at[todo] = (at[todo] + 1) & (n - 1)
    used = np.flatnonzero(owner >= 0)
    bucket = np.zeros(n, np.int64)
    bucket[used] = crc32(data, start[owner[used]], end[owner[used]]) % buckets
    return Table(slot, bucket, np.bincount(slot, minlength=n))


def ngrams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, then start, end and row of all runs of 1 to ``order`` words joined by one space; words of each row."""
    data = tk.LOWER[data]
    start, end, rows = tk.words(data, offs, OUTSIDE)
    n_words = tk.word_counts(rows, len(offs) - 1)
    if order > 1 and len(start):
        size = end - start
        to = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(to, size) + step] = data[np.repeat(start, size) + step]
        data, start, end = joined, to, to + size
    starts, ends, at = [start], [end], [rows]
    for k in range(1, order):
        ok = np.flatnonzero(rows[:-k] == rows[k:]) if len(rows) > k else np.zeros(0, np.int64)
        starts.append(start[ok])
        ends.append(end[ok + k])
        at.append(rows[ok])
    return data, np.concatenate(starts), np.concatenate(ends), np.concatenate(at), n_words


def _tables(text: pa.Array, order: int, buckets: int) -> Iterator[tuple[Table, np.ndarray, np.ndarray]]:
    """By slice of whole texts: the table, the row of every occurrence, and words of each row."""
    data, offs = text_bytes(text)
    for a, b in row_slices(offs):
        d, start, end, rows, n_words = ngrams(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], order)
        yield intern(d, start, end, buckets), rows, n_words


def bucket_counts(docs: DataFrame, order: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t, _, _ in _tables(batch.column(0), order, buckets):
                used = np.flatnonzero(t.count)
                np.add.at(total, t.bucket[used], t.count[used])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * s_all / ((float(source[k]) + 1) * t_all))) for k in range(n)], np.int64)


def noise(seed: str) -> Column:
    """Whole thousandths of a Gumbel variable from a hash of doc_id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def with_scores(docs: DataFrame, gain: np.ndarray, order: int = 1, seed: str = SEED) -> DataFrame:
    """``docs`` plus a last struct: n_words, n_features, weight and score."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(text: pa.Array) -> pa.Array:
        parts = [np.zeros((3, 0), np.int64)]
        for t, rows, n_words in _tables(text, order, len(shared.value)):
            of_slot = shared.value[t.bucket]
            n, weight = np.bincount(rows, minlength=len(n_words)), np.zeros(len(n_words), np.int64)
            np.add.at(weight, rows, of_slot[t.slot])
            parts.append(np.stack([n_words, n, weight]))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], names=["n_words", "n_features", "weight"])

    name = free_name(docs.columns, "_i")
    out = docs.withColumn(name, F.arrow_udf(run, "n_words long, n_features long, weight long")(F.col("text")))
    return out.withColumn(name, F.col(name).withField("score", F.col(f"{name}.weight") + noise(seed)))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``with_scores`` with ``rank`` in the struct: from 1 for the drawn share of the
    documents with enough words, null for all others."""
    name = scored.columns[-1]
    spark = scored.sparkSession
    scored = materialize(scored, "scores")
    part, copy = free_name(scored.columns, "_part"), free_name(scored.columns, "_copy")
    pool = F.col(f"{name}.n_words") >= least_words
    keys = [F.desc(f"{name}.score"), F.asc_nulls_last("doc_id"), F.asc(f"{name}.n_features"), F.asc(copy)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.where(pool).withColumn(copy, F.monotonically_increasing_id()).repartitionByRange(ranges, *keys)
    placed = materialize(placed.withColumn(part, F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())  # a row for each range
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    quota = before[-1] * percent // 100
    offset = free_name([*placed.columns, part], "_before")
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], f"`{part}` int, `{offset}` long")
    reached = join_small(placed, offsets.where(F.col(offset) < quota), [part], "inner")
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) + F.col(offset)
    reached = reached.withColumn(name, F.col(name).withField("rank", F.when(rank <= quota, rank)))
    none = F.col(name).withField("rank", F.lit(None).cast("long"))
    later = join_small(placed, offsets.where(F.col(offset) < quota), [part], "left_anti").withColumn(name, none)
    columns = [F.col(f"`{c}`") for c in scored.columns]
    return reached.select(columns).unionByName(later.select(columns)).unionByName(scored.where(~pool).withColumn(name, none).select(columns))


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, texts: bool = True) -> DataFrame:
    """All documents with weight, score and rank against the texts of ``target``.

    Ranking moves what the documents carry; without ``texts`` that is all but their text."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    scored = with_scores(docs, gain, order, seed)
    return draw(scored if texts else scored.drop("text"), percent, least_words)
