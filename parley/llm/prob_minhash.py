"""Near-duplicate documents by ProbMinHash (operator 7).

A document is the set of its 5-word shingles, each of weight 1 however often it
occurs. Every shingle is a Poisson process whose arrivals fall on random
registers; a register keeps the shingle that arrives first, so two documents
share a register with the Jaccard of their sets, the similarity that candidates
are verified by. Arrivals later than
the slowest register cannot win, which ends each process early; documents of a
batch run together, vectorised.

24 bands of 5 registers nominate pairs (a pair of similarity 0.8 is missed with
probability 7e-5), and candidates are verified exactly on their shingle sets:
Jaccard >= 0.8. Within a band bucket nobody emits all pairs: members are compared
with one centre, links found merge classes, further centres serve members that are
still in other classes, as long as they merge some. What then remains apart is joined
on prefixes: with the shingles of each set in one order, rare ones first, two sets of Jaccard >= t share
one among their first (1 - t) n + 1, so common passages nominate nobody.

Shingles are compared as 64-bit non-linear hashes of their words.

Cases: texts of one to four words are one shingle; texts without words (null,
empty, spaces) are alone in their class; equal texts share a class; a null
``doc_id`` is its own class (null); repeated rows get one row each; rows that share a
``doc_id`` but not the text are different documents, which may lie in different classes;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import connected_components, free_name, materialize, pack, row_slices, text_column, unpack

WIDTH, BANDS, ROWS, THRESHOLD, CENTRES = 5, 24, 5, 0.8, 3
M = BANDS * ROWS


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash, count; sorted by row, then hash."""
    starts, ends, rows = tk.words(data, offs)
    h = tk.span_hash(data, starts, ends)
    keys, at = tk.windows(h, rows, WIDTH)
    key_rows = rows[at]
    n = tk.word_counts(rows, len(offs) - 1)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        first = np.searchsorted(rows, short)
        acc = np.zeros(len(short), tk.U)
        for k in range(WIDTH - 1):
            on = n[short] > k
            acc[on] = tk.chain(acc[on], h[first[on] + k])
        keys, key_rows = np.concatenate([keys, tk.mix(acc)]), np.concatenate([key_rows, short])
    order = np.lexsort((keys, key_rows))
    keys, key_rows = keys[order], key_rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (key_rows[1:] != key_rows[:-1])
    first = np.flatnonzero(new)
    return key_rows[first], keys[first], np.diff(np.append(first, len(keys)))


def signatures(rows: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m) array of the shingle that wins each register; rows without shingles stay 0."""
    best = np.full(n * m, np.inf)
    owner = np.zeros(n * m, tk.U)
    if not len(rows):
        return owner.reshape(n, m)
    time, step, burst = np.zeros(len(rows)), 0, 1
    row, key, rate = rows.astype(np.int64), keys, 1.0 / weight
    while len(row):
        t = np.arange(step, step + burst, dtype=tk.U)
        bits = tk.mix(key[:, None] + (t[None, :] + tk.U(1)) * tk.U(0x9E3779B97F4A7C15))
        gap = -np.log(((bits >> tk.U(24)).astype(np.float64) + 0.5) * 2.0**-40) * rate[:, None]
        arrive = time[:, None] + np.cumsum(gap, axis=1)
        at = (row[:, None] * m + ((bits & tk.U(0xFFFFFF)) * tk.U(m) >> tk.U(24)).astype(np.int64)).ravel()
        flat = arrive.ravel()
        better = np.flatnonzero(flat < best[at])
        np.minimum.at(best, at[better], flat[better])
        won = better[best[at[better]] == flat[better]]
        owner[at[won]] = key[won // burst]
        # a process whose next arrival is later than its document's slowest register is over
        live, inverse = np.unique(row, return_inverse=True)
        slowest = best.reshape(n, m)[live].max(axis=1)
        time, step = arrive[:, -1], step + burst
        go = time < slowest[inverse]
        row, key, rate, time = row[go], key[go], rate[go], time[go]
        burst = 1 if len(row) * 2 > 1 << 16 else min(64, burst * 2)
    return owner.reshape(n, m)


def bands(sig: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(sig), BANDS), tk.U)
    s = sig.reshape(len(sig), BANDS, ROWS)
    for k in range(ROWS):
        acc = tk.chain(acc, s[:, :, k])
    return tk.mix(acc).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data_all, offs_all = text_column(batch)
        for a, b in row_slices(offs_all):
            data, offs = data_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
            row, key, _ = shingles(data, offs)
            size = np.bincount(row, minlength=b - a)
            band = bands(signatures(row, key, np.ones(len(key)), b - a))
            band_list = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(size.astype(np.int64)), band_list], ["doc_id", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data_all, offs_all = text_column(batch)
        for a, b in row_slices(offs_all):
            row, key, _ = shingles(data_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(cut).astype(np.int32)), pa.array([pack(key[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())], ["doc_id", "n", "blob"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        a, b, na, nb = (batch.column(i).to_pylist() for i in range(4))
        ok = []
        for i in range(len(a)):
            if last[0] != b[i]:  # rows of one centre follow each other
                last = (b[i], unpack(batch.column(5)[i].as_py(), nb[i], "u8")[0])
            mine = unpack(batch.column(4)[i].as_py(), na[i], "u8")[0]
            at = np.minimum(np.searchsorted(last[1], mine), nb[i] - 1)
            both = int((last[1][at] == mine).sum())
            ok.append(both >= THRESHOLD * (na[i] + nb[i] - both))
        pick = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pick), batch.column(1).filter(pick)], ["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have Jaccard >= THRESHOLD."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("blob").alias("xa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("blob").alias("xb")), "b")
    # exact: sets that differ more in size cannot reach the threshold
    both = both.where((F.col("na") >= THRESHOLD * F.col("nb")) & (F.col("nb") >= THRESHOLD * F.col("na")))
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_verify, "a long, b long")


CELL_BITS = 20


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> tk.U(64 - CELL_BITS)).astype(np.int32)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [unpack(b, n, "u8")[0] for n, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if keys:
            cell, n = np.unique(_cells(np.concatenate(keys)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])


def prefix_pairs(open_docs: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different classes among ``open_docs`` that can have Jaccard >= THRESHOLD.

    Shingles are ordered by how full their hash cell is; the 2**CELL_BITS counts
    (4 MB) are the only thing broadcast, and any shared order is exact."""
    mine = materialize(sets.join(open_docs, "doc_id"), "pmh-open")
    counts = np.zeros(1 << CELL_BITS, np.int64)
    got = mine.select("doc_id", "n", "blob").mapInArrow(_sizes, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    table = mine.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, blob, comp = (batch.column(i).to_pylist() for i in range(4))
            keys = []
            for size, b in zip(n, blob):
                k = unpack(b, size, "u8")[0]
                keep = size - int(np.ceil(THRESHOLD * size - 1e-9)) + 1
                keys.append(k[np.lexsort((k, table.value[_cells(k)]))[:keep]])
            each = np.array([len(k) for k in keys], np.int64)
            flat = np.concatenate(keys) if keys else np.zeros(0, tk.U)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each)), *(pa.array(np.repeat(np.array(x, np.int64), each)) for x in (doc, comp, n))], ["shingle", "p", "doc_id", "comp", "n"])

    rows = mine.select("doc_id", "n", "blob", "comp").mapInArrow(prefixes, "shingle long, p long, doc_id long, comp long, n long")
    rows = materialize(rows, "pmh-prefix")
    often = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    rows = rows.join(often, "shingle")
    x, y = (rows.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "comp", "n", "p"))) for side in "ab")
    # the first shared shingle leaves room for enough others in both sets
    room = 1 + F.least(F.expr("n_a - p_a - 1"), F.expr("n_b - p_b - 1"))
    enough = room * (1 + THRESHOLD) >= THRESHOLD * (F.col("n_a") + F.col("n_b")) - 1e-6
    return x.join(y, (x.shingle == y.shingle) & F.expr("doc_id_a < doc_id_b and comp_a <> comp_b") & enough).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """key, doc_id, digest, text of rows with a doc_id, and whether doc_ids have several texts.

    The key is the doc_id; of one with several texts, the texts after the least digest
    have keys of their own below all doc_ids."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    twins = rows.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    twins = materialize(twins.select("doc_id", "first"), "pmh-twins")
    if not twins.limit(1).count():
        return rows.withColumn("key", F.col("doc_id")), False
    own = -F.lit(1 << 62) - F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 61))
    key = F.when(F.col("digest") > F.col("first"), own).otherwise(F.col("doc_id"))
    return rows.join(twins, "doc_id", "left").withColumn("key", key).drop("first"), True


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), class_id and first (whether it is the one to keep of
    its class), one row for each pair of doc_id and digest; texts without words are left out."""
    spark = docs.sparkSession
    rows, several = _keyed(docs)
    narrow = rows.select(F.col("key").alias("doc_id"), "text")
    sketched = materialize(narrow.mapInArrow(_sketch, "doc_id long, size long, bands array<long>"), "pmh")
    worded = sketched.where("size > 0").select(F.col("doc_id").alias("key")).distinct()
    marks = materialize(rows.select("key", "doc_id", "digest").join(worded, "key", "left_semi"), "pmh-marks")
    reps = marks.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("rep")).select("digest", F.col("rep.key").alias("rep"))
    member = materialize(marks.join(reps, "digest").distinct(), "pmh-member")
    chosen = sketched.join(member.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    bands = chosen.select("doc_id", F.posexplode("bands").alias("band", "hash"))
    shared = bands.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash")
    bands = materialize(bands.join(shared, ["band", "hash"]), "pmh-bands")

    needed = bands.select("doc_id").distinct()
    texts = narrow.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(texts.mapInArrow(_sets, "doc_id long, n int, blob binary"), "pmh-sets")
    label = _linked(spark, bands, sets)
    if label is None:
        out = member.withColumn("class", F.col("rep"))
    else:
        out = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    if not several:  # keys are doc_ids, so the least key is the class
        return out.select("doc_id", "digest", F.col("class").alias("class_id"), (F.col("class") == F.col("doc_id")).alias("first"))
    best = out.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    out = out.join(best, "class")
    return out.select("doc_id", "digest", F.col("best.doc_id").alias("class_id"), (F.struct("doc_id", "digest") == F.col("best")).alias("first"))


def _linked(spark: SparkSession, rows: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node, component of the documents that have verified links; None if none has."""
    done = spark.createDataFrame([], "a long, b long")
    label, turn = None, 0
    while turn <= CENTRES:
        now = rows if label is None else rows.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        comp = F.col("doc_id") if label is None else F.coalesce("component", "doc_id")
        now = now.select("band", "hash", "doc_id", comp.alias("comp"))
        order = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")
        centre = F.min(F.struct(order.alias("o"), "doc_id", "comp")).alias("c")
        apart = now.groupBy("band", "hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), centre).where("lo <> hi")
        open_rows = now.join(apart.select("band", "hash", F.col("c.doc_id").alias("centre"), F.col("c.comp").alias("centre_comp")), ["band", "hash"])
        if turn < CENTRES:
            pairs = open_rows.where("comp <> centre_comp").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
        else:  # the exact rest: members still in other classes
            pairs = prefix_pairs(open_rows.select("doc_id", "comp").distinct(), sets)
        pairs = materialize(pairs.distinct().join(done, ["a", "b"], "left_anti"), "pmh-pairs")
        n_pairs = pairs.count()
        if not n_pairs:
            if not apart.limit(1).count():
                break  # no bucket holds two classes: nothing is left to compare
            turn += 1
            continue  # all of this turn's centres served before: the next ones, or the exact rest
        found = materialize(verify(pairs, sets), "pmh-links")
        done = done.unionByName(pairs).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        n_found = found.count()
        if n_found:
            label = materialize(_merged(label, found), "pmh-label")
        # once centres merge next to nothing, what is still apart is for the exact rest
        turn = max(turn + 1, CENTRES) if n_found * 100 < n_pairs else turn + 1
    return label


def _merged(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """``label`` after the links found between its classes: only the classes are linked
    anew, so a turn with few links works on few edges however large the classes are."""
    if label is None:
        return connected_components(found)
    ends = found.select(F.explode(F.array("a", "b")).alias("node"))
    # a class is named by its least node, so the minimum prefers the class to the node itself
    known = label.unionByName(ends.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    edges = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (doc_id = class_id), one row for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    out = rows.where("doc_id is not null").join(classes(docs), ["doc_id", "digest"], "left")
    class_id = F.coalesce("class_id", "doc_id")
    out = out.select("doc_id", class_id.alias("class_id"), (class_id == F.col("doc_id")).alias("kept"))
    none = rows.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, columns unchanged; of repeated rows one stays, and all without words or doc_id."""
    digest, gone = free_name(docs.columns, "_digest"), free_name(docs.columns, "_gone")
    rest = classes(docs).where("not first").select(F.col("doc_id").alias(gone), F.col("digest").alias(digest))
    known = docs.where("doc_id is not null").withColumn(digest, F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", digest])
    same = (F.col("k.doc_id") == F.col(f"r.{gone}")) & (F.col(f"k.{digest}") == F.col(f"r.{digest}"))
    known = known.alias("k").join(rest.alias("r"), same, "left_anti").select(*[F.col(f"k.`{c}`") for c in docs.columns])
    return known.unionByName(docs.where("doc_id is null"))
