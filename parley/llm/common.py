"""Helpers the training-data operators share.

* ``materialize`` cuts lineage with a table in the cluster's shared folder;
* ``join_small`` broadcasts a side only after its row count is known;
* ``pack`` / ``unpack`` turn column arrays into one compressed binary value, so
  that a shuffle moves a few long rows instead of one row for each word;
* ``connected_components`` labels graph nodes without collecting any of them.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset (tests)."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if where := spark.sparkContext.getCheckpointDir():
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="parley-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The plan above then starts from replicated files, so a lost executor costs a
    re-read and not a re-run; unlike a checkpoint the table is columnar."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/parley/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", rows: int = 100_000) -> DataFrame:
    """Join with a table that is usually tiny: broadcast if it has at most
    ``rows`` rows (it is counted), otherwise an ordinary join that adaptive
    execution may split where a key is hot."""
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return df.join(small, list(on), how)


def free_name(columns: Sequence[str], name: str) -> str:
    """``name`` with as many underscores appended as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def block_of(n: int) -> Column:
    """A document's block: by doc_id, and by its text where that is null, so that no block is hot."""
    return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int")


def text_tag() -> Column:
    """31 bits that tell texts under one doc_id apart."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)), F.lit((1 << 31) - 1)).cast("int")


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    return text_bytes(batch.column(batch.schema.get_field_index(name)))


def release() -> None:
    """Give back what the last batch freed: Python workers live on, and their unused
    heap counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    release()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def row_slices(offs: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, so that scratch arrays stay bounded; one longer row stands alone."""
    out, at, n = [], 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def portions(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of text, for functions that keep arrays of a whole batch."""
    for batch in batches:
        _, offs = text_column(batch)
        for a, b in row_slices(offs, most):
            yield batch.slice(a, b - a)


#: Fast and small; blobs live only in shuffles and shared tables.
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Equal-length arrays as one compressed value, byte planes apart so that small numbers in wide types cost little."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return _CODEC.compress(raw, asbytes=True) if raw else b""


def unpack(blob: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    kinds = [np.dtype(d) for d in dtypes]
    raw = np.frombuffer(_CODEC.decompress(blob, n * sum(k.itemsize for k in kinds), asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for k in kinds:
        size = n * k.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(k.itemsize, n).T).reshape(-1).view(k) if n else np.zeros(0, k))
        at += size
    return out


BLOBS = "bucket int, n int, blob binary"


def blob_batch(buckets: np.ndarray, arrays: Sequence[np.ndarray], n_buckets: int, order: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket that occurs; ``order`` sorts by bucket first."""
    if order is None:
        order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    keys, first = np.unique(sorted_buckets, return_index=True)
    arrays = [a[order] for a in arrays]
    last = np.append(first[1:], len(order))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array([pack(*(x[a:b] for x in arrays)) for a, b in zip(first, last)], pa.binary())],
        ["bucket", "n", "blob"],
    )


def unpack_all(table: pa.Table, *dtypes: str) -> list[np.ndarray]:
    """The concatenated arrays of all blobs of a group."""
    parts = [unpack(b, n, *dtypes) for n, b in zip(table.column("n").to_pylist(), table.column("blob").to_pylist())]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, d) for d in dtypes]


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable.

    Alternating large-star and small-star steps until nothing moves: every step is one
    grouping, the links shrink towards stars, and each step's links are cut off in the
    shared folder. A hot centre has its neighbours' minimum pre-aggregated before the
    shuffle. Duplicate links, self links and both directions are fine."""
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "cc")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        # stars: no node has two targets, and no target has one; otherwise go on until nothing moves
        out = F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), F.xxhash64("a", "b").alias("h"))
        into = F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(0).cast("long").alias("h"))
        each = links.select(F.inline(F.array(out, into))).groupBy("node")
        each = each.agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
        uneven, n, mark = each.agg(F.count_if(F.expr("out > 1 or (out > 0 and into > 0)")), F.sum("out"), F.sum("h")).first()
        if not uneven or (n, mark) == seen:
            break
        seen = (n, mark)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(ends).groupBy("node").agg(F.min("component").alias("component"))
