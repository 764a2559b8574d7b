"""A distributed count-min sketch with saturating counters.

Every input batch makes a partial sketch, kept sparse and cut into slabs; the
partials of a slab are added in one task. What consumers need is whether the
estimate of a key is two or more, so the merged sketch is one bit for each cell,
and its size is bounded by ``depth * 2**MOST_BITS / 8`` bytes (64 MB) whatever the
input: only that is broadcast. The estimate is never below the true count, so a
consumer that skips keys estimated once loses none that repeats. Past the bound
more single keys look repeated, which costs shuffle and never a result."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.common import BLOBS, pack, portions, unpack
from parley.llm.textkernel import U, mix

DEPTH, MOST_BITS, SLAB_BITS = 2, 28, 20
_SALT = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0]


def bits_for(keys: float) -> int:
    """Log2 of a row's cells: about three for each key, within the bound."""
    return int(min(MOST_BITS, max(SLAB_BITS, math.ceil(math.log2(max(1.0, 3 * keys))))))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ U(_SALT[row])) >> U(64 - bits)).astype(np.int64)


def partial(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """One batch's sketch: a sparse blob for each slab it touches."""
    out: list[tuple[int, int, bytes]] = []
    for row in range(DEPTH):
        c, n = np.unique(cells(keys, row, bits), return_counts=True)
        slab = c >> SLAB_BITS
        first = np.flatnonzero(np.diff(slab, prepend=-1)) if len(c) else np.zeros(0, np.int64)
        for a, b in zip(first, [*first[1:], len(c)]):
            gaps = np.diff(c[a:b] & ((1 << SLAB_BITS) - 1), prepend=0).astype(np.uint32)
            out.append((row << 16 | int(slab[a]), int(b - a), pack(gaps, np.minimum(n[a:b], 2).astype(np.uint8))))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "n", "blob"])


def _merge(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLAB_BITS, np.uint8)
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist()):
        gaps, count = unpack(blob, n, "u4", "u1")
        at = np.cumsum(gaps.astype(np.int64))
        total[at] = np.minimum(total[at] + count, 2)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([1 << SLAB_BITS], pa.int32()), "blob": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})


def build(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> list[np.ndarray]:
    """Merge the partial sketches of all batches; returns DEPTH bit arrays."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            if batch.num_rows:
                yield partial(keys_of(batch), bits)

    slab_bytes = (1 << SLAB_BITS) // 8
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    # at most DEPTH * 2**(bits - SLAB_BITS) slabs come back: the bounded sketch itself
    for slab in df.mapInArrow(emit, BLOBS).groupBy("bucket").applyInArrow(_merge, BLOBS).toLocalIterator():
        at = (slab.bucket & 0xFFFF) * slab_bytes
        rows[slab.bucket >> 16][at : at + slab_bytes] = np.frombuffer(slab.blob, np.uint8)
    return rows


def filter_of(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function for tasks: the mask of the keys whose estimate is two or more."""
    shared = df.sparkSession.sparkContext.broadcast(build(df, keys_of, bits))
    return lambda keys: repeated(shared.value, keys, bits)


def repeated(sketch: list[np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    """Mask of the keys whose estimate is two or more."""
    hit = np.ones(len(keys), bool)
    for row, cell_bits in enumerate(sketch):
        c = cells(keys, row, bits)
        hit &= (cell_bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
    return hit
