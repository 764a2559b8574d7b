"""Byte-substring deduplication with a logarithmic family of suffix arrays (operator 2).

Every WIDTH-byte string of the corpus is a suffix cut at WIDTH bytes. Suffixes are
dealt out by the least K-byte gram inside them, so equal strings always meet, and
neighbouring suffixes with the same gram travel as one run (their bytes once).
Runs whose gram occurs in one document only are left out before the shuffle: a
bounded count-min sketch, which never underestimates, tells which.

Within a bucket documents arrive in batches by ascending doc_id. A batch gets a
suffix array, which is merge-scanned against every level of the index for equal
strings; the strings that are new form a level, and levels of equal size merge,
so levels double in size and there are logarithmically many.

Cases: null text is empty; matches never cross documents; rows with a null
``doc_id`` are passed through unjudged and judge nobody; rows that share a ``doc_id``
never judge each other, whether their texts are equal or not (different texts are told
apart by 31 bits of a hash of the text); texts under WIDTH bytes lose nothing; other
columns pass through; an empty table gives an empty result. The struct that is added is
the last column, ``_s`` or, where that name is taken, ``_s`` with underscores appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import sketch as cm
from parley.llm import textkernel as tk
from parley.llm.common import BLOBS, blob_batch, block_of, free_name, pack, portions, row_slices, text_bytes, text_column, text_tag, unpack, unpack_all

GRAM, BATCH, SLICE = 20, 1 << 16, 1 << 20
RUNS = "bucket int, n int, blob binary, bytes binary"


def runs_of(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tk.Rolling]:
    """Runs of neighbouring suffixes with one least gram: row, first start, count, gram."""
    roll = tk.Rolling(data)
    n = len(data) - width + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z, np.zeros(0, tk.U), roll
    k = min(GRAM, width)
    i = np.arange(len(data) - k + 1)
    low = roll.of(i, i + k)
    have, span = 1, width - k + 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    ends = np.repeat(offs[1:], np.diff(offs))[:n]
    ok = np.arange(n) + width <= ends
    head = ok.copy()
    head[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | (ends[1:] != ends[:-1])
    at = np.flatnonzero(head)
    stop = np.flatnonzero(head | ~ok)
    nxt = np.append(stop, n)[np.searchsorted(stop, at, "right")]
    return np.searchsorted(offs, at, "right") - 1, at, nxt - at, low[at], roll


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + count), one after the other."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def pieces(size: np.ndarray, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of about ``most`` bytes in all, so that index arrays stay small."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def collapse(keys: np.ndarray, size: np.ndarray, at: np.ndarray, raw: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs with equal bytes: mask of all those in the group's smallest document (a repeat
    inside it may still start in a smaller document elsewhere), and mask of those in a
    larger document. Equality is by the bytes themselves."""
    order = np.lexsort((doc, size, keys))
    lead = np.ones(len(order), bool)
    lead[1:] = (keys[order][1:] != keys[order][:-1]) | (size[order][1:] != size[order][:-1])
    rep = np.empty(len(order), np.int64)
    rep[order] = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    other = np.flatnonzero(rep != np.arange(len(rep)))
    same = np.zeros(len(rep), bool)
    for part in pieces(size[other]):
        some = other[part]
        differs = raw[ranges(at[some], size[some])] != raw[ranges(at[rep[some]], size[some])]
        same[some] = ~np.logical_or.reduceat(differs, np.cumsum(size[some]) - size[some])
    later = same & (doc != doc[rep])
    return ~later, later


class SuffixLevels:
    """Sorted arrays of distinct suffixes, each level about twice the one below."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def known(self, suffixes: np.ndarray) -> np.ndarray:
        """Merge-scan a sorted batch against each level."""
        hit = np.zeros(len(suffixes), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            hit |= level[at] == suffixes
        return hit

    def add(self, suffixes: np.ndarray) -> None:
        if len(suffixes):
            while self.levels and len(self.levels[-1]) < 2 * len(suffixes):
                suffixes = np.sort(np.concatenate([self.levels.pop(), suffixes]), kind="stable")
            self.levels.append(suffixes)


def judge_bucket(doc: np.ndarray, size: np.ndarray, raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of the runs also start in a smaller document: run number and place in the run."""
    at = np.cumsum(size) - size
    keys = np.zeros(len(size), tk.U)
    for part in pieces(size):
        lo, hi = at[part][0], at[part][-1] + size[part][-1]
        keys[part] = tk.Rolling(raw[lo:hi]).of(at[part] - lo, at[part] + size[part] - lo)
    keep, later = collapse(keys, size, at, raw, doc)
    whole = np.flatnonzero(later)
    out_run = [np.repeat(whole, size[whole] - width + 1)]
    out_at = [ranges(np.zeros(len(whole), np.int64), size[whole] - width + 1)]
    runs = np.flatnonzero(keep)
    runs = runs[np.argsort(doc[runs], kind="stable")]
    count = size[runs] - width + 1
    total = np.cumsum(count)
    view = np.lib.stride_tricks.sliding_window_view(raw, width) if len(raw) >= width else None
    index, a = SuffixLevels(), 0
    while a < len(runs):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH, "right")))
        while b < len(runs) and doc[runs[b]] == doc[runs[b - 1]]:  # a batch ends with a document
            b += 1
        run = np.repeat(runs[a:b], count[a:b])
        place = ranges(np.zeros(b - a, np.int64), count[a:b])
        keys = np.ones((len(run), width + 1), np.uint8)  # a last byte of 1 keeps trailing zeros
        keys[:, :width] = view[at[run] + place]
        keys = keys.view(f"S{width + 1}").reshape(-1)
        order = np.argsort(keys, kind="stable")  # the batch's suffix array; documents ascend among equals
        keys, run, place = keys[order], run[order], place[order]
        lead = np.ones(len(keys), bool)
        lead[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(lead)
        group = np.cumsum(lead) - 1
        old = index.known(keys[first])
        hit = old[group] | (doc[run] != doc[run[first]][group])
        out_run.append(run[hit])
        out_at.append(place[hit])
        index.add(keys[first][~old])
        a = b
    return np.concatenate(out_run), np.concatenate(out_at)


def _flags(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, block: np.ndarray, shift: int, n: int) -> pa.RecordBatch:
    order = np.lexsort((start, doc, block))
    b = blob_batch(block[order] + shift, (doc[order], tag[order], start[order].astype(np.uint32), count[order].astype(np.uint32)), n, np.arange(len(order)))
    return b.append_column("bytes", pa.array([b""] * b.num_rows, pa.binary()))


def drop_repeated_bytes(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` without text, plus a last struct: n_bytes, n_removed, n_spans and ``kept`` (the bytes that remain)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = cm.bits_for(size / 16)
    n_blocks, n_buckets = max(64, size >> 22), max(64, size >> 21)
    block = block_of(n_blocks)
    narrow = docs.select("doc_id", "text", block.alias("block"), text_tag().alias("tag"))

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data, offs = text_column(batch)
        for a, b in row_slices(offs, SLICE):
            yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, tk.U)]
        for _, data, offs in slices(batch):
            rows, _, _, low, _ = runs_of(data, offs, width)
            order = np.lexsort((low, rows))
            low, rows = low[order], rows[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
            out.append(low[new])
        return np.concatenate(out)

    repeated = cm.filter_of(narrow, keys_of, bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            block, tag = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.uint32)
            parts: list[list[np.ndarray]] = []
            for a, data, offs in slices(batch):
                rows, at, count, low, roll = runs_of(data, offs, width)
                pick = repeated(low) & known[a + rows]
                rows, at, count, low = rows[pick], at[pick], count[pick], low[pick]
                length = count + width - 1
                parts.append([ids[a + rows], tag[a + rows], block[a + rows], at - offs[rows], length, low, roll.of(at, at + length), data[ranges(at, length)]])
            if not parts:
                continue
            doc, mark, blk, start, length, low, keys, raw = (np.concatenate(x) for x in zip(*parts))
            keep, later = collapse(keys, length, np.cumsum(length) - length, raw, doc)
            if later.any():
                yield _flags(doc[later], mark[later], start[later], length[later] - width + 1, blk[later], n_buckets, n_buckets)
            bucket = ((low >> tk.U(20)) % tk.U(n_buckets)).astype(np.int64)
            order = np.flatnonzero(keep)
            order = order[np.lexsort((start[order], doc[order], bucket[order]))]
            offset = (np.cumsum(length) - length)[order]
            out = blob_batch(bucket[order], (doc[order], mark[order], start[order].astype(np.uint32), length[order].astype(np.uint32), blk[order].astype(np.uint32)), n_buckets, np.arange(len(order)))
            ends = np.cumsum(out.column(1).to_numpy())
            lengths = length[order]
            texts = [pack(raw[ranges(offset[e - n : e], lengths[e - n : e])]) for n, e in zip(out.column(1).to_numpy(), ends)]
            yield out.append_column("bytes", pa.array(texts, pa.binary()))

    def resolve(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= n_buckets:
            return table.set_column(0, "bucket", pa.array([bucket - n_buckets] * table.num_rows, pa.int32())).drop_columns(["bytes"])
        parts, raws = [], []
        for n, blob, packed in zip(*(table.column(c).to_pylist() for c in ("n", "blob", "bytes"))):
            parts.append(unpack(blob, n, "i8", "u4", "u4", "u4", "u4"))
            raws.append(unpack(packed, int(parts[-1][3].sum()), "u1")[0])
        doc, mark, start, length, blk = (np.concatenate(x) for x in zip(*parts))
        run, place = judge_bucket(doc, length.astype(np.int64), np.concatenate(raws), width)
        order = np.lexsort((place, run))
        run, place = run[order], place[order]
        head = np.ones(len(run), bool)
        head[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(run)))
        run, place = run[first], place[first]
        return pa.Table.from_batches([_flags(doc[run], mark[run], start[run] + place, count, blk[run].astype(np.int64), 0, n_blocks)]).drop_columns(["bytes"])

    flags = narrow.mapInArrow(candidates, RUNS).groupBy("bucket").applyInArrow(resolve, BLOBS)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, mark, start, count = unpack_all(right, "i8", "u4", "u4", "u4")
        key = tk.mix(doc.view(tk.U)) ^ mark.astype(tk.U)
        order = np.argsort(key, kind="stable")
        key, start, count = key[order], start[order].astype(np.int64), count[order].astype(np.int64)
        ids = left.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = tk.mix(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(tk.U)) ^ left.column("tag").to_numpy().astype(np.uint32).astype(tk.U)
        data_all, offs_all = text_bytes(left.column("text"))
        cols: list[list] = [[], [], [], []]
        for a, b in row_slices(offs_all):
            data, offs = data_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
            lo, hi = np.searchsorted(key, ids[a:b], "left"), np.searchsorted(key, ids[a:b], "right")
            hits = np.where(known[a:b], hi - lo, 0)
            pick = ranges(lo, hits)
            stop = np.repeat(offs[1:], hits)
            s = np.minimum(np.repeat(offs[:-1], hits) + start[pick], stop)
            d = np.zeros(len(data) + 1, np.int32)
            np.add.at(d, s, 1)
            np.add.at(d, np.minimum(s + count[pick] + width - 1, stop), -1)
            gone = np.cumsum(d[:-1]) > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])[offs].astype(np.int32)
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            edge = offs[:-1][offs[:-1] < len(data)]
            head[edge] = gone[edge]
            spans = np.concatenate([[0], np.cumsum(head)])[offs]
            n = np.diff(offs)
            for c, v in zip(cols, (pa.array(n), pa.array(n - np.diff(kept)), pa.array(np.diff(spans)), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(kept), pa.py_buffer(data[~gone])]))):
                c.append(v)
        out = left.drop_columns(["text", "block", "tag"])
        for name, c, kind in zip(("n_bytes", "n_removed", "n_spans", "kept"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary())):
            out = out.append_column(name, pa.chunked_array([x.cast(kind) for x in c], kind))
        return out

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    left = docs.select("doc_id", "text", rest.alias("rest"), block.alias("block"), text_tag().alias("tag"))
    schema = T.StructType([*left.drop("text", "block", "tag").schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    out = left.groupBy("block").cogroup(flags.groupBy("bucket")).applyInArrow(apply, schema)
    return out.select(*[F.col(f"rest.`{c}`") for c in docs.columns if c != "text"], F.struct("n_bytes", "n_removed", "n_spans", "kept").alias(free_name(docs.columns, "_s")))
