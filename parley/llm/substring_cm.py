"""Substring deduplication over word windows with a count-min prefilter (operator 10).

1. Each window of WIDTH words is represented by its least 10-word gram (a
   minimiser). Grams chosen by some window are counted in a count-min sketch;
   equal windows choose equal grams, so a gram's estimate is never below the
   count of a window that it represents.
2. Windows whose estimate is two or more go on, each identified by 128 bits of two
   independent non-linear hashes of its words, with its first place for each input
   batch (later places of a batch are judged there: hot windows are pre-aggregated).
   One task for each hash bucket finds the first place of each window in the corpus.
3. Windows that start later than their first place come back to the blocks of
   their documents, which drop the words these windows cover.

Documents are ordered by doc_id, then start. Cases: null text is empty; rows with
a null ``doc_id`` are passed through unjudged and judge nobody; rows that share a
``doc_id`` and text count as the same document and each get its result; rows that share
a ``doc_id`` but not the text are different documents, neither of them earlier than the
other (they are told apart by 31 bits of a hash of the text); fewer than WIDTH words:
nothing is removed; other columns pass through. The struct that is added is the last
column, ``_s`` or, where that name is taken, ``_s`` with underscores appended.
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
from parley.llm.common import BLOBS, blob_batch, block_of, free_name, portions, row_slices, text_bytes, text_column, text_tag, unpack_all

GRAM = 10


def minimisers(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, each one's least gram, and the grams chosen
    (one for each place at which some window chooses it)."""
    gram = min(GRAM, width)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, tk.U), np.zeros(0, tk.U)
    acc = np.zeros(len(hashes) - gram + 1, tk.U)
    for k in range(gram):
        acc *= tk.U(0xD1342543DE82EF95)
        acc += hashes[k : k + len(acc)]
    g = tk.mix(acc)
    span, low, have = width - gram + 1, g, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    ok = rows[:n] == rows[width - 1 :]
    high = np.concatenate([np.zeros(span - 1, tk.U), np.where(ok, low[:n], tk.U(0)), np.zeros(span - 1, tk.U)])
    have = 1
    while have < span:
        step = min(have, span - have)
        high = np.maximum(high[: len(high) - step], high[step:])
        have += step
    at = np.flatnonzero(ok)
    return at, low[at], g[high[: len(g)] == g]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    data, offs = text_column(batch)
    for a, b in row_slices(offs):
        yield slice(a, b), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def window_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int, word: np.ndarray) -> list[np.ndarray]:
    """128 bits for each window that starts at word ``at``: two hashes with seeds of their own."""
    out = []
    for h, salt in ((word, 0x51ED270B), (tk.span_hash(data, starts, ends, 1), 0x2545F491)):
        acc = np.full(len(at), salt, tk.U)
        for k in range(width):
            acc = tk.chain(acc, h[at + k])
        out.append(tk.mix(acc))
    return out


def first_places(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window and place, and in it: the first place of each window, and the
    places that are later than it (in a larger document, or further on in the same one).

    Documents with one doc_id and different tags do not precede each other."""
    order = np.lexsort((start, tag, doc, h2, h1))
    h1, h2, doc, tag, start = (x[order] for x in (h1, h2, doc, tag, start))
    lead = np.ones(len(h1), bool)
    lead[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    own = lead.copy()
    own[1:] |= (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    of = lambda mask: np.flatnonzero(mask)[np.cumsum(mask) - 1]
    later = (doc != doc[of(lead)]) | (start != start[of(own)])
    return order, lead, later


def drop_repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """``docs`` without text, plus a last struct: n_words, n_removed and ``text`` (the words kept, joined by one space)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = cm.bits_for(size / 30)  # words are about 6 bytes and one gram in 6 is chosen
    n_blocks, n_buckets = max(64, size >> 22), max(64, size >> 22)
    block = block_of(n_blocks)
    narrow = docs.select("doc_id", "text", block.alias("block"), text_tag().alias("tag"))

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, tk.U)]
        for _, data, offs in _slices(batch):
            starts, ends, rows = tk.words(data, offs)
            out.append(minimisers(tk.span_hash(data, starts, ends), rows, width)[2])
        return np.concatenate(out)

    repeated = cm.filter_of(narrow, keys_of, bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, block, tag = batch.column(0), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.uint32)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            parts: list[list[np.ndarray]] = []
            for rows_at, data, offs in _slices(batch):
                starts, ends, rows = tk.words(data, offs)
                h = tk.span_hash(data, starts, ends)
                at, low, _ = minimisers(h, rows, width)
                at = at[repeated(low) & known[rows_at][rows[at]]]
                first = np.searchsorted(rows, np.arange(len(offs)))  # first word of each row
                mine = rows[at]
                parts.append([*window_ids(data, starts, ends, at, width, h), ids[rows_at][mine], tag[rows_at][mine], (at - first[mine]).astype(np.uint32), block[rows_at][mine]])
            if not parts:
                continue
            h1, h2, doc, tag, start, blk = (np.concatenate(x) for x in zip(*parts))
            order, lead, later = first_places(h1, h2, doc, tag, start)
            h1, h2, doc, tag, start, blk = (x[order] for x in (h1, h2, doc, tag, start, blk))
            go = ~later  # first places, and those of documents that the first one does not precede
            go[1:] &= lead[1:] | (tag[1:] != tag[:-1])
            yield blob_batch(_bucket(h1[go], n_buckets), (h1[go], h2[go], doc[go], tag[go], start[go], blk[go].astype(np.uint32)), n_buckets)
            if later.any():  # judged here
                yield blob_batch(n_buckets + blk[later], (doc[later], tag[later], start[later]), n_buckets)

    def resolve(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= n_buckets:
            return table.set_column(0, "bucket", pa.array([bucket - n_buckets] * table.num_rows, pa.int32()))
        h1, h2, doc, tag, start, blk = unpack_all(table, "u8", "u8", "i8", "u4", "u4", "u4")
        order, _, later = first_places(h1, h2, doc, tag, start)
        doc, tag, start, blk = (x[order][later] for x in (doc, tag, start, blk))
        return pa.Table.from_batches([blob_batch(blk.astype(np.int64), (doc, tag, start), n_blocks)])

    flags = narrow.mapInArrow(candidates, BLOBS).groupBy("bucket").applyInArrow(resolve, BLOBS)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, doc_tag, start = unpack_all(right, "i8", "u4", "u4")
        key = tk.mix(doc.view(tk.U)) ^ doc_tag.astype(tk.U)
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        ids = left.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = tk.mix(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(tk.U)) ^ left.column("tag").to_numpy().astype(np.uint32).astype(tk.U)
        data_all, offs_all = text_bytes(left.column("text"))
        n_words, n_removed, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for a, b in row_slices(offs_all):
            data, offs = data_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
            starts, ends, rows = tk.words(data, offs)
            first = np.searchsorted(rows, np.arange(b - a + 1))
            lo, hi = np.searchsorted(key, ids[a:b], "left"), np.searchsorted(key, ids[a:b], "right")
            hits = np.where(known[a:b], hi - lo, 0)
            pick = np.repeat(lo, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
            at = np.repeat(first[:-1], hits) + start[pick].astype(np.int64)
            gone = tk.covered(at[at + width <= np.repeat(first[1:], hits)], width, len(starts))
            text, n_kept = keep_words(data, offs, starts, ends, rows, ~gone)
            n_words.append(tk.word_counts(rows, b - a))
            n_removed.append(n_words[-1] - n_kept)
            texts.append(text)
        out = left.select([c for c in left.column_names if c not in ("text", "block", "tag")])
        return out.append_column("n_words", pa.array(np.concatenate(n_words))).append_column("n_removed", pa.array(np.concatenate(n_removed))).append_column("kept_text", pa.chunked_array(texts, pa.string()))

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    left = docs.select("doc_id", "text", rest.alias("rest"), block.alias("block"), text_tag().alias("tag"))
    schema = T.StructType([*left.drop("text", "block", "tag").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    out = left.groupBy("block").cogroup(flags.groupBy("bucket")).applyInArrow(apply, schema)
    cols = [F.col(f"rest.`{c}`") for c in docs.columns if c != "text"]
    return out.select(*cols, F.struct("n_words", "n_removed", F.col("kept_text").alias("text")).alias(free_name(docs.columns, "_s")))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> tk.U(33)) % tk.U(n)).astype(np.int64)


def keep_words(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each row's kept words joined by one space, and how many they are."""
    n = len(offs) - 1
    s, e, r = starts[keep], ends[keep], rows[keep]
    more = np.append(r[1:] == r[:-1], False) if len(r) else np.zeros(0, bool)
    d = np.zeros(len(data) + 1, np.int8)
    d[s] += 1
    d[e] -= 1
    mask = np.cumsum(d[:-1]).astype(bool)
    out = data.copy()
    mask[e[more]] = True
    out[e[more]] = 0x20
    run = np.concatenate([[0], np.cumsum(mask)])[offs]
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(run.astype(np.int64)), pa.py_buffer(out[mask])])
    return text.cast(pa.string()), tk.word_counts(r, n)
