"""K-d tree sharding by distributed weighted medians (operator 1, DataFrame functions only).

Documents are points in a metadata space (language, source, length, text hash).
A node that must hold k shards is split along its widest dimension where the
bytes on the left reach floor(k/2)/k of the node's, until every leaf is one
shard; shards therefore differ by single documents at most in bytes (law
``bytes``). Each dimension is a 60-bit key: the value, then bits of the text's CRC
and of a hash of doc_id, so copies of one text can be divided anywhere.

A median is found by narrowing: one aggregation counts bytes by the next 10 bits
of the key inside the open bucket of every node at once, so all nodes of a level
share a handful of small jobs and no row moves. Only the histogram of at most
(nodes x 1024) rows reaches the driver. Slots are numbered within small chunks of a
shard whose offsets come from an aggregate, so no task holds a whole shard.

Copies of one text can lie in several shards: equal sizes would not hold otherwise. A text
of more bytes than a shard makes its shard that much larger.

Cases: null texts weigh 8 bytes and have the CRC of the empty text; null ``lang`` or
``source`` are values of their own; rows that share a ``doc_id`` are placed each on
its own; with fewer documents than shards some shards stay empty; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import materialize

#: Dimension: bits of its value.
DIMS = ("lang", "source", "length", "texthash")
VALUE_BITS, STEP, KEY_BITS = 12, 10, 60
#: A split is exact enough when the open bucket holds this share of a node's bytes.
CLOSE = 1 / 20_000
CHUNK_ROWS = 4096


def _code(column: str) -> Column:
    """A stable 12-bit code of a nullable string: equal values stay together."""
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(column), F.lit(4095)))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one key for each dimension; the text is read once."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _code("lang").alias("v_lang"), _code("source").alias("v_source"))
    length = F.least(F.lit(4095), (F.log2(F.col("size").cast("double")) * 128).cast("long"))
    tie = F.shiftleft(F.shiftright("text_crc32", 4), 20) + F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
    value = {"lang": F.col("v_lang"), "source": F.col("v_source"), "length": length, "texthash": F.shiftright("text_crc32", 20)}
    return base.select("doc_id", "size", "text_crc32", *((F.shiftleft(value[d].cast("long"), KEY_BITS - VALUE_BITS) + tie).alias(f"k_{d}") for d in DIMS))


class Tree:
    """The splits made so far; turns a value for each leaf into one nested CASE over the keys."""

    def __init__(self, n_shards: int) -> None:
        self.cuts: dict[int, tuple[str, int]] = {}
        self.leaves = {1: (0, n_shards)}

    def column(self, of: Callable[[int], Column], node: int = 1) -> Column:
        if node not in self.cuts:
            return of(node)
        dim, cut = self.cuts[node]
        return F.when(F.col(f"k_{dim}") >= cut, self.column(of, 2 * node + 1)).otherwise(self.column(of, 2 * node))

    def open_nodes(self) -> list[int]:
        return [n for n, (_, k) in self.leaves.items() if k > 1]

    def split(self, cuts: dict[int, tuple[str, int]]) -> None:
        for n in self.open_nodes():
            first, k = self.leaves.pop(n)
            if n in cuts:
                self.cuts[n] = cuts[n]
                self.leaves |= {2 * n: (first, k // 2), 2 * n + 1: (first + k // 2, k - k // 2)}
            else:
                self.leaves[n] = (first, 1)  # an empty node


def find_cuts(points: DataFrame, tree: Tree) -> dict[int, tuple[str, int]]:
    """The widest dimension of every open node and the weighted quantile of its key."""
    nodes = tree.open_nodes()
    value = {d: F.shiftright(f"k_{d}", KEY_BITS - VALUE_BITS) for d in DIMS[:3]}
    spans = [e for d, v in value.items() for e in (F.min(v).alias(f"lo_{d}"), F.max(v).alias(f"hi_{d}"), F.approx_count_distinct(v, 0.05).alias(f"n_{d}"))]
    node = tree.column(lambda n: F.lit(n if n in nodes else None).cast("int"))
    state: dict[int, dict] = {}
    for row in points.groupBy(node.alias("node")).agg(F.sum("size").alias("bytes"), *spans).where("node is not null").collect():
        # widest: codes count by their number of values, the length by its range
        width = {d: 160 * (row[f"n_{d}"] - 1) if d != "length" else row[f"hi_{d}"] - row[f"lo_{d}"] for d in value}
        dim = max(width, key=width.get) if max(width.values()) > 0 else "texthash"
        k = tree.leaves[row.node][1]
        state[row.node] = {"dim": dim, "want": row.bytes * (k // 2) // k, "bytes": row.bytes, "below": 0, "prefix": 0, "open": True}
    for bits in range(0, KEY_BITS, STEP):
        todo = {n: s for n, s in state.items() if s["open"]}
        if not todo:
            break
        cell = tree.column(lambda n: F.when(F.shiftright(f"k_{todo[n]['dim']}", KEY_BITS - bits) == todo[n]["prefix"], F.shiftright(f"k_{todo[n]['dim']}", KEY_BITS - bits - STEP)) if n in todo else F.lit(None).cast("long"))
        found: dict[int, list] = {}
        for c in points.groupBy(node.alias("node"), cell.alias("cell")).agg(F.sum("size").alias("bytes")).where("cell is not null").collect():
            found.setdefault(c.node, []).append((c.cell, c.bytes))  # at most 1024 a node
        for n, s in todo.items():
            for at, weight in sorted(found[n]):
                if s["below"] + weight > s["want"]:
                    break
                s["below"] += weight
            s |= {"prefix": at, "bits": bits + STEP, "open": bits + STEP < KEY_BITS and weight > max(1, CLOSE * s["bytes"])}
            if not s["open"] and s["want"] - s["below"] > weight / 2:
                s["prefix"] += 1  # the last bucket goes left as a whole
    return {n: (s["dim"], s["prefix"] << (KEY_BITS - s["bits"])) for n, s in state.items()}


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the leaf of every document.

    Fix ``n_shards`` from a target size with ``shards_for``."""
    # rows without an id are told apart for their slots only
    points = materialize(metadata(docs).withColumn("salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "kd")
    tree = Tree(n_shards)
    while tree.open_nodes():
        tree.split(find_cuts(points, tree))
    placed = points.select("doc_id", "size", "text_crc32", "salt", tree.column(F.lit).alias("leaf"), tree.column(lambda n: F.lit(tree.leaves[n][0])).alias("shard"))
    return _with_slots(placed, n_shards)


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """Leaves needed so that none exceeds ``target_bytes`` by more than rounding."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    return max(1, -(-total // target_bytes))


def _with_slots(placed: DataFrame, n_shards: int) -> DataFrame:
    rows = placed.count()
    chunks = max(1, rows // (n_shards * CHUNK_ROWS))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "salt", F.lit(5)), F.lit(chunks)).cast("int"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("inner", inner).join(offsets, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("inner") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "leaf"
    )
