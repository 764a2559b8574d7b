"""Embedding near-duplicates by dual traversal of cover trees (operator 6).

Vectors of one label are compared by cosine, in double precision, through the
chord distance of their unit vectors, so a cosine threshold is a radius. The top
of the tree is shared: pivots chosen farthest-first from a bounded sample (each
prefix of them is a coarser level) cut each label into cells of about CELL vectors;
cells that stay large are sliced. Pairs of cells whose covering balls are farther
apart than the radius are pruned, and every other pair is one task. A task builds
the lower levels, with radii that at least halve, and walks both trees together:
node pairs are pruned by their covering radii, or accepted whole where the bounds
allow no other outcome, and the rest is compared exactly in leaves.

Equal vectors are one point with a weight. A task returns link counts and a
spanning star of each local component, never its pairs; components are then joined
over all tasks.

Cases: a null label, or a vector that is null, empty, zero or holds null or
non-finite numbers, links with nothing; vectors of different lengths never link;
ties are kept (cosine >= threshold); repeated rows link with each other like any
two vectors; different vectors under one vec_id are different points, each row with its
own links; a null vec_id links with nothing; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import connected_components, materialize

CELL, SAMPLE, PIVOTS, LEAF = 1024, 4096, 256, 48
FOUND = "a long, b long, n long"


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def farthest_first(x: np.ndarray, most: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres until all points are within ``radius`` (or ``most`` are chosen); each point's centre and distance."""
    near = chord(x, x[:1])[:, 0]
    owner, centres = np.zeros(len(x), np.int64), [0]
    while len(centres) < most and near.max() > radius:
        c = int(near.argmax())
        d = chord(x, x[c : c + 1])[:, 0]
        closer = d < near
        owner[closer], near[closer] = len(centres), d[closer]
        centres.append(c)
    return np.array(centres), owner, near


class Node:
    """A centre, its points and its covering radius; children cover with half of it at most."""

    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: int, radius: float) -> None:
        self.centre, self.points, self.radius, self.children = centre, points, radius, None

    def expand(self, x: np.ndarray) -> list[Node]:
        if self.children is None:
            mine = x[self.points]
            if len(self.points) <= LEAF or self.radius < 1e-6:
                self.children = []
            else:
                centres, owner, near = farthest_first(mine, len(mine), self.radius / 2)
                self.children = [Node(x, self.points[owner == k], int(self.points[c]), float(near[owner == k].max())) for k, c in enumerate(centres)]
        return self.children


def dual(x: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= ``cosine`` between two point sets, or within one (right None)."""
    theta, slack = float(np.sqrt(2 - 2 * cosine)), 1e-7
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def root(points: np.ndarray) -> Node:
        return Node(x, points, int(points[0]), float(chord(x[points], x[points[:1]]).max()))

    a = root(left)
    stack = [(a, a if right is None else root(right))]
    while stack:
        p, q = stack.pop()
        ps, qs = p.expand(x), q.expand(x)
        if not ps and not qs:
            hit = x[p.points] @ x[q.points].T >= cosine
            if p is q:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            out_a.append(p.points[i])
            out_b.append(q.points[j])
            continue
        ps, qs = ps or [p], qs or [q]
        d = chord(x[[n.centre for n in ps]], x[[n.centre for n in qs]])
        rp, rq = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        alive = d - rp[:, None] - rq[None, :] <= theta + slack
        whole = d + rp[:, None] + rq[None, :] <= theta - slack
        if p is q:
            alive = np.triu(alive)
        for i, j in zip(*np.nonzero(alive)):
            m, n = ps[i], qs[j]
            if whole[i, j] and m is not n:
                out_a.append(np.repeat(m.points, len(n.points)))
                out_b.append(np.tile(n.points, len(m.points)))
            else:
                stack.append((m, n))
    return np.concatenate(out_a), np.concatenate(out_b)


def local_stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, least node of its component) over nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(len(column), -1))


def link_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))
    keys = ["label", "h1", "h2"]
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = every.where(sound).withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    points = rows.groupBy(*keys).agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    points = materialize(points.withColumn("dim", F.size("embedding")), "ct-points")
    # a point's number is its least vec_id; where several points share that, all but one get numbers below all ids
    twins = points.groupBy("low").agg(F.min(F.struct(*keys)).alias("one"), F.count("*").alias("n")).where("n > 1").select("low", "one")
    twins = materialize(twins, "ct-twins")
    several = twins.limit(1).count() > 0
    rep = F.col("low")
    if several:
        points = points.join(twins, "low", "left")
        own = -F.lit(1 << 62) - F.pmod(F.xxhash64("low", *keys), F.lit(1 << 61))
        rep = F.when(F.struct(*keys) > F.col("one"), own).otherwise(F.col("low"))
    points = points.select(*keys, "low", "weight", "embedding", "dim", rep.alias("rep"))
    label_type = points.schema["label"].dataType.simpleString()

    pivots: dict[int, np.ndarray] = {}
    sample = points.select("dim", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas()
    for dim, part in sample.groupby("dim"):
        x = unit(np.stack(part.embedding.to_numpy()))
        pivots[int(dim)] = x[farthest_first(x, PIVOTS, 1e-3)[0]]

    def assign(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims, want = table.column("dim").to_numpy(), table.column("want").to_numpy()
            cell, dist = np.zeros(len(dims), np.int32), np.full(len(dims), 2.0)
            for dim in np.unique(dims):
                if (top := pivots.get(int(dim))) is not None:
                    at = np.flatnonzero(dims == dim)
                    d = chord(_matrix(table.column("embedding").take(pa.array(at))), top)
                    d[np.arange(len(top))[None, :] >= np.maximum(1, want[at])[:, None]] = 9.0
                    cell[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "rep", "weight", "embedding")), pa.array(cell), pa.array(dist)], ["label", "dim", "rep", "weight", "embedding", "cell", "dist"])

    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / CELL).cast("int").alias("want"))
    placed = points.join(sizes, ["label", "dim"]).select("label", "dim", "rep", "weight", "embedding", "want").mapInArrow(assign, f"label {label_type}, dim int, rep long, weight long, embedding array<double>, cell int, dist double")
    placed = materialize(placed, "ct-cells")
    crowd = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("slices"))
    placed = placed.join(crowd, ["label", "dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    balls = materialize(placed.groupBy("label", "dim", "cell", "slice").agg(F.max("dist").alias("radius")), "ct-balls")

    far = spark.createDataFrame([(dim, i, j, float(d)) for dim, p in pivots.items() for i, line in enumerate(chord(p, p)) for j, d in enumerate(line)] or [(0, 0, 0, 0.0)], "dim int, x_cell int, y_cell int, d double")
    x, y = (balls.select("label", "dim", *(F.col(c).alias(f"{s}_{c}") for c in ("cell", "slice", "radius"))) for s in "xy")
    pairs = x.join(y, ["label", "dim"]).where("x_cell < y_cell or (x_cell = y_cell and x_slice <= y_slice)").join(far, ["dim", "x_cell", "y_cell"], "left")
    theta = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    pairs = pairs.where(F.coalesce("d", F.lit(0.0)) - F.col("x_radius") - F.col("y_radius") <= theta)
    pairs = materialize(pairs.select("label", "dim", "x_cell", "x_slice", "y_cell", "y_slice").withColumn("task", F.concat_ws("/", "label", "dim", "x_cell", "x_slice", "y_cell", "y_slice")), "ct-pairs")
    sides = [pairs.select("task", "label", "dim", F.col(f"{s}_cell").alias("cell"), F.col(f"{s}_slice").alias("slice"), F.lit(s == "y").alias("right")) for s in "xy"]
    sides[1] = sides[1].join(pairs.where("x_cell = y_cell and x_slice = y_slice").select("task"), "task", "left_anti")
    work = placed.join(sides[0].unionByName(sides[1]), ["label", "dim", "cell", "slice"]).select("task", "right", "rep", "weight", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("embedding"))
        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        right = table.column("right").to_numpy()
        order = np.argsort(rep, kind="stable")
        l, r = order[~right[order]], order[right[order]]
        a, b = dual(x, l, r if len(r) else None, cosine)
        links = np.bincount(a, weights=weight[b], minlength=len(rep)) + np.bincount(b, weights=weight[a], minlength=len(rep))
        at = np.flatnonzero(links)
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        node, star = local_stars(rank[a], rank[b], len(rep))
        return pa.table({"a": pa.array(np.concatenate([rep[at], rep[order[node]]])), "b": pa.array(np.concatenate([rep[at], rep[order[star]]])), "n": pa.array(np.concatenate([links[at], np.zeros(len(node))]).astype(np.int64))})

    found = materialize(work.groupBy("task").applyInArrow(compare, FOUND), "ct-found")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    label = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    classes = points.join(counts, "rep", "left").join(label, "rep", "left")
    classes = classes.select(*keys, "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    if several:  # the least vec_id of a component's points, not the least number
        least = classes.groupBy("component_id").agg(F.min("low").alias("least"))
        classes = classes.join(least, "component_id").withColumn("component_id", F.col("least"))
    linked = rows.select("vec_id", *keys).join(classes.select(*keys, "n_links", "component_id"), keys)
    linked = linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    alone = every.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
