"""Hard negatives against brute force over Python integers."""

import math

import numpy as np
import pytest

pytest.importorskip("parley.llm")

from pyspark.sql import functions as F  # noqa: E402

from parley.llm import hard_negatives as hn  # noqa: E402

KIND = "vec_id long, embedding array<double>, label int, norm string, tag int"


def brute(rows, every=100, positives=5, negatives=5, low=80, high=100):
    use = [(i, [max(min(math.floor(x * 256) if math.isfinite(x * 256) else math.copysign(2**70, x), 2**62), -(2**62)) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda s: max(min(s, 2**63 - 1), -(2**63))
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in use if i % every == 0}:
        scores = sorted((-cut(int(sum(a * b for a, b in zip(v, w)))), j, d == c) for j, w, d in use if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scores if x[2]][:positives]:
            fits = [x for x in scores if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, "n", 1) for i, v, c in rows], KIND).repartition(3)
    out = hn.mine(hn.build_index(df), F.col("vec_id") % 100 == 0, **kw)
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def clusters():
    """Five tight clusters with labels that cut across them, ties and repeats."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(5, 16))
    return [(i, (centre[i % 5] + 0.15 * rng.normal(size=16)).tolist(), int(rng.integers(0, 3))) for i in range(600)]


def test_clusters_in_several_blocks(spark, clusters, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 300)
    got = mined(spark, clusters)
    assert got == brute(clusters) and len(got) > 60


def test_odd_rows(spark, clusters):
    v = clusters[100][1]
    odd = [(700, v, 0), (700, v, 0), (700, clusters[3][1], 0), (None, v, 1), (701, None, 1), (702, v, None), (703, [1.0, None], 1), (704, [float("nan")] * 16, 1), (705, [float("inf")] * 16, 1)]
    odd += [(800, [0.0] * 16, 1), (801, [0.0] * 16, 2), (802, [0.0] * 16, 1), (900, [], 1), (901, [], 1), (902, [], 2), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [1.0, 1.9], 2)]
    odd += [(1003 + k, v, k % 2) for k in range(40)]  # one common vector
    odd += [(1100, [3e18] * 2, 4), (1101, [3e18, 2e18], 4), (1102, [2.9e18, 2e18], 5), (1200, [1e307] * 3, 4), (1201, [1e307] * 3, 4), (1202, [1e308] * 3, 5), (-100, v, 1), (1300, v, 2)]
    rows = clusters + odd
    got = mined(spark, rows)
    assert got == brute(rows)
    assert {g[0] for g in got} >= {700, 900, 1000, -100}


def test_settings(spark, clusters):
    assert mined(spark, clusters[:301], positives=2, negatives=3, low=50, high=90) == brute(clusters[:301], 100, 2, 3, 50, 90)


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == []


def test_most_pairs_of_clusters_are_never_scored(clusters, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 32))
    x = hn.as_integers(centre[np.arange(4000) % 20] + 0.05 * rng.normal(size=(4000, 32)))
    n = hn.norms(x)
    refs = centre[:12] / np.linalg.norm(centre[:12], axis=1)[:, None]
    rows = hn.Rows(np.arange(4000), np.arange(4000) % 3, x, n, hn.angles_to(x, n, refs).astype(float))
    at = np.arange(0, 4000, 100)
    k = (len(at), 1)
    best = x[at] @ x.T
    low = np.sort(best, axis=1)[:, -60:-59].astype(np.int64)
    anchors = hn.Anchors(rows.take(at), at, low, np.full(k, hn.LONG.max), np.zeros(k, np.int64), np.zeros(k, np.int64), False, 5)
    scored = []
    whole = hn.products
    monkeypatch.setattr(hn, "products", lambda a, b: scored.append(len(a) * len(b)) or whole(a, b))
    anchors.start()
    anchors.scan(rows)
    assert sum(scored) < 0.2 * len(at) * 4000
    for j, i in enumerate(at):
        want = sorted((-best[j, m], m) for m in range(4000) if m % 3 != i % 3 and best[j, m] >= low[j, 0])[:5]
        assert [(-s, m) for s, m in zip(anchors.score[j, 0], anchors.id[j, 0])][: len(want)] == [(int(s), m) for s, m in want]


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x = np.concatenate([hn.as_integers(rng.normal(size=(200, 8)) * s) for s in (1e-2, 1, 1e6)])
    n = hn.norms(x)
    t = hn.angles_to(x, n, np.eye(8)[:5]).astype(float)
    gap = np.abs(t[:, None] - t[None]).max(axis=2)
    reach = hn.reach_of(t[:, None], t[None], t[None]).min(axis=2)
    low, high = hn.bounds(gap, reach, n[:, None], n, n)
    s = x @ x.T
    assert (low <= s).all() and (s <= high).all()
