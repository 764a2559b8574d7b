"""The factorisation machine: the identity against all pairs, gradients, features in plain Python, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("parley.llm")

from parley.llm import quality_fm as fm  # noqa: E402
from parley.llm import textkernel as tk  # noqa: E402

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _quality string, good int, words int, m0 int"


def texts(seed, n):
    """Good prose, and bad texts of three kinds."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(30, 120)))
        kind = i % 8
        t = {0: " ".join(x + "$$$" for x in w), 1: " ".join(w).upper() + "!!", 2: " ".join([w[0]] * 40 + w[:5])}.get(kind, ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)))
        out.append((t, int(kind > 2)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, t, "en", "s", len(t), "kept", 5, 6, 7) for i, (t, _) in enumerate(texts(1, 400))]
    labels = [(i, q) for i, (_, q) in enumerate(texts(1, 400)) if i % 5]
    return spark.createDataFrame(rows, CLASHING), spark.createDataFrame(labels, "doc_id long, quality int"), {i: q for i, (_, q) in enumerate(texts(1, 400))}


def arrays(ts):
    b = [t.encode() for t in ts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)


def test_held_out_accuracy_and_columns(spark, labelled):
    docs, labels, truth = labelled
    out = fm.with_quality(docs, fm.train(docs, labels))
    assert out.columns == [*docs.columns, "_quality_"]
    rows = out.collect()
    assert all(r["_quality"] == "kept" and r["good"] == 5 for r in rows)
    right = [(r["_quality_"] >= fm.CUT) == truth[r.doc_id] for r in rows if r.doc_id % 5 == 0]
    assert len(right) == 80 and np.mean(right) >= 0.97
    assert all(0 <= r["_quality_"] <= 1 for r in rows)


def test_scores_are_those_of_all_pairs(spark, labelled):
    docs, labels, _ = labelled
    m = fm.train(docs, labels)
    got = {r.doc_id: r["_quality_"] for r in fm.with_quality(docs, m).where("doc_id < 12").collect()}
    for i, (t, _) in enumerate(texts(1, 400)[:12]):
        rows, bucket, stats = fm.features(*arrays([t]))
        col, x, _ = m.entries(rows, bucket, np.append(stats[0], np.log1p(len(t)))[None])
        pairs = sum(m.v[a] @ m.v[b] * x[j] * x[k] for j, a in enumerate(col) for k, b in enumerate(col) if j < k)
        z = m.slope * (m.b + (m.w[col] * x).sum() + pairs - m.at) + np.log(fm.CUT / (1 - fm.CUT))
        assert abs(1 / (1 + np.exp(-z)) - got[i]) < 1e-9


def test_gradients():
    rng = np.random.default_rng(3)
    m = fm.Machine(rng.normal(size=(9, 3)))
    m.w = 0.1 * rng.normal(size=m.w.shape)
    rows, bucket = np.repeat(np.arange(6), 4), rng.integers(0, 40, 24)
    col, x, first = m.entries(rows, bucket, rng.normal(size=(6, 3)))
    label = np.array([1, 0, 1, 1, 0, 0], bool)

    def loss():
        z, _ = m.logits(col, x, first)
        return np.mean(np.log1p(np.exp(-np.where(label, z, -z))))

    used, g_w, g_v, g_b = m.gradient(col, x, first, label)
    for k in (0, len(used) // 2, len(used) - 1):
        for p, at, g in ((m.w, used[k], g_w[k]), (m.v, (used[k], 2), g_v[k, 2])):
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()
            p[at] = keep - 1e-5
            assert abs((up - loss()) / 2e-5 - g) < 1e-6
            p[at] = keep
    m.b += 1e-5
    up = loss()
    m.b -= 2e-5
    assert abs((up - loss()) / 2e-5 - g_b) < 1e-6


def test_features_in_plain_python():
    ts = ["", " \n", "One two two\ntwo, # $$ | Ünï THREE!\nOne two two\n\n9 lives.", "a", "x" * 3000, "same same same " * 50]
    rows, bucket, stats = fm.features(*arrays(ts))
    for k, t in enumerate(ts):
        b, words = t.encode(), re.findall(r"[^\x20\x09-\x0d]+", t)
        low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        n, nb = max(1, len(words)), max(1, len(b))
        lines = [x for x in t.split("\n") if x]
        count = lambda chars: sum(c in chars for c in t)
        want = {
            "log_words": np.log1p(len(words)), "word_bytes": sum(len(w.encode()) for w in words) / n, "distinct": len(set(low)) / n, "top_word": max(Counter(low).values(), default=0) / n,
            "echo": sum(a == c for a, c in zip(low, low[1:])) / n, "symbols": count("#$%&*|<>+=~^_{}[]\\@") / nb, "marks": count("!?") / nb, "capitals": sum("A" <= c <= "Z" for c in t) / nb,
            "digits": count("0123456789") / nb, "stops": sum(w[-1] in ".,;:" for w in words) / n, "line_words": np.log1p(len(words) / max(1, len(lines))),
            "repeat_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "beyond_ascii": sum(x >= 128 for x in b) / nb, "lone_symbols": sum(w in "#$%&*|<>+=~^_{}[]\\@" for w in words) / n,
        }
        assert np.allclose(stats[k], [want[s] for s in fm.STATS], rtol=1e-5), t[:20]
        assert len(bucket[rows == k]) == len(set(bucket[rows == k])) <= len(set(low))
    assert len(bucket[rows == 2]) == len({w.lower() for w in ts[2].split() if w.isascii()} | {"Ünï"})


def test_odd_rows(spark, labelled):
    docs, labels, _ = labelled
    m = fm.train(docs, labels)
    odd = [(None, None, None, None, None, None, None, None, None), (1, None, "en", "s", 3, "x", 1, 1, 1), (1, "", "en", "s", None, "x", 1, 1, 1), (1, "word " * 50_000, "en", "s", -5, "x", 1, 1, 1)]
    df = spark.createDataFrame(odd + odd, CLASHING)
    got = sorted((str(r[:6]), r["_quality_"]) for r in fm.with_quality(df, m).collect())
    assert len(got) == 8 and all(a == b and 0 <= a[1] <= 1 for a, b in zip(got[::2], got[1::2]))
    assert fm.with_quality(docs.limit(0), m).count() == 0
    without = fm.with_quality(docs.select("doc_id", "text"), fm.train(docs.select("doc_id", "text"), labels))
    assert without.columns == ["doc_id", "text", "_quality"] and without.count() == 400


def test_labels_of_one_kind_or_none(spark, labelled):
    docs, labels, _ = labelled
    assert fm.train(docs, labels.where("quality = 1")) == 1.0
    assert fm.train(docs, labels.where("quality is null")) == 0.0
    assert {r["_quality_"] for r in fm.with_quality(docs.limit(3), 1.0).collect()} == {1.0}
    assert fm.train(docs.limit(0), labels) == 0.0


def test_long_texts_are_read_to_their_ends(spark):
    """Two texts that differ only in their last word have different entries."""
    a, b = arrays(["w " * 200_000 + "first"]), arrays(["w " * 200_000 + "other"])
    assert set(fm.features(*a)[1]) != set(fm.features(*b)[1])
    assert fm.features(*a)[2][0][0] == pytest.approx(np.log1p(200_001))
    assert tk.word_counts(np.zeros(3, int), 1)[0] == 3
