"""Every operator against brute force or a law, and the odd cases each must survive."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("parley.llm")

from parley.llm import cover_tree, katz, mixing, prob_minhash, quality, shard_kd, sp_wfst, substring_cm, suffix_index, toxicity  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, label string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    vocab = ["w%d" % i for i in range(400)] + ["é", "日本"]
    texts = [" ".join(rng.choice(vocab, n)) for n in rng.integers(1, 120, 40)]
    texts += [texts[3], texts[3], " ".join(texts[5].split()[:60] + texts[7].split()), texts[9] + " new", None, "", "   \n", "a " * 3000, "x" * 5000]
    rows = [(i, t, [None, "en"][i % 2], [None, "s"][i % 3 == 0], 0, 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id text", "en", "s", 0, 1, "z")], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def known(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None)


def test_sharding(docs, empty):
    out = shard_kd.shard(docs, 5).collect()
    assert len(out) == docs.count() and shard_kd.shard(empty, 5).count() == 0
    slots = Counter()
    for s in range(5):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
        slots[s] = sum(r.size for r in out if r.shard == s)
    assert sum(slots.values()) == sum(len((r.text or "").encode()) + 8 for r in docs.collect())


def test_byte_dedup(docs, empty):
    got = {r.doc_id: r._s for r in suffix_index.drop_repeated_bytes(docs).collect()}
    assert suffix_index.drop_repeated_bytes(empty).count() == 0
    seen = set()
    for i, t in known(docs):
        b, mine = (t or "").encode(), set()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            mine.add(k)
            if k in seen:
                gone[s : s + 50] = [True] * 50
        seen |= mine
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone) if not g) and got[i].n_removed == sum(gone)
        assert got[i].n_spans == sum(g and not p for g, p in zip(gone, [False, *gone]))


def test_byte_dedup_of_repeats_in_one_document(spark):
    rng = np.random.default_rng(5)
    p, *other = (" ".join("w%d" % x for x in rng.integers(0, 10**6, 60)) for _ in range(5))
    twice = [(1, p + other[0] + p + other[1] + p), (2, other[2] + p + other[3] + p)]
    docs = spark.createDataFrame([(0, p), *twice], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # every document in its own batch
    try:
        got = {r.doc_id: bytes(r._s.kept).decode() for r in suffix_index.drop_repeated_bytes(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    seen = {p[k : k + 50] for k in range(len(p) - 49)}
    assert got.pop(0) == p
    for i, t in twice:
        mine = [t[k : k + 50] for k in range(len(t) - 49)]
        gone = {k + j for k, x in enumerate(mine) if x in seen for j in range(50)}
        assert got[i] == "".join(x for k, x in enumerate(t) if k not in gone)
        seen |= set(mine)


def test_window_dedup(docs, empty):
    got = {r.doc_id: r._s for r in substring_cm.drop_repeated_windows(docs).collect()}
    assert substring_cm.drop_repeated_windows(empty).count() == 0
    seen = set()
    for i, t in known(docs):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].text, got[i].n_removed) == (kept, sum(gone))


def test_quality_counts(docs, empty):
    assert quality.judge(empty).count() == 0
    for r in quality.judge(docs).collect():
        w = words(r.text)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = Counter(x for x in (r.text or "").split("\n") if words(x))
        assert (r._q.n_words, r._q.n_repeat_words, r._q.n_dup_lines) == (len(w), len(rep), sum(lines.values()) - len(lines))
        assert r._q.word_chars == sum(map(len, w)) and not (r._q.base_failed and r._q.kept)


def test_near_duplicates(docs, empty):
    assert prob_minhash.near_duplicates(empty).count() == 0
    got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in known(docs) if (w := words(t))}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {i: got[i] for i in sets} == root and all(got[i] == i for i, t in known(docs) if not words(t))
    assert prob_minhash.keep_one(docs).count() == len(set(root.values())) + 3 + 1


def test_band_nomination_ignores_counts():
    import pyarrow as pa

    once = " ".join("w%d" % i for i in range(40))
    often = " ".join([once, *[" ".join(once.split()[:14])] * 500])
    again = " ".join([once, *[" ".join(once.split()[:14])] * 2])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": [often, again]})
    (out,) = prob_minhash._sketch(iter([batch]))
    assert out.column("size").to_pylist()[0] == out.column("size").to_pylist()[1]
    a, b = out.column("bands").to_pylist()
    assert a == b  # equal shingle sets share every band


def test_katz(spark, docs, empty):
    assert katz.train_and_score(empty).count() == 0
    got = {r.doc_id: r for r in katz.train_and_score(docs).collect()}
    count = Counter(x for _, t in known(docs) for x in [*words((t or "").lower()), None]) + Counter(["null", "id", "text", None])
    n, v = sum(count.values()), len(count)
    for i, t in known(docs):
        tokens = [*words((t or "").lower()), None]
        assert got[i].n_tokens == got[i].n_known == len(tokens) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in tokens), rel=1e-6)
        assert got[i].score < 0
    uni = katz.Unigram(100, 3, {1: 2, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0})
    assert uni.p(np.array([1, 1, 2, 96])).sum() + uni.unseen * uni.unseen_types == pytest.approx(1)


def test_transducer(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in sp_wfst.encode(docs, sp_wfst.load(MODEL), decode=True).collect():
        assert list(r._e.ids) == lib.encode(r.text or "") and r._e.decoded == (r.text or "")


def test_cover_tree(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 6))
    x = [(i, [float(v) for v in base[i % 12] + rng.standard_normal(6) * 0.1], i % 3 if i % 7 else None) for i in range(150)]
    odd = [(900, None, 1), (901, [0.0] * 6, 1), (902, [float("nan")] * 6, 1), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, x[1][1], 1), (907, x[1][1], 1)]
    df = spark.createDataFrame([*x, *odd], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in cover_tree.link_vectors(df).collect()}
    rows = {r.vec_id: (np.array(r.embedding, float), r.label) for r in df.collect() if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    assert got == {i: sum(j != i and rows[j][1] == rows[i][1] and bool(cos(rows[i][0], rows[j][0])) for j in rows) if i in rows else 0 for i in got}


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 1)) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.with_rates(docs, labels).selectExpr("doc_id", "_m.*").collect()
    total = sum(r.tokens for r in out)
    assert len(out) == docs.count() and all(r.rate >= 0 for r in out)
    assert sum(r.tokens * r.rate for r in out) == pytest.approx(total, rel=1e-3)
    assert sum(r.tokens * r.rate * r.toxic for r in out) <= 0.011 * total
    assert mixing.mix(empty, labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == docs.count()


def test_toxicity(spark, docs):
    rng = np.random.default_rng(4)
    vocab = ["w%d" % i for i in range(300)]
    y = rng.random(400) < 0.3
    texts = [" ".join([*rng.choice(vocab, 30), *(["nastyword"] if t else []), *rng.choice(vocab, 30)]) for t in y]
    known = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string")
    net = toxicity.train(known, spark.createDataFrame([(i, int(t)) for i, t in enumerate(y[:300])], "doc_id long, toxic int"))
    df = spark.createDataFrame(list(enumerate(texts[300:])), "doc_id long, text string")
    got = {r.doc_id: r._score for r in toxicity.with_score(df, net).collect()}
    assert np.mean([(got[i] >= 0.5) == t for i, t in enumerate(y[300:])]) > 0.95
    assert all(0 <= r._score <= 1 for r in toxicity.with_score(docs, net).collect())
    assert toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) == 0.0


def test_digest_is_of_bytes():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
