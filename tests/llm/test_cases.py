"""The odd cases all operators must survive, on one shared table: repeated and null ids,
clashing column names, empty tables, and texts built to deceive weak hashes."""

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("parley.llm")

from parley.llm import cover_tree, katz, mixing, prob_minhash, quality, shard_kd, sp_wfst, substring_cm, suffix_index, toxicity  # noqa: E402
from parley.llm import textkernel as tk  # noqa: E402

CLASHING = ("_s", "_q", "_b", "_f", "_m", "_k", "_e", "_score", "_lang", "_source", "_fence", "_copy", "_digest", "_whole", "size", "label", "block", "tag")
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def thue_morse():
    """A word over a and b, and its complement: no polynomial hash modulo 2**64 tells them apart."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocab = ["v%d" % i for i in range(300)]
    body = [" ".join(rng.choice(vocab, n)) for n in rng.integers(20, 80, 12)]
    a, b = thue_morse()
    out = [(i, t) for i, t in enumerate(body)]
    out += [(3, body[3]), (3, body[4] + " tail"), (3, body[3] + " " + body[5]), (4, body[3])]  # repeated ids, with the same text and others
    out += [(None, body[3]), (None, body[3]), (None, None), (20, None), (20, ""), (21, " \n\t"), (22, a + " " + body[0]), (23, b + " " + body[0]), (24, a + "\n" + b), (25, "x" * 20000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, [None, "", "en"][k % 3], [None, "s"][k % 2], 7, *[c for c in CLASHING]) for k, (i, t) in enumerate(rows)], KIND)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 1)) for i in range(12)] + [(3, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def untouched(out, docs, without=()):
    """All other columns pass through under their names, and the result is one more, the last."""
    want = [c for c in docs.columns if c not in without]
    assert out.columns[: len(want)] == want and out.columns[-1] not in docs.columns
    assert all(r[c] == c for r in out.collect() for c in CLASHING)
    return [(r.doc_id, r["text"] if "text" in out.columns else None, r[out.columns[-1]]) for r in out.collect()]


def test_hash_tells_built_words_apart(rows):
    a, b = thue_morse()
    data = np.frombuffer((a + b).encode(), np.uint8)
    x, y = tk.span_hash(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert x != y
    long = np.frombuffer(b"ab" * 5000 + b"ab" * 5000, np.uint8)
    x, y = tk.span_hash(long, np.array([0, 10000]), np.array([10000, 20000]))
    assert x == y


def test_bytes(docs, rows):
    got = untouched(suffix_index.drop_repeated_bytes(docs), docs, ("text",))
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            smaller = [(u or "").encode() for j, u in rows if j is not None and j < i]
            seen = {u[k : k + 50] for u in smaller for k in range(len(u) - 49)}
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    gone[k : k + 50] = [True] * 50
        want.append((i, bytes(x for x, g in zip(b, gone) if not g)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((i, bytes(s.kept)) for i, _, s in got), key=key) == sorted(want, key=key)


def test_windows(docs, rows):
    got = untouched(substring_cm.drop_repeated_windows(docs), docs, ("text",))
    want = []
    for i, t in rows:
        w, own = words(t), set()
        gone = [False] * len(w)
        smaller = {tuple(u[k : k + 20]) for j, x in rows if i is not None and j is not None and j < i for u in [words(x)] for k in range(len(u) - 19)}
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if i is not None and (key in smaller or key in own):
                gone[k : k + 20] = [True] * 20
            own.add(key)
        want.append((i, " ".join(x for x, g in zip(w, gone) if not g)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((i, s.text) for i, _, s in got), key=key) == sorted(want, key=key)


def test_quality(docs, rows):
    got = untouched(quality.judge(docs), docs)
    for _, t, q in got:
        w = words(t)
        lines = Counter(x for x in (t or "").split("\n") if words(x))
        assert (q.n_words, q.word_chars, q.n_dup_lines) == (len(w), sum(map(len, w)), sum(lines.values()) - len(lines))
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(q.kept for *_, q in got)


def test_thresholds_follow_the_group(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    text = lambda size, marks: " ".join([word(size) for _ in range(60)] + ["#" * marks])
    plain = [("plain", text(int(rng.integers(4, 6)), 0)) for _ in range(120)]
    code = [("code", text(int(rng.integers(9, 15)), int(rng.integers(20, 60)))) for _ in range(120)]
    df = spark.createDataFrame([(i, "en", s, t) for i, (s, t) in enumerate([*plain, *code, ("plain", text(12, 40)), ("code", text(12, 40))])], "doc_id long, lang string, source string, text string")
    q = quality.with_measures(df, "_q")
    fences = {r.source: r for r in quality.thresholds(quality.sketches(q, "_q")).collect()}
    for m in quality.MEASURES:
        if m not in ("dup_lines", "repeats"):
            assert fences["=code"][f"hi_{m}"] > fences["=plain"][f"hi_{m}"]
    got = {r.doc_id: r[r.__fields__[-1]].kept for r in quality.judge(df).collect()}
    assert not got[240] and got[241] and sum(got.values()) > 230  # the same text is junk in one source only


def jaccard_classes(texts):
    sets = {k: {tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))} for k, t in texts.items() if (w := words(t))}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted([root[a], root[b]])
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_near_duplicates(docs, rows):
    distinct = {(i, t or ""): t for i, t in rows if i is not None}
    root = jaccard_classes(distinct)
    want = sorted([(i, root.get((i, t or ""), (i, 0))[0]) for i, t in rows if i is not None])
    got = prob_minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None and r.class_id is None and r.kept for r in got) == 3
    one = prob_minhash.keep_one(docs)
    assert one.columns == docs.columns
    left = Counter((r.doc_id, r.text or "") for r in one.collect() if r.doc_id is not None)
    assert set(left) == {k for k in distinct if root.get(k, k) == k} and max(left.values()) == 1


def test_rare_centres_do_not_end_the_search(spark):
    """A bucket {1, 2, 3} where only 2 and 3 are alike: 1 is the centre twice."""
    rng = np.random.default_rng(3)
    one, two = (" ".join("u%d" % x for x in rng.integers(0, 10**6, 100)) for _ in range(2))
    df = spark.createDataFrame([(1, one), (2, two), (3, two + " more")], "doc_id long, text string")
    sets = df.mapInArrow(prob_minhash._sets, "doc_id long, n int, blob binary")
    bands = spark.createDataFrame([(i, 0, 5) for i in (1, 2, 3)], "doc_id long, band int, hash long")
    label = prob_minhash._linked(spark, bands, sets)
    assert {r.node: r.component for r in label.collect()} == {2: 2, 3: 2}


def test_labels_of_turns_are_those_of_all_links(spark):
    rng = np.random.default_rng(5)
    links = rng.integers(0, 60, (45, 2)).tolist() + [[0, n] for n in range(70, 90)]
    name = {n: n for pair in links for n in pair}
    for a, b in links:  # every link renames one whole class
        low, high = sorted((name[a], name[b]))
        name = {n: low if c == high else c for n, c in name.items()}
    label = None
    for part in (links[:20], links[20:40], links[40:]):
        label = prob_minhash._merged(label, spark.createDataFrame(part, "a long, b long"))
    got = {r.node: r.component for r in label.collect()}
    assert {n: got.get(n, n) for n in name} == name


def test_words_and_scores(docs, rows):
    got = sorted(katz.train_and_score(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score))
    assert len(got) == len(rows)
    tokens = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    count = Counter(x for _, t in rows for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i is None, i or 0, len(tokens(t)), sum(np.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t in rows))
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.base_score, 3)) for r in got)
    assert [x[:3] for x in mine] == [x[:3] for x in want] and np.allclose(sorted(x[3] for x in mine), sorted(x[3] for x in want), atol=2e-3)
    assert all(r.train_tokens == n for r in got)


def test_encoding(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _, t, e in untouched(sp_wfst.encode(docs, sp_wfst.load(MODEL), decode=True), docs):
        assert list(e.ids) == lib.encode(t or "") and e.decoded == (t or "")


def test_mixing(docs, labels, rows):
    got = untouched(mixing.with_rates(docs, labels), docs)
    assert len(got) == len(rows) and all(m.rate >= 0 for *_, m in got)
    assert mixing.mix(docs, labels).columns == docs.columns


def test_toxicity(spark, docs, labels, rows):
    got = untouched(toxicity.with_score(docs, toxicity.train(docs, labels)), docs)
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert toxicity.with_score(docs.limit(0), 0.5).count() == 0
    long = spark.createDataFrame([(0, "w " * 200_000), (1, "short")], "doc_id long, text string")
    assert toxicity.train(long, spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")) == 0.0


def test_sharding(docs, rows):
    out = shard_kd.shard(docs, 4).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len((t or "").encode()) + 8) for i, t in rows)


def test_slots_of_rows_without_an_id(spark, monkeypatch):
    """They are numbered in many chunks, not in one of each shard; copies and one huge text among them."""
    monkeypatch.setattr(shard_kd, "CHUNK_ROWS", 10)
    docs = spark.createDataFrame([(None, "copy", None, None)] * 300 + [(None, f"own {i}", "en", "s") for i in range(100)] + [(1, "x" * 50_000, None, "s")], "doc_id long, text string, lang string, source string")
    out = shard_kd.shard(docs, 4).collect()
    assert len(out) == 401
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_vectors_under_one_id(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, "p"), (1, y, "p"), (2, x, "p"), (3, [0.0, 0.0, 1.0], "p"), (4, y, "p"), (5, y, "p"), (None, x, "p"), (6, x, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label string, rep string, weight int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in cover_tree.link_vectors(df).collect()))
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 2, 1, False), (5, 2, 1, False), (6, 0, 6, True)]
    assert cover_tree.link_vectors(df.limit(0)).count() == 0


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    model = sp_wfst.load(MODEL)
    assert sp_wfst.encode(none, model).count() == 0
    assert toxicity.with_score(none, toxicity.train(none, labels)).count() == 0
    assert mixing.with_rates(none, labels).count() == 0 and quality.judge(none).count() == 0
