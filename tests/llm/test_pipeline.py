"""Every stage of the pipeline on what the stage before kept, against plain versions."""

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("parley.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from parley.llm import mixing, quality  # noqa: E402


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    vocab = ["word%d" % i for i in range(500)]
    good = [" ".join(rng.choice(vocab, n)) for n in rng.integers(30, 90, 60)]
    shared = " ".join(rng.choice(vocab, 55))
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100, good[2]), (101, good[3] + " end"), (102, shared + " " + good[4][:150]), (103, good[5][:90] + " " + shared), (104, "short"), (105, None), (106, "# " * 60 + good[6]), (107, "nastyword " * 3 + good[7][::-1])]
    where = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "web", len(t or ""), "_s") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int, _s string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i == 107)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, place):
    import sentencepiece

    docs = spark.read.parquet(f"{place}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, seen[-1], place)
        out.write.parquet(f"{place}/out{k}")
        seen.append(spark.read.parquet(f"{place}/out{k}"))
        if k < 4:
            assert out.columns == docs.columns
    start, clean, single, cut, mixed, encoded = ([r for r in x.collect()] for x in seen)

    verdict = {r.doc_id: r[-1].kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in clean} == {i for i, k in verdict.items() if k} and not {104, 105, 106} & {r.doc_id for r in clean}

    sets = {r.doc_id: {tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))} for r in clean if (w := words(r.text))}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted([root[a], root[b]])
                root = {i: x if v == y else v for i, v in root.items()}
    assert sorted(r.doc_id for r in single) == sorted({x for x in root.values()}) and root[100] == 2 and root[101] == 3

    earlier, want = set(), {}
    for r in sorted(single, key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in earlier:
                gone[s : s + 20] = [True] * 20
            earlier.add(key)
        left = " ".join(x for x, g in zip(w, gone) if not g)
        if left:
            want[r.doc_id] = left if any(gone) else r.text
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    assert len(words(want[103])) < len(words(dict((r.doc_id, r.text) for r in start)[103]))

    rates = {r.doc_id: r[-1].copies for r in mixing.with_rates(seen[3], spark.read.parquet(f"{place}/labels.parquet")).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in rates.items() if n})

    lib = sentencepiece.SentencePieceProcessor(model_file=pipeline.MODEL)
    by_id = {r.doc_id: r.text for r in mixed}
    assert len(encoded) == len(mixed) and all(list(r.ids) == lib.encode(by_id[r.doc_id]) and r.n_ids == len(r.ids) for r in encoded)


def test_run_restores_the_session(spark, place):
    before = spark.conf.get(pipeline.BATCH_SETTING)
    assert pipeline.run(spark, place).count() > 0 and spark.conf.get(pipeline.BATCH_SETTING) == before
