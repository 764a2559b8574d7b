"""Importance resampling against a dictionary version, and its table against the libraries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("parley.llm")

from parley.llm import importance as im  # noqa: E402

KIND = "doc_id long, text string, _i string, _part int, _copy int, _before int, bucket int, rank int"


def plain_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def features(t, order):
    w = plain_words(t)
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, order=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, order))
    t = Counter(bucket(f) for x in target for f in features(x, order))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * s_all / ((s[k] + 1) * t_all))) for k in s}
    out = []
    for i, text in docs:
        fs = features(text, order)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(pool[: len(pool) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(out):
    name = out.columns[-1]
    return sorted(((r.doc_id, r[name].n_features, r[name].weight, r[name].score, r[name]["rank"]) for r in out.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    vocab = ["w%d" % i for i in range(200)] + ["Über", "日本", "A" * 70, "x-y", "b" * 40]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 90)))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (None, docs[5][1]), (None, None), (500, None), (501, ""), (502, "\n -- ! "), (503, "z" * 100_000), (504, "long " * 30_000)]
    docs += [(600 + i, docs[7][1] + " the common line of many texts") for i in range(60)]
    target = [" ".join(rng.choice(vocab[:40], 60)) for _ in range(5)] + [None, ""]
    return docs, target


@pytest.mark.parametrize("order", [1, 2])
def test_all_rows_like_a_dictionary(spark, corpus, order):
    docs, target = corpus
    df = spark.createDataFrame([(i, t, "a", 1, 2, 3, 4, 5) for i, t in docs], KIND).repartition(3)
    out = im.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), order=order)
    assert out.columns[:-1] == df.columns and out.columns[-1] == "_i_"
    assert rows_of(out) == brute(docs, target, order)
    assert all(r["_part"] == 1 and r["rank"] == 5 and r["_i"] == "a" for r in out.collect())


def test_ties_and_shares(spark):
    docs = [(i // 2, "a b c d e f g h i j k l m n o p q r s t") for i in range(50)]
    out = im.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=50)
    got = rows_of(out)
    assert got == brute(docs, ["a"], percent=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 26))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert im.resample(none, none.select("text")).count() == 0
    docs = [(1, "one two"), (2, None)]
    assert rows_of(im.resample(spark.createDataFrame(docs, "doc_id long, text string"), none.select("text"))) == brute(docs, [])


def spans(items):
    data = np.frombuffer(b"".join(items), np.uint8)
    end = np.cumsum([len(x) for x in items])
    return data, end - [len(x) for x in items], end


def test_hashes_are_those_of_the_libraries():
    rng = np.random.default_rng(1)
    items = [rng.bytes(n) for n in [*range(70), 200, 5000]]
    assert im.xxhash64(*spans(items)).tolist() == [xxhash.xxh64_intdigest(x) for x in items]
    assert im.crc32(*spans(items)).tolist() == [zlib.crc32(x) for x in items]


def test_equal_keys_are_told_apart_by_their_bytes():
    items = [b"alpha", b"beta", b"alpha", b"alphb", b"gamma-gamma-1", b"gamma-gamma-2", b"beta", b"", b"", b"gamma-gamma-1"] * 3
    for keys in (np.zeros(len(items), np.uint64), np.full(len(items), 2**64 - 1, np.uint64), None):
        t = im.intern(*spans(items), keys=keys)
        assert len(np.unique(t.slot)) == len(set(items))
        assert [int(t.count[s]) for s in t.slot] == [items.count(x) for x in items]
        assert [int(t.bucket[s]) for s in t.slot] == [zlib.crc32(x) % im.BUCKETS for x in items]
