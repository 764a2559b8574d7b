"""Toxicity scores from a bidirectional gated recurrent network (operator 9).

A word enters as its own vector (if frequent enough in the sample) joined with the
mean vector of its character trigrams, so inflected and misspelt words still speak.
Two gated recurrent passes read windows of SPAN words, attention pools them, and a
document's score is that of its worst window; windows overlap by half and cover
every word of every text.

Training is numpy on the driver, on windows of at most SAMPLE labelled rows (the first by a
hash of doc_id), whose texts are read whole in tasks: one pass counts texts of both kinds by
word, one draws windows from all of each text, at most DRAWN a text (those with the words
most typical of toxic texts, and some by a hash). Windows of toxic texts that hold such words
are positive, windows of other texts negative. Windows of more than WINDOW_BYTES (words
without end) are scored but not drawn. A last logistic step calibrates the document scores
of the whole sample, which tasks compute. Scoring needs only the weights (under 1 MB),
which are broadcast.

Cases: null and empty texts are one window of padding and get a score; labels that
are null are not learned from; without labels of both kinds every score is the share
of positives seen (0 if none); extra columns pass through; repeated rows are scored alike;
a label counts for every row of its doc_id until SAMPLE rows are taken. The score is the last
column, ``_score`` or, where that name is taken, ``_score`` with underscores appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import free_name, materialize, row_slices, text_bytes

SAMPLE, SPAN, STRIDE = 3000, 24, 12
#: Windows of a text for fitting, how many of them are the most typical ones, and their bytes.
DRAWN, TYPICAL, WINDOW_BYTES = 32, 8, 1 << 14
#: Words whose odds tell which windows are typical of toxic texts.
TELLING = 1 << 14
WORDS, GRAMS, EMBED, HIDDEN, ATTEND = 4096, 1 << 12, 8, 8, 8
STEPS, BATCH, RATE = 260, 256, 0.01
#: Clean documents should be left alone.
FALSE_ALARM = 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Text:
    """The words of a slice: distinct ones, their trigram buckets, and windows over them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        data = tk.LOWER[data]
        starts, ends, self.rows = tk.words(data, offs)
        self.data, self.starts, self.ends = data, starts, ends
        self.n = len(offs) - 1
        keys = tk.span_hash(data, starts, ends)
        self.keys, rep, self.word = np.unique(keys, return_index=True, return_inverse=True)
        s, size = starts[rep], ends[rep] - starts[rep]
        # trigrams of the word between two boundary marks
        size2 = size + 2
        cut = np.cumsum(size2) - size2
        flat = np.zeros(int(size2.sum()) + 2, np.int64)
        inside = np.ones(int(size2.sum()), bool)
        inside[cut] = inside[cut + size2 - 1] = False
        flat[:-2][inside] = data[np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        code = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        gram = (tk.mix(code.astype(tk.U)) >> tk.U(52)).astype(np.int32)
        ok = np.ones(len(code), bool)
        ok[cut + size2 - 1] = ok[cut + size2 - 2] = False
        self.grams, self.gram_n = gram[ok], size
        self.gram_at = np.cumsum(size) - size
        # windows: every STRIDE words, the last one flush with the end
        count = tk.word_counts(self.rows, self.n)
        n_win = np.where(count <= SPAN, 1, 1 + -(-(count - SPAN) // STRIDE))
        self.win_row = np.repeat(np.arange(self.n), n_win)
        k = np.arange(len(self.win_row)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        first = np.minimum(k * STRIDE, np.maximum(0, count - SPAN)[self.win_row])
        at = first[:, None] + np.arange(SPAN)[None, :]
        self.mask = at < count[self.win_row][:, None]
        base = (np.cumsum(count) - count)[self.win_row]
        self.win_first, self.win_words = base + first, np.minimum(count[self.win_row], SPAN)
        word = np.append(self.word, len(self.keys))
        self.windows = np.where(self.mask, word[np.minimum(base[:, None] + at, len(self.word))], len(self.keys))


class Network:
    def __init__(self, vocab: np.ndarray) -> None:
        g = np.random.default_rng(7)
        d, h = 2 * EMBED, HIDDEN
        f = lambda *s, by: (g.standard_normal(s) * by).astype(np.float32)
        self.vocab = vocab
        self.p = {"word": f(len(vocab) + 1, EMBED, by=0.3), "gram": f(GRAMS, EMBED, by=0.3), "att": f(2 * h, ATTEND, by=0.3), "att_b": np.zeros(ATTEND, np.float32), "att_v": f(ATTEND, by=0.3), "out": f(2 * h, by=0.3), "out_b": np.full(1, -1, np.float32)}
        for way in "fb":
            self.p |= {f"in_{way}": f(d, 3 * h, by=0.3), f"bias_{way}": np.zeros(3 * h, np.float32), f"rec_{way}": f(h, 3 * h, by=0.3)}
        self.p["word"][0] = 0
        self.scale = (1.0, 0.0)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, keys), len(self.vocab) - 1)
        return np.where(self.vocab[at] == keys, at + 1, 0)

    def inputs(self, t: Text) -> np.ndarray:
        """A row for each distinct word and one of zeros for padding."""
        chars = np.zeros((len(t.keys), EMBED), np.float32)
        if len(t.grams):
            chars = np.add.reduceat(self.p["gram"][t.grams], t.gram_at, axis=0) / t.gram_n[:, None]
        x = np.concatenate([self.p["word"][self.ids(t.keys)], chars], axis=1)
        return np.concatenate([x, np.zeros((1, 2 * EMBED), np.float32)]).astype(np.float32)

    def _pass(self, way: str, proj: np.ndarray, win: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
        h = HIDDEN
        rec = self.p[f"rec_{way}"]
        state = np.zeros((len(win), h), np.float32)
        out = np.empty((SPAN, len(win), h), np.float32)
        for t in range(SPAN) if way == "f" else range(SPAN - 1, -1, -1):
            a = proj[win[:, t]]
            r_all = state @ rec
            zr = sigmoid(a[:, : 2 * h] + r_all[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(a[:, 2 * h :] + r * r_all[:, 2 * h :])
            new = np.where(mask[:, t, None], cand + z * (state - cand), state)
            if tape is not None:
                tape.append((t, state, z, r, cand, r_all[:, 2 * h :]))
            state = out[t] = new
        return out

    def forward(self, x: np.ndarray, win: np.ndarray, mask: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        both = []
        for way in "fb":
            tape = None if tapes is None else tapes.setdefault(way, [])
            both.append(self._pass(way, x @ self.p[f"in_{way}"] + self.p[f"bias_{way}"], win, mask, tape))
        states = np.concatenate(both, axis=2)
        u = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = np.where(mask.T, u @ self.p["att_v"], -1e9)
        w = np.exp(e - e.max(axis=0)) * mask.T
        w = w / np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", w, states)
        if tapes is not None:
            tapes |= {"states": states, "u": u, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def backward(self, t: Text, x: np.ndarray, win: np.ndarray, mask: np.ndarray, tapes: dict, d: np.ndarray) -> dict:
        p, h, g = self.p, HIDDEN, {}
        states, u, w = tapes["states"], tapes["u"], tapes["w"]
        g["out"], g["out_b"] = tapes["pooled"].T @ d, d.sum(keepdims=True)
        d_pool = d[:, None] * p["out"]
        d_states = w[:, :, None] * d_pool
        d_w = (states * d_pool).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["att_v"] = np.einsum("tb,tba->a", d_e, u)
        d_u = d_e[:, :, None] * p["att_v"] * (1 - u * u)
        g["att"], g["att_b"] = np.einsum("tbh,tba->ha", states, d_u), d_u.sum(axis=(0, 1))
        d_states = d_states + d_u @ p["att"].T
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            rec, d_rec = p[f"rec_{way}"], np.zeros_like(p[f"rec_{way}"])
            d_proj = np.zeros((len(x), 3 * h), np.float32)
            carry = np.zeros((len(win), h), np.float32)
            for at, before, z, r, cand, r_n in reversed(tapes[way]):
                m = mask[:, at, None]
                total = carry + d_states[at][:, k * h : (k + 1) * h]
                d_new = total * m
                d_cand = d_new * (1 - z) * (1 - cand * cand)
                d_z = d_new * (before - cand) * z * (1 - z)
                d_r = d_cand * r_n * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_cand], axis=1)
                d_all = np.concatenate([d_z, d_r, d_cand * r], axis=1)
                carry = total * ~m + d_new * z + d_all @ rec.T
                d_rec += before.T @ d_all
                np.add.at(d_proj, win[:, at], d_in)
            d_proj[-1] = 0
            g[f"rec_{way}"], g[f"in_{way}"], g[f"bias_{way}"] = d_rec, x.T @ d_proj, d_proj.sum(axis=0)
            d_x += d_proj @ p[f"in_{way}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], self.ids(t.keys), d_x[:-1, :EMBED])
        g["word"][0] = 0
        if len(t.grams):
            np.add.at(g["gram"], t.grams, np.repeat(d_x[:-1, EMBED:] / t.gram_n[:, None], t.gram_n, axis=0))
        return g

    def logits(self, t: Text) -> np.ndarray:
        """The worst window's logit of each row."""
        x = self.inputs(t)
        parts = [self.forward(x, t.windows[a : a + 2048], t.mask[a : a + 2048]) for a in range(0, len(t.windows), 2048)]
        out = np.full(t.n, -np.inf)
        np.maximum.at(out, t.win_row, np.concatenate(parts))
        return out

    def score(self, t: Text) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(t) + self.scale[1])


def fit(vocab: np.ndarray, texts: list[str], toxic: np.ndarray, typical: np.ndarray, best: np.ndarray) -> Network:
    """Train on drawn windows: the kind of their text, their most typical word's odds, and those of the text's best window."""
    data, offs = text_bytes(pa.array(texts, pa.string()))
    t = Text(data, offs)
    net = Network(vocab)
    positive = np.flatnonzero(toxic & (typical >= np.maximum(0.7 * best, 1)))
    if not len(positive):
        positive = np.flatnonzero(toxic)
    negative = np.flatnonzero(~toxic)
    hard = negative[np.argsort(-typical[negative], kind="stable")[: max(256, len(negative) // 10)]]
    rng = np.random.default_rng(3)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(positive, BATCH // 4), rng.choice(hard, BATCH // 4), rng.choice(negative, BATCH // 2)])
        label = np.arange(BATCH) < BATCH // 4
        win, mask = t.windows[pick], t.mask[pick]
        used, inverse = np.unique(np.append(win, len(t.keys)), return_inverse=True)
        sub = _subset(t, used[:-1])
        x, tapes = net.inputs(sub), {}
        local = inverse[:-1].reshape(win.shape)
        logit = net.forward(x, local, mask, tapes)
        g = net.backward(sub, x, local, mask, tapes, ((sigmoid(logit) - label) / BATCH).astype(np.float32))
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for k, d in g.items():
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def calibrate(net: Network, logits: np.ndarray, toxic: np.ndarray) -> None:
    """Platt scaling of document logits, then the cut with the fewest errors as a score of one half."""
    a, b = 1.0, 0.0
    for _ in range(400):
        s = sigmoid(a * logits + b)
        a, b = a - 0.5 * float(((s - toxic) * logits).mean() / max(1e-6, (logits**2).mean())), b - 0.5 * float((s - toxic).mean())
    net.scale = (max(a, 0.3), -max(a, 0.3) * _best_cut(logits, toxic))


def _best_cut(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The cut that costs least on the sample, a false alarm as much as FALSE_ALARM misses; midway between neighbours."""
    order = np.argsort(logits, kind="stable")
    clean = FALSE_ALARM * (~toxic).sum()
    errors = np.concatenate([[clean], clean + np.cumsum(np.where(toxic[order], 1, -FALSE_ALARM))])
    k = int(errors.argmin())
    x = logits[order]
    return float((x[max(0, k - 1)] + x[min(k, len(x) - 1)]) / 2)


def _subset(t: Text, words: np.ndarray) -> Text:
    """The same words as their own little vocabulary."""
    out = object.__new__(Text)
    out.keys, out.gram_n = t.keys[words], t.gram_n[words]
    out.gram_at = np.cumsum(out.gram_n) - out.gram_n
    out.grams = t.grams[np.repeat(t.gram_at[words] - out.gram_at, out.gram_n) + np.arange(out.gram_n.sum())]
    return out


def _texts(text: pa.Array) -> Iterator[tuple[int, int, Text]]:
    data, offs = text_bytes(text)
    for a, b in row_slices(offs):
        yield a, b, Text(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each kind that hold a word."""
    for batch in batches:
        toxic = batch.column(1).to_numpy() == 1
        for a, b, t in _texts(batch.column(2)):
            pair = np.unique(t.rows * max(1, len(t.keys)) + t.word)
            row, word = pair // max(1, len(t.keys)), pair % max(1, len(t.keys))
            n = [np.bincount(word[toxic[a:b][row] == kind], minlength=len(t.keys)) for kind in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(t.keys.view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["word", "n0", "n1"])


def draw(t: Text, ids: np.ndarray, toxic: np.ndarray, words: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to fit on, their odds and those of their text's best window. Texts are drawn from end to end."""
    at = np.minimum(np.searchsorted(words, t.keys), max(0, len(words) - 1))
    known = words[at] == t.keys if len(words) else np.zeros(len(t.keys), bool)
    typical = np.append(np.where(known, odds[at] if len(odds) else 0.0, 0.0), -9)[t.windows].max(axis=1)
    best = np.full(t.n, -np.inf)
    np.maximum.at(best, t.win_row, typical)
    size = np.zeros(len(t.win_row), np.int64)
    some = t.win_words > 0
    size[some] = t.ends[t.win_first[some] + t.win_words[some] - 1] - t.starts[t.win_first[some]]
    fits = np.flatnonzero(some & (size <= WINDOW_BYTES))
    row = t.win_row[fits]
    chance = tk.mix(ids[row].astype(tk.U) * tk.U(0x9E3779B97F4A7C15) + t.win_first[fits].astype(tk.U)) >> tk.U(1)
    by_odds, by_chance = np.lexsort((~chance, -typical[fits], row)), np.lexsort((chance, row))
    rank = np.zeros((2, len(fits)), np.int64)
    for r, order in zip(rank, (by_odds, by_chance)):
        r[order] = np.arange(len(fits)) - np.searchsorted(row[order], row[order])
    most = np.where(toxic[row], DRAWN, TYPICAL)
    keep = fits[(rank[0] < most) | (rank[1] < DRAWN - most)]
    return keep, typical[keep], best[t.win_row[keep]]


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) joined with their texts; with one
    kind of label only, the share of positives."""
    spark = docs.sparkSession
    pick = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    sample = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), "text")
    sample = materialize(sample, "toxic-sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return float(n1 > 0)
    counts = sample.mapInArrow(_count_words, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    counts = materialize(counts.select("word", (F.col("n0") + F.col("n1")).alias("n"), odds.alias("odds")), "toxic-words")
    often = counts.orderBy(F.desc("n"), "word").limit(WORDS // 2).select("word").toArrow().column(0).to_numpy()
    telling = counts.where("n >= 3").orderBy(F.desc(F.abs("odds")), "word").limit(TELLING).toArrow()
    words, value = telling.column("word").to_numpy().view(tk.U), telling.column("odds").to_numpy()
    vocab = np.union1d(often.view(tk.U), words[: WORDS // 2])
    order = np.argsort(words)
    shared = spark.sparkContext.broadcast((words[order], value[order]))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, t in _texts(batch.column(2)):
                keep, typical, best = draw(t, ids[a:b], toxic[a:b] == 1, *shared.value)
                text = [t.data[t.starts[i] : t.ends[i + k - 1]].tobytes().decode("utf-8", "replace") for i, k in zip(t.win_first[keep].tolist(), t.win_words[keep].tolist())]
                cols = [ids[a:b][t.win_row[keep]], toxic[a:b][t.win_row[keep]], typical, best]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(text, pa.string())], ["doc_id", "toxic", "typical", "best", "text"])

    drawn = sample.mapInArrow(windows, "doc_id long, toxic int, typical double, best double, text string")
    # rows of one doc_id can be more than the sample asked for
    drawn = drawn.orderBy("doc_id", "toxic", F.xxhash64("text")).limit(SAMPLE * DRAWN).toArrow()
    toxic = drawn.column("toxic").to_numpy() == 1
    if toxic.all() or not toxic.any():
        return n1 / (n0 + n1)
    net = fit(vocab, drawn.column("text").to_pylist(), toxic, drawn.column("typical").to_numpy(), drawn.column("best").to_numpy())
    shared_net = spark.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shared_net.value.logits(t) for _, _, t in _texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *each]))], ["doc_id", "toxic", "logit"])

    got = sample.mapInArrow(logits, "doc_id long, toxic int, logit double").orderBy("doc_id", "toxic", "logit").limit(SAMPLE).toArrow()
    calibrate(net, got.column("logit").to_numpy(), got.column("toxic").to_numpy() == 1)
    return net


def with_score(docs: DataFrame, net: Network | float) -> DataFrame:
    """``docs`` plus a last column, the score: a double in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(text: pa.Array) -> pa.Array:
        net = shared.value
        if isinstance(net, float):
            return pa.array(np.full(len(text), net))
        return pa.array(np.concatenate([np.zeros(0), *(net.score(t) for _, _, t in _texts(text))]))

    return docs.withColumn(free_name(docs.columns, "_score"), F.arrow_udf(run, "double")(F.col("text")))
