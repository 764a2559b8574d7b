"""Mixing documents to target domain weights (operator 4).

Domains come from the labelled table: ``toxic``, else ``good`` or ``low`` by quality. A
softmax classifier over the SAMPLE_WORDS most widespread words, fitted on at most
SAMPLE labelled texts (the first by a hash of doc_id, each read whole), gives every document
a soft membership: posterior shares of its tokens. Nonnegative rates r then solve

    least squares over domains of  sum_d r_d * tokens_d * p_dk  =  target_k

and, of all such rates, are those nearest to 1 (each document weighed by its tokens).
They are found by projected gradient with lazy projection: the gradient for document d is
p_d . residual, so all steps together are one vector lambda with a number for each domain,
and a rate is 1 less the steps, projected onto what is not negative: max(0, 1 - p_d . lambda).
lambda is what the dual of the problem maximises, a concave function whose value, gradient
and curvature are sums over documents. A step is the gradient in the metric of the
documents whose rate is not 0 (a Newton step), of SIZES of which the best is taken; each is
one aggregation of a few numbers, and nothing is shuffled. To stay bounded where targets are
out of reach the residual weighs 1 / ridge, with RIDGES from large to small; it ends when
no step gains anything, at the least-squares optimum.

Rates become whole copies by a hash of doc_id, right in expectation.

Cases: null and empty texts have no tokens, rate by their posteriors and weigh
nothing; labels with nulls are not learned from; without two labelled domains every
document is ``good`` with rate 1; rows that share a doc_id and a rate get the same copies,
rows without a doc_id draw by their texts; an empty table gives an empty result; other
columns pass through. The struct that is added is the last column, ``_m`` or, where that
name is taken, ``_m`` with underscores appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import free_name, materialize, row_slices, text_bytes

DOMAINS = ("good", "low", "toxic")
SAMPLE, SAMPLE_WORDS = 4000, 4096
SIZES = (1.0, 0.5, 0.25, 0.0625, 2.0**-8, 2.0**-14)
RIDGES = (1e-2, 1e-4, 1e-6, 1e-8, 1e-10, 1e-12)
#: Most share of all tokens; a domain below its cap keeps its share, ``good`` takes the rest.
CAPS = {"low": 0.03, "toxic": 0.01}


def _rows_of(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: words of each row, then distinct (row, word hash) pairs."""
    data, offs = text_bytes(text)
    for a, b in row_slices(offs):
        d, o = tk.LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
        starts, ends, rows = tk.words(d, o)
        yield tk.word_counts(rows, b - a), rows, tk.span_hash(d, starts, ends)


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def _known(vocab: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, number in the sorted vocabulary) pairs, by row."""
    if not len(vocab) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, keys), len(vocab) - 1)
    hit = vocab[at] == keys
    return _distinct(rows[hit], at[hit])


class Classifier:
    """Softmax over the presence of known words."""

    def __init__(self, vocab: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.vocab, self.weights, self.bias = vocab, weights, bias

    def posteriors(self, n: int, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        z = np.tile(self.bias, (n, 1))
        r, f = _known(self.vocab, rows, keys)
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(r, weights=self.weights[f, k], minlength=n)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(vocab: np.ndarray, present: list[np.ndarray], domain: np.ndarray) -> Classifier:
    """From the numbers of the known words of each sampled document, and its domain number."""
    n, k = len(present), len(DOMAINS)
    if len(np.unique(domain)) < 2:
        return Classifier(np.zeros(0, tk.U), np.zeros((0, k)), np.array([40.0, 0, 0]))
    x = np.zeros((n, len(vocab)), np.float32)
    for row, words in enumerate(present):
        x[row, words] = 1
    y = np.eye(k, dtype=np.float32)[domain]
    w, b = np.zeros((x.shape[1], k), np.float32), np.log(y.mean(axis=0) + 1e-3)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 201):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - y) / n + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * (p - y).mean(axis=0)
    return Classifier(vocab, w.astype(np.float64), b.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Two passes over the sampled texts: one counts texts by word, one marks the words chosen."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    pick = labels.where("quality is not null and toxic is not null").select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(SAMPLE)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick), "doc_id")
    sample = materialize(sample.select("doc_id", "domain", "text"), "mix-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, keys in _rows_of(batch.column(2)):
                words, n = np.unique(_distinct(rows, keys)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    often = sample.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS)
    vocab = np.sort(often.select("word").toArrow().column(0).to_numpy().view(tk.U))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for n_words, rows, keys in _rows_of(batch.column(2)):
                rows, at = _known(shared.value, rows, keys)
                marks += [at[a:b].astype(np.uint16).tobytes() for a, b in zip(np.searchsorted(rows, np.arange(len(n_words))), np.searchsorted(rows, np.arange(1, len(n_words) + 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], ["doc_id", "domain", "words"])

    # at most 2 x SAMPLE_WORDS bytes a text reach the driver
    rows = sample.mapInArrow(mark, "doc_id long, domain int, words binary").orderBy("doc_id", "domain", F.xxhash64("words")).limit(SAMPLE).toArrow()
    present = [np.frombuffer(x, np.uint16) for x in rows.column("words").to_pylist()]
    return fit(vocab, present, rows.column("domain").to_numpy().astype(np.int64))


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` plus a last struct: tokens and one posterior for each domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        tokens, post = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
        for n_words, rows, keys in _rows_of(text):
            tokens.append(n_words)
            post.append(shared.value.posteriors(len(n_words), rows, keys))
        p = np.concatenate(post)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=["tokens", *DOMAINS])

    kind = "tokens long, " + ", ".join(f"{d} double" for d in DOMAINS)
    return docs.withColumn(free_name(docs.columns, "_m"), F.arrow_udf(run, kind)(F.col("text")))


def targets_for(mass: np.ndarray, caps: dict[str, float]) -> np.ndarray:
    """Target tokens for each domain from present ones."""
    total = mass.sum()
    t = np.array([min(m, caps[d] * total) if d in caps else m for d, m in zip(DOMAINS, mass)])
    free = [k for k, d in enumerate(DOMAINS) if d not in caps]
    t[free] += (total - t.sum()) / len(free)
    return t


def _sums(members: DataFrame, points: np.ndarray) -> np.ndarray:
    """For each point: half the squared rates, domain tokens, and the Gram matrix of documents
    whose rate is not 0, all weighed by tokens; one row a point."""
    k = len(DOMAINS)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), 1 + k + len(upper[0])))
        for batch in batches:
            t, *p = (batch.column(c).to_numpy().astype(np.float64) for c in ("tokens", *DOMAINS))
            p = np.stack(p, axis=1)
            for row, point in zip(total, points):
                r = np.maximum(0, 1 - p @ point)
                w = t * (r > 0)
                row[0] += t @ (r * r) / 2
                row[1 : 1 + k] += (t * r) @ p
                row[1 + k :] += ((p * w[:, None]).T @ p)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total.reshape(-1, 1)], [f"c{i}" for i in range(total.size)])

    names = [f"c{i}" for i in range(len(points) * (1 + k + len(upper[0])))]
    row = members.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
    return np.array([x or 0.0 for x in row]).reshape(len(points), -1)


def solve(members: DataFrame, caps: dict[str, float] | None = None, tolerance: float = 1e-7) -> np.ndarray:
    """lambda over a table with the struct ``_m``: one number for each domain."""
    members = materialize(members.where("_m.tokens > 0").select("_m.tokens", *(f"_m.{d}" for d in DOMAINS)), "mix")
    k = len(DOMAINS)
    upper = np.triu_indices(k)
    point = np.zeros(k)
    here = _sums(members, point[None])[0]
    total = here[1 : 1 + k].sum()
    if not total:
        return point
    target = targets_for(here[1 : 1 + k], CAPS if caps is None else caps) / total
    for ridge in RIDGES:
        value = lambda x, s, ridge=ridge: s[0] / total + x @ target + ridge / 2 * x @ x  # noqa: E731  convex, least at lambda
        while True:
            gradient = target - here[1 : 1 + k] / total + ridge * point
            if np.abs(gradient).max() <= tolerance:
                break
            curve = np.zeros((k, k))
            curve[upper] = here[1 + k :] / total
            curve = curve + np.triu(curve, 1).T + ridge * np.eye(k)
            tries = point - np.array(SIZES)[:, None] * np.linalg.solve(curve, gradient)
            sums = _sums(members, tries)
            values = [value(x, s) for x, s in zip(tries, sums)]
            best = int(np.argmin(values))
            if not values[best] < value(point, here) - 1e-15 * abs(value(point, here)):
                break  # nothing is left to gain in doubles
            point, here = tries[best], sums[best]
    return point


def rate_of(point: np.ndarray, m: str) -> Column:
    """The rate of a document with the struct ``m``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"{m}.{d}") * float(x) for d, x in zip(DOMAINS, point)), F.lit(0.0)))


def with_rates(docs: DataFrame, labels: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """``docs`` plus a last struct: tokens, posteriors, rate and copies."""
    scored = with_posteriors(docs, train(docs, labels))
    name = scored.columns[-1]
    rate = rate_of(solve(scored.select(F.col(name).alias("_m")), caps), name)
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(41))).otherwise(F.xxhash64("doc_id", F.lit(41)))
    u = F.pmod(draw, F.lit(1 << 30)) / (1 << 30)
    scored = scored.withColumn(name, F.col(name).withField("rate", rate))
    return scored.withColumn(name, F.col(name).withField("copies", F.floor(F.col(f"{name}.rate") + u).cast("int")))


def mix(docs: DataFrame, labels: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """Each document as often as its rate says, columns unchanged."""
    out = with_rates(docs, labels, caps)
    name = out.columns[-1]
    copy = free_name(out.columns, "_copy")
    out = out.where(F.col(f"{name}.copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
