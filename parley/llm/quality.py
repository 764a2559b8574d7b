"""Quality rules with adaptive thresholds (operator 8).

Each document gets integer measures. For every language and source a mergeable
quantile sketch of each measure is kept: counts by log-linear bucket, so merging
is addition, order does not matter and the relative error is at most 1/32. Every
threshold comes from these sketches alone: a fence lies FENCE spreads beyond the
group's own tail quantile, where the spread is the distance from the median to that
tail. Where both are equal (a measure that is 0 for nearly all documents) the spread
is a sixteenth of the distance to the 99th percentile. Groups with few documents use
the merged sketch of their language, then of everything. The fences are joined back
and documents outside are rejected. A group of junk only sets its fences by itself, so
the tail of word length and symbols is the 90th percentile: up to a tenth of junk in a
group does not move it.

Cases: a null or empty text has no words and fails the base rule; null ``lang`` or
``source`` form a group of their own, apart from the empty string; repeated rows each
count and get the same verdict; an empty table gives an empty result; other columns
pass through. The struct that ``judge`` adds is the last column, ``_q`` or, where that
name is taken, ``_q`` with underscores appended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import textkernel as tk
from parley.llm.common import free_name, join_small, materialize, row_slices, text_bytes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Measure: (integer expression, percent of the tail quantile, has a lower fence).
MEASURES = {
    "word_len": ("word_chars * 100 div n_words", 90, True),
    "symbols": ("n_symbols * 1000 div word_chars", 90, False),
    "dup_lines": ("n_dup_lines * 1000 div n_words", 99, False),
    "repeats": ("n_repeat_words * 1000 div n_words", 99, False),
}
FENCE, MIN_DOCS, WINDOW, FAR_SHARE = 3, 50, 5, 16
PERCENTS = (1, 10, 50, 90, 99)


def measure(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The five base counts of each row of one slice."""
    n = len(offs) - 1
    starts, ends, rows = tk.words(data, offs)
    n_words = tk.word_counts(rows, n)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(rows, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64)
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    symbols = (sym[offs[1:]] - sym[offs[:-1]]).astype(np.int64)
    a, b, line_rows = tk.lines(data, offs)
    full = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    _, later = tk.repeated_within(tk.span_hash(data, a[full], b[full]), line_rows[full])
    dup = np.bincount(line_rows[full][later], minlength=n).astype(np.int64)
    win, at = tk.windows(tk.span_hash(data, starts, ends), rows, WINDOW)
    twice, _ = tk.repeated_within(win, rows[at])
    hit = tk.covered(at[twice], WINDOW, len(starts))
    return [n_words, chars, symbols, dup, np.bincount(rows[hit], minlength=n).astype(np.int64)]


def base_counts(text: pa.Array) -> pa.Array:
    data, offs = text_bytes(text)
    parts = [measure(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in row_slices(offs)]
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=list(BASE))


def bucket(value: Column) -> Column:
    """The lower edge of a value's log-linear bucket (6 significant bits)."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return value - value % step


def group_key(column: str) -> Column:
    """A non-null text for each value of a nullable column, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def sketches(scored: DataFrame, q: str) -> DataFrame:
    """lang, source (as group keys), measure, edge, n: the quantile sketches of documents that pass the base rule."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"{q}.{m}").alias("v")) for m in MEASURES))
    rows = scored.where(f"not {q}.base_failed").select(group_key("lang").alias("lang"), group_key("source").alias("source"), F.explode(values).alias("x"))
    return rows.groupBy("lang", "source", F.col("x.measure").alias("measure"), bucket(F.col("x.v")).alias("edge")).agg(F.count("*").alias("n"))


def _quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure and the struct ``at``: total and the quantiles of the merged sketches.

    A quantile is the smallest edge below which at least that share of the documents lies."""
    by = [*keys, "measure"]
    w = Window.partitionBy(*by)
    run = sk.groupBy(*by, "edge").agg(F.sum("n").alias("n"))
    run = run.withColumn("c", F.sum("n").over(w.orderBy("edge"))).withColumn("total", F.sum("n").over(w))
    q = {f"q{p}": F.min(F.when(F.col("c") * 100 >= F.col("total") * p, F.col("edge"))) for p in PERCENTS}
    out = run.groupBy(*by).agg(F.max("total").alias("total"), *(e.alias(n) for n, e in q.items()))
    return out.select(*by, F.struct("total", *q).alias("at"))


def thresholds(sk: DataFrame) -> DataFrame:
    """lang, source and one lo_/hi_ pair for each measure, from the narrowest level with enough documents."""
    own = _quantiles(sk, ["lang", "source"]).withColumnRenamed("at", "s")
    of_lang = _quantiles(sk, ["lang"]).withColumnRenamed("at", "l")
    of_all = _quantiles(sk, []).withColumnRenamed("at", "a")
    best = F.when(F.col("s.total") >= MIN_DOCS, F.col("s")).when(F.col("l.total") >= MIN_DOCS, F.col("l")).otherwise(F.col("a"))
    out = own.join(of_lang, ["lang", "measure"]).join(of_all, ["measure"]).withColumn("x", best)
    wide = F.create_map(*(F.lit(v) for m, (_, p, _) in MEASURES.items() for v in (m, p == 99)))[F.col("measure")]
    far_high, far_low = F.col("x.q99"), F.col("x.q1")
    high, low = F.when(wide, far_high).otherwise(F.col("x.q90")), F.when(wide, far_low).otherwise(F.col("x.q10"))

    def spread(tail: Column, far: Column) -> Column:
        near = F.abs(tail - F.col("x.q50"))
        return F.when(near > 0, near).otherwise(F.floor(F.abs(far - F.col("x.q50")) / FAR_SHARE) + 1)

    lo, hi = low - FENCE * spread(low, far_low), high + FENCE * spread(high, far_high)
    out = out.select("lang", "source", "measure", lo.alias("lo"), hi.alias("hi"))
    pick = [F.max(F.when(F.col("measure") == m, F.col(b))).alias(f"{b}_{m}") for m in MEASURES for b in ("lo", "hi")]
    return out.groupBy("lang", "source").agg(*pick)


def with_measures(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` plus the struct ``into``: base counts, measures and ``base_failed``."""
    base = docs.withColumn(into, F.arrow_udf(base_counts, SHAPE)(F.col("text")))
    fields = [F.col(f"{into}.{c}").alias(c) for c in BASE]
    fields.append(F.expr(f"{into}.n_words < 10 or 100 * {into}.n_repeat_words > 20 * {into}.n_words").alias("base_failed"))
    for m, (e, _, _) in MEASURES.items():
        for c in BASE:
            e = e.replace(c, f"{into}.{c}")
        fields.append(F.expr(f"case when {into}.n_words > 0 then {e} end").alias(m))
    return base.withColumn(into, F.struct(*fields))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` plus a last column, a struct with base counts, measures, ``base_failed`` and ``kept``."""
    q, lang, source, fence = (free_name(docs.columns, c) for c in ("_q", "_lang", "_source", "_fence"))
    scored = with_measures(docs, q)
    fences = materialize(thresholds(materialize(sketches(scored.select("lang", "source", q), q), "sketch")), "fences")
    limits = F.struct(*[c for c in fences.columns if c not in ("lang", "source")])
    fences = fences.select(F.col("lang").alias(lang), F.col("source").alias(source), limits.alias(fence))
    keyed = scored.withColumns({lang: group_key("lang"), source: group_key("source")})
    out = join_small(keyed, fences, [lang, source])
    ok = F.lit(True)
    for m, (_, _, low) in MEASURES.items():
        edge = bucket(F.col(f"{q}.{m}"))  # values of one bucket are one value to the sketch
        ok &= edge <= F.col(f"{fence}.hi_{m}")
        if low:
            ok &= edge >= F.col(f"{fence}.lo_{m}")
    kept = F.when(F.col(f"{q}.base_failed"), F.lit(False)).otherwise(F.coalesce(ok, F.lit(False)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(q).withField("kept", kept).alias(q))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns unchanged."""
    out = judge(docs)
    return out.where(f"{out.columns[-1]}.kept").drop(out.columns[-1])
