"""Quality rules: fixed base rules, then multivariate outliers against robust estimates per language and source.

Each text gives a vector of transformed statistics, in fixed point so that sums are exact whatever their order. For
each (language, source) the minimum-covariance-determinant estimate is sought by concentration steps from two starts
(medians with quartile spreads, and the plain mean and covariance): the three quarters of the rows nearest by
Mahalanobis distance give the next mean and covariance. A step is one aggregation: rows are counted and summed by group
and distance bin, and the bins up to the quantile are added up, so no group meets in a task. A bin is 1 / BINS of a
factor e wide and is taken whole, so that a subset may hold a little more than its three quarters. After two steps the
start of the smaller determinant goes on, until the determinants settle; one reweighting step follows.

Small groups have too few rows for an estimate of their own, so every estimate is regularised: with n rows of its own a
group's mean and covariance count n / (n + SHRINK), those of its language the rest, which in turn lean on the whole
corpus's in the same way. During the steps what a group leans on is fixed, as its start gives it; the reweighting step
takes it anew from the rows it keeps. This is continuous in n: a large group has its own estimate, a group of one row nearly that of
its language, and every group gives a verdict. A small variance is added in each dimension so that a statistic that is
constant in a group cannot reject tiny deviations.

Texts beyond a chi-square tail are rejected. Statistics of real texts have longer tails than a normal distribution, so the
tail is far out (1e-7) in order to leave unusual but sound texts alone; what the rules are after lies much farther out.

Cases: null or empty texts have no words and fail the base rules; a null language or source is a value of its own; ties
in distance fall in one bin and are taken together; repeated rows each count; very long texts are counted whole; an
empty table gives no rows; null ids are passed through; other columns are ignored, except that keep_good() returns them,
whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, checkpoint
from lodeworks.llm.text_stats import with_counts

#: Fixed-point steps per unit of a transformed statistic.
SCALE = 256
#: Standard deviation added to each dimension, in units of the transformed statistics.
FLOOR = (0.05, 0.05, 0.05, 0.1, 0.05)
P = len(FLOOR)
#: Rows that the estimate of the next larger group counts as.
SHRINK = 50
#: Distance bins per factor e.
BINS = 32
#: Width of the bins that starting medians and quartiles are read from, in fixed-point steps.
WIDTH = 8
_PAIRS = list(combinations_with_replacement(range(P), 2))
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in _PAIRS)]
_GROUP = ["lang", "source"]


def vector() -> list[Column]:
    """Length of words, symbols, capitals, repetition and other characters; the constants calm short texts."""
    n, c = F.col("n_words") + 50, F.col("word_chars") + 250
    raw = [c / n, 1 + 10 * F.col("n_symbols") / n, 1 + 10 * F.col("n_upper") / c, 1 + 10 * F.col("n_repeat_words") / n, 1 + 10 * F.col("n_other") / c]
    return [F.round(F.log(x) * SCALE).cast("long").alias(f"x{j}") for j, x in enumerate(raw)]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-17:
        term *= z / (a + i)
        total += term
        i += 1
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _attached(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a table of a row or few a group, nulls being equal; small is read from files, so Spark knows whether to send it to all tasks."""
    other = small.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(other, same, "left").drop(*(f"_{k}" for k in keys))


def _sums(inside: str = "true") -> list[Column]:
    """Counts, sums and products of the rows for which inside holds."""
    values = {"n": "1L", **{f"s{i}": f"x{i}" for i in range(P)}, **{f"s{i}_{j}": f"x{i} * x{j}" for i, j in _PAIRS}}
    return [F.expr(f"coalesce(sum({v}) FILTER (WHERE {inside}), 0)" if inside != "true" else f"sum({v})").alias(k) for k, v in values.items()]


def _moments(at: str, factor: float, above: str | None) -> tuple[list[str], list[str]]:
    """SQL for the means, and then for the covariances, of a level from its sums, leaning on those of the level above."""
    lean = lambda own, k: own if above is None else f"(coalesce({own}, 0D) * {at}n + {SHRINK} * {above}{k}) / ({at}n + {SHRINK})"
    raw = [f"coalesce({at}s{i} / nullif({at}n, 0), 0D) AS {at}r{i}" for i in range(P)]
    mean = [f"{lean(f'{at}r{i}', f'm{i}')} AS {at}m{i}" for i in range(P)]
    own = {(i, j): f"(({at}s{i}_{j} / nullif({at}n, 0) - {at}r{i} * {at}r{j}) * {factor!r}D)" for i, j in _PAIRS}
    return raw, [*mean, *(f"{lean(f'coalesce({c}, 0D)', f'c{i}_{j}')} AS {at}c{i}_{j}" for (i, j), c in own.items())]


#: What a group leans on: means and covariances of its language.
_ABOVE = [f"l_m{i}" for i in range(P)] + [f"l_c{i}_{j}" for i, j in _PAIRS]


def leaning(sums: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Rows of n, s0.. and s0_0.. a group (by, lang, source), with what they lean on."""
    sums = sums.withColumn("_one", F.lit(1))
    out = sums
    for at, keys in (("l_", [*by, "lang"]), ("a_", [*by, "_one"])):
        out = _attached(out, sums.groupBy(*keys).agg(*(F.expr(f"sum({k}) AS {at}{k}") for k in _SUMS)), keys)
    for at, above in (("a_", None), ("l_", "a_")):
        for step in _moments(at, factor, above):
            out = out.selectExpr("*", *step)
    return out.select(*by, *_GROUP, *_SUMS, *_ABOVE)


def estimates(sums: DataFrame, by: list[str], factor: float) -> DataFrame:
    """by, lang, source, mean m0.., inverse Cholesky factor w0_0.. and logdet of the covariances, and what they lean on, from the rows of leaning()."""
    out = sums
    for step in _moments("", factor, "l_"):
        out = out.selectExpr("*", *step)
    floor = {(i, j): f" + {(FLOOR[i] * SCALE) ** 2!r}D" if i == j else "" for i, j in _PAIRS}
    return _inverse_factor(out.selectExpr(*by, *_GROUP, *_ABOVE, *(f"m{i}" for i in range(P)), *(f"c{i}_{j}{floor[i, j]} AS c{i}_{j}" for i, j in _PAIRS)), [*by, *_GROUP, *_ABOVE])


def _inverse_factor(out: DataFrame, keep: list[str]) -> DataFrame:
    """Columns c{i}_{j} (i <= j) to w{i}_{j} (j <= i), the inverse of the Cholesky factor, and logdet."""
    add = lambda terms: " + ".join(terms) or "0D"
    for j in range(P):
        out = out.selectExpr("*", f"sqrt(c{j}_{j} - ({add(f'l{j}_{k} * l{j}_{k}' for k in range(j))})) AS l{j}_{j}")
        if j + 1 < P:
            out = out.selectExpr("*", *(f"(c{j}_{i} - ({add(f'l{i}_{k} * l{j}_{k}' for k in range(j))})) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, P)))
    out = out.selectExpr("*", *(f"1 / l{i}_{i} AS w{i}_{i}" for i in range(P)))
    for step in range(1, P):
        out = out.selectExpr("*", *(f"-({add(f'l{i}_{k} * w{k}_{i - step}' for k in range(i - step, i))}) / l{i}_{i} AS w{i}_{i - step}" for i in range(step, P)))
    return out.selectExpr(*keep, *(f"m{i}" for i in range(P)), *(f"w{i}_{j}" for j, i in _PAIRS), add(f"2 * ln(l{i}_{i})" for i in range(P)) + " AS logdet")


#: Squared Mahalanobis distance of x0.. under m0.. and w0_0.., in SQL.
_DISTANCE = " + ".join(f"power({' + '.join(f'w{i}_{j} * (x{j} - m{j})' for j in range(i + 1))}, 2)" for i in range(P))


def _first_sums(x: DataFrame) -> DataFrame:
    """The sums of the two starts, as (start, lang, source, n, s0.., s0_0..)."""
    plain = x.groupBy(*_GROUP).agg(*_sums()).withColumn("start", F.lit(1))
    # Quartiles from exact counts of narrow bins, for all dimensions at once.
    cells = x.select(*_GROUP, F.posexplode(F.expr(f"array({', '.join(f'floor(x{i} / {WIDTH})' for i in range(P))})")).alias("dim", "bin")).groupBy(*_GROUP, "dim", "bin").agg(F.count("*").alias("k"))
    whole = W.partitionBy(*_GROUP, "dim")
    cells = cells.withColumns({"upto": F.sum("k").over(whole.orderBy("bin")), "all": F.sum("k").over(whole)})
    at = lambda q, name: F.expr(f"min(bin) FILTER (WHERE upto >= all * {q}D) * {WIDTH} + {WIDTH // 2} AS {name}")
    quart = cells.groupBy(*_GROUP, "dim").agg(F.max("all").alias("n"), at(0.25, "low"), at(0.5, "mid"), at(0.75, "high"))
    # As sums of n rows with that median for a mean and that spread for a deviation, so that small groups lean on others alike.
    wide = quart.groupBy(*_GROUP).agg(F.max("n").alias("n"), *(F.expr(f"max(mid) FILTER (WHERE dim = {i}) AS q{i}") for i in range(P)), *(F.expr(f"max(power((high - low) / 1.349D, 2)) FILTER (WHERE dim = {i}) AS v{i}") for i in range(P)))
    robust = wide.selectExpr("0 AS start", *_GROUP, "n", *(f"n * q{i} AS s{i}" for i in range(P)), *(f"cast(n * (q{i} * q{j}{f' + v{i}' if i == j else ''}) AS bigint) AS s{i}_{j}" for i, j in _PAIRS))
    return robust.unionByName(plain.select(*robust.columns))


def fit(x: DataFrame, scratch: Scratch, share: float = 0.75, inner: float = 0.975, settled: float = 1e-3, report: dict | None = None) -> DataFrame:
    """The estimates of each group, mean m0.. and inverse Cholesky factor w0_0.., from rows of (lang, source, x0..).

    Each group keeps its smallest log determinant. Steps end when none falls by settled or more, as all must at last: the
    determinants have a floor. report: gets steps, how many there were.
    """
    by = ["start", *_GROUP]
    h, k = chi2_quantile(share, P), chi2_quantile(inner, P)
    grow, last = share / chi2_cdf(h, P + 2), inner / chi2_cdf(k, P + 2)

    def step(est: DataFrame) -> DataFrame:
        near = _attached(x, est.drop(*_ABOVE, "logdet"), _GROUP).withColumn("bin", F.expr(f"floor(ln({_DISTANCE} + 1e-3D) * {BINS})"))
        bins = near.groupBy(*by, "bin").agg(*_sums())
        bins = bins.withColumns({"_upto": F.sum("n").over(W.partitionBy(*by).orderBy("bin")), "_all": F.sum("n").over(W.partitionBy(*by))})
        inside = bins.filter(F.col("_upto") - F.col("n") < F.ceil(F.col("_all") * share)).groupBy(*by).agg(*(F.expr(f"sum({c}) AS {c}") for c in _SUMS))
        return estimates(_attached(inside, est.select(*by, *_ABOVE), by), ["start"], grow)

    est = scratch.keep(estimates(leaning(_first_sums(x), ["start"], 1.0), ["start"], 1.0), "start")
    for i in range(2):
        est = scratch.keep(step(est), f"both{i}")
    est = est.groupBy(*_GROUP).agg(F.min_by(F.struct(*(c for c in est.columns if c not in _GROUP)), F.struct("logdet", "start")).alias("_b")).select(*_GROUP, "_b.*")
    est, fell, steps = est.withColumn("fell", F.lit(0.0)), settled, 2
    while fell is not None and fell >= settled:
        now = est.drop("fell")
        after = scratch.keep(step(now), f"step{steps}")
        was = now.select(*by, F.col("logdet").alias("_was"), F.struct(*(c for c in now.columns if c not in by)).alias("_old"))
        both = _attached(after.select(*by, F.struct(*(c for c in after.columns if c not in by)).alias("_new")), was, by)
        lower = F.col("_new.logdet") < F.col("_was")
        names = [c for c in now.columns if c not in by]
        est = both.select(*by, *(F.when(lower, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in names), F.when(lower, F.col("_was") - F.col("_new.logdet")).otherwise(0.0).alias("fell"))
        est = scratch.keep(est, f"best{steps}")
        fell, steps = est.agg(F.max("fell")).first()[0], steps + 1
    if report is not None:
        report["steps"] = steps
    est = est.drop("fell")
    near = _attached(x, est.drop("start", "logdet", *_ABOVE), _GROUP)
    kept = leaning(near.groupBy(*_GROUP).agg(*_sums(f"{_DISTANCE} <= {k!r}D")), [], last)
    return scratch.keep(estimates(kept, [], last).drop("logdet", *_ABOVE), "reweighted")


def _judged(docs: DataFrame, scratch: Scratch, tail: float, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool) -> DataFrame:
    """Counts, base_failed, distance and kept of each row, with the row itself as _row if whole is set: it is written once, and never shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"), *([F.struct("*").alias("_row")] if whole else []))
    rows = with_counts(rows, "_text").drop("_text").withColumn("base_failed", base_failed())
    rows = scratch.keep(rows.select("*", *vector()), "vectors")
    est = fit(rows.filter(~F.col("base_failed")).select(*_GROUP, *(f"x{i}" for i in range(P))), scratch)
    out = _attached(rows, est, _GROUP).withColumn("distance", F.expr(_DISTANCE))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - tail, P))
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))


def judge(docs: DataFrame, tail: float = 1e-7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Each document's counts, base_failed, distance and kept; distance is null where all of a group fail the base rules.

    tail: the share of a normal sample that the distance would reject.
    """
    with Scratch(docs.sparkSession) as scratch:
        out = _judged(docs, scratch, tail, id_col, text_col, lang_col, source_col, False)
        return checkpoint(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"))


def keep_good(docs: DataFrame, tail: float = 1e-7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that judge() keeps, with all their columns. The texts are written once beside their vectors, and not shuffled."""
    scratch = Scratch(docs.sparkSession)  # its tables are read when the result is, and deleted at the end of the session
    return _judged(docs, scratch, tail, id_col, text_col, lang_col, source_col, True).filter("kept").select("_row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
