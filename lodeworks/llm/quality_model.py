"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled covariance within the classes and a small ridge; the
score is the logistic of the difference of the classes' log densities and log shares. The inverse Cholesky factors are
computed once and kept in the model; scoring is arithmetic on columns. Fitting takes a bounded sample of the labelled
rows (sample, those with the smallest MD5 of the id) and one aggregation of sums and products. Statistics are in fixed
point, so that sums, and with them the model, are the same however the rows are dealt.

Cases: a null or empty text has all counts 0 and gets the score of that vector; rows without a label, or with a null
one, are not learnt from; null ids are scored but not learnt from; repeated documents or labels each count; very long texts
are counted whole; if a class has fewer rows than dimensions the shrunk
covariance still exists, and with no row of a class every score is the share of the other (0.5 without any label); an
empty table gives no rows; other columns, whatever their names, are ignored or passed through as they are.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.text_stats import with_counts

#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000
#: Fixed-point steps per unit of a transformed statistic.
SCALE = 1 << 16


def features() -> list[Column]:
    n, c = F.col("n_words") + 20, F.col("word_chars") + 100
    rate = lambda x, of: F.log(1 + 10 * F.col(x) / of)
    raw = [F.log(c / n), rate("n_symbols", n), rate("n_upper", c), rate("n_marks", n), rate("n_other", c), F.log(F.col("n_distinct") + 10) - 0.88 * F.log(F.col("n_words") + 10), F.log(F.col("n_words") + 10), rate("n_dup_lines", F.col("n_lines") + 4)]
    return [F.round(x * SCALE).cast("long") for x in raw]


D = 8


def held_out(id_col: Column) -> Column:
    """Rows that no model learns from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


class QualityModel:
    """Class means, inverse Cholesky factors and offsets."""

    def __init__(self, means, factors, offsets):
        self.means, self.factors, self.offsets = np.asarray(means), np.asarray(factors), list(offsets)

    @classmethod
    def from_sums(cls, n, sums, products, shrink: float = 0.2, ridge: float = 1e-3) -> QualityModel:
        """n, sums and products (in fixed point) by class 0 and 1."""
        n, sums, products = np.asarray(n, float), np.asarray(sums, float) / SCALE, np.asarray(products, float) / SCALE**2
        if min(n) == 0:
            share = n[1] / n.sum() if n.sum() else 0.5
            odds = math.inf if share == 1 else -math.inf if share == 0 else 0.0
            return cls(np.zeros((2, D)), np.zeros((2, D, D)), [0.0, max(-700.0, min(700.0, odds))])
        means = sums / n[:, None]
        own = [products[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
        factors, offsets = [], []
        for k in (0, 1):
            chol = np.linalg.cholesky((1 - shrink) * own[k] + shrink * pooled + ridge * np.eye(D))
            factors.append(np.linalg.inv(chol))
            offsets.append(math.log(n[k] / n.sum()) - float(np.log(np.diag(chol)).sum()))
        return cls(means, factors, offsets)

    def dumps(self) -> str:
        return json.dumps({"means": self.means.tolist(), "factors": self.factors.tolist(), "offsets": self.offsets})

    @classmethod
    def loads(cls, text: str) -> QualityModel:
        return cls(**json.loads(text))

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """docs with the score of text_col; a column of that name is replaced, no other is touched."""
        x = [f"x{j}" for j in range(D)]
        out = with_counts(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), "text", windows=False)
        out = out.select("row", *((f / SCALE).alias(n) for f, n in zip(features(), x, strict=True)))
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            rows = [sum((float(factor[i, j]) * (F.col(x[j]) - float(mean[j])) for j in range(i + 1)), F.lit(0.0)) for i in range(D)]
            density.append(sum((r * r for r in rows), F.lit(0.0)) * -0.5 + offset)
        score = (1 / (1 + F.exp(density[0] - density[1]))).alias(score_col)
        return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != score_col), score)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """A model from the labels of rows that are not held out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    x = with_counts(rows, "_text", windows=False).select("_y", *(f.alias(f"_x{j}") for j, f in enumerate(features())))
    sums = x.groupBy("_y").agg(F.count("*").alias("n"), F.array(*(F.sum(f"_x{j}") for j in range(D))).alias("s"), F.array(*(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(D) for j in range(D))).alias("p")).collect()
    n, s, p = [0, 0], np.zeros((2, D)), np.zeros((2, D, D))
    for r in sums:
        n[r["_y"]], s[r["_y"]], p[r["_y"]] = r["n"], r["s"], np.reshape(r["p"], (D, D))
    return QualityModel.from_sums(n, s, p)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
