"""Quality of documents by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics. A class is a Gaussian
over them, its covariance shrunk towards the covariance of both classes and its
diagonal; a score is the sigmoid of the prior and density log-ratio, taken from
Mahalanobis distances by Cholesky factors that are made once and kept with the
model. Training needs only counts, sums and products by class, which Spark
aggregates over all labelled rows; two rows come to the driver.

Defined cases: null and empty texts have statistics like any other (all zero);
labels that are null or of no document are not learned from, repeated ones count
each; with one class only, every score is that class, with none, 0.5; an empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import filtered
from .storage import keep

NAMES = ("words", "word_length", "upper", "symbols", "pipes", "bangs", "digits", "stops", "repeats", "variety", "same_lines")
#: Shares of the class covariance that come from the pooled one, and from its diagonal.
POOLED, DIAGONAL = 0.1, 0.05
THRESHOLD = 0.7
_SYMBOLS = np.frombuffer(b"*$%&#@^~<>{}[]=+_\\/", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, letters = max(1, len(words)), max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    share = lambda k, of: float(np.sqrt(k / of))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(raw) / n)),
        share(seen[65:91].sum(), letters),
        share(seen[_SYMBOLS].sum(), n),
        share(seen[ord("|")], n),
        share(seen[ord("!")], n),
        share(seen[48:58].sum(), max(1, len(raw))),
        share(seen[_STOPS].sum(), n),
        share(sum(map(operator.eq, words, words[1:])), n),
        float(np.log1p(len(set(words))) / np.log1p(n)),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
    ]


def _statistics_udf() -> Any:
    return F.pandas_udf(lambda texts: pd.Series([statistics(t) for t in texts]), "array<double>")


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "_stats") -> DataFrame:
    return docs.withColumn(out, _statistics_udf()(F.col(text_col).cast("string")))


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors, log-determinants and log-priors; class 0 first."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    only: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        log = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse[k].T
            log.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(1)))
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def train(stats: DataFrame, label: Column, column: str = "_stats") -> Model:
    """Fit on all rows of ``stats`` whose ``label`` is 0 or 1."""
    p = len(NAMES)
    x = [F.col(column)[i] for i in range(p)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(p)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in upper]
    rows = {r["_y"]: r for r in stats.withColumn("_y", label.cast("int")).where("_y in (0, 1)").groupBy("_y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if len(rows) < 2:
        return Model(*[np.empty(0)] * 4, only=float(next(iter(rows), 0.5)))
    mean, scatter, n = [], [], np.array([rows[k]["n"] for k in (0, 1)], float)
    for k in (0, 1):
        m = np.array([rows[k][f"s{i}"] for i in range(p)]) / n[k]
        c = np.empty((p, p))
        for i, j in upper:
            c[i, j] = c[j, i] = rows[k][f"p{i}_{j}"] / n[k] - m[i] * m[j]
        mean.append(m)
        scatter.append(c)
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()
    inverse, log_det = [], []
    for c in scatter:
        shrunk = (1 - POOLED - DIAGONAL) * c + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(np.array(mean), np.array(inverse), np.array(log_det), np.log(n / n.sum()))


def score(stats: DataFrame, model: Model, column: str = "_stats", out: str = "score") -> DataFrame:
    udf = F.pandas_udf(lambda s: pd.Series(model.scores(np.stack(s.to_numpy())) if len(s) else []), "double")
    return stats.withColumn(out, udf(F.col(column)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _marked(labels: DataFrame) -> DataFrame:
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    return marked.where(~held_out(F.col("_id")) & F.col("_quality").isin(0, 1))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from all labelled rows. Statistics are made of what a bitmap of their ids lets through, and joined to labels instead of texts."""
    marked = _marked(labels)
    ids = keep(marked.select(F.col("_id").cast("long").alias("_id")).distinct(), "quality-ids")
    stats = with_statistics(filtered(_own(docs, id_col, text_col), ids, "_id"), "_text").select("_id", "_stats")
    return train(stats.join(marked, "_id"), F.col("_quality"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    stats = keep(with_statistics(_own(docs, id_col, text_col), "_text").select("_id", "_stats"), "quality-stats")
    scored = score(stats, train(stats.join(_marked(labels), "_id"), F.col("_quality")))
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns; texts are scored where they lie."""
    model = fit(docs, labels, id_col, text_col)
    udf = F.pandas_udf(lambda texts: pd.Series(model.scores(np.array([statistics(t) for t in texts])) if len(texts) else []), "double")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), udf(F.col(text_col).cast("string")).alias("_score"))
    return boxed.where(F.col("_score") >= THRESHOLD).select("_row.*")
