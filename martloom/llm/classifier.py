"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics. For each class the
labelled texts give a mean and a covariance, shrunk towards the classes' common
covariance and towards its diagonal. A text's score is the logistic of the
difference of the two log densities; each is a Mahalanobis distance through the
class's Cholesky factor, computed once and sent with the task.

The fit needs two rows of sums, which Spark adds up over all labelled texts.

Defined results: a null text is an empty one, and scored; rows with a null label
or without a text of their id teach nothing, a repeated label row counts again;
with labels of a single class or none the score is the share of label 1, or one
half; equal texts get equal scores; a text of any length is one row and is read
whole; an empty table gives no rows. Labels, language, source and id are no input
of a score. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import fold, named, output, table
from martloom.session import stage

FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3
POOL = 0.2  # share of the common covariance in a class's covariance
DIAGONAL = 0.1  # share of its own diagonal
RIDGE = 0.05  # added variance, in units of the statistics below
MARKS = "#*$%&|<>"


def statistics(text: str) -> list[float]:
    """Statistics of one text, transformed to similar scales (logs of counts and of shares)."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    letters = sum(map(len, words)) or 1
    found = Counter(words)
    lines = text.split("\n")

    def share(part: float, whole: float, floor: float) -> float:
        return math.log(part / whole + floor) if whole else math.log(floor)

    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(map(text.count, MARKS))
    repeats = sum(1 for a, b in zip(words, words[1:]) if a == b)
    top = max(found.values()) if found else 0
    common = list(Counter(text).values())
    entropy = -sum(c / chars * math.log2(c / chars) for c in common)
    return [
        math.log1p(n),
        math.log(letters / max(1, n)),
        share(upper, n, 0.01),
        share(marked, letters, 0.003),
        share(text.count("|"), letters, 0.003),
        share(text.count("!"), letters, 0.003),
        share(text.count(".") + text.count(","), letters, 0.003),
        share(sum(map(text.count, "0123456789")), letters, 0.003),
        share(repeats, n, 0.01),
        share(top, n, 0.02),
        math.log(max(1, len(found))) / math.log(n) if n > 1 else 1.0,
        share(len(lines) - len(set(lines)), len(lines), 0.03),
        math.log1p(n / len(lines)),
        entropy / 2,
    ]


SIZE = len(statistics(""))


def described(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``x``, the statistics of the text."""
    rows = docs.select(*[named(c).alias(c) for c in keep], F.coalesce(named(text), F.lit("")).alias("__text"))

    def describe(batches):
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column("__text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], x], [*keep, "x"])

    return rows.mapInArrow(describe, output(rows, keep, "x array<double>"))


def moments(labelled: DataFrame, label: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of ``x`` for each class, from one row of sums per class."""
    x = F.col("x")
    sums = [F.sum(x[i]) for i in range(SIZE)] + [F.sum(x[i] * x[j]) for i in range(SIZE) for j in range(i + 1)]
    found = {}
    rows = labelled.where(named(label).isin(0, 1)).groupBy(named(label).cast("int").alias("y"))
    for row in rows.agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).collect():
        values = np.array(row[2:], float) / row["n"]
        mean, square = values[:SIZE], np.zeros((SIZE, SIZE))
        square[np.tril_indices(SIZE)] = values[SIZE:]
        square = square + np.tril(square, -1).T
        found[row["y"]] = (row["n"], mean, square - np.outer(mean, mean))
    return found


class Discriminant:
    """Two Gaussian classes with shrunk covariances; keeps Cholesky factors."""

    def __init__(self, classes: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in classes.values())
        self.prior = classes[1][0] / total if 1 in classes else 0.0 if total else 0.5
        self.parts = None
        if set(classes) != {0, 1}:
            return
        common = sum(n * c for n, _, c in classes.values()) / total
        self.parts = []
        for y in (0, 1):
            n, mean, own = classes[y]
            own = (1 - POOL) * own + POOL * common
            own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + RIDGE * np.eye(SIZE)
            factor = np.linalg.cholesky(own)
            self.parts.append((mean, np.linalg.inv(factor), math.log(n / total) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        density = [start - 0.5 * (((x - mean) @ root.T) ** 2).sum(axis=1) for mean, root, start in self.parts]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(labelled: DataFrame, label: str) -> Discriminant:
    return Discriminant(moments(labelled, label))


def score(described_docs: DataFrame, model: Discriminant) -> DataFrame:
    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    return described_docs.withColumn("score", scored("x"))


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(described(table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = fit(docs.where("not held_out").join(labels, "doc_id"), "quality")
    scored = score(docs, model)
    return scored.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )
