"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text gives about a dozen counts (words, adjacent repeats, capitals,
signs, line repeats ...). A count becomes the logarithm of its rate per word, drawn
towards the rate of the good class by ``strength`` words' worth, so that a short
text isn't judged by one sign. Each class has a Gaussian over these features whose
covariance is shrunk twice: towards the pooled covariance, then towards its own
diagonal. The Cholesky factor of each is computed once, when the model is fitted,
and travels with the model. A text's score is the probability of class 1 by the
difference of the log densities (Mahalanobis distances and log determinants) and
of the class sizes.

Fitting reads every labelled row that isn't held out and needs sums only: counts of
the good class, then numbers, sums and outer products of the features for each class
and fold. They are added up in Spark; what the driver gets has a fixed size, however
many rows there are and however often an id is repeated. The strength and both
shrinkages are those of ``GRID`` with the least log loss in cross-validation over
``FOLDS`` folds of the training rows. Scoring is a projection over all rows, with no
shuffle.

Rows: a null text is an empty text, and both have a score. Labels with a null
doc_id or quality, or a quality other than 0 and 1, teach nothing; a repeated
label or document counts again. With less than two rows of a class the score is the
share of class 1 (0.5 with no rows at all). Columns of the input are kept; one named
as the score column is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FOLDS = 5
STRENGTHS, POOLED, DIAGONAL = (10.0, 40.0, 160.0), (0.1, 0.3, 0.6), (0.1, 0.3, 0.6)
#: Candidates: strength, share of the pooled covariance, share of the diagonal.
GRID = list(product(STRENGTHS, POOLED, DIAGONAL))
COUNTS = ("repeats", "upper", "digit", "pipe", "bang", "sign", "stop", "high", "line_repeats", "chars", "distinct", "top")
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "|!.,"]


def counts(text: str | None) -> list[float]:
    """Number of words, then ``COUNTS``."""
    text = text or ""
    words, raw = text.split(), np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x]
    tally = Counter(words)
    return [
        len(words),
        sum(map(eq, words, words[1:])),
        raw[65:91].sum(),
        raw[48:58].sum(),
        raw[124],
        raw[33],
        raw[_SIGNS].sum(),
        raw[46] + raw[44],
        raw[128:].sum(),
        len(lines) - len(set(lines)),
        len(text),
        len(tally),
        max(tally.values(), default=0),
    ]


def features(c: np.ndarray, rates: np.ndarray, strength: float) -> np.ndarray:
    """Transformed statistics of rows of counts, with the good class's rates per word."""
    n = c[:, :1]
    r = np.log((c[:, 1:] + strength * rates + 0.01) / (n + strength + 0.01))
    return np.concatenate((np.log1p(n) / 4, r), 1)


@dataclass
class Model:
    rates: np.ndarray
    strength: float
    prior: float  # log odds of class 1
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None  # inverses of the lower Cholesky factors
    logdets: tuple[float, float] | None = None

    def log_odds(self, c: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        if self.means is None:
            return np.full(len(c), self.prior)
        x = features(c, self.rates, self.strength) if x is None else x
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return density[1] - density[0] + self.prior

    def score(self, c: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(c), -700, 700)))  # what exp can hold


def fit(sums: np.ndarray, rates: np.ndarray, strength: float, pooled: float, diagonal: float) -> Model:
    """From each class's number of rows, sums and outer products of features: a row a class."""
    bad, good = sums[:, 0]
    prior = float(np.log((good + 1) / (bad + 1)))
    if min(good, bad) < 2:
        return Model(rates, strength, prior)
    d = 1 + len(COUNTS)
    means = [s[1 : 1 + d] / s[0] for s in sums]
    covs = [(s[1 + d :].reshape(d, d) - s[0] * np.outer(m, m)) / (s[0] - 1) for s, m in zip(sums, means, strict=True)]
    both = (bad * covs[0] + good * covs[1]) / (bad + good)
    factors, logdets = [], []
    for v in covs:
        v = (1 - pooled) * v + pooled * both
        v = (1 - diagonal) * v + diagonal * np.diag(np.diag(v)) + 1e-4 * np.eye(d)
        low = np.linalg.cholesky(v)
        factors.append(np.linalg.inv(low))
        logdets.append(float(2 * np.log(np.diag(low)).sum()))
    return Model(rates, strength, prior, tuple(means), tuple(factors), tuple(logdets))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and c (``counts`` of the whole text) of every row."""
    every = F.pandas_udf(lambda s: pd.Series([np.array(counts(t), float) for t in s]), "array<double>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), every(F.col("text").cast("string")).alias("c"))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0).flatten().to_numpy().reshape(-1, 1 + len(COUNTS)), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _sums(rows: DataFrame, rates: np.ndarray) -> np.ndarray:
    """(strength, fold, class, 1 + d + d * d): numbers, sums and outer products of features."""
    shape = (len(STRENGTHS), FOLDS, 2, 1 + (1 + len(COUNTS)) * (2 + len(COUNTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros(shape), False
        for batch in batches:
            c, y, fold = _rows(batch)
            for i, strength in enumerate(STRENGTHS):
                x = features(c, rates, strength)
                for k in np.unique(fold):
                    for label in (0, 1):
                        own = x[(fold == k) & (y == label)]
                        out[i, k, label] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "v"])

    total = np.zeros(shape)
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row for each place
        total.flat[r["at"]] = r["v"]
    return total


def _losses(rows: DataFrame, models: list[list[Model]]) -> np.ndarray:
    """Log loss of each candidate over the rows of each fold, by the model fitted without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(models))
        for batch in batches:
            c, y, fold = _rows(batch)
            for k in np.unique(fold):
                own, sign = c[fold == k], np.where(y[fold == k] == 1, -1.0, 1.0)
                x = {s: features(own, models[0][0].rates, s) for s in STRENGTHS}
                for i, of_fold in enumerate(models):
                    out[i] += np.logaddexp(0, sign * of_fold[k].log_odds(own, x[of_fold[k].strength])).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["at", "v"])

    total = np.zeros(len(models))
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row for each candidate
        total[r["at"]] = r["v"]
    return total


def train(measured: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows of ``measured`` (of ``counted``) that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = staged(measured.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(usable, "doc_id").select("c", "quality", fold), "labelled")
    classes = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(1 + len(COUNTS))]).collect()}
    own = classes.get(1) or classes.get(0)
    total = np.array([own[f"c{i}"] for i in range(1 + len(COUNTS))]) if own else np.zeros(1 + len(COUNTS))
    rates = total[1:] / max(1.0, total[0])
    sums = _sums(rows, rates)
    every = sums.sum(1)
    fits = [[fit(every[i] - sums[i, k], rates, s, p, d) for k in range(FOLDS)] for i, s in enumerate(STRENGTHS) for p, d in product(POOLED, DIAGONAL)]
    best = int(np.argmin(_losses(rows, fits)))
    strength, pooled, diagonal = GRID[best]
    return fit(every[STRENGTHS.index(strength)], rates, strength, pooled, diagonal)


def score_of(c: Column, model: Model) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows) if len(rows) else np.zeros((0, 1 + len(COUNTS)))))

    return F.pandas_udf(run, "double")(c)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([counts(t) for t in texts], float).reshape(-1, 1 + len(COUNTS))))

    return docs.withColumn(column, F.pandas_udf(run, "double")(F.col("text").cast("string")))
