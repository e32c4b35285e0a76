"""Quality classifier: regularised quadratic discriminant analysis.

Documents become a dozen transformed statistics in one pass over the texts.  Each class
is a Gaussian whose covariance is shrunk towards the pooled one and towards the identity.
The score is the logistic of the difference of the two log densities (and log priors),
each a Mahalanobis distance through a Cholesky factor that is computed once.

Fitting uses every labelled training row: class counts, means and covariances are ordinary
aggregates, so what reaches the driver is two rows, however many labels there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

FEATURES = (
    "log_words", "word_length", "upper", "exclaims", "symbols", "bars", "distinct",
    "doubled", "digits", "stops", "lines", "repeated_lines",
)
#: Shares of the pooled covariance and of the identity in a class's covariance.
POOLED, RIDGE = 0.10, 0.02
#: The contract's fold: rows whose crc32(doc_id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 3, 1
#: The log density difference is divided by this, so that scores keep their order near 0 and 1.
TEMPERATURE = 4.0

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>"


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text: logs of smoothed rates, defined for no words too."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    upper, lower = count(_UPPER), count(_LOWER)
    rate = lambda k, of: np.log((k + 0.5) / (of + 1.0))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return [
        np.log1p(n),
        np.log1p(sum(map(len, words)) / max(n, 1)),
        rate(upper, upper + lower),
        rate(data.count(b"!"), n),
        rate(count(_SYMBOLS), n),
        rate(data.count(b"|"), n),
        len(set(words)) / max(n, 1) ** 0.9,
        rate(sum(map(eq, words, words[1:])), n),
        rate(count(_DIGITS), len(data)),
        rate(count(b".,"), n),
        rate(len(lines), n),
        rate(len(lines) - len(set(lines)), len(lines)),
    ]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def features(docs: DataFrame) -> DataFrame:
    """doc_id and `x`, the statistics, for every row; only doc_id and text are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "x"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {key}, x array<double>")


@dataclass(frozen=True)
class Gaussian:
    log_prior: float
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_prior - 0.5 * ((z * z).sum(axis=1) + self.log_det)


@dataclass(frozen=True)
class Model:
    good: Gaussian | None
    bad: Gaussian | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """With labels of one class only, that class; without any, the undecided 0.5."""
        if self.good is None or self.bad is None:
            only = 0.5 if self.good is None and self.bad is None else float(self.good is not None)
            return np.full(len(x), only)
        margin = (self.good.log_density(x) - self.bad.log_density(x)) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def fit(known: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Fits both classes to (x, quality) rows; rows whose quality isn't 0 or 1 don't count."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    columns = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]]
    columns += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]  # merges centred moments, so it doesn't cancel
    rows = {r["quality"]: r for r in known.where("quality IN (0, 1)").groupBy("quality").agg(*columns).collect()}
    moments = {}
    for label, r in rows.items():
        own = np.zeros((d, d))
        for i, j in pairs:
            own[i, j] = own[j, i] = r[f"c{i}_{j}"]
        moments[label] = r["n"], np.array([r[f"m{i}"] for i in range(d)]), own
    total = sum(n for n, _, _ in moments.values())
    both = sum((n * c for n, _, c in moments.values()), np.zeros((d, d))) / max(total, 1)

    def gaussian(label: int) -> Gaussian | None:
        if label not in moments:
            return None
        n, mean, own = moments[label]
        cov = (1 - pooled - ridge) * own + pooled * both + ridge * np.eye(d)
        lower = np.linalg.cholesky(cov)
        return Gaussian(float(np.log(n / total)), mean, np.linalg.inv(lower), float(2 * np.log(np.diag(lower)).sum()))

    return Model(gaussian(1), gaussian(0))


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of features()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            s = model.scores(x)
            columns = [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    key = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("doc_id", "x").mapInArrow(work, f"doc_id {key}, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """(features of all docs, the model of the labels (doc_id, quality) outside the held-out fold).

    Labels without a document or without a quality don't count, and repeated labels count each.
    """
    vectors = materialise(features(docs), "statistics")
    learnt = labels.select("doc_id", "quality").where(fold(F.col("doc_id")) != HELD_OUT)
    return vectors, fit(vectors.join(learnt, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored like any other, a null id is in the fold of the empty text,
    and repeated rows are scored each (and learnt each, if labelled).  Without labels every score
    is 0.5, with labels of one class only it is that class; an empty table gives an empty result.
    A text's statistics take time linear in its length.  Other columns are ignored.
    """
    vectors, model = train(docs, labels)
    return score(vectors, model).withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text the model predicts to be good: a filter, so that no text is
    shuffled to its verdict."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(v.as_py()) for v in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return docs.mapInArrow(work, docs.schema)


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores over the whole documents table."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
