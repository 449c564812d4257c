"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Every document is reduced to a few bounded statistics.  Class means and covariances come from sums
over the labelled training rows, FIT_ROWS of them at most, aggregated on the executors; only those few hundred numbers reach
the driver.  Covariances are shrunk towards the pooled one and its diagonal, factored once by
Cholesky, and a score is the logistic of the difference of Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, require, words_text

#: Labelled rows that the model is fitted on, about: where there are more, a share of them by hash.
FIT_ROWS = 65_536
FEATURES = ("length", "marks", "upper", "bare", "repeats", "variety")
THRESHOLD = 0.3
#: Share of the pooled covariance in a class covariance, then of its diagonal; least variance.
TO_POOLED = 0.3
TO_DIAGONAL = 0.2
LEAST_VARIANCE = 1e-3
#: Scores keep off 0 and 1 by this log-odds bound.
MOST_LOG_ODDS = 30.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Marks of ordinary prose do not count as junk, nor do digits.
_MARK = ~(_LETTER | _SPACE)
_MARK[[ord(c) for c in "0123456789.,;:'\"-()?"]] = False


def statistics(text: str) -> tuple[float, ...]:
    """The transformed statistics of one text, in the order of FEATURES; an empty text is all zero."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    inked = len(data) - int(counts[_SPACE].sum())
    ascii_letters = int(counts[65:91].sum() + counts[97:123].sum())
    different = set(words)
    same_next = sum(map(eq, words, words[1:]))
    root = lambda part, whole: float(np.sqrt(min(1.0, part / whole))) if whole else 0.0
    unmarked = [w for w in different if not any(map(str.isalnum, w))]
    bare = sum(map(words.count, unmarked)) if len(unmarked) < 8 else sum(map(set(unmarked).__contains__, words))
    # A few marks, bare marks or repeats are ordinary in any text, so they are passed over; capitals
    # beyond one a word count, and distinct words are held against n^0.8, as in running prose.
    return (
        float(np.log1p(n) / 10),
        root(max(0, int(counts[_MARK].sum()) - 4), inked),
        root(max(0, int(counts[_UPPER].sum()) - n), ascii_letters),
        root(max(0, bare - 2), n),
        root(max(0, same_next - 1), n),
        float(min(1.0, (len(different) + 2) / n**0.8)),
    )


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Columns ``keep`` and one double for each of FEATURES, by ``names``; null text counts as empty."""
    require(docs, "text", *keep)
    columns = [*keep, *names]
    if len({c.lower() for c in columns}) < len(columns):
        raise ValueError(f"columns repeat: {columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(rows[:, j].copy()) for j in range(len(FEATURES)))], names=columns)

    schema = docs.select(*keep)
    for name in names:
        schema = schema.withColumn(name, F.lit(0.0).cast("double"))
    return docs.select(*keep, words_text(F.col("text")).alias(free_name(docs, "text"))).mapInArrow(run, schema.schema)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log-density constants; index is the label."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with priors, for rows of statistics."""
        parts = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            parts.append(self.constants[c] - 0.5 * (z * z).sum(axis=1))
        return np.clip(parts[1] - parts[0], -MOST_LOG_ODDS, MOST_LOG_ODDS)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.log_odds(x)))


def fit(labelled: DataFrame, label: str = "label") -> Discriminant:
    """The discriminant from rows of FEATURES and a 0/1 label.

    Rows with any other label are passed over.  A class without rows takes the other's moments, so
    its documents score by the priors alone (add-one counts); no rows at all give a score of 0.5.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{k}") for k, (i, j) in enumerate(pairs)]
    found = {int(r["label"]): r for r in labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *sums).collect()}
    counts = np.array([found[c]["n"] if c in found else 0 for c in (0, 1)], float)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for c, r in found.items():
        means[c] = [r[f"s{i}"] / r["n"] for i in range(d)]
        for k, (i, j) in enumerate(pairs):
            scatter[c, i, j] = scatter[c, j, i] = r[f"q{k}"] - r["n"] * means[c, i] * means[c, j]
    for c in (0, 1):
        if not counts[c]:
            means[c], scatter[c] = means[1 - c], scatter[1 - c]
    weight = np.maximum(counts, 1)
    pooled = scatter.sum(axis=0) / weight.sum()
    whiten, constants = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        own = scatter[c] / weight[c] if counts[c] else pooled
        mixed = (1 - TO_POOLED) * own + TO_POOLED * pooled
        mixed = (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diag(mixed)) + LEAST_VARIANCE * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        whiten[c] = np.linalg.inv(factor)
        constants[c] = np.log((counts[c] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum()
    return Discriminant(means, whiten, constants)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> DataFrame:
    """(fit_id, label) of 0/1 labels of documents that are not held out, ``most`` of them at most, about.

    Where there are more, those stay whose id's hash is under a bound, so a document keeps its place
    in the sample whatever the partitions.
    """
    known = labels.select(F.col("doc_id").alias("fit_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("fit_id").isNotNull() & ~held_out("fit_id"))
    n = known.count()
    return known if n <= most else known.where(F.pmod(F.xxhash64("fit_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """The model fitted on the training labels' documents; only their texts are looked at.

    A document with several labels counts once for each, and each of several rows of one id.
    """
    known = training_labels(labels, label)
    slim = docs.select(F.col("doc_id").alias("fit_id"), "text")
    # FIT_ROWS ids at most: a bounded side
    picked = slim.join(F.broadcast(known), "fit_id").select(F.col("label").alias("fit_label"), "text")
    return fit(materialize(with_statistics(picked, ("fit_label",)), "statistics"), "fit_label")


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep``, held_out, score and predicted for every document.

    The model is fitted on labelled documents that are not held out, FIT_ROWS at most; score is the
    probability of label 1, from the text alone, and predicted is 1 where it is at least
    ``threshold``.  Null and empty texts score as a text without words; texts of any length count
    whole.  Repeated rows each get a row; a null doc_id is scored and not held out.  An empty table
    gives no rows, and without labels every score is 0.5.  Columns not in ``keep`` are ignored; one
    of them named held_out, score or predicted is refused.
    """
    require(labels, "doc_id", label)
    require(docs, "text", *keep)
    names = [*keep, "held_out", "score", "predicted"]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"columns repeat: {names}")
    model = train(docs, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)], float).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    schema = docs.select(*keep, held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.select(*keep, held_out().alias("held_out"), words_text(F.col("text")).alias(free_name(docs, "text"))).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of ``docs``.

    Rows that share a doc_id are decided one by one, by their own text; null and empty texts as a
    text without words.  An empty table gives no rows; extra columns are kept.
    """
    model = train(docs, labels, label)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(place)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
