"""Quality of whole texts by a regularised quadratic discriminant.

1. Every text becomes a short vector of statistics (word lengths, shares of capitals, symbols, digits, repeated and
   distinct words, ...): square roots of shares, logarithms of sizes, so that a class is roughly normal in them.
2. Each class of the labelled rows gets its mean and covariance, from moments that are summed per task and then over all
   tasks: all rows teach, and only a few hundred sums reach the driver. A covariance is shrunk towards the pooled one, and
   both towards their diagonal and a floor, so that a class with few rows or a constant statistic still has a density.
3. The Cholesky factor of each class is computed once and sent with the model. A score is the posterior of the good class:
   the difference of the classes' log densities, with Mahalanobis distances from triangular solves, and the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, slices, words, written

#: Share of the pooled covariance, and of the diagonal, in a class covariance; the least variance of a statistic.
POOLED, DIAGONAL, FLOOR = 0.1, 0.05, 1e-4
#: Words (or letters, bytes) without the feature that every share counts beside its own, so that short texts aren't extreme.
EMPTY = 8
THRESHOLD = 0.3
STATISTICS = (
    "log words", "log bytes per word", "spread of word length", "capitals", "capitals at word starts", "digits", "full stops and commas",
    "other symbols", "symbols at word ends", "words of symbols only", "lines", "words equal to the word before", "commonest word", "distinct words",
    "bytes beyond ASCII",
)
_CAPITAL, _LETTER, _DIGIT, _STOP, _SYMBOL, _SPACE, _HIGH = range(7)


def _kinds() -> np.ndarray:
    kind = np.full(256, _SYMBOL, np.uint8)
    kind[0:33] = _SPACE
    kind[48:58] = _DIGIT
    kind[65:91] = _CAPITAL
    kind[97:123] = _LETTER
    kind[[ord("."), ord(",")]] = _STOP
    kind[128:] = _HIGH
    return kind


KINDS = _kinds()


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.append(0, np.cumsum(values, dtype=np.float64))
    return total[offsets[1:]] - total[offsets[:-1]]


def measured(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros only."""
    n = len(offsets) - 1
    hashes, counts, starts, ends = words(raw, offsets, "spaced", spans=True)
    kind = KINDS[raw]
    n_words, n_bytes = np.diff(counts).astype(np.float64), np.diff(offsets).astype(np.float64)
    per_word = np.maximum(n_words, 1)
    of = [_per_text(kind == k, offsets) for k in range(7)]
    size = (ends - starts).astype(np.float64)
    mean = _per_text(size, counts) / per_word
    spread = np.maximum(_per_text(size * size, counts) / per_word - mean * mean, 0)
    marks = np.append(0, np.cumsum((kind == _SYMBOL) | (kind == _STOP)))
    bare = marks[ends] - marks[starts] == size
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[counts[:-1][counts[:-1] < len(hashes)]] = False  # a text's first word has no word before it
    text = np.repeat(np.arange(n), np.diff(counts))
    order = np.lexsort((hashes, text))
    ordered, owner = hashes[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(order)))
    most, distinct = np.zeros(n), np.zeros(n)
    np.maximum.at(most, owner[heads], times)
    np.add.at(distinct, owner[heads], 1)
    share = lambda part, whole: np.sqrt(part / (whole + EMPTY))
    return np.column_stack([
        np.log1p(n_words), np.log1p(mean), np.log1p(spread), share(of[_CAPITAL], of[_CAPITAL] + of[_LETTER]), share(_per_text(kind[starts] == _CAPITAL, counts), n_words),
        share(of[_DIGIT], n_bytes), share(of[_STOP], n_words), np.log1p(of[_SYMBOL] / (n_words + EMPTY)), share(_per_text((kind[ends - 1] == _SYMBOL) & ~bare, counts), n_words),
        share(_per_text(bare, counts), n_words), share(_per_text(raw == 10, offsets), n_words), share(_per_text(same, counts), n_words), share(most, n_words),
        np.log1p(distinct) / np.maximum(np.log1p(n_words), 1e-9), share(of[_HIGH], n_bytes),
    ])


def with_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with __statistics, an array of doubles in the order of STATISTICS. Null is the empty text."""

    @F.arrow_udf("array<double>")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            parts = [measured(raw, offsets) for _, _, raw, offsets in slices(array)]
            rows = np.concatenate([np.zeros((0, len(STATISTICS))), *parts])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))

    return documents.withColumn("__statistics", measure(F.col(f"`{text}`")))


def matrix(arrays: pa.Array, width: int = len(STATISTICS)) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), width)


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, Cholesky factor of the shrunk covariance, its log determinant and the log prior."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    priors: list[float]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, logdet, prior in zip(self.means, self.factors, self.logdets, self.priors, strict=True):
            z = np.linalg.solve(factor, (rows - mean).T)
            density.append(prior - 0.5 * (logdet + np.einsum("ij,ij->j", z, z)))
        return density[1] - density[0]


def moments(taught: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of __statistics per class `label` (0, 1)."""
    width = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            rows, label = matrix(batch["__statistics"]), batch["label"].to_numpy()
            for c in (0, 1):
                own = rows[label == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist())], ["label", "sums"])

    partial = taught.select("label", "__statistics").mapInArrow(add, "label int, sums array<double>")
    total = partial.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in (0, 1):
        flat = np.zeros(1 + width + width * width)
        for r in total:
            if r["label"] == c:
                flat[r["at"]] = r["v"]
        out[c] = (flat[0], flat[1 : 1 + width], flat[1 + width :].reshape(width, width))
    return out


def fit(measured_rows: DataFrame, labels: DataFrame, column: str = "quality") -> Discriminant | float:
    """The discriminant of `labels.column` over all rows of `measured_rows` (doc_id, __statistics) that it covers.

    Several label rows of a document are averaged; null ids and null labels teach nothing. Where a class has no row, the smoothed
    share of class 1 (1/2 without any label) takes the discriminant's place."""
    known = bound(labels, doc_id="doc_id", label=column).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sums = moments(measured_rows.join(known, "doc_id"))
    sizes = {c: sums[c][0] for c in (0, 1)}
    if not min(sizes.values()):
        return (sizes[1] + 1) / (sizes[0] + sizes[1] + 2)
    means = {c: sums[c][1] / sizes[c] for c in (0, 1)}
    spreads = {c: sums[c][2] / sizes[c] - np.outer(means[c], means[c]) for c in (0, 1)}
    pooled = sum(sizes[c] * spreads[c] for c in (0, 1)) / sum(sizes.values())
    factors, logdets = [], []
    for c in (0, 1):
        mixed = (1 - POOLED) * spreads[c] + POOLED * pooled
        shrunk = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed)) + FLOOR * np.eye(len(mixed))
        factors.append(np.linalg.cholesky(shrunk))
        logdets.append(float(2 * np.log(np.diag(factors[-1])).sum()))
    whole = sum(sizes.values())
    return Discriminant([means[0], means[1]], factors, logdets, [float(np.log(sizes[c] / whole)) for c in (0, 1)])


def scored(measured_rows: DataFrame, model: Discriminant | float) -> DataFrame:
    """`measured_rows` with `score`, the posterior of class 1, instead of __statistics."""
    if isinstance(model, float):
        return measured_rows.withColumn("score", F.lit(model)).drop("__statistics")
    shared = measured_rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def posterior(rows: pa.Array) -> pa.Array:
        odds = shared.value.log_odds(matrix(rows)) if len(rows) else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

    return measured_rows.withColumn("score", posterior("__statistics")).drop("__statistics")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have the statistics of an empty text and a score like any other. Rows of the held-out fifth and rows
    without id teach nothing; the latter are not held out. Rows that repeat an id are scored, and taught, one by one. Without
    labels of both classes every score is the smoothed share of class 1. Empty tables give an empty result.
    """
    rows = written(with_statistics(bound(documents, doc_id="doc_id", text="text")).drop("text"), "statistics")
    taught = rows.filter(~held_out(F.col("doc_id")))
    out = scored(rows, fit(taught, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
