"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so that the fit list (every distinct vector once), its sums and all deviations are exact.
Components come from products V Q of the covariance with a thin block Q. Each product is one pass over the fit list:
every task centres its vectors, multiplies them with Q and back, and sends one small matrix; V itself is never built.

A round filters the block with a Chebyshev polynomial of V, by its three-term recurrence: inside [0, cut], the unwanted
part of the spectrum, the polynomial stays below 1, above it grows with the degree. QR makes the block orthonormal again,
Rayleigh-Ritz turns it to the best eigenvectors inside it, and the least Ritz value of the block is the next cut. The
rounds end when the residuals |V q - e q| certify every wanted component, or do not fall any more (rounding).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Columns of the block beside the wanted ones, degree of a filter, most rounds, and the certified residual (share of the largest eigenvalue).
GUARD, DEGREE, ROUNDS, RESIDUAL = 32, 12, 60, 1e-14
#: Eigenvalues below this share of the largest are rounding: such components do not exist.
RANK = 1e-10
#: Vectors that one row of the packed fit list holds.
PACK = 2048
_LONG = float(1 << 62)


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """`vectors` with __x, their entries as whole numbers; rows go whose vector is null, empty or holds an entry that is null,
    not finite or too large for a long."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LONG / SCALE)
    rows = vectors.withColumn("__c", entries).filter((F.size("__c") > 0) & F.forall("__c", fits))
    return rows.withColumn("__x", F.transform("__c", lambda c: F.when(fits(c), F.floor(SCALE * c).cast("long") + SHIFT))).drop("__c")


@dataclass(frozen=True)
class Fit:
    """What whitening needs: size and sums of the fit list, unit components (as columns), their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def rows_of(batch: pa.Array, width: int) -> np.ndarray:
    return batch.flatten().to_numpy().reshape(len(batch), width)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding: n x - S is exact where it fits a long."""
    if _safe(x, n, sums):
        return (n * x - sums) / float(n)
    return (x - SHIFT).astype(np.float64) - (sums - n * SHIFT).astype(np.float64) / n


def _safe(x: np.ndarray, n: int, sums: np.ndarray) -> bool:
    return not x.size or (float(np.abs(x.astype(np.float64)).max()) * n < _LONG and sums.dtype == np.int64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2, None where one does not fit a long."""
    if _safe(x, n, sums):
        off = n * x - sums
        if (off.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) < _LONG:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


class Passes:
    """The fit list, packed, and sums over it: each call is one distributed pass."""

    def __init__(self, distinct: DataFrame, width: int):
        self.width = width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, PACK):
                    data = rows_of(batch["__x"].slice(low, PACK), width).astype(np.int64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["x"])

        self.packed = written(distinct.mapInArrow(pack, "x binary"), "fit_list")
        counted = distinct.select(F.posexplode("__x").alias("i", "v")).groupBy("i").agg(F.count("v").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
        found = sorted(counted.collect())
        self.n = found[0]["n"]
        sums = [int(r["s"]) for r in found]
        self.sums = np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)

    def total(self, part) -> np.ndarray:
        """Sum of `part`(centred vectors) over the fit list, any fixed shape."""
        n, sums, width = self.n, self.sums, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for data in batch["x"]:
                    own = part(centred(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width), n, sums))
                    found = own if found is None else found + own
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["part"])

        rows = self.packed.mapInArrow(run, "part binary").collect()  # one small matrix per task
        return sum(np.frombuffer(r["part"]) for r in rows)

    def product(self, block: np.ndarray) -> np.ndarray:
        """V Q of the covariance V."""
        return self.total(lambda a: a.T @ (a @ block)).reshape(block.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda a: np.array([(a * a).sum()]))[0]) / self.n


def filtered(passes: Passes, block: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times the block: at most 1 on [0, cut], scaled to 1 at `top`."""
    half = cut / 2
    ratio = half / (half - top)
    first, factor = ratio, 2 / ratio
    before, now = block, (passes.product(block) - half * block) * (ratio / half)
    for _ in range(degree - 1):
        new = 1 / (factor - first)
        before, now = now, 2 * (new / half) * (passes.product(now) - half * now) - (first * new) * before
        first = new
    return now


def components(passes: Passes, wanted: int, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of the covariance and their unit eigenvectors, as columns."""
    size = min(passes.width, wanted + GUARD)
    block = np.linalg.qr(np.random.default_rng(1309).standard_normal((passes.width, size)))[0]
    least = math.inf
    for _ in range(rounds):
        image = passes.product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = max(float(values[0]), 0.0)
        real = values[:wanted] > RANK * top
        miss = float(np.linalg.norm((image - block * values)[:, :wanted], axis=0)[real].max(initial=0.0))
        # certified, or no better than the best before: rounding
        if miss <= RESIDUAL * top or (miss <= 1e3 * RESIDUAL * top and miss > 0.5 * least):
            break
        least = min(least, miss)
        cut = float(values[-1])
        if size < passes.width and cut > RANK * top and cut < top:
            block = filtered(passes, block, cut, top, degree)
        else:  # nothing is left to damp: the block already spans all of the spectrum that is not rounding
            block = image + top * RANK * block
        block = np.linalg.qr(block)[0]
    return values[:wanted][real], block[:, :wanted][:, real]


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> tuple[Fit, float] | None:
    """Fit over the distinct __x of `rows`, all of one length, and the identity error; None without rows."""
    distinct = rows.select("__x").distinct()
    first = rows.select(F.size("__x").alias("d")).first()
    if first is None:
        return None
    passes = Passes(distinct, first["d"])
    values, vectors = components(passes, min(wanted, first["d"]))
    found = Fit(passes.n, passes.sums, vectors, values, passes.trace())
    scaled = vectors / np.sqrt(values)
    mean = passes.total(lambda a: (a @ scaled).sum(axis=0)) / passes.n

    def spread(a: np.ndarray) -> np.ndarray:
        w = a @ scaled - mean
        return w.T @ w

    error = np.abs(passes.total(spread).reshape(len(values), -1) / passes.n - np.eye(len(values))).max() if len(values) else 0.0
    return found, float(error)


def common_length(rows: DataFrame) -> DataFrame:
    """The rows whose __x has the commonest length (of ties the longest); covariance has no meaning across lengths."""
    lengths = rows.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    best = lengths.first()
    return rows.filter(F.size("__x") == (best["d"] if best else 0))


def whitened(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or of another than the commonest length, and those with an entry that is null, not finite or beyond
    what a long holds, are left out. Vectors that occur often weigh once in the fit, and each row gets its own result; a null
    id stays. Components of no variance do not exist, so equal vectors, one vector and an empty table give an empty result.
    Equal eigenvalues leave their components free to turn. A deviation beyond a long is null. Other columns are not read.
    """
    rows = common_length(whole(bound(vectors, key=key, vector=vector), "vector").select("key", "__x"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made = fit(rows, wanted)
    if made is None or not len(made[0].values):
        return rows.sparkSession.createDataFrame([], schema)
    model, error = made
    k, scaled, explained = len(model.values), model.components / np.sqrt(model.values), model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch["__x"], len(model.sums))
            size = len(x)
            columns = [
                batch["key"].take(pa.array(np.repeat(np.arange(size), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, model.n)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                pa.array((centred(x, model.n, model.sums) @ scaled).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
