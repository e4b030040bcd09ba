"""Exact k-th nearest-neighbour distance inside groups, in bounded blocks that are visited only where they can matter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonnage.functions.scalar import null_safe_join
from tonnage.operators.ordered import row_numbers, running
from tonnage.sources.scratch import written

_BITS = 60
#: Blocks of one super-block, whose box is looked at before theirs; lists of distances that one merge takes.
FAN_IN = 64
#: Rows of one run inside a block, skipped or compared as a whole.
RUN = 512


def _pairwise(left: np.ndarray, right: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """k smallest Euclidean distances from each left row, ascending (fewer when right is short)."""
    keep = min(k, len(right))
    out = np.empty((len(left), keep))
    for start in range(0, len(left), chunk):
        part = left[start : start + chunk]
        squared = np.zeros((len(part), len(right)))
        for d in range(part.shape[1]):
            squared += np.square(part[:, d : d + 1] - right[None, :, d])
        nearest = np.partition(squared, keep - 1, axis=1)[:, :keep]
        out[start : start + chunk] = np.sqrt(np.sort(nearest, axis=1))
    return out


def _merge(near: np.ndarray, rows: np.ndarray, more: np.ndarray) -> None:
    near[rows] = np.sort(np.concatenate([near[rows], more], axis=1), axis=1)[:, : near.shape[1]]


def _flat(rows: np.ndarray, middle: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a matrix whose product with that of the other side holds the squared distances; the rows' squared lengths."""
    rows = rows - middle
    squares, ones = np.square(rows).sum(axis=1, keepdims=True), np.ones((len(rows), 1))
    return np.hstack([-2.0 * rows, ones, squares] if left else [rows, squares, ones]).astype(np.float32), squares[:, 0]


def _nearest(points: np.ndarray, support: np.ndarray, k: int, far: np.ndarray, counted: list[int] | None = None) -> np.ndarray:
    """k smallest distances from each point, ascending, filled up with NaN; those beyond the point's bound `far` may be missing.

    Rows are taken in runs. A run of points meets the runs of support from the nearest on, and each point only those
    whose box lies within its bound, which falls with every run. A matrix product in single precision, with room for its
    rounding, tells the pairs that may lie within the bounds; only these are measured, as in `_pairwise`. The order of the
    rows changes no distance; along a curve the boxes are small. `counted` gets the number of pairs in each product.
    """
    near, far = np.full((len(points), k), np.nan), np.where(np.isnan(far), np.inf, far)
    runs = [support[i : i + RUN] for i in range(0, len(support), RUN)]
    low, high = (np.stack([f.reduce(run, axis=0) for run in runs]) for f in (np.fmin, np.fmax))
    slack = 2.4e-7 * (support.shape[1] + 4)
    with np.errstate(all="ignore"):  # pairs that single precision cannot judge are measured
        middle = np.nan_to_num(support).mean(axis=0)
        flats = [_flat(run, middle, False) for run in runs]
        for start in range(0, len(points), RUN):
            mine, bound, best = (x[start : start + RUN] for x in (points, far, near))
            product, lengths = _flat(mine, middle, True)
            centre = mine.mean(axis=0)
            for j in np.argsort(np.square(np.maximum(np.maximum(low - centre, centre - high), 0.0)).sum(axis=1), kind="stable"):
                gap = np.zeros(len(mine))
                for d in range(mine.shape[1]):
                    gap += np.square(np.maximum(np.maximum(low[j, d] - mine[:, d], mine[:, d] - high[j, d]), 0.0))
                reach = np.square(bound) * (1.0 + 1e-12)
                rows = np.flatnonzero(~(gap > reach) & (bound > 0.0))  # below a bound of zero there is nothing
                if not rows.size:
                    continue
                flat, others = flats[j]
                limit = (reach[rows] + slack * (lengths[rows] + others.max()) + 1e-30).astype(np.float32)
                i, c = np.divmod(np.flatnonzero(~(product[rows] @ flat.T > limit[:, None])), len(flat))
                if counted is not None:
                    counted.append(len(rows) * len(flat))
                many = np.bincount(i, minlength=len(rows)) > 8 * k
                if many.any():  # no bound yet, or many rows alike
                    _merge(best, rows[many], _pairwise(mine[rows[many]], runs[j], k))
                    i, c = i[~many[i]], c[~many[i]]
                if i.size:
                    squared = np.zeros(len(i))
                    for d in range(mine.shape[1]):
                        squared += np.square(mine[rows[i], d] - runs[j][c, d])
                    order = np.lexsort((squared, i))
                    found, first, line = np.unique(i[order], return_index=True, return_inverse=True)
                    place = np.arange(len(i)) - first[line]
                    more = np.full((len(found), k), np.nan)
                    more[line[place < k], place[place < k]] = np.sqrt(squared[order][place < k])
                    _merge(best, rows[found], more)
                np.fmin(bound, best[:, k - 1], out=bound)
    return near


def _curve(size: int) -> Column:
    """Place of __v on a Z-order curve over the group's mean and deviation per dimension (__m, __s)."""
    dims = min(size, _BITS)
    bits = max(1, _BITS // dims)
    place = F.lit(0).cast("long")
    for i in range(dims):
        scaled = (F.col("__v")[i] - F.col("__m")[i]) / F.greatest(4.0 * F.col("__s")[i], F.lit(1e-300)) + 0.5
        cell = F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0 - 1e-9)) * (1 << bits)).cast("long")
        for b in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1)), b * dims + i))
    return place


def _boxes(rows: DataFrame, keys: Sequence[str], size: int, prefix: str, extra: Sequence[Column] = ()) -> DataFrame:
    low, high = [F.array(*[f(F.col("__v")[i]) for i in range(size)]) for f in (F.min, F.max)]
    return rows.groupBy(*keys).agg(low.alias(f"{prefix}lo"), high.alias(f"{prefix}hi"), *extra)


def _gap(a: str, b: str) -> Column:
    """Least distance between two boxes."""
    def side(lo: Column, hi: Column) -> Column:
        return F.zip_with(lo, hi, lambda x, y: F.greatest(x - y, F.lit(0.0)))

    apart = F.zip_with(side(F.col(f"{a}lo"), F.col(f"{b}hi")), side(F.col(f"{b}lo"), F.col(f"{a}hi")), lambda x, y: F.greatest(x, y))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda t, g: t + g * g))


def _near(points: DataFrame, support: DataFrame, cell: list[str], by: list[str], key: str, k: int, bounded: bool) -> DataFrame:
    """by, key, __near: up to k ascending distances from each point to the support rows of its cell (with `bounded`, to __far at most)."""
    names = [f"__r_{i}" for i in range(len(cell))]
    fields = T.StructType([*[points.schema[c] for c in (*by, key)], T.StructField("__near", T.ArrayType(T.DoubleType()))])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in fields})
        a, b = a.sort_values("__z"), b.sort_values("__r__z")
        far = a["__far"].to_numpy() if bounded else np.full(len(a), np.inf)
        near = _nearest(np.stack(a["__v"].to_numpy()), np.stack(b["__r__v"].to_numpy()), k, far)[:, : len(b)]
        result = a[[*by, key]].reset_index(drop=True)
        result["__near"] = [row[row <= most] for row, most in zip(near, far, strict=True)] if bounded else list(near)
        return result[result["__near"].map(len) > 0]

    kept = points.select(*cell, *[c for c in (*by, key) if c not in cell], "__v", "__z", *(["__far"] if bounded else []))
    # fresh names keep the two sides apart when points and support come from one frame
    opposite = support.select(*[F.col(c).alias(n) for c, n in zip(cell, names, strict=True)], F.col("__v").alias("__r__v"), F.col("__z").alias("__r__z"))
    return kept.groupBy(*cell).cogroup(opposite.groupBy(*names)).applyInPandas(compare, fields)


def knn_distance(
    points: DataFrame, support: DataFrame, by: Sequence[str], key: str, support_key: str, vector: str, k: int | Mapping[str, int], out: str = "distance", block_rows: int = 16384,
    visited: list[int] | None = None,
) -> DataFrame:
    """by, key, `out`: distance of each point to its k-th nearest support row of the same group, written once.

    With column names and their k in place of k, one search gives all of these columns.
    Support rows are ranked along a Z-order curve and cut into blocks of `block_rows`, each with its box. A point first meets
    the block at its own place on the curve, which bounds its k-th distance from above; after that a block of points meets
    only the blocks whose box lies within the bound of one of its points (boxes of FAN_IN blocks are tried first). A task
    compares one block with one block, run by run, and emits up to k distances a point; these lists are merged FAN_IN at a time.
    Null when the group has fewer than k support rows. `visited` gets the number of block pairs compared after the first.
    """
    by, wanted = list(by), dict(k) if isinstance(k, Mapping) else {out: k}
    k = max(wanted.values())
    rows = written(support.select(*by, F.col(support_key).alias("__key"), F.col(vector).alias("__v")), "rows")
    peek = rows.select(F.size("__v").alias("n")).first()
    if peek is None:
        return points.select(*by, key, *[F.lit(None).cast("double").alias(name) for name in wanted]).limit(0)
    size = peek["n"]
    shape = rows.groupBy(*by).agg(
        F.array(*[F.avg(F.col("__v")[i]) for i in range(size)]).alias("__m"), F.array(*[F.stddev_pop(F.col("__v")[i]) for i in range(size)]).alias("__s"), F.count(F.lit(1)).alias("__all")
    )
    shape = written(shape, "shape")
    placed = written(null_safe_join(rows, shape, by).withColumn("__z", _curve(size)).drop("__m", "__s"), "placed")
    ranked = row_numbers(placed, by, "__z", "__key", name="__rank")
    blocks = written(ranked.withColumn("__sb", F.floor((F.col("__rank") - 1) / block_rows)).drop("__rank"), "support")
    asked = null_safe_join(points.select(*by, key, F.col(vector).alias("__v")), shape, by).withColumn("__z", _curve(size)).drop("__m", "__s")
    asked = written(asked, "asked")
    # a point's own block: as many support rows stand before its place on the curve
    steps = placed.select(*by, "__z", F.lit(1).alias("__one")).unionByName(asked.select(*by, "__z", F.lit(0).alias("__one")))
    before = running(steps, by, "__z", {"__upto": ("sum", "__one")}, ranges_from=placed)
    asked = null_safe_join(asked, before, [*by, "__z"]).withColumn("__sb", F.floor(F.greatest(F.col("__upto") - 1, F.lit(0)) / block_rows))
    cells = asked.groupBy(*by, "__sb").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__parts"))
    asked = null_safe_join(asked, cells, [*by, "__sb"]).withColumn("__pb", F.pmod(F.xxhash64(key), F.col("__parts"))).drop("__upto", "__parts")
    asked = written(asked, "points")
    copies = null_safe_join(blocks.select(*by, "__sb", "__v", "__z"), cells, [*by, "__sb"])
    copies = copies.withColumn("__pb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    own = written(_near(asked, copies, [*by, "__sb", "__pb"], by, key, k, bounded=False), "own")

    far = F.coalesce(F.try_element_at("__near", F.lit(k)), F.lit(float("inf")))
    bounded = null_safe_join(asked, own.select(*by, key, far.alias("__far")), [*by, key], "left").withColumn("__far", F.coalesce("__far", F.lit(float("inf"))))
    mine = [*by, "__sb", "__pb"]
    hulls = _boxes(bounded, mine, size, "__p", [F.max("__far").alias("__reach")])
    boxes = _boxes(blocks, [*by, "__sb"], size, "__b").withColumn("__sup", F.floor(F.col("__sb") / FAN_IN)).withColumnRenamed("__sb", "__other")
    supers = boxes.groupBy(*by, "__sup").agg(*[F.array(*[f(F.col(c)[i]) for i in range(size)]).alias(n) for c, n, f in (("__blo", "__ulo", F.min), ("__bhi", "__uhi", F.max))])
    close = F.lit(1.0 + 1e-12)  # a bound never fails for a rounding
    first = null_safe_join(hulls, supers, by).filter(_gap("__p", "__u") <= F.col("__reach") * close).drop("__ulo", "__uhi")
    pairs = null_safe_join(first, boxes, [*by, "__sup"]).filter((F.col("__other") != F.col("__sb")) & (_gap("__p", "__b") <= F.col("__reach") * close))
    pairs = written(pairs.select(*mine, "__other", "__blo", "__bhi"), "pairs")
    if visited is not None:
        visited.append(pairs.count())
    visitors = null_safe_join(bounded, pairs, mine).withColumns({"__plo": F.col("__v"), "__phi": F.col("__v")})
    visitors = visitors.filter(_gap("__p", "__b") <= F.col("__far") * close).drop("__plo", "__phi", "__blo", "__bhi")
    cell = [*mine, "__other"]
    hosts = null_safe_join(blocks.select(*by, F.col("__sb").alias("__other"), "__v", "__z"), visitors.select(*cell).distinct(), [*by, "__other"])
    more = _near(visitors, hosts, cell, by, key, k, bounded=True)

    lists = own.unionByName(more).withColumn("__slot", F.pmod(F.xxhash64("__near"), F.lit(FAN_IN * FAN_IN)))
    few = F.slice(F.sort_array(F.flatten(F.collect_list("__near"))), 1, k).alias("__near")
    most = pairs.groupBy(*mine).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most >= FAN_IN:  # first merges of a bounded number of lists
        lists = written(lists, "lists").groupBy(*by, key, "__slot").agg(few)
    merged = lists.groupBy(*by, key).agg(few)
    return written(merged.select(*by, key, *[F.try_element_at("__near", F.lit(n)).alias(name) for name, n in wanted.items()]), "distances")
