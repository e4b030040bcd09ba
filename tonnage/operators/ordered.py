"""Ranks, running totals and exact quantiles that never gather a group in one task.

A window over a hot group (or over no group at all) would pull it into a single task. Here the
order column is first cut into ranges of about equal row count; windows run inside
(group, range) cells, and a small table with one row per cell carries the totals of the earlier
ranges. Rows that tie on the order value are collapsed or cut again on the tie-break key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonnage.functions.scalar import epoch_micros, null_safe_join
from tonnage.sources.scratch import written

#: Types whose order codes differ wherever their values do; others have a second code for values that share the first.
_LOSSLESS = {"double", "float", "integer", "short", "byte", "date", "boolean"}
_LOWEST = -1.7976931348623157e308
#: Ranges where only some of them are exchanged: a range is then a small share of the rows.
FINE_RANGES = 1000


def range_count(df: DataFrame) -> int:
    """As many ranges as the session uses shuffle partitions: the user's own sizing knob, which follows the data."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _shared_prefix(df: DataFrame, column: str) -> int:
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if row is None or row["lo"] is None:
        return 0
    size = 0
    for a, b in zip(row["lo"], row["hi"]):
        if a != b or ord(a) > 127:
            break
        size += 1
    return size


def order_code(df: DataFrame, column: str) -> Column:
    """A double that never decreases when `column` grows; nulls come first, at minus infinity, and alone there."""
    kind = df.schema[column].dataType.typeName()
    value = F.col(column)
    if kind in ("timestamp", "timestamp_ntz"):
        code = epoch_micros(value).cast("double")
    elif kind == "date":
        code = F.unix_date(value).cast("double")
    elif kind == "string":
        code = _bytes_code(value, _shared_prefix(df, column), 0)
    else:
        code = value.cast("double") + F.lit(0.0)  # one zero
    return F.when(code.isNull(), float("-inf")).otherwise(F.greatest(code, F.lit(_LOWEST)))


def _bytes_code(value: Column, prefix: int, skip: int) -> Column:
    """Six bytes of a string as a number, after `prefix` characters (ASCII) and `skip` bytes."""
    tail = F.hex(F.substring(value, prefix + 1, 1_000_000).cast("binary"))
    return F.conv(F.substring(F.rpad(tail, 2 * skip + 12, "0"), 2 * skip + 1, 12), 16, 10).cast("double")


def second_code(df: DataFrame, column: str) -> Column | None:
    """A double that never decreases among values of one order code; None where one code means one value."""
    kind = df.schema[column].dataType.typeName()
    value = F.col(column)
    if kind in _LOSSLESS:
        return None
    if kind == "string":
        code = _bytes_code(value, _shared_prefix(df, column), 6)
    elif kind == "decimal":
        code = F.try_subtract(value, value.cast("double").try_cast(df.schema[column].dataType)).cast("double")
    else:
        whole = epoch_micros(value) if kind in ("timestamp", "timestamp_ntz") else value
        code = (whole.cast("decimal(38,0)") - whole.cast("double").cast("decimal(38,0)")).cast("double")
    return F.coalesce(code, F.lit(float("-inf")))


def _splits(df: DataFrame, code: Column, parts: int, isolate_heavy: bool) -> tuple[list[float], set[int]]:
    """Range borders (a bounded driver-side list) and the ranges that hold one heavy value only."""
    sample = df.select(code.alias("c"))
    points = sample.approxQuantile("c", [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    heavy = {p for p in points if points.count(p) > 1} if isolate_heavy else set()
    borders = set(points)
    for p in heavy:
        borders.add(math.nextafter(p, math.inf))
    inner = sorted(p for p in borders if math.isfinite(p))
    splits = [float("-inf"), *inner, float("inf")]
    return splits, {i for i, s in enumerate(splits[:-1]) if s in heavy}


def _cut(df: DataFrame, code: Column, splits: list[float], out: str) -> DataFrame:
    coded = df.withColumn("__code", code)
    if len(splits) < 3:
        return coded.withColumn(out, F.lit(0)).drop("__code")
    cutter = Bucketizer(splits=splits, inputCol="__code", outputCol="__bin", handleInvalid="keep")
    return cutter.transform(coded).withColumn(out, F.col("__bin").cast("int")).drop("__code", "__bin")


def _cell_join(left: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(left, cells, keys, "inner")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    aggs: Mapping[str, tuple[str, str | Column]],
    descending: bool = False,
    totals: bool = False,
    own: bool = False,
    parts: int | None = None,
    ranges_from: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running aggregates over `order`, one row per distinct (by, order).

    `aggs` maps an output name to (`sum` | `max` | `min`, input). Ties share their value, as in a RANGE
    frame. With `totals`, `<name>_total` carries the whole group's value; with
    `own`, `<name>_own` carries the value of the order point alone. `ranges_from` may name a cheaper frame
    with the order column (a source before its joins) to place the range borders; they only balance the work.
    """
    by = list(by)
    combine = {"sum": F.sum, "max": F.max, "min": F.min}
    inputs = {n: (F.col(c) if isinstance(c, str) else c) for n, (_, c) in aggs.items()}
    points = df.groupBy(*by, order).agg(*[combine[k](inputs[n]).alias(n) for n, (k, _) in aggs.items()])
    code = order_code(df if ranges_from is None else ranges_from, order)
    source = df if ranges_from is None else ranges_from
    splits, _ = _splits(source, code, parts or range_count(df), isolate_heavy=False)
    points = _cut(points, code, splits, "__cell")

    cells = points.groupBy(*by, "__cell").agg(*[combine[k](n).alias(f"__{n}") for n, (k, _) in aggs.items()])
    step = F.col("__cell").desc() if descending else F.col("__cell").asc()
    earlier = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = [combine[k](f"__{n}").over(earlier).alias(f"__before_{n}") for n, (k, _) in aggs.items()]
    extra = [combine[k](f"__{n}").over(whole).alias(f"{n}_total") for n, (k, _) in aggs.items()] if totals else []
    cells = cells.select(*by, "__cell", *carried, *extra)

    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "__cell").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    alone = [F.col(n).alias(f"{n}_own") for n in aggs] if own else []
    local = points.select(*by, order, "__cell", *alone, *[combine[k](n).over(inside).alias(n) for n, (k, _) in aggs.items()])
    joined = _cell_join(local, cells, [*by, "__cell"])

    def merged(name: str, kind: str) -> Column:
        here, before = F.col(name), F.col(f"__before_{name}")
        if kind == "sum":
            return F.coalesce(before + here, here, before)
        return (F.greatest if kind == "max" else F.least)(before, here)

    out = [merged(n, k).alias(n) for n, (k, _) in aggs.items()]
    extras = [f"{n}_total" for n in aggs] if totals else []
    extras += [f"{n}_own" for n in aggs] if own else []
    return joined.select(*by, order, *out, *extras)


def row_numbers(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    tie: str | None = None,
    descending: bool = False,
    name: str = "row_number",
    total: str | None = None,
    parts: int | None = None,
    ranges_from: DataFrame | None = None,
) -> DataFrame:
    """Exact row numbers per group by (order, tie); `tie` is always ascending."""
    by = list(by)
    cut, cells = _numbered_cells(df, by, order, tie, descending, total, parts, ranges_from)
    return _numbered(cut, cells, by, order, tie, descending, name)


def rows_reached(
    df: DataFrame, order: str, tie: str, reached: Callable[[Column, Column, Column], Column], name: str = "row_number", total: str = "__total", parts: int | None = None
) -> DataFrame:
    """Some rows of the ordering by (order, tie), with their row number and the number of all rows.

    `reached(first, rows, all)` tells whether `rows` rows after the first `first` of `all` hold a wanted one; it is asked of cells, then of single
    rows. Only rows of the cells it names are exchanged and numbered."""
    cut, cells = _numbered_cells(df, [], order, tie, False, total, parts or max(range_count(df), FINE_RANGES), None)
    # written, so that the few cells are known to be few before any row moves
    wanted = written(cells.filter(reached(F.col("__before"), F.col("__held"), F.col(total))), "cells")
    near = _cell_join(cut, wanted.select("__cell", "__mid", "__sub"), ["__cell", "__mid", "__sub"])
    numbered = _numbered(near, wanted, [], order, tie, False, name)
    return numbered.filter(reached(F.col(name) - 1, F.lit(1), F.col(total)))


def _numbered_cells(
    df: DataFrame, by: list[str], order: str, tie: str | None, descending: bool, total: str | None, parts: int | None, ranges_from: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Rows with the cell they lie in, and the cells with the rows they hold and those before them."""
    parts = parts or range_count(df)
    source = df if ranges_from is None else ranges_from
    code = order_code(source, order)
    finer = second_code(source, order)
    splits, heavy = _splits(source, code, parts, isolate_heavy=bool(tie) or finer is not None)
    cut = _cut(df, code, splits, "__cell").withColumns({"__mid": F.lit(0), "__sub": F.lit(0)})
    if heavy:
        # a heavy code is cut again: by what tells its values apart, then, where one value is left, by the tie-break key
        one_value = F.col("__cell").isin(*heavy)
        if finer is not None:
            crowded = source.withColumn("__c", code)
            crowded = _cut(crowded, F.col("__c"), splits, "__cell").filter(one_value)
            mid_splits, single = _splits(crowded, finer, parts, isolate_heavy=bool(tie))
            cut = _cut(cut.drop("__mid"), finer, mid_splits, "__mid").withColumn("__mid", F.when(one_value, F.col("__mid")).otherwise(0))
            same = F.col(order).isNull()
            if single and df.schema[order].dataType.typeName() != "string":  # a residual and its code make one value
                same = same | F.col("__mid").isin(*single)
            one_value = one_value & same
        if tie:
            tie_code = order_code(source, tie)
            tie_splits, _ = _splits(source, tie_code, parts, isolate_heavy=False)
            cut = _cut(cut.drop("__sub"), tie_code, tie_splits, "__sub")
            cut = cut.withColumn("__sub", F.when(one_value, F.col("__sub")).otherwise(0))

    cells = cut.groupBy(*by, "__cell", "__mid", "__sub").agg(F.count(F.lit(1)).alias("__held"))
    step = [F.col(c).desc() if descending else F.col(c).asc() for c in ("__cell", "__mid")]
    earlier = Window.partitionBy(*by).orderBy(*step, "__sub").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("__held").over(Window.partitionBy(*by)).alias(total)] if total else []
    cells = cells.select(
        *by, "__cell", "__mid", "__sub", "__held", F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__before"), *extra
    )
    return cut, cells


def _numbered(cut: DataFrame, cells: DataFrame, by: list[str], order: str, tie: str | None, descending: bool, name: str) -> DataFrame:
    """The rows of the cells, numbered."""
    keys = [F.col(order).desc() if descending else F.col(order).asc(), *([F.col(tie).asc()] if tie else [])]
    inside = Window.partitionBy(*by, "__cell", "__mid", "__sub").orderBy(*keys)
    local = cut.withColumn("__rn", F.row_number().over(inside))
    joined = _cell_join(local, cells.drop("__held"), [*by, "__cell", "__mid", "__sub"])
    return joined.withColumn(name, (F.col("__rn") + F.col("__before")).cast("long")).drop(
        "__rn", "__before", "__cell", "__mid", "__sub"
    )


def _tile(row: Column, rows: Column, n: int) -> Column:
    """`ntile(n)` of a row number: the first (count mod n) tiles are one row longer."""
    size, longer = F.floor(rows / n), rows % n
    edge = longer * (size + 1)
    low = F.floor((row - 1) / (size + 1))
    high = longer + F.floor((row - 1 - edge) / F.greatest(size, F.lit(1)))
    return (F.when(row <= edge, low).otherwise(high) + 1).cast("int")


def tiles(
    df: DataFrame, by: Sequence[str], order: str, tie: str, n: int, name: str, ranges_from: DataFrame | None = None
) -> DataFrame:
    """`ntile(n)` per group by (order, tie)."""
    numbered = row_numbers(df, by, order, tie, name="__row", total="__rows", ranges_from=ranges_from)
    return numbered.withColumn(name, _tile(F.col("__row"), F.col("__rows"), n)).drop("__row", "__rows")


def tiles_together(
    df: DataFrame, by: Sequence[str], names: Mapping[str, str], tie: str, n: int, ranges_from: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """`ntile(n)` per group by several order columns at once: `names` maps each (double) to the name of its tiles.

    Rows are not exchanged: one histogram of all columns says in which cell (range of values, cut again on the tie-break key where
    one value holds many rows) a tile begins, only the rows of those cells are numbered, and every row is compared with the few
    first rows of its group's tiles. The range borders come from one pass over `ranges_from`."""
    by, columns = list(by), list(names)
    parts = parts or range_count(df)
    source = df if ranges_from is None else ranges_from
    lossy = [c for c in columns if df.schema[c].dataType.typeName() not in _LOSSLESS]
    if lossy:
        raise TypeError(f"order codes of {lossy} may hold several values; use tiles")
    codes = {c: order_code(source, c) for c in columns}
    coded = source.select(*[codes[c].alias(f"__c{i}") for i, c in enumerate(columns)])
    points = coded.approxQuantile([f"__c{i}" for i in range(len(columns))], [k / parts for k in range(1, parts)], 0.5 / parts)
    tie_splits = None
    cut = df.select(*by, *columns, tie)
    for i, (c, at) in enumerate(zip(columns, points, strict=True)):
        heavy = {p for p in at if at.count(p) > 1}
        splits = [float("-inf"), *sorted(p for p in {*at, *(math.nextafter(p, math.inf) for p in heavy)} if math.isfinite(p)), float("inf")]
        cut = _cut(cut, codes[c], splits, f"__cell{i}").withColumn(f"__sub{i}", F.lit(0))
        full = [k for k, s in enumerate(splits[:-1]) if s in heavy]
        if full:
            code = order_code(source, tie)
            tie_splits = tie_splits or _splits(source, code, parts, isolate_heavy=False)[0]
            cut = _cut(cut.drop(f"__sub{i}"), code, tie_splits, f"__sub{i}")
            cut = cut.withColumn(f"__sub{i}", F.when(F.col(f"__cell{i}").isin(*full), F.col(f"__sub{i}")).otherwise(0))
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__cell{i}").alias("cell"), F.col(f"__sub{i}").alias("sub")) for i in range(len(columns))])
    counts = cut.select(*by, F.explode(spots).alias("s")).groupBy(*by, "s").agg(F.count(F.lit(1)).alias("__n")).select(*by, "s.*", "__n")
    group = Window.partitionBy(*by, "i")
    earlier = group.orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "i", "cell", "sub", "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("__rows"))
    # the first row of tile k + 1 by its number in the group, and the cell it lies in
    starts = F.array(*[F.struct(F.lit(k).alias("k"), _tile_start(F.col("__rows"), n, k).alias("at")) for k in range(1, n)])
    starts = counts.withColumn("__s", F.explode(starts)).filter((F.col("__s.at") > F.col("__before")) & (F.col("__s.at") <= F.col("__before") + F.col("__n")))
    starts = written(starts.select(*by, "i", "cell", "sub", F.col("__s.k").alias("k"), (F.col("__s.at") - F.col("__before")).alias("__at")), "starts")
    firsts = None
    for i, c in enumerate(columns):
        cells = starts.filter(F.col("i") == i).select(*by, F.col("cell").alias(f"__cell{i}"), F.col("sub").alias(f"__sub{i}"), "k", "__at")
        own = [*by, f"__cell{i}", f"__sub{i}"]
        numbered = _cell_join(cut.select(*own, c, tie), cells.groupBy(*own).agg(F.collect_list(F.struct("k", "__at")).alias("__starts")), own)
        order = Window.partitionBy(*own).orderBy(c, tie)
        numbered = numbered.withColumns({"__rn": F.row_number().over(order), "__first": F.rank().over(order)}).withColumn("__s", F.explode("__starts"))
        found = numbered.filter(F.col("__rn") == F.col("__s.__at"))
        # equal rows before the first one of a tile stay in the tile below
        found = found.select(*by, F.lit(i).alias("i"), F.col("__s.k").alias("k"), F.struct(F.struct(F.col(c).alias("v"), F.col(tie).alias("t")).alias("row"), (F.col("__rn") - F.col("__first")).alias("below")).alias("b"))
        firsts = found if firsts is None else firsts.unionByName(found)
    firsts = written(firsts, "firsts")
    shared = firsts.filter("b.below > 0").isEmpty()
    marks = {(i, k): f"__b{i}_{k}" for i in range(len(columns)) for k in range(1, n)}
    wide = firsts.groupBy(*by).agg(*[F.max(F.when((F.col("i") == i) & (F.col("k") == k), F.col("b"))).alias(b) for (i, k), b in marks.items()])
    out = null_safe_join(df, wide, by, "left") if by else df.crossJoin(wide)
    for i, c in enumerate(columns):
        row = F.struct(F.col(c).alias("v"), F.col(tie).alias("t"))
        if not shared:
            split = [F.coalesce((F.col(f"{marks[i, k]}.below") > 0) & (F.col(f"{marks[i, k]}.row") == row), F.lit(False)) for k in range(1, n)]
            out = out.withColumn("__split", reduce(or_, split))
            equal = Window.partitionBy(*by, c, tie).orderBy(c)
            some = out.filter("__split").withColumn("__at", F.row_number().over(equal))
            out = out.filter("NOT __split").withColumn("__at", F.lit(1)).unionByName(some).drop("__split")
        at = F.lit(1) if shared else F.col("__at")
        tile = F.lit(1)
        for k in range(1, n):
            first = F.col(marks[i, k])
            tile = tile + F.when((row > first["row"]) | ((row == first["row"]) & (at > first["below"])), 1).otherwise(0)
        out = out.withColumn(names[c], tile).drop("__at")
    return out.drop(*marks.values())


def _tile_start(rows: Column, n: int, k: int) -> Column:
    """Number of the first row of tile k + 1 of `ntile(n)`, above `rows` where there is no such tile."""
    return F.lit(k) * F.floor(rows / n) + F.least(F.lit(k), rows % n) + 1


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct (by, value) with the mean rank of its ties and the number of tied rows."""
    ranked = running(df, by, value, {"__upto": ("sum", F.lit(1))}, own=True)
    mean = F.col("__upto") - (F.col("__upto_own") - 1) / F.lit(2.0)
    return ranked.select(*by, value, mean.alias(name), F.col("__upto_own").alias(f"{name}_ties"))


def average_ranks_together(df: DataFrame, names: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """`df` with the mean rank that each value has among its ties, in several columns without nulls; `names` maps each to the name of its ranks.

    One histogram of all columns ranks every value that fills a cell alone, so a column of few values needs no exchange. For any other
    the rows are exchanged once, by cell, and ranked there."""
    columns = list(names)
    parts = parts or max(range_count(df), FINE_RANGES)
    codes = {c: order_code(df, c) for c in columns}
    coded = df.select(*[codes[c].alias(f"__c{i}") for i, c in enumerate(columns)])
    points = coded.approxQuantile([f"__c{i}" for i in range(len(columns))], [k / parts for k in range(1, parts)], 0.5 / parts)
    borders, alone, cut = [], F.lit(False), df
    for i, (c, at) in enumerate(zip(columns, points, strict=True)):
        seen = Counter(at) if df.schema[c].dataType.typeName() in _LOSSLESS else {}
        heavy = {p for p, n in seen.items() if n > 1 and math.isfinite(p)}
        inner = sorted(p for p in {*at, *(math.nextafter(p, math.inf) for p in heavy)} if math.isfinite(p))
        borders.append([float("-inf"), *inner, float("inf")])
        cut = _cut(cut, codes[c], borders[i], f"__cell{i}")
        full = [k for k, s in enumerate(borders[i][:-1]) if s in heavy]
        alone = alone | ((F.col("i") == i) & F.col("cell").isin(full)) if full else alone
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__cell{i}").alias("cell")) for i in range(len(columns))])
    cells = cut.select(F.explode(spots).alias("s")).groupBy("s.i", "s.cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.select("i", "cell", "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), alone.alias("__alone")), "cells")
    mixed = {r["i"] for r in cells.filter("NOT __alone").select("i").distinct().collect()}
    out = df
    for i, c in enumerate(columns):
        mine = cells.filter(F.col("i") == i).select(F.col("cell").alias("__cell"), "__n", "__before", "__alone")
        out = _cut(out, codes[c], borders[i], "__cell").join(mine, "__cell")
        rank = F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)
        if i in mixed:
            # rows of a value that fills its cell need no neighbours, so they are spread
            out = out.withColumn("__spread", F.when(F.col("__alone"), F.pmod(F.xxhash64(*df.columns), F.lit(parts))).otherwise(0))
            inside = Window.partitionBy("__cell", "__spread").orderBy(c)
            upto = F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            out = out.withColumns({"__first": F.rank().over(inside), "__upto": upto})
            rank = F.when(F.col("__alone"), rank).otherwise(F.col("__before") + (F.col("__first") + F.col("__upto")) / F.lit(2.0))
        out = out.withColumn(names[c], rank).drop("__cell", "__n", "__before", "__alone", "__spread", "__first", "__upto")
    return out


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], kind: str = "cont", parts: int | None = None,
    ranges_from: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles per group, one column per entry of `quantiles`.

    A histogram over value ranges finds the ranges that hold the wanted ranks; only those ranges are then
    counted value by value, so nearly all rows leave the job at the map-side histogram.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    source = rows if ranges_from is None else ranges_from.select(F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    splits, _ = _splits(source, F.col("__v"), parts or range_count(df), isolate_heavy=True)
    rows = _cut(rows, F.col("__v"), splits, "__cell")

    hist = rows.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(
        *by,
        "__cell",
        "__n",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__total"),
    )
    wanted = []
    for q in quantiles.values():
        if kind == "disc":
            position = F.greatest(F.ceil(F.lit(float(q)) * F.col("__total")) - 1, F.lit(0))
            wanted += [position, position]
        else:
            position = F.lit(float(q)) * (F.col("__total") - 1)
            wanted += [F.floor(position), F.ceil(position)]
    inside = [(w >= F.col("__before")) & (w < F.col("__before") + F.col("__n")) for w in wanted]
    keep = inside[0]
    for condition in inside[1:]:
        keep = keep | condition
    targets = hist.filter(keep).select(*by, "__cell", "__before", "__total")

    hit = _cell_join(rows, targets, [*by, "__cell"])
    counted = hit.groupBy(*by, "__cell", "__before", "__total", "__v").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("__last", F.col("__before") + F.sum("__n").over(upto) - 1)

    def at(position: Column) -> Column:
        here = (position <= F.col("__last")) & (position > F.col("__last") - F.col("__n"))
        return F.max(F.when(here, F.col("__v")))

    aggs = []
    for i, (name, q) in enumerate(quantiles.items()):
        aggs += [at(wanted[2 * i]).alias(f"__lo_{i}"), at(wanted[2 * i + 1]).alias(f"__hi_{i}")]
    picked = counted.groupBy(*by).agg(F.max("__total").alias("__total"), *aggs)
    out = []
    for i, (name, q) in enumerate(quantiles.items()):
        low, high = F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        if kind == "disc":
            out.append(low.alias(name))
        else:
            position = F.lit(float(q)) * (F.col("__total") - 1)
            out.append((low + (position - F.floor(position)) * (high - low)).alias(name))
    return picked.select(*by, *out)
