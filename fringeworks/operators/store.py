"""The solution store: appended slices, last write wins, exact and interpolated look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append(slices: DataFrame, path: str) -> None:
    """Adds slices, laid out by parameter so that a look-up prunes the rest."""
    slices.write.mode("append").partitionBy("param").parquet(path)


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row written of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in log.columns if c not in (*keys, order)]
    return log.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def lookup(grid: DataFrame, solutions: DataFrame, keys: list[str]) -> DataFrame:
    """Values on a grid; masked where the store has none."""
    return grid.join(solutions, keys, "left").withColumn("masked", F.col("value").isNull())


def mismatched(grid: DataFrame, solutions: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(solutions.select(*keys), keys, "left_anti")


def interpolated(targets: DataFrame, solutions: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Linear interpolation along one axis, extrapolated from the two nearest points. Neighbours come from a merged order, not from pairs: for each target the last two
    points at or before it and the first two after."""
    point = solutions.select(*keys, F.col(axis).alias("x"), F.col("value").alias("y"), F.lit(0).alias("ask"))
    ask = targets.select(*keys, F.col(axis).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("ask"))
    # frames run from the beginning only, as a frame to the end is summed anew for each row: what comes after is what came before in the order turned round
    up, down = Window.partitionBy(*keys).orderBy("x", "ask"), Window.partitionBy(*keys).orderBy(F.desc("x"), F.desc("ask"))
    past, so_far = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    laid = point.unionByName(ask).withColumn("p", F.when(F.col("ask") == 0, F.struct("x", "y")))
    last = lambda c, w, frame: F.last(c, ignorenulls=True).over(w.rowsBetween(*frame))
    laid = laid.withColumns({"lo": last("p", up, so_far), "prev": last("p", up, past)})
    laid = laid.withColumn("lo2", last(F.when(F.col("ask") == 0, F.struct(F.col("prev").alias("n"))), up, so_far)["n"])
    laid = laid.withColumns({"hi": last("p", down, past), "next": last("p", down, past)})
    laid = laid.withColumn("hi2", last(F.when(F.col("ask") == 0, F.struct(F.col("next").alias("n"))), down, past)["n"])
    a = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.coalesce("lo2", "lo")).otherwise(F.col("lo"))
    b = F.when(F.col("lo").isNull(), F.coalesce("hi2", "hi")).when(F.col("hi").isNull(), F.col("lo")).otherwise(F.col("hi"))
    laid = laid.where("ask = 1").withColumns({"a": a, "b": b})
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    value = F.when(F.col("a.x") == F.col("b.x"), F.col("a.y")).otherwise(F.col("a.y") + slope * (F.col("x") - F.col("a.x")))
    return laid.select(*keys, F.col("x").alias(axis), value.alias("value"))


def latest_at_or_before(asks: DataFrame, starts: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """asks with the value that began last at or before them; before the first, the first. A merged order of both, never pairs of them."""
    rest = [c for c in asks.columns if c not in (*keys, axis)]
    a = asks.select(*keys, axis, F.struct(*rest).alias("_rest"), F.lit(None).cast(starts.schema[value].dataType).alias(value), F.lit(1).alias("_ask"))
    s = starts.select(*keys, axis, F.lit(None).cast(a.schema["_rest"].dataType).alias("_rest"), value, F.lit(0).alias("_ask"))
    order = Window.partitionBy(*keys).orderBy(axis, "_ask")
    last = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # before the first there is the first of the key, which is one aggregate
    first = F.min_by(value, F.when(F.col("_ask") == 0, F.col(axis))).over(Window.partitionBy(*keys))
    laid = a.unionByName(s).withColumn("_v", F.coalesce(last, first)).where("_ask = 1")
    return laid.select(*keys, axis, "_rest.*", F.col("_v").alias(value))


#: Points of an axis at most, as every slice gets all of them.
MAX_AXIS = 1_000_000


def cube(solutions: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Every slice on the union grid of the axis, absences masked. The grid goes to all tasks as one array, its size checked."""
    points = solutions.select(axis).distinct()
    if points.limit(MAX_AXIS + 1).count() > MAX_AXIS:
        raise ValueError(f"more than {MAX_AXIS} points of {axis}")
    grid = points.agg(F.collect_list(axis).alias("_grid"))
    full = solutions.select(*keys).distinct().join(F.broadcast(grid)).select(*keys, F.explode("_grid").alias(axis))
    return lookup(full, solutions, [*keys, axis])


def norm01(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n: value scaled to [0, 1] within groups; a group of one value gets 0."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    n = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return rows.join(ends, by).withColumn("n", n).drop("_lo", "_hi")


def _neighbours(asks: DataFrame, points: DataFrame, keys: list[str], axis: str, rest: list[str]) -> DataFrame:
    """asks with the points (structs of axis and rest) at or next to their place on the axis, below (_lo) and above (_hi); beyond the ends both are the last point. One merged order, never pairs."""
    shape = F.struct(axis, *rest)
    p = points.select(*keys, F.col(axis).alias("_x"), shape.alias("_p"), F.lit(0).alias("_ask"))
    a = asks.select(*keys, F.col(axis).alias("_x"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_ask"), F.struct(*asks.columns).alias("_row"))
    laid = p.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)).unionByName(a)
    over = lambda way: F.last("_p", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(way, "_ask").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumns({"_below": over(F.col("_x").asc()), "_above": over(F.col("_x").desc())}).where("_ask = 1")
    return laid.select("_row.*", F.coalesce("_below", "_above").alias("_lo"), F.coalesce("_above", "_below").alias("_hi"))


def _between(at: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear between two points, the one's value where they are the same; beyond them, the value at the end."""
    part = F.least(F.greatest((at - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))
    return F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * part)


def interpolated_plane(targets: DataFrame, solutions: DataFrame, keys: list[str], axes: tuple[str, str]) -> DataFrame:
    """Linear interpolation along the first axis on the two lines (of the second axis) that enclose a target, then between these; ends are held outside the grid. Absent points are made up by their
    line's others, absent lines by the next ones; a parameter without any has no value. Merged orders and joins, whatever a plane's size."""
    x, y = axes
    t = targets.select(*keys, x, y).distinct()
    near = _neighbours(t, solutions.select(*keys, y).distinct(), keys, y, [])
    ends = near.select(*keys, x, y, F.col(f"_lo.{y}").alias("_y0"), F.col(f"_hi.{y}").alias("_y1"))
    asks = ends.select(*keys, x, F.col("_y0").alias("_line")).union(ends.select(*keys, x, F.col("_y1").alias("_line"))).where("_line is not null").distinct()
    lines = solutions.select(*keys, F.col(y).alias("_line"), x, "value")
    found = _neighbours(asks, lines, [*keys, "_line"], x, ["value"])
    found = found.select(*keys, x, "_line", _between(F.col(x), F.col(f"_lo.{x}"), F.col(f"_hi.{x}"), F.col("_lo.value"), F.col("_hi.value")).alias("_v"))
    for k in (0, 1):
        ends = ends.join(found.withColumnsRenamed({"_line": f"_y{k}", "_v": f"_v{k}"}), [*keys, x, f"_y{k}"], "left")
    return ends.select(*keys, x, y, _between(F.col(y), F.col("_y0"), F.col("_y1"), F.col("_v0"), F.col("_v1")).alias("value"))
