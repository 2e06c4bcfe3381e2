"""Grouping and re-binning: chunks, islands, weighted means, intervals, Hermitian rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

KEYS = ("t", "chan", "ant1", "ant2")


def slots(vis: DataFrame, days: int) -> DataFrame:
    return vis.withColumn("t", F.floor(F.col("tslot") / days))


def rebin_vis(vis: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Weighted means over unflagged samples, weights summed; flags are OR-ed, and cleared where any sample was good."""
    good = F.col("fl") == 0
    w = F.when(good, F.col("w"))
    sums = {c: F.sum(w * F.col(c)) for c in ("re", "im")} | {c: F.sum(F.when(good, F.col(c))) for c in ("mre", "mim")}
    out = vis.groupBy(*keys).agg(*[s.alias(f"_{c}") for c, s in sums.items()], F.coalesce(F.sum(w), F.lit(0.0)).alias("w"), F.count_if(good).alias("n"), F.bit_or("fl").alias("_fl"))
    mean = {c: F.col(f"_{c}") / F.when(F.col("w") != 0, F.col("w")) for c in ("re", "im")} | {c: F.col(f"_{c}") / F.when(F.col("n") > 0, F.col("n")) for c in ("mre", "mim")}
    return out.select(*keys, *[m.alias(c) for c, m in mean.items()], "w", F.when(F.col("n") > 0, 0).otherwise(F.col("_fl")).cast("bigint").alias("fl"))


def good_bins(vis: DataFrame, days: int) -> DataFrame:
    """Unique (t, chan, ant1 < ant2) cells with data."""
    return rebin_vis(slots(vis.where("fl = 0"), days))


def islands(rows: DataFrame, by: list[str], order: list[str], value: str, jump: float) -> DataFrame:
    """island: a new one begins where a value jumps by more than jump against the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.abs(F.col(value) - F.lag(value).over(w)) > jump
    return rows.withColumn("island", F.sum(F.when(step, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def dense_index(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values and their ordinals from 0; the distinct values of an axis are few beside its rows."""
    return rows.select(value).distinct().withColumn("ordinal", F.dense_rank().over(Window.orderBy(value)) - 1)


def hermitian(vis: DataFrame) -> DataFrame:
    """Each baseline from both ends: (q, p) is the conjugate of (p, q), with the cross correlations (1 and 2) swapped."""
    flip = {"ant1": F.col("ant2"), "ant2": F.col("ant1"), "im": -F.col("im"), "mim": -F.col("mim")}
    flip["corr"] = F.col("corr") if "corr" not in vis.columns else F.when(F.col("corr") == 1, 2).when(F.col("corr") == 2, 1).otherwise(F.col("corr")).cast("bigint")
    return vis.where("ant1 <> ant2").unionByName(vis.where("ant1 <> ant2").select(*[flip.get(c, F.col(c)).alias(c) for c in vis.columns]))


def interval(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size)


def complete_grid(vis: DataFrame, ants: int) -> DataFrame:
    """Every (t, ant1 < ant2) of the observed times, and whether it has no row: the grid comes from exploded antenna numbers, the absences from an outer join."""
    have = vis.where("ant1 <> ant2").select("t", "ant1", "ant2").distinct().withColumn("_have", F.lit(True))
    grid = vis.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ants - 2).cast("bigint"))).alias("ant1"))
    grid = grid.select("t", "ant1", F.explode(F.sequence(F.col("ant1") + 1, F.lit(ants - 1).cast("bigint"))).alias("ant2"))
    return grid.join(have, ["t", "ant1", "ant2"], "left").select("t", "ant1", "ant2", F.col("_have").isNull().alias("missing"))


def merged_spans(spans: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Overlapping spans [lo, hi] become one: by, first, last, n."""
    order = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0)
    part = spans.withColumn("_new", begins).withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*by, "_part").agg(F.min(lo).alias("first"), F.max(hi).alias("last"), F.count(F.lit(1)).alias("n")).drop("_part")


def chunks_by_slots(times: DataFrame, by: list[str], time: str, jump: float, slots: int) -> DataFrame:
    """chunk: islands between jumps, cut after so many slots each; times are the distinct ones of an axis."""
    laid = islands(times, by, [time], time, jump)
    place = F.row_number().over(Window.partitionBy(*by, "island").orderBy(time)) - 1
    laid = laid.withColumn("_part", F.floor(place / slots))
    return laid.withColumn("chunk", F.dense_rank().over(Window.partitionBy(*by).orderBy("island", "_part")) - 1).drop("_part", "island")


def following(points: DataFrame, by: list[str], value: str, at: Column, name: str) -> DataFrame:
    """points with name: the smallest value of their group at or above `at`, by one pass over values and questions in descending order."""
    rows = points.select("*", F.lit(True).alias("_point"), F.col(value).alias("_at")).unionByName(points.select("*", F.lit(False).alias("_point"), at.alias("_at")))
    order = Window.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_point")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_point"), F.col("_at")), ignorenulls=True).over(order)
    return rows.withColumn(name, found).where("not _point").drop("_point", "_at")


def orbit(steps: DataFrame, by: list[str], value: str, after: str) -> DataFrame:
    """(by, value): of a group's points the first, the one that its step leads to (after; null ends), and so on. Steps are doubled: each round takes what is reached as far again, so a walk of n
    steps needs log n rounds of joins, and no group is walked in order."""
    reached = written(steps.groupBy(*by).agg(F.min(value).alias(value)), "reached")
    jump = steps.where(F.col(after).isNotNull()).select(*by, value, after)
    while True:
        more = written(reached.join(jump, [*by, value]).select(*by, F.col(after).alias(value)), "reached")
        if more.isEmpty():
            return reached
        reached = written(reached.unionByName(more), "reached")
        far = jump.select(*by, F.col(value).alias(after), F.col(after).alias("_far"))
        jump = written(jump.join(far, [*by, after]).select(*by, value, F.col("_far").alias(after)), "jumps")


def _parts(rows: DataFrame, by: list[str], value: str, starts: DataFrame, name: str) -> DataFrame:
    """rows with name: how many starts lie at or before their value, less one."""
    marked = rows.join(starts.withColumn("_start", F.lit(1)), [*by, value], "left")
    order = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(F.coalesce("_start", F.lit(0))).over(order) - 1).drop("_start")


def chunks_by_length(times: DataFrame, by: list[str], time: str, length: float) -> DataFrame:
    """chunk: a new one begins at the first time that is length or more after the one before began; times are the distinct ones of an axis."""
    if length <= 0:
        raise ValueError("length: above 0")
    axis = written(times.select(*by, time).distinct(), "axis")
    starts = orbit(following(axis, by, time, F.col(time) + length, "_next"), by, time, "_next")
    return _parts(times, by, time, starts, "chunk")


def coarsened(tiles: DataFrame, by: list[str], order: str, n: str, least: int, most: int) -> DataFrame:
    """tiles (in an order; n chunks each, 1 or more) with tile: they are merged one after another while the merged one has no more than least chunks and would have no more than most."""
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    laid = written(tiles.withColumn("_sum", F.sum(n).over(up)), "tiles")
    points = laid.select(*by, "_sum", (F.col("_sum") - F.col(n)).alias("_before"), F.lead("_sum").over(Window.partitionBy(*by).orderBy(order)).alias("_after"))
    # the next start stands behind the first tile with more than least, or is the first one that doesn't fit; sums name tiles
    enough = following(points, by, "_sum", F.col("_before") + least + 1, "_full")
    behind = points.select(*by, F.col("_sum").alias("_full"), F.col("_after").alias("_next1"))
    steps = following(enough.drop("_after"), by, "_sum", F.greatest(F.col("_before") + most + 1, F.col("_sum") + 1), "_next2").join(behind, [*by, "_full"], "left")
    steps = steps.select(*by, "_sum", F.least("_next1", "_next2").alias("_next"))
    return _parts(laid, by, "_sum", orbit(steps, by, "_sum", "_next"), "tile").drop("_sum")


def baselines(ants: DataFrame) -> DataFrame:
    """Of antennas (ant, name, x, y, z), a bounded table: ant1 < ant2, name (both antennas' less the beginning that all have) and length."""
    ends = ants.agg(F.min("name").alias("a"), F.max("name").alias("b"))
    # what the first and the last name begin with, all do
    same = F.filter(F.sequence(F.lit(0), F.length("a")), lambda n: F.substring(F.col("a"), F.lit(1), n) == F.substring(F.col("b"), F.lit(1), n))
    short = ants.join(F.broadcast(ends.select(F.array_max(same).alias("_n")))).withColumn("name", F.substring(F.col("name"), F.col("_n") + 1, F.length("name"))).drop("_n")
    every = short.agg(F.collect_list(F.struct(*[F.col(c).alias(f"{c}2") for c in ("ant", "name", "x", "y", "z")])).alias("_b"))
    pairs = short.join(F.broadcast(every)).select("ant", "name", "x", "y", "z", F.explode("_b").alias("b")).select("*", "b.*").where("ant < ant2")
    d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    return pairs.select(F.col("ant").alias("ant1"), "ant2", F.concat("name", F.lit("-"), "name2").alias("name"), F.sqrt(d2).alias("length"))


def rebin_uvw(vis: DataFrame, keys: tuple[str, ...], axes: tuple[str, ...]) -> DataFrame:
    """Coordinates of merged rows: means over unflagged samples, by their weights; without any, plain means."""
    w = F.when(F.col("fl") == 0, F.col("w"))
    return vis.groupBy(*keys).agg(*[F.coalesce(F.sum(w * F.col(a)) / F.when(F.sum(w) > 0, F.sum(w)), F.avg(a)).alias(a) for a in axes])


def delays(cells: DataFrame, by: list[str], size: int) -> DataFrame:
    """by, delay, power: the delay (in turns over the padded band, size steps of it) at which a spectrum (chan, re, im) adds up most; of equal ones the least. Sums combine before the shuffle."""
    import math

    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("k")
    # spectra of a group are added up first, so rows multiply by the size once a channel
    x = cells.groupBy(*by, "chan").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).select(*by, "chan", "re", "im", k)
    phase = -2 * math.pi * F.col("k") * F.col("chan") / size
    s = x.groupBy(*by, "k").agg(F.sum(F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase)).alias("a"), F.sum(F.col("re") * F.sin(phase) + F.col("im") * F.cos(phase)).alias("b"))
    power = F.round(F.col("a") * F.col("a") + F.col("b") * F.col("b"), 6)
    top = F.max(F.struct(power.alias("power"), (-F.col("k")).alias("k"))).alias("x")
    return s.groupBy(*by).agg(top).select(*by, (-F.col("x.k") / F.lit(float(size))).alias("delay"), F.sqrt("x.power").alias("power"))
