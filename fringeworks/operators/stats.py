"""Noise, chi-squared, marginals and median-deviation flagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written


def channel_noise(spectra: DataFrame, row: str, chan: str, value: str, by: list[str]) -> DataFrame:
    """Root mean square of differences between adjacent channels, over 4, by groups."""
    w = Window.partitionBy(row).orderBy(chan)
    d = spectra.withColumn("_d", F.col(value) - F.lag(value).over(w)).where("_d is not null")
    return d.groupBy(*by).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d") / 4) / F.count(F.lit(1))).alias("noise"), F.count(F.lit(1)).alias("n"))


def at_extremes(rows: DataFrame, by: str, arg: str, value: str, place: str) -> DataFrame:
    """by, best, worst: arg where value is largest and where it is smallest in its group; of equal values the row of the least place. Rows without arg or value don't count.
    Extremes are found first, so that places are compared between the rows that have them alone."""
    x = rows.select(by, arg, place, F.when(F.col(arg).isNotNull(), F.col(value)).alias("_v"))
    ends = F.broadcast(x.groupBy(F.col(by).alias("_by")).agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo")))
    x = x.join(ends, F.col(by).eqNullSafe(F.col("_by"))).where("_v = _hi or _v = _lo or _hi is null")
    first = lambda end: F.min_by(arg, F.when(F.col("_v") == F.col(end), F.col(place)))
    return x.groupBy(by).agg(first("_hi").alias("best"), first("_lo").alias("worst"))


def marginals(rows: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates over several groupings in one pass."""
    names = sorted({c for s in sets for c in s})
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*aggregates)


def chi_squared(both: DataFrame) -> DataFrame:
    """Sum and count of squared residuals by (t, ant): each baseline counts for both ends, so rows come from hermitian()."""
    r = F.col("re") - F.col("mre")
    i = F.col("im") - F.col("mim")
    return both.groupBy("t", "ant1").agg(F.sum(r * r + i * i).alias("chi2"), F.count(F.lit(1)).alias("n")).withColumnRenamed("ant1", "ant")


def median_of(column: Column) -> Column:
    """For groups of few values: all distinct ones of a group are held."""
    return F.percentile(column, 0.5)


#: A group's values that are ranked one by one, and parts that a range is cut into before.
RANKED, PARTS = 1_000_000, 1024


def medians(rows: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact medians of groups of any size (the mean of the middle two): by, out. The range that holds the middle is cut into parts, values are counted by part, and the part with the middle
    is the next range, until no group has more than RANKED values in it; these are ranked. All counts combine before the shuffle, and no buffer grows with a group."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), F.lit(0).alias("_one"))
    key = [*by, "_one"]
    span = rows.groupBy(*key).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_m"))
    span = span.withColumns({"_below": F.lit(0).cast("bigint"), "_k": F.floor((F.col("_m") - 1) / 2), "_j": F.floor(F.col("_m") / 2)})
    within = lambda: rows.join(span, key).where("_x between _lo and _hi")
    while ((most := span.where("_lo < _hi").agg(F.max("_m")).first()[0]) or 0) > RANKED:
        part = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))
        counts = within().where("_lo < _hi").withColumn("_part", part).groupBy(*key, "_part", "_below", "_k", "_j").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_m"))
        before = F.col("_below") + F.sum("_m").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
        held = counts.withColumn("_from", before).where("_from <= _j and _from + _m > _k")
        fresh = held.groupBy(*key, "_k", "_j").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_m").alias("_m"), F.min("_from").alias("_below"))
        span = written(fresh.unionByName(span.where("_lo = _hi").select(fresh.columns)), "spans")
    ranked = within().where("_lo < _hi").withColumn("_at", F.col("_below") + F.row_number().over(Window.partitionBy(*key).orderBy("_x")) - 1)
    middle = ranked.where("_at = _k or _at = _j").groupBy(*key).agg(F.avg("_x").alias(out))
    return middle.unionByName(span.where("_lo = _hi").select(*key, F.col("_lo").alias(out))).drop("_one")


def mad_by_baseline(res: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median absolute residual by baseline (and more); zeros and flagged samples don't count."""
    return medians(res.where("fl = 0 and absres <> 0"), ["ant1", "ant2", *(by or [])], "absres", "mad")


def mad_flags(res: DataFrame, threshold: float, global_threshold: float, bit: int) -> DataFrame:
    """Two stages: residuals above threshold * MAD / 1.4826 of their baseline, then above global_threshold * median MAD / 1.4826. The baselines' table is bounded by
    the square of the antennas."""
    mad = mad_by_baseline(res)
    mid = mad.agg(median_of(F.col("mad")).alias("mmad"))
    joined = res.join(F.broadcast(mad), ["ant1", "ant2"], "left").join(F.broadcast(mid))
    over = (F.col("fl") == 0) & ((F.col("absres") > threshold / 1.4826 * F.col("mad")) | (F.col("absres") > global_threshold / 1.4826 * F.col("mmad")))
    return joined.withColumn("fl", F.when(over, F.col("fl").bitwiseOR(F.lit(bit))).otherwise(F.col("fl")))


def dense_flags(rows: DataFrame, flag: str, by: list[str], fraction: float) -> DataFrame:
    """Whole groups go where more than a fraction of them is flagged; counted per group and joined back, so no group has to fit in one task."""
    share = rows.groupBy(*by).agg((F.count_if(F.col(flag)) / F.count(F.lit(1))).alias("_share"))
    return rows.join(share, by).withColumn(flag, F.col(flag) | (F.col("_share") > fraction)).drop("_share")


def channel_differences(cells: DataFrame) -> DataFrame:
    """p: a quarter of the squared difference to the channel below, for unflagged samples (t, chan, ant1, ant2) next to one another."""
    w = Window.partitionBy("t", "ant1", "ant2").orderBy("chan")
    below = lambda c: F.lag(c).over(w)
    d = cells.withColumns({"_r": F.col("re") - below("re"), "_i": F.col("im") - below("im"), "_next": (F.col("chan") - below("chan") == 1) & (F.col("fl") == 0) & (below("fl") == 0)})
    return d.where("_next").withColumn("p", (F.col("_r") * F.col("_r") + F.col("_i") * F.col("_i")) / 4).drop("_r", "_i", "_next")


def inverse_variance(cells: DataFrame) -> DataFrame:
    """chan, inv: 1 over the noise's variance by channel; the first channel has the second's."""
    v = channel_differences(cells).groupBy("chan").agg((F.count(F.lit(1)) / F.sum("p")).alias("inv"))
    return v.unionByName(v.where("chan = 1").withColumn("chan", F.lit(0).cast("bigint")))


def local_medians(baselines: DataFrame, share: float = 0.2) -> DataFrame:
    """ant1, ant2, local: median of mad over the other baselines of a length within a share. Lengths meet in steps of their logarithm, each in its own and both next ones."""
    import math

    step = F.floor(F.log("length") / math.log(1 / (1 - share)))
    a = baselines.select("ant1", "ant2", F.col("length").alias("own"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    b = baselines.select(step.alias("step"), "length", F.col("ant1").alias("b1"), F.col("ant2").alias("b2"), "mad")
    near = a.join(b, "step").where((F.col("length") > (1 - share) * F.col("own")) & (F.col("length") < (1 + share) * F.col("own")) & ~((F.col("ant1") == F.col("b1")) & (F.col("ant2") == F.col("b2"))))
    return near.groupBy("ant1", "ant2").agg(median_of(F.col("mad")).alias("local"))
