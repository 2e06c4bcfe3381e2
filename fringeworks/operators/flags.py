"""Bitmask algebra on flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FL, FLAG_BITS


def has(mask: int, column: str = "fl") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask)) != 0


def raised(condition: Column, bit: int, column: str = "fl") -> Column:
    """The flags with a bit set where the condition holds; always OR-ed, never assigned."""
    return F.when(condition, F.col(column).bitwiseOR(F.lit(bit))).otherwise(F.col(column))


def apply_bits(vis: DataFrame, mask: int, row_bits: str | None = None) -> DataFrame:
    """PRIOR where a sample's bits, or its row's, meet the mask."""
    return vis.withColumn("fl", raised(has(mask) | has(mask, row_bits) if row_bits else has(mask), FL["PRIOR"]))


def invalid(vis: DataFrame) -> DataFrame:
    """INVALID: data that aren't finite, or exactly zero on a diagonal correlation (0 and 3; where vis has no corr, every sample is one)."""
    odd = lambda c: F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    diagonal = F.col("corr").isin(0, 3) if "corr" in vis.columns else F.lit(True)
    return vis.withColumn("fl", raised(odd("re") | odd("im") | (diagonal & (F.col("re") == 0) & (F.col("im") == 0)), FL["INVALID"]))


def weights(vis: DataFrame) -> DataFrame:
    """INVWGHT: weights that aren't finite; NULLWGHT: zero."""
    bad = F.isnan("w") | (F.abs("w") == float("inf"))
    return vis.withColumn("fl", raised(bad, FL["INVWGHT"])).withColumn("fl", raised(F.col("w") == 0, FL["NULLWGHT"]))


def outside_baselines(vis: DataFrame, low: float, high: float) -> DataFrame:
    """SKIPSOL where the length in the u-v plane lies outside."""
    length2 = F.col("u") * F.col("u") + F.col("v") * F.col("v")
    return vis.withColumn("fl", raised((length2 < low * low) | (length2 > high * high), FL["SKIPSOL"]))


def counts(vis: DataFrame, by: list[str]) -> DataFrame:
    return vis.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("fl") != 0).alias("flagged"))


def categories(vis: DataFrame) -> DataFrame:
    """name, bit, n: samples that carry each category; one pass over the data, whatever the number of categories."""
    sums = vis.agg(*[F.count_if(has(1 << bit)).alias(name) for name, bit in FLAG_BITS.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).cast("bigint").alias("bit"), F.col(n).alias("n")) for n, b in FLAG_BITS.items()])).alias("x")).select("x.*")


def saved(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Flags to store: OR over correlations of all but PRIOR and SKIPSOL."""
    own = F.bit_or("fl").bitwiseAND(F.lit(~(FL["PRIOR"] | FL["SKIPSOL"]) & 0xFFFF))
    return vis.groupBy(*keys).agg(F.bit_or("fl").alias("all_bits"), own.alias("own_bits"), F.bit_and("fl").alias("common_bits"))


def stored(vis: DataFrame, cube: DataFrame, keys: list[str], own: int) -> DataFrame:
    """Rows with column bits: their own bit is cleared, and set again where the cube's flags (keys, fl, over any correlations) have more than PRIOR and SKIPSOL; flag: whether it is set."""
    mask = ~(FL["PRIOR"] | FL["SKIPSOL"]) & 0xFFFF
    new = cube.groupBy(*keys).agg((F.bit_or("fl").bitwiseAND(F.lit(mask)) != 0).alias("_new"))
    out = vis.join(new, keys, "left").withColumn("flag", F.coalesce("_new", F.lit(False)))
    cleared = F.col("bits").bitwiseAND(F.bitwise_not(F.lit(own).cast("bigint")))
    return out.withColumn("bits", F.when(F.col("flag"), cleared.bitwiseOR(F.lit(own).cast("bigint"))).otherwise(cleared)).drop("_new")


def from_gains(vis: DataFrame, gains: DataFrame, bit: int) -> DataFrame:
    """A flagged gain raises a bit on all baselines of its antenna; gains has (t, ant, gflag)."""
    g = gains.where("gflag <> 0").select("t", "ant").distinct()
    p, q = g.select("t", F.col("ant").alias("ant1"), F.lit(True).alias("_p")), g.select("t", F.col("ant").alias("ant2"), F.lit(True).alias("_q"))
    out = vis.join(p, ["t", "ant1"], "left").join(q, ["t", "ant2"], "left")
    return out.withColumn("fl", raised(F.col("_p").isNotNull() | F.col("_q").isNotNull(), bit)).drop("_p", "_q")


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def model_weights(weights: Column, column: str = "fl") -> Column:
    """Flags by an array of models' weights: INVWGHT where any isn't finite, else NULLWGHT where all are zero."""
    odd = F.exists(weights, lambda x: ~_finite(x))
    return F.when(odd, raised(odd, FL["INVWGHT"], column)).otherwise(raised(F.forall(weights, lambda x: x == 0), FL["NULLWGHT"], column))


def models(values: Column, column: str = "fl") -> Column:
    """Flags by an array of models of all directions: INVMODEL where any isn't finite, or all are zero."""
    return raised(F.exists(values, lambda x: ~_finite(x)) | F.forall(values, lambda x: x == 0), FL["INVMODEL"], column)


def gain_policies(gains: DataFrame, direction: int) -> DataFrame:
    """Of gains (t, ant, dir, gflag): whether they flag data, by t and antenna, under each policy over directions."""
    own = F.coalesce(F.bool_or(F.when(F.col("dir") == direction, F.col("gflag"))), F.lit(False))
    return gains.groupBy("t", "ant").agg(F.lit(False).alias("never"), F.bool_or("gflag").alias("always"), F.bool_and("gflag").alias("in_all"), own.alias("of_one"))
