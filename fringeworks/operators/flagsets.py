"""Named sets of flags: a table of (name, bit, place), one row for each of at most 32 names; what is done with it is bounded by that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 32


def loaded(bits: DataFrame, order: DataFrame) -> DataFrame:
    """Sets (name, bit) in their stored order (name, place): names of the order that have a bit, then those it forgot, by bit. mask is the bit's value."""
    known = bits.join(order.groupBy("name").agg(F.min("place").alias("_at")), "name", "left")
    place = F.row_number().over(Window.orderBy(F.col("_at").isNull(), "_at", "bit")) - 1
    return known.select("name", "bit", place.cast("bigint").alias("place")).withColumn("mask", mask_of(F.col("bit")))


def from_names(names: DataFrame) -> DataFrame:
    """Sets of an old-style list (name, place): bits follow the list."""
    return names.select("name", F.col("place").cast("bigint").alias("bit"), F.col("place").cast("bigint").alias("place")).withColumn("mask", mask_of(F.col("place")))


def mask_of(bit: Column) -> Column:
    """The value of a bit below 53."""
    return F.pow(F.lit(2.0), bit).cast("bigint")


def created(sets: DataFrame, names: DataFrame) -> DataFrame:
    """sets with new names on the first free bits, in order of the names; those that exist keep theirs. More than BITS is an error."""
    free = sets.sparkSession.range(BITS).select(F.col("id").alias("bit")).join(sets.select("bit"), "bit", "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.orderBy("bit")))
    new = names.select("name").distinct().join(sets.select("name"), "name", "left_anti").withColumn("_k", F.row_number().over(Window.orderBy("name")))
    got = new.join(free, "_k", "left").withColumn("bit", F.when(F.col("bit").isNull(), F.raise_error(F.lit("too many flagsets")).cast("bigint")).otherwise(F.col("bit")))
    last = sets.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_last"))
    got = got.join(F.broadcast(last)).select("name", "bit", (F.col("_last") + F.col("_k")).cast("bigint").alias("place"), mask_of(F.col("bit")).alias("mask"))
    return sets.select("name", "bit", "place", "mask").unionByName(got)


def removed(sets: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """The sets less some names, and one row with the mask of those."""
    gone = F.col("name").isin(list(names))
    return sets.where(~gone), sets.where(gone).agg(F.coalesce(F.bit_or("mask"), F.lit(0).cast("bigint")).alias("mask"))


def policy(sets: DataFrame, apply: str | int | list[str]) -> DataFrame:
    """One row: mask, the bits to apply, and legacy, whether FLAG is applied instead. apply: a mask, FLAG, names, or -NAME for all but one; unknown names count for nothing."""
    if isinstance(apply, int):
        return sets.sparkSession.range(1).select(F.lit(apply).cast("bigint").alias("mask"), F.lit(False).alias("legacy"))
    names = apply if isinstance(apply, list) else apply.split(",")
    legacy = names == ["FLAG"]
    wanted = F.col("name") != names[0][1:] if names[0].startswith("-") else F.col("name").isin(names)
    return sets.where(F.lit(False) if legacy else wanted).agg(F.coalesce(F.bit_or("mask"), F.lit(0).cast("bigint")).alias("mask"), F.lit(legacy).alias("legacy"))


def counts(vis: DataFrame, sets: dict[str, int], out: str = "new_fl") -> DataFrame:
    """name, n, percent: samples in all, of each set (a bit of column bits), deselected (SKIPSOL), flagged before, newly, and after; one pass. Columns: bits, legacy, deselected, fl, and out."""
    old, new = F.col("fl") != 0, F.col(out) != 0
    cells = {"FLAG": F.col("legacy")} | {n: F.col("bits").bitwiseAND(F.lit(m)) != 0 for n, m in sets.items()} | {"DESEL": F.col("deselected"), "IN": old, "NEW": new & ~old, "OUT": new}
    sums = vis.agg(F.count(F.lit(1)).alias("TOTAL"), *[F.count_if(x).alias(n) for n, x in cells.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n"), (100.0 * F.col(n) / F.greatest(F.col("TOTAL"), F.lit(1))).alias("percent")) for n in ("TOTAL", *cells)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def from_cube(rows: DataFrame, cube: DataFrame) -> DataFrame:
    """Rows (t, ddid, ...) with the flags of a cube (t, ddid, chan, flag): each row's channels in order."""
    spectrum = cube.groupBy("t", "ddid").agg(F.sort_array(F.collect_list(F.struct("chan", "flag"))).alias("_f"))
    return rows.join(spectrum, ["t", "ddid"], "left").withColumn("flags", F.transform("_f", lambda x: x["flag"])).drop("_f")
