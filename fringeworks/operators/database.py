"""A database of solutions in a folder: declared parameters, appended slices on sub-grids, loading (the last write of a place wins), and compaction.

params/: name, axes, interpolation axes, default. slices/param=.../: seq, the axes as a map of strings would lose types, so axes are columns; value. Parameters may have different axes;
absent ones are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("dir", "time", "freq", "ant", "corr")
_PARAMS = "name string, axes array<string>, interpolation array<string>, empty double"


def create(spark: SparkSession, path: str, metadata: dict[str, str]) -> None:
    """An empty database with its metadata; one that is there already is an error."""
    spark.createDataFrame(sorted(metadata.items()), "key string, value string").write.parquet(f"{path}/meta")


def define(spark: SparkSession, path: str, name: str, axes: tuple[str, ...], interpolation: tuple[str, ...] = (), empty: float = 0.0) -> None:
    if not set(interpolation) <= set(axes) <= set(AXES):
        raise ValueError(f"axes are of {AXES}, interpolation axes of these")
    spark.createDataFrame([(name, list(axes), list(interpolation), empty)], _PARAMS).write.mode("append").parquet(f"{path}/params")


def append(path: str, name: str, slices: DataFrame, seq: int) -> None:
    """Adds values on a sub-grid (axes..., value); seq is the order of writes."""
    kept = [F.col(a).cast("double" if a in ("time", "freq") else "bigint").alias(a) if a in slices.columns else F.lit(None).cast("double" if a in ("time", "freq") else "bigint").alias(a) for a in AXES]
    rows = slices.select(F.lit(name).alias("param"), F.lit(seq).cast("bigint").alias("seq"), *kept, F.col("value").cast("double").alias("value"))
    rows.write.mode("append").partitionBy("param").parquet(f"{path}/slices")


def names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/params").select("name", "axes", "interpolation", "empty")


def get(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A parameter's values by its axes; of a place that was written several times, the last."""
    rows = spark.read.parquet(f"{path}/slices").where(F.col("param") == name)
    return rows.groupBy(*AXES).agg(F.max_by("value", "seq").alias("value"))


def compact(spark: SparkSession, path: str, backup: bool = True) -> None:
    """Rewrites the slices with the last write of each place alone; the folder before is kept beside it, or goes."""
    rows = spark.read.parquet(f"{path}/slices").groupBy("param", *AXES).agg(F.max(F.struct("seq", "value")).alias("r"))
    rows.select("param", "r.seq", *AXES, "r.value").write.mode("overwrite").partitionBy("param").parquet(f"{path}/slices.new")
    old, new, now = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slices{x}") for x in (".old", ".new", ""))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(now, old)
    fs.rename(new, now)
    if not backup:
        fs.delete(old, True)


def grids(values: DataFrame) -> DataFrame:
    """axis, value, place: the sorted union of each axis over all slices."""
    from pyspark.sql.window import Window

    long = values.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("grid")) for a in AXES])).alias("x")).select("x.*")
    every = long.where("grid is not null").distinct()
    return every.withColumn("place", (F.row_number().over(Window.partitionBy("axis").orderBy("grid")) - 1).cast("bigint"))


def trimmed(cells: DataFrame, slice_by: list[str], axes: list[str]) -> DataFrame:
    """Cells (with masked) of each slice, less the lines of an axis that are masked wholly."""
    for a in axes:
        live = cells.groupBy(*slice_by, a).agg(F.bool_and("masked").alias("_gone")).where("not _gone").drop("_gone")
        cells = cells.join(live, [*slice_by, a], "left_semi")
    return cells


def loaded(grid: DataFrame, solutions: DataFrame, keys: list[str], axis: str, transfer: bool) -> DataFrame:
    """Solutions on a grid: as they are, where a place without one is an error, or (transfer) interpolated along the axis; a key that has none at all is masked."""
    from . import store

    if transfer:
        return store.interpolated(grid, solutions, keys, axis).withColumn("masked", F.col("value").isNull())
    if not store.mismatched(grid, solutions, [*keys, axis]).isEmpty():
        raise ValueError("no solutions on the whole grid: transfer them instead")
    return store.lookup(grid, solutions, [*keys, axis])
