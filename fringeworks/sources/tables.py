"""Tables on disk: intermediate folders, new versions of columns, tiles, source catalogues, and text tables of leakages and bandpasses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CATALOGUE = "id bigint, tag string, type string, ra double, dec double, flux double, alpha double, curve double, ex double, ey double, pa double"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new local one, kept in the session, for a local session that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fringeworks.tables.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("fringeworks.tables.dir", at)
    return at


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


#: Folders of intermediate tables of this process.
_tables: list[str] = []


def release_all(spark: SparkSession) -> None:
    """Deletes every folder of fresh_path() in this process, for callers that have stored their results."""
    for path in _tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _tables.clear()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read again: it cuts the lineage and outlives executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- columns and tiles


def embedded(cell: Column, part: Column, start: int) -> Column:
    """An array with part in place of its elements from start on (from 0)."""
    rest = F.greatest(F.size(cell) - start - F.size(part), F.lit(0))
    return F.concat(F.slice(cell, 1, start), part, F.slice(cell, F.lit(start + 1) + F.size(part), rest))


def reduced_flags(flags: Column) -> Column:
    """Flags of a sample's correlations: any of them, in each."""
    return F.transform(flags, lambda x: F.exists(flags, lambda f: f))


def with_column_like(df: DataFrame, name: str, like: str) -> DataFrame:
    """A new, empty column of another one's type; an existing one stays."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(df.schema[like].dataType))


def write_tile(df: DataFrame, path: str, by: str, only_save: tuple[str, ...] = ()) -> None:
    """Results of a tile, laid out by a key that later reads prune on; with only_save, these columns and the key alone."""
    (df.select(*dict.fromkeys([*only_save, by])) if only_save else df).write.partitionBy(by).mode("overwrite").parquet(path)


# ---------------------------------------------------------------- catalogues and text tables


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A source catalogue: lines of comma-separated values with a header."""
    return spark.read.csv(path, header=True, schema=CATALOGUE)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line: a file is one row first, so its lines keep their order; files are many and short."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return whole.withColumn("fields", F.split(F.trim("line"), r"\s+"))


def _number(i: int) -> Column:
    """A field as a number; INDE stands for no value, which counts as 0."""
    return F.when(F.col("fields")[i] == "INDE", 0.0).otherwise(F.expr(f"try_cast(fields[{i}] as double)"))


def read_leakages(spark: SparkSession, path: str) -> DataFrame:
    """Of a printed leakage table: ant, freq (Hz), r_re, r_im, l_re, l_im. Entries are lines of six fields that begin with an antenna number; they need a header before them."""
    header = F.col("line").rlike(r"^#ANT\s+FREQ\s+REAL\(R\)\s+IMAG\(R\)\s+REAL\(L\)\s+IMAG\(L\)\s*$")
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    entry = _lines(spark, path).withColumn("seen", F.max(header).over(order)).where((F.size("fields") == 6) & F.col("fields")[0].rlike(r"^\d+$"))
    seen = F.when(F.col("seen"), F.col("fields")[0]).otherwise(F.raise_error(F.lit("antenna entry before header")).cast("string"))
    return entry.select(seen.cast("bigint").alias("ant"), (_number(1) * 1e9).alias("freq"), *[_number(2 + i).alias(c) for i, c in enumerate(("r_re", "r_im", "l_re", "l_im"))])


def read_polar_leakages(spark: SparkSession, path: str) -> DataFrame:
    """Of a table with a line for each antenna and lines of seven fields below it (polarisation, frequency in MHz, amplitude, phase in degrees): ant, name, pol, freq (Hz), re, im.
    An entry belongs to the last antenna line before it."""
    named = F.regexp_extract("line", r"^\s*Antenna #\s+(\d+)\s+ name: (\w+)", 1)
    lines = _lines(spark, path).withColumn("head", F.when(named != "", F.struct(named.cast("bigint").alias("ant"), F.regexp_extract("line", r"name: (\w+)", 1).alias("name"))))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("at", F.last("head", ignorenulls=True).over(order)).where((F.size("fields") == 7) & F.col("head").isNull())
    rows = rows.withColumns({"f": _number(3), "a": _number(5), "p": F.radians(_number(6))}).where("f is not null and a is not null and p is not null and at is not null")
    return rows.select("at.ant", "at.name", F.col("fields")[2].alias("pol"), (F.col("f") * 1e6).alias("freq"), (F.col("a") * F.cos("p")).alias("re"), (F.col("a") * F.sin("p")).alias("im"))


def read_bandpass(spark: SparkSession, path: str, freq0: float, dfreq: float) -> DataFrame:
    """Of a printed bandpass table: time (s), source, ant, chan, freq and both hands' re and im. A header names the columns, which begin where their names do; lines of one row
    number are its channels in order."""
    names = ("TIME", "SOURCE ID", "ANTENNA", "REAL 1", "IMAG 1", "REAL 2", "IMAG 2")
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(spark, path).withColumn("header", F.last(F.when(F.col("fields")[0] == "ROW", F.col("line")), ignorenulls=True).over(order))
    rows = lines.where(F.col("fields")[0].rlike(r"^\d+$") & F.col("header").isNotNull())
    # a field is the first word from its column's place on; short names may be parts of longer ones, so blanks are asked for around them
    at = {c: F.expr(f"locate(' {c} ', concat(header, ' '))") + 1 for c in names}
    field = {c: F.element_at(F.split(F.ltrim(F.expr("substring(line, at_{})".format(i))), r"\s+"), 1) for i, c in enumerate(names)}
    rows = rows.withColumns({f"at_{i}": at[c].cast("int") for i, c in enumerate(names)}).withColumns({f"f_{i}": field[c] for i, c in enumerate(names)})
    part = lambda k: F.regexp_extract("f_0", r"^(\d+)/(\d+):(\d+):([\d.]+)$", k).cast("double")
    chan = F.row_number().over(Window.partitionBy("file", F.col("fields")[0]).orderBy("n")) - 1
    rows = rows.withColumn("chan", chan.cast("bigint"))
    numbers = [F.col(f"f_{3 + i}").cast("double").alias(c) for i, c in enumerate(("r_re", "r_im", "l_re", "l_im"))]
    return rows.select((part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).alias("time"), F.col("f_1").cast("bigint").alias("source"), F.col("f_2").cast("bigint").alias("ant"), "chan", (freq0 + F.col("chan") * dfreq).alias("freq"), *numbers)
