"""The database of solutions on whole tables: declaring, appending, loading, compaction, slices, transfer and gain tables; and the same in SQL."""

from __future__ import annotations

import re
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import database, rebin, stats, store
from ..sources.tables import fresh_path, written
from ..sources.views import SLOT_DAYS, VC, VL, visibilities, visibilities_of
from .queries import GRID, RB, SOL, _grid, _solutions
from .registry import query
from .tiles import corrs

#: Three writes of G on overlapping times, the last of one channel only, and one of B.
WRITES = f"""{VL}, {SOL}, wr as (select 'G' as param, 1::bigint as seq, ant, chan, time, value from sol where time < 10 union all select 'G', 2, ant, chan, time, value + 100 from sol where time >= 5 and time < 25
 union all select 'G', 3, ant, chan, time, value + 200 from sol where time < 15 and chan = 0 union all select 'B', 1, ant, chan, null, avg(value) from sol group by ant, chan)"""


def _database(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "solutions")
    s = written(_solutions(spark, sf_dir), "solved")
    ants = s.select("ant").distinct().count()
    database.create(spark, path, {"antennas": str(ants), "kind": "gains"})
    database.define(spark, path, "G", ("ant", "time", "freq"), ("time", "freq"))
    database.define(spark, path, "B", ("ant", "freq"), ("freq",), 1.0)
    g = s.select("ant", F.col("chan").alias("freq"), "time", "value")
    database.append(path, "G", g.where("time < 10"), 1)
    database.append(path, "G", g.where("time >= 5 and time < 25").withColumn("value", F.col("value") + 100), 2)
    database.append(path, "G", g.where("time < 15 and freq = 0").withColumn("value", F.col("value") + 200), 3)
    database.append(path, "B", g.groupBy("ant", "freq").agg(F.avg("value").alias("value")), 1)
    return path


@query(f"with {VL}, {SOL} select 'antennas' as key, count(distinct ant)::varchar as value from sol union all select 'kind', 'gains'")
def db_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_database(spark, sf_dir)}/meta")


@query(f"with {WRITES} select param as name, case param when 'G' then 'ant,time,freq' else 'ant,freq' end as axes, case param when 'G' then 'time,freq' else 'freq' end as interpolation, case param when 'G' then 0.0::double else 1.0::double end as empty, count(*) as written from wr group by param")
def db_define(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _database(spark, sf_dir)
    n = spark.read.parquet(f"{path}/slices").groupBy(F.col("param").alias("name")).agg(F.count(F.lit(1)).alias("written"))
    return database.names(spark, path).join(n, "name").select("name", F.array_join("axes", ",").alias("axes"), F.array_join("interpolation", ",").alias("interpolation"), "empty", "written")


@query(f"with {WRITES} select param, seq, count(*) as n, sum(value) as total from wr group by all", "total", 4)
def db_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_database(spark, sf_dir)}/slices")
    return rows.groupBy("param", "seq").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(f"with {WRITES} select ant, chan, time, arg_max(value, seq) as value from wr where param = 'G' group by all", "value")
def db_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = database.get(spark, _database(spark, sf_dir), "G")
    return g.select("ant", F.col("freq").cast("bigint").alias("chan"), F.col("time").cast("bigint").alias("time"), "value")


@query(f"with {WRITES} select param, ant, chan, time, max(seq) as seq, arg_max(value, seq) as value from wr group by all", "value")
def db_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _database(spark, sf_dir)
    database.compact(spark, path)
    return spark.read.parquet(f"{path}/slices").select("param", "ant", F.col("freq").cast("bigint").alias("chan"), F.col("time").cast("bigint").alias("time"), "seq", "value")


@query(f"with {WRITES} select param as name, count(*) as places from (select distinct param, ant, chan, time from wr) group by 1")
def db_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _database(spark, sf_dir)
    every = database.get(spark, path, "G").withColumn("name", F.lit("G")).unionByName(database.get(spark, path, "B").withColumn("name", F.lit("B")))
    return database.names(spark, path).select("name").join(every, "name").groupBy("name").agg(F.count(F.lit(1)).alias("places"))


@query(f"with {WRITES}, x as (select 'ant' as axis, ant::double as grid from wr where param = 'G' union select 'freq', chan::double from wr where param = 'G' union select 'time', time::double from wr where param = 'G') select axis, grid, row_number() over (partition by axis order by grid) - 1 as place from x")
def param_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.grids(database.get(spark, _database(spark, sf_dir), "G"))


# ---------------------------------------------------------------- slices and transfer

CUBE = "cu as (select k.ant, k.chan, g.time, s.value, s.value is null as masked from (select distinct ant, chan from grid) k cross join (select distinct time from grid) g left join sol s on s.ant = k.ant and s.chan = k.chan and s.time = g.time)"


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir)
    places = store.cube(grid.withColumn("value", F.lit(0.0)), ["ant", "chan"], "time").select("ant", "chan", "time")
    return store.lookup(places, _solutions(spark, sf_dir), ["ant", "chan", "time"])


@query(f"with {VL}, {SOL}, {GRID}, {CUBE}, a as (select ant, time from cu group by all having not bool_and(masked)), b as (select ant, chan from cu group by all having not bool_and(masked)) select cu.* from cu semi join a using (ant, time) semi join b using (ant, chan)", "value")
def param_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.trimmed(_cube(spark, sf_dir), ["ant"], ["time", "chan"]).select("ant", "chan", "time", "value", "masked")


@query(f"with {WRITES} select chan, time, arg_max(value, seq) as value from wr where param = 'G' and ant = 1 group by all", "value")
def get_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = database.get(spark, _database(spark, sf_dir), "G").where("ant = 1")
    return g.select(F.col("freq").cast("bigint").alias("chan"), F.col("time").cast("bigint").alias("time"), "value")


@query(f"with {VL}, {SOL}, {GRID}, {CUBE} select ant, chan, bool_or(not masked) as valid from cu group by all")
def is_slice_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir).groupBy("ant", "chan").agg(F.bool_or(~F.col("masked")).alias("valid"))


@query(f"with {VL}, {SOL} select ant, chan, time, value, false as masked from sol", "value")
def load_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As they are, on a grid that has them all."""
    s = _solutions(spark, sf_dir)
    return database.loaded(s.select("ant", "chan", "time"), s, ["ant", "chan"], "time", False)


@query(f"""with {VL}, {SOL}, {GRID}, n as (select ant, chan, time, value, row_number() over w as k, count(*) over (partition by ant, chan) as m from sol window w as (partition by ant, chan order by time)),
 a as (select g.ant, g.chan, g.time, greatest(1, least(max(m) - 1, count(*) filter (n.time <= g.time))) as k from grid g join n on n.ant = g.ant and n.chan = g.chan group by all)
 select g.ant, g.chan, g.time, case when p.value is null then null when q.value is null then p.value else p.value + (q.value - p.value) * (g.time - p.time) / (q.time - p.time) end as value, p.value is null as masked
 from grid g left join a on a.ant = g.ant and a.chan = g.chan and a.time = g.time left join n p on p.ant = a.ant and p.chan = a.chan and p.k = a.k left join n q on q.ant = a.ant and q.chan = a.chan and q.k = a.k + 1""", "value")  # fmt: skip
def transfer_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated along time, on the grid of all samples."""
    return database.loaded(_grid(spark, sf_dir), _solutions(spark, sf_dir), ["ant", "chan"], "time", True)


# ---------------------------------------------------------------- gain tables

#: 2 x 2 values on times and channels, of which some are absent, by what a table holds of them: elements, their phases, or delays, in nanoseconds, of a line through the phases over channels of 1 MHz; of one channel there is none.
WIDTH = 1e6
VALUES = {"elements": "avg(re)", "phases": "atan2(avg(im), avg(re))", "delays": f"case when min(chan) < max(chan) then regr_slope(atan2(im, re), chan::double) / {2 * pi * WIDTH!r} / 1e-9::double end"}


def _jones_sql(kind: str) -> str:
    chan = "0::bigint" if kind == "delays" else "chan"
    return f"jo as (select t as time, {chan} as chan, ant1 as ant, corr, {VALUES[kind]} as value, avg(w) / 1000 as error from vc where (t + chan) % 5 <> 0 group by all), jg as (select distinct j.time, j.ant, c.chan from jo j, (select distinct chan from jo) c)"


def _jones(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    c = corrs(spark, sf_dir).where("(t + chan) % 5 <> 0")
    value = {"elements": F.avg("re"), "phases": F.atan2(F.avg("im"), F.avg("re")), "delays": F.when(F.min("chan") < F.max("chan"), F.regr_slope(F.atan2("im", "re"), F.col("chan").cast("double"))) / (2 * pi * WIDTH) / 1e-9}[kind]
    chan = F.lit(0).cast("bigint") if kind == "delays" else F.col("chan")
    return c.groupBy(F.col("t").alias("time"), chan.alias("chan"), F.col("ant1").alias("ant"), "corr").agg(value.alias("value"), (F.avg("w") / 1000).alias("error"))


def _gain_table(spark: SparkSession, sf_dir: str, pair: tuple[int, int], kind: str) -> DataFrame:
    """Rows of (field, time, spw, antenna) with arrays over the window's channels: a pair of elements with flags, and their errors. Windows are of four channels; a delay is one for all."""
    j = _jones(spark, sf_dir, kind)
    at = lambda c, k: F.max(F.when(F.col("corr") == pair[k], F.col(c)))
    wide = j.groupBy("time", "ant", "chan").agg(*[at(c, k).alias(f"{c}{k}") for c in ("value", "error") for k in (0, 1)])
    chans = j.select("chan").distinct()
    full = j.select("time", "ant").distinct().join(F.broadcast(chans)).join(wide, ["time", "ant", "chan"], "left")
    tidy = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) + 3e-10, 6) + 0.0
    row = F.struct("chan", tidy("value0").alias("p0"), tidy("value1").alias("p1"), tidy("error0").alias("e0"), tidy("error1").alias("e1"), F.col("value0").isNull().alias("flag"))
    spw = F.floor(F.col("chan") / 4).alias("spw")
    t = full.groupBy("time", "ant", spw).agg(F.sort_array(F.collect_list(row)).alias("x"))
    return t.select(F.lit(0).cast("bigint").alias("field"), "time", "spw", F.col("ant").alias("antenna1"), F.lit(-1).cast("bigint").alias("antenna2"), *[F.col(f"x.{c}").alias(n) for c, n in (("p0", "param0"), ("p1", "param1"), ("e0", "error0"), ("e1", "error1"), ("flag", "flags"))])


def _gain_sql(pair: tuple[int, int], kind: str) -> str:
    cell = lambda c, k: f"round(coalesce(max({c}) filter (corr = {pair[k]}), 0.0::double) + 3e-10::double, 6) + 0.0::double"
    return f"""with {VL}, {RB}, {VC}, {_jones_sql(kind)}, wd as (select jg.time, jg.ant, jg.chan, {cell("value", 0)} as p0, {cell("value", 1)} as p1, {cell("error", 0)} as e0, {cell("error", 1)} as e1, max(value) filter (corr = {pair[0]}) is null as flag
 from jg left join jo on jo.time = jg.time and jo.ant = jg.ant and jo.chan = jg.chan group by all) select 0::bigint as field, time, chan // 4 as spw, ant as antenna1, -1::bigint as antenna2,
 list(p0 order by chan) as param0, list(p1 order by chan) as param1, list(e0 order by chan) as error0, list(e1 order by chan) as error1, list(flag order by chan) as flags from wd group by all"""


@query(_gain_sql((0, 3), "phases"))
def caltable_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a diagonal."""
    return _gain_table(spark, sf_dir, (0, 3), "phases")


@query(_gain_sql((0, 3), "elements"))
def caltable_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal elements."""
    return _gain_table(spark, sf_dir, (0, 3), "elements")


@query(_gain_sql((1, 2), "elements"))
def caltable_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-diagonal elements."""
    return _gain_table(spark, sf_dir, (1, 2), "elements")


@query(_gain_sql((0, 3), "delays"))
def caltable_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays in nanoseconds, fitted to the phases of all channels."""
    return _gain_table(spark, sf_dir, (0, 3), "delays")


@query(f"with {VL}, {SOL} select ant, chan, time, value, value * 0.01 as error from sol", "value error")
def save_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters with their errors go to a new database, and come back."""
    path = fresh_path(spark, "export")
    s = _solutions(spark, sf_dir).select("ant", F.col("chan").alias("freq"), "time", "value")
    database.create(spark, path, {"kind": "export"})
    for name, scale in (("gain", 1.0), ("gain.err", 0.01)):
        database.define(spark, path, name, ("ant", "time", "freq"), ("time", "freq"))
        database.append(path, name, s.withColumn("value", F.col("value") * scale), 1)
    back = lambda n, c: database.get(spark, path, n).select("ant", F.col("freq").cast("bigint").alias("chan"), F.col("time").cast("bigint").alias("time"), F.col("value").alias(c))
    return back("gain", "value").join(back("gain.err", "error"), ["ant", "chan", "time"])


@query(f"with {VL} select scan, chan, count(*) as n, avg(re) as mean from vl group by all", "mean")
def stats_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stats")
    visibilities(spark, sf_dir).groupBy("scan", "chan").agg(F.count(F.lit(1)).alias("n"), F.avg("re").alias("mean")).write.parquet(path)
    return spark.read.parquet(path)


@query(f"with {VL}, d as (select ant1, arg_max(tslot, re) as best, arg_min(tslot, re) as worst from vl where fl = 0 group by 1) select ant1 as ant, best, worst from d")
def argmax_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each antenna's largest and smallest value; of equal values the first row's, in the order of the table's files."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index"))
    return stats.at_extremes(visibilities_of(li, "place").where("fl = 0").withColumnRenamed("ant1", "ant"), "ant", "tslot", "re", "place")


@query(f"with {VL}, c as (select ant1 as ant, avg(case when fl <> 0 then 1.0 else 0.0 end) as bad, count(*) as n from vl group by 1) select arg_min(ant, bad * 1000 + ant) as ref, min(bad) as bad from c", "bad")
def argmin_refant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The antenna with the least share of flagged samples; of equal ones the first."""
    c = visibilities(spark, sf_dir).groupBy(F.col("ant1").alias("ant")).agg(F.avg(F.when(F.col("fl") != 0, 1.0).otherwise(0.0)).alias("bad"))
    return c.agg(F.min_by("ant", F.col("bad") * 1000 + F.col("ant")).alias("ref"), F.min("bad").alias("bad"))


@query(f"with {VL}, {RB} select t, chan, ant1, ant2, w from rb where floor(t / 8) = 2 and floor(chan / 4) = 1", "w")
def sel_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk, by its label, whose parts become bounds of the table's own columns."""
    _, ti, fi = map(int, re.fullmatch(r"D(\d+)T(\d+)F(\d+)", "D0T2F1").groups())
    part = visibilities(spark, sf_dir, (ti * 8 * SLOT_DAYS, (ti + 1) * 8 * SLOT_DAYS - 1), (fi * 4, fi * 4 + 3))
    return rebin.good_bins(part, SLOT_DAYS).select("t", "chan", "ant1", "ant2", "w")
