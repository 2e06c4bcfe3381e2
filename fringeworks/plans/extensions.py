"""Windows of time and planes of parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources.tables import fresh_path
from ..sources.views import VL
from ..streaming import windows
from .queries import GRID, SOL, _grid, _solutions
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type as corr, epoch_us(time_bucket(interval 1 hour, ts)) as start, count(*) as n, avg(value) as mean from events group by all", "mean")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.tumbling(_events(spark, sf_dir).withColumnRenamed("event_type", "corr"), "ts", "1 hour", "1 hour", ["corr"], F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select("corr", F.unix_micros("start").alias("start"), "n", "mean")


@query("""with j as (select user_id as ant, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as s from events), k as (select *, sum(s) over (partition by ant order by ts range unbounded preceding) as part from j)
 select ant, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 21600000000 as stop, count(*) as n from k group by ant, part""")  # fmt: skip
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.sessions(_events(spark, sf_dir).withColumnRenamed("user_id", "ant"), "ts", "6 hours", "1 hour", ["ant"], F.count(F.lit(1)).alias("n"))
    return w.select("ant", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")


@query("select chan, epoch_us(time_bucket(interval 30 day, l_shipdate, timestamp '1970-01-01')) as start, count(*) as n, count(*) filter (l_returnflag = 'R') as flagged from (select *, (l_linenumber - 1)::bigint as chan from lineitem) group by all")
def stream_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of flags by channel and 30 days, over the table as a stream; no row comes later than the watermark allows."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    rows = stream.select(F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_linenumber") - 1).cast("bigint").alias("chan"), (F.col("l_returnflag") == "R").alias("flag"))
    path = fresh_path(spark, "running")
    windows.running(rows, "ts", "30 days", "3650 days", ["chan"], path, fresh_path(spark, "progress"), flagged=F.count_if("flag")).awaitTermination()
    return windows.current(spark, path, ["chan"]).select("chan", F.unix_micros("start").alias("start"), "n", "flagged")


@query(f"""with {VL}, {SOL}, {GRID}, g as (select ant, time, chan + 0.5::double as chan from grid), ln as (select distinct ant, chan from sol),
 t as (select g.ant, g.time, g.chan, max(ln.chan) filter (ln.chan <= g.chan) as lo, min(ln.chan) filter (ln.chan >= g.chan) as hi from g left join ln using (ant) group by all), e as (select ant, time, chan, coalesce(lo, hi) as c0, coalesce(hi, lo) as c1 from t),
 a as (select ant, time, c0 as line from e union select ant, time, c1 from e), n as (select a.ant, a.time, a.line, max(s.time) filter (s.time <= a.time) as t0, min(s.time) filter (s.time >= a.time) as t1, arg_max(s.value, s.time) filter (s.time <= a.time) as v0, arg_min(s.value, s.time) filter (s.time >= a.time) as v1
 from a join sol s on s.ant = a.ant and s.chan = a.line group by all), v as (select ant, time, line, case when t0 is null then v1 when t1 is null or t0 = t1 then v0 else v0 + (v1 - v0) * (time - t0) / (t1 - t0) end as v from n)
 select e.ant, e.time, e.chan, case when c0 = c1 then p.v else p.v + (q.v - p.v) * (e.chan - c0) / (c1 - c0) end as value from e left join v p on p.ant = e.ant and p.time = e.time and p.line = c0 left join v q on q.ant = e.ant and q.time = e.time and q.line = c1""", "value")  # fmt: skip
def reinterpolate_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions on a grid of their times, half a channel up."""
    grid = _grid(spark, sf_dir).select("ant", "time", (F.col("chan") + 0.5).alias("chan"))
    return store.interpolated_plane(grid, _solutions(spark, sf_dir).withColumn("chan", F.col("chan").cast("double")), ["ant"], ("time", "chan"))
