"""Visibility-like views of general tables, so that each operator runs on whole tables of any size; and the same as SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANTS, SLOT_DAYS = 7, 30


FIRST_DAY = date(1995, 1, 1)


def visibilities(spark: SparkSession, sf_dir: str, days: tuple[int, int] | None = None, chans: tuple[int, int] | None = None) -> DataFrame:
    """Bounds of days and channels, both ends included, are put to the table's own columns, so that they reach its scan."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if days:
        lo, hi = (FIRST_DAY + timedelta(days=d) for d in (days[0], days[1] + 1))
        li = li.where(f"l_shipdate >= timestamp_ntz'{lo}' and l_shipdate < timestamp_ntz'{hi}'")
    if chans:
        li = li.where(F.col("l_linenumber").between(chans[0] + 1, chans[1] + 1))
    return visibilities_of(li)


def visibilities_of(li: DataFrame, *more: str) -> DataFrame:
    """Of lineitem, a table or a stream: tslot, chan, ant1 <= ant2, data re/im, weight w, model mre/mim, scan, flags fl, seq (the order of rows), and more columns as they are. Keys repeat: re-bin before dense use."""
    a, b = F.col("l_partkey") % ANTS, F.col("l_suppkey") % ANTS
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit(str(FIRST_DAY)).cast("date"))
    return li.select(
        day.cast("bigint").alias("tslot"), (F.col("l_linenumber") - 1).cast("bigint").alias("chan"), F.least(a, b).alias("ant1"), F.greatest(a, b).alias("ant2"), (F.col("l_extendedprice") / 1e4).alias("re"),
        (F.when(a > b, -1.0).otherwise(1.0) * F.col("l_discount") * 10).alias("im"), F.col("l_quantity").alias("w"), (F.col("l_extendedprice") / 1e4 * (1 - F.col("l_discount"))).alias("mre"), F.lit(0.0).alias("mim"),
        F.year("l_shipdate").cast("bigint").alias("scan"), (F.when(F.col("l_returnflag") == "R", 1).otherwise(0).bitwiseOR(F.when(a == b, 32768).otherwise(0))).cast("bigint").alias("fl"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq"), *more,
    )


VL = f"""vl as (select date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as tslot, (l_linenumber - 1)::bigint as chan, least(l_partkey % {ANTS}, l_suppkey % {ANTS}) as ant1,
 greatest(l_partkey % {ANTS}, l_suppkey % {ANTS}) as ant2, l_extendedprice / 1e4 as re, (case when l_partkey % {ANTS} > l_suppkey % {ANTS} then -1.0::double else 1.0::double end) * l_discount * 10 as im,
 l_quantity as w, l_extendedprice / 1e4 * (1 - l_discount) as mre, 0.0::double as mim, year(l_shipdate)::bigint as scan,
 ((case l_returnflag when 'R' then 1 else 0 end) | (case when l_partkey % {ANTS} = l_suppkey % {ANTS} then 32768 else 0 end))::bigint as fl, (l_orderkey * 8 + l_linenumber)::bigint as seq from lineitem)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of embeddings: row, scan, chan, x."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row"), F.col("label").cast("bigint").alias("scan"), F.posexplode("embedding").alias("chan", "x")).select("row", "scan", F.col("chan").cast("bigint").alias("chan"), F.col("x").cast("double").alias("x"))


VE = "ve as (select vec_id as row, label::bigint as scan, (generate_subscripts(embedding, 1) - 1)::bigint as chan, unnest(embedding)::double as x from embeddings)"


def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events: id, time (seconds), ant, corr, amp."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"), F.col("user_id").alias("ant"), F.col("event_type").alias("corr"), F.col("value").alias("amp"))


VT = "vt as (select event_id as id, epoch_us(ts) / 1e6 as time, user_id as ant, event_type as corr, value as amp from events)"

#: Parts of a row in each of the four correlations: of re, of mre, of im, of the weight.
CORRS = ((0, 1.0, 0.0, 1.0, 1.0), (1, 0.0, 0.1, 0.5, 0.5), (2, 0.0, 0.1, -0.5, 0.25), (3, 0.5, 0.5, -1.0, 2.0))


def correlations(cells: DataFrame) -> DataFrame:
    """Of re-binned cells: t, chan, ant1, ant2, corr 0 to 3, re, im, mre, mim, w, fl."""
    k = F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("corr"), *[F.lit(x).alias(n) for n, x in zip("abcd", rest, strict=True)]) for c, *rest in CORRS])).alias("k")
    x = cells.select("*", k)
    return x.select("t", "chan", "ant1", "ant2", "k.corr", (F.col("re") * F.col("k.a") + F.col("mre") * F.col("k.b")).alias("re"), (F.col("im") * F.col("k.c")).alias("im"), (F.col("mre") * F.col("k.a")).alias("mre"), F.lit(0.0).alias("mim"), (F.col("w") * F.col("k.d")).alias("w"), "fl")


VC = f"""vc as (select t, chan, ant1, ant2, corr, re * a + mre * b as re, im * c as im, mre * a as mre, 0.0::double as mim, w * d as w, fl from rb, (values {", ".join(f"({c}::bigint, {', '.join(f'{x}::double' for x in rest)})" for c, *rest in CORRS)}) as k(corr, a, b, c, d))"""
