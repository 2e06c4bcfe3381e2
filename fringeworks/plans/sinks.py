"""Writing results and reading other tables, selections, sorts and flag sets on whole tables; and the same in SQL. What is written is read back, as a later job would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cx import Cx, cx, diagonal_inverse, polar
from ..functions.grammar import parse_bin
from ..operators import flags, flagsets, gains, rebin, stats
from ..schema import FL
from ..sources import tables
from ..sources.views import VL, VT, time_axis, visibilities
from .queries import G, RB, cells, given_gains
from .registry import query
from .statistics import ABS, MAD, _absres

ROW = "tslot, chan, ant1, ant2, seq"
ROWS = ["tslot", "chan", "ant1", "ant2", "seq"]


def _stored(df: DataFrame, tag: str, by: str, only_save: tuple[str, ...] = ()) -> DataFrame:
    path = tables.fresh_path(df.sparkSession, tag)
    tables.write_tile(df, path, by, only_save)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- sinks


@query("select vec_id as row, list_concat(embedding[1:8], [(2 * x)::float for x in embedding[9:16]], embedding[17:]) as cell, [list_bool_or([x > 0 for x in embedding[1:4]]) for x in embedding[1:4]] as flags from embeddings")
def sink_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight elements of an array column are replaced within the full cell, and flags of four are OR-ed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = F.transform(F.slice("embedding", 9, 8), lambda x: (2 * x).cast("float"))
    flag = F.transform(F.slice("embedding", 1, 4), lambda x: x > 0)
    out = e.select(F.col("vec_id").alias("row"), "label", tables.embedded(F.col("embedding"), part, 8).alias("cell"), tables.reduced_flags(flag).alias("flags"))
    return _stored(out, "column", "label").select("row", "cell", "flags")


@query(f"with {VL}, {RB}, {G} select t, chan, ant1, ant2, (re * gr + im * gi) / (gr * gr + gi * gi) as corrected_re, w, ant1 % 2 as ddid from (select rb.*, p.g_re * q.g_re + p.g_im * q.g_im as gr, p.g_im * q.g_re - p.g_re * q.g_im as gi from rb join g p on p.ant = ant1 join g q on q.ant = ant2)", "corrected_re w")
def sink_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected data, weights and flags by data description; what is asked for alone is saved, laid out so that readers prune to a description."""
    c = cells(spark, sf_dir)
    out = gains.corrected(gains.with_gains(c, given_gains(c))).withColumns({"corrected_re": F.col("c_re"), "corrected_im": F.col("c_im"), "ddid": F.col("ant1") % 2})
    back = _stored(out, "tile", "ddid", ("t", "chan", "ant1", "ant2", "corrected_re", "w"))
    return back.select("t", "chan", "ant1", "ant2", "corrected_re", "w", F.col("ddid").cast("bigint").alias("ddid"))


@query(f"with {VL} select {ROW}, null::double as corrected, null::bigint as bitflag from vl")
def add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.with_column_like(tables.with_column_like(visibilities(spark, sf_dir), "corrected", "re"), "bitflag", "fl")
    return tables.written(v.select(*ROWS, "corrected", "bitflag"), "columns")


@query(f"with {VL}, {RB}, v as (select *, floor(tslot / 30)::bigint as t from vl) select v.tslot, v.chan, v.ant1, v.ant2, v.seq, rb.re * cos(0.1::double * (v.ant1 - v.ant2)) + rb.im * sin(0.1::double * (v.ant1 - v.ant2)) as out_re, rb.im * cos(0.1::double * (v.ant1 - v.ant2)) - rb.re * sin(0.1::double * (v.ant1 - v.ant2)) as out_im from v join rb on rb.t = v.t and rb.chan = v.chan and rb.ant1 = v.ant1 and rb.ant2 = v.ant2", "out_re out_im")
def chunk_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's results go back to the rows and channels that they came from, turned back by each end's angle."""
    v = visibilities(spark, sf_dir).withColumn("t", F.floor(F.col("tslot") / 30)).select(*ROWS, "t")
    cube = cells(spark, sf_dir).select("t", "chan", "ant1", "ant2", "re", "im")
    out = cx("re", "im") * polar(-0.1 * (F.col("ant1") - F.col("ant2")))
    return v.join(cube, ["t", "chan", "ant1", "ant2"]).select(*ROWS, out.re.alias("out_re"), out.im.alias("out_im"))


# ---------------------------------------------------------------- other tables


@query("""select c_custkey as id, c_mktsegment as tag, case when c_custkey % 4 = 0 then 'pnt' else 'gau' end as type, c_nationkey / 100.0::double as ra, c_acctbal / 10000 as dec, 1 + c_custkey % 10 / 10.0::double as flux, -0.7::double as alpha from customer""", "ra dec flux")
def src_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, zero = F.col("c_custkey"), F.lit(0.0)
    rows = c.select(k.alias("id"), F.col("c_mktsegment").alias("tag"), F.when(k % 4 == 0, "pnt").otherwise("gau").alias("type"), (F.col("c_nationkey") / 100.0).alias("ra"), (F.col("c_acctbal") / 10000).alias("dec"), (1 + k % 10 / F.lit(10.0)).alias("flux"), F.lit(-0.7).alias("alpha"), zero.alias("curve"), zero.alias("ex"), zero.alias("ey"), zero.alias("pa"))
    path = tables.fresh_path(spark, "catalogue")
    rows.write.csv(path, header=True)
    return tables.read_catalogue(spark, path).select("id", "tag", "type", "ra", "dec", "flux", "alpha")


def _printed(rows: DataFrame, head: str | None) -> str:
    """Files of lines: rows are (file, place, line); a file is one value, so its lines stay in order."""
    lines = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("x"))
    text = F.array_join(F.col("x.line"), "\n")
    text = F.concat(F.lit(head + "\n"), text) if head else text
    path = tables.fresh_path(rows.sparkSession, "printed")
    lines.select(text.alias("value"), "file").write.partitionBy("file").text(path)
    return path


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.withColumns({"file": F.floor(F.col("s_suppkey") / 50), "k": F.col("s_suppkey"), "x": F.round(F.col("s_acctbal") / 10000, 6)})


@query("select s_suppkey as ant, 1400000000.0::double + (s_suppkey % 8) * 1000000.0::double as freq, round(s_acctbal / 10000, 6) as r_re, -0.5::double as r_im, round(s_acctbal / 10000, 6) as l_re, 0.0::double as l_im from supplier", "freq r_re r_im l_re", 4)
def src_aips_prtab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as printed leakages; one part is printed as absent."""
    s = _suppliers(spark, sf_dir)
    line = F.format_string("%d  %.4f  %.6f  %.6f  %.6f  INDE", "k", 1.4 + (F.col("k") % 8) * 0.001, "x", F.lit(-0.5), "x")
    path = _printed(s.select("file", F.col("k").alias("place"), line.alias("line")), "table of leakages\n#ANT   FREQ   REAL(R)  IMAG(R)  REAL(L)  IMAG(L)")
    return tables.read_leakages(spark, path)


@query("select s_suppkey as ant, 'EA' || s_suppkey as name, pol, 1400000000.0::double + f * 2000000.0::double as freq, round(abs(s_acctbal) / 10000, 6) * cos(radians(f * 30.0::double)) as re, round(abs(s_acctbal) / 10000, 6) * sin(radians(f * 30.0::double)) as im from supplier, (values ('R', 1), ('L', 2)) v(pol, f)", "freq re im", 5)
def src_aips_pd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    entry = lambda pol, f: F.format_string(f"1 2 {pol} %.1f 9 %.6f %.1f", F.lit(1400.0 + 2 * f), F.abs("x"), F.lit(30.0 * f))
    lines = F.array(F.concat(F.lit("  Antenna #   "), "k", F.lit("  name: EA"), "k"), F.lit("IF Chan Pol"), entry("R", 1), entry("L", 2))
    rows = s.select("file", "k", F.posexplode(lines).alias("j", "line")).select("file", F.struct("k", "j").alias("place"), "line")
    return tables.read_polar_leakages(spark, _printed(rows, None))


@query("select (s_suppkey % 3) * 86400 + 3723.5::double as time, 1::bigint as source, s_suppkey as ant, chan, 1e9::double + chan * 1e6::double as freq, round(s_acctbal / 10000, 6) as r_re, chan / 10.0::double as r_im, 1.0::double as l_re, -0.25::double as l_im from supplier, (values (0::bigint), (1::bigint), (2::bigint)) c(chan)", "r_re r_im")
def src_aips_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    line = F.format_string("%-8d%-17s%-11d%-9d%-10d%-11.6f%-11.6f%-11.6f%-11.6f", "k", F.concat(F.col("k") % 3, F.lit("/01:02:03.5")), F.lit(1), "k", F.lit(5), "x", F.col("c") / F.lit(10.0), F.lit(1.0), F.lit(-0.25))
    rows = s.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("c")).select("file", F.struct("k", "c").alias("place"), line.alias("line"))
    head = "".join(c.ljust(w) for c, w in (("ROW", 8), ("TIME", 17), ("SOURCE ID", 11), ("ANTENNA", 9), ("REFANT 1", 10), ("REAL 1", 11), ("IMAG 1", 11), ("REAL 2", 11), ("IMAG 2", 11)))
    return tables.read_bandpass(spark, _printed(rows, head), 1e9, 1e6)


# ---------------------------------------------------------------- selections, sorts, sets


@query(f"with {VT} select floor(time / 7200)::bigint as bin, count(*) as n from vt group by 1")
def sel_bin_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two hours, by their text."""
    _, seconds = parse_bin("2h")
    return time_axis(spark, sf_dir).groupBy(F.floor(F.col("time") / seconds).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {VL} select {ROW}, re from vl order by tslot, seq")
def sort_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by ranges of time, so that the result's partitions follow one another."""
    return visibilities(spark, sf_dir).select(*ROWS, "re").orderBy("tslot", "seq")


@query("""with a as (select n_nationkey::bigint as ant, avg(s_acctbal) as x, min(s_acctbal) as y, max(s_acctbal) as z from supplier join nation on s_nationkey = n_nationkey group by 1),
 n as (select p.ant as ant1, q.ant as ant2, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) as length from a p join a q on p.ant < q.ant) select ant1, ant2, length, row_number() over (order by length, ant1, ant2) as place from n""", "length", 4)
def sort_baseline_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines by the distance of their antennas' positions; a row a baseline, few beside their data."""
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    ants = n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").cast("bigint").alias("ant"), F.col("n_name").alias("name"))
    n = rebin.baselines(ants.agg(F.avg("s_acctbal").alias("x"), F.min("s_acctbal").alias("y"), F.max("s_acctbal").alias("z"))).select("ant1", "ant2", "length")
    return n.withColumn("place", F.row_number().over(Window.orderBy("length", "ant1", "ant2")).cast("bigint"))


@query("select event_id as id, event_type from events order by ts desc, event_id desc limit 5")
def topk_recent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select(F.col("event_id").alias("id"), "event_type")


@query("select n_nationkey::bigint as dir, max(label) as label from (select s_nationkey as n_nationkey, 'supplier' as label from supplier union select c_nationkey, 'customer' from customer) group by 1")
def set_union_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions named by either of two models."""
    at = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("dir"), F.lit(t).alias("label"))
    both = at("supplier", "s_nationkey").union(at("customer", "c_nationkey")).distinct()
    return both.groupBy(F.col("dir").cast("bigint").alias("dir")).agg(F.max("label").alias("label"))


@query("select l_suppkey as feed, bool_or(l_returnflag = 'R' or l_linestatus = 'O') as circular, bool_or(l_returnflag = 'A') as linear, case when bool_or(l_returnflag = 'R' or l_linestatus = 'O') and bool_or(l_returnflag = 'A') then 'mixed' when bool_or(l_returnflag = 'A') then 'linear' when bool_or(l_returnflag = 'R' or l_linestatus = 'O') then 'circular' else 'none' end as kind from lineitem group by 1")
def meta_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by the receptors that they have: R and O stand for circular ones, A for linear ones."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("feed"))
    kinds = r.agg(F.bool_or((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O")).alias("circular"), F.bool_or(F.col("l_returnflag") == "A").alias("linear"))
    return kinds.withColumn("kind", F.when(F.col("circular") & F.col("linear"), "mixed").when(F.col("linear"), "linear").when(F.col("circular"), "circular").otherwise("none"))


@query(f"with {VL}, x as (select tslot, chan, ant1, ant2, seq, re as a, im as b, mre as c, w / 50 - 0.5 as d from vl), y as (select *, (a * a + b * b) * (c * c + d * d) <= 0.01::double as singular from x) select tslot, chan, ant1, ant2, seq, singular, case when singular then 0 else a / (a * a + b * b) end as a_re, case when singular then 0 else -d / (c * c + d * d) end as d_im from y", "a_re d_im")
def diag_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d, bad = diagonal_inverse(cx("re", "im"), Cx(F.col("mre"), F.col("w") / 50 - 0.5), 0.1)
    return visibilities(spark, sf_dir).select(*ROWS, bad.alias("singular"), a.re.alias("a_re"), d.im.alias("d_im"))


# ---------------------------------------------------------------- flag sets

#: Kinds of events as stored sets with gaps between their bits, and an order that names two of them and one that isn't there.
SETS = "ev as (select event_type as name, row_number() over (order by event_type) * 2 as bit from events group by 1), sets as (select name, bit, row_number() over (order by case name when 'view' then 0 when 'click' then 1 else 2 end, bit) - 1 as place, 1::bigint << bit::int as mask from ev)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name")).distinct()
    bits = names.withColumn("bit", (F.row_number().over(Window.orderBy("name")) * 2).cast("bigint"))
    order = spark.createDataFrame([("view", 0), ("gone", 1), ("click", 2)], "name string, place bigint")
    return flagsets.loaded(bits, order)


@query(f"with {SETS} select * from sets")
def flagset_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)


NEW = "nw as (select name, row_number() over (order by name) as k from (values ('alpha'), ('click'), ('zulu')) v(name) where name not in (select name from ev)), fr as (select b as bit, row_number() over (order by b) as k from range(32) r(b) where b not in (select bit from ev))"


@query(f"with {SETS}, {NEW} select * from sets union all select name, bit, (select max(place) from sets) + nw.k, 1::bigint << bit::int from nw join fr using (k)")
def flagset_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names take the first free bits."""
    return flagsets.created(_sets(spark, sf_dir), spark.createDataFrame([("zulu",), ("alpha",), ("click",)], "name string"))


@query(f"with {SETS} select name, mask, (select bit_or(mask) from sets where name in ('click', 'view')) as removed from sets where name not in ('click', 'view')")
def flagset_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, gone = flagsets.removed(_sets(spark, sf_dir), "click", "view")
    return left.join(F.broadcast(gone.select(F.col("mask").alias("removed")))).select("name", "mask", "removed")


@query(f"with {SETS}, u as (select event_type, count(*) as n from events group by 1), p as (select '-click' as policy, bit_or(mask) as mask, false as legacy from sets where name <> 'click' union all select 'click,nothing', bit_or(mask), false from sets where name = 'click' union all select 'FLAG', 0, true union all select '12', 12, false) select policy, p.mask, legacy, coalesce(sum(n) filter (s.mask & p.mask <> 0), 0)::bigint as applied from p, u join sets s on s.name = u.event_type group by all")
def flag_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of four policies, and how many events each would flag."""
    sets = _sets(spark, sf_dir)
    rules = {"-click": "-click", "click,nothing": ["click", "nothing"], "FLAG": "FLAG", "12": 12}
    p = None
    for name, rule in rules.items():
        one = flagsets.policy(sets, rule).select(F.lit(name).alias("policy"), F.col("mask").alias("p_mask"), "legacy")
        p = one if p is None else p.unionByName(one)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).join(sets, "name")
    met = n.join(F.broadcast(p))
    return met.groupBy("policy", F.col("p_mask").alias("mask"), "legacy").agg(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.col("p_mask")) != 0, F.col("n"))), F.lit(0)).cast("bigint").alias("applied"))


_COUNTED = {"prior": 1, "skipsol": 32768}


@query(f"""with {VL}, x as (select *, fl & 1 = 1 as legacy, scan <> 1995 as des, case when fl = 0 and w > 40 then 16384 else fl end as nf from vl), c as (select count(*) as total, count(*) filter (legacy) as flag, count(*) filter (fl & 1 <> 0) as prior, count(*) filter (fl & 32768 <> 0) as skipsol, count(*) filter (des) as des, count(*) filter (fl <> 0) as i, count(*) filter (nf <> 0 and fl = 0) as n, count(*) filter (nf <> 0) as o from x)
 select name, k as n, 100.0::double * k / total as percent from c, lateral (values ('TOTAL', total), ('FLAG', flag), ('prior', prior), ('skipsol', skipsol), ('DESEL', des), ('IN', i), ('NEW', n), ('OUT', o)) as v(name, k)""", "percent")  # fmt: skip
def flag_counts_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir).withColumns({"bits": F.col("fl"), "legacy": flags.has(1), "deselected": F.col("scan") != 1995})
    return flagsets.counts(v.withColumn("new_fl", flags.raised((F.col("fl") == 0) & (F.col("w") > 40), FL["MAD"])), _COUNTED)


@query(f"with {VL}, {ABS}, {MAD}, c as (select tslot, chan, ant1, ant2, bit_or(case when r.fl = 0 and x > 3 / 1.4826 * mad then r.fl | {FL['MAD']} else r.fl end) & 32766 <> 0 as new from r left join m using (ant1, ant2) group by all) select v.tslot, v.chan, v.ant1, v.ant2, v.seq, case when new then (v.fl & ~2::bigint) | 2 else v.fl & ~2::bigint end as bits, new as flag from vl v join c using (tslot, chan, ant1, ant2)")
def flag_save_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a run, flags of whole cubes go back to the rows: the run's own bit is cleared and set anew."""
    found = stats.mad_flags(_absres(spark, sf_dir), 3.0, 1e9, FL["MAD"])
    v = visibilities(spark, sf_dir).select(*ROWS, F.col("fl").alias("bits"))
    return flags.stored(v, found, ["tslot", "chan", "ant1", "ant2"], 2).select(*ROWS, "bits", "flag")


@query(f"with {VL}, c as (select tslot as t, ant1 % 2 as ddid, chan, bool_and(fl <> 0) as flag from vl group by all), s as (select t, ddid, list(flag order by chan) as flags, list(chan order by chan) as chans from c group by all) select v.tslot, v.chan, v.ant1, v.ant2, v.seq, s.flags from vl v join s on s.t = v.tslot and s.ddid = v.ant1 % 2")
def flag_cube_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir).withColumns({"t": F.col("tslot"), "ddid": F.col("ant1") % 2})
    cube = v.groupBy("t", "ddid", "chan").agg(F.bool_and(F.col("fl") != 0).alias("flag"))
    return flagsets.from_cube(v.select(*ROWS, "t", "ddid"), cube).select(*ROWS, "flags")
