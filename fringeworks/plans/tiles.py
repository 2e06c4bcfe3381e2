"""Weights, models, look-up joins, chunks and cubes on whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.algebra import evaluated, weights
from ..functions.cx import cx, rotated_hands
from ..functions.grammar import parse_bin
from ..functions.sky import nearest
from ..operators import flags, gains, rebin, store
from ..schema import FL
from ..sources.views import ANTS, SLOT_DAYS, VC, VL, VT, correlations, time_axis, visibilities
from .queries import G, RB, cells, given_gains
from .registry import query

SAMPLE = ["t", "chan", "ant1", "ant2"]
KEY = "t, chan, ant1, ant2"


def corrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(cells(spark, sf_dir))


# ---------------------------------------------------------------- correlations, weights, models


@query(f"with {VL}, {RB}, {VC} select {KEY}, corr, re, im from vc where corr in (0, 3)", "re im")
def sel_corr_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrs(spark, sf_dir).where("corr in (0, 3)").select(*SAMPLE, "corr", "re", "im")


@query(f"with {VL}, {RB}, {VC} select {KEY}, sqrt(max(w) filter (corr = 0) * max(w) filter (corr = 3)) as w_off from vc group by all", "w_off")
def weight_offdiag(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.max(F.when(F.col("corr") == c, F.col("w")))
    return corrs(spark, sf_dir).groupBy(*SAMPLE).agg(F.sqrt(at(0) * at(3)).alias("w_off"))


@query(f"with {VL}, {RB}, {VC} select {KEY}, corr, sqrt(w) as w_root, sqrt(w) * re as d_re, sqrt(w) * im as d_im, sqrt(w) * mre as m_re, case when bad then 0 else re end as z_re, case when bad then 0 else im end as z_im, case when bad then 0 else mre end as mz_re from (select *, fl <> 0 or im > 0.9 as bad from vc)", "w_root d_re d_im m_re z_re z_im mz_re")
def weighted_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and model times the roots of weights; and as they are without weights, zero where flagged."""
    w, c = F.sqrt("w"), corrs(spark, sf_dir)
    c = c.withColumn("fl", flags.raised(F.col("im") > 0.9, FL["PRIOR"]))
    plain = lambda x: F.when(F.col("fl") != 0, 0.0).otherwise(F.col(x))
    return c.select(*SAMPLE, "corr", w.alias("w_root"), (w * F.col("re")).alias("d_re"), (w * F.col("im")).alias("d_im"), (w * F.col("mre")).alias("m_re"), plain("re").alias("z_re"), plain("im").alias("z_im"), plain("mre").alias("mz_re"))


@query(f"with {VL}, {RB}, {VC} select {KEY}, avg(w) as w_mean, avg(w) / avg(avg(w)) over () as w_norm from vc group by all", "w_mean w_norm")
def weight_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = corrs(spark, sf_dir).groupBy(*SAMPLE).agg(F.avg("w").alias("w_mean"))
    return mean.join(F.broadcast(mean.agg(F.avg("w_mean").alias("_all")))).withColumn("w_norm", F.col("w_mean") / F.col("_all")).drop("_all")


@query(f"with {VL} select tslot, chan, ant1, ant2, seq, round(mre, 16) as m_re, round(im, 16) as m_im from vl", "m_re m_im")
def round_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).select("tslot", "chan", "ant1", "ant2", "seq", F.round("mre", 16).alias("m_re"), F.round("im", 16).alias("m_im"))


@query(f"with {VL}, {RB}, {VC} select {KEY}, corr, w * avg(abs(re)) over (partition by {KEY}) as weight from vc", "weight")
def weight_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of columns, W*Q~: a column with ~ stands for its mean over correlations."""
    c = corrs(spark, sf_dir).withColumns({"W": F.col("w"), "Q": F.abs("re")})
    return c.withColumn("weight", weights(c, "W*Q~", SAMPLE)).select(*SAMPLE, "corr", "weight")


@query(f"""with {VL} select tslot, chan, ant1, ant2, w, 0::bigint as model, 0::bigint as dir, re - mre as m_re, im - mim as m_im from vl union all select tslot, chan, ant1, ant2, w, 0, 1, mre, mim from vl
 union all select tslot, chan, ant1, ant2, w, 1, 0, 1 + re, im from vl""", "m_re m_im")  # fmt: skip
def model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(visibilities(spark, sf_dir), "A+-B:B,1+A", {"A": cx("re", "im"), "B": cx("mre", "mim")}, ["tslot", "chan", "ant1", "ant2", "w"])


# ---------------------------------------------------------------- look-up joins


@query("select s_suppkey as row, n_nationkey::bigint as ddid, n_regionkey::bigint as spw, chan, 1e9::double + n_regionkey * 1e8::double + chan * 1e6::double as freq from supplier join nation on s_nationkey = n_nationkey join (select r_regionkey, unnest(range(r_regionkey::bigint + 2)) as chan from region) c on n_regionkey = r_regionkey")
def join_ddid_spw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's description names its window, and windows have different numbers of channels."""
    rows, dd, spw = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    spw = spw.select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("r_regionkey").cast("bigint") + 1)).alias("chan"))
    out = rows.join(dd, F.col("s_nationkey") == F.col("n_nationkey")).join(spw, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("s_suppkey").alias("row"), F.col("n_nationkey").cast("bigint").alias("ddid"), F.col("r_regionkey").cast("bigint").alias("spw"), "chan", (1e9 + F.col("r_regionkey") * 1e8 + F.col("chan") * 1e6).alias("freq"))


@query(f"with {VL}, {RB}, s as (select floor(t / 4)::bigint as ti, floor(chan / 2)::bigint as fi, ant1, avg(re) as gain from rb group by all) select {KEY}, gain from rb join s using (ant1) where ti = floor(t / 4) and fi = floor(chan / 2)", "gain")
def join_interval_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).withColumns({"ti": rebin.interval("t", 4), "fi": rebin.interval("chan", 2)})
    return c.join(c.groupBy("ti", "fi", "ant1").agg(F.avg("re").alias("gain")), ["ti", "fi", "ant1"]).select(*SAMPLE, "gain")


@query(f"""with {VL}, v as (select floor(tslot / {SLOT_DAYS})::bigint as t, * from vl), grid as (select t, p as ant1, q as ant2 from (select distinct t from v), range({ANTS}) a(p), range({ANTS}) b(q) where p < q)
 select t, ant1, ant2, not exists (select 1 from v where v.t = grid.t and v.ant1 = grid.ant1 and v.ant2 = grid.ant2) as missing from grid""")  # fmt: skip
def join_pad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.complete_grid(rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS), ANTS)


BANDS = [0.0, 2.5, 5.0, 7.5, 10.0]


@query(f"with {VL} select tslot, chan, ant1, ant2, w, (select arg_min(b, abs(re - b) * 1000 + b / 1e6) from (select unnest({BANDS})::double as b)) as band from vl")
def join_beam_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).select("tslot", "chan", "ant1", "ant2", "w", nearest(F.col("re"), BANDS).alias("band"))


@query(f"""with {VT}, s as (select ant, time, max(id) as sample from vt where id % 10 = 3 group by all), f as (select ant, arg_min(sample, time) as first from s group by 1)
 select vt.ant, vt.time, vt.id, coalesce(s.sample, f.first) as sample from vt asof left join s on s.ant = vt.ant and s.time <= vt.time left join f on f.ant = vt.ant""")  # fmt: skip
def join_beam_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = time_axis(spark, sf_dir)
    starts = v.where("id % 10 = 3").groupBy("ant", "time").agg(F.max("id").alias("sample"))
    return store.latest_at_or_before(v.select("ant", "time", "id"), starts, ["ant"], "time", "sample")


@query(f"with {VL}, {RB}, g as (select ant1, ant2, chan, sum(mre * re) / sum(re * re + im * im) as gr, -sum(mre * im) / sum(re * re + im * im) as gi from rb group by all) select {KEY}, gr * re - gi * im as c_re, gr * im + gi * re as c_im from rb join g using (ant1, ant2, chan)", "c_re c_im")
def join_ifr_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    x = c.join(gains.baseline_gains(c, ["ant1", "ant2", "chan"]), ["ant1", "ant2", "chan"])
    out = cx("g_re", "g_im") * cx("re", "im")
    return x.select(*SAMPLE, out.re.alias("c_re"), out.im.alias("c_im"))


@query("with o as (select n_name, row_number() over (order by n_name) - 1 as place from nation) select s_suppkey as row, n.n_nationkey::bigint as ant, o.place from supplier join nation n on n.n_nationkey = s_nationkey join o using (n_name)")
def join_antenna_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    order = rebin.dense_index(n, "n_name").select("n_name", F.col("ordinal").cast("bigint").alias("place"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(order, "n_name")
    return s.select(F.col("s_suppkey").alias("row"), F.col("n_nationkey").cast("bigint").alias("ant"), "place")


# ---------------------------------------------------------------- chunks and cubes


@query(f"""with {VL}, d as (select distinct scan, tslot from vl), j as (select *, case when tslot - lag(tslot) over (partition by scan order by tslot) > 3 then 1 else 0 end as s from d), i as (select *, sum(s) over (partition by scan order by tslot) as k from j),
 p as (select *, floor((row_number() over (partition by scan, k order by tslot) - 1) / 16)::bigint as part from i) select scan, tslot, (dense_rank() over (partition by scan order by k, part) - 1)::bigint as chunk from p""")  # fmt: skip
def chunk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rebin.chunks_by_slots(visibilities(spark, sf_dir).select("scan", "tslot").distinct(), ["scan"], "tslot", 3, 16)
    return out.select("scan", "tslot", F.col("chunk").cast("bigint").alias("chunk"))


CHUNK_STARTS = """with recursive {}, nx as (select a.g, a.x, min(b.x) as nxt from d a left join d b on b.g = a.g and b.x >= a.x + {} group by all), st as (select g, min(x) as s from d group by 1 union all select st.g, nx.nxt from st join nx on nx.g = st.g and nx.x = st.s where nx.nxt is not null)"""


@query(CHUNK_STARTS.format(f"{VL}, d as (select distinct scan as g, tslot as x from vl)", 20) + " select d.g as scan, d.x as tslot, count(*) - 1 as chunk from d join st on st.g = d.g and st.s <= d.x group by all")
def chunk_time_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.chunks_by_length(visibilities(spark, sf_dir).select("scan", "tslot").distinct(), ["scan"], "tslot", 20)


@query(f"with {VL} select floor(chan / 3)::bigint as fchunk, min(1e9::double + chan * 1e6::double) as lo, max(1e9::double + chan * 1e6::double) as hi, count(distinct chan) as channels from vl group by 1")
def chunk_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = 1e9 + F.col("chan") * 1e6
    axis = visibilities(spark, sf_dir).select("chan").distinct()
    return axis.groupBy(F.floor(F.col("chan") / 3).alias("fchunk")).agg(F.min(f).alias("lo"), F.max(f).alias("hi"), F.count("chan").alias("channels"))


@query(f"with {VL}, a as (select distinct ant1 % 2 as ddid, chan, 1e9::double + (ant1 % 2) * 1e8::double + chan * 1e6::double as freq from vl) select ddid, chan, freq, freq > lag(freq) over (order by ddid, chan) as rising, row_number() over (order by ddid, chan) - 1 as place, min(row_no) over (partition by ddid) as first from (select *, row_number() over (order by ddid, chan) - 1 as row_no from a)")
def freq_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes of all descriptions one after another, with each one's first place, and whether frequencies rise."""
    axis = visibilities(spark, sf_dir).select((F.col("ant1") % 2).alias("ddid"), "chan").distinct().withColumn("freq", 1e9 + F.col("ddid") * 1e8 + F.col("chan") * 1e6)
    order = Window.orderBy("ddid", "chan")
    axis = axis.withColumns({"rising": F.col("freq") > F.lag("freq").over(order), "place": (F.row_number().over(order) - 1).cast("bigint")})
    return axis.withColumn("first", F.min("place").over(Window.partitionBy("ddid")))


@query(CHUNK_STARTS.format(f"{VL}, d as (select distinct 0 as g, chan as x from vl)", 2.5) + " select d.x as chan, count(*) - 1 as chunk from d join st on st.s <= d.x group by all")
def chunk_freq_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk begins 2.5 MHz or more after the one before began; channels are 1 MHz apart."""
    _, width = parse_bin("2.5MHz")
    axis = visibilities(spark, sf_dir).select("chan").distinct().withColumns({"axis": F.lit(0), "freq": 1e9 + F.col("chan") * 1e6})
    return rebin.chunks_by_length(axis, ["axis"], "freq", width).select("chan", "chunk")


@query(f"with {VL}, a as (select *, case when fl & 1 <> 0 then fl | 1 else fl end as f1 from vl where scan = 1996) select tslot, chan, ant1, ant2, seq, re * w as d_re, im * w as d_im, mre * w as m_re, f1 | case when re = 0 and im = 0 then 4 else 0 end | case when w = 0 then 8192 else 0 end | case when re * re + im * im < 4 or re * re + im * im > 100 then 32768 else 0 end as fl from a", "d_re d_im m_re")
def load_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data, weights, flags and model of one tile: the selection reaches the scan, all else is one projection."""
    v = flags.apply_bits(visibilities(spark, sf_dir).where("scan = 1996"), FL["PRIOR"])
    v = flags.outside_baselines(flags.weights(flags.invalid(v)).withColumns({"u": F.col("re"), "v": F.col("im")}), 2.0, 10.0)
    w = F.col("w")
    return v.select("tslot", "chan", "ant1", "ant2", "seq", (F.col("re") * w).alias("d_re"), (F.col("im") * w).alias("d_im"), (F.col("mre") * w).alias("m_re"), "fl")


@query(f"with {VL}, {RB}, {VC}, x as (select *, 0.1::double * ant1 + 0.01::double * t as ap, 0.1::double * ant2 + 0.01::double * t as aq from vc), y as (select *, -case corr when 0 then ap - aq when 1 then ap + aq when 2 then -ap - aq else aq - ap end as ph from x) select {KEY}, corr, re * cos(ph) - im * sin(ph) as re, re * sin(ph) + im * cos(ph) as im from y", "re im")
def pa_derotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular hands are turned back by the angles of both ends, which are looked up by time and antenna."""
    c = corrs(spark, sf_dir)
    table = c.select("t", F.explode(F.array("ant1", "ant2")).alias("ant")).distinct().withColumn("angle", 0.1 * F.col("ant") + 0.01 * F.col("t"))
    p, q = (table.select("t", F.col("ant").alias(f"ant{i}"), F.col("angle").alias(f"a{i}")) for i in (1, 2))
    return rotated_hands(c.join(p, ["t", "ant1"]).join(q, ["t", "ant2"]), -1).select(*SAMPLE, "corr", "re", "im")


@query(f"with {VL} select floor(tslot / {SLOT_DAYS})::bigint as t, chan, ant1, ant2, avg(mre) as m, count(*) as n from vl where fl = 0 group by 1, 2, 3, 4", "m")
def rebin_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.slots(visibilities(spark, sf_dir).where("fl = 0"), SLOT_DAYS).groupBy(*SAMPLE).agg(F.avg("mre").alias("m"), F.count(F.lit(1)).alias("n"))


@query(f"with {VL} select ant1 % 2 as ddid, floor(tslot / {SLOT_DAYS})::bigint as tchunk, min(tslot) as first, count(*) as n, 'D' || (ant1 % 2) || 'T' || floor(tslot / {SLOT_DAYS})::bigint as label from vl group by all")
def rows_by_ddid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir).groupBy((F.col("ant1") % 2).alias("ddid"), F.floor(F.col("tslot") / SLOT_DAYS).alias("tchunk"))
    return v.agg(F.min("tslot").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("label", F.concat(F.lit("D"), "ddid", F.lit("T"), "tchunk"))


SPANS = "sp as (select l_orderkey as k, (l_orderkey // 2048)::bigint as g, min(date_diff('day', date '1995-01-01', cast(l_shipdate as date))) as lo, max(date_diff('day', date '1995-01-01', cast(l_shipdate as date))) as hi from lineitem group by 1), sq as (select *, lo + least(hi - lo, 3) as top from sp)"


@query(f"with {SPANS}, r as (select *, max(top) over (partition by g order by lo, top rows between unbounded preceding and 1 preceding) as reach from sq), i as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by g order by lo, top rows unbounded preceding) as part from r) select g, min(lo) as first, max(top) as last, count(*) as n from i group by g, part")
def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row chunks that overlap, by groups of 2048 orders."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    s = li.groupBy(F.col("l_orderkey")).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    s = s.select(F.floor(F.col("l_orderkey") / 2048).alias("g"), "lo", (F.col("lo") + F.least(F.col("hi") - F.col("lo"), F.lit(3))).alias("hi"))
    return rebin.merged_spans(s, ["g"], "lo", "hi")


@query(f"""with recursive {SPANS}, r as (select *, max(top) over (partition by g order by lo, top rows between unbounded preceding and 1 preceding) as reach from sq), i as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by g order by lo, top rows unbounded preceding) as part from r),
 o as (select g, min(lo) as first, max(top) as last, count(*) as n, row_number() over (partition by g order by min(lo)) as i from i group by g, part), walk as (select g, i, n as have, 0::bigint as tile from o where i = 1
 union all select o.g, o.i, case when have > 4 or have + o.n > 16 then o.n else have + o.n end, case when have > 4 or have + o.n > 16 then tile + 1 else tile end from walk join o on o.g = walk.g and o.i = walk.i + 1)
 select g, tile, min(first) as first, max(last) as last, sum(n)::bigint as n, count(*) as merged from walk join o using (g, i) group by g, tile""")  # fmt: skip
def tile_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles one after another are merged up to more than 4 chunks, never beyond 16."""
    t = rebin.coarsened(tile_merge(spark, sf_dir), ["g"], "first", "n", 4, 16)
    return t.groupBy("g", "tile").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("merged"))


@query(f"with {VL}, {RB} select floor(t / 8)::bigint as chunk, min(t) as t_lo, max(t) as t_hi, min(chan) as f_lo, max(chan) as f_hi, count(*) as n from rb group by 1")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).groupBy(F.floor(F.col("t") / 8).alias("chunk"))
    return c.agg(F.min("t").alias("t_lo"), F.max("t").alias("t_hi"), F.min("chan").alias("f_lo"), F.max("chan").alias("f_hi"), F.count(F.lit(1)).alias("n"))


@query(f"with {VL}, {RB}, {VC} select {KEY}, corr, re from vc", "re")
def unpivot_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = corrs(spark, sf_dir).groupBy(*SAMPLE).pivot("corr", [0, 1, 2, 3]).agg(F.first("re"))
    return wide.unpivot(SAMPLE, ["0", "1", "2", "3"], "corr", "re").withColumn("corr", F.col("corr").cast("bigint"))


_W = ", ".join(f"case when f <> 0 then 0 else w{k} end as w{k}" for k in range(4))
_WK = ", ".join(f"max(w) filter (corr = {k}) as w{k}" for k in range(4))


@query(f"with {VL}, {RB}, {VC}, x as (select t, chan, ant1, ant2, bit_or(case when im > 0.9 and corr = 0 then fl | 1 else fl end | case when ant1 = ant2 then {FL['SKIPSOL']} else 0 end)::bigint as f, list(re order by corr) as re, {_WK} from vc group by 1, 2, 3, 4) select t, chan, ant1, ant2, f as fl, list_sum(re) as total, {_W} from x", "total w0 w1 w2 w3")
def chunk_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with all their correlations: flags of any of them, autocorrelations left out of fits, weights zero where flagged."""
    c = corrs(spark, sf_dir)
    c = c.withColumn("fl", flags.raised((F.col("im") > 0.9) & (F.col("corr") == 0), 1)).withColumn("fl", flags.raised(F.col("ant1") == F.col("ant2"), FL["SKIPSOL"]))
    s = c.groupBy(*SAMPLE).agg(F.bit_or("fl").alias("fl"), F.sum("re").alias("total"), *[F.max(F.when(F.col("corr") == k, F.col("w"))).alias(f"w{k}") for k in range(4)])
    return s.withColumns({f"w{k}": F.when(F.col("fl") != 0, 0.0).otherwise(F.col(f"w{k}")) for k in range(4)})


@query(f"with {VL} select floor(tslot / 8)::bigint as ti, floor(chan / 2)::bigint as fi, ant1, bool_and(fl <> 0) as all_bad, avg(tslot) as time, avg(1e3::double + chan) as freq from vl group by all", "time freq")
def interval_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir).groupBy(rebin.interval("tslot", 8).alias("ti"), rebin.interval("chan", 2).alias("fi"), "ant1")
    return v.agg(F.bool_and(F.col("fl") != 0).alias("all_bad"), F.avg("tslot").alias("time"), F.avg(1e3 + F.col("chan")).alias("freq"))


@query(f"with {VL}, {RB}, {G} select {KEY}, corr.re - (gpr * gqr + gpi * gqi) * mre as r_re, corr.im - (gpi * gqr - gpr * gqi) * mre as r_im from (select rb.*, p.g_re as gpr, p.g_im as gpi, q.g_re as gqr, q.g_im as gqi from rb join g p on p.ant = ant1 join g q on q.ant = ant2) as corr", "r_re r_im")
def corrupt_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return gains.corrupted(gains.with_gains(c, given_gains(c))).select(*SAMPLE, "r_re", "r_im")
