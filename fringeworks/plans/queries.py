"""The operators applied to whole tables through the views, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cx import Cx, cx, mat_inverse, polar, sandwich
from ..functions.grammar import in_range
from ..operators import flags, gains, rebin, stats, store
from ..schema import FL
from ..sources.tables import written
from ..sources.views import SLOT_DAYS, VC, VE, VL, VT, correlations, spectra, time_axis, visibilities
from .registry import query

RB = f"""rb as (select floor(tslot / {SLOT_DAYS})::bigint as t, chan, ant1, ant2, sum(w * re) / sum(w) as re, sum(w * im) / sum(w) as im, avg(mre) as mre, avg(mim) as mim, sum(w) as w, 0::bigint as fl from vl where fl = 0 group by 1, 2, 3, 4)"""
BOTH = "b as (select t, chan, ant1, ant2, re, im, mre, mim, w from rb where ant1 <> ant2 union all select t, chan, ant2, ant1, re, -im, mre, -mim, w from rb where ant1 <> ant2)"
#: Gains that every antenna has without a fit, for queries about applying them.
G = "g as (select distinct ant, 1 + ant / 10.0::double as g_re, ant / 20.0::double as g_im from (select ant1 as ant from rb union select ant2 from rb))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.good_bins(visibilities(spark, sf_dir), SLOT_DAYS)


def given_gains(vis: DataFrame) -> DataFrame:
    ants = vis.select(F.explode(F.array("ant1", "ant2")).alias("ant")).distinct()
    return ants.select("ant", (1 + F.col("ant") / 10).alias("g_re"), (F.col("ant") / 20).alias("g_im"))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return gains.with_gains(c, given_gains(c))


# ---------------------------------------------------------------- scans and selections


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01'")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1997-01-01'")
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity")


@query(f"with {VL} select w from vl")
def scan_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).select("w")


@query("select vec_id as row, embedding[9:16] as part, [x for x, i in embedding if (i - 1) % 16 = 0] as strided from embeddings")
def scan_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row"), F.slice("embedding", 9, 8).alias("part"), F.filter("embedding", lambda x, i: i % 16 == 0).alias("strided"))


@query(f"with {VL} select tslot, chan, ant1, ant2, re from vl where scan in (1995, 1996) and chan = 2 and w > 10")
def sel_taql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).where(F.expr("w > 10")).where(F.col("scan").isin(1995, 1996) & (F.col("chan") == 2)).select("tslot", "chan", "ant1", "ant2", "re")


@query(f"with {VL} select tslot, chan, ant1, ant2, re from vl where chan >= 0 and chan <= 5 and chan % 2 = 0")
def sel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).where(in_range(F.col("chan"), "~5:2", 7)).select("tslot", "chan", "ant1", "ant2", "re")


@query(f"with {VE} select row, chan, x from ve where chan >= 8 and chan < 24")
def sel_chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).where(in_range(F.col("chan"), "8:24", 64)).select("row", "chan", "x")


@query(f"with {VL} select tslot, chan, ant1, ant2, w, case when scan = 1995 then fl else fl | 32768 end as fl from vl")
def sel_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).withColumn("fl", flags.raised(F.col("scan") != 1995, FL["SKIPSOL"])).select("tslot", "chan", "ant1", "ant2", "w", "fl")


@query(f"with {VL} select tslot, chan, ant1, ant2, w, fl | (case when re * re + im * im < 4 or re * re + im * im > 100 then 32768 else 0 end) as fl from vl")
def sel_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    uv = visibilities(spark, sf_dir).withColumns({"u": F.col("re"), "v": F.col("im")})
    return flags.outside_baselines(uv, 2.0, 10.0).select("tslot", "chan", "ant1", "ant2", "w", "fl")


@query(f"with {VL} select seq, tslot, (dense_rank() over (order by tslot) - 1)::bigint as ordinal from vl")
def uniq_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordinal for each row; only the distinct values are ranked."""
    v = visibilities(spark, sf_dir)
    return v.select("seq", "tslot").join(rebin.dense_index(v, "tslot"), "tslot").select("seq", "tslot", F.col("ordinal").cast("bigint").alias("ordinal"))


#: Nations as antennas: name and place from what their suppliers have.
ANT = """an as (select n_nationkey::bigint as ant, 'ANT-' || n_name as name, avg(s_acctbal) as x, min(s_acctbal) as y, max(s_acctbal) as z from nation join supplier on s_nationkey = n_nationkey group by all),
 pre as (select max(n) + 1 as p from (select unnest(range(0, 40)) as n, min(name) as a, max(name) as b from an) where a[1:n] = b[1:n] and n <= len(a))"""


@query(f"with {ANT} select a.ant as ant1, b.ant as ant2, a.name[(select p from pre):] || '-' || b.name[(select p from pre):] as name, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as length from an a join an b on a.ant < b.ant", "length", 4)
def meta_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of antennas, few beside their data: short names (less what all begin with) and lengths."""
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    ants = n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").cast("bigint").alias("ant"), F.concat(F.lit("ANT-"), "n_name").alias("name"))
    return rebin.baselines(ants.agg(F.avg("s_acctbal").alias("x"), F.min("s_acctbal").alias("y"), F.max("s_acctbal").alias("z")))


@query(f"with {VL} select tslot, chan, ant1, ant2, w * re as weight, sqrt(w) as whitened, sqrt(w * (w + 1)) as offdiag from vl", "weight whitened offdiag")
def weight_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return visibilities(spark, sf_dir).select("tslot", "chan", "ant1", "ant2", (w * F.col("re")).alias("weight"), F.sqrt(w).alias("whitened"), F.sqrt(w * (w + 1)).alias("offdiag"))


@query(f"with {VL}, p as (select tslot, chan, ant1, ant2, re + mre as sr, im as si, sqrt(sqrt(re * re + im * im) * sqrt(mre * mre)) as a from vl) select tslot, chan, ant1, ant2, a * cos(atan2(si, sr)) as xy_re, a * sin(atan2(si, sr)) as xy_im from p", "xy_re xy_im")
def null_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy, yx = cx("re", "im"), cx("mre", "mim")
    out = polar((xy + yx).arg()).scaled(F.sqrt(xy.abs() * yx.abs()))
    return visibilities(spark, sf_dir).select("tslot", "chan", "ant1", "ant2", out.re.alias("xy_re"), out.im.alias("xy_im"))


# ---------------------------------------------------------------- grouping and re-binning


@query(f"""with {VL} select floor(tslot / {SLOT_DAYS})::bigint as t, chan, ant1, ant2, sum(w * re) filter (fl = 0) / sum(w) filter (fl = 0) as re, sum(w * im) filter (fl = 0) / sum(w) filter (fl = 0) as im, avg(mre) filter (fl = 0) as mre,
 coalesce(sum(w) filter (fl = 0), 0.0::double) as w, case when count(*) filter (fl = 0) > 0 then 0 else bit_or(fl) end::bigint as fl from vl group by 1, 2, 3, 4""", "re im mre w")  # fmt: skip
def rebin_vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.rebin_vis(rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS)).drop("mim")


@query(f"with {VL}, f as (select distinct chan, 1e9::double + chan * 1e6::double as freq from vl) select floor(chan / 3)::bigint as out_chan, min(chan) as lo, max(chan) as hi, (min(freq) + max(freq)) / 2 as centre, max(freq) - min(freq) + 1e6::double as width from f group by 1")
def rebin_chan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output channels: their inputs, centre and width, from the outer edges of the merged ones."""
    axis = visibilities(spark, sf_dir).select("chan").distinct().withColumns({"lo_edge": 1e9 + F.col("chan") * 1e6 - 5e5, "hi_edge": 1e9 + F.col("chan") * 1e6 + 5e5})
    g = axis.groupBy(F.floor(F.col("chan") / 3).alias("out_chan"))
    return g.agg(F.min("chan").alias("lo"), F.max("chan").alias("hi"), ((F.min("lo_edge") + F.max("hi_edge")) / 2).alias("centre"), (F.max("hi_edge") - F.min("lo_edge")).alias("width"))


@query(f"with {VL} select floor(tslot / {SLOT_DAYS})::bigint as t, avg(tslot) as time, arg_max(ant2, seq * 100000 + ant2 * 10000 + scan) as ant, arg_max(scan, seq * 100000 + ant2 * 10000 + scan) as ddid, count(*) as n from vl group by 1", "time")
def rebin_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean time, and the last row's antenna and description."""
    last = F.struct("seq", "ant2", "scan")
    return rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS).groupBy("t").agg(F.avg("tslot").alias("time"), F.max_by("ant2", last).alias("ant"), F.max_by("scan", last).alias("ddid"), F.count(F.lit(1)).alias("n"))


@query(f"with {VL}, {RB} select v.tslot, v.chan, v.ant1, v.ant2, v.w, rb.re as bin_re from vl v join rb on rb.t = floor(v.tslot / {SLOT_DAYS}) and rb.chan = v.chan and rb.ant1 = v.ant1 and rb.ant2 = v.ant2", "bin_re")
def sink_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir)
    mean = rebin.good_bins(v, SLOT_DAYS).select(*rebin.KEYS, F.col("re").alias("bin_re"))
    return rebin.slots(v, SLOT_DAYS).join(mean, [*rebin.KEYS]).select("tslot", "chan", "ant1", "ant2", "w", "bin_re")


@query(f"""with {VT}, s as (select ant, id, case when abs(time - lag(time) over w) > 86400 then 1 else 0 end as j, time from vt window w as (partition by ant order by time, id)),
 i as (select ant, id, time, sum(j) over (partition by ant order by time, id rows unbounded preceding)::bigint as island from s) select ant, island, count(*) as n, min(time) as t0, max(time) as t1 from i group by 1, 2""", "t0 t1", 3)  # fmt: skip
def chunk_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebin.islands(time_axis(spark, sf_dir), ["ant"], ["time", "id"], "time", 86400)
    return rows.groupBy("ant", "island").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"))


@query(f"with {VL} select floor(tslot / 32)::bigint as tchunk, floor(chan / 4)::bigint as fchunk, 'D0T' || floor(tslot / 32)::bigint || 'F' || floor(chan / 4)::bigint as label, min(tslot) as t0, max(tslot) as t1, min(chan) as c0, max(chan) as c1, count(*) as n from vl group by 1, 2")
def tile_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir).groupBy(rebin.interval("tslot", 32).alias("tchunk"), rebin.interval("chan", 4).alias("fchunk"))
    out = v.agg(F.min("tslot").alias("t0"), F.max("tslot").alias("t1"), F.min("chan").alias("c0"), F.max("chan").alias("c1"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("label", F.concat(F.lit("D0T"), "tchunk", F.lit("F"), "fchunk"))


@query(f"with {VL} select floor(tslot / 60)::bigint as ti, floor(chan / 2)::bigint as fi, ant1, sum(re) as re, bool_and(fl <> 0) as all_flagged, avg(tslot) as centre from vl group by 1, 2, 3", "re centre", 4)
def interval_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir).groupBy(rebin.interval("tslot", 60).alias("ti"), rebin.interval("chan", 2).alias("fi"), "ant1")
    return v.agg(F.sum("re").alias("re"), F.bool_and(F.col("fl") != 0).alias("all_flagged"), F.avg("tslot").alias("centre"))


@query(f"with {VL}, {RB}, {VC}, x as (select * from vc where ant1 <> ant2) select t, chan, ant1, ant2, corr, re, im, w from x union all select t, chan, ant2, ant1, case corr when 1 then 2 when 2 then 1 else corr end, re, -im, w from x", "re im w")
def pivot_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.hermitian(correlations(cells(spark, sf_dir))).select("t", "chan", "ant1", "ant2", "corr", "re", "im", "w")


@query(f"with {VL}, x as (select floor(tslot / {SLOT_DAYS})::bigint as t, ant1, ant2, fl, w, tslot * 10.0::double + ant1 as u, tslot * -3.0::double + ant2 as v from vl) select t, ant1, ant2, coalesce(sum(w * u) filter (fl = 0) / sum(w) filter (fl = 0), avg(u)) as u, coalesce(sum(w * v) filter (fl = 0) / sum(w) filter (fl = 0), avg(v)) as v from x group by 1, 2, 3", "u v", 4)
def rebin_uvw(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS).withColumns({"u": F.col("tslot") * 10.0 + F.col("ant1"), "v": F.col("tslot") * -3.0 + F.col("ant2")})
    return rebin.rebin_uvw(v, ("t", "ant1", "ant2"), ("u", "v"))


@query(f"""with {VL}, {RB}, x as (select floor(t / 8)::bigint as ti, ant2 as ant, chan, re * cos(0.4::double * chan * ant2) - im * sin(0.4::double * chan * ant2) as re, re * sin(0.4::double * chan * ant2) + im * cos(0.4::double * chan * ant2) as im from rb where ant1 = 0 and ant2 > 0),
 s as (select ti, ant, k, sum(re * cos(-2 * pi() * k * chan / 64) - im * sin(-2 * pi() * k * chan / 64)) as a, sum(re * sin(-2 * pi() * k * chan / 64) + im * cos(-2 * pi() * k * chan / 64)) as b from x, range(64) r(k) group by all)
 select ti, ant, arg_max(k, round(a * a + b * b, 6)) / 64.0::double as delay, sqrt(max(round(a * a + b * b, 6))) as power from s group by 1, 2""", "delay power", 4)  # fmt: skip
def delay_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delays against antenna 0, from spectra of its baselines (turned, so that there is a delay) padded to 64 channels."""
    turned = cx("re", "im") * polar(0.4 * F.col("chan") * F.col("ant2"))
    c = cells(spark, sf_dir).where("ant1 = 0 and ant2 > 0").select(rebin.interval("t", 8).alias("ti"), F.col("ant2").alias("ant"), "chan", turned.re.alias("re"), turned.im.alias("im"))
    return rebin.delays(c, ["ti", "ant"], 64)


# ---------------------------------------------------------------- flags


@query(f"with {VL} select tslot, chan, ant1, ant2, w, fl | (case when (fl & 32769) <> 0 or (case when scan = 1995 then 2 else 32768 end & 32769) <> 0 then 1 else 0 end) as fl from vl")
def flag_apply_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of a sample or of its row."""
    v = visibilities(spark, sf_dir).withColumn("row_bits", F.when(F.col("scan") == 1995, 2).otherwise(32768))
    return flags.apply_bits(v, 32769, "row_bits").select("tslot", "chan", "ant1", "ant2", "w", "fl")


@query(f"with {VL}, {RB}, {VC} select t, chan, ant1, ant2, corr, case when chan = 0 and corr in (0, 3) then fl | 4 else fl end | (case when w = 0 then 8192 else 0 end) as fl from vc")
def flag_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel 0 is all zero: diagonal correlations are invalid there, the others aren't."""
    c = correlations(cells(spark, sf_dir))
    c = c.withColumns({x: F.when(F.col("chan") == 0, 0.0).otherwise(F.col(x)) for x in ("re", "im")})
    return flags.weights(flags.invalid(c)).select("t", "chan", "ant1", "ant2", "corr", "fl")


@query(f"with {VL} select scan, count(*) as total, count(*) filter (fl <> 0) as flagged from vl group by 1")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.counts(visibilities(spark, sf_dir), ["scan"])


_BITS = ", ".join(f"('{n}', {b.bit_length() - 1}::bigint)" for n, b in FL.items())


@query(f"with {VL} select name, bit, (select count(*) from vl where (fl & (1::bigint << bit::int)) <> 0) as n from (values {_BITS}) x(name, bit)")
def flag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.categories(visibilities(spark, sf_dir))


@query(f"with {VL} select tslot, ant1, ant2, bit_or(fl) as all_bits, bit_or(fl) & 32766 as own_bits, bit_and(fl) as common_bits from vl group by 1, 2, 3")
def flag_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.saved(visibilities(spark, sf_dir), ["tslot", "ant1", "ant2"])


@query(f"""with {VL}, {RB}, bad as (select distinct t, ant1 as ant from rb where abs(im) > 0.9) select t, chan, ant1, ant2, w, fl | (case when exists (select 1 from bad where bad.t = rb.t and (ant = ant1 or ant = ant2)) then 32 else 0 end) as fl from rb""", "w")
def flag_gain_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    bad = c.where("abs(im) > 0.9").select("t", F.col("ant1").alias("ant"), F.lit(32).alias("gflag"))
    return flags.from_gains(c, bad, FL["NOSOL"]).select("t", "chan", "ant1", "ant2", "w", "fl")


@query(f"""with {VL}, {RB}, {BOTH}, c as (select t, ant1 as ant, sum((re - mre) * (re - mre) + im * im) as chi2, count(*) as n from b group by 1, 2), f as (select *, chi2 > 1.2 * (select median(chi2) from c) or n < 0.5 * (select median(n) from c) as bad from c),
 r as (select t, ant, chi2, n, bad or avg(bad::int) over (partition by t) > 0.5 or avg(bad::int) over (partition by ant) > 0.5 as bad from f) select t, ant, chi2, n, bad or avg(bad::int) over (partition by ant % 2) > 0.5 as bad from r""", "chi2")  # fmt: skip
def postmortem_chisq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells far above the median chi-squared, or with few samples; then rows and columns that are bad for the most part, and after these whole descriptions (of every other antenna)."""
    c = written(stats.chi_squared(rebin.hermitian(cells(spark, sf_dir))), "chi2")
    mid = stats.medians(c, [], "chi2", "m").join(stats.medians(c, [], "n", "k"))
    bad = c.join(F.broadcast(mid)).withColumn("bad", (F.col("chi2") > 1.2 * F.col("m")) | (F.col("n") < 0.5 * F.col("k"))).drop("m", "k")
    rows, columns = (stats.dense_flags(bad, "bad", [k], 0.5) for k in ("t", "ant"))
    both = rows.join(columns.select("t", "ant", F.col("bad").alias("too")), ["t", "ant"]).withColumn("bad", F.col("bad") | F.col("too")).drop("too")
    return stats.dense_flags(both.withColumn("ddid", F.col("ant") % 2), "bad", ["ddid"], 0.5).select("t", "ant", "chi2", "n", "bad")


# ---------------------------------------------------------------- statistics


@query(f"with {VE}, d as (select scan, chan, x - lag(x) over (partition by row order by chan) as d from ve) select scan, sqrt(sum(d * d / 4) / count(*)) as noise, count(*) as n from d where d is not null group by 1", "noise")
def noise_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.channel_noise(spectra(spark, sf_dir), "row", "chan", "x", ["scan"])


@query(f"with {VL}, {RB}, {BOTH} select t, ant1 as ant, sum((re - mre) * (re - mre) + im * im) as chi2, count(*) as n from b group by 1, 2", "chi2")
def chi2_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi_squared(rebin.hermitian(cells(spark, sf_dir)))


@query(f"with {VL}, x as (select chan, ant1 as ant, floor(tslot / {SLOT_DAYS})::bigint as t, re * re + im * im as p from vl where fl = 0) select chan, ant, t, count(*) as n, sum(p) as power from x group by grouping sets ((chan, ant), (t, ant), (t, chan))", "power", 3)
def stat_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rebin.slots(visibilities(spark, sf_dir).where("fl = 0"), SLOT_DAYS).withColumn("ant", F.col("ant1"))
    return stats.marginals(v, [["chan", "ant"], ["t", "ant"], ["t", "chan"]], F.count(F.lit(1)).alias("n"), F.sum(cx("re", "im").abs2()).alias("power"))


@query(f"with {VL}, p as (select scan, floor(tslot / {SLOT_DAYS}) as t, sum(re) as s, count(*) as n from vl where fl = 0 group by 1, 2) select scan, sum(s) / sum(n) as mean, sum(n)::bigint as n from p group by 1", "mean")
def stat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = rebin.slots(visibilities(spark, sf_dir).where("fl = 0"), SLOT_DAYS).groupBy("scan", "t").agg(F.sum("re").alias("s"), F.count(F.lit(1)).alias("n"))
    return part.groupBy("scan").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


RES = "r as (select tslot, chan, ant1, ant2, fl, sqrt((re - mre) * (re - mre) + im * im) as absres from vl)"


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).withColumn("absres", (cx("re", "im") - cx("mre", "mim")).abs())


@query(f"with {VL}, {RES} select ant1, ant2, median(absres) as mad from r where fl = 0 and absres <> 0 group by 1, 2", "mad")
def mad_bl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad_by_baseline(_residuals(spark, sf_dir))


@query(f"with {VL}, {RB}, {VC}, r as (select ant1, ant2, corr, sqrt((re - mre) * (re - mre) + im * im) as a from vc where fl = 0) select ant1, ant2, corr, median(a) as mad from r where a <> 0 group by all", "mad")
def mad_bl_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = correlations(cells(spark, sf_dir))
    return stats.mad_by_baseline(c.withColumn("absres", (cx("re", "im") - cx("mre", "mim")).abs()), ["corr"])


@query(f"with {VL}, {RES}, m as (select ant1, ant2, median(absres) as mad from r where fl = 0 and absres <> 0 group by 1, 2) select median(mad) as mmad, count(*) as baselines from m", "mmad")
def mad_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad_by_baseline(_residuals(spark, sf_dir)).agg(stats.median_of(F.col("mad")).alias("mmad"), F.count(F.lit(1)).alias("baselines"))


@query(f"""with {VL}, {RES}, m as (select ant1, ant2, median(absres) as mad from r where fl = 0 and absres <> 0 group by 1, 2) select r.ant1, r.ant2, count(*) as n, count(*) filter (r.fl = 0 and (absres > 3 / 1.4826 * mad or absres > 4 / 1.4826 * (select median(mad) from m))) as flagged
 from r left join m on m.ant1 = r.ant1 and m.ant2 = r.ant2 group by 1, 2""")  # fmt: skip
def mad_flagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad_flags(_residuals(spark, sf_dir), 3.0, 4.0, FL["MAD"]).groupBy("ant1", "ant2").agg(F.count(F.lit(1)).alias("n"), F.count_if(flags.has(FL["MAD"])).alias("flagged"))


@query(f"with {VL}, {RES}, m as (select ant1, ant2, median(absres) as mad from r where fl = 0 and absres <> 0 group by 1, 2), a as (select ant1 as ant, mad from m union all select ant2, mad from m), k as (select ant, median(mad) as mad from a group by 1), c as (select median(mad) as mid from k) select ant, mad, mad > mid + 2 * 1.4826 * (select median(abs(mad - mid)) from k, c) as bad from k, c", "mad")
def mad_antenna(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.mad_by_baseline(_residuals(spark, sf_dir))
    k = m.select(F.explode(F.array("ant1", "ant2")).alias("ant"), "mad").groupBy("ant").agg(stats.median_of(F.col("mad")).alias("mad"))
    mid = k.agg(stats.median_of(F.col("mad")).alias("mid"))
    dev = k.join(F.broadcast(mid)).agg(stats.median_of(F.abs(F.col("mad") - F.col("mid"))).alias("dev"))
    return k.join(F.broadcast(mid)).join(F.broadcast(dev)).select("ant", "mad", (F.col("mad") > F.col("mid") + 2 * 1.4826 * F.col("dev")).alias("bad"))


@query(f"with {VL}, {RES}, m as (select ant1, ant2, median(absres) as mad from r where fl = 0 and absres <> 0 group by 1, 2), k as (select *, row_number() over (order by mad desc, ant1, ant2) as place, count(*) over () as n from m) select ant1, ant2, mad, place from k where place <= 3 or place = (n + 1) // 2", "mad")
def topk_worst_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three worst baselines and the median one."""
    k = stats.mad_by_baseline(_residuals(spark, sf_dir)).withColumns({"place": F.row_number().over(Window.orderBy(F.desc("mad"), "ant1", "ant2")).cast("bigint"), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    return k.where("place <= 3 or place = (n + 1) div 2").select("ant1", "ant2", "mad", "place")


# ---------------------------------------------------------------- gains


@query(f"with {VL}, {RB}, {G} select t, chan, ant1, ant2, (re * gr + im * gi) / (gr * gr + gi * gi) as c_re, (im * gr - re * gi) / (gr * gr + gi * gi) as c_im from (select rb.*, p.g_re * q.g_re + p.g_im * q.g_im as gr, p.g_im * q.g_re - p.g_re * q.g_im as gi from rb join g p on p.ant = ant1 join g q on q.ant = ant2)", "c_re c_im")
def mode_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.corrected(_joined(spark, sf_dir)).select("t", "chan", "ant1", "ant2", "c_re", "c_im")


@query(f"with {VL}, {RB}, {G} select t, chan, ant1, ant2, mre * gr as k_re, mre * gi as k_im, re - mre * gr as r_re, im - mre * gi as r_im from (select rb.*, p.g_re * q.g_re + p.g_im * q.g_im as gr, p.g_im * q.g_re - p.g_re * q.g_im as gi from rb join g p on p.ant = ant1 join g q on q.ant = ant2)", "k_re k_im r_re r_im")
def mode_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.corrupted(_joined(spark, sf_dir)).select("t", "chan", "ant1", "ant2", "k_re", "k_im", "r_re", "r_im")


@query(f"with {VL}, {RB}, {G}, x as (select rb.*, p.g_re * q.g_re + p.g_im * q.g_im as gr, p.g_im * q.g_re - p.g_re * q.g_im as gi from rb join g p on p.ant = ant1 join g q on q.ant = ant2), y as (select *, re - mre * gr as rr, im - mre * gi as ri from x) select t, chan, ant1, ant2, (rr * gr + ri * gi) / (gr * gr + gi * gi) as c_re, (ri * gr - rr * gi) / (gr * gr + gi * gi) as c_im from y", "c_re c_im")
def mode_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = gains.corrupted(_joined(spark, sf_dir)).withColumns({"re": F.col("r_re"), "im": F.col("r_im")})
    return gains.corrected(left).select("t", "chan", "ant1", "ant2", "c_re", "c_im")


@query(f"with {VL}, {RB}, {G} select ant1, ant2, avg(sqrt((re * re + im * im) / ((p.g_re * p.g_re + p.g_im * p.g_im) * (q.g_re * q.g_re + q.g_im * q.g_im)))) as amp, count(*) as n from rb join g p on p.ant = ant1 join g q on q.ant = ant2 group by 1, 2", "amp")
def apply_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.corrected(_joined(spark, sf_dir)).groupBy("ant1", "ant2").agg(F.avg(cx("c_re", "c_im").abs()).alias("amp"), F.count(F.lit(1)).alias("n"))


_M = "select tslot, chan, ant1, ant2, w, re as a, im as b, mre as c, (re - mre) as d, w / 10 as e from vl"


@query(f"with {VL}, m as ({_M}), x as (select *, a * e - b * b - c * d as dr, b * e + a * b - 0 as di from m) select tslot, chan, ant1, ant2, w, (dr * dr + di * di <= 1e-6) as singular, case when dr * dr + di * di <= 1e-6 then 0 else (e * dr + b * di) / (dr * dr + di * di) end as i_re, case when dr * dr + di * di <= 1e-6 then 0 else (b * dr - e * di) / (dr * dr + di * di) end as i_im from x", "i_re i_im")
def mat2_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    v = visibilities(spark, sf_dir)
    m = ((cx("re", "im"), Cx(F.col("mre"), zero)), (Cx(F.col("re") - F.col("mre"), zero), Cx(F.col("w") / 10, F.col("im"))))
    inverse, bad = mat_inverse(m, 1e-3)
    return v.select("tslot", "chan", "ant1", "ant2", "w", bad.alias("singular"), inverse[0][0].re.alias("i_re"), inverse[0][0].im.alias("i_im"))


_TURNED = ", ".join(
    f"{' + '.join(f'({p} * {q}) * {v}{c}' for p, v, q in terms)} as v{k}_{'re' if c == 'r' else 'im'}"
    for k, terms in enumerate([[(p, v, q) for p, row in zip(ps, ("ab", "cd")) for v, q in zip(row, qs)] for ps in (("cos(pa)", "-sin(pa)"), ("sin(pa)", "cos(pa)")) for qs in (("cos(qa)", "-sin(qa)"), ("sin(qa)", "cos(qa)"))])
    for c in "ri"
)


@query(f"""with {VL}, {RB}, {VC}, w as (select t, chan, ant1, ant2, {", ".join(f"max(re) filter (corr = {k}) as {c}r, max(im) filter (corr = {k}) as {c}i" for k, c in enumerate("abcd"))}, 0.1::double * ant1 + 0.01::double * t as pa, 0.1::double * ant2 + 0.01::double * t as qa from vc group by all)
 select t, chan, ant1, ant2, {_TURNED} from w""", " ".join(f"v{k}_{c}" for k in range(4) for c in ("re", "im")))  # fmt: skip
def pa_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear feeds are turned by the angles of both ends, R_p V R_q^T, which are looked up by time and antenna."""
    c = correlations(cells(spark, sf_dir))
    at = lambda k, x: F.max(F.when(F.col("corr") == k, F.col(x)))
    v = c.groupBy("t", "chan", "ant1", "ant2").agg(*[at(k, x).alias(f"{x}{k}") for k in range(4) for x in ("re", "im")])
    table = c.select("t", F.explode(F.array("ant1", "ant2")).alias("ant")).distinct().withColumn("angle", 0.1 * F.col("ant") + 0.01 * F.col("t"))
    for k in (1, 2):
        v = v.join(table.select("t", F.col("ant").alias(f"ant{k}"), F.col("angle").alias(f"a{k}")), ["t", f"ant{k}"])
    real = lambda x: Cx(x, F.lit(0.0))
    turn = lambda a: ((real(F.cos(a)), real(-F.sin(a))), (real(F.sin(a)), real(F.cos(a))))
    cell = lambda k: cx(f"re{k}", f"im{k}")
    out = sandwich(turn(F.col("a1")), ((cell(0), cell(1)), (cell(2), cell(3))), turn(F.col("a2")))
    return v.select("t", "chan", "ant1", "ant2", *[x.alias(f"v{k}_{n}") for k in range(4) for n, x in (("re", out[k // 2][k % 2].re), ("im", out[k // 2][k % 2].im))])


@query(f"with {VL}, s as (select ant1, ant2, chan, sum(mre * re) as nr, sum(-mre * im) as ni, sum(re * re + im * im) as dd from vl where fl = 0 group by 1, 2, 3) select ant1, ant2, chan, case when dd = 0 then 1 else nr / dd end as g_re, case when dd = 0 then 0 else ni / dd end as g_im from s", "g_re g_im")
def ifr_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.baseline_gains(visibilities(spark, sf_dir).where("fl = 0"), ["ant1", "ant2", "chan"])


@query(f"with {VL}, s as (select ant1, ant2, chan, sum(mre * re) as nr, sum(-mre * im) as ni, sum(re * re + im * im) as dd from vl where fl = 0 group by 1, 2, 3), g as (select ant1, ant2, nr / dd as g_re, ni / dd as g_im from s where dd <> 0) select ant1, ant2, avg(sqrt(g_re * g_re + g_im * g_im)) as mean, stddev_pop(sqrt(g_re * g_re + g_im * g_im)) as spread, avg(g_re) as re, avg(g_im) as im from g group by 1, 2", "mean spread re im")
def ifr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gains.baseline_gains(visibilities(spark, sf_dir).where("fl = 0"), ["ant1", "ant2", "chan"]).where("not (g_re = 1 and g_im = 0)")
    size = cx("g_re", "g_im").abs()
    return g.groupBy("ant1", "ant2").agg(F.avg(size).alias("mean"), F.stddev_pop(size).alias("spread"), F.avg("g_re").alias("re"), F.avg("g_im").alias("im"))


@query(f"""with {VL}, {RB}, {VC}, x as (select floor(t / 4)::bigint as ti, corr, re, im, 0.1::double * abs(re) + 0.1 as mr, 0.05::double * im as mi from vc where corr in (1, 2) and fl = 0 and ant1 <> ant2),
 d as (select ti, corr, (re * mr + im * mi) / sqrt(mr * mr + mi * mi) as dr, (im * mr - re * mi) / sqrt(mr * mr + mi * mi) as di from x) select ti, atan2(sum(case corr when 1 then di else -di end), sum(dr)) as pzd from d group by 1""", "pzd")  # fmt: skip
def pzd_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase between the hands by interval, against a model of the cross hands."""
    c = correlations(cells(spark, sf_dir)).where("ant1 <> ant2 and fl = 0").withColumns({"mre": 0.1 * F.abs("re") + 0.1, "mim": 0.05 * F.col("im")})
    return gains.hand_phase(c.withColumn("ti", rebin.interval("t", 4)), ["ti"])


@query(f"""with {VL}, {RB}, {BOTH}, g0 as (select distinct ant1 as ant, 1.0::double as g from b), u1 as (select ant1 as ant, sum(re * g * mre) / sum(g * mre * g * mre) as g from b join g0 on g0.ant = ant2 group by 1),
 u2 as (select ant1 as ant, sum(re * g * mre) / sum(g * mre * g * mre) as g from b join u1 on u1.ant = ant2 group by 1) select u1.ant, (u1.g + u2.g) / 2 as g from u1 join u2 on u1.ant = u2.ant""", "g")  # fmt: skip
def solve_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.scalar_gains(rebin.hermitian(cells(spark, sf_dir)), 2)


# ---------------------------------------------------------------- solution store

SOL = f"sol as (select ant1 as ant, chan, floor(tslot / {SLOT_DAYS})::bigint as time, avg(re) as value from vl where fl = 0 and floor(tslot / {SLOT_DAYS})::bigint % 3 <> 1 group by 1, 2, 3)"


def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rebin.slots(visibilities(spark, sf_dir).where("fl = 0"), SLOT_DAYS).where("t % 3 <> 1")
    return v.groupBy(F.col("ant1").alias("ant"), "chan", F.col("t").alias("time")).agg(F.avg("re").alias("value"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS).select(F.col("ant1").alias("ant"), "chan", F.col("t").alias("time")).distinct()


GRID = f"grid as (select distinct ant1 as ant, chan, floor(tslot / {SLOT_DAYS})::bigint as time from vl)"


@query(f"with {VL}, {SOL}, {GRID} select grid.*, value, value is null as masked from grid left join sol using (ant, chan, time)", "value")
def join_db_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(_grid(spark, sf_dir), _solutions(spark, sf_dir), ["ant", "chan", "time"])


@query(f"with {VL}, {SOL}, {GRID} select * from grid where not exists (select 1 from sol where sol.ant = grid.ant and sol.chan = grid.chan and sol.time = grid.time)")
def join_db_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.mismatched(_grid(spark, sf_dir), _solutions(spark, sf_dir), ["ant", "chan", "time"])


@query(f"""with {VL}, {SOL}, {GRID}, n as (select ant, chan, time, value, row_number() over (partition by ant, chan order by time) as k, count(*) over (partition by ant, chan) as m from sol),
 a as (select g.ant, g.chan, g.time, greatest(1, least(m - 1, count(*) filter (n.time <= g.time))) as k, m from grid g join n on n.ant = g.ant and n.chan = g.chan group by g.ant, g.chan, g.time, m)
 select g.ant, g.chan, g.time, case when p.time = a.time or q.time is null then p.value when q.time = a.time then q.value else p.value + (q.value - p.value) * (a.time - p.time) / (q.time - p.time) end as value from grid g left join a on a.ant = g.ant and a.chan = g.chan and a.time = g.time left join n p on p.ant = a.ant and p.chan = a.chan and p.k = a.k left join n q on q.ant = a.ant and q.chan = a.chan and q.k = a.k + 1""", "value")  # fmt: skip
def join_db_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.interpolated(_grid(spark, sf_dir), _solutions(spark, sf_dir), ["ant", "chan"], "time")


@query(f"with {VL}, {SOL} select ant, list_sort(list(distinct chan)) as chans, count(distinct time) as times, min(value) as lo, max(value) as hi from sol group by 1", "lo hi")
def param_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _solutions(spark, sf_dir)
    return s.groupBy("ant").agg(F.sort_array(F.collect_set("chan")).alias("chans"), F.countDistinct("time").alias("times"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(f"with {VL} select ant1 as ant from vl where chan = 1 intersect select ant2 from vl where chan = 2")
def set_intersect_ants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir)
    return v.where("chan = 1").select(F.col("ant1").alias("ant")).intersect(v.where("chan = 2").select(F.col("ant2").alias("ant")))


@query(f"with {VL} select chan, count(*) as rows, sum(count(*)) over (order by chan rows between unbounded preceding and current row)::bigint - count(*) as first_row from vl group by 1")
def win_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = visibilities(spark, sf_dir).groupBy("chan").agg(F.count(F.lit(1)).alias("rows"))
    run = Window.orderBy("chan").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("first_row", F.sum("rows").over(run) - F.col("rows"))
