"""Flags, counts of equations, chi-squared and deviations on whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import Cx, cx
from ..functions.grammar import globbed
from ..operators import flags, gains, rebin, stats, store
from ..schema import FL, FLAG_BITS
from ..sources.tables import written
from ..sources.views import SLOT_DAYS, VC, VE, VL, spectra, visibilities
from .queries import BOTH, RB, SOL, _solutions, cells
from .registry import query
from .tiles import corrs

ROW = "tslot, chan, ant1, ant2, w"
ROWS = ["tslot", "chan", "ant1", "ant2", "w"]

# ---------------------------------------------------------------- flags


@query(f"with {VL} select {ROW}, seq, case when bool_or(fl & 1 = 1) over (partition by tslot, chan, ant1, ant2) or ant1 = 0 then fl | 1 else fl end as fl from vl")
def flag_apply_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any correlation's flag (here: of the rows of one sample), or the row's, which antenna 0 stands for."""
    v = visibilities(spark, sf_dir)
    some = v.groupBy("tslot", "chan", "ant1", "ant2").agg(F.bool_or(flags.has(1)).alias("some"))
    return v.join(some, ["tslot", "chan", "ant1", "ant2"]).select(*ROWS, "seq", flags.raised(F.col("some") | (F.col("ant1") == 0), FL["PRIOR"]).alias("fl"))


@query(f"with {VL} select {ROW}, case when fl <> 0 then 4 else 0 end::bigint as bits from vl")
def flag_fill_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).select(*ROWS, F.when(F.col("fl") != 0, 4).otherwise(0).cast("bigint").alias("bits"))


@query(f"with {VL} select {ROW}, case when w > 45 then fl | {FL['INVWGHT']} when w <= 2 then fl | {FL['NULLWGHT']} else fl end as fl from vl")
def flag_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of two models: invalid if any isn't finite, null if all are zero."""
    w = F.col("w")
    models = F.array(F.when(w > 45, float("inf")).when(w <= 2, 0.0).otherwise(w), F.when(w <= 3, 0.0).otherwise(w))
    return visibilities(spark, sf_dir).select(*ROWS, flags.model_weights(models).alias("fl"))


@query(f"with {VL} select {ROW}, case when re > 9 or (chan = 0 and scan = 1995) then fl | {FL['INVMODEL']} else fl end as fl from vl")
def flag_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of two directions: invalid if any isn't finite, or all are zero."""
    zero = (F.col("chan") == 0) & (F.col("scan") == 1995)
    models = F.array(F.when(zero, 0.0).when(F.col("re") > 9, float("nan")).otherwise(F.col("mre")), F.when(zero & (F.col("re") <= 9), 0.0).when(F.col("re") > 9, float("nan")).otherwise(1.0))
    return visibilities(spark, sf_dir).select(*ROWS, flags.models(models).alias("fl"))


@query("with n as (select distinct event_type as name from events), k as (select name, row_number() over (order by name) - 1 as bit from n) select name, bit, (1::bigint << bit) as mask, (select sum(1::bigint << bit)::bigint from k where name <> 'click') as rest from k")
def flagset_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names take the first free bits; rest: the mask of all but one name, as a policy of 'all but' needs it."""
    k = rebin.dense_index(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type").select(F.col("event_type").alias("name"), F.col("ordinal").cast("bigint").alias("bit"))
    k = k.withColumn("mask", F.expr("shiftleft(1L, cast(bit as int))"))
    return k.join(F.broadcast(k.where("name <> 'click'").agg(F.bit_or("mask").alias("rest"))))


@query(f"""with {VL}, s as (select tslot, chan, ant1 as ant, sum(re) as x, bool_and(fl <> 0) as gone from vl group by all), t as (select tslot, bool_and(gone) as gone_t from s group by 1), c as (select chan, bool_and(gone) as gone_c from s group by 1)
 select 'time-ant' as part, s.tslot, null::bigint as chan, s.ant, sum(case when gone_t then 0 else x end) as x from s join t using (tslot) group by all union all select 'chan-ant', null, s.chan, s.ant, sum(case when gone_c then 0 else x end) from s join c using (chan) group by all
 union all select 'time-chan', s.tslot, s.chan, null, sum(case when gone_t or gone_c then 0 else x end) from s join t using (tslot) join c using (chan) group by all""", "x")
def stats_apply_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by time and antenna, channel and antenna, and time and channel: those of times or channels that are flagged throughout become 0."""
    s = visibilities(spark, sf_dir).groupBy("tslot", "chan", F.col("ant1").alias("ant")).agg(F.sum("re").alias("x"), F.bool_and(F.col("fl") != 0).alias("gone"))
    s = written(s, "sums")
    for c, name in (("tslot", "gone_t"), ("chan", "gone_c")):
        s = s.join(s.groupBy(c).agg(F.bool_and("gone").alias(name)), c)
    s = written(s, "flagged")
    out = None
    for part, keys, gone in (("time-ant", ("tslot", "ant"), F.col("gone_t")), ("chan-ant", ("chan", "ant"), F.col("gone_c")), ("time-chan", ("tslot", "chan"), F.col("gone_t") | F.col("gone_c"))):
        rows = s.groupBy(*keys).agg(F.sum(F.when(gone, 0.0).otherwise(F.col("x"))).alias("x"))
        rows = rows.select(F.lit(part).alias("part"), *[(F.col(c) if c in keys else F.lit(None).cast("bigint")).alias(c) for c in ("tslot", "chan", "ant")], "x")
        out = rows if out is None else out.unionByName(rows)
    return out


_BITS = "(values " + ", ".join(f"('{n}', {b}::bigint)" for n, b in FLAG_BITS.items()) + ") as c(name, bit)"


@query(f"with {VL} select name, bit, scan, count(*) filter (fl >> bit & 1 = 1) as n from vl, {_BITS} group by all")
def flag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = visibilities(spark, sf_dir).groupBy("scan").agg(*[F.count_if(flags.has(1 << b)).alias(n) for n, b in FLAG_BITS.items()])
    cells_ = [F.struct(F.lit(n).alias("name"), F.lit(b).cast("bigint").alias("bit"), F.col(n).alias("n")) for n, b in FLAG_BITS.items()]
    return sums.select("scan", F.explode(F.array(*cells_)).alias("x")).select("x.name", "x.bit", "scan", "x.n")


# ---------------------------------------------------------------- counts, chi-squared

R2 = "(re - mre) * (re - mre) + im * im"


def _chi(rows: DataFrame, which: str) -> DataFrame:
    r = Cx(F.col("re") - F.col("mre"), F.col("im") - F.col("mim"))
    return rebin.hermitian(rows.where(which)).groupBy("t", "ant1").agg(F.sum(r.abs2()).alias("chi2"), F.count(F.lit(1)).alias("n"))


@query(f"with {VL}, {RB}, {VC}, x as (select * from vc where corr in (0, 3) and ant1 <> ant2) select t, a as ant1, sum({R2}) as chi2, count(*) as n from (select *, unnest([ant1, ant2]) as a from x) group by 1, 2", "chi2")
def chi2_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chi(corrs(spark, sf_dir), "corr in (0, 3)")


@query(f"with {VL}, {RB}, {VC}, x as (select * from vc where corr in (1, 2) and ant1 <> ant2) select t, a as ant1, sum({R2}) as chi2, count(*) as n from (select *, unnest([ant1, ant2]) as a from x) group by 1, 2", "chi2")
def chi2_offdiag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chi(corrs(spark, sf_dir), "corr in (1, 2)")


#: Noise by channel from differences of adjacent channels; the first channel has the second's.
NOISE = """d as (select t, ant1, ant2, chan, re - lag(re) over u as dr, im - lag(im) over u as di, chan - lag(chan) over u as gap from rb window u as (partition by t, ant1, ant2 order by chan)),
 nz as (select chan, sum((dr * dr + di * di) / 4) / count(*) as v from d where gap = 1 group by 1), iv as (select chan, 1 / v as inv from nz union all select 0, 1 / v from nz where chan = 1)"""


@query(f"with {VL}, {RB}, {NOISE} select t, sum(({R2}) * inv) as total, count(*) as n, sum(({R2}) * inv) / (2 * count(*)) as chi2 from rb join iv using (chan) group by 1", "total chi2", 3)
def chi2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared residuals over the noise of their channel, by slot and by its number of equations."""
    c = cells(spark, sf_dir)
    c = c.join(F.broadcast(stats.inverse_variance(c)), "chan").withColumn("x", Cx(F.col("re") - F.col("mre"), F.col("im") - F.col("mim")).abs2() * F.col("inv"))
    return c.groupBy("t").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n")).withColumn("chi2", F.col("total") / (2 * F.col("n")))


@query(f"""with {VL}, r0 as (select floor(tslot / {SLOT_DAYS})::bigint as t, chan, ant1, ant2, sum(w * re) filter (fl = 0) / sum(w) filter (fl = 0) as re, sum(w * im) filter (fl = 0) / sum(w) filter (fl = 0) as im, count(*) filter (fl = 0) = 0 as bad from vl group by 1, 2, 3, 4),
 d as (select t, ant1, ant2, chan, re - lag(re) over u as dr, im - lag(im) over u as di, chan - lag(chan) over u as gap, bad or lag(bad) over u as bad from r0 window u as (partition by t, ant1, ant2 order by chan)), x as (select t, chan, unnest([ant1, ant2]) as ant, (dr * dr + di * di) / 4 as p from d where gap = 1 and not bad and ant1 <> ant2)
 select chan, ant, t, sqrt(sum(p) / count(*)) as noise, count(*) as n from x group by grouping sets ((chan, ant), (t, ant), (t, chan))""", "noise")  # fmt: skip
def noise_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise by channel and antenna, slot and antenna, slot and channel, from differences of adjacent channels of which neither is flagged."""
    c = rebin.rebin_vis(rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS))
    d = stats.channel_differences(c.where("ant1 <> ant2")).select("t", "chan", F.explode(F.array("ant1", "ant2")).alias("ant"), "p")
    return stats.marginals(d, [["chan", "ant"], ["t", "ant"], ["t", "chan"]], F.sqrt(F.sum("p") / F.count(F.lit(1))).alias("noise"), F.count(F.lit(1)).alias("n"))


@query(f"with {VL}, {RB}, {BOTH} select floor(t / 4)::bigint as ti, ant1 as ant, 4 * count(*) as eqs, 4 * count(*) >= 8 as enough, case when 4 * count(*) > 8 then 4 * count(*) / (4 * count(*) - 8) else null end as reduced from b group by 1, 2", "reduced")
def eq_counts_interval(spark: SparkSession, sf_dir: str, dof: int = 8) -> DataFrame:
    n = rebin.hermitian(cells(spark, sf_dir)).groupBy(rebin.interval("t", 4).alias("ti"), F.col("ant1").alias("ant")).agg((4 * F.count(F.lit(1))).alias("eqs"))
    return n.withColumns({"enough": F.col("eqs") >= dof, "reduced": F.when(F.col("eqs") > dof, F.col("eqs") / (F.col("eqs") - dof))})


@query(f"with {VL}, {RB}, {BOTH} select t, ant1 as ant, count(*) as records, 2 * count(*) as eqs, 1 / (2.0::double * count(*)) as norm from b group by 1, 2", "norm")
def eq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rebin.hermitian(cells(spark, sf_dir)).groupBy("t", F.col("ant1").alias("ant")).agg(F.count(F.lit(1)).alias("records"))
    return n.withColumns({"eqs": 2 * F.col("records"), "norm": 1 / (2.0 * F.col("records"))})


_STEPS = ", ".join(f"max(x) filter (chan = {k}) as c{k}" for k in range(7))


@query(f"with {VL}, s as (select scan, chan, avg(re) as x from vl group by all) select scan, {_STEPS} from s group by 1", " ".join(f"c{k}" for k in range(7)))
def stat_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = visibilities(spark, sf_dir).groupBy("scan").pivot("chan", list(range(7))).agg(F.avg("re"))
    return wide.select("scan", *[F.col(str(k)).alias(f"c{k}") for k in range(7)])


@query(f"with {VL} select 're' as field, max(abs(re)) > 0 as used from vl union all select 'im', max(abs(im)) > 0 from vl union all select 'mim', max(abs(mim)) > 0 from vl")
def stat_nontrivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = visibilities(spark, sf_dir).agg(*[(F.max(F.abs(c)) > 0).alias(c) for c in ("re", "im", "mim")])
    return wide.unpivot([], ["re", "im", "mim"], "field", "used")


@query(f"with {VL} select scan, chan, printf('%.3f', avg(w) + 0.0000001) || case when avg(w) > 25.5 then '*' else '' end as cell from vl group by all")
def stat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = visibilities(spark, sf_dir).groupBy("scan", "chan").agg(F.avg("w").alias("x"))
    return s.select("scan", "chan", F.concat(F.format_string("%.3f", F.col("x") + 0.0000001), F.when(F.col("x") > 25.5, "*").otherwise("")).alias("cell"))


# ---------------------------------------------------------------- deviations

ABS = f"r as (select *, sqrt({R2}) as x from vl)"
MAD = "m as (select ant1, ant2, median(x) as mad from r where fl = 0 and x <> 0 group by all)"


def _absres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibilities(spark, sf_dir).withColumn("absres", Cx(F.col("re") - F.col("mre"), F.col("im") - F.col("mim")).abs())


@query(f"""with {VL}, {RB}, {VC}, r as (select *, sqrt({R2}) as x from vc), m as (select ant1, ant2, corr, median(x) as mad from r where fl = 0 and x <> 0 group by all)
 select t, chan, ant1, ant2, bool_or(corr in (0, 3) and x > 3 / 1.4826 * mad and fl = 0) as bad, count(*) as corrs from r left join m using (ant1, ant2, corr) group by 1, 2, 3, 4""")  # fmt: skip
def mad_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample goes if it is valid and any of the chosen correlations is above its threshold."""
    c = corrs(spark, sf_dir).withColumn("absres", Cx(F.col("re") - F.col("mre"), F.col("im") - F.col("mim")).abs())
    c = c.join(F.broadcast(stats.mad_by_baseline(c, ["corr"])), ["ant1", "ant2", "corr"], "left")
    over = F.col("corr").isin(0, 3) & (F.col("absres") > 3 / 1.4826 * F.col("mad")) & (F.col("fl") == 0)
    return c.groupBy("t", "chan", "ant1", "ant2").agg(F.bool_or(F.coalesce(over, F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("corrs"))


@query(f"with {VL}, {ABS}, {MAD}, l as (select *, sqrt(power(3.0::double * (ant1 * ant1 - ant2 * ant2), 2) + power(7.0::double * (ant1 - ant2), 2)) as length from m where ant1 <> ant2) select a.ant1, a.ant2, median(b.mad) as local from l a join l b on b.length > 0.8 * a.length and b.length < 1.2 * a.length and not (a.ant1 = b.ant1 and a.ant2 = b.ant2) group by 1, 2", "local")
def mad_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over the other baselines whose length is within a fifth."""
    square = lambda x: x * x
    length = F.sqrt(square(3.0 * (F.col("ant1") * F.col("ant1") - F.col("ant2") * F.col("ant2"))) + square(7.0 * (F.col("ant1") - F.col("ant2"))))
    return stats.local_medians(stats.mad_by_baseline(_absres(spark, sf_dir)).where("ant1 <> ant2").withColumn("length", length))


@query(f"with {VL}, {ABS}, {MAD} select ant1, ant2, count(*) filter (fl = 0 and x > 2 / 1.4826 * mad) as new, count(*) filter (fl <> 0) as old, count(*) as total from r left join m using (ant1, ant2) group by all")
def mad_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.mad_flags(_absres(spark, sf_dir), 2, 1e9, FL["MAD"])
    new = flags.has(FL["MAD"])
    return f.groupBy("ant1", "ant2").agg(F.count_if(new).alias("new"), F.count_if((F.col("fl") != 0) & ~new).alias("old"), F.count(F.lit(1)).alias("total"))


@query(f"with {VL}, {RB}, {BOTH}, s as (select floor(t / 4)::bigint as ti, ant1 as ant, sqrt(sum(0.01 / w) / (sum(mre * mre) / count(*) * count(*))) as pge from b group by 1, 2) select ti, ant, pge, pge > 0.005 as low from s", "pge")
def gain_snr_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rebin.hermitian(cells(spark, sf_dir)).groupBy(rebin.interval("t", 4).alias("ti"), F.col("ant1").alias("ant"))
    return b.agg(F.sqrt(F.sum(0.01 / F.col("w")) / F.sum(cx("mre", "mim").abs2())).alias("pge")).withColumn("low", F.col("pge") > 0.005)


@query(f"with {VL} select scan, ant1, grouping(scan)::bigint as all_scans, avg(case when fl <> 0 then 100.0 else 0.0 end) as percent, bool_and(fl <> 0) as dead from vl group by grouping sets ((scan), (ant1), (scan, ant1))", "percent")
def gain_flag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visibilities(spark, sf_dir)
    bad = F.col("fl") != 0
    return stats.marginals(v, [["scan"], ["ant1"], ["scan", "ant1"]], F.grouping("scan").cast("bigint").alias("all_scans"), F.avg(F.when(bad, 100.0).otherwise(0.0)).alias("percent"), F.bool_and(bad).alias("dead"))


@query(f"with {VL} select ant1, ant2, chan, sum(re * re + im * im) as dd, sum(mre * re) as md_re, sum(-mre * im) as md_im from vl where fl = 0 group by all", "dd md_re md_im", 4)
def ifr_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = cx("mre", "mim") * cx("re", "im").conj()
    return visibilities(spark, sf_dir).where("fl = 0").groupBy("ant1", "ant2", "chan").agg(F.sum(cx("re", "im").abs2()).alias("dd"), F.sum(md.re).alias("md_re"), F.sum(md.im).alias("md_im"))


# ---------------------------------------------------------------- parameters


@query(f"with {VL}, {SOL} select ant, chan, time, value, case when max(value) over w = min(value) over w then 0 else (value - min(value) over w) / (max(value) over w - min(value) over w) end as n from sol window w as (partition by ant, chan)", "value n")
def param_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.norm01(_solutions(spark, sf_dir), "value", ["ant", "chan"])


@query(f"with {VL}, {SOL} select k.ant, k.chan, g.time, sol.value, sol.value is null as masked from (select distinct ant, chan from sol) k cross join (select distinct time from sol) g left join sol on sol.ant = k.ant and sol.chan = k.chan and sol.time = g.time", "value")
def get_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cube(_solutions(spark, sf_dir), ["ant", "chan"], "time")


@query(f"with {VL}, {RB}, x as (select t, chan, re, im, sqrt(re * re + im * im) as amp, atan2(im, re) as ph from rb) select chan, min(t) as t_lo, max(t) as t_hi, min(amp) as a_lo, max(amp) as a_hi, min(ph) as p_lo, max(ph) as p_hi, least(min(re), min(im)) as x_lo, greatest(max(re), max(im)) as x_hi from x group by rollup (chan)", "a_lo a_hi p_lo p_hi x_lo x_hi")
def sols_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of times, amplitudes, phases and parts, by channel and over all."""
    g = cx("re", "im")
    x = cells(spark, sf_dir).select("t", "chan", "re", "im", g.abs().alias("amp"), g.arg().alias("ph"))
    ends = [f(c).alias(f"{n}_{e}") for c, n in (("t", "t"), ("amp", "a"), ("ph", "p")) for f, e in ((F.min, "lo"), (F.max, "hi"))]
    return x.rollup("chan").agg(*ends, F.least(F.min("re"), F.min("im")).alias("x_lo"), F.greatest(F.max("re"), F.max("im")).alias("x_hi"))


@query("select s_suppkey as ant, s_name as name from supplier where s_name glob '*[0-4]?' and s_name glob 'Supp*'")
def glob_ants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antennas by patterns of file names."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ant"), F.col("s_name").alias("name"))
    return s.where(globbed(F.col("name"), "*[0-4]?") & globbed(F.col("name"), "Supp*"))


@query(f"with {VL}, s as (select ant1, ant2, chan, re, im, mre from vl where fl = 0 and ant1 <> ant2), g as (select ant1, ant2, sum(mre * re) / sum(re * re + im * im) as gr, -sum(mre * im) / sum(re * re + im * im) as gi from s group by 1, 2) select ant1, ant2, corr, case when corr in (1, 2) then 1 else gr * 1.1 - gi * 0.2 end as g_re, case when corr in (1, 2) then 0 else gr * 0.2 + gi * 1.1 end as g_im from g, (values (0::bigint), (1::bigint), (2::bigint), (3::bigint)) c(corr)", "g_re g_im")
def ifr_gain_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of baselines over all frequencies, times those of an earlier run; off-diagonal ones are 1."""
    g = gains.baseline_gains(visibilities(spark, sf_dir).where("fl = 0 and ant1 <> ant2"), ["ant1", "ant2"])
    out = cx("g_re", "g_im") * Cx(F.lit(1.1), F.lit(0.2))
    c = g.select("ant1", "ant2", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(4)])).alias("corr"), out.re.alias("re"), out.im.alias("im"))
    off = F.col("corr").isin(1, 2)
    return c.select("ant1", "ant2", "corr", F.when(off, 1.0).otherwise(F.col("re")).alias("g_re"), F.when(off, 0.0).otherwise(F.col("im")).alias("g_im"))


@query(f"with {VL}, {RB}, {VC}, b as (select t, ant1 as ant, corr % 2 as dir, bool_or(abs(im) > 0.5) as bad from vc group by all), p as (select t, ant, bool_or(bad) as any_bad, bool_and(bad) as all_bad, bool_or(bad) filter (dir = 1) as own from b group by 1, 2) select t, ant, false as never, any_bad as always, all_bad as in_all, coalesce(own, false) as of_one from p")
def flag_gain_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an antenna's flagged gains reach the data, by policy over directions: never, for any of them, for all of them, or for the chosen one."""
    g = corrs(spark, sf_dir).groupBy("t", F.col("ant1").alias("ant"), (F.col("corr") % 2).alias("dir")).agg(F.bool_or(F.abs("im") > 0.5).alias("gflag"))
    return flags.gain_policies(g, 1)


@query(f"with {VL}, {RB}, {VC} select t, chan, ant1, avg(re) filter (corr = 0) as g00, avg(re) filter (corr = 1) as g01, avg(re) filter (corr = 2) as g10, avg(re) filter (corr = 3) as g11 from vc where ant1 in (1, 2) and t >= 5 and t < 20 group by all", "g00 g01 g10 g11")
def sols_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corrs(spark, sf_dir).where(F.col("ant1").cast("string").rlike("^[12]$") & F.col("t").between(5, 19))
    wide = c.groupBy("t", "chan", "ant1").pivot("corr", [0, 1, 2, 3]).agg(F.avg("re"))
    return wide.select("t", "chan", "ant1", *[F.col(str(k)).alias(f"g{k // 2}{k % 2}") for k in range(4)])


@query(f"with {VL}, {SOL} select time, ant, list(round(value + 3e-10::double, 6) order by chan) as vals, list(chan order by chan) as chans, avg(value) * 1e3 as delay from sol group by all", "delay")
def caltable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _solutions(spark, sf_dir).groupBy("time", "ant").agg(F.sort_array(F.collect_list(F.struct("chan", F.round(F.col("value") + 3e-10, 6).alias("value")))).alias("x"), (F.avg("value") * 1e3).alias("delay"))
    return s.select("time", "ant", F.col("x.value").alias("vals"), F.col("x.chan").alias("chans"), "delay")


@query(f"with {VE}, d as (select row, chan, x - lag(x) over (partition by row order by chan) as d from ve) select row, chan, d from d where d is not null", "d")
def win_lag_chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    d = F.col("x") - F.lag("x").over(Window.partitionBy("row").orderBy("chan"))
    return spectra(spark, sf_dir).select("row", "chan", d.alias("d")).where("d is not null")


@query(f"with {VL} select scan, floor(tslot / {SLOT_DAYS})::bigint as t, chan, avg(case when fl <> 0 then 1.0 else 0.0 end) as density from vl group by grouping sets ((scan), (t), (chan))", "density")
def win_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rebin.slots(visibilities(spark, sf_dir), SLOT_DAYS)
    return stats.marginals(v, [["scan"], ["t"], ["chan"]], F.avg(F.when(F.col("fl") != 0, 1.0).otherwise(0.0)).alias("density")).select("scan", "t", "chan", "density")


