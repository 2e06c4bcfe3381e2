"""Gains fitted by iterations of joins and sums, what they come to, and their use on data; the same iterations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import cx
from ..operators import gains, gauss_newton, rebin, stats
from ..schema import FL
from ..sources.tables import fresh_path, written
from ..sources.views import SLOT_DAYS, VC, VL, visibilities_of
from ..streaming import windows
from .queries import BOTH, RB, cells
from .registry import query
from .tiles import KEY, SAMPLE, corrs

T_INT, F_INT, ROUNDS = 8, 4, 4
I = "ti, fi"  # noqa: E741

#: Sums over a baseline's samples in an interval.
SUMS = f"""{VL}, {RB}, {BOTH}, s as materialized (select floor(t / {T_INT})::bigint as ti, floor(chan / {F_INT})::bigint as fi, ant1, ant2, sum(w * (re * mre + im * mim)) as zr, sum(w * (im * mre - re * mim)) as zi,
 sum(w * (mre * mre + mim * mim)) as v, sum(w * (re * re + im * im)) as dd, count(*) as n from b group by all), g0 as (select distinct {I}, ant1 as ant, 1.0::double as gr, 0.0::double as gi, 0.0::double as jhj from s)"""


def _rounds(n: int) -> str:
    out = SUMS
    for k in range(1, n + 1):
        half = "(r.ur + g.gr) / 2 as gr, (r.ui + g.gi) / 2 as gi" if k % 2 == 0 else "r.ur as gr, r.ui as gi"
        out += f""", r{k} as (select s.ti, s.fi, ant1 as ant, sum(zr * gr - zi * gi) / sum(v * (gr * gr + gi * gi)) as ur, sum(zr * gi + zi * gr) / sum(v * (gr * gr + gi * gi)) as ui, sum(v * (gr * gr + gi * gi)) as jhj
 from s join g{k - 1} g on g.ti = s.ti and g.fi = s.fi and g.ant = s.ant2 group by all), g{k} as materialized (select r.ti, r.fi, r.ant, {half}, r.jhj from r{k} r join g{k - 1} g using (ti, fi, ant))"""
    return out


DIAG = _rounds(ROUNDS)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.intervals(rebin.hermitian(cells(spark, sf_dir)), T_INT, F_INT)


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(gauss_newton.normal_sums(_samples(spark, sf_dir)), "sums")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.diagonal(_sums(spark, sf_dir), ROUNDS)


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.last(_history(spark, sf_dir), ROUNDS)


# ---------------------------------------------------------------- fits


@query(f"with {DIAG} select {I}, ant, gr as g_re, gi as g_im, jhj from g{ROUNDS}", "g_re g_im jhj", 4)
def solve_complex_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gains(spark, sf_dir)


def _phase_rounds(n: int) -> str:
    out = SUMS.replace("g0 as (select", "unused as (select") + f", p0 as (select distinct {I}, ant1 as ant, 0.0::double as p from s)"
    for k in range(1, n + 1):
        half = 0.5 if k % 2 == 0 else 1.0
        out += f""", m{k} as (select s.ti, s.fi, s.ant1 as ant, sum(zr * sin(q.p - o.p) + zi * cos(q.p - o.p)) / sum(v) as move from s join p{k - 1} q on q.ti = s.ti and q.fi = s.fi and q.ant = s.ant2
 join p{k - 1} o on o.ti = s.ti and o.fi = s.fi and o.ant = s.ant1 group by all), p{k} as materialized (select ti, fi, ant, p + {half}::double * move as p from m{k} join p{k - 1} using (ti, fi, ant))"""
    return out


@query(f"with {_phase_rounds(ROUNDS)} select {I}, ant, p as phase from p{ROUNDS}", "phase")
def solve_phase_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.last(gauss_newton.phases(_sums(spark, sf_dir), ROUNDS), ROUNDS)


#: Elements of data and model as rows, both ends: (q, p) is the conjugate transpose.
ELEMENTS = f"""{VL}, {RB}, {VC}, x as (select floor(t / {T_INT})::bigint as ti, floor(chan / {F_INT})::bigint as fi, t, chan, ant1, ant2, corr // 2 as i, corr % 2 as j, re, im, mre + case when corr in (1, 2) then 0.05::double * re else 0 end as mr, 0.0::double as mi, max(w) over (partition by t, chan, ant1, ant2) as w from vc where ant1 <> ant2),
 e as materialized (select ti, fi, t, chan, ant1, ant2, i, j, re, im, mr, mi, w from x union all select ti, fi, t, chan, ant2, ant1, j, i, re, -im, mr, -mi, w from x),
 dm as materialized (select d.ti, d.fi, d.ant1, d.ant2, d.i, d.j as k, m.i as j, m.j as l, sum(d.w * (d.re * m.mr + d.im * m.mi)) as re, sum(d.w * (d.im * m.mr - d.re * m.mi)) as im from e d join e m using (t, chan, ant1, ant2) group by all),
 mm as materialized (select d.ti, d.fi, d.ant1, d.ant2, d.i, d.j as l, m.i as j, m.j as s, sum(d.w * (d.mr * m.mr + d.mi * m.mi)) as re, sum(d.w * (d.mi * m.mr - d.mr * m.mi)) as im from e d join e m using (t, chan, ant1, ant2) group by all),
 g0 as (select distinct ti, fi, ant1 as ant, i, j, (i = j)::int::double as gr, 0.0::double as gi from e)"""


def full_round(k: int, dm: str = "dm", mm: str = "mm", kind: str = "full", mean: bool | None = None) -> str:
    """Round k of 2 x 2 gains, from g{k - 1} and the names of element sums; even rounds take means unless told."""
    half = [f"(u.u{c} + g.g{c}) / 2" if (k % 2 == 0 if mean is None else mean) else f"u.u{c}" for c in "ri"]
    if kind == "leakage":
        half = [f"case when g.i = g.j then {one} else {x} end" for one, x in zip((1, 0), half, strict=True)]
    new = f"g{k} as materialized (select g.ti, g.fi, g.ant, g.i, g.j, coalesce({half[0]}, g.gr) as gr, coalesce({half[1]}, g.gi) as gi from g{k - 1} g left join u{k} u using (ti, fi, ant, i, j))"
    at = lambda t, c, i, j: f"max({c}) filter (i = {i} and j = {j}) as {t}{i}{j}{c}"
    wide = lambda t: ", ".join(at(t, c, i, j) for i in (0, 1) for j in (0, 1) for c in ("re", "im"))
    out = f""", r{k} as (select a.ti, a.fi, ant1 as ant, a.i, a.j, sum(re * gr - im * gi) as re, sum(re * gi + im * gr) as im from {dm} a join g{k - 1} g on g.ti = a.ti and g.fi = a.fi and g.ant = a.ant2 and g.i = a.k and g.j = a.l group by all),
 h{k} as (select a.ti, a.fi, ant1 as ant, a.i, a.j, sum((a.re * p.gr + a.im * p.gi) * q.gr - (a.im * p.gr - a.re * p.gi) * q.gi) as re, sum((a.re * p.gr + a.im * p.gi) * q.gi + (a.im * p.gr - a.re * p.gi) * q.gr) as im from {mm} a
 join g{k - 1} p on p.ti = a.ti and p.fi = a.fi and p.ant = a.ant2 and p.j = a.l join g{k - 1} q on q.ti = a.ti and q.fi = a.fi and q.ant = a.ant2 and q.i = p.i and q.j = a.s group by all),
 w{k} as (select * from (select ti, fi, ant, {wide("r")} from r{k} group by all) join (select ti, fi, ant, {wide("h")} from h{k} group by all) using (ti, fi, ant))"""
    if kind == "diag":
        hand = ", ".join(f"({i}, {j}, {f'r{i}{i}re / h{i}{i}re, r{i}{i}im / h{i}{i}re' if i == j else '0.0::double, 0.0::double'})" for i in (0, 1) for j in (0, 1))
        return out + f", u{k} as (select ti, fi, ant, x.i, x.j, x.ur, x.ui from w{k}, lateral (values {hand}) x(i, j, ur, ui) where h00re > 0 and h11re > 0), {new}"
    return out + f""",
 t{k} as (select *, h00re * h11re - h00im * h11im - h01re * h10re + h01im * h10im as dr, h00re * h11im + h00im * h11re - h01re * h10im - h01im * h10re as di from w{k}),
 n{k} as (select ti, fi, ant, 0 as i, 0 as j, r00re * h11re - r00im * h11im - r01re * h10re + r01im * h10im as nr, r00re * h11im + r00im * h11re - r01re * h10im - r01im * h10re as ni, dr, di from t{k}
 union all select ti, fi, ant, 0, 1, -r00re * h01re + r00im * h01im + r01re * h00re - r01im * h00im, -r00re * h01im - r00im * h01re + r01re * h00im + r01im * h00re, dr, di from t{k}
 union all select ti, fi, ant, 1, 0, r10re * h11re - r10im * h11im - r11re * h10re + r11im * h10im, r10re * h11im + r10im * h11re - r11re * h10im - r11im * h10re, dr, di from t{k}
 union all select ti, fi, ant, 1, 1, -r10re * h01re + r10im * h01im + r11re * h00re - r11im * h00im, -r10re * h01im - r10im * h01re + r11re * h00im + r11im * h00re, dr, di from t{k}),
 u{k} as (select ti, fi, ant, i, j, (nr * dr + ni * di) / (dr * dr + di * di) as ur, (ni * dr - nr * di) / (dr * dr + di * di) as ui from n{k} where dr * dr + di * di > 0), {new}"""


def _full_rounds(n: int, kind: str = "full") -> str:
    return ELEMENTS + "".join(full_round(k, kind=kind) for k in range(1, n + 1))


def element_samples(spark: SparkSession, sf_dir: str, t_int: int = T_INT, f_int: int = F_INT) -> DataFrame:
    """Samples with all their correlations from both ends. The model of the off-diagonals gets a share of the data, as one of zero leaves JHJ diagonal."""
    c = gauss_newton.intervals(corrs(spark, sf_dir).where("ant1 <> ant2"), t_int, f_int)
    model = F.col("mre") + F.when(F.col("corr").isin(1, 2), 0.05 * F.col("re")).otherwise(0.0)
    at = lambda re, im, k: F.struct(F.max(F.when(F.col("corr") == k, re)).alias("re"), F.max(F.when(F.col("corr") == k, im)).alias("im"))
    cells_ = lambda re, im: F.array(*[at(re, im, k) for k in range(4)])
    s = c.groupBy("ti", "fi", *SAMPLE).agg(cells_(F.col("re"), F.col("im")).alias("d"), cells_(model, F.lit(0.0)).alias("m"), F.max("w").alias("w"))
    turned = lambda a: F.array(*[F.struct(F.col(a)[k]["re"].alias("re"), (-F.col(a)[k]["im"]).alias("im")) for k in (0, 2, 1, 3)])
    back = s.select("ti", "fi", "t", "chan", F.col("ant2").alias("ant1"), F.col("ant1").alias("ant2"), turned("d").alias("d"), turned("m").alias("m"), "w")
    return s.unionByName(back)


def elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return gauss_newton.element_sums(element_samples(spark, sf_dir))


@query(f"with {_full_rounds(2)} select ti, fi, ant, i::bigint as i, j::bigint as j, gr as g_re, gi as g_im from g2", "g_re g_im", 5)
def solve_complex_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gauss_newton.last(gauss_newton.full(*elements(spark, sf_dir), 2), 2, "n")
    return g.select("ti", "fi", "ant", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g_re", "g_im")


# ---------------------------------------------------------------- fitted gains on data

ON = f"from rb join g{ROUNDS} p on p.ti = floor(t / {T_INT}) and p.fi = floor(chan / {F_INT}) and p.ant = ant1 join g{ROUNDS} q on q.ti = floor(t / {T_INT}) and q.fi = floor(chan / {F_INT}) and q.ant = ant2 where ant1 <> ant2"
GAIN = f"x as (select rb.*, p.gr * q.gr + p.gi * q.gi as gr, p.gi * q.gr - p.gr * q.gi as gi {ON})"


def _with_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gains(spark, sf_dir).drop("jhj")
    c = gauss_newton.intervals(cells(spark, sf_dir).where("ant1 <> ant2"), T_INT, F_INT)
    return gains.with_gains(c, g, ["ti", "fi"])


@query(f"with {DIAG}, {GAIN} select {KEY}, (re * gr + im * gi) / (gr * gr + gi * gi) as c_re, (im * gr - re * gi) / (gr * gr + gi * gi) as c_im from x", "c_re c_im", 4)
def mode_sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.corrected(_with_fit(spark, sf_dir)).select(*SAMPLE, "c_re", "c_im")


@query(f"with {DIAG}, {GAIN} select {KEY}, re - mre * gr as r_re, im - mre * gi as r_im from x", "r_re r_im", 4)
def mode_ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gains.corrupted(_with_fit(spark, sf_dir)).select(*SAMPLE, "r_re", "r_im")


@query(f"with {DIAG}, {GAIN}, y as (select *, re - mre * gr as rr, im - mre * gi as ri from x) select {KEY}, (rr * gr + ri * gi) / (gr * gr + gi * gi) as c_re, (ri * gr - rr * gi) / (gr * gr + gi * gi) as c_im from y", "c_re c_im", 4)
def mode_sr(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = gains.corrupted(_with_fit(spark, sf_dir)).withColumns({"re": F.col("r_re"), "im": F.col("r_im")})
    return gains.corrected(left).select(*SAMPLE, "c_re", "c_im")


@query(f"""with {DIAG}, {GAIN}, r as (select ant1, ant2, sqrt((re - mre * gr) * (re - mre * gr) + (im - mre * gi) * (im - mre * gi)) as a from x), m as (select ant1, ant2, median(a) as mad from r where a <> 0 group by all), k as (select median(mad) as mmad from m)
 select ant1, ant2, count(*) as n, count(*) filter (a > 3 / 1.4826 * mad or a > 4 / 1.4826 * mmad) as flagged, round(100.0 * count(*) filter (a > 3 / 1.4826 * mad or a > 4 / 1.4826 * mmad) / count(*) + 0.0000003, 3) as percent from r join m using (ant1, ant2), k group by all""")  # fmt: skip
def finalize_resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations of the fit's residuals, flagged in two stages, and a summary of the flags."""
    r = gains.corrupted(_with_fit(spark, sf_dir)).withColumn("absres", cx("r_re", "r_im").abs())
    f = stats.mad_flags(written(r.select("ant1", "ant2", "fl", "absres"), "residuals"), 3.0, 4.0, FL["MAD"])
    bad = F.count_if(F.col("fl").bitwiseAND(F.lit(FL["MAD"])) != 0)
    return f.groupBy("ant1", "ant2").agg(F.count(F.lit(1)).alias("n"), bad.alias("flagged"), F.round(100.0 * bad / F.count(F.lit(1)) + 0.0000003, 3).alias("percent"))


@query(f"""with {VL}, {RB}, {"g as (select distinct ti, fi, gdir, ant, 1 + ant / 10.0::double + ti / 100.0::double as gr, ant / 20.0::double - fi / 50.0::double + gdir / 10.0::double as gi from (select floor(t / 8)::bigint as ti, floor(chan / 4)::bigint as fi, unnest([ant1, ant2]) as ant from rb), (values (0::bigint), (1::bigint)) d(gdir))"},
 v as (select rb.*, dir, mre / (1 + dir) as m from rb, (values (0::bigint), (1::bigint), (2::bigint)) d(dir)) select {KEY}, sum(m * (p.gr * q.gr + p.gi * q.gi)) as k_re, sum(m * (p.gi * q.gr - p.gr * q.gi)) as k_im
 from v join g p on p.ti = floor(t / 8) and p.fi = floor(chan / 4) and p.gdir = dir % 2 and p.ant = ant1 join g q on q.ti = floor(t / 8) and q.fi = floor(chan / 4) and q.gdir = dir % 2 and q.ant = ant2 group by {KEY}""", "k_re k_im")  # fmt: skip
def join_gain_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three model directions under gains of two, by intervals of time and frequency."""
    c = cells(spark, sf_dir)
    at = c.select(F.floor(F.col("t") / 8).alias("ti"), F.floor(F.col("chan") / 4).alias("fi"), F.explode(F.array("ant1", "ant2")).alias("ant")).distinct()
    g = at.select("*", F.explode(F.array(*[F.lit(d).cast("bigint") for d in (0, 1)])).alias("gdir"))
    g = g.withColumns({"g_re": 1 + F.col("ant") / 10 + F.col("ti") / 100, "g_im": F.col("ant") / 20 - F.col("fi") / 50 + F.col("gdir") / 10})
    v = c.select("*", F.explode(F.array(*[F.lit(d).cast("bigint") for d in (0, 1, 2)])).alias("dir")).withColumn("mre", F.col("mre") / (1 + F.col("dir")))
    return gains.corrupted_sum(gains.with_interval_gains(v, g, 8, 4, 2), SAMPLE)


# ---------------------------------------------------------------- what iterations came to


@query(f"with {DIAG} select a.ti, a.fi, sum((a.gr - b.gr) * (a.gr - b.gr) + (a.gi - b.gi) * (a.gi - b.gi)) / sum(a.gr * a.gr + a.gi * a.gi) as change, sum((a.gr - b.gr) * (a.gr - b.gr) + (a.gi - b.gi) * (a.gi - b.gi)) / sum(a.gr * a.gr + a.gi * a.gi) <= 0.0025::double as converged from g4 a join g3 b using (ti, fi, ant) group by a.ti, a.fi", "change")
def converge_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.convergence(_history(spark, sf_dir), 4, 0.05)


@query(f"with {DIAG}, c as (select sum((a.gr - b.gr) * (a.gr - b.gr) + (a.gi - b.gi) * (a.gi - b.gi)) / sum(a.gr * a.gr + a.gi * a.gi) <= 0.0025::double as ok from g4 a join g3 b using (ti, fi, ant) group by a.ti, a.fi) select avg(ok::int::double) as share, avg(ok::int::double) >= 0.99::double as reached from c", "share")
def converge_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.reached(gauss_newton.convergence(_history(spark, sf_dir), 4, 0.05), "converged", 0.99)


def _chi(k: int) -> str:
    return f"c{k} as (select s.ti, s.fi, sum(dd - 2 * (zr * (p.gr * q.gr + p.gi * q.gi) + zi * (p.gi * q.gr - p.gr * q.gi)) + (p.gr * p.gr + p.gi * p.gi) * (q.gr * q.gr + q.gi * q.gi) * v) as chi2 from s join g{k} p on p.ti = s.ti and p.fi = s.fi and p.ant = s.ant1 join g{k} q on q.ti = s.ti and q.fi = s.fi and q.ant = s.ant2 group by all)"


@query(f"with {DIAG}, {_chi(3)}, {_chi(4)} select ti, fi, c3.chi2 as before, c4.chi2 as chi2, c3.chi2 - c4.chi2 <= 0.01::double * c3.chi2 as stalled, c3.chi2 - c4.chi2 < -0.1::double * c3.chi2 as diverging from c4 join c3 using (ti, fi)", "before chi2", 2)
def stall_diverge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _sums(spark, sf_dir)
    power = _samples(spark, sf_dir).groupBy("ti", "fi", "ant1", "ant2").agg(F.sum(F.col("w") * cx("re", "im").abs2()).alias("dd"))
    history = gauss_newton.diagonal(sums, ROUNDS).where("k >= 3")
    return gauss_newton.progress(gauss_newton.chi_squares(sums, power, history), 4, 0.01)


ERR = f"pe as (select *, sqrt(1 / jhj) as error, sqrt(gr * gr + gi * gi) as size from g{ROUNDS})"
RULES = f"fs as (select *, case when isnan(gr) or isinf(gr) or isnan(gi) or isinf(gi) then {FL['BOOM']} when size = 0 then {FL['GNULL']} when size < 0.9 or size > 1.1 then {FL['GOOB']} when error > 0.004 then {FL['GVAR']} else 0 end::bigint as gflags from pe)"


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = _history(spark, sf_dir)
    return gauss_newton.flagged(gauss_newton.posterior_errors(gauss_newton.last(h, ROUNDS)), FL, 0.9, 1.1, 0.004), gauss_newton.last(h, ROUNDS - 1)


@query(f"with {DIAG}, {ERR} select {I}, ant, error from pe", "error")
def posterior_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.posterior_errors(_gains(spark, sf_dir)).select("ti", "fi", "ant", "error")


@query(f"with {DIAG}, {ERR}, {RULES} select f.ti, f.fi, f.ant, case when gflags <> 0 then o.gr else f.gr end as g_re, case when gflags <> 0 then o.gi else f.gi end as g_im, gflags from fs f join g{ROUNDS - 1} o using (ti, fi, ant)", "g_re g_im", 4)
def flag_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.restored(*_flagged(spark, sf_dir)).select("ti", "fi", "ant", "g_re", "g_im", "gflags")


@query(f"with {DIAG}, r as (select ti, fi, atan2(gi, gr) as a from g{ROUNDS} where ant = 2) select {I}, ant, gr * cos(coalesce(a, 0)) + gi * sin(coalesce(a, 0)) as g_re, gi * cos(coalesce(a, 0)) - gr * sin(coalesce(a, 0)) as g_im from g{ROUNDS} left join r using (ti, fi)", "g_re g_im", 4)
def ref_antenna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.referred(_gains(spark, sf_dir), 2).select("ti", "fi", "ant", "g_re", "g_im")


@query(f"with {DIAG}, {ERR} select {I}, ant, name, value, err as error from pe, lateral (values ('gain.re', gr, error), ('gain.im', gi, error), ('phase', atan2(gi, gr), error / size)) as x(name, value, err)", "value error", 4)
def exportables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauss_newton.exported(gauss_newton.posterior_errors(_gains(spark, sf_dir)))


#: Sums of single samples, without re-binning: parts of them may come from different batches.
RAW = f"""{VL}, b as (select floor(tslot / {SLOT_DAYS})::bigint as t, chan, ant1, ant2, re, im, mre, mim, w from vl where fl = 0 and ant1 <> ant2 union all select floor(tslot / {SLOT_DAYS})::bigint, chan, ant2, ant1, re, -im, mre, -mim, w from vl where fl = 0 and ant1 <> ant2)"""


@query(f"with {_rounds(2).replace(f'{VL}, {RB}, {BOTH}', RAW)} select {I}, ant, gr as g_re, gi as g_im from g2", "g_re g_im", 4)
def stream_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_gains(spark, f"{sf_dir}/lineitem.parque[t]", f"{sf_dir}/lineitem.parquet")


def streamed_gains(spark: SparkSession, source: str, like: str, files: int | None = None) -> DataFrame:
    """Gains of a stream of files (a folder, or a pattern; columns as in the table like), however they fall into micro-batches, of so many files each: a batch leaves its sums by baseline and interval
    under its number, the sums of all batches add up, and the iterations run on these."""
    options = {"maxFilesPerTrigger": str(files)} if files else {}
    stream = spark.readStream.schema(spark.read.parquet(like).schema).options(**options).parquet(source)

    def sums(batch: DataFrame) -> DataFrame:
        v = visibilities_of(batch).where("fl = 0").withColumn("t", F.floor(F.col("tslot") / SLOT_DAYS)).select("t", "chan", "ant1", "ant2", "re", "im", "mre", "mim", "w")
        return gauss_newton.normal_sums(gauss_newton.intervals(rebin.hermitian(v), T_INT, F_INT))

    out = fresh_path(spark, "stream")
    windows.solved(stream, sums, out, fresh_path(spark, "progress")).awaitTermination()
    parts = spark.read.parquet(out).groupBy("ti", "fi", "ant1", "ant2").agg(*[F.sum(c).alias(c) for c in ("z_re", "z_im", "v", "n")])
    return gauss_newton.last(gauss_newton.diagonal(written(parts, "sums"), 2), 2).select("ti", "fi", "ant", "g_re", "g_im")
