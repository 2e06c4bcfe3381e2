"""Fits of several directions, chains of terms, slopes, leakages, and a loop that stops by itself, on whole tables; the same rounds in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import Cx, cx
from ..operators import chains, gains, gauss_newton, rebin
from ..operators.chains import MatrixTerm, Term
from ..sources.tables import written
from ..sources.views import VL
from .queries import BOTH, RB, cells
from .registry import query
from .solvers import ELEMENTS, F_INT, SUMS, T_INT, _full_rounds, _samples, element_samples, elements, full_round
from .tiles import KEY, SAMPLE

BASE = f"{VL}, {RB}, {BOTH}"

# ---------------------------------------------------------------- several directions

DIRS, DD_ROUNDS = 3, 4
PHASE = "0.4::double * d * (ant1 - ant2) * (1 + chan)"


def models(n: int = DIRS) -> list[Cx]:
    """A direction's model turns by an angle that grows with its number, the baseline and the channel."""
    out = []
    for d in range(n):
        phase = 0.4 * d * (F.col("ant1") - F.col("ant2")) * (1 + F.col("chan"))
        out.append(Cx(F.col("mre") * F.cos(phase), F.col("mre") * F.sin(phase)))
    return out


def _dd_rounds(n: int) -> str:
    out = f"""{BASE}, bd as materialized (select floor(t / {T_INT})::bigint as ti, floor(chan / {F_INT})::bigint as fi, t, chan, ant1, ant2, re, im, w, d, mre * cos({PHASE}) as mr, mre * sin({PHASE}) as mi from b, (values {", ".join(f"({d}::bigint)" for d in range(DIRS))}) x(d)),
 sd as materialized (select ti, fi, ant1, ant2, d, sum(w * (re * mr + im * mi)) as zr, sum(w * (im * mr - re * mi)) as zi from bd group by all),
 vd as materialized (select a.ti, a.fi, a.ant1, a.ant2, a.d, e.d as e, sum(a.w * (e.mr * a.mr + e.mi * a.mi)) as vr, sum(a.w * (e.mi * a.mr - e.mr * a.mi)) as vi from bd a join bd e using (t, chan, ant1, ant2) group by all),
 g0 as (select distinct ti, fi, ant1 as ant, d, 1.0::double as gr, 0.0::double as gi from sd)"""
    for k in range(1, n + 1):
        g = f"g{k - 1}"
        out += f""", f{k} as (select v.ti, v.fi, v.ant1, v.ant2, v.d, sum((p.gr * q.gr + p.gi * q.gi) * vr - (p.gi * q.gr - p.gr * q.gi) * vi) as fr, sum((p.gr * q.gr + p.gi * q.gi) * vi + (p.gi * q.gr - p.gr * q.gi) * vr) as fm
 from vd v join {g} p on p.ti = v.ti and p.fi = v.fi and p.ant = v.ant1 and p.d = v.e join {g} q on q.ti = v.ti and q.fi = v.fi and q.ant = v.ant2 and q.d = v.e group by all),
 u{k} as (select s.ti, s.fi, s.ant1 as ant, s.d, sum((zr - fr) * gr - (zi - fm) * gi) as ur, sum((zr - fr) * gi + (zi - fm) * gr) as ui, sum(vr * (gr * gr + gi * gi)) as h
 from sd s join f{k} using (ti, fi, ant1, ant2, d) join (select * from vd where d = e) v using (ti, fi, ant1, ant2, d) join {g} q on q.ti = s.ti and q.fi = s.fi and q.ant = s.ant2 and q.d = s.d group by all),
 g{k} as materialized (select ti, fi, ant, d, gr + 0.5::double * ur / h as gr, gi + 0.5::double * ui / h as gi from u{k} join {g} using (ti, fi, ant, d))"""
    return out


def _dd(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = written(chains.direction_sums(_samples(spark, sf_dir), models()), "sums")
    return gauss_newton.last(chains.directions(sums, DIRS, DD_ROUNDS), DD_ROUNDS)


@query(f"with {_dd_rounds(DD_ROUNDS)} select ti, fi, ant, d as dir, gr as g_re, gi as g_im from g{DD_ROUNDS}", "g_re g_im", 4)
def solve_dd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of three directions, fitted together."""
    return _dd(spark, sf_dir)


@query(f"""with {_dd_rounds(DD_ROUNDS)}, x as (select t, chan, ant1, ant2, re, im, sum((p.gr * q.gr + p.gi * q.gi) * mr - (p.gi * q.gr - p.gr * q.gi) * mi) filter (bd.d > 0) as kr, sum((p.gr * q.gr + p.gi * q.gi) * mi + (p.gi * q.gr - p.gr * q.gi) * mr) filter (bd.d > 0) as ki,
 max(p.gr * q.gr + p.gi * q.gi) filter (bd.d = 0) as gr, max(p.gi * q.gr - p.gr * q.gi) filter (bd.d = 0) as gi from bd join g{DD_ROUNDS} p on p.ti = bd.ti and p.fi = bd.fi and p.ant = ant1 and p.d = bd.d join g{DD_ROUNDS} q on q.ti = bd.ti and q.fi = bd.fi and q.ant = ant2 and q.d = bd.d where ant1 < ant2 group by all)
 select {KEY}, ((re - kr) * gr + (im - ki) * gi) / (gr * gr + gi * gi) as c_re, ((im - ki) * gr - (re - kr) * gi) / (gr * gr + gi * gi) as c_im from x""", "c_re c_im", 3)  # fmt: skip
def peel_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data less what two directions make, corrected for the gains of the first."""
    samples = gauss_newton.intervals(cells(spark, sf_dir).where("ant1 < ant2"), T_INT, F_INT)
    left = chains.peeled(samples, models(), _dd(spark, sf_dir), (1, 2), 0)
    return left.select(*SAMPLE, F.col("r_re").alias("c_re"), F.col("r_im").alias("c_im"))


# ---------------------------------------------------------------- chains of terms

TERMS, RECIPE = [Term(8, 0), Term(0, 1)], [2, 2, 2, 2]
FINE = f"{BASE}, s as materialized (select t as ti, chan as fi, ant1, ant2, sum(w * (re * mre + im * mim)) as zr, sum(w * (im * mre - re * mim)) as zi, sum(w * (mre * mre + mim * mim)) as v from b group by all)"


def _term_key(term: Term, alias: str = "") -> tuple[str, str]:
    return tuple(f"floor({alias}{c} / {n})::bigint" if n else "0::bigint" for c, n in (("ti", term.t_int), ("fi", term.f_int)))


def _chain_sql() -> str:
    out, now = FINE, [None, None]
    for turn, count in enumerate(RECIPE):
        k, j = turn % 2, 1 - turn % 2
        (t, f), (ot, of) = _term_key(TERMS[k], "s."), _term_key(TERMS[j], "s.")
        if now[j]:
            gain = "p.gr * q.gr + p.gi * q.gi as gr, p.gi * q.gr - p.gr * q.gi as gi"
            rows = f"(select s.*, {gain} from s join {now[j]} p on p.ti = {ot} and p.fi = {of} and p.ant = s.ant1 join {now[j]} q on q.ti = {ot} and q.fi = {of} and q.ant = s.ant2) s"
            n = "(gr * gr + gi * gi)" if j < k else "1"
            v = "v" if j < k else "v * (gr * gr + gi * gi)"
            cells_ = f"sum((zr * gr + zi * gi) / {n}) as zr, sum((zi * gr - zr * gi) / {n}) as zi, sum({v}) as v"
        else:
            rows, cells_ = "s", "sum(zr) as zr, sum(zi) as zi, sum(v) as v"
        out += f", w{turn} as materialized (select {t} as ti, {f} as fi, ant1, ant2, {cells_} from {rows} group by all)"
        start = f"left join {now[k]} o on o.ti = w.ti and o.fi = w.fi and o.ant = w.ant1" if now[k] else ""
        first = "coalesce(o.gr, 1.0::double) as gr, coalesce(o.gi, 0.0::double) as gi" if now[k] else "1.0::double as gr, 0.0::double as gi"
        out += f", g{turn}_0 as materialized (select distinct w.ti, w.fi, w.ant1 as ant, {first} from w{turn} w {start})"
        for i in range(1, count + 1):
            mean = "(r.ur + g.gr) / 2 as gr, (r.ui + g.gi) / 2 as gi" if i % 2 == 0 else "r.ur as gr, r.ui as gi"
            out += f""", g{turn}_{i} as materialized (select r.ti, r.fi, r.ant, {mean} from (select w.ti, w.fi, w.ant1 as ant, sum(zr * gr - zi * gi) / sum(v * (gr * gr + gi * gi)) as ur, sum(zr * gi + zi * gr) / sum(v * (gr * gr + gi * gi)) as ui
 from w{turn} w join g{turn}_{i - 1} g on g.ti = w.ti and g.fi = w.fi and g.ant = w.ant2 group by all) r join g{turn}_{i - 1} g using (ti, fi, ant))"""
        now[k] = f"g{turn}_{count}"
    return out + " select * from (" + " union all ".join(f"select {k}::bigint as term, ti, fi, ant, gr as g_re, gi as g_im from {g}" for k, g in enumerate(now)) + ")"


@query(f"with {_chain_sql()}", "g_re g_im", 4)
def solve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains by time before a bandpass by frequency, in turns."""
    fine = gauss_newton.intervals(rebin.hermitian(cells(spark, sf_dir)), 1, 1)
    return chains.chain(written(gauss_newton.normal_sums(fine), "sums"), TERMS, RECIPE)


# ---------------------------------------------------------------- slopes

SLOPE_ROUNDS = 4


def _slope_sql(t: str, f: str, axes: list[str]) -> str:
    n = len(axes) + 1
    raw = ", ".join(f"{a} as a{i}" for i, a in enumerate(axes, 1))
    scaled = ", ".join(f"(a{i} - min(a{i}) over w)::double / case when max(a{i}) over w > min(a{i}) over w then max(a{i}) over w - min(a{i}) over w else 1 end as x{i}" for i in range(1, n))
    out = f"""{BASE}, c as materialized (select {t} as ti, {f} as fi, {raw}, ant1, ant2, sum(w * (re * mre + im * mim)) as zr, sum(w * (im * mre - re * mim)) as zi, sum(w * (mre * mre + mim * mim)) as v from b group by all),
 x as materialized (select *, 1.0::double as x0, {scaled} from c window w as (partition by ti, fi)), p_0 as (select distinct ti, fi, ant1 as ant, {", ".join(f"0.0::double as p{i}" for i in range(n))} from x)"""
    for k in range(1, SLOPE_ROUNDS + 1):
        phase = " + ".join(f"(q.p{i} - o.p{i}) * x{i}" for i in range(n))
        sums = ", ".join([f"sum(r * x{i}) as b{i}" for i in range(n)] + [f"sum(v * x{i} * x{j}) as a{i}{j}" for i in range(n) for j in range(i, n)])
        if n == 2:
            det, size, top = "a00 * a11 - a01 * a01", "a00 * a11", ["a11 * b0 - a01 * b1", "a00 * b1 - a01 * b0"]
        else:
            det, size = "a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02)", "a00 * a11 * a22"
            top = ["(a11 * a22 - a12 * a12) * b0 + (a02 * a12 - a01 * a22) * b1 + (a01 * a12 - a02 * a11) * b2", "(a02 * a12 - a01 * a22) * b0 + (a00 * a22 - a02 * a02) * b1 + (a01 * a02 - a00 * a12) * b2",
                   "(a01 * a12 - a02 * a11) * b0 + (a01 * a02 - a00 * a12) * b1 + (a00 * a11 - a01 * a01) * b2"]
        moved = ", ".join(f"p{i} + 0.5::double * case when det > 1e-9::double * size then ({x}) / det else {'b0 / a00' if i == 0 else '0'} end as p{i}" for i, x in enumerate(top))
        out += f""", r_{k} as (select x.ti, x.fi, x.ant1 as ant, x.* exclude (ti, fi, ant1, ant2, zr, zi), zr * sin({phase}) + zi * cos({phase}) as r from x join p_{k - 1} q on q.ti = x.ti and q.fi = x.fi and q.ant = x.ant2 join p_{k - 1} o on o.ti = x.ti and o.fi = x.fi and o.ant = x.ant1),
 s_{k} as (select *, {det} as det, {size} as size from (select ti, fi, ant, {sums} from r_{k} group by all)), p_{k} as materialized (select ti, fi, ant, {moved} from s_{k} join p_{k - 1} using (ti, fi, ant))"""
    own = [f"p.p{i} - coalesce(o.p{i}, 0)" for i in range(n)]
    own[0] = f"atan2(sin({own[0]}), cos({own[0]}))"
    return f"with {out} " + " union all ".join(f"select p.ti, p.fi, p.ant, {i}::bigint as param, {v} as value from p_{SLOPE_ROUNDS} p left join p_{SLOPE_ROUNDS} o on o.ti = p.ti and o.fi = p.fi and o.ant = 0" for i, v in enumerate(own))


INVERSE = "(1.0::double / (chan + 1))"


def _slopes(spark: SparkSession, sf_dir: str, kind: str, f_whole: bool = True) -> DataFrame:
    c = rebin.hermitian(cells(spark, sf_dir)).withColumns({"ti": F.floor(F.col("t") / 8), "fi": F.lit(0).cast("bigint") if f_whole else F.col("chan")})
    sums, axes = chains.slope_sums(c, kind)
    return chains.slopes(written(sums, "sums"), axes, SLOPE_ROUNDS)


@query(_slope_sql("floor(t / 8)::bigint", "0::bigint", ["chan"]), "value", 4)
def solve_f_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase and a delay an antenna."""
    return _slopes(spark, sf_dir, "f-slope")


@query(_slope_sql("floor(t / 8)::bigint", "chan", ["t"]), "value", 4)
def solve_t_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase and a rate an antenna and channel."""
    return _slopes(spark, sf_dir, "t-slope", False)


@query(_slope_sql("floor(t / 8)::bigint", "0::bigint", ["t", "chan"]), "value", 4)
def solve_tf_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase, a rate and a delay an antenna."""
    return _slopes(spark, sf_dir, "tf-plane")


@query(_slope_sql("floor(t / 8)::bigint", "0::bigint", [INVERSE]), "value", 4)
def solve_if_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase and a slope over inverse frequency an antenna."""
    return _slopes(spark, sf_dir, "if-slope")


@query(_slope_sql("floor(t / 8)::bigint", "0::bigint", ["chan", INVERSE]), "value", 4)
def solve_fif_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase, a delay and a slope over inverse frequency an antenna."""
    return _slopes(spark, sf_dir, "fif-slope")


# ---------------------------------------------------------------- leakages


@query(f"with {_full_rounds(3, "leakage")} select ti, fi, ant, i::bigint as i, j::bigint as j, gr as g_re, gi as g_im from g3", "g_re g_im", 5)
def solve_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 gains of which only the off-diagonals are free."""
    g = gauss_newton.last(gauss_newton.full(*elements(spark, sf_dir), 3, "leakage"), 3, "n")
    return g.select("ti", "fi", "ant", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g_re", "g_im")


# ---------------------------------------------------------------- leakages and a phase between the hands

POL_ROUNDS = 2


def _pol_sql(rounds: int) -> str:
    ratio = "sum((a.gr * b.gr + a.gi * b.gi) / (b.gr * b.gr + b.gi * b.gi))", "sum((a.gi * b.gr - a.gr * b.gi) / (b.gr * b.gr + b.gi * b.gi))"
    phase = lambda g: f"select a.ti, a.fi, atan2({ratio[1]}, {ratio[0]}) as pzd from (select * from {g} where i = 0 and j = 0) a join (select * from {g} where i = 1 and j = 1) b using (ti, fi, ant) group by all"
    held = lambda g, z: f"select ti, fi, ant, i, j, case when i = 1 and j = 1 then cos(pzd) when i = j then 1 else gr end as gr, case when i = 1 and j = 1 then -sin(pzd) when i = j then 0 else gi end as gi from {g} join {z} using (ti, fi)"
    hands = "(re * mr + im * mi) / sqrt(mr * mr + mi * mi)", "(im * mr - re * mi) / sqrt(mr * mr + mi * mi)"
    out = ELEMENTS.replace("g0 as (", "one as (") + f""", z0 as (select ti, fi, atan2(sum(case when i = 0 then {hands[1]} else -{hands[1]} end), sum({hands[0]})) as pzd from e where i <> j group by all), g0 as materialized ({held("one", "z0")})"""
    for k in range(1, rounds + 1):
        out += full_round(2 * k - 1) + f", y{k} as materialized ({phase(f'g{2 * k - 1}')}), q{k} as materialized ({held(f'g{2 * k - 1}', f'y{k}')})"
        if k % 2:
            out += f", z{k} as (select * from y{k}), g{2 * k} as materialized (select * from q{k})"
        else:
            out += f", o{k} as materialized (select ti, fi, ant, i, j, (q.gr + g.gr) / 2 as gr, (q.gi + g.gi) / 2 as gi from q{k} q join g{2 * k - 2} g using (ti, fi, ant, i, j)), z{k} as materialized ({phase(f'o{k}')}), g{2 * k} as materialized ({held(f'o{k}', f'z{k}')})"
    return out


@query(f"with {_pol_sql(POL_ROUNDS)} select ti, fi, ant, i::bigint as i, j::bigint as j, gr as g_re, gi as g_im, pzd from g{2 * POL_ROUNDS} join z{POL_ROUNDS} using (ti, fi)", "g_re g_im pzd", 4)
def solve_polarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakages and the phase between the hands, which starts from the cross hands."""
    samples = element_samples(spark, sf_dir)
    hands = F.explode(F.array(*[F.struct(F.lit(k).alias("corr"), *[F.col(c)[k][p].alias(n) for c, p, n in (("d", "re", "re"), ("d", "im", "im"), ("m", "re", "mre"), ("m", "im", "mim"))]) for k in (1, 2)])).alias("x")
    start = gains.hand_phase(samples.select("ti", "fi", hands).select("ti", "fi", "x.*"), ["ti", "fi"])
    g, z = chains.polarised(samples, written(start, "offsets"), POL_ROUNDS)
    return g.join(z, ["ti", "fi"]).select("ti", "fi", "ant", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g_re", "g_im", "pzd")


# ---------------------------------------------------------------- robust fits

ROBUST_ROUNDS = 2


def _digamma(x: str) -> str:
    return f"(ln({x} + 6) - 0.5 / ({x} + 6) - 1 / (({x} + 6) * ({x} + 6)) * (1 / 12.0::double - 1 / (({x} + 6) * ({x} + 6)) * (1 / 120.0::double - 1 / (({x} + 6) * ({x} + 6)) / 252)) - ({' + '.join(f'1 / ({x} + {i})' for i in range(6))}))"


def _weights_sql(k: int, e: str = "e") -> str:
    """Weights of round k (su, their means mw), the freedoms v{k} that fit them and the weighted elements we{k}, of elements e under g{k - 1} and v{k - 1}."""
    key, g = "ti, fi, t, chan, ant1, ant2", f"g{k - 1}"
    return f""", rs{k} as materialized (select e.ti, e.fi, e.t, e.chan, e.ant1, e.ant2, p.i, q.i as j, sum((p.gr * mr - p.gi * mi) * q.gr + (p.gr * mi + p.gi * mr) * q.gi) as kr, sum((p.gr * mi + p.gi * mr) * q.gr - (p.gr * mr - p.gi * mi) * q.gi) as ki
 from {e} e join {g} p on p.ti = e.ti and p.fi = e.fi and p.ant = e.ant1 and p.j = e.i join {g} q on q.ti = e.ti and q.fi = e.fi and q.ant = e.ant2 and q.j = e.j group by all),
 sq{k} as materialized (select {key}, i, j, (re - kr) * (re - kr) + (im - ki) * (im - ki) as r2 from {e} e join rs{k} using ({key}, i, j)), cv{k} as (select ti, fi, i, j, greatest(avg(r2), 1e-12::double) as c from sq{k} group by all),
 su{k} as materialized (select {key}, any_value(v) as v, (any_value(v) + 4) / (any_value(v) + sum(r2 / c)) as u from sq{k} join cv{k} using (ti, fi, i, j) join v{k - 1} using (ti, fi) group by all),
 mw{k} as (select ti, fi, avg(u) as mu, avg(ln(u) - u) as ml, any_value(v) as v from su{k} group by all),
 v{k} as materialized (select ti, fi, arg_min(f, cost * 1e6::double + f / 1e6::double) as v from (select ti, fi, f, round(abs(ln(f / 2) - {_digamma("(f / 2)")} + ml + 1 + {_digamma("((v + 4) / 2)")} - ln((v + 4) / 2)), 9) as cost from mw{k}, (select unnest(range(2, 101))::double as f)) group by all),
 we{k} as materialized (select e.* exclude (w), w * u / mu as w from {e} e join su{k} using ({key}) join mw{k} using (ti, fi))"""


def _robust_round(k: int, e: str = "e", kind: str = "full", mean: bool | None = None) -> str:
    sums = f""",
 dm{k} as materialized (select d.ti, d.fi, d.ant1, d.ant2, d.i, d.j as k, m.i as j, m.j as l, sum(d.w * (d.re * m.mr + d.im * m.mi)) as re, sum(d.w * (d.im * m.mr - d.re * m.mi)) as im from we{k} d join we{k} m using (t, chan, ant1, ant2) group by all),
 mm{k} as materialized (select d.ti, d.fi, d.ant1, d.ant2, d.i, d.j as l, m.i as j, m.j as s, sum(d.w * (d.mr * m.mr + d.mi * m.mi)) as re, sum(d.w * (d.mi * m.mr - d.mr * m.mi)) as im from we{k} d join we{k} m using (t, chan, ant1, ant2) group by all)"""
    return _weights_sql(k, e) + sums + full_round(k, f"dm{k}", f"mm{k}", kind, mean)


def _robust_sql(rounds: int) -> str:
    return f"{ELEMENTS}, v0 as (select distinct ti, fi, 2.0::double as v from e)" + "".join(_robust_round(k) for k in range(1, rounds + 1))


@query(f"with {_robust_sql(ROBUST_ROUNDS)} select ti, fi, ant, i::bigint as i, j::bigint as j, gr as g_re, gi as g_im, v as freedoms from g{ROBUST_ROUNDS} join v{ROBUST_ROUNDS} using (ti, fi)", "g_re g_im", 4)
def solve_robust_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 gains under Student-t weights, and the degrees of freedom of each interval."""
    g, v = chains.robust(element_samples(spark, sf_dir), ROBUST_ROUNDS)
    return g.join(v, ["ti", "fi"]).select("ti", "fi", "ant", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g_re", "g_im", F.col("v").alias("freedoms"))


SIGMA = 3.0


def _flagged_sql(rounds: int) -> str:
    """Round 1 weighs under unit gains with the freedoms to start from; the fit is rounds 11 on; round 99 weighs under its gains."""
    low = lambda k: f"u / mu < {chains.LOW_FACTOR}::double / v{k}.v * (v{k}.v + {chains.LOW_CORRELATIONS}) / (v{k}.v + {SIGMA}::double)"
    key, last_ = "ti, fi, t, chan, ant1, ant2", 10 + rounds
    out = f"""{ELEMENTS}, v0 as (select distinct ti, fi, {chains.LOW_START}::double as v from e){_weights_sql(1)}, qv as (select ti, fi, avg(c) < {chains.LOW_VARIANCE}::double as quiet from cv1 where i = j group by all),
 lo1 as materialized (select {key}, {low(1)} and not quiet as low from su1 join mw1 using (ti, fi) join v1 using (ti, fi) join qv using (ti, fi)), ek as materialized (select e.* from e join lo1 using ({key}) where not low),
 v10 as (select distinct ti, fi, 2.0::double as v from ek), g10 as (select distinct ti, fi, ant1 as ant, i, j, (i = j)::int::double as gr, 0.0::double as gi from ek)"""
    out += "".join(_robust_round(k, "ek", mean=(k - 10) % 2 == 0) for k in range(11, last_ + 1))
    out += f", g98 as (select * from g{last_}), v98 as (select * from v{last_}){_weights_sql(99, 'ek')}"
    return out + f", lo2 as (select {key}, {low(last_)} as low from su99 join mw99 using (ti, fi) join v{last_} using (ti, fi))"


@query(f"with {_flagged_sql(ROBUST_ROUNDS)} select ti, fi, ant, i::bigint as i, j::bigint as j, gr as g_re, gi as g_im, v as freedoms from g98 join v98 using (ti, fi)", "g_re g_im", 4)
def solve_robust_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robust fit without the samples whose weights under unit gains are too low."""
    g, v, _ = chains.robust_flagged(element_samples(spark, sf_dir), ROBUST_ROUNDS, SIGMA)
    return g.join(v, ["ti", "fi"]).select("ti", "fi", "ant", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g_re", "g_im", F.col("v").alias("freedoms"))


@query(f"with {_flagged_sql(ROBUST_ROUNDS)} select t, chan, ant1, ant2, 1::bigint as wflag from lo1 where low and ant1 < ant2 union all select t, chan, ant1, ant2, 2::bigint from lo2 where low and ant1 < ant2")
def flag_low_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that a robust fit flags, before (1) and after it (2)."""
    flags = chains.robust_flagged(element_samples(spark, sf_dir), ROBUST_ROUNDS, SIGMA)[2]
    return flags.where("wflag > 0 and ant1 < ant2").select("t", "chan", "ant1", "ant2", F.col("wflag").cast("bigint").alias("wflag"))


MATRIX_TERMS, MATRIX_RECIPE = [MatrixTerm(1, 0, "diag", True), MatrixTerm(8, 0, "full", True)], [2, 2, 1]


def _sandwich_sql(e: str, g: str, re: str, im: str, own: MatrixTerm) -> str:
    """P X Q^H of the elements (re, im) of e, with a term's gains."""
    t, f = _term_key(own, "e.")
    pr, pi = f"(p.gr * {re} - p.gi * {im})", f"(p.gr * {im} + p.gi * {re})"
    return f"""(select t, chan, ant1, ant2, p.i, q.i as j, sum({pr} * q.gr + {pi} * q.gi) as kr, sum({pi} * q.gr - {pr} * q.gi) as ki from {e} e
 join {g} p on p.ti = {t} and p.fi = {f} and p.ant = e.ant1 and p.j = e.i join {g} q on q.ti = {t} and q.fi = {f} and q.ant = e.ant2 and q.j = e.j group by all)"""


def _matrix_chain_sql() -> str:
    """Elements start in intervals of a slot and a channel; each turn has its own table of elements and its rounds."""
    out = ELEMENTS.replace(f"floor(t / {T_INT})::bigint as ti, floor(chan / {F_INT})::bigint as fi", "t as ti, chan as fi")
    now, at = [None, None], 100
    for turn, count in enumerate(MATRIX_RECIPE):
        k, j = turn % 2, 1 - turn % 2
        t, f = _term_key(MATRIX_TERMS[k], "e.")
        if now[j] and j > k:
            out += f", fo{turn} as materialized (select {t} as ti, {f} as fi, e.t, e.chan, e.ant1, e.ant2, e.i, e.j, e.re, e.im, kr as mr, ki as mi, e.w from e join {_sandwich_sql('e', now[j], 'mr', 'mi', MATRIX_TERMS[j])} x using (t, chan, ant1, ant2, i, j))"
        elif now[j]:
            wide = ", ".join(f"max(g{c}) filter (i = {i} and j = {m}) as {x}_{c}" for (i, m), x in zip(((0, 0), (0, 1), (1, 0), (1, 1)), "abcd", strict=True) for c in "ri")
            over = lambda x, sign: f"{sign}({x}_r * det_r + {x}_i * det_i) / size, {sign}({x}_i * det_r - {x}_r * det_i) / size"
            rows = f"(0, 0, {over('d', '')}), (0, 1, {over('b', '-')}), (1, 0, {over('c', '-')}), (1, 1, {over('a', '')})"
            out += f""", iw{turn} as (select *, det_r * det_r + det_i * det_i as size from (select *, a_r * d_r - a_i * d_i - b_r * c_r + b_i * c_i as det_r, a_r * d_i + a_i * d_r - b_r * c_i - b_i * c_r as det_i from (select ti, fi, ant, {wide} from {now[j]} group by all))),
 iv{turn} as materialized (select ti, fi, ant, x.i, x.j, x.gr, x.gi from iw{turn}, lateral (values {rows}) x(i, j, gr, gi) where size > 1e-24),
 fo{turn} as materialized (select {t} as ti, {f} as fi, e.t, e.chan, e.ant1, e.ant2, e.i, e.j, kr as re, ki as im, e.mr, e.mi, e.w from e join {_sandwich_sql('e', f'iv{turn}', 're', 'im', MATRIX_TERMS[j])} x using (t, chan, ant1, ant2, i, j))"""
        else:
            out += f", fo{turn} as materialized (select {t} as ti, {f} as fi, e.* exclude (ti, fi) from e)"
        start = f"left join {now[k]} o using (ti, fi, ant, i, j)" if now[k] else ""
        first = "coalesce(o.gr, x.gr) as gr, coalesce(o.gi, x.gi) as gi" if now[k] else "x.gr, x.gi"
        out += f", g{at} as (select x.ti, x.fi, x.ant, x.i, x.j, {first} from (select distinct ti, fi, ant1 as ant, i, j, (i = j)::int::double as gr, 0.0::double as gi from fo{turn}) x {start}), v{at} as (select distinct ti, fi, 2.0::double as v from fo{turn})"
        out += "".join(_robust_round(at + n, f"fo{turn}", MATRIX_TERMS[k].kind, n % 2 == 0) for n in range(1, count + 1))
        now[k] = f"g{at + count}"
        at += 100
    return out + " select * from (" + " union all ".join(f"select {k}::bigint as term, ti, fi, ant, i::bigint as i, j::bigint as j, gr as g_re, gi as g_im from {g}" for k, g in enumerate(now)) + ")"


@query(f"with {_matrix_chain_sql()}", "g_re g_im", 4)
def solve_chain_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal gains by slot before full ones by eight slots, both robust, in turns."""
    g = chains.matrix_chain(element_samples(spark, sf_dir, 1, 1), MATRIX_TERMS, MATRIX_RECIPE)
    return g.select("term", "ti", "fi", "ant", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g_re", "g_im")


# ---------------------------------------------------------------- a loop that stops by itself

MOST, EPSILON, DELTA = 6, 0.02, 0.02


def _active_sql() -> str:
    out = SUMS.replace("0.0::double as jhj", "null::double as chi2")
    for k in range(1, MOST + 1):
        mean = "(r.ur + g.gr) / 2 as gr, (r.ui + g.gi) / 2 as gi" if k % 2 == 0 else "r.ur as gr, r.ui as gi"
        out += f""", n{k} as materialized (select r.ti, r.fi, r.ant, {mean}, g.gr as fr, g.gi as fm, g.chi2 from (select s.ti, s.fi, ant1 as ant, sum(zr * gr - zi * gi) / sum(v * (gr * gr + gi * gi)) as ur, sum(zr * gi + zi * gr) / sum(v * (gr * gr + gi * gi)) as ui
 from s join g{k - 1} g on g.ti = s.ti and g.fi = s.fi and g.ant = s.ant2 group by all) r join g{k - 1} g using (ti, fi, ant)), m{k} as (select ti, fi, sum((gr - fr) * (gr - fr) + (gi - fm) * (gi - fm)) / sum(gr * gr + gi * gi) as change, max(chi2) as before from n{k} group by all)"""
        if k % 2 == 0:
            out += f""", c{k} as (select s.ti, s.fi, sum(dd - 2 * (zr * (p.gr * q.gr + p.gi * q.gi) + zi * (p.gi * q.gr - p.gr * q.gi)) + (p.gr * p.gr + p.gi * p.gi) * (q.gr * q.gr + q.gi * q.gi) * v) as chi from s
 join n{k} p on p.ti = s.ti and p.fi = s.fi and p.ant = s.ant1 join n{k} q on q.ti = s.ti and q.fi = s.fi and q.ant = s.ant2 group by all)"""
            stalled, joined, chi = f"when before - chi <= {DELTA} * before then 'stalled'", f"join c{k} using (ti, fi)", "coalesce(chi, before)"
        else:
            stalled, joined, chi = "", "", "before"
        out += f", t{k} as materialized (select ti, fi, {chi} as chi2, case when change <= {EPSILON * EPSILON!r}::double then 'converged' {stalled} else 'running' end as state from m{k} {joined})"
        out += f", d{k} as (select ti, fi, ant, gr, gi, t{k}.chi2, state from n{k} join t{k} using (ti, fi)), g{k} as materialized (select ti, fi, ant, gr, gi, chi2 from d{k} where state = 'running')"
    parts = [f"select ti, fi, ant, gr as g_re, gi as g_im, {k}::bigint as rounds, state from d{k} where state <> 'running'" for k in range(1, MOST + 1)]
    return f"with {out} {' union all '.join(parts)} union all select ti, fi, ant, gr, gi, {MOST}::bigint, 'running' from g{MOST}"


@query(_active_sql(), "g_re g_im", 4)
def solve_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each interval is iterated until its own gains converge or its chi-squared stalls."""
    samples = _samples(spark, sf_dir)
    power = samples.groupBy("ti", "fi", "ant1", "ant2").agg(F.sum(F.col("w") * cx("re", "im").abs2()).alias("dd"))
    sums = written(gauss_newton.normal_sums(samples).join(power, ["ti", "fi", "ant1", "ant2"]), "sums")
    return chains.solve_until(sums, EPSILON, DELTA, MOST)
