"""Gains by Gauss-Newton iterations as joins and grouped sums. Within an interval of time and frequency gains are constant, so data and model enter by sums over a baseline's samples only:
they are formed once, with partial sums before the shuffle, and the iterations run on rows of (interval, baseline), however many samples there are.

Histories have rows (k, ti, fi, ant, ...): k = 0 are the unit gains that iterations start from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx, Mat, cx, polar
from ..sources.tables import written

KEY = ("ti", "fi")


def intervals(both: DataFrame, t_int: int, f_int: int) -> DataFrame:
    """ti and fi of samples by time slot t and channel; 0 is one interval for all."""
    at = lambda c, n: (F.floor(F.col(c) / n) if n else F.lit(0)).cast("bigint")
    return both.withColumns({"ti": at("t", t_int), "fi": at("chan", f_int)})


def normal_sums(both: DataFrame) -> DataFrame:
    """Of samples from both ends with ti and fi: z = sum w d conj(m), v = sum w |m|^2 and n by interval and baseline; flagged samples are left out beforehand."""
    z, m = cx("re", "im") * cx("mre", "mim").conj(), cx("mre", "mim")
    w = F.col("w")
    return both.groupBy(*KEY, "ant1", "ant2").agg(F.sum(w * z.re).alias("z_re"), F.sum(w * z.im).alias("z_im"), F.sum(w * m.abs2()).alias("v"), F.count(F.lit(1)).alias("n"))


def _other(sums: DataFrame, g: DataFrame) -> DataFrame:
    return sums.join(g.select(*KEY, F.col("ant").alias("ant2"), "g_re", "g_im"), [*KEY, "ant2"])


def diagonal(sums: DataFrame, iterations: int, start: DataFrame | None = None) -> DataFrame:
    """History of one complex gain an antenna: g_p = sum z g_q / sum v |g_q|^2; even iterations take the mean with the one before. jhj is the denominator. Starts from unit gains, or from those in
    start (ti, fi, ant, g_re, g_im) where it has them."""
    g = sums.select(*KEY, F.col("ant1").alias("ant")).distinct().withColumns({"k": F.lit(0), "g_re": F.lit(1.0), "g_im": F.lit(0.0), "jhj": F.lit(0.0)})
    if start is not None:
        old = start.select(*KEY, "ant", F.col("g_re").alias("_re"), F.col("g_im").alias("_im"))
        g = written(g.join(old, [*KEY, "ant"], "left").select(*KEY, "ant", "k", F.coalesce("_re", "g_re").alias("g_re"), F.coalesce("_im", "g_im").alias("g_im"), "jhj"), "gains")
    out = g
    for k in range(1, iterations + 1):
        x = _other(sums, g)
        r, h = cx("z_re", "z_im") * cx("g_re", "g_im"), F.col("v") * cx("g_re", "g_im").abs2()
        new = x.groupBy(*KEY, F.col("ant1").alias("ant")).agg(F.sum(r.re).alias("r_re"), F.sum(r.im).alias("r_im"), F.sum(h).alias("jhj"))
        ok = F.when(F.col("jhj") > 0, F.col("jhj"))
        new = new.select(*KEY, "ant", F.coalesce(F.col("r_re") / ok, F.lit(0.0)).alias("u_re"), F.coalesce(F.col("r_im") / ok, F.lit(0.0)).alias("u_im"), "jhj")
        half = 0.5 if k % 2 == 0 else 0.0
        g = new.join(g.select(*KEY, "ant", "g_re", "g_im"), [*KEY, "ant"])
        g = g.select(*KEY, "ant", F.lit(k).alias("k"), (F.col("u_re") * (1 - half) + F.col("g_re") * half).alias("g_re"), (F.col("u_im") * (1 - half) + F.col("g_im") * half).alias("g_im"), "jhj")
        # each round reads the one before as a table of a row an antenna and interval
        g = written(g, "gains")
        out = out.unionByName(g)
    return out


def phases(sums: DataFrame, iterations: int) -> DataFrame:
    """History of one phase an antenna: it moves by Im(conj(g_p) sum z g_q) / sum v, by half of that in even iterations."""
    g = sums.select(*KEY, F.col("ant1").alias("ant")).distinct().withColumns({"k": F.lit(0), "phase": F.lit(0.0)})
    out = g
    for k in range(1, iterations + 1):
        unit = lambda c: polar(F.col(c))
        x = sums.join(g.select(*KEY, F.col("ant").alias("ant2"), F.col("phase").alias("q")), [*KEY, "ant2"]).join(g.select(*KEY, F.col("ant").alias("ant1"), F.col("phase").alias("p")), [*KEY, "ant1"])
        r = unit("p").conj() * cx("z_re", "z_im") * unit("q")
        step = x.groupBy(*KEY, F.col("ant1").alias("ant")).agg(F.sum(r.im).alias("r"), F.sum("v").alias("v"))
        move = F.coalesce(F.col("r") / F.when(F.col("v") > 0, F.col("v")), F.lit(0.0)) * (0.5 if k % 2 == 0 else 1.0)
        g = written(step.join(g, [*KEY, "ant"]).select(*KEY, "ant", F.lit(k).alias("k"), (F.col("phase") + move).alias("phase")), "phases")
        out = out.unionByName(g)
    return out


# ---------------------------------------------------------------- 2 x 2 gains: elements as rows


def element_sums(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of samples from both ends with d and m as arrays of four (re, im) structs (00, 01, 10, 11), ti and fi: sums over a baseline's samples of w d_ik conj(m_jl), rows (i, k, j, l),
    and of w m_il conj(m_js), rows (i, l, j, s). Samples stay single rows: all products are columns of one aggregate, and become rows of baselines after it."""

    def total(x: str, a: int, y: str, b: int) -> Column:
        p = cx(F.col(x)[a]["re"], F.col(x)[a]["im"]) * cx(F.col(y)[b]["re"], F.col(y)[b]["im"]).conj()
        return F.struct(F.sum(F.col("w") * p.re).alias("re"), F.sum(F.col("w") * p.im).alias("im"))

    pairs = [(a, b) for a in range(4) for b in range(4)]
    wide = samples.groupBy(*KEY, "ant1", "ant2").agg(*[total("d", a, "m", b).alias(f"d{a}{b}") for a, b in pairs], *[total("m", a, "m", b).alias(f"m{a}{b}") for a, b in pairs if a <= b])
    wide = written(wide, "elements")

    def rows(cell: Callable[[int, int], tuple[Column, Column]], names: tuple[str, ...]) -> DataFrame:
        cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (a // 2, a % 2, b // 2, b % 2), strict=True)], *[x.alias(n) for n, x in zip(("re", "im"), cell(a, b), strict=True)]) for a, b in pairs]
        return wide.select(*KEY, "ant1", "ant2", F.explode(F.array(*cells)).alias("x")).select(*KEY, "ant1", "ant2", "x.*")

    at = lambda n: (F.col(n)["re"], F.col(n)["im"])
    mm = lambda a, b: at(f"m{a}{b}") if a <= b else (F.col(f"m{b}{a}")["re"], -F.col(f"m{b}{a}")["im"])
    return rows(lambda a, b: at(f"d{a}{b}"), ("i", "k", "j", "l")), rows(mm, ("i", "l", "j", "s"))


def unit_elements(rows: DataFrame) -> DataFrame:
    """Unit 2 x 2 gains of each interval and antenna (ant1) of rows: (ti, fi, ant, n, i, j, g_re, g_im), n = 0."""
    unit = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(i == j)).alias("g_re"), F.lit(0.0).alias("g_im")) for i in (0, 1) for j in (0, 1)]
    return rows.select(*KEY, F.col("ant1").alias("ant")).distinct().select(*KEY, "ant", F.lit(0).alias("n"), F.explode(F.array(*unit)).alias("x")).select(*KEY, "ant", "n", "x.*")


Restriction = Callable[[Mat, Mat, Mat], Mat]


def _diagonal_of(both: Callable[[Mat, Mat], tuple[Cx, Cx]]) -> Restriction:
    """A restriction to diagonal gains, whose two elements both makes of JHR and JHJ."""

    def restrict(_: Mat, r: Mat, h: Mat) -> Mat:
        zero = cx(F.lit(0.0), F.lit(0.0))
        a, b = both(r, h)
        return ((a, zero), (zero, b))

    return restrict


def _ratio(x: Cx, size: Column) -> Cx:
    """x over a size; null where that is none."""
    return Cx(x.re / F.when(size > 0, size), x.im / F.when(size > 0, size))


def _hands(r: Mat, h: Mat) -> tuple[Cx, Cx]:
    return _ratio(r[0][0], h[0][0].re), _ratio(r[1][1], h[1][1].re)


def _common(r: Mat, h: Mat) -> tuple[Cx, Cx]:
    g = _ratio(r[0][0] + r[1][1], h[0][0].re + h[1][1].re)
    return g, g


def _leakage(u: Mat, r: Mat, h: Mat) -> Mat:
    one = cx(F.lit(1.0), F.lit(0.0))
    return ((one, u[0][1]), (u[1][0], one))


#: Kinds of 2 x 2 gains: what becomes of an update, given also JHR and JHJ. Users add their own; an element that comes out null keeps its value of the round before.
KINDS: dict[str, Restriction] = {
    "full": lambda u, r, h: u,
    "diag": _diagonal_of(_hands),
    "phase": _diagonal_of(lambda r, h: tuple(_ratio(g, g.abs()) for g in _hands(r, h))),
    "amp": _diagonal_of(lambda r, h: tuple(Cx(g.abs(), F.lit(0.0)) for g in _hands(r, h))),
    "scalar": _diagonal_of(_common),
    "leakage": _leakage,
}


def full_update(dm: DataFrame, mm: DataFrame, g: DataFrame, n: int, kind: str = "full") -> DataFrame:
    """2 x 2 gains of round n from those before: JHR = sum D G_q M_qp, JHJ = sum (G_q M_qp)^H (G_q M_qp), update JHR JHJ^-1 as the kind restricts it, even rounds the mean with the one before.
    Elements that a kind fixes are as it says; of the others, those that JHJ leaves open (it is singular) stay as they were, and so do all of an antenna without samples."""
    if kind not in KINDS:
        raise ValueError(f"kinds: {', '.join(KINDS)}")
    by = [*KEY, "ant1"]
    el = lambda a, b, c, d: g.select(*KEY, F.col("ant").alias("ant2"), F.col("i").alias(a), F.col("j").alias(b), F.col("g_re").alias(c), F.col("g_im").alias(d))
    # (G_q M_qp)_kj = sum_l G_kl conj(M_jl)
    r = cx("re", "im") * cx("g_re", "g_im")
    jhr = dm.join(el("k", "l", "g_re", "g_im"), [*KEY, "ant2", "k", "l"]).groupBy(*by, "i", "j").agg(F.sum(r.re).alias("re"), F.sum(r.im).alias("im"))
    # conj((G M^H)_ki) (G M^H)_kj = conj(G_kl) G_ks m_il conj(m_js)
    h = cx("re", "im") * cx("a_re", "a_im").conj() * cx("b_re", "b_im")
    jhj = mm.join(el("k", "l", "a_re", "a_im"), [*KEY, "ant2", "l"]).join(el("k", "s", "b_re", "b_im"), [*KEY, "ant2", "k", "s"]).groupBy(*by, "i", "j").agg(F.sum(h.re).alias("re"), F.sum(h.im).alias("im"))
    wide = lambda x, tag: x.groupBy(*by).agg(*[F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c))).alias(f"{tag}{i}{j}_{c}") for i in (0, 1) for j in (0, 1) for c in ("re", "im")])
    both = wide(jhr, "r").join(wide(jhj, "h"), by)
    matrix = lambda tag: tuple(tuple(cx(f"{tag}{i}{j}_re", f"{tag}{i}{j}_im") for j in (0, 1)) for i in (0, 1))
    top, own = matrix("r"), matrix("h")
    det = own[0][0] * own[1][1] - own[0][1] * own[1][0]
    det = Cx(F.when(det.abs2() > 0, det.re), F.when(det.abs2() > 0, det.im))
    inverse = ((own[1][1], -own[0][1]), (-own[1][0], own[0][0]))
    update = tuple(tuple((top[i][0] * inverse[0][j] + top[i][1] * inverse[1][j]).over(det) for j in (0, 1)) for i in (0, 1))
    limited = KINDS[kind](update, top, own)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), limited[i][j].re.alias("u_re"), limited[i][j].im.alias("u_im")) for i in (0, 1) for j in (0, 1)]
    new = both.select(*KEY, F.col("ant1").alias("ant"), F.explode(F.array(*cells)).alias("x")).select(*KEY, "ant", "x.*")
    half = 0.5 if n % 2 == 0 else 0.0
    step = lambda c: F.coalesce(F.col(f"u_{c}") * (1 - half) + F.col(f"g_{c}") * half, f"g_{c}").alias(f"g_{c}")
    return written(g.drop("n").join(new, [*KEY, "ant", "i", "j"], "left").select(*KEY, "ant", F.lit(n).alias("n"), "i", "j", step("re"), step("im")), "gains")


def started(rows: DataFrame, start: DataFrame | None) -> DataFrame:
    """The 2 x 2 gains that iterations begin with: those of start (ti, fi, ant, i, j, g_re, g_im), unit gains for the rest."""
    g = unit_elements(rows)
    if start is None:
        return g
    old = start.select(*KEY, "ant", "i", "j", F.col("g_re").alias("_re"), F.col("g_im").alias("_im"))
    return written(g.join(old, [*KEY, "ant", "i", "j"], "left").select(*KEY, "ant", "n", "i", "j", F.coalesce("_re", "g_re").alias("g_re"), F.coalesce("_im", "g_im").alias("g_im")), "gains")


def full(dm: DataFrame, mm: DataFrame, iterations: int, kind: str = "full", start: DataFrame | None = None) -> DataFrame:
    """History of 2 x 2 gains of a kind, elements as rows (i, j, g_re, g_im)."""
    g = out = started(dm, start)
    for n in range(1, iterations + 1):
        g = full_update(dm, mm, g, n, kind)
        out = out.unionByName(g)
    return out


# ---------------------------------------------------------------- what iterations came to


def last(history: DataFrame, k: int, column: str = "k") -> DataFrame:
    return history.where(F.col(column) == k).drop(column)


def convergence(history: DataFrame, k: int, epsilon: float) -> DataFrame:
    """By interval: change = sum |g_k - g_(k-1)|^2 / sum |g_k|^2 over antennas, and whether it is within epsilon squared."""
    now, before = last(history, k), last(history, k - 1).select(*KEY, "ant", F.col("g_re").alias("o_re"), F.col("g_im").alias("o_im"))
    d = cx("g_re", "g_im") - cx("o_re", "o_im")
    s = now.join(before, [*KEY, "ant"]).groupBy(*KEY).agg((F.sum(d.abs2()) / F.sum(cx("g_re", "g_im").abs2())).alias("change"))
    return s.withColumn("converged", F.col("change") <= epsilon * epsilon)


def reached(intervals_: DataFrame, flag: str, quorum: float) -> DataFrame:
    """One row: the share of intervals with a flag, and whether it makes the quorum."""
    return intervals_.agg(F.avg(F.col(flag).cast("double")).alias("share")).withColumn("reached", F.col("share") >= quorum)


def chi_squares(sums: DataFrame, power: DataFrame, history: DataFrame) -> DataFrame:
    """Chi-squared of each iteration's gains by (k, ti, fi): sum w |d - g_p m conj(g_q)|^2 from the baselines' sums; power has sum w |d|^2 (dd)."""
    g = history.select("k", *KEY, "ant", "g_re", "g_im")
    p, q = g.select("k", *KEY, F.col("ant").alias("ant1"), F.col("g_re").alias("p_re"), F.col("g_im").alias("p_im")), g.select("k", *KEY, F.col("ant").alias("ant2"), F.col("g_re").alias("q_re"), F.col("g_im").alias("q_im"))
    x = sums.join(power, [*KEY, "ant1", "ant2"]).join(p, [*KEY, "ant1"]).join(q, ["k", *KEY, "ant2"])
    gain = cx("p_re", "p_im") * cx("q_re", "q_im").conj()
    fit = cx("z_re", "z_im") * gain.conj()
    return x.groupBy("k", *KEY).agg(F.sum(F.col("dd") - 2 * fit.re + gain.abs2() * F.col("v")).alias("chi2"))


def progress(chi: DataFrame, k: int, delta: float) -> DataFrame:
    """By interval: whether chi-squared has stalled (falls by delta of itself or less) or diverges (grows by more than a tenth)."""
    now, before = chi.where(F.col("k") == k).drop("k"), chi.where(F.col("k") == k - 1).select(*KEY, F.col("chi2").alias("before"))
    fall = F.col("before") - F.col("chi2")
    return now.join(before, list(KEY)).select(*KEY, "before", "chi2", (fall <= delta * F.col("before")).alias("stalled"), (fall < -0.1 * F.col("before")).alias("diverging"))


def posterior_errors(gains: DataFrame) -> DataFrame:
    """error: sqrt(1 / JHJ) of each gain."""
    return gains.withColumn("error", F.sqrt(1 / F.when(F.col("jhj") > 0, F.col("jhj"))))


def flagged(gains: DataFrame, bits: dict[str, int], low: float, high: float, max_error: float) -> DataFrame:
    """gflags: the first that applies of BOOM (not finite), GNULL (zero), GOOB (size outside low..high) and GVAR (posterior error above max_error)."""
    size = cx("g_re", "g_im").abs()
    boom = F.isnan("g_re") | F.isnan("g_im") | (F.abs("g_re") == float("inf")) | (F.abs("g_im") == float("inf"))
    rules = (("BOOM", boom), ("GNULL", size == 0), ("GOOB", (size < low) | (size > high)), ("GVAR", F.coalesce(F.col("error") > max_error, F.lit(True))))
    out = F.lit(0)
    for name, rule in reversed(rules):
        out = F.when(rule, bits[name]).otherwise(out)
    return gains.withColumn("gflags", out.cast("bigint"))


def restored(gains: DataFrame, before: DataFrame) -> DataFrame:
    """Flagged gains go back to their values of the iteration before."""
    old = before.select(*KEY, "ant", F.col("g_re").alias("o_re"), F.col("g_im").alias("o_im"))
    pick = lambda c: F.when(F.col("gflags") != 0, F.col(f"o_{c}")).otherwise(F.col(f"g_{c}")).alias(f"g_{c}")
    return gains.join(old, [*KEY, "ant"]).select(*KEY, "ant", pick("re"), pick("im"), "error", "gflags")


def referred(gains: DataFrame, antenna: int) -> DataFrame:
    """Gains turned by the phase of a reference antenna, whose own becomes real; an interval without it stays."""
    ref = gains.where(F.col("ant") == antenna).select(*KEY, F.atan2("g_im", "g_re").alias("_ref"))
    turned = cx("g_re", "g_im") * polar(-F.coalesce("_ref", F.lit(0.0)))
    return gains.join(ref, list(KEY), "left").withColumns({"g_re": turned.re, "g_im": turned.im}).drop("_ref")


def exported(gains: DataFrame) -> DataFrame:
    """Parameters as rows: ti, fi, ant, name (gain.re, gain.im, phase), value and error."""
    size = cx("g_re", "g_im").abs()
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), e.alias("error")) for n, v, e in (("gain.re", F.col("g_re"), F.col("error")), ("gain.im", F.col("g_im"), F.col("error")), ("phase", F.atan2("g_im", "g_re"), F.col("error") / F.when(size > 0, size)))])
    return gains.select(*KEY, "ant", F.explode(rows).alias("x")).select(*KEY, "ant", "x.*")
