"""Fits of several directions, of chains of terms, of phase slopes, and fits that stop by themselves: joins and grouped sums over baselines, like gauss_newton, whose sums they take.

Rows of gains and parameters are one an antenna and interval; sums one a baseline and interval. Each round is written, so lineage stays short and a lost executor costs a round at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx, Mat, cx, mat_inverse, polar, sandwich
from ..sources.tables import written
from .gauss_newton import KEY, diagonal, element_sums, full, full_update, last, started, unit_elements

# ---------------------------------------------------------------- several directions


def direction_sums(both: DataFrame, models: list[Cx]) -> DataFrame:
    """Of samples from both ends with ti and fi, and the model of each direction: z_d = sum w data conj(m_d) and v_de = sum w m_e conj(m_d), d <= e, by interval and baseline. Samples stay single
    rows; each pair of directions is a column."""
    w, sums = F.col("w"), []
    for d, m in enumerate(models):
        z = cx("re", "im") * m.conj()
        sums += [F.sum(w * z.re).alias(f"z{d}_re"), F.sum(w * z.im).alias(f"z{d}_im")]
        for e in range(d, len(models)):
            v = models[e] * m.conj()
            sums += [F.sum(w * v.re).alias(f"v{d}{e}_re"), F.sum(w * v.im).alias(f"v{d}{e}_im")]
    return both.groupBy(*KEY, "ant1", "ant2").agg(*sums)


def _pair(d: int, e: int) -> Cx:
    v = cx(f"v{min(d, e)}{max(d, e)}_re", f"v{min(d, e)}{max(d, e)}_im")
    return v if d <= e else v.conj()


def _ends(sums: DataFrame, g: DataFrame, columns: list[str]) -> DataFrame:
    """sums with an antenna's columns for both ends: p_... of ant1 and q_... of ant2."""
    for end, ant in (("q", "ant2"), ("p", "ant1")):
        sums = sums.join(g.select(*KEY, F.col("ant").alias(ant), *[F.col(c).alias(f"{end}_{c}") for c in columns]), [*KEY, ant])
    return sums


def directions(sums: DataFrame, n: int, iterations: int) -> DataFrame:
    """History (k, ti, fi, ant, dir, g_re, g_im) of n complex gains an antenna, fitted together: what all directions make of the gains is taken from each one's sums, and half of the step that is
    left is added to its gain."""
    columns = [f"g{d}_{c}" for d in range(n) for c in ("re", "im")]
    g = sums.select(*KEY, F.col("ant1").alias("ant")).distinct().withColumns({c: F.lit(float(c.endswith("re"))) for c in columns} | {"k": F.lit(0)})
    history = [g]
    for k in range(1, iterations + 1):
        x = _ends(sums, g, columns)
        p, q = ([cx(f"{end}_g{d}_re", f"{end}_g{d}_im") for d in range(n)] for end in "pq")
        steps = []
        for d in range(n):
            left = cx(f"z{d}_re", f"z{d}_im")
            for e in range(n):
                left = left - p[e] * q[e].conj() * _pair(d, e)
            r = left * q[d]
            steps += [F.sum(r.re).alias(f"r{d}_re"), F.sum(r.im).alias(f"r{d}_im"), F.sum(q[d].abs2() * F.col(f"v{d}{d}_re")).alias(f"h{d}")]
        new = x.groupBy(*KEY, F.col("ant1").alias("ant")).agg(*steps).join(g.drop("k"), [*KEY, "ant"])
        moved = [(F.col(f"g{d}_{c}") + 0.5 * F.coalesce(F.col(f"r{d}_{c}") / F.when(F.col(f"h{d}") > 0, F.col(f"h{d}")), F.lit(0.0))).alias(f"g{d}_{c}") for d in range(n) for c in ("re", "im")]
        g = written(new.select(*KEY, "ant", *moved, F.lit(k).alias("k")), "directions")
        history.append(g)
    out = history[0]
    for h in history[1:]:
        out = out.unionByName(h)
    each = F.explode(F.array(*[F.struct(F.lit(d).cast("bigint").alias("dir"), F.col(f"g{d}_re").alias("g_re"), F.col(f"g{d}_im").alias("g_im")) for d in range(n)])).alias("x")
    return out.select("k", *KEY, "ant", each).select("k", *KEY, "ant", "x.*")


def peeled(samples: DataFrame, models: list[Cx], gains: DataFrame, subtract: tuple[int, ...], correct: int | None = None) -> DataFrame:
    """Samples (ti, fi, ant1, ant2, re, im, ...) less what the directions in subtract make under their gains (ti, fi, ant, dir, g_re, g_im), r_re and r_im; with correct, divided by that direction's
    gains of both ends (null where these are zero)."""
    columns = [f"g{d}_{c}" for d in range(len(models)) for c in ("re", "im")]
    wide = gains.groupBy(*KEY, "ant").agg(*[F.max(F.when(F.col("dir") == d, F.col(f"g_{c}"))).alias(f"g{d}_{c}") for d in range(len(models)) for c in ("re", "im")])
    x = _ends(samples, wide, columns)
    both = [cx(f"p_g{d}_re", f"p_g{d}_im") * cx(f"q_g{d}_re", f"q_g{d}_im").conj() for d in range(len(models))]
    left = cx("re", "im")
    for d in subtract:
        left = left - both[d] * models[d]
    if correct is not None:
        ok = both[correct].abs2() > 0
        left = left.over(Cx(F.when(ok, both[correct].re), F.when(ok, both[correct].im)))
    return x.withColumns({"r_re": left.re, "r_im": left.im}).drop(*[f"{end}_{c}" for end in "pq" for c in columns])


# ---------------------------------------------------------------- chains of terms


@dataclass(frozen=True)
class Term:
    """A gain term's solution intervals, in intervals of the sums that a chain starts from (0: one for all)."""

    t_int: int = 1
    f_int: int = 0

    def key(self, name: str) -> Column:
        n = self.t_int if name == "ti" else self.f_int
        return (F.floor(F.col(name) / n) if n else F.lit(0)).cast("bigint")


def folded(sums: DataFrame, terms: list[Term], gains: list[DataFrame | None], k: int) -> DataFrame:
    """Sums (z, v) of fine intervals as term k sees them: terms to the right go into the model, those to the left are taken off the data, and the result is added up in the term's own intervals."""
    z, v = cx("z_re", "z_im"), F.col("v")
    for j, (term, g) in enumerate(zip(terms, gains, strict=True)):
        if j == k or g is None:
            continue
        for end, ant in (("p", "ant1"), ("q", "ant2")):
            own = g.select(F.col("ti").alias(f"_t{j}"), F.col("fi").alias(f"_f{j}"), F.col("ant").alias(ant), F.col("g_re").alias(f"_{end}{j}_re"), F.col("g_im").alias(f"_{end}{j}_im"))
            sums = sums.withColumns({f"_t{j}": term.key("ti"), f"_f{j}": term.key("fi")}).join(own, [f"_t{j}", f"_f{j}", ant])
        gain = cx(f"_p{j}_re", f"_p{j}_im") * cx(f"_q{j}_re", f"_q{j}_im").conj()
        if j > k:
            z, v = z * gain.conj(), v * gain.abs2()
        else:
            sums = sums.where(gain.abs2() > 0)
            z = z.over(gain)
    own = terms[k]
    return sums.groupBy(own.key("ti").alias("ti"), own.key("fi").alias("fi"), "ant1", "ant2").agg(F.sum(z.re).alias("z_re"), F.sum(z.im).alias("z_im"), F.sum(v).alias("v"))


def chain(sums: DataFrame, terms: list[Term], recipe: list[int]) -> DataFrame:
    """(term, ti, fi, ant, g_re, g_im) of the terms of a product of complex gains; recipe: iterations, dealt to the terms in turn. Samples are read once: each turn starts from the fine sums."""
    gains: list[DataFrame | None] = [None] * len(terms)
    for turn, count in enumerate(recipe):
        k = turn % len(terms)
        seen = written(folded(sums, terms, gains, k), "folded")
        gains[k] = diagonal(seen, count, gains[k]).where(F.col("k") == count).select(*KEY, "ant", "g_re", "g_im")
    out = None
    for k, g in enumerate(gains):
        if g is not None:
            rows = g.select(F.lit(k).cast("bigint").alias("term"), *KEY, "ant", "g_re", "g_im")
            out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- phase slopes


def scaled_axis(cells: DataFrame, axis: str, name: str) -> DataFrame:
    """name: the axis scaled to [0, 1] within an interval."""
    ends = cells.groupBy(*KEY).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    wide = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1)
    return cells.join(ends, list(KEY)).withColumn(name, (F.col(axis) - F.col("_lo")) / wide).drop("_lo", "_hi")


#: Kinds of slopes: the axes that a phase depends on besides its offset, as columns of slots t and channels chan. Users add their own, of one or two axes.
SLOPES: dict[str, tuple[str, ...]] = {"f-slope": ("chan",), "t-slope": ("t",), "tf-plane": ("t", "chan"), "if-slope": ("1d / (chan + 1)",), "fif-slope": ("chan", "1d / (chan + 1)")}


def slope_sums(both: DataFrame, kind: str) -> tuple[DataFrame, list[str]]:
    """Of samples from both ends with ti and fi: sums z and v by interval, place and baseline, with the kind's axes scaled within an interval; and these columns' names."""
    if kind not in SLOPES:
        raise ValueError(f"slopes: {', '.join(SLOPES)}")
    z, m = cx("re", "im") * cx("mre", "mim").conj(), cx("mre", "mim")
    axes = {f"_a{i}": F.expr(axis) for i, axis in enumerate(SLOPES[kind], 1)}
    sums = both.withColumns(axes).groupBy(*KEY, *axes, "ant1", "ant2").agg(F.sum(F.col("w") * z.re).alias("z_re"), F.sum(F.col("w") * z.im).alias("z_im"), F.sum(F.col("w") * m.abs2()).alias("v"))
    for axis in axes:
        sums = scaled_axis(sums, axis, axis.replace("_a", "x"))
    return sums, [axis.replace("_a", "x") for axis in axes]


def _solved(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """The solution of a symmetric system of two or three equations; where it is singular, of the first one alone."""
    n = len(b)
    if n == 2:
        det = a[0][0] * a[1][1] - a[0][1] * a[0][1]
        top = [a[1][1] * b[0] - a[0][1] * b[1], a[0][0] * b[1] - a[0][1] * b[0]]
        size = a[0][0] * a[1][1]
    else:
        minor = lambda i, j, k, m: a[i][k] * a[j][m] - a[i][m] * a[j][k]
        c = [[minor(1, 2, 1, 2), -minor(1, 2, 0, 2), minor(1, 2, 0, 1)], [-minor(0, 2, 1, 2), minor(0, 2, 0, 2), -minor(0, 2, 0, 1)], [minor(0, 1, 1, 2), -minor(0, 1, 0, 2), minor(0, 1, 0, 1)]]
        det = a[0][0] * c[0][0] + a[0][1] * c[0][1] + a[0][2] * c[0][2]
        top = [c[i][0] * b[0] + c[i][1] * b[1] + c[i][2] * b[2] for i in range(3)]
        size = a[0][0] * a[1][1] * a[2][2]
    fine = F.when(det > 1e-9 * size, det)
    alone = F.coalesce(b[0] / F.when(a[0][0] > 0, a[0][0]), F.lit(0.0))
    return [F.coalesce(t / fine, alone if i == 0 else F.lit(0.0)) for i, t in enumerate(top)]


def slopes(cells: DataFrame, axes: list[str], iterations: int, reference: int = 0) -> DataFrame:
    """(ti, fi, ant, param, value): phases p0 + p1 x1 (+ p2 x2) of each antenna over the axes x of an interval. cells: sums z and v by interval, place on the axes, and baseline. Sums of products of
    the axes by antenna make a system of two or three equations a round; half of its solution is added. In the end the reference's parameters are taken off, and offsets lie within a turn."""
    n = len(axes) + 1
    names = [f"p{i}" for i in range(n)]
    x = [F.lit(1.0), *[F.col(c) for c in axes]]
    p = cells.select(*KEY, F.col("ant1").alias("ant")).distinct().withColumns({c: F.lit(0.0) for c in names})
    for _ in range(iterations):
        both = _ends(cells, p, names)
        phase = sum(((F.col(f"q_{c}") - F.col(f"p_{c}")) * x[i] for i, c in enumerate(names)), F.lit(0.0))
        r = (cx("z_re", "z_im") * polar(phase)).im
        sums = [F.sum(r * x[i]).alias(f"b{i}") for i in range(n)] + [F.sum(F.col("v") * x[i] * x[j]).alias(f"a{i}{j}") for i in range(n) for j in range(i, n)]
        new = both.groupBy(*KEY, F.col("ant1").alias("ant")).agg(*sums).join(p, [*KEY, "ant"])
        step = _solved([[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(n)] for i in range(n)], [F.col(f"b{i}") for i in range(n)])
        p = written(new.select(*KEY, "ant", *[(F.col(c) + 0.5 * step[i]).alias(c) for i, c in enumerate(names)]), "slopes")
    ref = p.where(F.col("ant") == reference).select(*KEY, *[F.col(c).alias(f"_{c}") for c in names])
    p = p.join(ref, list(KEY), "left")
    own = [F.col(c) - F.coalesce(f"_{c}", F.lit(0.0)) for c in names]
    own[0] = F.atan2(F.sin(own[0]), F.cos(own[0]))
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("param"), v.alias("value")) for i, v in enumerate(own)])).alias("x")
    return p.select(*KEY, "ant", rows).select(*KEY, "ant", "x.*")


# ---------------------------------------------------------------- a loop that stops by itself


def solve_until(sums: DataFrame, epsilon: float, delta: float, most: int, quorum: float = 1.0, every: int = 2) -> DataFrame:
    """(ti, fi, ant, g_re, g_im, rounds, state) of complex gains, each interval iterated until it is done: converged, where its gains change by a share of epsilon or less, or stalled, where
    chi-squared, looked at in every so many rounds, falls by a share of delta or less. Intervals that are done leave the table; the rest go on, until a quorum of all is done or after most rounds.
    sums also have dd = sum w |d|^2. Only counts of intervals reach the driver."""
    total = sums.select(*KEY).distinct().count()
    g = sums.select(*KEY, F.col("ant1").alias("ant")).distinct().withColumns({"g_re": F.lit(1.0), "g_im": F.lit(0.0), "chi2": F.lit(None).cast("double")})
    done, finished = [], 0
    for k in range(1, most + 1):
        x = sums.join(g.select(*KEY, F.col("ant").alias("ant2"), "g_re", "g_im"), [*KEY, "ant2"])
        r, h = cx("z_re", "z_im") * cx("g_re", "g_im"), F.col("v") * cx("g_re", "g_im").abs2()
        new = x.groupBy(*KEY, F.col("ant1").alias("ant")).agg(F.sum(r.re).alias("r_re"), F.sum(r.im).alias("r_im"), F.sum(h).alias("h"))
        half = 0.5 if k % 2 == 0 else 0.0
        at = lambda c: (F.coalesce(F.col(f"r_{c}") / F.when(F.col("h") > 0, F.col("h")), F.lit(0.0)) * (1 - half) + F.col(f"g_{c}") * half).alias(f"n_{c}")
        new = new.join(g, [*KEY, "ant"]).select(*KEY, "ant", "g_re", "g_im", "chi2", at("re"), at("im"))
        moved = new.groupBy(*KEY).agg((F.sum((cx("n_re", "n_im") - cx("g_re", "g_im")).abs2()) / F.sum(cx("n_re", "n_im").abs2())).alias("change"))
        new = new.select(*KEY, "ant", F.col("n_re").alias("g_re"), F.col("n_im").alias("g_im"), "chi2")
        state = F.when(F.col("change") <= epsilon * epsilon, "converged")
        if k % every == 0:
            ends = _ends(sums, new, ["g_re", "g_im"])
            gain = cx("p_g_re", "p_g_im") * cx("q_g_re", "q_g_im").conj()
            fit = (cx("z_re", "z_im") * gain.conj()).re
            moved = moved.join(ends.groupBy(*KEY).agg(F.sum(F.col("dd") - 2 * fit + gain.abs2() * F.col("v")).alias("_chi2")), list(KEY))
            state = state.when(F.col("chi2") - F.col("_chi2") <= delta * F.col("chi2"), "stalled")
        else:
            moved = moved.withColumn("_chi2", F.lit(None).cast("double"))
        new = new.join(moved, list(KEY)).select(*KEY, "ant", "g_re", "g_im", F.coalesce("_chi2", "chi2").alias("chi2"), F.coalesce(state, F.lit("running")).alias("state"))
        new = written(new, "round")
        done.append(new.where("state <> 'running'").withColumn("rounds", F.lit(k)))
        finished += new.where("state <> 'running'").select(*KEY).distinct().count()
        g = new.where("state = 'running'").drop("state")
        if finished >= quorum * total:
            break
    out = g.withColumns({"state": F.lit("running"), "rounds": F.lit(k)}) if total else g.withColumns({"state": F.lit(""), "rounds": F.lit(0)})
    for d in done:
        out = out.unionByName(d)
    return out.select(*KEY, "ant", "g_re", "g_im", F.col("rounds").cast("bigint").alias("rounds"), "state")


# ---------------------------------------------------------------- leakages and a phase between the hands


def _offsets(g: DataFrame) -> DataFrame:
    """pzd by interval: the phase of the sum over antennas of the first diagonal element over the second."""
    at = lambda i, c: F.max(F.when((F.col("i") == i) & (F.col("j") == i), F.col(f"g_{c}")))
    d = g.groupBy(*KEY, "ant").agg(*[at(i, c).alias(f"d{i}_{c}") for i in (0, 1) for c in ("re", "im")])
    r = cx("d0_re", "d0_im") * cx("d1_re", "d1_im").conj()
    size = F.when(cx("d1_re", "d1_im").abs2() > 0, cx("d1_re", "d1_im").abs2())
    return d.groupBy(*KEY).agg(F.coalesce(F.atan2(F.sum(r.im / size), F.sum(r.re / size)), F.lit(0.0)).alias("pzd"))


def _restricted(g: DataFrame, offsets: DataFrame) -> DataFrame:
    """Gains whose diagonal is 1 and exp(-i pzd), the same for all antennas of an interval."""
    own = {"re": F.when(F.col("i") == 0, 1.0).otherwise(F.cos("pzd")), "im": F.when(F.col("i") == 0, 0.0).otherwise(-F.sin("pzd"))}
    diagonal_ = F.col("i") == F.col("j")
    return g.join(offsets, list(KEY)).select(*KEY, "ant", "n", "i", "j", *[F.when(diagonal_, x).otherwise(F.col(f"g_{c}")).alias(f"g_{c}") for c, x in own.items()])


def polarised(samples: DataFrame, offsets: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """2 x 2 gains (ti, fi, ant, i, j, g_re, g_im) of free leakages and one phase between the hands for all antennas of an interval, and that phase (ti, fi, pzd), in turns: a step of all elements,
    then the phase from its diagonals, which become 1 and exp(-i pzd). offsets: the phase to start from, of the cross hands. Even rounds take the mean with the gains before, and its phase. The
    alternation asks for leakages and cross hands that are small beside the diagonal; else it may leave the solution."""
    dm, mm = element_sums(samples)
    g = written(_restricted(unit_elements(samples), offsets), "polarised")
    for n in range(1, rounds + 1):
        new = full_update(dm, mm, g, 1)
        offsets = _offsets(new)
        new = _restricted(new, offsets)
        if n % 2 == 0:
            old = g.select(*KEY, "ant", "i", "j", F.col("g_re").alias("o_re"), F.col("g_im").alias("o_im"))
            new = written(new.join(old, [*KEY, "ant", "i", "j"]).select(*KEY, "ant", "n", "i", "j", *[((F.col(f"g_{c}") + F.col(f"o_{c}")) / 2).alias(f"g_{c}") for c in ("re", "im")]), "means")
            offsets = _offsets(new)
            new = _restricted(new, offsets)
        g = written(new, "polarised")
    return g.drop("n"), written(offsets, "offsets")


# ---------------------------------------------------------------- robust fits

#: Degrees of freedom that are tried.
FREEDOMS = (2, 100)


def digamma(x: Column) -> Column:
    """For x > 0: six steps up, then the asymptotic series, whose error there is below 1e-8."""
    up = x + 6
    y = 1 / (up * up)
    return F.log(up) - 0.5 / up - y * (1 / F.lit(12.0) - y * (1 / F.lit(120.0) - y / 252)) - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


ELEMENTS = [f"g{i}{j}_{c}" for i in (0, 1) for j in (0, 1) for c in ("re", "im")]


def _wide(g: DataFrame) -> DataFrame:
    """2 x 2 gains with their elements as columns, a row an antenna and interval."""
    return g.groupBy(*KEY, "ant").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(f"g_{c}"))).alias(f"g{i}{j}_{c}") for i in (0, 1) for j in (0, 1) for c in ("re", "im")])


def _gain(end: str) -> Mat:
    return tuple(tuple(cx(f"{end}_g{i}{j}_re", f"{end}_g{i}{j}_im") for j in (0, 1)) for i in (0, 1))


def _cells(column: str) -> Mat:
    """An array of four (re, im) structs as a matrix."""
    return tuple(tuple(cx(F.col(column)[2 * i + j]["re"], F.col(column)[2 * i + j]["im"]) for j in (0, 1)) for i in (0, 1))


def _array(m: Mat) -> Column:
    return F.array(*[F.struct(x.re.alias("re"), x.im.alias("im")) for row in m for x in row])


def student_weights(samples: DataFrame, g: DataFrame, freedoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples (ti, fi, ant1, ant2, d, m, ...) with u: weights of a Student-t distribution of the residuals under 2 x 2 gains, of mean 1 in each interval, where v (of freedoms: ti, fi, v) are its
    degrees of freedom and the variances of the four elements are those of the interval; and the freedoms that fit these weights best, with var, the mean variance of the two diagonal elements."""
    x = _ends(samples, _wide(g), ELEMENTS)
    made, data = sandwich(_gain("p"), _cells("m"), _gain("q")), _cells("d")
    x = x.withColumns({f"_r{k}": (data[k // 2][k % 2] - made[k // 2][k % 2]).abs2() for k in range(4)}).drop(*[f"{end}_{n}" for end in "pq" for n in ELEMENTS])
    x = written(x, "residuals")
    by = x.groupBy(*KEY).agg(*[F.greatest(F.avg(f"_r{k}"), F.lit(1e-12)).alias(f"_c{k}") for k in range(4)]).join(freedoms.select(*KEY, "v"), list(KEY))
    x = x.join(by, list(KEY))
    x = x.withColumn("u", (F.col("v") + 4) / (F.col("v") + sum((F.col(f"_r{k}") / F.col(f"_c{k}") for k in range(1, 4)), F.col("_r0") / F.col("_c0"))))
    mean = x.groupBy(*KEY, "v").agg(F.avg("u").alias("_u"), F.avg(F.log("u") - F.col("u")).alias("_l"), F.max((F.col("_c0") + F.col("_c3")) / 2).alias("var"))
    k, half = F.col("k").cast("double"), (F.col("v") + 4) / 2
    cost = F.abs(F.log(k / 2) - digamma(k / 2) + F.col("_l") + 1 + digamma(half) - F.log(half))
    tried = mean.withColumn("k", F.explode(F.sequence(*map(F.lit, FREEDOMS))))
    # rounded, so that freedoms that are as good as each other don't hang on the order of sums
    best = tried.groupBy(*KEY).agg(F.min_by(k, F.struct(F.round(cost, 9), k)).alias("v"), F.max("var").alias("var"))
    out = x.join(mean.select(*KEY, "_u"), list(KEY)).withColumn("u", F.col("u") / F.col("_u"))
    return out.drop("v", "_u", *[f"_{c}{k}" for c in "rc" for k in range(4)]), written(best, "freedoms")


def robust(samples: DataFrame, rounds: int, kind: str = "full", start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """2 x 2 gains (ti, fi, ant, i, j, g_re, g_im) of a kind and freedoms (ti, fi, v): in each round samples (from both ends, as for element_sums) get weights by their residuals, element sums are
    formed with these, and gains take one step. A round reads the samples once and leaves rows of baselines."""
    g = started(samples, start)
    freedoms = samples.select(*KEY).distinct().withColumn("v", F.lit(float(FREEDOMS[0])))
    for n in range(1, rounds + 1):
        weighted, freedoms = student_weights(samples, g, freedoms)
        g = full_update(*element_sums(weighted.withColumn("w", F.col("w") * F.col("u"))), g, n, kind)
    return g.drop("n"), freedoms.select(*KEY, "v")


# Fixed values of the rule for weights that are too low: a factor, the correlations that count, the freedoms to start from, and the variance below which an interval isn't flagged.
LOW_FACTOR, LOW_CORRELATIONS, LOW_START, LOW_VARIANCE = 1.26, 2, 5.0, 2e-2


def with_low_weights(weighted: DataFrame, freedoms: DataFrame, sigma: float) -> DataFrame:
    """weighted (samples with u) with low: whether the weight lies under what the interval's freedoms v (and sigma) ask for, factor / v (v + correlations) / (v + sigma)."""
    v = F.col("_v")
    limit = LOW_FACTOR / v * (v + LOW_CORRELATIONS) / (v + sigma)
    return weighted.join(freedoms.select(*KEY, F.col("v").alias("_v")), list(KEY)).withColumn("low", F.col("u") < limit).drop("_v")


def robust_flagged(samples: DataFrame, rounds: int, sigma: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gains and freedoms of a robust fit without the samples whose weights are too low, and the samples with wflag: 1 those flagged before the fit, by residuals under unit gains (not in intervals
    of low variance), 2 those flagged by the weights that the fit came to, else 0. A fit with all samples of an interval flagged has no rows for it."""
    start = samples.select(*KEY).distinct().withColumn("v", F.lit(LOW_START))
    first, v = student_weights(samples, unit_elements(samples), start)
    quiet = v.select(*KEY, (F.col("var") < LOW_VARIANCE).alias("_quiet"))
    first = written(with_low_weights(first, v, sigma).join(quiet, list(KEY)).withColumn("low", F.col("low") & ~F.col("_quiet")).drop("_quiet", "u"), "flagged")
    kept = first.where("not low").drop("low")
    g, v = robust(kept, rounds)
    after, _ = student_weights(kept, g, v)
    after = with_low_weights(after, v, sigma).withColumn("wflag", F.when(F.col("low"), 2).otherwise(0)).drop("u", "low")
    return g, v, after.unionByName(first.where("low").drop("low").withColumn("wflag", F.lit(1)))


# ---------------------------------------------------------------- chains of 2 x 2 terms


@dataclass(frozen=True)
class MatrixTerm(Term):
    """A term of 2 x 2 gains: its kind, and whether its fit is robust."""

    kind: str = "full"
    robust: bool = False


def folded_samples(samples: DataFrame, terms: list[MatrixTerm], gains: list[DataFrame | None], k: int) -> DataFrame:
    """Samples (ti and fi of the finest intervals, d, m, ...) as term k sees them, in its own intervals: terms to the right go into the model, from the last on, those to the left are taken off the data, from
    the first on. Samples go where a gain to be taken off is singular."""
    right, left = range(len(terms) - 1, k, -1), range(k)
    for j in [*right, *left]:
        if gains[j] is None:
            continue
        own = _wide(gains[j])
        if j < k:  # inverted once an antenna, not once a sample
            plain = tuple(tuple(cx(f"g{a}{b}_re", f"g{a}{b}_im") for b in (0, 1)) for a in (0, 1))
            inverse, bad = mat_inverse(plain, 1e-12)
            own = own.where(~bad).select(*KEY, "ant", *[c.alias(f"g{a}{b}_{part}") for a in (0, 1) for b in (0, 1) for part, c in (("re", inverse[a][b].re), ("im", inverse[a][b].im))])
        own = own.withColumnsRenamed({"ti": "_ti", "fi": "_fi"})
        x = samples.withColumns({"_ti": terms[j].key("ti"), "_fi": terms[j].key("fi")})
        for end, ant in (("q", "ant2"), ("p", "ant1")):
            x = x.join(own.select("_ti", "_fi", F.col("ant").alias(ant), *[F.col(c).alias(f"{end}_{c}") for c in ELEMENTS]), ["_ti", "_fi", ant])
        side = "m" if j > k else "d"
        x = x.withColumn(side, _array(sandwich(_gain("p"), _cells(side), _gain("q"))))
        samples = x.select(*samples.columns)
    return samples.withColumns({n: terms[k].key(n) for n in KEY})


def matrix_chain(samples: DataFrame, terms: list[MatrixTerm], recipe: list[int]) -> DataFrame:
    """(term, ti, fi, ant, i, j, g_re, g_im) of the terms of a product of 2 x 2 gains; samples from both ends with d, m, w and ti, fi of the finest intervals. recipe: rounds, dealt to the terms in
    turn; a robust turn starts from the gains of the term's last one and from the fewest freedoms. A turn reads the samples once and writes them as its term sees them; all rounds then run on rows of
    baselines, but for robust ones, which read these samples once each."""
    gains: list[DataFrame | None] = [None] * len(terms)
    for turn, count in enumerate(recipe):
        k = turn % len(terms)
        seen = written(folded_samples(samples, terms, gains, k), "folded")
        if terms[k].robust:
            gains[k] = robust(seen, count, terms[k].kind, gains[k])[0]
        else:
            gains[k] = last(full(*element_sums(seen), count, terms[k].kind, gains[k]), count, "n")
    out = None
    for k, g in enumerate(gains):
        if g is not None:
            rows = g.select(F.lit(k).cast("bigint").alias("term"), *KEY, "ant", "i", "j", "g_re", "g_im")
            out = rows if out is None else out.unionByName(rows)
    return out
