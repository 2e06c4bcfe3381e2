"""Fits of several directions, chains, slopes and the loop that stops by itself, in closed loops: data made of known gains."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_solvers import observed

from fringeworks.functions.cx import cx
from fringeworks.operators import chains, gains, gauss_newton, rebin
from fringeworks.operators.chains import MatrixTerm, Term

ANTS, SLOTS, CHANS, DIRS = 7, 12, 6, 3
SCHEMA = "t bigint, chan bigint, ant1 bigint, ant2 bigint, re double, im double, w double, " + ", ".join(f"m{d}_re double, m{d}_im double" for d in range(DIRS))


def decibels(error):
    """Within -30 dB in the median and -25 dB for 95 in 100."""
    return 10 * np.log10(np.median(error) + 1e-12) <= -30 and 10 * np.log10(np.percentile(error, 95) + 1e-12) <= -25


def test_directions(spark):
    """Three directions with gains of their own are told apart, what two of them make is taken off, and the rest is corrected."""
    rng = np.random.default_rng(3)
    true = 1 + 0.15 * (rng.normal(size=(ANTS, DIRS)) + 1j * rng.normal(size=(ANTS, DIRS)))
    rows = []
    for t in range(SLOTS):
        for f in range(CHANS):
            for p in range(ANTS):
                for q in range(p + 1, ANTS):
                    m = np.exp(1j * rng.uniform(0, 2 * np.pi, DIRS)) * (1, 0.6, 0.4)
                    d = (true[p] * m * true[q].conj()).sum()
                    rows.append((t, f, p, q, float(d.real), float(d.imag), 1.0, *[float(x) for v in m for x in (v.real, v.imag)]))
                    rows.append((t, f, q, p, float(d.real), -float(d.imag), 1.0, *[float(x) for v in m for x in (v.real, -v.imag)]))
    both = gauss_newton.intervals(spark.createDataFrame(rows, SCHEMA), 0, 0).repartition(4).cache()
    models = [cx(f"m{d}_re", f"m{d}_im") for d in range(DIRS)]
    g = gauss_newton.last(chains.directions(chains.direction_sums(both, models), DIRS, 25), 25).cache()
    got = np.zeros((ANTS, DIRS), complex)
    for r in g.collect():
        got[r.ant, r.dir] = complex(r.g_re, r.g_im)
    turned = got * np.exp(-1j * (np.angle(got[0]) - np.angle(true[0])))
    assert decibels((np.abs(turned - true) / np.abs(true)).ravel())
    left = chains.peeled(both.where("ant1 < ant2"), models, g, (1, 2), 0).select("r_re", "r_im", "m0_re", "m0_im").collect()
    assert decibels(np.array([abs(complex(r.r_re, r.r_im) - complex(r.m0_re, r.m0_im)) for r in left]))
    nothing = chains.peeled(both.where("ant1 < ant2"), models, g, (0, 1, 2)).select(F.max(cx("r_re", "r_im").abs())).first()[0]
    assert nothing < 0.1
    assert chains.peeled(both.where("ant1 < ant2"), models, g, ()).where("r_re <> re or r_im <> im").count() == 0


def test_chain(spark):
    """Gains by time times a bandpass: their product on every baseline is found, whichever term takes a common factor."""
    rng = np.random.default_rng(4)
    g = 1 + 0.2 * (rng.normal(size=(3, ANTS)) + 1j * rng.normal(size=(3, ANTS)))
    b = 1 + 0.2 * (rng.normal(size=(CHANS, ANTS)) + 1j * rng.normal(size=(CHANS, ANTS)))
    rows = []
    for t in range(SLOTS):
        for f in range(CHANS):
            for p in range(ANTS):
                for q in range(p + 1, ANTS):
                    m = complex(*rng.normal(1, 0.2, 2))
                    d = g[t // 4, p] * b[f, p] * m * np.conj(b[f, q] * g[t // 4, q])
                    rows.append((t, f, p, q, float(d.real), float(d.imag), float(m.real), float(m.imag), 1.0))
    vis = spark.createDataFrame(rows, "t bigint, chan bigint, ant1 bigint, ant2 bigint, re double, im double, mre double, mim double, w double")
    sums = gauss_newton.normal_sums(gauss_newton.intervals(rebin.hermitian(vis), 1, 1))
    out = {(r.term, r.ti, r.fi, r.ant): complex(r.g_re, r.g_im) for r in chains.chain(sums, [Term(4, 0), Term(0, 1)], [6, 6, 6, 6, 6, 6]).collect()}
    assert {k[:3] for k in out} == {(0, t, 0) for t in range(3)} | {(1, 0, f) for f in range(CHANS)}
    error = [
        abs(out[0, t, 0, p] * out[1, 0, f, p] * np.conj(out[0, t, 0, q] * out[1, 0, f, q]) / (g[t, p] * b[f, p] * np.conj(g[t, q] * b[f, q])) - 1)
        for t in range(3) for f in range(CHANS) for p in range(ANTS) for q in range(p)
    ]
    assert decibels(error)


@pytest.mark.parametrize("axes", [("chan",), ("t",), ("t", "chan")])
def test_slopes(spark, axes):
    """A phase and slopes over the axes, in an interval that also has an axis with one place."""
    rng = np.random.default_rng(5)
    true = rng.uniform(-1, 1, (ANTS, 1 + len(axes)))
    true[0] = 0
    rows = []
    for ti in (0, 1):
        for t in range(SLOTS if ti == 0 else 1):
            for f in range(CHANS if ti == 0 else 1):
                x = [1.0] + [({"t": t / (SLOTS - 1), "chan": f / (CHANS - 1)}[a] if ti == 0 else 0.0) for a in axes]
                for p in range(ANTS):
                    for q in range(ANTS):
                        if p != q:
                            z = np.exp(1j * (true[p] - true[q]) @ x)
                            rows.append((ti, 0, t, f, p, q, float(z.real), float(z.imag), 1.0))
    cells = spark.createDataFrame(rows, "ti bigint, fi bigint, t bigint, chan bigint, ant1 bigint, ant2 bigint, z_re double, z_im double, v double")
    for i, a in enumerate(axes, 1):
        cells = chains.scaled_axis(cells, a, f"x{i}")
    got = {(r.ti, r.ant, r.param): r.value for r in chains.slopes(cells, [f"x{i}" for i in range(1, len(axes) + 1)], 16).collect()}
    for a in range(ANTS):
        for k in range(1 + len(axes)):
            assert abs(got[0, a, k] - true[a, k]) < 1e-2
        assert abs(got[1, a, 0] - true[a, 0]) < 1e-2 and got[1, a, 1] == 0


def test_active_intervals(spark):
    """Intervals leave as they converge; those that stay have gone on, and all have the gains of a long fixed run."""
    true = {p: (1 + 0.08 * p) * np.exp(0.2j * p) for p in range(ANTS)}
    quiet = observed(spark, true.get)
    # an interval of unit gains is done at once
    unit = observed(spark, lambda p: 1.0).withColumn("t", F.col("t") + 100)
    samples = gauss_newton.intervals(rebin.hermitian(quiet.unionByName(unit)), 50, 0).cache()
    power = samples.groupBy("ti", "fi", "ant1", "ant2").agg(F.sum(F.col("w") * cx("re", "im").abs2()).alias("dd"))
    sums = gauss_newton.normal_sums(samples).join(power, ["ti", "fi", "ant1", "ant2"]).cache()
    got = chains.solve_until(sums, 1e-5, -1.0, 40).collect()
    rounds = {(r.ti, r.state): r.rounds for r in got}
    assert set(rounds) == {(0, "converged"), (2, "converged")} and rounds[2, "converged"] == 1 < rounds[0, "converged"] < 40
    fixed = {(r.ti, r.ant): complex(r.g_re, r.g_im) for r in gauss_newton.last(gauss_newton.diagonal(sums, 24), 24).collect()}
    turned = lambda g, t: g[t, 0].conjugate() / abs(g[t, 0])
    own = {(r.ti, r.ant): complex(r.g_re, r.g_im) for r in got}
    assert len(own) == len(fixed) and all(abs(own[k] * turned(own, k[0]) - fixed[k] * turned(fixed, k[0])) < 1e-3 for k in fixed)
    # a quorum of one half ends the loop with the first interval; noise that can't be fitted stalls
    assert {(r.ti, r.state) for r in chains.solve_until(sums, 1e-5, -1.0, 40, quorum=0.5).collect()} == {(2, "converged"), (0, "running")}
    noisy = gauss_newton.intervals(rebin.hermitian(observed(spark, true.get, 0.5)), 0, 0)
    noisy = gauss_newton.normal_sums(noisy).join(noisy.groupBy("ti", "fi", "ant1", "ant2").agg(F.sum(cx("re", "im").abs2()).alias("dd")), ["ti", "fi", "ant1", "ant2"])
    assert {r.state for r in chains.solve_until(noisy, 1e-9, 0.01, 20).collect()} == {"stalled"}
    assert chains.solve_until(sums.limit(0), 1e-5, 0.01, 3).count() == 0


def test_digamma(spark):
    known = {0.5: -1.9635100260214235, 1.0: -0.5772156649015329, 3.0: 0.9227843350984671, 52.0: sum(1 / i for i in range(1, 52)) - 0.5772156649015329}
    for x, y in known.items():
        assert abs(spark.range(1).select(chains.digamma(F.lit(x))).first()[0] - y) < 1e-8


def test_robust(spark):
    """Outliers lose weight: gains are far nearer to the true ones than those of a plain fit, and the freedoms are few where there are outliers and many where there are none."""
    rng = np.random.default_rng(6)
    true = [np.eye(2) + 0.1 * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))) for _ in range(ANTS)]
    cell = lambda x: [(float(v.real), float(v.imag)) for v in x.reshape(-1)]
    noise = lambda s: s * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)))
    rows, made, bad = [], [], set()
    for ti in (0, 1):
        for s in range(25):
            for p in range(ANTS):
                for q in range(p + 1, ANTS):
                    m = np.eye(2) + noise(0.3)
                    d = true[p] @ m @ true[q].conj().T
                    made.append((p, q, m, d))
                    wild = ti == 0 and rng.random() < 0.06
                    if wild:
                        bad.add((s, p, q))
                    d = d + noise(3.0 if wild else 0.01)
                    rows += [(ti, 0, s, p, q, cell(d), cell(m), 1.0), (ti, 0, s, q, p, cell(d.conj().T), cell(m.conj().T), 1.0)]
    samples = spark.createDataFrame(rows, "ti bigint, fi bigint, s bigint, ant1 bigint, ant2 bigint, d array<struct<re:double,im:double>>, m array<struct<re:double,im:double>>, w double").repartition(4).cache()

    def misfit(g, ti):
        got = {p: np.zeros((2, 2), complex) for p in range(ANTS)}
        for r in g:
            if r.ti == ti:
                got[r.ant][r.i, r.j] = complex(r.g_re, r.g_im)
        return np.median([np.abs(got[p] @ m @ got[q].conj().T - d).max() for p, q, m, d in made])

    g, v = chains.robust(samples, 8)
    plain = gauss_newton.last(gauss_newton.full(*gauss_newton.element_sums(samples), 8), 8, "n").collect()
    robust, free = g.collect(), {r.ti: r.v for r in v.collect()}
    assert misfit(robust, 0) < 0.3 * misfit(plain, 0) and misfit(robust, 1) < 1.5 * misfit(plain, 1) + 1e-3
    assert free[0] <= 4 < free[1]
    weighted = chains.student_weights(samples, g, v)[0].where("ti = 0 and ant1 < ant2").select("s", "ant1", "ant2", "u").collect()
    wild = [r.u for r in weighted if (r.s, r.ant1, r.ant2) in bad]
    assert max(wild) < 0.1 and abs(np.mean([r.u for r in weighted]) - 1) < 0.05


def test_leakages_and_an_offset(spark):
    """An injected phase between the hands and leakages are found, from a start at the cross hands' phase, and the diagonals are those of the offset."""
    rng = np.random.default_rng(8)
    offset = 0.7
    true = [np.array([[1, 0.01 * complex(*rng.normal(size=2))], [0.01 * complex(*rng.normal(size=2)), np.exp(-1j * offset)]]) for _ in range(ANTS)]
    cell = lambda x: [(float(v.real), float(v.imag)) for v in x.reshape(-1)]
    rows = []
    for s in range(20):
        for p in range(ANTS):
            for q in range(p + 1, ANTS):
                m = np.array([[1, 0.3], [0.3, 1]]) + 0.1 * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)))
                d = true[p] @ m @ true[q].conj().T
                rows += [(0, 0, p, q, cell(d), cell(m), 1.0), (0, 0, q, p, cell(d.conj().T), cell(m.conj().T), 1.0)]
    samples = spark.createDataFrame(rows, "ti bigint, fi bigint, ant1 bigint, ant2 bigint, d array<struct<re:double,im:double>>, m array<struct<re:double,im:double>>, w double").cache()
    far = chains.polarised(samples, spark.createDataFrame([(0, 0, 0.5)], "ti bigint, fi bigint, pzd double"), 4)[1].first()["pzd"]
    assert 0.5 < far < offset
    cross = samples.select("ti", "fi", F.explode(F.array(*[F.struct(F.lit(k).alias("corr"), F.col("d")[k]["re"].alias("re"), F.col("d")[k]["im"].alias("im"), F.col("m")[k]["re"].alias("mre"), F.col("m")[k]["im"].alias("mim")) for k in (1, 2)])).alias("x")).select("ti", "fi", "x.*")
    start = gains.hand_phase(cross, ["ti", "fi"])
    assert abs(start.first()["pzd"] - offset) < 0.1
    g, z = chains.polarised(samples, start, 6)
    assert abs(z.first()["pzd"] - offset) < 0.05
    for r in g.collect():
        if r.i == r.j:
            assert abs(complex(r.g_re, r.g_im) - (1 if r.i == 0 else np.exp(-1j * z.first()["pzd"]))) < 1e-12
        else:
            assert abs(complex(r.g_re, r.g_im) - true[r.ant][r.i, r.j]) < 5e-2


# ---------------------------------------------------------------- 2 x 2 gains of a kind

MATRICES = "ti bigint, fi bigint, s bigint, ant1 bigint, ant2 bigint, d array<struct<re:double,im:double>>, m array<struct<re:double,im:double>>, w double"


def both_ends(ti, fi, s, p, q, d, m):
    cell = lambda x: [(float(v.real), float(v.imag)) for v in x.reshape(-1)]
    return [(ti, fi, s, p, q, cell(d), cell(m), 1.0), (ti, fi, s, q, p, cell(d.conj().T), cell(m.conj().T), 1.0)]


def a_model(rng):
    return np.eye(2) + 0.3 * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)))


def a_gain(rng, kind):
    size, phase, off = rng.uniform(0.8, 1.2, 2), np.exp(1j * rng.normal(0, 0.3, 2)), 0.1 * (rng.normal(size=2) + 1j * rng.normal(size=2))
    diagonal = {"phase": phase, "amp": size, "scalar": size[:1] * phase[:1] * np.ones(2), "leakage": np.ones(2)}.get(kind, size * phase)
    g = np.diag(diagonal).astype(complex)
    if kind in ("full", "leakage"):
        g[0, 1], g[1, 0] = off
    return g


def matrices(rows, *key):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in key), np.zeros((2, 2), complex))[r.i, r.j] = complex(r.g_re, r.g_im)
    return out


def a_step(d, m, g, kind):
    """A round of one interval, antenna by antenna, of (p, q, data, model) from both ends."""
    out = {}
    for a in range(ANTS):
        y = [(x, g[q] @ v.conj().T) for (p, q), x, v in zip(d, d.values(), m.values(), strict=True) if p == a]
        r, h = sum(x @ v for x, v in y), sum(v.conj().T @ v for _, v in y)
        if abs(np.linalg.det(h)) == 0:
            out[a] = g[a]
            continue
        hands = np.diag(r) / np.diag(h).real
        whole = r @ np.linalg.inv(h)
        leak = whole.copy()
        leak[[0, 1], [0, 1]] = 1
        out[a] = {"full": whole, "diag": np.diag(hands), "phase": np.diag(hands / abs(hands)), "amp": np.diag(abs(hands)), "scalar": np.eye(2) * np.trace(r) / np.trace(h).real, "leakage": leak}[kind]
    return out


@pytest.mark.parametrize("kind", gauss_newton.KINDS)
def test_kinds(spark, kind):
    """A round of each kind against one antenna by antenna, from gains of before; an antenna whose model is zero keeps them."""
    rng = np.random.default_rng(9)
    true, before = ([a_gain(rng, k) for _ in range(ANTS)] for k in (kind, kind))
    rows, data, model = [], {}, {}
    for p in range(ANTS):
        for q in range(p + 1, ANTS):
            m = a_model(rng) * (q < ANTS - 1)
            d = true[p] @ m @ true[q].conj().T
            rows += both_ends(0, 0, 0, p, q, d, m)
            data |= {(p, q): d, (q, p): d.conj().T}
            model |= {(p, q): m, (q, p): m.conj().T}
    start = spark.createDataFrame([(0, 0, a, i, j, float(g[i, j].real), float(g[i, j].imag)) for a, g in enumerate(before) for i in (0, 1) for j in (0, 1)], "ti bigint, fi bigint, ant bigint, i int, j int, g_re double, g_im double")
    g = gauss_newton.full(*gauss_newton.element_sums(spark.createDataFrame(rows, MATRICES)), 1, kind, start)
    got, want = matrices(gauss_newton.last(g, 1, "n").collect(), "ant"), a_step(data, model, before, kind)
    for a in range(ANTS):
        assert np.allclose(got[a,], want[a]), (a, got[a,], want[a])
    assert np.allclose(got[ANTS - 1,], before[ANTS - 1])


def test_other_kinds(spark):
    with pytest.raises(ValueError, match="kinds"):
        gauss_newton.full_update(None, None, None, 1, "other")
    with pytest.raises(ValueError, match="slopes"):
        chains.slope_sums(None, "other")


def test_matrix_chain(spark):
    """Gains by slot times full ones of the whole: what they make comes nearer the data with each turn than one term can, and no samples give no gains."""
    rng = np.random.default_rng(10)
    left, right = [[a_gain(rng, "diag") for _ in range(ANTS)] for _ in range(3)], [a_gain(rng, "full") for _ in range(ANTS)]
    rows, made = [], []
    for t in range(3):
        for s in range(12):
            for p in range(ANTS):
                for q in range(p + 1, ANTS):
                    m = a_model(rng)
                    d = left[t][p] @ right[p] @ m @ (left[t][q] @ right[q]).conj().T
                    made.append((t, p, q, m, d))
                    rows += both_ends(t, s, s, p, q, d, m)
    samples = spark.createDataFrame(rows, MATRICES).repartition(2)
    terms = [MatrixTerm(1, 0, "diag"), MatrixTerm(0, 0)]
    out = matrices(chains.matrix_chain(samples, terms, [3, 3, 3]).collect(), "term", "ti", "fi", "ant")
    assert {k[:3] for k in out} == {(0, t, 0) for t in range(3)} | {(1, 0, 0)}
    g = lambda t, a: out[0, t, 0, a] @ out[1, 0, 0, a]
    error = np.median([np.abs(g(t, p) @ m @ g(t, q).conj().T - d).max() for t, p, q, m, d in made])
    alone = np.median([np.abs(out[0, t, 0, p] @ m @ out[0, t, 0, q].conj().T - d).max() for t, p, q, m, d in made])
    assert error < 0.02 and error < alone / 3
    assert chains.matrix_chain(samples.limit(0), [MatrixTerm(1, 0, "diag", True)], [1]).count() == 0


def test_low_weights(spark):
    """Planted outliers are flagged before the fit, in the interval that has them and none beside them, from both ends; a quiet interval is left alone."""
    rng = np.random.default_rng(11)
    true, bad, rows = [a_gain(rng, "full") for _ in range(ANTS)], set(), []
    for ti in (0, 1):
        for s in range(25):
            for p in range(ANTS):
                for q in range(p + 1, ANTS):
                    m = a_model(rng)
                    d = true[p] @ m @ true[q].conj().T if ti == 0 else m
                    wild = ti == 0 and rng.random() < 0.03
                    if wild:
                        bad.add((s, p, q))
                    rows += both_ends(ti, 0, s, p, q, d + (20.0 if wild else 0.01) * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))), m)
    samples = spark.createDataFrame(rows, MATRICES).repartition(2)
    _, v, flags = chains.robust_flagged(samples, 1)
    assert set(flags.columns) == {*samples.columns, "wflag"}
    flags = flags.collect()
    assert len(flags) == len(rows) and v.count() == 2
    first = {(r.s, r.ant1, r.ant2) for r in flags if r.wflag == 1 and r.ant1 < r.ant2}
    assert first <= bad and len(first) >= 0.8 * len(bad)
    assert {(r.s, r.ant2, r.ant1) for r in flags if r.wflag == 1 and r.ant1 > r.ant2} == first and not any(r.wflag == 1 and r.ti == 1 for r in flags)


def test_slope_axes(spark):
    """Sums by place with the axes of a kind scaled within each interval."""
    rows = [(ti, 0, t, f, 0, 1, 1.0, 2.0, 0.5, 0.0, 2.0) for ti in (0, 1) for t in (3, 5) for f in range(3)]
    both = spark.createDataFrame(rows, "ti bigint, fi bigint, t bigint, chan bigint, ant1 bigint, ant2 bigint, re double, im double, mre double, mim double, w double")
    for kind, places in {"if-slope": [(1.0,), (0.25,), (0.0,)], "fif-slope": [(0.0, 1.0), (0.5, 0.25), (1.0, 0.0)], "tf-plane": [(t, f) for t in (0.0, 1.0) for f in (0.0, 0.5, 1.0)]}.items():
        sums, axes = chains.slope_sums(both, kind)
        n = 6 / len(places)
        got = {(r.ti, *[round(r[a], 9) for a in axes]): (r.z_re, r.z_im, r.v) for r in sums.collect()}
        assert got == {(ti, *p): (n * 1.0, n * 2.0, n * 0.5) for ti in (0, 1) for p in places}
