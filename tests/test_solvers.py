"""Gains fitted by joins and sums, in closed loops: data made of known gains."""

import numpy as np
import pytest

from fringeworks.operators import gauss_newton, rebin

ANTS, SLOTS, CHANS = 7, 6, 4


def observed(spark, gain, noise=0.0):
    """Visibilities of a model under gain(ant), one row a baseline, slot and channel."""
    rng = np.random.default_rng(1)
    rows = []
    for t in range(SLOTS):
        for f in range(CHANS):
            for p in range(ANTS):
                for q in range(p + 1, ANTS):
                    m = complex(*rng.normal(1, 0.2, 2))
                    d = gain(p) * m * np.conj(gain(q)) + complex(*rng.normal(0, noise or 1e-12, 2))
                    rows.append((t, f, p, q, float(d.real), float(d.imag), float(m.real), float(m.imag), 1.0))
    return spark.createDataFrame(rows, "t bigint, chan bigint, ant1 bigint, ant2 bigint, re double, im double, mre double, mim double, w double")


def test_complex_gains(spark):
    true = {p: (1 + 0.05 * p) * np.exp(0.1j * p) for p in range(ANTS)}
    both = gauss_newton.intervals(rebin.hermitian(observed(spark, true.get, 1e-3)), 3, 0)
    h = gauss_newton.diagonal(gauss_newton.normal_sums(both), 12)
    got = gauss_newton.referred(gauss_newton.last(h, 12), 0).collect()
    assert {(r.ti, r.fi) for r in got} == {(0, 0), (1, 0)} and len(got) == 2 * ANTS
    error = [abs(complex(r.g_re, r.g_im) - true[r.ant]) / abs(true[r.ant]) for r in got]
    assert 20 * np.log10(np.median(error)) <= -30 and 20 * np.log10(np.percentile(error, 95)) <= -25
    assert gauss_newton.reached(gauss_newton.convergence(h, 12, 1e-2), "converged", 0.99).first()["reached"]


def test_phases(spark):
    true = {p: np.exp(0.15j * p) for p in range(ANTS)}
    both = gauss_newton.intervals(rebin.hermitian(observed(spark, true.get)), 0, 0)
    got = {r.ant: r.phase for r in gauss_newton.last(gauss_newton.phases(gauss_newton.normal_sums(both), 12), 12).collect()}
    assert all(got[p] - got[0] == pytest.approx(0.15 * p, abs=1e-3) for p in true)


def test_full_gains(spark):
    """2 x 2 gains reproduce the data that they made."""
    rng = np.random.default_rng(2)
    true = [np.eye(2) + 0.1 * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))) for _ in range(ANTS)]
    cell = lambda x: [(float(v.real), float(v.imag)) for v in x.reshape(-1)]
    rows, made = [], []
    for s in range(4):
        for p in range(ANTS):
            for q in range(p + 1, ANTS):
                m = np.eye(2) + 0.2 * (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)))
                d = true[p] @ m @ true[q].conj().T
                made.append((p, q, m, d))
                rows += [(0, 0, p, q, cell(d), cell(m), 1.0), (0, 0, q, p, cell(d.conj().T), cell(m.conj().T), 1.0)]
    samples = spark.createDataFrame(rows, "ti bigint, fi bigint, ant1 bigint, ant2 bigint, d array<struct<re:double,im:double>>, m array<struct<re:double,im:double>>, w double")
    g = gauss_newton.last(gauss_newton.full(*gauss_newton.element_sums(samples), 14), 14, "n").collect()
    got = {p: np.zeros((2, 2), complex) for p in range(ANTS)}
    for r in g:
        got[r.ant][r.i, r.j] = complex(r.g_re, r.g_im)
    error = [np.abs(got[p] @ m @ got[q].conj().T - d).max() / np.abs(d).max() for p, q, m, d in made]
    assert np.median(error) < 0.01


def test_rules(spark):
    gains = spark.createDataFrame([(0, 0, a, *x) for a, x in enumerate([(1.0, 0.0, 100.0), (float("nan"), 0.0, 100.0), (0.0, 0.0, 100.0), (5.0, 0.0, 100.0), (1.0, 0.0, 1.0), (1.0, 0.0, 0.0)])], "ti bigint, fi bigint, ant bigint, g_re double, g_im double, jhj double")
    bits = {"BOOM": 128, "GNULL": 256, "GOOB": 64, "GVAR": 1024}
    flagged = gauss_newton.flagged(gauss_newton.posterior_errors(gains), bits, 0.5, 2.0, 0.5)
    assert {r.ant: r.gflags for r in flagged.collect()} == {0: 0, 1: 128, 2: 256, 3: 64, 4: 1024, 5: 1024}
    back = gauss_newton.restored(flagged, gains.selectExpr("ti", "fi", "ant", "7.0D as g_re", "1.0D as g_im")).collect()
    assert {r.ant: (r.g_re, r.g_im) for r in back} == {0: (1, 0)} | {a: (7, 1) for a in range(1, 6)}
