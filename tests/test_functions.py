import fnmatch

import pytest
from pyspark.sql import functions as F

from fringeworks.functions.algebra import weights
from fringeworks.functions.cx import cx, diagonal_inverse
from fringeworks.functions.grammar import globbed, parse_bin, parse_range


@pytest.mark.parametrize("spec, want", [("5", [5]), ("5~7", [5, 6, 7]), ("5:8", [5, 6, 7]), ("7:", [7, 8, 9]), ("~9:4", [0, 4, 8]), ("", list(range(10))), (None, list(range(10)))])
def test_ranges(spec, want):
    assert list(parse_range(spec, 10)) == want


def test_no_range():
    with pytest.raises(ValueError):
        parse_range("a-b", 10)


def test_bins():
    assert parse_bin("16") == (16, None)
    assert parse_bin("2m") == (0, 120.0)
    assert parse_bin("4MHz") == (0, 4e6)


def test_patterns_of_file_names(spark):
    names = ["EA01", "EA12", "ea01", "VLA[1]", "a.b", "axb"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for pattern in ("EA*", "EA?[12]", "[!E]*", "*[[]1]", "a.b", "*"):
        got = {r.n for r in rows.where(globbed(F.col("n"), pattern)).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}, pattern


def test_weight_products(spark):
    rows = spark.createDataFrame([(0, 0, 2.0, 1.0), (0, 1, 4.0, 3.0), (1, 0, 5.0, 7.0)], "t int, corr int, A double, B double")
    got = rows.withColumn("w", weights(rows, "A*B~", ["t"])).orderBy("t", "corr").collect()
    assert [r.w for r in got] == [4.0, 8.0, 35.0]
    with pytest.raises(ValueError):
        weights(rows, "A*C", ["t"])


def test_diagonal_inverse(spark):
    rows = spark.createDataFrame([(2.0, 0.0, 0.0, 4.0), (1e-4, 0.0, 1e-4, 0.0)], "a double, b double, c double, d double")
    x, y, bad = diagonal_inverse(cx("a", "b"), cx("c", "d"), 1e-6)
    got = rows.select(x.re.alias("x"), y.im.alias("y"), bad.alias("bad")).collect()
    assert tuple(got[0]) == (0.5, -0.25, False) and tuple(got[1]) == (0.0, 0.0, True)


def test_polarised_sources(spark):
    """A point at the centre shows its Stokes fluxes on every baseline, for both kinds of feeds; one off the centre turns all four alike; directions stay apart."""
    from fringeworks.operators import predict

    sky = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 1.0, 0.5, 0.25), (1, 0.01, -0.02, 2.0, 0.0, 0.0, 1.0)], "dir long, l double, m double, i double, q double, u double, v double")
    sky = sky.selectExpr("*", "0D as alpha", "0D as lx", "0D as mx", "1D as ratio")
    vis = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 30.0, 10.0, 5.0)], "row long, u double, v double, w_m double").selectExpr("*", "1e9 as freq")
    for circular, first in ((False, [5, 0.5 + 0.25j, 0.5 - 0.25j, 3]), (True, [4.25, 1 + 0.5j, 1 - 0.5j, 3.75])):
        got = {(r.row, r.dir, r.corr): complex(r.m_re, r.m_im) for r in predict.predicted_brightness(vis, sky, ["row"], circular).collect()}
        assert all(abs(got[row, 0, c] - first[c]) < 1e-12 for row in (0, 1) for c in range(4))
        turn = got[1, 1, 0] / got[0, 1, 0]
        assert abs(abs(turn) - 1) < 1e-9 and abs(turn - 1) > 0.1
        assert all(abs(got[1, 1, c] - turn * got[0, 1, c]) < 1e-9 for c in range(4))
