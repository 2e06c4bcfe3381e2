"""The solution database on a small grid with known values, exact medians against numpy, and flag sets."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from fringeworks.operators import database, flagsets, stats, store
from fringeworks.plans import database as plans  # noqa: F401
from fringeworks.plans.registry import QUERIES, SQL
from fringeworks.sources.tables import fresh_path


@pytest.fixture(scope="module")
def path(spark):
    """G by time, and B by frequency, written on [0, 2), [4, 6) and [7, 9), each with its first index as value."""
    at = fresh_path(spark, "fixture")
    database.create(spark, at, {"made": "by a test"})
    for name, axis in (("G", "time"), ("B", "freq")):
        database.define(spark, at, name, ("ant", "time", "freq", "corr"), ("time", "freq"))
        for seq, (lo, hi) in enumerate(((0, 2), (4, 6), (7, 9))):
            rows = [(a, float(i), c, float(lo)) for a in range(3) for i in range(lo, hi) for c in range(2)]
            database.append(at, name, spark.createDataFrame(rows, f"ant bigint, {axis} double, corr bigint, value double"), seq)
    return at


def test_fixture(spark, path):
    assert sorted(r.name for r in database.names(spark, path).collect()) == ["B", "G"]
    with pytest.raises(Exception):
        database.create(spark, path, {"made": "again"})
    with pytest.raises(ValueError):
        database.define(spark, path, "X", ("ant",), ("time",))
    g = database.get(spark, path, "G")
    shape = {r.axis: r.n for r in database.grids(g).groupBy("axis").agg({"grid": "count"}).withColumnRenamed("count(grid)", "n").collect()}
    assert shape == {"ant": 3, "time": 6, "corr": 2}
    one = {r.time: r.value for r in g.where("ant = 0 and corr = 0").collect()}
    assert one == {0: 0, 1: 0, 4: 4, 5: 4, 7: 7, 8: 7}
    ask = spark.createDataFrame([(a, c, t / 2) for a in range(3) for c in range(2) for t in range(20)], "ant bigint, corr bigint, time double")
    got = database.loaded(ask, g, ["ant", "corr"], "time", True).where("ant = 1 and corr = 1").collect()
    x, y = np.array(sorted(one)), np.array([one[t] for t in sorted(one)])
    for r in got:
        # beyond the ends the last two points go on
        want = np.interp(r.time, x, y) if x[0] <= r.time <= x[-1] else y[-1] + (y[-1] - y[-2]) / (x[-1] - x[-2]) * (r.time - x[-1])
        assert r.value == pytest.approx(want) and not r.masked
    with pytest.raises(ValueError):
        database.loaded(ask, g, ["ant", "corr"], "time", False)
    exact = database.loaded(g.select("ant", "corr", "time"), g, ["ant", "corr"], "time", False)
    assert exact.count() == 36 and exact.where("masked").count() == 0


def test_last_write_wins_also_after_compaction(spark, path):
    database.append(path, "G", spark.createDataFrame([(0, 4.0, 0, 99.0)], "ant bigint, time double, corr bigint, value double"), 9)
    before = sorted(map(tuple, database.get(spark, path, "G").collect()), key=str)
    assert sum(r[-1] == 99.0 for r in before) == 1
    database.compact(spark, path)
    assert sorted(map(tuple, database.get(spark, path, "G").collect()), key=str) == before
    assert spark.read.parquet(f"{path}/slices").count() == 72


def test_slices_lose_masked_lines(spark):
    cells = spark.createDataFrame([(0, t, f, (t == 1) or (f == 2)) for t in range(3) for f in range(3)], "ant int, time int, freq int, masked boolean")
    got = {(r.time, r.freq) for r in database.trimmed(cells, ["ant"], ["time", "freq"]).collect()}
    assert got == {(0, 0), (0, 1), (2, 0), (2, 1)}


@pytest.mark.parametrize("ranked", [stats.RANKED, 7])
def test_medians(spark, monkeypatch, ranked):
    """The same whether all values of a group are ranked or ranges are cut first; ties, single values and far outliers included."""
    monkeypatch.setattr(stats, "RANKED", ranked)
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(0, 1, 501), 1: rng.integers(0, 3, 400).astype(float), 2: np.append(rng.uniform(0, 1, 99), 1e30), 3: np.array([5.0]), 4: np.full(50, 2.0), 5: np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [(6, None)], "k int, x double").repartition(3)
    got = {r.k: r["median"] for r in stats.medians(rows, ["k"], "x").collect()}
    assert got == {k: pytest.approx(np.median(v)) for k, v in groups.items()}
    every = np.concatenate(list(groups.values()))
    assert stats.medians(rows, [], "x").first()["median"] == pytest.approx(np.median(every))


def test_latest_before(spark):
    asks = spark.createDataFrame([(1, t) for t in (0, 5, 10, 20)], "k int, t int")
    starts = spark.createDataFrame([(1, 5, "a"), (1, 12, "b")], "k int, t int, v string")
    got = {r.t: r.v for r in store.latest_at_or_before(asks, starts, ["k"], "t", "v").collect()}
    assert got == {0: "a", 5: "a", 10: "a", 20: "b"}


def test_flagsets(spark):
    bits = spark.createDataFrame([("a", 0), ("b", 2), ("c", 5)], "name string, bit bigint")
    order = spark.createDataFrame([("c", 0), ("lost", 1), ("a", 2)], "name string, place bigint")
    sets = flagsets.loaded(bits, order)
    assert [r.name for r in sets.orderBy("place").collect()] == ["c", "a", "b"]
    more = {r.name: (r.bit, r.mask) for r in flagsets.created(sets, spark.createDataFrame([("x",), ("b",), ("y",)], "name string")).collect()}
    assert more == {"a": (0, 1), "b": (2, 4), "c": (5, 32), "x": (1, 2), "y": (3, 8)}
    left, mask = flagsets.removed(sets, "a", "c")
    assert [r.name for r in left.collect()] == ["b"] and mask.first()["mask"] == 33
    policy = lambda p: tuple(flagsets.policy(sets, p).first())
    assert policy("-b") == (33, False) and policy("a,gone") == (1, False) and policy(["b", "c"]) == (36, False) and policy(7) == (7, False) and policy("FLAG") == (0, True)
    full = spark.createDataFrame([(f"n{i}", i) for i in range(32)], "name string, bit bigint")
    with pytest.raises(Exception):
        flagsets.created(flagsets.loaded(full, order), spark.createDataFrame([("one more",)], "name string")).collect()
    assert {r.name: r.mask for r in flagsets.from_names(spark.createDataFrame([("u", 0), ("v", 1)], "name string, place bigint")).collect()} == {"u": 1, "v": 2}


def test_first_of_equal_extremes(spark, tmp_path):
    """Rows in two files: of equal prices the first row's day, by the SQL too; rows without day or price don't count, an antenna with no others has no days."""
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    day = lambda d: None if d is None else datetime(1995, 1, 1) + timedelta(days=d)
    row = lambda k, ant, price, d: (k, ant, ant + 1, 1, 1.0, price, 0.0, 0.0, "N", "O", day(d))
    files = [
        [row(9, 0, 5e4, 40), row(8, 0, 9e4, 30), row(7, 0, 9e4, 10), row(6, 0, 1e4, 20), row(5, 1, None, 3), row(4, 1, 7e4, None), row(3, 0, 9e5, None)],
        [row(2, 0, 9e4, 5), row(1, 0, 1e4, 6), row(1, 0, 1e4, 50), row(1, 2, float("nan"), 8), row(1, 2, 3e4, 9), row(1, 2, float("nan"), 7)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (part,) = (tmp_path / str(i)).glob("part-*.parquet")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    got = {(r.ant, r.best, r.worst) for r in QUERIES["argmax_delay"](spark, str(tmp_path)).collect()}
    assert got == {(0, 30, 20), (1, None, None), (2, 8, 9)}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert set(con.sql(SQL["argmax_delay"]).fetchall()) == got
