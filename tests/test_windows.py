"""Streams give what batches give; planes, chunks and tiles against brute force."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fringeworks.functions.algebra import parse_models
from fringeworks.operators import rebin, store
from fringeworks.plans import solvers
from fringeworks.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") % 3).alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(10**6, 0)], "s long, k long").select(F.timestamp_seconds("s").alias("ts"), "k")
    last.write.mode("append").parquet(str(tmp_path / "in"))
    made = lambda x: windows.tumbling(x, "ts", "10 minutes", "1 minute", ["k"], F.count(F.lit(1)).alias("n"))
    q = made(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, made(spark.read.parquet(str(tmp_path / "in"))).collect()))


def test_solved_batches(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    q = windows.solved(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda b: b.select(F.sum("id").alias("s")), str(tmp_path / "out"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    assert [r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [45]


def test_plane(spark):
    f = lambda t, c: 2.0 * t - 3.0 * c + 1
    s = spark.createDataFrame([(0, t, c, f(t, c)) for t in (0, 2, 4) for c in (0, 4) if (t, c) != (2, 4)], "ant long, time long, chan long, value double")
    asks = [(0, t, c) for t in (-1, 0, 1, 3, 4, 9) for c in (0, 1, 4, 7)]
    got = store.interpolated_plane(spark.createDataFrame(asks, "ant long, time long, chan long"), s, ["ant"], ("time", "chan")).collect()
    assert all(np.isclose(r.value, f(min(max(r.time, 0), 4), min(r.chan, 4))) for r in got) and len(got) == len(asks)


def test_planes_of_appended_slices(spark):
    """Slices of gains by time and of a bandpass by frequency, with gaps between them, on a finer grid: steps become slopes, ends are held, and a parameter without solutions has no values."""
    s = [("G", 0, float(t), 0.0, float(i0)) for i0, i1 in ((0, 2), (4, 6), (7, 9)) for t in range(i0, i1)] + [("B", 0, 0.0, float(f), float(i0)) for i0, i1 in ((0, 2), (4, 6), (7, 9)) for f in range(i0, i1)]
    asks = [(p, 0, t / 2, f * 1.5) for p in "GBX" for t in range(20) for f in range(7)]
    schema = "param string, ant long, time double, freq double"
    got = {(r.param, r.time, r.freq): r.value for r in store.interpolated_plane(spark.createDataFrame(asks, schema), spark.createDataFrame(s, schema + ", value double"), ["param", "ant"], ("time", "freq")).collect()}
    at = [0, 1, 4, 5, 7, 8], [0.0, 0.0, 4.0, 4.0, 7.0, 7.0]
    for p, _, t, f in asks:
        want = {"G": np.interp(t, *at), "B": np.interp(f, *at), "X": None}[p]
        assert got[p, t, f] is None if want is None else abs(got[p, t, f] - want) < 1e-12


def test_chunks_by_length(spark):
    d = spark.createDataFrame([(0, x) for x in (0, 1, 9, 10, 11, 30, 35, 41)], "scan long, t long")
    got = {r.t: r.chunk for r in rebin.chunks_by_length(d, ["scan"], "t", 10).collect()}
    assert got == {0: 0, 1: 0, 9: 0, 10: 1, 11: 1, 30: 2, 35: 2, 41: 3}


def test_models():
    assert parse_models("A+-B:C,1") == [[[(1, "A"), (-1, "B")], [(1, "C")]], [[(1, "1")]]]


def test_greedy_chunks(spark):
    """Chunks of random axes in several groups are those of a walk, also where one has a single time."""
    rnd = random.Random(6)
    rows = {g: sorted({rnd.randrange(400) for _ in range(rnd.choice([1, 5, 120]))}) for g in range(7)}
    for length in (1, 7, 55.5):
        want = {}
        for g, times in rows.items():
            start, k = times[0], 0
            for x in times:
                if x >= start + length:
                    start, k = x, k + 1
                want[g, x] = k
        d = spark.createDataFrame([(g, x, "kept") for g, t in rows.items() for x in t], "g long, t long, more string").repartition(3)
        got = rebin.chunks_by_length(d, ["g"], "t", length).collect()
        assert {(r.g, r.t): r.chunk for r in got} == want and {r.more for r in got} == {"kept"}
    assert rebin.chunks_by_length(d.limit(0), ["g"], "t", 5).count() == 0


def test_coarse_tiles(spark):
    rnd = random.Random(7)
    rows = {g: [rnd.choice([1, 1, 2, 3, 9, 30]) for _ in range(rnd.choice([1, 4, 60]))] for g in range(6)}
    for least, most in ((4, 16), (1, 3), (10, 10**6)):
        want = {}
        for g, sizes in rows.items():
            have, k = sizes[0], 0
            for i, n in enumerate(sizes):
                if i:
                    have, k = (n, k + 1) if have > least or have + n > most else (have + n, k)
                want[g, i] = k
        d = spark.createDataFrame([(g, i, n) for g, s in rows.items() for i, n in enumerate(s)], "g long, i long, n long")
        assert {(r.g, r.i): r.tile for r in rebin.coarsened(d, ["g"], "i", "n", least, most).collect()} == want


@pytest.mark.parametrize("files", [None, 1, 2])
def test_solve_over_batches(spark, tmp_path, files):
    """However a table's files fall into micro-batches, the gains are those of the table at once."""
    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "parts"))
    got = solvers.streamed_gains(spark, str(tmp_path / "parts"), f"{SF}/lineitem.parquet", files).collect()
    want = {(r.ti, r.fi, r.ant): (r.g_re, r.g_im) for r in solvers.streamed_gains(spark, f"{SF}/lineitem.parque[t]", f"{SF}/lineitem.parquet").collect()}
    assert len(got) == len(want) and all(np.allclose((r.g_re, r.g_im), want[r.ti, r.fi, r.ant]) for r in got)


def test_bounds_reach_the_scan(spark, capsys):
    from fringeworks.plans import database

    database.sel_single(spark, SF).explain("formatted")
    shown = capsys.readouterr().out
    pushed = next(line for line in shown.splitlines() if "PushedFilters" in line)
    assert "l_shipdate" in pushed and "l_linenumber" in pushed


def test_running_counts(spark, tmp_path):
    """Three batches of a file each: rows out of order are counted, a row after the watermark is dropped and said to be, and the state goes on from batch to batch."""
    files = [[(t, t // 60 % 2) for t in range(0, 6000, 60)], [(t, 1) for t in range(9000, 5000, -90)], [(9500, 0), (8700, 1), (100, 0), (200, 1), (9600, 1)]]
    for i, rows in enumerate(files):
        spark.createDataFrame([(t, k, t % 4 == 0) for t, k in rows], "s long, k long, flag boolean").select(F.timestamp_seconds("s").alias("ts"), "k", "flag").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.running(stream, "ts", "10 minutes", "20 minutes", ["k"], str(tmp_path / "out"), str(tmp_path / "c"), flagged=F.count_if("flag"))
    assert query.awaitTermination(240)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = windows.current(spark, str(tmp_path / "out"), ["k"])
    want = {}
    for t, k in [x for f in files for x in f if x not in ((100, 0), (200, 1)) or f is files[0]]:
        n, flagged = want.get((k, t // 600 * 600), (0, 0))
        want[k, t // 600 * 600] = (n + 1, flagged + (t % 4 == 0))
    assert {(r.k, int(r.start.timestamp())): (r.n, r.flagged) for r in got.select("k", "start", "n", "flagged").collect()} == want
    assert windows.dropped(query, got) == 2
