"""Outlines against known answers."""

import random

import pytest
from pyspark.sql import functions as F

from fringeworks.operators import regions

#: Corners in order around each outline, anticlockwise.
OUTLINES = {1: [(-40, 30), (0, -80), (30, 10), (20, 60)], 2: [(-20, -120), (40, -60), (0, 60)], 3: [(-20, 58), (20, 100), (-40, 80)], 4: [(100, 100), (104, 100), (104, 104), (100, 104)], 5: [(105, 100), (109, 100), (109, 104), (105, 104)], 6: [(104, 105), (106, 105), (106, 107), (104, 107)]}


def hulls(spark, *ids):
    return spark.createDataFrame([(i, k, x, y) for i in ids for k, (x, y) in enumerate(OUTLINES[i])], "id bigint, k bigint, x bigint, y bigint")


def test_overlaps_by_separating_axes(spark):
    """The first meets the second; the third meets neither, although boxes overlap; boxes a pixel apart don't meet."""
    got = {(r.a, r.b) for r in regions.overlapping(hulls(spark, 1, 2, 3, 4, 5, 6), 16).collect()}
    assert got == {(1, 2)}


def copies(spark, n, *kinds):
    """n outlines of each kind: id % number of kinds tells which."""
    rows = [(i, k, x, y) for i in range(n * len(kinds)) for k, (x, y) in enumerate(OUTLINES[kinds[i % len(kinds)]])]
    return spark.createDataFrame(rows, "id bigint, k bigint, x bigint, y bigint")


def test_equal_outlines_are_tested_once(spark, monkeypatch):
    """Copies are few rows until their pairs are written out; lists cut short lose no pair, within a list, between lists of one outline and of two."""
    monkeypatch.setattr(regions, "BLOCK", 16)
    hull = copies(spark, 100, 1, 2, 3)
    lists = regions._outlines(hull).collect()
    assert len(lists) <= 21 and sorted(i for r in lists for i in r.ids) == list(range(300))
    got = [(r.a, r.b) for r in regions.overlapping(hull, 16).collect()]
    want = {(a, b) for b in range(300) for a in range(b) if a % 3 == b % 3 or (a % 3 < 2 and b % 3 < 2)}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("whole", [1 << 18, 3])
def test_one_outline_in_another_order_of_rows(spark, monkeypatch, whole):
    """Counts that don't go to every task give the same lists."""
    monkeypatch.setattr(regions, "WHOLE", whole)
    hull = copies(spark, 30, 1, 4, 5, 6, 3).orderBy("y", "id")
    assert sorted(sorted(r.ids) for r in regions._outlines(hull).collect()) == [list(range(i, 150, 5)) for i in range(5)]


def test_points_within(spark):
    points = spark.createDataFrame([(1, -1000, -1000), (2, 0, 0), (3, -40, 30), (4, 31, 10), (5, 29, 10)], "point bigint, x bigint, y bigint")
    got = {r.point for r in regions.containing(hulls(spark, 1), points, 16).collect()}
    assert got == {2, 3, 5}


def test_equal_points_meet_once(spark, monkeypatch):
    """Copies of outlines and of points are few rows until their pairs are written out; short lists lose none, and a point without a place is nowhere."""
    monkeypatch.setattr(regions, "BLOCK", 8)
    met, dealt = [], regions._dealt
    monkeypatch.setattr(regions, "_dealt", lambda m, *rest: met.append(m.count()) or dealt(m, *rest))
    places = [(0, 0), (-1000, 7), (-40, 30), (102, 103)]
    points = spark.createDataFrame([(i, *places[i % 4]) for i in range(80)] + [(80, None, 0)], "point bigint, x bigint, y bigint")
    got = [(r.id, r.point) for r in regions.containing(copies(spark, 40, 1, 4), points, 16).collect()]
    want = {(i, p) for i in range(80) for p in range(80) if p % 4 in ((0, 2), (3,))[i % 2]}
    assert len(got) == len(want) and set(got) == want
    assert met[0] <= 12 * 12


def test_odd_sides(spark):
    box = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(-14, 30), (20, 30), (20, 49), (-14, 49)])], "id bigint, k bigint, x bigint, y bigint")
    assert tuple(regions.aligned(box).first()) == (1, -14, 20, 30, 50)
    assert tuple(regions.aligned(box, square=True).first()) == (1, -14, 20, 22, 56)


def test_windows_beyond_the_image(spark):
    box = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(-2, 0), (1, 0), (1, 1), (-2, 1)])], "id bigint, k bigint, x bigint, y bigint")
    image = spark.createDataFrame([(x, y, float(10 * x + y + 1)) for x in range(3) for y in range(3)], "x bigint, y bigint, value double")
    got = {(r.x, r.y): r.value for r in regions.extracted(box, image, 3, 3, -1.0).collect()}
    assert got == {(-2, 0): -1, (-2, 1): -1, (-1, 0): -1, (-1, 1): -1, (0, 0): 1, (0, 1): 2, (1, 0): 11, (1, 1): 12}


def broadcast_rows(df):
    """Row counts of the tables that a plan sends to every task."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        else:
            found += [node.metrics().apply("numOutputRows").value()] if name == "BroadcastExchangeExec" else []
            plan += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("whole", [1 << 18, 3])
def test_windows_send_only_the_image(spark, monkeypatch, whole):
    """Pixels of outlines are never broadcast, however small Spark takes their table for; an image of many pixels isn't either."""
    monkeypatch.setattr(regions, "WHOLE", whole)
    image = spark.createDataFrame([(x, y, float(x + y)) for x in range(4) for y in range(4)], "x bigint, y bigint, value double")
    got = regions.extracted(copies(spark, 2, 1, 2), image, 4, 4, -1.0)
    assert broadcast_rows(got) == ([16] if whole > 16 else [])
    inside = {(r.id, r.x, r.y) for r in regions.rasterised(copies(spark, 2, 1, 2)).collect()}
    rows = got.collect()
    assert len(rows) == 2 * (71 * 141 + 61 * 181)
    for r in rows:
        assert r.value == (r.x + r.y if 0 <= r.x < 4 and 0 <= r.y < 4 and (r.id, r.x, r.y) in inside else -1)


@pytest.mark.parametrize("whole", [1 << 18, 3])
def test_weights_send_only_counts(spark, monkeypatch, tmp_path, whole):
    """From a table that Spark takes for small, only the counts of pixels go to every task, none of them if they are many."""
    monkeypatch.setattr(regions, "WHOLE", whole)
    copies(spark, 40, 5).write.parquet(f"{tmp_path}/hull")
    pixels = regions.rasterised(spark.read.parquet(f"{tmp_path}/hull"))
    got = regions.normalised(pixels)
    assert broadcast_rows(got) == ([25] if whole > 25 else [])
    rows = got.collect()
    assert len(rows) == 1000 and {r.weight for r in rows} == {1 / 40}


def test_stitched_weights_sum_to_one(spark):
    pixels = regions.normalised(regions.rasterised(hulls(spark, 1, 2, 3)))
    total = pixels.groupBy("x", "y").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").count()
    assert total == 0


@pytest.mark.parametrize("whole", [1 << 18, 3])
def test_stitched_image_sends_only_counts(spark, monkeypatch, tmp_path, whole):
    """The image of regions from a stored table, each pixel the mean of what paints it."""
    monkeypatch.setattr(regions, "WHOLE", whole)
    copies(spark, 20, 4, 6).write.parquet(f"{tmp_path}/hull")
    pixels = regions.rasterised(spark.read.parquet(f"{tmp_path}/hull"))
    got = regions.stitched(regions.normalised(pixels).withColumn("value", F.col("id").cast("double")))
    assert broadcast_rows(got) == ([34] if whole > 34 else [])
    square = {(x, y): 19.0 for x in range(100, 105) for y in range(100, 105)} | {(x, y): 20.0 for x in range(104, 107) for y in range(105, 108)}
    assert {(r.x, r.y): round(r.value, 9) for r in got.collect()} == square


@pytest.mark.parametrize("width", [256, 4])
def test_hulls(spark, width):
    """Outlines of points in any order, of strips and as a whole; points inside, repeated, in a line, and alone."""
    rnd = random.Random(width)
    rows, want = [], {}
    for i, corners in OUTLINES.items():
        if i in (1, 2, 3):
            continue
        inside = [(sum(c[0] for c in corners) // len(corners), sum(c[1] for c in corners) // len(corners))]
        rows += [(i, *p) for p in corners + inside + corners[:2]]
        want[i] = {tuple(c) for c in corners}
    rows += [(10, k, 2 * k) for k in range(9)] + [(11, 5, 5)] * 3 + [(12, 3, y) for y in (4, 9, 1)]
    want |= {10: {(0, 0), (8, 16)}, 11: {(5, 5)}, 12: {(3, 1), (3, 9)}}
    clouds = {20 + i: [(rnd.randint(-30, 30), rnd.randint(-30, 30)) for _ in range(rnd.choice([3, 8, 60]))] for i in range(8)}
    rows += [(i, *p) for i, c in clouds.items() for p in c]
    rnd.shuffle(rows)
    got = {}
    for r in regions.hulls(spark.createDataFrame(rows, "id long, x long, y long").repartition(3), width).orderBy("id", "k").collect():
        got.setdefault(r.id, []).append((r.x, r.y))
    assert all(set(got[i]) == w and len(got[i]) == len(w) for i, w in want.items())
    for i, cloud in clouds.items():
        h = got[i]
        assert h[0] == min(cloud) and set(h) <= set(cloud)
        for a, b, c in zip(h, h[1:] + h[:1], h[2:] + h[:2]):
            side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            assert all(side(p) >= 0 for p in cloud) and (len(h) < 3 or side(c) > 0)
