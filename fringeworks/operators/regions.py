"""Convex regions of an image and boxes: outlines are vertex rows (id, k, x, y) in order around the region, pixels are rows (id, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

#: Ids that a row of _lists() holds, on average at most; rows of numbers that go to every task whole.
BLOCK, WHOLE = 1024, 1 << 18


def hulls(points: DataFrame, width: int = 256) -> DataFrame:
    """id, k, x, y: the convex outline of each id's points (id, x, y; whole numbers, in any order, repeated or in a line), anticlockwise from the lowest of its leftmost ones. Of each column the lowest and
    the highest point are kept, before any shuffle; strips of so many columns become outlines of their own by a monotone chain, folded over sorted arrays, and these outlines' points once more."""

    def chain(sorted_: Column, sign: int) -> Column:
        """Points that turn one way only: a new one takes away those at the end that would turn the other way, or not at all."""

        def put(kept: Column, p: Column) -> Column:
            def stays(s: Column, k: Column) -> Column:
                o = F.get(kept, k - 1)
                return (k == 0) | (sign * ((s["x"] - o["x"]) * (p["y"] - o["y"]) - (s["y"] - o["y"]) * (p["x"] - o["x"])) > 0)

            return F.concat(F.filter(kept, stays), F.array(p))

        return F.aggregate(sorted_, F.array().cast("array<struct<x:bigint,y:bigint>>"), put)

    columns = points.groupBy("id", F.col("x").cast("bigint").alias("x")).agg(F.min("y").cast("bigint").alias("lo"), F.max("y").cast("bigint").alias("hi"))
    at = lambda y: F.sort_array(F.collect_list(F.struct("x", F.col(y).alias("y"))))
    strips = columns.groupBy("id", F.floor(F.col("x") / width).alias("strip")).agg(at("lo").alias("low"), at("hi").alias("high"))
    strips = strips.select("id", chain(F.col("low"), 1).alias("low"), chain(F.col("high"), -1).alias("high"))
    whole = strips.groupBy("id").agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("low", "high")])
    around = F.array_distinct(F.concat(chain(F.col("low"), 1), F.reverse(chain(F.col("high"), -1))))
    return whole.select("id", F.posexplode(around).alias("k", "p")).select("id", F.col("k").cast("bigint").alias("k"), "p.x", "p.y")


def edges(hull: DataFrame) -> DataFrame:
    """id, k, x, y, x2, y2, nx, ny: each edge and its normal towards the inside of an anticlockwise outline."""
    order = Window.partitionBy("id").orderBy("k")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {f"{c}2": F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("x", "y")}
    return hull.withColumns(nxt).withColumns({"nx": F.col("y") - F.col("y2"), "ny": F.col("x2") - F.col("x")})


def areas(hull: DataFrame) -> DataFrame:
    """id, area by the edges' cross products, and pixels, the lattice points within or on it (Pick)."""
    e = edges(hull)
    a, b = F.abs(F.col("x2") - F.col("x")).cast("bigint"), F.abs(F.col("y2") - F.col("y")).cast("bigint")
    # lattice points on an edge: the greatest common divisor of its sides
    on = F.when(F.least(a, b) == 0, F.greatest(a, b)).otherwise(F.array_max(F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.least(a, b), F.lit(1))), lambda d: (a % d == 0) & (b % d == 0))))
    s = e.groupBy("id").agg((F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / F.lit(2.0)).alias("area"), F.sum(on).alias("_on"))
    return s.select("id", "area", (F.col("area") + F.col("_on") / 2 + 1).cast("bigint").alias("pixels"))


def _cells_of_boxes(hull: DataFrame) -> DataFrame:
    """Every pixel of each outline's own box: id, x, y, and _in, whether it lies within or on the outline."""
    e = edges(hull)
    h = e.groupBy("id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.collect_list(F.struct("x", "y", "nx", "ny")).alias("_e"))
    cell = h.select("id", "_e", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("px")).select("id", "_e", "px", F.explode(F.sequence("y0", "y1")).alias("py"))
    inside = F.forall("_e", lambda s: (F.col("px") - s["x"]) * s["nx"] + (F.col("py") - s["y"]) * s["ny"] >= 0)
    return cell.select("id", F.col("px").alias("x"), F.col("py").alias("y"), inside.alias("_in"))


def rasterised(hull: DataFrame) -> DataFrame:
    """Pixels within or on each outline; rows multiply by the area of a region's own box."""
    return _cells_of_boxes(hull).where("_in").drop("_in")


def _beside(rows: DataFrame, numbers: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to a table of few columns. It goes to every task if it has no more than WHOLE rows, else both are shuffled: Spark's guess, which doesn't see how explode() multiplies rows, would send either one through the driver."""
    numbers = written(numbers, "numbers")
    return rows.join(F.broadcast(numbers) if numbers.count() <= WHOLE else numbers.hint("merge"), on)


def normalised(pixels: DataFrame) -> DataFrame:
    """Each pixel's weight: 1 over the regions that paint it. Counted by pixel before the join, so a hot pixel is no hot task."""
    n = pixels.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"))
    return _beside(pixels, n, ["x", "y"]).select("id", "x", "y", (1 / F.col("_n")).alias("weight"))


def stitched(values: DataFrame) -> DataFrame:
    """One image of (x, y, value, weight) rows: the sum of weighted values."""
    return values.groupBy("x", "y").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def boxes(hull: DataFrame, pad: int = 0) -> DataFrame:
    return hull.groupBy("id").agg((F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"), (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))


def split_boxes(box: DataFrame, size: int) -> DataFrame:
    """Boxes cut along a grid of the given step: id, x0, x1, y0, y1, none larger than a cell."""
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    g = box.withColumn("gx", cut("x0", "x1")).withColumn("gy", cut("y0", "y1"))
    ends = {"x0": F.greatest("x0", F.col("gx") * size), "x1": F.least("x1", F.col("gx") * size + size - 1), "y0": F.greatest("y0", F.col("gy") * size), "y1": F.least("y1", F.col("gy") * size + size - 1)}
    return g.withColumns(ends).drop("gx", "gy")


def _in_cells(box: DataFrame, size: int) -> DataFrame:
    """A row for each cell of the grid that a box (x0, x1, y0, y1) touches: gx, gy."""
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return box.withColumn("gx", cell("x0", "x1")).withColumn("gy", cell("y0", "y1"))


def _lists(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, block, ids: the names of rows with equal keys, some BLOCK a row; a hash deals them out, so a key of many rows is no hot task. Keys are counted by their hashes: a shared one makes more, shorter lists."""
    rows = written(rows.withColumn("_h", F.xxhash64(key)), "keys")
    n = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    block = F.pmod(F.xxhash64(name), F.ceil(F.col("_n") / BLOCK)).alias("block")
    return written(_beside(rows, n, ["_h"]).groupBy(key, block).agg(F.collect_list(name).alias("ids")), "lists")


def _outlines(hull: DataFrame) -> DataFrame:
    """corners, block, ids: outlines with the same corners are one row, or few."""
    corners = F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    return _lists(hull.groupBy("id").agg(corners.alias("corners")), "corners", "id")


def _sides(corners: Column) -> Column:
    """x, y, nx, ny of each edge as in edges(), normals of length 1."""

    def side(c: Column, i: Column) -> Column:
        nxt = F.get(corners, (i + 1) % F.size(corners))
        nx, ny = c["y"] - nxt["y"], nxt["x"] - c["x"]
        length = F.sqrt(nx * nx + ny * ny)
        return F.struct(c["x"].alias("x"), c["y"].alias("y"), (nx / length).alias("nx"), (ny / length).alias("ny"))

    return F.transform(corners, side)


def _ends(corners: str, pad: float) -> dict[str, Column]:
    at = lambda f, c: f(F.transform(corners, lambda v: v[c]))
    return {f"{c}{i}": at(f, c) + (2 * i - 1) * pad for c in "xy" for i, f in enumerate((F.array_min, F.array_max))}


def _dealt(met: DataFrame, by: list[str], *lists: DataFrame) -> DataFrame:
    """Pairs of lists are dealt out before they become pairs of ids, which may be millions a row; without lists of several ids they stay where they are."""
    if all(x.where(F.size("ids") > 1).isEmpty() for x in lists):
        return met
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def overlapping(hull: DataFrame, size: int, gap: float = 0.5) -> DataFrame:
    """Pairs a < b of outlines that no normal of an edge keeps more than gap apart. Outlines with the same corners are tested once, by lists. Their boxes, padded by half the gap, meet in the grid cells that
    they touch; a pair counts in the cell of its common corner alone."""
    lists = _outlines(hull)
    shape = lists.select(F.array_min("ids").alias("id"), "ids", _sides(F.col("corners")).alias("e"), *[v.alias(c) for c, v in _ends("corners", gap / 2).items()])
    cell = _in_cells(shape, size)
    a, b = (cell.select("gx", "gy", *[F.col(c).alias(f"{c}{k}") for c in ("id", "ids", "x0", "x1", "y0", "y1", "e")]) for k in "ab")
    met = a.join(b.hint("merge"), ["gx", "gy"]).where("ida <= idb and x0a <= x1b and x0b <= x1a and y0a <= y1b and y0b <= y1a")
    met = met.where((F.floor(F.greatest("x0a", "x0b") / size) == F.col("gx")) & (F.floor(F.greatest("y0a", "y0b") / size) == F.col("gy")))

    def apart(n: Column) -> Column:
        pa, pb = (F.transform(c, lambda v: v["x"] * n["nx"] + v["y"] * n["ny"]) for c in ("ea", "eb"))
        return (F.array_min(pb) - F.array_max(pa) > gap) | (F.array_min(pa) - F.array_max(pb) > gap)

    met = met.where(~F.exists(F.concat("ea", "eb"), apart)).select("ida", "idb", "idsa", "idsb")
    pairs = _dealt(met, ["ida", "idb"], lists).select((F.col("ida") == F.col("idb")).alias("_one"), F.explode("idsa").alias("a"), "idsb").select("_one", "a", F.explode("idsb").alias("b"))
    return pairs.where("not _one or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def containing(hull: DataFrame, points: DataFrame, size: int, tolerance: float = 0.5) -> DataFrame:
    """Points (point, x, y) within each outline, or at most tolerance outside an edge: id, point. Outlines with the same corners and points of one place meet once, by lists, in grid cells."""
    lists = _outlines(hull)
    shape = lists.select(F.array_min("ids").alias("_a"), F.col("ids").alias("_ids"), _sides(F.col("corners")).alias("e"), *[v.alias(c) for c, v in _ends("corners", 1).items()])
    places = _lists(points.select("point", F.struct("x", "y").alias("at")), "at", "point")
    at = places.select(F.array_min("ids").alias("_b"), F.col("ids").alias("_points"), F.col("at.x").alias("px"), F.col("at.y").alias("py")).withColumns({"gx": F.floor(F.col("px") / size), "gy": F.floor(F.col("py") / size)})
    met = _in_cells(shape, size).join(at.hint("merge"), ["gx", "gy"])
    met = met.where(F.forall("e", lambda s: (F.col("px") - s["x"]) * s["nx"] + (F.col("py") - s["y"]) * s["ny"] >= -tolerance)).select("_a", "_b", "_ids", "_points")
    return _dealt(met, ["_a", "_b"], lists, places).select(F.explode("_ids").alias("id"), "_points").select("id", F.explode("_points").alias("point"))


def extracted(hull: DataFrame, image: DataFrame, width: int, height: int, outside: float = 0.0) -> DataFrame:
    """The window of each outline's box out of an image of pixels (x, y, value; absent ones are 0): id, x, y, value, where pixels outside the outline or the image have the value outside.
    Windows are laid out once, and only the image is joined: it goes to every task if it has no more than WHOLE pixels."""
    on = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    pixels = image.where(on).select("x", "y", "value")
    got = _cells_of_boxes(hull).join(F.broadcast(pixels) if width * height <= WHOLE else pixels.hint("merge"), ["x", "y"], "left")
    return got.select("id", "x", "y", F.when(F.col("_in") & on, F.coalesce("value", F.lit(0.0))).otherwise(outside).alias("value"))


def aligned(hull: DataFrame, square: bool = False, odd: bool = True) -> DataFrame:
    """The box of each outline: id, x0, x1, y0, y1; square ones around the truncated mean of the corners; with odd, of odd sides."""
    b = boxes(hull)
    if square:
        trunc = lambda c: F.when(F.avg(c) >= 0, F.floor(F.avg(c))).otherwise(F.ceil(F.avg(c)))
        b = b.join(hull.groupBy("id").agg(trunc("x").alias("cx"), trunc("y").alias("cy")), "id")
        side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1
        b = b.withColumn("_n", side).withColumn("_r", F.floor(side / 2))
        b = b.select("id", *[x.cast("bigint").alias(n) for c, k in (("cx", "x"), ("cy", "y")) for n, x in ((f"{k}0", F.col(c) - F.col("_r")), (f"{k}1", F.col(c) + F.col("_n") - F.col("_r") - 1))])
    more = lambda k: F.col(f"{k}1") + ((F.col(f"{k}1") - F.col(f"{k}0")) % 2 if odd else 0)
    return b.withColumns({"x1": more("x"), "y1": more("y")}).select("id", "x0", "x1", "y0", "y1")
