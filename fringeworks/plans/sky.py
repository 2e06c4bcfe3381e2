"""Sources, regions and angles on whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.cx import Cx, cx, sandwich
from ..operators import predict, regions
from ..sources.views import VL, VT, time_axis, visibilities
from .queries import RB, cells
from .registry import query

#: Customers as sources: place, flux, spectral terms and shape.
SRC = """src as (select c_custkey as id, c_nationkey::bigint as tag, 0.9::double + (c_custkey % 97) / 970.0::double as ra, -0.5::double + (c_custkey % 89) / 890.0::double as dec, 1 + abs(c_acctbal) / 1000 as flux,
 -0.7::double - (c_custkey % 5) / 50.0::double as alpha, 0.01::double * (c_custkey % 3) as curve, (c_custkey % 4) / 1000.0::double as ex, (c_custkey % 4) / 2000.0::double as ey, (c_custkey % 31) / 10.0::double as pa from customer)"""
LM = "lm as (select *, cos(dec) * sin(ra - 0.95::double) as l, sin(dec) * cos(-0.45::double) - cos(dec) * sin(-0.45::double) * cos(ra - 0.95::double) as m from src)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda n, d: (k % n) / F.lit(d)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("id"), F.col("c_nationkey").cast("bigint").alias("tag"), (0.9 + part(97, 970.0)).alias("ra"), (-0.5 + part(89, 890.0)).alias("dec"), (1 + F.abs("c_acctbal") / 1000).alias("flux"),
        (-0.7 - part(5, 50.0)).alias("alpha"), (0.01 * (k % 3)).alias("curve"), part(4, 1000.0).alias("ex"), part(4, 2000.0).alias("ey"), part(31, 10.0).alias("pa"),
    )
    l, m = sky.radec_to_lm(F.col("ra"), F.col("dec"), 0.95, -0.45)
    return c.withColumns({"l": l, "m": m})


@query(f"with {SRC}, {LM} select id, l, m from lm", "l m")
def radec2lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("id", "l", "m")


_SP = "pow(1.4::double, alpha + curve * log10(1.4::double))"


@query(f"with {SRC} select id, flux * {_SP} as stokes_i, 0.1 * flux * {_SP} as stokes_q, -0.05 * flux * {_SP} as stokes_u, 0.01 * flux * {_SP} as stokes_v from src", "stokes_i stokes_q stokes_u stokes_v")
def spectrum_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sky.power_law(F.lit(1.4e9), F.lit(1e9), [F.col("alpha"), F.col("curve")])
    return sources(spark, sf_dir).select("id", *[(share * F.col("flux") * s).alias(f"stokes_{c}") for c, share in (("i", 1.0), ("q", 0.1), ("u", -0.05), ("v", 0.01))])


@query(f"with {SRC} select id, ex * sin(pa) as lx, ex * cos(pa) as mx, case when ex = 0 then 1 else ey / ex end as ratio from src", "lx mx ratio")
def gauss_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lx, mx, ratio = sky.gaussian_shape(F.col("ex"), F.col("ey"), F.col("pa"))
    return sources(spark, sf_dir).select("id", lx.alias("lx"), mx.alias("mx"), ratio.alias("ratio"))


@query(f"with {SRC} select tag, id % 2 as beam, case when ex > 0 then 'gaussian' else 'point' end as type, count(*) as n, sum(flux) as flux, min(id) as first from src group by all", "flux")
def cluster_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.grouped(sources(spark, sf_dir).withColumn("beam", F.col("id") % 2))


CL = "cl as (select floor(l / 0.02)::bigint as cl, floor(m / 0.02)::bigint as cm, sum(l * flux) / sum(flux) as l, sum(m * flux) / sum(flux) as m, sum(alpha * flux) / sum(flux) as alpha, sum(flux) as flux, count(*) as n from lm group by 1, 2)"


@query(f"with {SRC}, {LM}, {CL} select * from cl", "l m alpha flux")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.clusters(sources(spark, sf_dir), 0.02)


@query(f"""with {VL}, {RB}, {SRC}, {LM}, {CL}, v as (select *, 10.0::double * (ant2 - ant1) as u, 5.0::double * (t % 10) as v, 2.0::double * ant1 as w_m, 1e9::double + chan * 1e7::double as freq from rb), s as (select l, m, flux, alpha, 0.001::double * (n % 3) as lx, 0.002::double * (n % 2) as mx from cl),
 p as (select v.*, -2 * pi() * (u * l + v * m + w_m * (sqrt(1 - l * l - m * m) - 1)) * freq / 299792458.0::double as ph, flux * pow(freq / 1e9::double, alpha) * exp(-(pow((u * lx + v * mx) * freq * pi() / 299792458.0::double, 2) + pow((u * mx - v * lx) * 0.5 * freq * pi() / 299792458.0::double, 2)) / (4 * ln(2.0::double))) as a from v, s)
 select t, chan, ant1, ant2, sum(a * cos(ph)) as m_re, sum(a * sin(ph)) as m_im from p group by 1, 2, 3, 4""", "m_re m_im", 3)  # fmt: skip
def predict_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sky, merged by cell; merged sources have a size, a spectrum and a shape."""
    cat = predict.clusters(sources(spark, sf_dir), 0.02).withColumns({"lx": 0.001 * (F.col("n") % 3), "mx": 0.002 * (F.col("n") % 2), "ratio": F.lit(0.5)})
    v = cells(spark, sf_dir).withColumns({"u": 10.0 * (F.col("ant2") - F.col("ant1")), "v": 5.0 * (F.col("t") % 10), "w_m": 2.0 * F.col("ant1"), "freq": 1e9 + F.col("chan") * 1e7})
    return predict.predicted(v, cat, ["t", "chan", "ant1", "ant2"])


_STOKES = (("i", "flux"), ("q", "0.1::double * flux * (n % 3)"), ("u", "-0.05::double * flux * (cl % 4)"), ("v", "0.02::double * flux"))


@query(f"""with {VL}, {RB}, {SRC}, {LM}, {CL}, v as (select *, 10.0::double * (ant2 - ant1) as u, 5.0::double * (t % 10) as v, 2.0::double * ant1 as w_m, 1e9::double + chan * 1e7::double as freq from rb), s as (select (cm % 2 + 2) % 2 as dir, l, m, alpha, {", ".join(f"{x} as s{c}" for c, x in _STOKES)} from cl),
 p as (select v.*, s.*, -2 * pi() * (u * l + v * m + w_m * (sqrt(1 - l * l - m * m) - 1)) * freq / 299792458.0::double as ph, pow(freq / 1e9::double, alpha) as a from v, s),
 x as (select t, chan, ant1, ant2, dir, {", ".join(f"sum(s{c} * a * cos(ph)) as {c}r, sum(s{c} * a * sin(ph)) as {c}i" for c in "iquv")} from p group by all)
 select t, chan, ant1, ant2, dir, 0::bigint as corr, ir + qr as m_re, ii + qi as m_im from x union all select t, chan, ant1, ant2, dir, 1, ur - vi, ui + vr from x
 union all select t, chan, ant1, ant2, dir, 2, ur + vi, ui - vr from x union all select t, chan, ant1, ant2, dir, 3, ir - qr, ii - qi from x""", "m_re m_im", 3)  # fmt: skip
def predict_stokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polarised sky in two directions, as linear feeds see it."""
    cat = predict.clusters(sources(spark, sf_dir), 0.02)
    flux = F.col("flux")
    cat = cat.withColumns({"i": flux, "q": 0.1 * flux * (F.col("n") % 3), "u": -0.05 * flux * (F.floor(F.col("l") / 0.02) % 4), "v": 0.02 * flux, "lx": F.lit(0.0), "mx": F.lit(0.0), "ratio": F.lit(1.0), "dir": F.pmod(F.floor(F.col("m") / 0.02), F.lit(2))})
    v = cells(spark, sf_dir).withColumns({"u": 10.0 * (F.col("ant2") - F.col("ant1")), "v": 5.0 * (F.col("t") % 10), "w_m": 2.0 * F.col("ant1"), "freq": 1e9 + F.col("chan") * 1e7})
    return predict.predicted_brightness(v, cat, ["t", "chan", "ant1", "ant2"])


# ---------------------------------------------------------------- angles and Jones


@query(f"with {VT} select id, atan2(cos(-0.5::double) * sin((id % 1000) / 500.0::double), sin(-0.5::double) * cos(0.3::double) - cos(-0.5::double) * sin(0.3::double) * cos((id % 1000) / 500.0::double)) as angle from vt", "angle")
def pa_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_axis(spark, sf_dir).select("id", sky.parallactic_angle((F.col("id") % 1000) / 500.0, 0.3, F.lit(-0.5)).alias("angle"))


@query("select event_id as id, epoch_us(ts) // 1000000 + 3506716800 as mjd_s, (epoch_us(ts) // 1000000) * 1000000 as utc_us from events")
def mjd_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On whole seconds: a double holds these days' microseconds to one only."""
    mjd = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) + 3506716800
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), mjd.alias("mjd_s"))
    return e.withColumn("utc_us", F.unix_micros(sky.mjd_to_utc(F.col("mjd_s"))))


#: Jones matrices by antenna, time sample (of ten slots) and band (of three channels): a, b, c, d by rows.
_J = "jn as (select distinct ant, floor(t / 10)::bigint as ts, chan // 3 as band, 1 + ant / 10.0::double + floor(t / 10) / 50 as a, 0.1::double * ant as b, 0.05::double * (chan // 3) as c, 1 - ant / 20.0::double as d from (select t, chan, unnest([ant1, ant2]) as ant from rb))"


@query(f"""with {VL}, {RB}, {_J}, v as (select *, mre as x, 0.2::double as y, w / 100 as z from rb) select t, chan, ant1, ant2, (p.a * re + p.b * y) * q.a + (p.a * x + p.b * z) * q.b as v00_re, p.a * im * q.a as v00_im, (p.c * re + p.d * y) * q.c + (p.c * x + p.d * z) * q.d as v11_re
 from v join jn p on p.ant = ant1 and p.ts = floor(t / 10) and p.band = chan // 3 join jn q on q.ant = ant2 and q.ts = floor(t / 10) and q.band = chan // 3""", "v00_re v00_im v11_re", 4)  # fmt: skip
def jones_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J V J^H with both ends' matrices looked up by maps of times and channels."""
    v = cells(spark, sf_dir).withColumns({"ts": F.floor(F.col("t") / 10), "band": F.floor(F.col("chan") / 3)})
    at = v.select("ts", "band", F.explode(F.array("ant1", "ant2")).alias("ant")).distinct()
    j = at.withColumns({"a": 1 + F.col("ant") / 10 + F.col("ts") / 50, "b": 0.1 * F.col("ant"), "c": 0.05 * F.col("band"), "d": 1 - F.col("ant") / 20})
    for k in (1, 2):
        v = v.join(j.select("ts", "band", F.col("ant").alias(f"ant{k}"), *[F.col(x).alias(f"{x}{k}") for x in "abcd"]), ["ts", "band", f"ant{k}"])
    real = lambda c: Cx(c, F.lit(0.0))
    matrix = lambda k: ((real(F.col(f"a{k}")), real(F.col(f"b{k}"))), (real(F.col(f"c{k}")), real(F.col(f"d{k}"))))
    out = sandwich(matrix(1), ((cx("re", "im"), real(F.col("mre"))), (real(F.lit(0.2)), real(F.col("w") / 100))), matrix(2))
    return v.select("t", "chan", "ant1", "ant2", out[0][0].re.alias("v00_re"), out[0][0].im.alias("v00_im"), out[1][1].re.alias("v11_re"))


@query(f"with {VL}, {RB}, d as (select t, chan, ant1 as ant, avg(re) as d_re, avg(im) as d_im from rb where ant1 < ant2 group by all) select d.t, d.chan, d.ant, d.d_re - r.d_re as xy_re, d.d_im - r.d_im as xy_im, d.d_re + r.d_re as yx_re, d.d_im - r.d_im as yx_im, coalesce(d.d_re - n.d_re, d.d_re) as diff from d join d r on r.t = d.t and r.chan = d.chan and r.ant = 0 left join d n on n.t = d.t + 1 and n.chan = d.chan and n.ant = d.ant", "xy_re xy_im yx_re yx_im diff")
def reref_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakages against a reference antenna (subtracted from xy, its conjugate added to yx), and the difference to another table by name, absent ones as zero."""
    d = cells(spark, sf_dir).where("ant1 < ant2").groupBy("t", "chan", F.col("ant1").alias("ant")).agg(F.avg("re").alias("d_re"), F.avg("im").alias("d_im"))
    ref = d.where("ant = 0").select("t", "chan", F.col("d_re").alias("r_re"), F.col("d_im").alias("r_im"))
    other = d.select((F.col("t") - 1).alias("t"), "chan", "ant", F.col("d_re").alias("o_re"))
    xy, yx = cx("d_re", "d_im") - cx("r_re", "r_im"), cx("d_re", "d_im") + cx("r_re", "r_im").conj()
    x = d.join(ref, ["t", "chan"]).join(other, ["t", "chan", "ant"], "left")
    return x.select("t", "chan", "ant", xy.re.alias("xy_re"), xy.im.alias("xy_im"), yx.re.alias("yx_re"), yx.im.alias("yx_im"), (F.col("d_re") - F.coalesce("o_re", F.lit(0.0))).alias("diff"))


# ---------------------------------------------------------------- regions

#: Parts as convex outlines of four corners, anticlockwise.
QUAD = """q as (select p_partkey as id, p_partkey * 7 % 400 as x, p_partkey * 13 % 300 as y, 3 + p_size % 5 as a, 2 + p_partkey % 6 as b from part),
 h as (select id, 0::bigint as k, x, y from q union all select id, 1, x + a, y + 1 from q union all select id, 2, x + a, y + b + 1 from q union all select id, 3, x, y + b from q)"""
EDGES = "e as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from h window w as (partition by id order by k))"
PIX = f"""box as (select id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from h group by 1), cand as (select id, px, unnest(range(y0, y1 + 1)) as py from (select *, unnest(range(x0, x1 + 1)) as px from box)),
 pix as (select c.id, c.px as x, c.py as y from cand c join e on e.id = c.id group by 1, 2, 3 having bool_and((c.px - e.x) * (e.y - e.y2) + (c.py - e.y) * (e.x2 - e.x) >= 0))"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    q = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("id"), (p * 7 % 400).alias("x"), (p * 13 % 300).alias("y"), (3 + F.col("p_size") % 5).cast("bigint").alias("a"), (2 + p % 6).alias("b"))
    corner = lambda k, x, y: F.struct(F.lit(k).cast("bigint").alias("k"), x.alias("x"), y.alias("y"))
    x, y, a, b = (F.col(c) for c in "xyab")
    return q.select("id", F.explode(F.array(corner(0, x, y), corner(1, x + a, y + 1), corner(2, x + a, y + b + 1), corner(3, x, y + b))).alias("c")).select("id", "c.*")


#: Each part's nine points in no order, some of them equal or in a line.
POINTS = "pt as (select p_partkey as id, p_partkey * 7 % 400 + (j * 5 + p_partkey) % 9 as x, p_partkey * 13 % 300 + (j * j * 3 + p_partkey * j) % 7 as y from part, (select unnest(range(9)) as j))"


@query(f"""with {POINTS}, d as (select distinct * from pt), pair as (select a.id, a.x, a.y, b.x as x2, b.y as y2 from d a join d b on a.id = b.id and (a.x <> b.x or a.y <> b.y)),
 s as (select pair.*, (x2 - pair.x) * (c.y - pair.y) - (y2 - pair.y) * (c.x - pair.x) as side, (c.x - pair.x) * (c.x - x2) + (c.y - pair.y) * (c.y - y2) as along from pair join d c using (id))
 select id, x, y, x2, y2 from s group by all having bool_and(side > 0 or (side = 0 and along <= 0))""")  # fmt: skip
def region_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the convex outlines of unordered points."""
    p, j = F.col("p_partkey"), F.col("j")
    pts = spark.read.parquet(f"{sf_dir}/part.parquet").select(p, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))).alias("j"))
    pts = pts.select(p.alias("id"), (p * 7 % 400 + (j * 5 + p) % 9).alias("x"), (p * 13 % 300 + (j * j * 3 + p * j) % 7).alias("y"))
    return regions.edges(regions.hulls(pts)).select("id", "x", "y", "x2", "y2")


@query(f"with {QUAD}, {EDGES} select id, k, x, y, x2, y2, y - y2 as nx, x2 - x as ny from e")
def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.edges(outlines(spark, sf_dir))


@query(f"with {QUAD}, {EDGES}, {PIX}, s as (select id, abs(sum(x * y2 - x2 * y)) / 2.0::double as area from e group by 1) select id, area, count(*) as pixels from s join pix using (id) group by 1, 2")
def region_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.areas(outlines(spark, sf_dir))


@query(f"with {QUAD}, {EDGES}, {PIX} select * from pix")
def region_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.rasterised(outlines(spark, sf_dir))


@query(f"with {QUAD}, {EDGES}, {PIX} select id, x, y, 1.0::double / count(*) over (partition by x, y) as weight from pix", "weight")
def region_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.normalised(regions.rasterised(outlines(spark, sf_dir)))


@query(f"with {QUAD}, {EDGES}, {PIX}, w as (select id, x, y, 1.0::double / count(*) over (partition by x, y) as weight from pix) select x, y, sum((id % 10) * weight) as value from w group by 1, 2", "value")
def region_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regions.normalised(regions.rasterised(outlines(spark, sf_dir)))
    return regions.stitched(w.withColumn("value", F.col("id") % 10))


@query(f"""with {QUAD}, {EDGES}, b as (select id, min(x) - 0.25 as x0, max(x) + 0.25 as x1, min(y) - 0.25 as y0, max(y) + 0.25 as y1 from h group by 1), c as (select a.id as a, b.id as b from b a join b on a.id < b.id and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1),
 n as (select a, b, k + 4 * (id = b)::int as k, (y - y2) / sqrt((y - y2) ** 2 + (x2 - x) ** 2) as nx, (x2 - x) / sqrt((y - y2) ** 2 + (x2 - x) ** 2) as ny from c join e on e.id = a or e.id = b),
 pa as (select a, b, n.k, min(x * nx + y * ny) as lo, max(x * nx + y * ny) as hi from n join h on h.id = a group by all), pb as (select a, b, n.k, min(x * nx + y * ny) as lo, max(x * nx + y * ny) as hi from n join h on h.id = b group by all)
 select a, b from pa join pb using (a, b, k) group by 1, 2 having not bool_or(pb.lo - pa.hi > 0.5 or pa.lo - pb.hi > 0.5)""")  # fmt: skip
def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlapping(outlines(spark, sf_dir), 16)


@query(f"with {QUAD}, {EDGES}, p as (select c_custkey as point, c_custkey * 11 % 400 as px, c_custkey * 17 % 300 as py from customer) select e.id, p.point from p join e on px between e.x - 40 and e.x + 40 and py between e.y - 40 and e.y + 40 group by 1, 2 having count(*) = 4 and bool_and(((px - x) * (y - y2) + (py - y) * (x2 - x)) / sqrt((y - y2) ** 2 + (x2 - x) ** 2) >= -0.5)")
def region_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("point"), (k * 11 % 400).alias("x"), (k * 17 % 300).alias("y"))
    return regions.containing(outlines(spark, sf_dir), p, 16)


IMAGE = "im as (select c_custkey % 400 as x, c_custkey * 3 % 300 as y, sum(c_acctbal) as value from customer group by 1, 2)"


@query(f"with {QUAD}, {EDGES}, {PIX}, {IMAGE} select c.id, c.px as x, c.py as y, case when p.id is null or c.px > 399 or c.py > 299 then -1 else coalesce(im.value, 0) end as value from cand c left join pix p on p.id = c.id and p.x = c.px and p.y = c.py left join im on im.x = c.px and im.y = c.py", "value", 3)
def region_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    image = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy((k % 400).alias("x"), (k * 3 % 300).alias("y")).agg(F.sum("c_acctbal").alias("value"))
    return regions.extracted(outlines(spark, sf_dir), image, 400, 300, -1.0)


@query(f"with {QUAD}, b as (select id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, floor(avg(x))::bigint as cx, floor(avg(y))::bigint as cy from h group by 1), s as (select *, greatest(x1 - x0, y1 - y0) + 1 as n from b) select id, x0, x1 + (x1 - x0) % 2 as x1, y0, y1 + (y1 - y0) % 2 as y1, cx - n // 2 as sx0, cx + n - n // 2 - 1 + (n - 1) % 2 as sx1, cy - n // 2 as sy0, cy + n - n // 2 - 1 + (n - 1) % 2 as sy1 from s")
def box_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of odd sides along the axes, and square ones."""
    o = outlines(spark, sf_dir)
    square = regions.aligned(o, square=True).select("id", *[F.col(c).alias(f"s{c}") for c in ("x0", "x1", "y0", "y1")])
    return regions.aligned(o).join(square, "id")


@query(f"""with {QUAD}, b as (select id, min(x) - 2 as x0, max(x) + 2 as x1, min(y) - 2 as y0, max(y) + 2 as y1 from h group by 1), g as (select *, unnest(range(floor(x0 / 8)::bigint, floor(x1 / 8)::bigint + 1)) as gx from b), f as (select *, unnest(range(floor(y0 / 8)::bigint, floor(y1 / 8)::bigint + 1)) as gy from g)
 select id, greatest(x0, gx * 8) as x0, least(x1, gx * 8 + 7) as x1, greatest(y0, gy * 8) as y0, least(y1, gy * 8 + 7) as y1 from f""")  # fmt: skip
def box_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.split_boxes(regions.boxes(outlines(spark, sf_dir), 2), 8)
