"""Gains: look-up on baselines, inversion, correction, corruption, baseline-based gains, and a fixed-iteration fit in SQL operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx, cx


def with_gains(vis: DataFrame, gains: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Gains of both ends, gp_re .. gq_im; gains has (keys, ant, g_re, g_im). Adaptive execution broadcasts gains where they turn out to be small; else the joins shuffle by key and antenna."""
    keys = keys or []
    for end, ant in (("gp", "ant1"), ("gq", "ant2")):
        g = gains.select(*keys, F.col("ant").alias(ant), F.col("g_re").alias(f"{end}_re"), F.col("g_im").alias(f"{end}_im"))
        vis = vis.join(g, [*keys, ant])
    return vis


def with_interval_gains(vis: DataFrame, gains: DataFrame, t_int: int, f_int: int, directions: int) -> DataFrame:
    """Gains of both ends at a sample's interval and direction: gains has (ti, fi, gdir, ant, g_re, g_im) and a direction d takes gdir = d mod directions."""
    keyed = vis.withColumns({"ti": F.floor(F.col("t") / t_int), "fi": F.floor(F.col("chan") / f_int), "gdir": F.col("dir") % directions})
    return with_gains(keyed, gains, ["ti", "fi", "gdir"])


def corrupted_sum(vis: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over directions of gp m conj(gq) for each sample: keys, k_re, k_im."""
    m = cx("gp_re", "gp_im") * cx("mre", "mim") * cx("gq_re", "gq_im").conj()
    return vis.groupBy(*keys).agg(F.sum(m.re).alias("k_re"), F.sum(m.im).alias("k_im"))


def corrected(vis: DataFrame) -> DataFrame:
    """c = d / (gp conj(gq)); where the product is zero there is no correction."""
    g = cx("gp_re", "gp_im") * cx("gq_re", "gq_im").conj()
    ok = g.abs2() > 0
    c = cx("re", "im").over(Cx(F.when(ok, g.re), F.when(ok, g.im)))
    return vis.withColumns({"c_re": c.re, "c_im": c.im})


def corrupted(vis: DataFrame) -> DataFrame:
    """gp m conj(gq), and the residual."""
    m = cx("gp_re", "gp_im") * cx("mre", "mim") * cx("gq_re", "gq_im").conj()
    return vis.withColumns({"k_re": m.re, "k_im": m.im, "r_re": F.col("re") - m.re, "r_im": F.col("im") - m.im})


def baseline_gains(vis: DataFrame, by: list[str]) -> DataFrame:
    """Sum of m conj(d) over sum of |d|^2 by baseline, 1 where there is no data."""
    n, d = cx("mre", "mim") * cx("re", "im").conj(), cx("re", "im").abs2()
    out = vis.groupBy(*by).agg(F.sum(n.re).alias("nr"), F.sum(n.im).alias("ni"), F.sum(d).alias("dd"))
    unit = F.col("dd") == 0
    return out.select(*by, F.when(unit, 1.0).otherwise(F.col("nr") / F.col("dd")).alias("g_re"), F.when(unit, 0.0).otherwise(F.col("ni") / F.col("dd")).alias("g_im"))


def scalar_gains(both: DataFrame, iterations: int = 2) -> DataFrame:
    """Real gain by antenna: g_p = sum d g_q m / sum (g_q m)^2 over its baselines (rows from both ends); each even iteration takes the mean with the one before. The gains are a row an antenna."""
    g = both.select(F.col("ant1").alias("ant")).distinct().withColumn("g", F.lit(1.0))
    for k in range(1, iterations + 1):
        x = both.join(F.broadcast(g.select(F.col("ant").alias("ant2"), "g")), "ant2")
        m = F.col("g") * F.col("mre")
        new = x.groupBy(F.col("ant1").alias("ant")).agg((F.sum(F.col("re") * m) / F.sum(m * m)).alias("u"))
        g = new.join(F.broadcast(g), "ant").select("ant", ((F.col("u") + F.col("g")) / 2 if k % 2 == 0 else F.col("u")).alias("g"))
    return g


def hand_phase(vis: DataFrame, by: list[str]) -> DataFrame:
    """pzd: the phase of the sum of d conj(m) / |m| over XY (corr 1) and the conjugate of YX (corr 2); 0 without data, samples without a model don't count."""
    m = cx("mre", "mim")
    d = cx("re", "im") * m.conj()
    size = F.when(m.abs() > 0, m.abs())
    im = F.when(F.col("corr") == 1, d.im).otherwise(-d.im) / size
    return vis.where("corr in (1, 2)").groupBy(*by).agg(F.coalesce(F.atan2(F.sum(im), F.sum(d.re / size)), F.lit(0.0)).alias("pzd"))
