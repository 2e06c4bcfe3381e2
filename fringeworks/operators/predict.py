"""Model visibilities of catalogued sources by direct Fourier sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx
from ..functions.sky import C

#: A catalogue beyond so many sources has to be clustered first: each sample meets each of them.
MAX_SOURCES = 100_000


def _checked(sources: DataFrame) -> DataFrame:
    if sources.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: cluster them")
    return sources.withColumn("n1", F.sqrt(1 - F.col("l") * F.col("l") - F.col("m") * F.col("m")) - 1)


def _sums(sky: str, parts: list[str], freq0: float) -> Column:
    """Sums over the sources of an array, for each of parts (their fluxes): part times spectrum and shape times exp(-2 pi i (u l + v m + w (n - 1)) f / c), a struct of <part>_re and <part>_im. What
    sources share is computed once: an array of amplitudes and phases, one of their cosines and sines, then the sums."""
    k = math.pi / C
    f = F.col("freq")

    def seen(s: Column) -> Column:
        major = (F.col("u") * s["lx"] + F.col("v") * s["mx"]) * f * k
        minor = (F.col("u") * s["mx"] - F.col("v") * s["lx"]) * s["ratio"] * f * k
        size = F.pow(f / freq0, s["alpha"]) * F.exp(-(major * major + minor * minor) / (4 * math.log(2)))
        phase = -2 * (F.col("u") * s["l"] + F.col("v") * s["m"] + F.col("w_m") * s["n1"]) * f * k
        return F.struct(size.alias("a"), phase.alias("p"), *[s[x].alias(x) for x in parts])

    turned = F.transform(F.transform(sky, seen), lambda s: F.struct((s["a"] * F.cos(s["p"])).alias("re"), (s["a"] * F.sin(s["p"])).alias("im"), *[s[x].alias(x) for x in parts]))
    zero = F.struct(*[F.lit(0.0).alias(f"{x}_{c}") for x in parts for c in ("re", "im")])
    return F.aggregate(turned, zero, lambda acc, s: F.struct(*[(acc[f"{x}_{c}"] + s[x] * s[c]).alias(f"{x}_{c}") for x in parts for c in ("re", "im")]))


_SHAPE = ("l", "m", "n1", "alpha", "lx", "mx", "ratio")


def predicted(vis: DataFrame, sources: DataFrame, keep: list[str], freq0: float = 1e9) -> DataFrame:
    """Sum over sources of their flux, by spectrum and shape, for each sample; vis has u, v, w_m (metres) and freq, sources l, m, flux, and alpha (spectral index), lx, mx (projections of the major
    axis) and ratio of a Gaussian's axes, 0, 0 and 1 for a point. The catalogue goes as one array to every task, its size checked; samples never shuffle."""
    sky = _checked(sources).agg(F.collect_list(F.struct(*_SHAPE, "flux")).alias("_sky"))
    out = vis.join(F.broadcast(sky)).withColumn("_m", _sums("_sky", ["flux"], freq0))
    return out.select(*keep, F.col("_m.flux_re").alias("m_re"), F.col("_m.flux_im").alias("m_im"))


def predicted_brightness(vis: DataFrame, sources: DataFrame, keep: list[str], circular: bool = False, freq0: float = 1e9) -> DataFrame:
    """keep, dir, corr (0 to 3), m_re, m_im: the 2 x 2 brightness of polarised sources as each sample sees it, direction by direction. sources are those of predicted() with i, q, u, v (Stokes
    fluxes) instead of flux, and dir. Linear feeds: ((I + Q, U + iV), (U - iV, I - Q)); circular ones: ((I + V, Q + iU), (Q - iU, I - V)). Arrays of all directions are checked together."""
    named = _checked(sources).select("dir", *_SHAPE, *[F.col(x).alias(f"s{x}") for x in "iquv"])
    sky = named.groupBy("dir").agg(F.collect_list(F.struct(*_SHAPE, *[f"s{x}" for x in "iquv"])).alias("_sky"))
    out = vis.join(F.broadcast(sky)).withColumn("_m", _sums("_sky", [f"s{x}" for x in "iquv"], freq0))
    stokes = {x: Cx(F.col(f"_m.s{x}_re"), F.col(f"_m.s{x}_im")) for x in "iquv"}
    i = stokes["i"]
    a, b, c = (stokes[x] for x in ("vqu" if circular else "quv"))
    turned = Cx(-c.im, c.re)
    cells = F.array(*[F.struct(F.lit(k).cast("bigint").alias("corr"), x.re.alias("m_re"), x.im.alias("m_im")) for k, x in enumerate((i + a, b + turned, b - turned, i - a))])
    return out.select(*keep, "dir", F.explode(cells).alias("x")).select(*keep, "dir", "x.*")


def grouped(sources: DataFrame) -> DataFrame:
    """Sources by cluster tag, beam and type (point or gaussian): their number and flux."""
    kind = F.when(F.col("ex") > 0, "gaussian").otherwise("point")
    return sources.groupBy("tag", "beam", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("flux"), F.min("id").alias("first"))


def clusters(sources: DataFrame, step: float) -> DataFrame:
    """Sources of a cell of the sky become one of their summed flux at their mean place, with their mean spectral index, weighted by flux."""
    g = sources.groupBy(F.floor(F.col("l") / step).alias("cl"), F.floor(F.col("m") / step).alias("cm"))
    mean = lambda c: (F.sum(F.col(c) * F.col("flux")) / F.sum("flux")).alias(c)
    return g.agg(mean("l"), mean("m"), mean("alpha"), F.sum("flux").alias("flux"), F.count(F.lit(1)).alias("n"))
