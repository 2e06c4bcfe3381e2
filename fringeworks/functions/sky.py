"""Directions, spectra, shapes and angles as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = 299792458.0
#: Seconds between the origin of modified Julian days and 1970.
MJD_EPOCH = 3506716800.0


def radec_to_lm(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Orthographic (SIN) projection about a phase centre; angles in radians."""
    d = ra - ra0
    return F.cos(dec) * F.sin(d), F.sin(dec) * math.cos(dec0) - F.cos(dec) * math.sin(dec0) * F.cos(d)


def power_law(freq: Column, freq0: Column, terms: list[Column]) -> Column:
    """(f / f0) ** sum of a_n log10(f / f0) ** n; flat without terms."""
    if not terms:
        return F.lit(1.0)
    x, power = F.log10(freq / freq0), terms[-1]
    for a in reversed(terms[:-1]):
        power = power * x + a
    return F.pow(freq / freq0, power)


def gaussian_shape(ex: Column, ey: Column, pa: Column) -> tuple[Column, Column, Column]:
    """Projections of the major axis, and the ratio of the axes (1 for a point)."""
    return ex * F.sin(pa), ex * F.cos(pa), F.when(ex == 0, 1.0).otherwise(ey / F.when(ex != 0, ex))


def parallactic_angle(hour: Column, dec: float, latitude: Column) -> Column:
    """Closed form on a sphere; no precession, nutation or refraction."""
    return F.atan2(F.cos(latitude) * F.sin(hour), F.sin(latitude) * math.cos(dec) - F.cos(latitude) * math.sin(dec) * F.cos(hour))


def mjd_to_utc(seconds: Column) -> Column:
    return F.timestamp_micros(F.round((seconds - MJD_EPOCH) * 1e6).cast("bigint"))


def nearest(value: Column, bands: list[float]) -> Column:
    """The nearest of a short list; a tie goes to the lower."""
    return F.array_min(F.array(*[F.struct(F.abs(value - b).alias("d"), F.lit(float(b)).alias("b")) for b in bands]))["b"]
