"""Lambert azimuthal equal-area projection on the WGS84 ellipsoid, as Column formulas.

The formulas are those of Snyder, Map Projections: A Working Manual (1987), section 24.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


def _q(s: float) -> float:
    return (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(E * s) / E)


QP = _q(1.0)


def _q_col(s: Column) -> Column:
    return (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(E * s) / E)


def _centre(lat_0: float) -> tuple[float, float, float]:
    """(beta, Rq, D) of an oblique centre."""
    phi = math.radians(lat_0)
    beta = math.asin(_q(math.sin(phi)) / QP)
    rq = A * math.sqrt(QP / 2)
    m = math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)
    return beta, rq, A * m / (rq * math.cos(beta))


def project(lon: Column, lat: Column, lon_0: float = 0.0, lat_0: float = 90.0) -> tuple[Column, Column]:
    """x and y in metres of a longitude and latitude in degrees."""
    lam = F.radians(F.pmod(lon - lon_0 + 180.0, F.lit(360.0)) - 180.0)
    q = _q_col(F.sin(F.radians(lat)))
    if abs(lat_0) == 90:
        sign = 1.0 if lat_0 > 0 else -1.0
        rho = A * F.sqrt(F.greatest(QP - sign * q, F.lit(0.0)))
        return rho * F.sin(lam), -sign * rho * F.cos(lam)
    b0, rq, d = _centre(lat_0)
    beta = F.asin(q / QP)
    common = math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(lam)
    b = rq * F.sqrt(2.0 / (1.0 + common))
    return b * d * F.cos(beta) * F.sin(lam), b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(lam))


def unproject(x: Column, y: Column, lon_0: float = 0.0, lat_0: float = 90.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point in metres; the centre returns itself."""
    if abs(lat_0) == 90:
        sign = 1.0 if lat_0 > 0 else -1.0
        beta = sign * F.asin(1.0 - (x * x + y * y) / (A * A * QP))
        lam = F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.atan2(x, -sign * y))
    else:
        b0, rq, d = _centre(lat_0)
        rho = F.sqrt(F.pow(x / d, 2) + F.pow(d * y, 2))
        c = 2.0 * F.asin(F.least(rho / (2 * rq), F.lit(1.0)))
        ratio = F.when(rho > 0, d * y * F.sin(c) / rho).otherwise(0.0)
        beta = F.asin(F.cos(c) * math.sin(b0) + ratio * math.cos(b0))
        lam = F.when(rho > 0, F.atan2(x * F.sin(c), d * rho * math.cos(b0) * F.cos(c) - d * d * y * math.sin(b0) * F.sin(c))).otherwise(0.0)
    phi = (
        beta
        + (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040) * F.sin(2 * beta)
        + (23 * E2**2 / 360 + 251 * E2**3 / 3780) * F.sin(4 * beta)
        + (761 * E2**3 / 45360) * F.sin(6 * beta)
    )
    return F.pmod(F.degrees(lam) + lon_0 + 180.0, F.lit(360.0)) - 180.0, F.degrees(phi)


def degrees_from_text(text: Column) -> Column:
    """'60 15.5 S' to -60.258...: degrees, minutes and a letter, south and west negative."""
    parts = F.split(F.trim(text), r"\s+")
    size = F.try_element_at(parts, F.lit(1)).cast("double") + F.try_element_at(parts, F.lit(2)).cast("double") / 60
    return F.when(F.upper(F.try_element_at(parts, F.lit(3))).isin("S", "W"), -size).otherwise(size)
