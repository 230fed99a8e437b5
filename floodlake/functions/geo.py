"""Geographic scalar functions as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E1 = E2**0.5
B = A * (1 - FLATTENING)
# UTM.
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
# True parallel and middle longitude of the polar stereographic codes.
POLAR = {3413: (70.0, -45.0), 3031: (-71.0, 0.0)}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def authalic(lat: Column) -> Column:
    """Area in m2 of a strip one radian wide from the equator to a latitude in degrees."""
    s = F.sin(F.radians(lat))
    return B * B / 2 * (s / (1 - E2 * s * s) + F.log((1 + E1 * s) / (1 - E1 * s)) / (2 * E1))


def rectangle_km2(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area on the ellipsoid of a rectangle in degrees; 0 if it is empty."""
    return F.when((x1 > x0) & (y1 > y0), F.radians(x1 - x0) * (authalic(y1) - authalic(y0)) / 1e6).otherwise(F.lit(0.0))


def ring_km2(xs: Column, ys: Column) -> Column:
    """Area of a closed ring in degrees (first point not repeated): each edge's strip at the mean of its ends."""
    n = F.size(xs)
    q = F.transform(ys, authalic)
    after = lambda a: F.concat(F.slice(a, 2, n - 1), F.slice(a, 1, 1))
    strips = F.zip_with(F.zip_with(after(xs), xs, lambda b, a: F.radians(b - a)), F.zip_with(after(q), q, lambda b, a: (a + b) / 2), lambda w, h: w * h)
    return F.abs(F.aggregate(strips, F.lit(0.0), lambda s, x: s + x)) / 1e6


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the local metric projection at a centroid; polar caps have their own."""
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1))
    return F.when(lat >= 84, F.lit(3413)).when(lat <= -80, F.lit(3031)).otherwise(F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone)


def utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krüger series to the fourth power of the third flattening; null for polar codes."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    s = F.sin(F.radians(lat))
    c = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    middle = (F.pmod(epsg, F.lit(100)) - 1) * 6 - 180 + 3
    d = F.radians(lon - middle)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = reduce(lambda s_, k: s_ + alpha[k - 1] * F.cos(2 * k * xi) * F.sinh(2 * k * eta), range(1, 5), eta)
    north = reduce(lambda s_, k: s_ + alpha[k - 1] * F.sin(2 * k * xi) * F.cosh(2 * k * eta), range(1, 5), xi)
    shift = F.when(epsg >= 32700, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))
    zoned = (epsg >= 32601) & (epsg <= 32760)
    return F.when(zoned, FALSE_EASTING + SCALE * radius * east), F.when(zoned, shift + SCALE * radius * north)


def lon_lat(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates, the reverse of ``utm`` by the same series; null for polar codes."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    shift = F.when(epsg >= 32700, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))
    xi, eta = (north - shift) / (SCALE * radius), (east - FALSE_EASTING) / (SCALE * radius)
    steep = reduce(lambda s_, k: s_ - beta[k - 1] * F.sin(2 * k * xi) * F.cosh(2 * k * eta), range(1, 5), xi)
    wide = reduce(lambda s_, k: s_ - beta[k - 1] * F.cos(2 * k * xi) * F.sinh(2 * k * eta), range(1, 5), eta)
    chi = F.asin(F.sin(steep) / F.cosh(wide))
    lat = reduce(lambda s_, k: s_ + delta[k - 1] * F.sin(2 * k * chi), range(1, 5), chi)
    middle = (F.pmod(epsg, F.lit(100)) - 1) * 6 - 180 + 3
    zoned = (epsg >= 32601) & (epsg <= 32760)
    return F.when(zoned, middle + F.degrees(F.atan2(F.sinh(wide), F.cos(steep)))), F.when(zoned, F.degrees(lat))


def _colatitude(sine: float | Column) -> float | Column:
    """tan(45 degrees - half the conformal latitude) of a latitude towards the pole, from its sine."""
    power = lambda x, y: F.pow(x, F.lit(y)) if isinstance(x, Column) else x**y
    return power((1 - sine) / (1 + sine), 0.5) * power((1 + E1 * sine) / (1 - E1 * sine), E1 / 2)


def _caps(epsg: Column) -> list[tuple[Column, float, float, float]]:
    """Per polar code: whether it is meant, its sign, middle longitude, and metres from the pole per ``_colatitude``."""
    out = []
    for code, (parallel, middle) in POLAR.items():
        sine = math.sin(math.radians(parallel))
        out.append((epsg == code, 1.0 if parallel > 0 else -1.0, middle, A * math.cos(math.radians(parallel)) / math.sqrt(1 - E2 * sine * sine) / _colatitude(abs(sine))))
    return out


def polar(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing of the polar stereographic codes; null for other codes."""
    east, north = F.lit(None).cast("double"), F.lit(None).cast("double")
    for meant, sign, middle, scale in _caps(epsg):
        away, turn = scale * _colatitude(sign * F.sin(F.radians(lat))), F.radians(lon - middle)
        east, north = F.when(meant, away * F.sin(turn)).otherwise(east), F.when(meant, -sign * away * F.cos(turn)).otherwise(north)
    return east, north


def polar_lon_lat(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of polar stereographic coordinates, the reverse of ``polar``; null for other codes."""
    lon, lat = F.lit(None).cast("double"), F.lit(None).cast("double")
    # From the conformal latitude by the series in the eccentricity.
    series = (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 7 * E2**3 / 120 + 81 * E2**4 / 1120, 4279 * E2**4 / 161280)
    for meant, sign, middle, scale in _caps(epsg):
        chi = math.pi / 2 - 2 * F.atan(F.hypot(east, north) / scale)
        steep = reduce(lambda s_, k: s_ + series[k - 1] * F.sin(2 * k * chi), range(1, 5), chi)  # noqa: B023
        turned = F.degrees(F.atan2(east, -sign * north)) + middle
        lon = F.when(meant, F.when(turned < -180, turned + 360).when(turned > 180, turned - 360).otherwise(turned)).otherwise(lon)
        lat = F.when(meant, sign * F.degrees(steep)).otherwise(lat)
    return lon, lat


def metric(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing by the code that ``utm_epsg`` gives, zones and polar caps alike."""
    return tuple(F.coalesce(a, b) for a, b in zip(utm(lon, lat, epsg), polar(lon, lat, epsg), strict=True))


def degrees(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """The reverse of ``metric``."""
    return tuple(F.coalesce(a, b) for a, b in zip(lon_lat(east, north, epsg), polar_lon_lat(east, north, epsg), strict=True))


def speed_kmh(text: Column, default: Column) -> Column:
    """A posted speed: the first part before ";", digits and dots only, miles converted; else the default."""
    first = F.lower(F.trim(F.split(text, ";")[0]))
    number = F.regexp_replace(first, "[^0-9.]", "").try_cast("double")
    value = F.when(first.contains("mph"), number * 1.609344).otherwise(number)
    return F.when(value > 0, value).otherwise(default)
