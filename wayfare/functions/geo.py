"""Geodesic and angular column expressions. Every argument is a Column or a column name; metres and
degrees throughout. A null argument gives null (``least`` and ``greatest`` skip nulls, so clipped terms
are guarded)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def known(*cs: Column) -> Column:
    out = cs[0].isNotNull()
    for c in cs[1:]:
        out = out & c.isNotNull()
    return out


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite: null is the only missing value inside the library."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    a, b, c, d = map(col, (lon1, lat1, lon2, lat2))
    half = lambda x, y: F.sin(F.radians(y - x) / 2)
    h = half(b, d) * half(b, d) + F.cos(F.radians(b)) * F.cos(F.radians(d)) * half(a, c) * half(a, c)
    return F.when(known(a, b, c, d), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Forward azimuth in [0, 360); null if the points coincide."""
    a, b, c, d = map(col, (lon1, lat1, lon2, lat2))
    p, q, dl = F.radians(b), F.radians(d), F.radians(c - a)
    y = F.sin(dl) * F.cos(q)
    x = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)
    still = (F.abs(x) < 1e-12) & (F.abs(y) < 1e-12)
    return F.when(known(a, b, c, d) & ~still, F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)))


def angle_diff_deg(a, b) -> Column:
    """Absolute difference of two directions, in [0, 180]."""
    return F.abs(F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0)


def planar_turn_deg(x0, y0, x1, y1, x2, y2) -> Column:
    """Angle between the legs into and out of a point on the plain degree grid; null if a leg is null or zero."""
    x0, y0, x1, y1, x2, y2 = map(col, (x0, y0, x1, y1, x2, y2))
    ux, uy, vx, vy = x1 - x0, y1 - y0, x2 - x1, y2 - y1
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cos = (ux * vx + uy * vy) / (nu * nv)
    ok = known(x0, y0, x1, y1, x2, y2) & (nu >= 1e-12) & (nv >= 1e-12)
    return F.when(ok, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def point_segment_m(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Distance of a point to a segment on the local equirectangular plane around the point."""
    lon, lat, lon1, lat1, lon2, lat2 = map(col, (lon, lat, lon1, lat1, lon2, lat2))
    kx = DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    ax, ay = (lon1 - lon) * kx, (lat1 - lat) * DEGREE_M
    dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * DEGREE_M
    n = dx * dx + dy * dy
    t = F.when(n > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / n))).otherwise(0.0)
    px, py = ax + t * dx, ay + t * dy
    return F.when(known(lon, lat, lon1, lat1, lon2, lat2), F.sqrt(px * px + py * py))


def metres_to_degrees(radius: float, lat=None) -> Column:
    """Degrees that cover a radius in metres: of latitude, or of longitude at a latitude."""
    if lat is None:
        return F.lit(radius / DEGREE_M)
    return radius / (DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians(col(lat)))))


def mix(a, b, share) -> Column:
    """a at share 0, b at share 1."""
    a, b, share = map(col, (a, b, share))
    return a + (b - a) * share
