"""Planar and spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def slope_percent(alt1: Column, alt2: Column, dist: Column) -> Column:
    """Signed slope in percent; null without altitudes, 0 without distance."""
    return F.when(alt1.isNull() | alt2.isNull(), F.lit(None).cast("double")).when(dist == 0, 0.0).otherwise(F.try_divide(alt2 - alt1, dist) * 100)


def utm31(lon: Column, lat: Column) -> Column:
    """struct<x,y>: ETRS89 / UTM zone 31N by the third-order Krueger series."""
    # The GRS80 ellipsoid and the zone.
    a, f, k0, lon0, east = 6378137.0, 1 / 298.257222101, 0.9996, 3.0, 500000.0
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    kappa = 2 * math.sqrt(n) / (1 + n)
    phi, dl = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(kappa) * F.atanh(F.lit(kappa) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, al in enumerate(alphas, 1):
        x = x + F.lit(al) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(al) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((F.lit(east) + F.lit(k0 * big) * x).alias("x"), (F.lit(k0 * big) * y).alias("y"))


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x1 + t * dx - px, y1 + t * dy - py)


def segment_in_circle(cx: Column, cy: Column, r: Column | float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of the part of a segment inside a circle."""
    r = F.lit(float(r)) if isinstance(r, (int, float)) else r
    ux, uy, dx, dy = x1 - cx, y1 - cy, x2 - x1, y2 - y1
    a, b, c = dx * dx + dy * dy, 2 * (ux * dx + uy * dy), ux * ux + uy * uy - r * r
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0, t1 = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    inside = F.sqrt(a) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), t1) - F.greatest(F.lit(0.0), t0))
    return F.when((a == 0) | (disc <= 0), 0.0).otherwise(inside)


def circle_edge_area(cx: Column, cy: Column, r: Column | float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """What one directed ring edge adds to the area of circle and polygon; the sum's absolute value is the area."""
    r = F.lit(float(r)) if isinstance(r, (int, float)) else r
    px, py, qx, qy = x1 - cx, y1 - cy, x2 - cx, y2 - cy
    dx, dy = qx - px, qy - py
    a, b, c = dx * dx + dy * dy, 2 * (px * dx + py * dy), px * px + py * py - r * r
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0, t1 = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    cross = lambda ax, ay, bx, by: ax * by - ay * bx
    angle = lambda ax, ay, bx, by: F.atan2(cross(ax, ay, bx, by), ax * bx + ay * by)
    ta, tb = F.greatest(F.lit(0.0), t0), F.least(F.lit(1.0), t1)
    ax, ay, bx, by = px + ta * dx, py + ta * dy, px + tb * dx, py + tb * dy
    half = r * r / 2
    outside = half * angle(px, py, qx, qy)
    through = F.when(t0 > 0, half * angle(px, py, ax, ay)).otherwise(0.0) + cross(ax, ay, bx, by) / 2 + F.when(t1 < 1, half * angle(bx, by, qx, qy)).otherwise(0.0)
    return F.when(a == 0, 0.0).when((disc <= 0) | (t1 <= 0) | (t0 >= 1), outside).otherwise(through)


def crosses_up(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ray from a point to the right crosses an edge."""
    return ((y1 > py) != (y2 > py)) & (px < F.coalesce(F.try_divide((x2 - x1) * (py - y1), y2 - y1), F.lit(0.0)) + x1)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting over a closed ring array<struct<x,y>>."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))
    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses_up(px, py, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q"))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e["p"]["x"] * e["q"]["y"] - e["p"]["y"] * e["q"]["x"])) / 2


def box_overlap(minx1, miny1, maxx1, maxy1, minx2, miny2, maxx2, maxy2) -> Column:
    """Common area of two boxes."""
    return F.greatest(F.lit(0.0), F.least(maxx1, maxx2) - F.greatest(minx1, minx2)) * F.greatest(F.lit(0.0), F.least(maxy1, maxy2) - F.greatest(miny1, miny2))


def centrality_scores(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, Column]:
    """(closeness to the centre of the bounds as 0 to 1, the inverse)."""
    cx, cy = (minx + maxx) / 2, (miny + maxy) / 2
    d = F.hypot(x - cx, y - cy)
    top = F.hypot(maxx - cx, maxy - cy)
    near = F.lit(1.0) - F.least(F.coalesce(F.try_divide(d, top), F.lit(0.0)), F.lit(1.0))
    return near, F.lit(1.0) - near
