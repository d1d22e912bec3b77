"""Spatial joins on grid cells: every join is an equi-join, never all pairs.

Points fall into square cells. Within a radius r only the nine cells of side r
around a point can hold partners; boxes are listed under every cell that they
touch. Counts are 0 and distances null where nothing matches.

Aggregates around points are made once per place, however many points share it. A side
of a join goes to every task only if its rows have been counted, as the size of a file
says little about the rows under all their cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


#: Fixed value: the places, boxes or features up to which a counted side of a join is sent to every task.
FEW = 50_000


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def around(points: DataFrame, size: float) -> DataFrame:
    """Each point under the nine cells around it: columns cx, cy."""
    near = F.sequence(F.lit(-1), F.lit(1))
    return points.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("cx", _cell(F.col("x"), size) + F.col("_i")).withColumn("cy", _cell(F.col("y"), size) + F.col("_j")).drop("_i", "_j")


def meet_on_grid(a: DataFrame, a_cells: DataFrame, b: DataFrame, b_cells: DataFrame) -> DataFrame:
    """Both sides under their cells joined on cx, cy; the one with at most ``FEW`` rows before that is broadcast."""
    if a.count() <= FEW:
        return b_cells.join(F.broadcast(a_cells), ["cx", "cy"])
    if b.count() <= FEW:
        return a_cells.join(F.broadcast(b_cells), ["cx", "cy"])
    return a_cells.hint("merge").join(b_cells, ["cx", "cy"])


def within_radius(points: DataFrame, features: DataFrame, radius: float) -> DataFrame:
    """Pairs (id, fid, dist, and the features' other columns) at most ``radius`` apart.

    points: id, x, y. features: fid, fx, fy, ... A pair meets in one cell.
    """
    left = around(points.select("id", "x", "y"), radius)
    right = features.withColumn("cx", _cell(F.col("fx"), radius)).withColumn("cy", _cell(F.col("fy"), radius))
    d = geo.distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))
    return left.join(right, ["cx", "cy"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("cx", "cy", "x", "y")


def aggregate_within(points: DataFrame, features: DataFrame, radius: float, aggs: list[Column], zero: list[str] = ()) -> DataFrame:
    """All points with aggregates of the features within ``radius``; columns in ``zero`` are 0 where none is."""
    spots = points.select("x", "y").distinct()
    right = features.withColumn("cx", _cell(F.col("fx"), radius)).withColumn("cy", _cell(F.col("fy"), radius))
    pairs = meet_on_grid(spots, around(spots, radius), features, right).withColumn("dist", geo.distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))).where(F.col("dist") <= radius)
    got = pairs.groupBy("x", "y").agg(*aggs)
    return points.select("id", "x", "y").join(got, ["x", "y"], "left").drop("x", "y").fillna(0, list(zero))


def nearest(points: DataFrame, features: DataFrame, size: float, exclude_self: bool = False) -> DataFrame:
    """(id, fid, dist) of the nearest feature, the smallest fid among equals; null without features.

    Rounds of growing radius: a match within the radius is final, the rest goes
    on. Each round is an equi-join on cells and ends in a checkpoint; few points
    see more than one. The radius stops growing when it spans both tables.
    """
    ends = lambda df, x, y: df.agg(*[f(c) for c in (x, y) for f in (F.min, F.max)]).first()
    p, f = ends(points, "x", "y"), ends(features, "fx", "fy")
    if f[0] is None or p[0] is None:
        return points.select("id", F.lit(None).cast(features.schema["fid"].dataType).alias("fid"), F.lit(None).cast("double").alias("dist"))
    span = max(max(p[1], f[1]) - min(p[0], f[0]), max(p[3], f[3]) - min(p[2], f[2])) * 1.5 + size
    rest, found, r = points.select("id", "x", "y"), None, float(size)
    while True:
        pairs = within_radius(rest, features.select("fid", "fx", "fy"), r)
        if exclude_self:
            pairs = pairs.where("id <> fid")
        best = pairs.groupBy("id").agg(F.min(F.struct("dist", "fid")).alias("b"))
        got = rest.join(best, "id", "left").select("id", "x", "y", "b.fid", "b.dist").checkpoint()
        done = got.where("dist is not null").select("id", "fid", "dist")
        found = done if found is None else found.unionByName(done)
        rest = got.where("dist is null").select("id", "x", "y")
        if r > span or rest.isEmpty():
            break
        r *= 3
    return points.select("id").join(found, "id", "left")


def nearest_segment(points: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """(id, dist) to the nearest segment (x1, y1, x2, y2); null without segments.

    Rounds of growing radius like :func:`nearest`; a segment stands under the cells of its box grown by the
    radius, and each round's cells are as large as its radius.
    """
    box = segments.agg(*[f(F.least(a, b) if f is F.min else F.greatest(a, b)) for a, b in (("x1", "x2"), ("y1", "y2")) for f in (F.min, F.max)]).first()
    own = points.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    if box[0] is None or own[0] is None:
        return points.select("id", F.lit(None).cast("double").alias("dist"))
    span = max(max(own[1], box[1]) - min(own[0], box[0]), max(own[3], box[3]) - min(own[2], box[2])) * 1.5 + size
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    boxed = segments.select("x1", "y1", "x2", "y2", F.least(x1, x2).alias("minx"), F.least(y1, y2).alias("miny"), F.greatest(x1, x2).alias("maxx"), F.greatest(y1, y2).alias("maxy"))
    rest, found, r = points.select("id", "x", "y"), None, float(size)
    while True:
        p = rest.withColumn("cx", _cell(F.col("x"), r)).withColumn("cy", _cell(F.col("y"), r))
        met = p.join(boxes_on_grid(boxed, r, r), ["cx", "cy"]).withColumn("dist", geo.point_segment_distance(F.col("x"), F.col("y"), x1, y1, x2, y2))
        best = met.where(F.col("dist") <= r).groupBy("id").agg(F.min("dist").alias("dist"))
        got = rest.join(best, "id", "left").checkpoint()
        done = got.where("dist is not null").select("id", "dist")
        found = done if found is None else found.unionByName(done)
        rest = got.where("dist is null").select("id", "x", "y")
        if r > span or rest.isEmpty():
            return points.select("id").join(found, "id", "left")
        r *= 3


def line_length_within(points: DataFrame, segments: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """(id, length, any_line): length of the segments (x1, y1, x2, y2) inside each point's circle.

    A segment is listed under the cells of its bounding box grown by the
    radius, so that each point meets it in the point's own cell.
    """
    cell = cell or 2 * radius
    lo = lambda a, b: _cell(F.least(a, b) - radius, cell)
    hi = lambda a, b: _cell(F.greatest(a, b) + radius, cell)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    seg = segments.withColumn("cx", F.explode(F.sequence(lo(x1, x2), hi(x1, x2)))).withColumn("cy", F.explode(F.sequence(lo(y1, y2), hi(y1, y2))))
    spots = points.select("x", "y").distinct()
    pts = spots.select("x", "y", _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"))
    boxed = lambda v, a, b: (v >= F.least(a, b) - radius) & (v <= F.greatest(a, b) + radius)
    got = meet_on_grid(spots, pts, segments, seg).where(boxed(F.col("x"), x1, x2) & boxed(F.col("y"), y1, y2))
    near = geo.point_segment_distance(F.col("x"), F.col("y"), x1, y1, x2, y2) <= radius
    got = got.select("x", "y", geo.segment_in_circle(F.col("x"), F.col("y"), radius, x1, y1, x2, y2).alias("len"), near.cast("int").alias("near"))
    got = got.groupBy("x", "y").agg(F.sum("len").alias("length"), F.max("near").alias("any_line"))
    return points.select("id", "x", "y").join(got, ["x", "y"], "left").drop("x", "y").fillna(0, ["length", "any_line"])


def boxes_on_grid(boxes: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """Boxes (minx, miny, maxx, maxy) under every cell that they touch."""
    return boxes.withColumn("cx", F.explode(F.sequence(_cell(F.col("minx") - grow, cell), _cell(F.col("maxx") + grow, cell)))).withColumn(
        "cy", F.explode(F.sequence(_cell(F.col("miny") - grow, cell), _cell(F.col("maxy") + grow, cell)))
    )


def point_in_box(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """All points with the zone (zid) of the half-open box that holds them; the smallest zid among several."""
    p = points.withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))
    hit = p.join(boxes_on_grid(boxes, cell), ["cx", "cy"]).where("x >= minx and x < maxx and y >= miny and y < maxy")
    return points.join(hit.groupBy("id").agg(F.min("zid").alias("zid")), "id", "left")


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """All points with the polygon (zid, ring, minx, miny, maxx, maxy) that holds them, by ray casting."""
    p = points.withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))
    hit = p.join(boxes_on_grid(polygons, cell), ["cx", "cy"]).where("x >= minx and x <= maxx and y >= miny and y <= maxy")
    hit = hit.where(geo.point_in_ring(F.col("x"), F.col("y"), F.col("ring")))
    return points.join(hit.groupBy("id").agg(F.min("zid").alias("zid")), "id", "left")


def box_distance(x: Column, y: Column) -> Column:
    dx = F.greatest(F.col("minx") - x, F.lit(0.0), x - F.col("maxx"))
    dy = F.greatest(F.col("miny") - y, F.lit(0.0), y - F.col("maxy"))
    return F.hypot(dx, dy)


def zone_with_fallback(points: DataFrame, boxes: DataFrame, cell: float, reach: float) -> DataFrame:
    """The zone of each point; for points in none the nearest box within ``reach`` (smallest zid among equals)."""
    inside = point_in_box(points, boxes, cell)
    out = inside.where("zid is null").drop("zid")
    p = out.withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))
    near = p.join(boxes_on_grid(boxes, cell, reach), ["cx", "cy"]).withColumn("d", box_distance(F.col("x"), F.col("y"))).where(F.col("d") <= reach)
    near = near.groupBy("id").agg(F.min(F.struct("d", "zid")).alias("b")).select("id", F.col("b.zid").alias("near"))
    return inside.join(near, "id", "left").withColumn("zid", F.coalesce("zid", "near")).drop("near")


def overlap_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(id, bid, area, and b's other columns) of boxes that overlap. a: id, minx..maxy; b: bid, minx..maxy, ..."""
    a = a.select("id", "minx", "miny", "maxx", "maxy")
    left = boxes_on_grid(a, cell)
    names = {c: f"b_{c}" for c in ("minx", "miny", "maxx", "maxy")}
    right = boxes_on_grid(b, cell).withColumnsRenamed(names)
    first = (F.col("cx") == _cell(F.greatest("minx", "b_minx"), cell)) & (F.col("cy") == _cell(F.greatest("miny", "b_miny"), cell))
    area = geo.box_overlap(*[F.col(c) for c in names], *[F.col(c) for c in names.values()])
    return meet_on_grid(a, left, b, right).where(first).withColumn("area", area).where("area > 0").drop("cx", "cy", *names, *names.values())


def circle_polygon_area(points: DataFrame, polygons: DataFrame, radius: float, cell: float) -> DataFrame:
    """(id, zid, area) of each circle and polygon (zid, ring) that overlap; rings are closed and simple."""
    ring = F.col("ring")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxed = polygons.select("zid", "ring", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    p = points.select("id", "x", "y", _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"))
    met = p.join(boxes_on_grid(boxed, cell, radius), ["cx", "cy"]).select("id", "x", "y", "zid", F.posexplode("ring").alias("k", "a"), "ring")
    met = met.where(F.col("k") < F.size("ring") - 1).withColumn("b", F.element_at("ring", F.col("k") + 2))
    part = geo.circle_edge_area(F.col("x"), F.col("y"), radius, F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    return met.groupBy("id", "zid").agg(F.abs(F.sum(part)).alias("area")).where("area > 1e-9")


def area_weighted_mean(overlaps: DataFrame, values: list[str]) -> DataFrame:
    """Per id the means of zone values by overlap area, all columns in one aggregate.

    A null value is missing in the numerator and not in the denominator.
    """
    return overlaps.groupBy("id").agg(*[F.try_divide(F.sum(F.col(v) * F.col("area")), F.sum("area")).alias(v) for v in values])


def dasymetric(buildings: DataFrame, zone: str, amount: str, area: str | None = None, name: str = "share") -> DataFrame:
    """A zone's amount split over its buildings, equally or by their area; the parts sum to the amount.

    Totals per zone are aggregated before they are joined, so a zone of any size is fine.
    """
    weight = F.lit(1.0) if area is None else F.col(area).cast("double")
    total = buildings.groupBy(zone).agg(F.sum(weight).alias("_w"))
    return buildings.join(total, zone).withColumn(name, F.try_divide(F.col(amount) * weight, F.col("_w"))).drop("_w")


def cell_density(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(i, j, n) of the square cells that hold points."""
    return points.groupBy(_cell(F.col("x") - x0, size).cast("int").alias("i"), _cell(F.col("y") - y0, size).cast("int").alias("j")).agg(F.count("*").alias("n"))


def square_grid(spark, minx: float, miny: float, maxx: float, maxy: float, size: float = 500.0, pad: float = 1000.0) -> DataFrame:
    """(cell, minx, miny, maxx, maxy) of the squares over padded bounds; a last partial row or column is dropped."""
    nx, ny = int((maxx - minx + 2 * pad) // size), int((maxy - miny + 2 * pad) // size)
    x = F.lit(minx - pad) + F.floor(F.col("id") / ny) * size
    y = F.lit(miny - pad) + (F.col("id") % ny) * size
    return spark.range(nx * ny).select(F.col("id").alias("cell"), x.alias("minx"), y.alias("miny"), (x + size).alias("maxx"), (y + size).alias("maxy"))


def lonlat_grid(spark, minlon: float, minlat: float, maxlon: float, maxlat: float, resolution: float) -> DataFrame:
    """Regular points: steps of resolution / 111320 degrees of longitude and / 110540 of latitude, ends excluded."""
    dx, dy = resolution / 111_320, resolution / 110_540
    nx, ny = (max(0, -int(-(b - a) // d)) for a, b, d in ((minlon, maxlon, dx), (minlat, maxlat, dy)))
    return spark.range(nx * ny).select("id", (F.lit(minlon) + F.floor(F.col("id") / max(ny, 1)) * dx).alias("lon"), (F.lit(minlat) + (F.col("id") % max(ny, 1)) * dy).alias("lat"))


def grid_slopes(grid: DataFrame, step: float) -> DataFrame:
    """(i, j, avg_slope, max_slope): absolute slopes in percent to the four neighbours of a grid (i, j, altitude)."""
    moves = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    shifted = grid.select("i", "j", F.col("altitude").alias("other"), F.explode(moves).alias("m")).select((F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), "other")
    slope = F.abs(F.col("other") - F.col("altitude")) / F.lit(float(step)) * 100
    return grid.join(shifted, ["i", "j"]).groupBy("i", "j").agg(F.avg(slope).alias("avg_slope"), F.max(slope).alias("max_slope"))


def corner_distance(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The largest distance from a corner of a box to the box (b_minx, b_miny, b_maxx, b_maxy); 0 if that holds it."""
    dx = F.greatest(F.col("b_minx") - minx, maxx - F.col("b_maxx"), F.lit(0.0))
    dy = F.greatest(F.col("b_miny") - miny, maxy - F.col("b_maxy"), F.lit(0.0))
    left, right = F.greatest(F.col("b_minx") - minx, F.lit(0.0)), F.greatest(maxx - F.col("b_maxx"), F.lit(0.0))
    low, high = F.greatest(F.col("b_miny") - miny, F.lit(0.0)), F.greatest(maxy - F.col("b_maxy"), F.lit(0.0))
    return F.greatest(dx, dy, *[F.hypot(a, b) for a in (left, right) for b in (low, high)])


def buffer_steps(first: float = 50.0, more: float = 10.0, last: float = 500.0) -> list[float]:
    """The radii after each retry: each step's buffer grows the result of the one before it."""
    out, total, step = [], 0.0, first
    while step <= last:
        total += step
        out.append(total)
        step += more
    return out


def assign_with_growing_buffers(areas: DataFrame, zones: DataFrame, cell: float, steps: list[float] | None = None) -> DataFrame:
    """(id, zid, step) of boxes (id, minx..maxy): the zone that holds the box, else the zone whose buffer holds it at the earliest step.

    A convex zone's buffer holds a box if it holds its corners, so the step needed
    is known from one distance and no buffer is built. Of several zones at a step
    the nearest counts, then the smallest zid; null where no step is enough.
    """
    steps = steps or buffer_steps()
    left = boxes_on_grid(areas.select("id", "minx", "miny", "maxx", "maxy"), cell)
    names = {c: f"b_{c}" for c in ("minx", "miny", "maxx", "maxy")}
    right = boxes_on_grid(zones.select("zid", *names), cell, steps[-1]).withColumnsRenamed(names)
    need = corner_distance(*[F.col(c) for c in names])
    met = left.join(right, ["cx", "cy"]).withColumn("need", need).where(F.col("need") <= steps[-1])
    step = F.when(F.col("need") == 0, 0).otherwise(1 + F.size(F.filter(F.array(*map(F.lit, steps)), lambda r: r < F.col("need"))))
    best = met.groupBy("id").agg(F.min(F.struct(step.alias("step"), "need", "zid")).alias("b")).select("id", "b.zid", "b.step")
    return areas.select("id").join(best, "id", "left")


def building_area(kind: Column, area: Column, radius: float = 10.0) -> Column:
    """A building's area; a point counts as the polygon of 64 corners that stands for its circle."""
    circle = 32 * math.sin(2 * math.pi / 64) * radius * radius
    return F.when(F.lower(kind) == "point", F.lit(circle)).otherwise(area)


def cells_touching(cells: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """The cells (cell, minx..maxy) that share a point with a box."""
    names = {c: f"b_{c}" for c in ("minx", "miny", "maxx", "maxy")}
    left = boxes_on_grid(cells, cell)
    right = boxes_on_grid(boxes.select(*names), cell).withColumnsRenamed(names)
    hit = left.join(right, ["cx", "cy"]).where("minx <= b_maxx and maxx >= b_minx and miny <= b_maxy and maxy >= b_miny")
    return cells.join(hit.select("cell").distinct(), "cell", "left_semi")


def clip_to_box(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float, clamp: list[str] = ()) -> DataFrame:
    """The points inside a box; negative values of ``clamp`` become 0."""
    inside = F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy)
    return points.where(inside).withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in clamp})


def usual_place(sightings: DataFrame) -> DataFrame:
    """(id, x, y): where each id was seen most often; of equally frequent places the smallest."""
    n = sightings.groupBy("id", "x", "y").agg(F.count("*").alias("n"))
    best = n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "x", "y")).alias("b"))
    return best.select("id", "b.x", "b.y")
