"""Points from whatever columns a table has for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.schema import pick_column

# What the columns are called.
X, Y = ["x", "X", "coord_x", "utm_x"], ["y", "Y", "coord_y", "utm_y"]
LON, LAT = ["lon", "longitude", "longtude", "lng"], ["lat", "latitude"]


def repair_degrees(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Columns lon and lat in degrees: where the median size is above 1000, latitudes are millionths and longitudes ten-millionths."""
    size = lambda c: F.percentile_approx(F.abs(F.col(c).try_cast("double")), 0.5, 100_000)
    m = df.agg(size(lat).alias("lat"), size(lon).alias("lon")).first()  # two numbers
    y, x = (F.col(c).try_cast("double") for c in (lat, lon))
    return df.withColumns({"lat": y / 1_000_000 if (m["lat"] or 0) > 1000 else y, "lon": x / 10_000_000 if (m["lon"] or 0) > 1000 else x})


def with_points(df: DataFrame) -> DataFrame:
    """The rows with a place, and its projected x and y: from WKT points, else projected columns, else longitude and latitude.

    WKT whose bounds fit degrees is taken as longitude and latitude.
    """
    wkt = pick_column(df, ["geometry"], False)
    if wkt:
        p = df.withColumn("_p", text.wkt_point(F.col(wkt))).where("_p is not null")
        b = p.agg(*[f(F.col("_p")[c]).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
        degrees = b["lox"] is not None and -180 <= b["lox"] and b["hix"] <= 180 and -90 <= b["loy"] and b["hiy"] <= 90
        place = geo.utm31(F.col("_p.x"), F.col("_p.y")) if degrees else F.col("_p")
        return p.withColumn("_q", place).withColumns({"x": F.col("_q.x"), "y": F.col("_q.y")}).drop("_p", "_q", wkt)
    x, y = pick_column(df, X, False), pick_column(df, Y, False)
    if x and y:
        return df.withColumns({"x": F.col(x).try_cast("double"), "y": F.col(y).try_cast("double")}).where("x is not null and y is not null")
    lon, lat = pick_column(df, LON, False), pick_column(df, LAT, False)
    if lon and lat:
        out = repair_degrees(df, lon, lat).where("lon is not null and lat is not null")
        return out.withColumn("_q", geo.utm31(F.col("lon"), F.col("lat"))).withColumns({"x": F.col("_q.x"), "y": F.col("_q.y")}).drop("_q")
    raise LookupError("no columns for a place")
