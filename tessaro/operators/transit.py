"""Stops, lines and entrances from map elements (type, id, lat, lon, tags, members)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .relational import first_of, unmatched


def lookup_or_same(value: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; what isn't in the mapping stays."""
    pairs = [F.lit(x) for p in mapping.items() for x in p]
    return F.coalesce(F.create_map(*pairs)[value], value) if pairs else value


def bus_stops(elements: DataFrame) -> DataFrame:
    """(stop_id, stop_name, line, lat, lon): a row per stop and line; a stop without lines keeps one with null."""
    stops = elements.where((F.col("type") == "node") & (F.col("tags")["highway"] == "bus_stop"))
    lines = F.explode_outer(F.filter(F.split(F.col("tags")["route_ref"], r"\s+"), lambda x: x != ""))
    return stops.select(F.col("id").alias("stop_id"), F.col("tags")["name"].alias("stop_name"), lines.alias("line"), "lat", "lon").distinct()


def _memberships(elements: DataFrame) -> DataFrame:
    """(relation, tags, node) of the nodes that relations list."""
    rel = elements.where("type = 'relation'").select(F.col("id").alias("relation"), F.col("tags").alias("r_tags"), F.explode("members").alias("m"))
    return rel.where(F.col("m")["type"] == "node").select("relation", "r_tags", F.col("m")["ref"].alias("id"))


def route_stops(elements: DataFrame, modes: list[str], line_names: dict[str, str]) -> DataFrame:
    """(line_id, line, stop_name, lat, lon) of the named stops of routes of some modes; one row per line and place."""
    routes = _memberships(elements).where(F.col("r_tags")["route"].isin(modes))
    nodes = elements.where("type = 'node'").select("id", F.col("tags")["name"].alias("stop_name"), "lat", "lon").where("stop_name is not null and stop_name <> ''")
    out = routes.join(nodes, "id").select(F.col("relation").alias("line_id"), lookup_or_same(F.col("r_tags")["ref"], line_names).alias("line"), "stop_name", "lat", "lon")
    return first_of(out, ["line", "stop_name", "lat", "lon"], [F.col("line_id")]).dropna()


def entrances(elements: DataFrame) -> DataFrame:
    """(entrance_id, entrance_name, stop_name, lat, lon): a row per entrance and stop area that lists it."""
    nodes = elements.where((F.col("type") == "node") & (F.col("tags")["railway"] == "subway_entrance"))
    areas = _memberships(elements).select("relation", "id", F.col("r_tags")["name"].alias("stop_name")).distinct()
    return nodes.join(areas, "id").select(F.col("id").alias("entrance_id"), F.col("tags")["name"].alias("entrance_name"), "stop_name", "lat", "lon")


def merge_entrances(stops: DataFrame, doors: DataFrame, patches: list[tuple[Column, str, Column]] = ()) -> DataFrame:
    """(stop_name, line, entrance_name, entrance_id, lat, lon): entrances with the lines of their stops.

    A full join on the stop's name. A missing line is the text in parentheses of
    the name, a line called metro the name's last word; both then leave the name.
    Places of the entrance come before those of the stop. Rows without an entrance
    stay only for (line, stop) pairs that have none. ``patches``: (condition,
    column, value), in order. Lines of one entrance become a sorted list.
    """
    a = doors.select(F.trim("stop_name").alias("stop_name"), F.trim("entrance_name").alias("entrance_name"), "entrance_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    b = stops.select(F.trim("stop_name").alias("stop_name"), "line", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    m = a.join(b, "stop_name", "full")
    m = m.withColumn("line", F.coalesce("line", text.in_parens(F.col("stop_name")))).withColumn("stop_name", text.without_parens(F.col("stop_name")))
    m = m.withColumn("line", F.when(F.col("line").isin("Metro", "metro"), text.last_token(F.col("stop_name"))).otherwise(F.col("line")))
    m = m.withColumn("stop_name", F.trim(F.regexp_replace("stop_name", r"\b(L\d+|[Mm]etro)\b", "")))
    for condition, column, value in patches:
        m = m.withColumn(column, F.when(condition, value).otherwise(F.col(column)))
    m = m.select("stop_name", "line", "entrance_name", "entrance_id", F.coalesce("_lat", "s_lat").alias("lat"), F.coalesce("_lon", "s_lon").alias("lon"))
    with_door = first_of(m.where("entrance_id is not null"), ["line", "stop_name", "entrance_name"], [F.col("entrance_id"), F.col("lat"), F.col("lon")])
    rest = first_of(m.where("entrance_id is null"), ["line", "stop_name"], [F.col("lat"), F.col("lon")])
    every = with_door.unionByName(unmatched(rest, with_door, ["line", "stop_name"])).withColumn("entrance_name", F.coalesce("entrance_name", "stop_name"))
    return every.groupBy("stop_name", "entrance_name", "lat", "lon").agg(F.array_sort(F.collect_set("line")).alias("line"), F.min("entrance_id").alias("entrance_id"))
