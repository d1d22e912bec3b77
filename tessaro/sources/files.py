"""Readers and writers of the supported files. All go through Spark's own readers."""

from __future__ import annotations

import csv
import itertools
import re
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_header

SEPARATORS = (",", ";", "\t", "|")


def sniff_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The separator that the first line has most often; a comma if none."""
    line = spark.read.option("encoding", encoding).text(path).first()
    line = line[0] if line else ""
    best = max(SEPARATORS, key=line.count)
    return best if line.count(best) else ","


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; byte-order marks are cleaned, the separator is found if not given."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", sep or sniff_separator(spark, path, encoding))
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[clean_header(c) for c in df.columns])


def read_thousands_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """CSV whose numbers have thousands points."""
    df = read_csv(spark, path, sep=sep, encoding=encoding)
    return df.withColumns({c: F.replace(F.trim(c), F.lit("."), F.lit("")).try_cast("bigint") for c in columns})


def read_broken_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV whose rows are quoted as a whole: one outer pair of quotes goes, doubled quotes become single.

    Short rows are filled with nulls, long ones cut to the header's width.
    """
    lines = spark.read.option("encoding", encoding).text(path).where(F.trim("value") != "")
    outer = F.trim("value").rlike('^".*"$') & ~F.trim("value").rlike('^"[^"]*"(,|$)')
    fixed = F.when(outer, F.replace(F.expr("substring(trim(value), 2, length(trim(value)) - 2)"), F.lit('""'), F.lit('"'))).otherwise(F.trim("value"))
    lines = lines.select(fixed.alias("line"), F.monotonically_increasing_id().alias("at"))
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "value string")
    names = [clean_header(c.strip()) for c in next(csv.reader([first["line"]]))]
    kind = ", ".join(f"`{c}` string" for c in names)
    rest = lines.where(F.col("at") != first["at"])  # later rows that look like the header are data
    return rest.select(F.from_csv("line", F.lit(kind), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_many(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """Several CSVs joined on one key, whatever keys each of them has."""
    return reduce(lambda a, b: a.join(b, key, "full"), [read_csv(spark, p) for p in paths])


def _px_fields(content: bytes, encoding: str) -> dict[str, str]:
    return {m[1].strip(): m[2] for m in re.finditer(r'^([A-Z-]+(?:\("[^"]*"\))?)=(.*?);\s*$', content.decode(encoding), re.S | re.M)}


def read_px(spark: SparkSession, path: str, encoding: str = "ISO-8859-15") -> DataFrame:
    """PC-Axis files as a long table: one column per heading, then value (null for marks such as "..").

    The headings are those of the first file; each file is read in a task of its own.
    """
    whole = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    fields = _px_fields(bytes(whole.first()["content"]), encoding)
    names = [x for k in ("STUB", "HEADING") if k in fields for x in re.findall(r'"([^"]*)"', fields[k])]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                own = _px_fields(bytes(content), encoding)
                values = [re.findall(r'"([^"]*)"', own[f'VALUES("{n}")']) for n in names]
                data = re.findall(r'"[^"]*"|\S+', own["DATA"])
                yield pd.DataFrame([(*k, v.strip('"')) for k, v in zip(itertools.product(*values), data)], columns=[*names, "value"])

    df = whole.mapInPandas(cells, T.StructType([T.StructField(n, T.StringType()) for n in [*names, "value"]]))
    return df.withColumn("value", F.col("value").try_cast("double"))


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lat, lon, tags, members) of a saved Overpass answer."""
    kind = "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,members:array<struct<type:string,ref:bigint,role:string>>>>"
    return spark.read.option("multiLine", True).schema(kind).json(path).select(F.inline("elements"))


def _shapes(content: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (1, 11, 21):
            yield number, [[struct.unpack("<2d", body[4:20])]]
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            parts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            xy = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            pts = list(zip(xy[::2], xy[1::2]))
            yield number, [pts[a:b] for a, b in zip(parts, parts[1:])]
        else:
            yield number, []
        at += 8 + 2 * words


def read_shapefile(spark: SparkSession, shp: str, dbf: str | None = None) -> DataFrame:
    """(record, rings, attributes): geometry of a .shp, joined by record number with the .dbf's text attributes."""

    def shapes(batches):
        for pdf in batches:
            rows = [(n, [[{"x": x, "y": y} for x, y in p] for p in parts]) for c in pdf["content"] for n, parts in _shapes(bytes(c))]
            yield pd.DataFrame(rows, columns=["record", "rings"])

    def records(batches):
        for pdf in batches:
            rows = []
            for c in pdf["content"]:
                c = bytes(c)
                n, head, size = struct.unpack("<IHH", c[4:12])
                fields, at = [], 32
                while c[at] != 0x0D:
                    fields.append((c[at : at + 11].split(b"\0")[0].decode("latin-1"), c[at + 16]))
                    at += 32
                for i in range(n):
                    row, k, got = c[head + i * size : head + (i + 1) * size], 1, {}
                    for name, width in fields:
                        got[name] = row[k : k + width].decode("utf-8", "replace").strip()
                        k += width
                    rows.append((i + 1, got))
            yield pd.DataFrame(rows, columns=["record", "attributes"])

    geo = spark.read.format("binaryFile").load(shp).select("content").mapInPandas(shapes, "record int, rings array<array<struct<x:double,y:double>>>")
    if dbf is None:
        return geo
    return geo.join(spark.read.format("binaryFile").load(dbf).select("content").mapInPandas(records, "record int, attributes map<string,string>"), "record")


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header, one file per partition; bring the rows to one partition first if one file is wanted."""
    df.write.mode(mode).option("header", True).option("quoteAll", quote_all).csv(path)


def append_log(df: DataFrame, path: str, key: str = "experiment_idx") -> None:
    """Appends rows to a parquet log, the key first; concurrent writers lose nothing."""
    df.select(key, *[c for c in df.columns if c != key]).write.mode("append").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; built and written only if it is not there."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write_duplicates(df: DataFrame, keys: list[str], path: str) -> bool:
    """Writes the rows of duplicated keys, only if there are any."""
    from ..operators.relational import duplicate_rows

    found = duplicate_rows(df, keys)
    if found.isEmpty():
        return False
    write_csv(found, path)
    return True


def wkt_of_point(x, y):
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))
