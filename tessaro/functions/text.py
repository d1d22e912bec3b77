"""Text expressions: normalisation of names and ids, extraction, parsing of serialised values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def clean_header(name: str) -> str:
    """A column name without byte-order marks (also mis-decoded ones) and outer white space."""
    return name.replace("﻿", "").replace("ï»¿", "").strip()


@F.pandas_udf(T.StringType())
def _unmarked(values: pd.Series) -> pd.Series:
    decomposed = values.str.normalize("NFKD")
    return decomposed.map(lambda t: t if t is None or t.isascii() else "".join(c for c in t if not unicodedata.combining(c)), na_action="ignore")


def normalize_text(c: Column) -> Column:
    """Trimmed, lower case, decomposed without combining marks, runs of white space as one space; empty becomes null.

    Decomposition has no built-in; it is one Arrow batch function. The rest stays in the JVM.
    """
    return F.nullif(F.trim(F.regexp_replace(_unmarked(F.lower(c)), r"\s+", " ")), F.lit(""))


def zfill(c: Column, n: int) -> Column:
    """Left zeros up to ``n`` characters; longer values stay whole (``lpad`` would cut them)."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def normalize_section(c: Column) -> Column:
    """A census section id of ten digits from numbers, decimals with point or comma, or labelled text."""
    s = F.trim(c.cast("string"))
    as_double = F.replace(s, F.lit(","), F.lit(".")).try_cast("double")
    whole = F.when(as_double == F.floor(as_double), as_double.try_cast("bigint").cast("string"))
    digits = F.regexp_replace(s, r"\D", "")
    return F.nullif(zfill(F.coalesce(whole, F.nullif(digits, F.lit(""))), 10), F.lit(""))


def decimal_comma(c: Column) -> Column:
    """A double from text with thousands points and a decimal comma; null if it is no number."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[\"']", ""), r"\.(?=\d{3}(\D|$))", "")
    return F.replace(s, F.lit(","), F.lit(".")).try_cast("double")


def in_parens(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\((.*?)\)", 1), F.lit(""))


def without_parens(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\(.*?\)", ""))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def line_letters(c: Column) -> Column:
    return F.regexp_extract(c, r"([A-Za-z]+)", 1)


def line_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def wkt_point(c: Column) -> Column:
    """struct<x,y> of ``POINT (x y)``; null for anything else."""
    at = lambda k: F.regexp_extract(c, r"^\s*POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)\s*$", k).try_cast("double")
    return F.when(at(1).isNotNull() & at(2).isNotNull(), F.struct(at(1).alias("x"), at(2).alias("y")))


def wkt_ring(c: Column) -> Column:
    """array<struct<x,y>> of a LINESTRING or of the outer ring of a POLYGON; null if a coordinate is no number."""
    pairs = F.split(F.trim(F.regexp_extract(c, r"\(+\s*([^()]*)\)", 1)), r"\s*,\s*")
    one = lambda p, i: F.try_element_at(F.split(p, r"\s+"), F.lit(i)).try_cast("double")
    pts = F.transform(pairs, lambda p: F.struct(one(p, 1).alias("x"), one(p, 2).alias("y")))
    return F.when(~F.exists(pts, lambda p: p["x"].isNull() | p["y"].isNull()), pts)


def parse_list(c: Column) -> Column:
    """array<string> of a serialised list such as ``['L4', 'L2']``; a bare value is a list of one."""
    inner = F.regexp_extract_all(c, F.lit(r"['\"]?([^'\",\[\]]+?)['\"]?\s*(?:,|\]|$)"), 1)
    return F.when(c.startswith("["), F.transform(inner, lambda x: F.trim(x))).otherwise(F.array(c))


def map_json(c: Column) -> Column:
    """JSON text of a map with its keys in order: equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def latest_period_column(columns: list[str], keys: list[str]) -> str:
    """The last column that is no key: the newest period of a wide table."""
    rest = [c for c in columns if c not in keys]
    if not rest:
        raise ValueError("no period column")
    return rest[-1]


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def plain_number(c: Column, places: int) -> Column:
    """A double rounded and written without an exponent: 0.0005, 1.0, -0.0 for what rounds to 0 from below; nan and null stay."""
    digits = F.abs(F.round(c, places)).cast(f"decimal(38,{places})").cast("string")
    said = F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")
    return F.when(F.isnan(c), "nan").otherwise(F.concat(F.when(c.cast("string").startswith("-"), "-").otherwise(""), said))
