"""Answers of outside services in batches, and choices from what they returned."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_elevation(points: DataFrame, ask: Callable[[list[tuple[float, float]]], list[float | None]], batch: int = 100, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(id, lat, lon, altitude): ``ask`` gets at most ``batch`` places at a time; after ``tries`` failures in a row theirs stay null.

    The pause between tries grows by ``wait`` each time. Each task asks on its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[float | None] = []
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                places = list(zip(part["lat"].tolist(), part["lon"].tolist()))
                answer: list[float | None] = [None] * len(places)
                for k in range(tries):
                    try:
                        answer = ask(places)
                        break
                    except (OSError, ValueError):
                        time.sleep(wait * (k + 1))
                got += answer
            yield pdf.assign(altitude=pd.Series(got, index=pdf.index, dtype=float))

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).mapInPandas(run, f"id {kind}, lat double, lon double, altitude double")


def features_by_tags(elements: DataFrame, tags: dict[str, list[str] | bool], place: str | None = None) -> DataFrame:
    """The elements that have one of the tags with one of its values (True: any value), in a place if one is given."""
    hit = F.lit(False)
    for key, values in tags.items():
        v = F.col("tags")[key]
        hit = hit | (v.isNotNull() if values is True else F.coalesce(v.isin(list(values or [])), F.lit(False)))
    return elements.where(hit & (F.col("place") == place) if place is not None else hit)


def read_scenarios(text: str) -> dict[str, dict[str, float]]:
    """Scenario -> variable -> weight, from JSON or from indented ``name: value`` lines; comments and empty lines don't count."""
    if text.lstrip().startswith("{"):
        found = json.loads(text)
        return {s: {k: float(v) for k, v in w.items()} for s, w in found.get("weight_combinations", found).items()}
    out: dict[str, dict[str, float]] = {}
    name = None
    for line in text.splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        if not colon or not key.strip():
            continue
        if not value.strip():
            name = key.strip()
        elif name is None:
            raise ValueError(f"a weight outside of a scenario: {line.strip()}")
        else:
            out.setdefault(name, {})[key.strip()] = float(value)
    return out
