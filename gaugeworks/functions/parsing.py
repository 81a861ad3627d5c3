"""Structures read from text: links, registries and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(text: Column, between: str) -> Column:
    """array<struct<a,b>> of the names that ``between`` (a pattern) stands between, in order."""
    shape = rf"(\w+){between}(\w+)"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(shape), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(shape), F.lit(2)).alias("b"))
    return F.transform(found, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))


def registry(text: Column) -> Column:
    """map of 'name: rest' lines; of a repeated name the last line counts."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^:\n]+?)\s*:", 1)).alias("k"), F.trim(F.regexp_extract(x, r":(.*)$", 1)).alias("v")))
    named = F.filter(lines, lambda x: x["k"] != "")
    once = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(once)


def dates(text: Column) -> Column:
    """array of the year-month-day dates in a text, as day numbers of a calendar whose months have 30 days."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    part = lambda x, at, n: F.substring(x, at, n).cast("int")
    return F.transform(found, lambda x: part(x, 1, 4) * 360 + part(x, 6, 2) * 30 + part(x, 9, 2))


def end_of_chain(links: Column, start: Column) -> Column:
    """Where following links(a, b) from start ends. Links must not form a circle; a name leads one way."""
    to = F.map_from_entries(F.transform(links, lambda x: F.struct(x["a"], x["b"])))
    return F.aggregate(links, start, lambda at, _: F.coalesce(F.try_element_at(to, at), at))
