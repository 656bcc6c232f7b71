"""Parsing of the text forms that detection data comes in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_to_seconds(text: Column) -> Column:
    """h:m:s, m:s or s (with a fraction) to seconds; null if it is none of these."""
    parts = F.reverse(F.split(text, ":"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.when(F.size(parts) < i, F.lit(0.0)))
    return at(1) + at(2) * 60 + at(3) * 3600


def seconds_to_clock(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((seconds - whole) * 1000 + 0.5).cast("int"))


def rate_to_double(text: Column) -> Column:
    """'30000/1001' to frames a second; a number without a bar as it is."""
    parts = F.split(text, "/")
    return F.try_divide(F.element_at(parts, 1).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0)))


def size_to_ints(text: Column) -> Column:
    """'640,360' to struct(width, height); null where it is no such text."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+)\s*,\s*(\d+)\s*$", i).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("width"), part(2).alias("height")))


def to_bool(text: Column) -> Column:
    # The words read as true.
    return F.lower(text).isin("yes", "true", "t", "1")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def tag_prefix(tag: Column) -> Column:
    return F.substring_index(tag, "_", 1)


def to_camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def to_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name).lower()
