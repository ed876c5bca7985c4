"""Source paths of debug information, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_absolute(name: Column) -> Column:
    """A path that begins with a separator or has a colon near its start."""
    return name.rlike(r"^[/\\]") | F.substring(name, 1, 3).contains(":")


def anchored(anchor: Column, name: Column) -> Column:
    """name below anchor: a bare name in anchor itself, a name with folders beside
    the deepest folder of anchor that its first part names; null if there is none,
    or nothing is left above it."""
    clean = F.translate(name, "\\", "/")
    head = F.regexp_extract(clean, "^([^/]*)/", 1)
    parts = F.split(anchor, "/")
    backward = F.array_position(F.reverse(parts), head)
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - backward, F.lit(0)).cast("int")), "/")
    joined = F.when((backward > 0) & (above != ""), F.concat_ws("/", above, clean))
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.when(~clean.contains("/"), F.concat_ws("/", anchor, clean)).otherwise(joined))
