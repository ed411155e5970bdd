"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added_removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows only in new are added, rows only in old are removed."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def known_urls(registered: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    return registered.select(*keys).union(candidates.select(*keys)).dropna().dropDuplicates()
