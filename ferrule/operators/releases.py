"""Releases and updates: which to keep, which to take first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URGENCY = {"critical": 3, "high": 2, "medium": 2, "low": 1}


def retained(releases: DataFrame, package: str, triplet: str, revision: str, current: Column, newest: int = 3, others: int = 1) -> DataFrame:
    """releases with state: kept or pruned. Of the current triplet the newest few revisions stay, of each other one fewer."""
    rank = F.row_number().over(Window.partitionBy(package, triplet).orderBy(F.desc(revision)))
    return releases.withColumn("state", F.when(rank <= F.when(current, newest).otherwise(others), "kept").otherwise("pruned"))


def urgent(updates: DataFrame, level: str, tie: str, limit: int = 10) -> DataFrame:
    """The most urgent first; an unknown level counts as medium."""
    points = F.lit(2)
    for name, n in URGENCY.items():
        points = F.when(F.lower(level) == name, n).otherwise(points)
    return updates.withColumn("urgency", points.cast("long")).orderBy(F.desc("urgency"), tie).limit(limit)
