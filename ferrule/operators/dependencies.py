"""Which versions satisfy all who ask: constraints are intersected until the choice of versions is stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import semver
from ferrule.operators import graph
from ferrule.sources import scratch


class Unsolvable(ValueError):
    """No version of some package fits all constraints, a package is unknown, or packages need each other in a circle."""


def choose(wanted: DataFrame, releases: DataFrame) -> DataFrame:
    """name and version: of each wanted name (name, asked_by, constraint) the best release (name, version) that passes all its constraints."""
    pairs = releases.join(wanted, "name").groupBy("name", "version").agg(F.every(F.coalesce(semver.holds(F.col("version"), F.col("constraint")), F.lit(False))).alias("fits"))
    key = semver.sort_key(F.col("version"))
    return pairs.where("fits").withColumn("key", key).where("key IS NOT NULL").groupBy("name").agg(F.max_by("version", "key").alias("version"))


def solve(requests: DataFrame, releases: DataFrame, requires: DataFrame, most_rounds: int = 100) -> DataFrame:
    """place, name, version of all that requests (name, constraint) need, what others need first.

    requires: name, version, needs, constraint. Each round chooses anew under the constraints of the requests and of the
    versions chosen before; only counts and a hash come to the driver. It ends when the choice is stable, which is an answer
    for every constraint of what is chosen.
    """
    asked = scratch.written(requests.select("name", F.lit("request").alias("asked_by"), "constraint").distinct(), "deps-asked")
    now, seen = None, set()
    for _ in range(most_rounds):
        wanted = asked
        if now is not None:
            wanted = asked.unionByName(now.join(requires, ["name", "version"]).select(F.col("needs").alias("name"), F.col("name").alias("asked_by"), "constraint")).distinct()
        wanted = scratch.written(wanted, "deps-wanted")
        then = scratch.written(choose(wanted, releases), "deps-chosen")
        lost = wanted.join(then, "name", "left_anti")
        if not lost.isEmpty():
            name = lost.agg(F.min("name").alias("n")).first()["n"]
            who = wanted.where(F.col("name") == name).orderBy("asked_by").limit(5).collect()
            raise Unsolvable(f"no version of {name} satisfies " + " | ".join(f"{r['constraint']} (by {r['asked_by']})" for r in who))
        state = then.agg(F.count("*"), F.sum(F.xxhash64("name", "version").cast("decimal(38,0)"))).first()
        if now is not None and state == last:
            break
        if state in seen:
            raise Unsolvable("the choice of versions does not settle")
        seen.add(state)
        now, last = then, state
    else:
        raise Unsolvable("the choice of versions does not settle")
    links = scratch.written(now.join(requires, ["name", "version"]).select(F.col("name").alias("node"), F.col("needs").alias("base")).distinct(), "deps-links")
    above = graph.ancestors(links)
    round_ = above.where("node = ancestor")
    if not round_.isEmpty():
        raise Unsolvable(f"a circle of dependencies through {round_.agg(F.min('node').alias('n')).first()['n']}")
    # Nothing that a package needs, directly or not, needs more packages than it does, so their number puts these first.
    needs = above.groupBy("node").agg(F.count("*").alias("place"))
    return now.join(needs, F.col("name") == F.col("node"), "left").select(F.coalesce("place", F.lit(0)).alias("place"), "name", "version")
