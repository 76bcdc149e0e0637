"""Choosing among symbols, outlines, plans and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import extension
from ferrule.operators import graph, rules
from ferrule.operators.linker import TYPES

DOCUMENTS = ("markdown",)


def overlaps(have: Column, want: list[str] | None) -> Column:
    """Sets meet if they share a member; no wish is met by all."""
    return F.lit(True) if not want else F.arrays_overlap(have, F.array(*map(F.lit, want)))


def topical(nodes: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Without extensions, no documents (Markdown, kinds named doc_*); with them, files of these alone."""
    if extensions:
        return nodes.where(extension(F.col("file_path")).isin(*extensions))
    return nodes.where(~F.coalesce(F.col("language").isin(*DOCUMENTS), F.lit(False)) & ~F.coalesce(F.col("kind").startswith("doc_"), F.lit(False)))


def select_nodes(nodes: DataFrame, spaces: list[str] | None = None, kinds: list[str] | None = None, visibility: str | None = None, facets: dict[str, str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """nodes (spaces and kinds arrays, facets a map) that pass all: any of the spaces (none named: 'project'), of the kinds, a visibility
    ('non-private': all others), extensions or languages, and each facet's value or one of its comma-separated values. Ordered by place."""
    test = overlaps(F.when(F.size("spaces") > 0, F.col("spaces")).otherwise(F.array(F.lit("project"))), spaces) & overlaps(F.col("kinds"), kinds)
    if visibility == "non-private":
        test &= F.coalesce(F.col("visibility") != "private", F.lit(True))
    elif visibility:
        test &= F.col("visibility") == visibility
    if extensions:
        test &= extension(F.col("file_path")).isin(*extensions) | F.lower("language").isin(*extensions)
    for key, value in (facets or {}).items():
        test &= F.coalesce(F.array_contains(F.split(F.col("facets")[key], r"\s*,\s*"), value), F.lit(False))
    return nodes.where(test).orderBy("file_path", "start_byte", "name")


def outline(nodes: DataFrame, visibility: str | None = None, static: bool | None = None, kinds: list[str] | None = None, types_only: bool = False) -> DataFrame:
    """nodes (id, parent_id, kind, visibility, is_static) of an outline that pass, and every container around one that does."""
    is_type = F.col("kind").isin(*TYPES)
    test = F.lit(True)
    if types_only:
        test &= is_type
    if visibility:
        test &= F.col("visibility") == visibility
    if static is not None:
        test &= F.coalesce("is_static", F.lit(False)) == static
    if kinds:
        test &= F.col("kind").isin(*kinds)
    chosen = nodes.where(test if types_only else test & ~is_type if (visibility or static is not None or kinds) and not (set(kinds or ()) & set(TYPES)) else test).select("id")
    around = graph.ancestors(nodes.where("parent_id IS NOT NULL").select(F.col("id").alias("node"), F.col("parent_id").alias("base")))
    kept = chosen.unionByName(around.join(chosen, F.col("node") == F.col("id"), "left_semi").select(F.col("ancestor").alias("id"))).distinct()
    return nodes.join(kept, "id", "left_semi")


def best_matches(symbols: DataFrame, selector: str, limit: int | None = None) -> DataFrame:
    """Symbols that a selector fits, the best first: points, then the shorter full name, then the id."""
    test, points = rules.selector(selector)
    out = symbols.where(test).withColumn("points", points)
    return out.orderBy(F.desc("points"), F.length("fqn"), "id") if limit is None else out.orderBy(F.desc("points"), F.length("fqn"), "id").limit(limit)


def todos_in_scope(todos: DataFrame, keyword: str | None = None) -> DataFrame:
    """To-dos whose scope, title, note or id holds a keyword, in any case."""
    return todos if not keyword else todos.where(F.lower(F.concat_ws("\n", "scope", "title", "note", "todo_id")).contains(keyword.lower()))


def named(plans: DataFrame, name: str, status: str | None = None) -> DataFrame:
    """Plans of a name (topic or file name): the exact ones if there are any, else those that hold it. The newest first."""
    low = name.lower().removesuffix(".md")
    own = F.regexp_replace(F.lower("filename"), r"\.md$", "")
    tier = F.when((own == low) | (F.lower("topic") == low), 1).when(own.contains(low) | F.lower("title").contains(low), 2)
    found = plans if status is None else plans.where(F.lower("status") == status.lower())
    found = found.withColumn("tier", tier).where("tier IS NOT NULL")
    best = found.agg(F.min("tier").alias("best"))
    return newest_first(found.crossJoin(F.broadcast(best)).where("tier = best").drop("tier", "best"))  # one row


def newest_first(plans: DataFrame) -> DataFrame:
    return plans.orderBy(F.desc("date"), F.desc("filename"))


def dirty(changes: DataFrame) -> DataFrame:
    """Paths to read again: added and modified, not deleted."""
    return changes.where(F.col("change").isin("added", "modified")).select("rel_path").distinct()


def merged_changes(changes: DataFrame) -> DataFrame:
    """Changes (space, rel_path, change, to_gen) of many spaces as one: a row a path. What one space has deleted and another has not is
    modified; added wins over modified only if no space knew the path."""
    kinds = F.collect_set("change")
    by = changes.where(F.col("change").isin("added", "modified", "deleted")).groupBy("rel_path").agg(kinds.alias("k"))  # at most three
    one = F.when(F.size("k") == 1, F.get("k", F.lit(0))).otherwise("modified")
    return by.select("rel_path", one.alias("change"))


def head(changes: DataFrame) -> DataFrame:
    """One row: the highest generation over all spaces, and over how many."""
    return changes.agg(F.max("to_gen").alias("to_gen"), F.count_distinct("space").alias("spaces"))


def appended(lists: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """Lists of a key joined in order, each value once, where it first stands."""
    rows = lists.select(key, order, F.posexplode(values).alias("i", "v"))
    first = rows.groupBy(key, "v").agg(F.min(F.struct(order, "i")).alias("at"))
    return first.select(key, F.col("v").alias("value"), F.col(f"at.{order}").alias(order), "at.i")
