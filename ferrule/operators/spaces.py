"""File spaces: composition, snapshot diffs, generations, consumers' progress, tombstones, digests of whole spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETAIN = 64


def compose(children: DataFrame, own: DataFrame, minus: DataFrame | None = None) -> DataFrame:
    """rel_path with the spaces it is in: the union of children and own files (rel_path, space), less those of minus; own files stay."""
    rows = children if minus is None else children.join(minus.select("rel_path").distinct(), "rel_path", "left_anti")
    return rows.unionByName(own).groupBy("rel_path").agg(F.sort_array(F.collect_set("space")).alias("spaces"))


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """rel_path and change between two snapshots (rel_path, size, mtime_ns, content_hash): touched if only the time differs."""
    b = before.select("rel_path", *(F.col(c).alias(f"b_{c}") for c in ("size", "mtime_ns", "content_hash")), F.lit(True).alias("b"))
    n = now.select("rel_path", *(F.col(c).alias(f"n_{c}") for c in ("size", "mtime_ns", "content_hash")), F.lit(True).alias("n"))
    same = F.col("b_content_hash").eqNullSafe(F.col("n_content_hash")) & (F.col("b_size") == F.col("n_size"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~same, "modified").when(F.col("b_mtime_ns") != F.col("n_mtime_ns"), "touched").otherwise("unchanged")
    return b.join(n, "rel_path", "full_outer").select("rel_path", change.alias("change"))


def to_hash(before: DataFrame, listed: DataFrame, scanned_ns: int, racy_ns: int = 10_000_000) -> DataFrame:
    """listed (rel_path, size, mtime_ns) with content_hash where the one before can be kept, else null: the file must be read.

    Kept are files of the same size and time, unless written so shortly before the scan before that they may have changed in the
    same tick of the clock (before has scanned_ns, when it was made; the one given counts where it has none).
    """
    old = before.select("rel_path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"), F.col("content_hash").alias("_h"), (F.coalesce("scanned_ns", F.lit(scanned_ns)) if "scanned_ns" in before.columns else F.lit(scanned_ns)).alias("_at"))
    clean = (F.col("_s") == F.col("size")) & (F.col("_t") == F.col("mtime_ns")) & (F.col("_at") - F.col("mtime_ns") > racy_ns)
    return listed.join(old, "rel_path", "left").withColumn("content_hash", F.when(clean, F.col("_h"))).drop("_s", "_t", "_h", "_at")


def advance(state: DataFrame, changes: DataFrame, generation: int) -> DataFrame:
    """The generation table (rel_path, created_gen, updated_gen, is_deleted) after a diff; a file made anew is created anew."""
    joined = state.join(changes.where(F.col("change").isin("added", "modified", "deleted")), "rel_path", "full_outer")
    g = F.lit(generation).cast("long")
    fresh = F.col("change") == "added"
    return joined.select("rel_path", F.when(fresh, g).otherwise(F.col("created_gen")).alias("created_gen"), F.when(F.col("change").isNotNull(), g).otherwise(F.col("updated_gen")).alias("updated_gen"), F.when(F.col("change").isNotNull(), F.col("change") == "deleted").otherwise(F.col("is_deleted")).alias("is_deleted"))


def pending(state: DataFrame, acked: int) -> DataFrame:
    """What a consumer at a generation has not seen: deletions only of files that existed then."""
    change = F.when(F.col("is_deleted") & (F.col("updated_gen") > acked) & (F.col("created_gen") <= acked), "deleted").when(~F.col("is_deleted") & (F.col("created_gen") > acked), "added").when(~F.col("is_deleted") & (F.col("updated_gen") > acked), "modified")
    return state.select("rel_path", change.alias("change")).where("change IS NOT NULL")


def prune(state: DataFrame, cursors: DataFrame, head: int, window: int = RETAIN) -> DataFrame:
    """state without tombstones older than the window that every consumer has passed, or than four windows."""
    if head <= window:
        return state
    least = cursors.where("acked_generation > 0").agg(F.coalesce(F.min("acked_generation"), F.lit(head)).alias("_least"))
    age = head - F.col("updated_gen")
    gone = F.col("is_deleted") & (age > window) & ((F.col("updated_gen") <= F.col("_least")) | (age > 4 * window))
    return state.crossJoin(F.broadcast(least)).where(~gone).drop("_least")  # one row


def digest(entries: DataFrame) -> DataFrame:
    """space and one SHA-256 over its path-ordered (path, size, hash) records, by way of digests of 4096 parts of the paths.

    Parts keep any one task's list short; the root covers the parts in order, so it changes if and only if an entry does.
    """
    part = F.substring(F.sha2("rel_path", 256), 1, 3)
    record = F.concat_ws("|", "rel_path", F.col("size").cast("string"), "content_hash")
    leaves = entries.groupBy("space", part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(record)), "\n"), 256).alias("leaf"))
    return leaves.groupBy("space").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("part", F.lit(":"), "leaf"))), "\n"), 256).alias("root"))


def status(state: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per space: live files, tombstones, head generation, and its slowest consumer."""
    s = state.groupBy("space").agg(F.count_if(~F.col("is_deleted")).alias("active"), F.count_if("is_deleted").alias("deleted"), F.max("updated_gen").alias("head"))
    return s.join(cursors.groupBy("space").agg(F.min("acked_generation").alias("slowest")), "space", "left")


def workspace_status(edges: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row: nodes and distinct edges of a graph (src, dst), documents of an index (its row of statistics)."""
    e = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    n = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(statistics.select(F.col("docs").alias("documents"))))  # rows of one
