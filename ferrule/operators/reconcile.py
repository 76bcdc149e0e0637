"""Three-way reconciliation of snapshots, reference counts of history, last-write-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("md5", "sha256", "size", "mtime_ns")


def same(a: str, b: str) -> Column:
    """MD5 and size where both have one, else SHA-256 and size, else size and time."""
    x, y = (lambda c: F.col(f"{a}_{c}")), (lambda c: F.col(f"{b}_{c}"))
    both = lambda c: (F.coalesce(x(c), F.lit("")) != "") & (F.coalesce(y(c), F.lit("")) != "")
    size = x("size") == y("size")
    return F.when(both("md5"), (x("md5") == y("md5")) & size).when(both("sha256"), (x("sha256") == y("sha256")) & size).otherwise(size & (x("mtime_ns") == y("mtime_ns")))


def three_way(local: DataFrame, remote: DataFrame, baseline: DataFrame, mode: str = "sync", pull_delete: bool = False, push_delete: bool = False, force: bool = False) -> DataFrame:
    """rel_path, action, reason. Some cells ask for nothing and give no row."""
    named = [(n, d.select("rel_path", *(F.col(c).alias(f"{n}_{c}") for c in COLUMNS), F.lit(True).alias(n))) for n, d in (("l", local), ("r", remote), ("b", baseline))]
    joined = named[0][1].join(named[1][1], "rel_path", "full_outer").join(named[2][1], "rel_path", "full_outer")
    l, r, b = (F.col(n).isNotNull() for n in "lrb")
    push, pull = mode == "push", mode == "pull"
    lc, rc = ~same("l", "b"), ~same("r", "b")
    cells = [
        (l & r & same("l", "r"), "in_sync", "identical_digest"),
        (l & r & ~b, "push_update" if force and push else "pull_update" if force and pull else "conflict", "forced_push_on_add_add_conflict" if force and push else "forced_pull_on_add_add_conflict" if force and pull else "add_add_diverged"),
        (l & r & lc & ~rc, ("pull_update" if force else "in_sync") if pull else "push_update", "modified_local_only"),
        (l & r & rc & ~lc, ("push_update" if force else "in_sync") if push else "pull_update", "modified_remote_only"),
        (l & r, "push_update" if force and push else "pull_update" if force and pull else "conflict", "both_modified_diverged"),
        (l & ~b, "push_new" if not pull else "delete_local" if pull_delete and force else None, "added_local" if not pull else "pull_delete_untracked_local"),
        (l & lc, "push_new" if force and push else "delete_local" if force and pull and pull_delete else "conflict", "modify_local_delete_remote_conflict"),
        (l, "delete_local" if not push and pull_delete else "push_new" if push else None, "deleted_on_remote" if not push and pull_delete else "restore_deleted_remote_on_push"),
        (r & ~b, "pull_new" if not push else "delete_remote" if push_delete and force else None, "added_remote" if not push else "push_delete_untracked_remote"),
        (r & rc, "pull_new" if force and pull else "delete_remote" if force and push and push_delete else "conflict", "delete_local_modify_remote_conflict"),
        (r, "delete_remote" if not pull and push_delete else "pull_new" if pull else None, "deleted_locally" if not pull and push_delete else "restore_deleted_local_on_pull"),
        (b, "in_sync", "both_deleted_prune_baseline"),
    ]
    action = reason = None
    for test, a, why in cells:
        a, why = F.lit(a).cast("string"), F.lit(why)
        action, reason = (F.when(test, a), F.when(test, why)) if action is None else (action.when(test, a), reason.when(test, why))
    return joined.select("rel_path", action.alias("action"), reason.alias("reason")).where("action IS NOT NULL")


def reference_counts(history: DataFrame, references: DataFrame) -> DataFrame:
    """file_id of history and how many branches of references (branch, file_id) hold it."""
    counts = references.groupBy("file_id").agg(F.count_distinct("branch").alias("refs"))
    return history.select("file_id").distinct().join(counts, "file_id", "left").select("file_id", F.coalesce("refs", F.lit(0)).alias("refs"))


def orphans(history: DataFrame, references: DataFrame) -> DataFrame:
    return history.select("file_id").distinct().join(references, "file_id", "left_anti")


def referenced_elsewhere(files: DataFrame, references: DataFrame, branch: str) -> DataFrame:
    return files.join(references.where(F.col("branch") != branch), "file_id", "left_semi")


def last_wins(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the row of the greatest seq; combined before the shuffle."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), seq).alias("r")).select(key, "r.*")
