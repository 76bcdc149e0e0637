"""Keeping indexes in step: noop, patched or rebuilt; vectors healed in small steps under a time budget; a debounce with a greatest age."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrule.operators import lexical, selection, spaces, vector
from ferrule.sources import files, scratch
from ferrule.streaming import changes as changes_


def consumed(states: dict[str, DataFrame], cursors: dict[str, int]) -> DataFrame:
    """What a consumer has not seen of many spaces' generation tables, as one: a row a path, and the generation to acknowledge by space."""
    every = None
    for space, state in states.items():
        head = state.agg(F.coalesce(F.max("updated_gen"), F.lit(0)).alias("h")).first()["h"]
        at = cursors.get(space, 0)
        rows = spaces.pending(state, at if at <= head else 0).select(F.lit(space).alias("space"), "rel_path", "change", F.lit(head).cast("long").alias("to_gen"))
        every = rows if every is None else every.unionByName(rows)
    return every


def sync_index(spark: SparkSession, index: str, pending: DataFrame, symbols_of: Callable[[DataFrame | None], DataFrame], config: str, source_generation: str = "", parts: int = 64) -> str:
    """Bring an index in step with changes (rel_path, change) and say how: 'noop', 'patched' or 'rebuilt'.

    It is rebuilt if there is none, or if it was made with another configuration or from another generation of its source; else
    the documents of changed files are replaced. symbols_of gives the symbols of these files (rel_path), or of all for None.
    """
    mark = f"{config}|{source_generation}"
    at = scratch.pointer(spark, index)
    if at["version"] == 0 or at["mark"] != mark:
        lexical.write_index(symbols_of(None), index, parts, mark=mark)
        return "rebuilt"
    pending = scratch.written(selection.merged_changes(pending), "sync-pending")
    if pending.isEmpty():
        return "noop"
    known = spark.read.parquet(f"{index}/{at['version']}/postings").select("doc", "file_path").distinct()
    gone = known.join(pending.select(F.col("rel_path").alias("file_path")), "file_path", "left_semi").select("doc")
    lexical.patch_index(spark, index, gone, symbols_of(selection.dirty(pending)), mark=mark)
    return "patched"


def hot_patch(edges: DataFrame, old: DataFrame, new_edges: DataFrame, relink: Callable[[DataFrame], DataFrame], rebuild: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """Edges after files were read anew: those of old nodes go, edges into them from outside are linked again, new ones come. If that
    fails, all is rebuilt; what was there stays until then."""
    from ferrule.operators import graph

    try:
        outside = scratch.written(graph.external_incoming(edges, old), "hot-outside")
        kept = graph.patch(edges, old, new_edges)
        return scratch.written(kept.unionByName(relink(outside)).distinct(), "hot-edges"), "patched"
    except Exception:
        return scratch.written(rebuild(), "hot-edges"), "rebuilt"


@dataclass
class Breaker:
    """Whether vectors fit a time budget: a probe of a few is timed and carried on to all; over it, search goes by words alone."""

    budget_s: float = 3.0
    probe: int = 10
    clock: Callable[[], float] = time.monotonic

    def allows(self, embed: Callable[[int], None], total: int) -> tuple[bool, float]:
        """embed is called with how many to embed. (fits, seconds expected for all)"""
        n = min(self.probe, total)
        if not n:
            return True, 0.0
        began = self.clock()
        embed(n)
        expected = (self.clock() - began) / n * total
        return expected <= self.budget_s, expected


def mode(vectors_there: bool, failed: bool = False) -> str:
    """How a search was answered: by words alone, after a failure, or by both."""
    return "fallback_bm25" if failed else "hybrid_rrf" if vectors_there else "lexical_bm25"


def heal(symbols: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], batch: int = 32) -> tuple[DataFrame, int]:
    """vectors (doc, text_hash, embedding) one step nearer to symbols (doc, text_hash, text): stale ones gone, the least batch of missing and
    changed ones embedded. And how many are left. A step is written, so that steps don't pile up."""
    lack = scratch.written(vector.deficit(symbols, vectors), "heal-lack")
    gone = lack.where("state <> 'missing'").select("doc")
    todo = lack.where("state <> 'stale'").orderBy("doc").limit(batch).select("doc")
    fresh = embed(symbols.join(todo, "doc", "left_semi")).select(*vectors.columns)
    out = scratch.written(vectors.join(gone, "doc", "left_anti").unionByName(fresh), "heal-vectors")
    return out, max(0, lack.where("state <> 'stale'").count() - batch)


def two_stages(words: Callable[[], str], heal_step: Callable[[], int], foreground: Callable[[], bool], most_steps: int = 1000) -> dict:
    """A cycle of the background worker: the words' index and graph first, then vectors step by step, as long as nothing in the foreground waits."""
    out = {"words": words(), "steps": 0, "left": None, "yielded": False}
    for _ in range(most_steps):
        if foreground():
            out["yielded"] = True
            break
        out["left"] = heal_step()
        out["steps"] += 1
        if not out["left"]:
            break
    return out


def propagate(dependents: list[str], dirty_paths: int, has_snapshot: Callable[[str], bool], patch: Callable[[str], None], rescan: Callable[[str], None], done: set[str]) -> dict[str, str]:
    """Take the spaces that depend on a changed one anew, each at most once a batch, and only those that have a snapshot: by a patch for up
    to 200 dirty paths, else by a scan."""
    out = {}
    for name in dependents:
        if name in done or not has_snapshot(name):
            continue
        done.add(name)
        how = "patched" if 1 <= dirty_paths <= changes_.PATCH else "rescanned"
        (patch if how == "patched" else rescan)(name)
        out[name] = how
    return out


def intake(events: DataFrame, ignored: Column, spaces_of: Column) -> DataFrame:
    """File events (path, is_directory, event_type, ts) of watched spaces: a row a space, with whether it asks for a scan (a folder's do)."""
    rows = events.where(~ignored).select("path", "ts", "is_directory", F.explode(spaces_of).alias("space"))
    return rows.select("space", F.when(~F.col("is_directory"), F.col("path")).alias("rel_path"), F.col("is_directory").alias("rescan"), "ts")


def debounced(events: DataFrame, quiet_ms: int = 500, age_ms: int = 5000, late: str = "0 seconds") -> DataFrame:
    """space, paths, rescan, first_ms, last_ms of intake's events, let through once a space is quiet for so long or its first event so old.

    Event time decides, so replays are the same. A batch of more than 200 paths keeps their number alone, as a scan is due anyway.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths, rescan, first, last = (list(state.get[0]), *state.get[1:]) if state.exists else ([], False, None, None)
        out = []

        def flush():
            out.append((key[0], sorted(set(paths)), bool(rescan), int(first), int(last)))

        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("ms")
            for path, scan, ms in zip(rows["rel_path"], rows["rescan"], rows["ms"]):
                if first is not None and (ms - last >= quiet_ms or ms - first >= age_ms):
                    flush()
                    paths, rescan, first = [], False, None
                first, last = (ms if first is None else first), ms
                rescan = rescan or bool(scan)
                if path is not None and len(paths) <= changes_.PATCH:
                    paths.append(path)
        elif first is not None:
            flush()
            first = None
        if first is None:
            state.remove()
        else:
            state.update((paths, bool(rescan), int(first), int(last)))
            state.setTimeoutTimestamp(max(int(min(last + quiet_ms, first + age_ms)), int(state.getCurrentWatermarkMs()) + 1))
        yield pd.DataFrame(out, columns=["space", "paths", "rescan", "first_ms", "last_ms"])

    timed = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    schema = "space string, paths array<string>, rescan boolean, first_ms long, last_ms long"
    return timed.groupBy("space").applyInPandasWithState(run, schema, "paths array<string>, rescan boolean, first_ms long, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def polled(before: DataFrame, spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The folders right under root now, and those that came and went (rel_path, change) since before."""
    now = files.scan(spark, root).select(F.regexp_extract("rel_path", r"^([^/]+)/", 1).alias("rel_path")).where("rel_path <> ''").distinct()
    came = now.join(before, "rel_path", "left_anti").select("rel_path", F.lit("added").alias("change"))
    return now, came.unionByName(before.join(now, "rel_path", "left_anti").select("rel_path", F.lit("deleted").alias("change")))
