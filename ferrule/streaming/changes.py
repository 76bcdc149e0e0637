"""Streams of file changes and events: sessions with late data, generation tables kept by micro-batches, fan-out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import spaces
from ferrule.sources import scratch
from ferrule.sources.files import load_snapshot, save_snapshot, snapshot_summary

STATE = "rel_path string, created_gen long, updated_gen long, is_deleted boolean"
#: More dirty paths than these ask for a scan of the whole space.
PATCH = 200


def event_sessions(events: DataFrame, actor: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per actor and session: start, end, events. Rows later than the watermark are dropped, as any streaming window has it."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(actor, w.alias("w")).agg(F.count("*").alias("events")).select(actor, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def event_counts(events: DataFrame, by: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), by, "events")


def apply_changes(spark: SparkSession, changes: DataFrame, path: str, batch: str | None = None) -> int:
    """The generation table at path after a batch of changes (rel_path, seq, exists); the new head.

    Of several changes of a path the last counts. A path that is known and alive is modified, else added; one that is gone is
    deleted. Without a change in effect the generation stays. The new table is written beside the old one and named, with the
    batch, in its place: a batch that failed leaves what was there and can run again, and one that is named is not taken twice.
    """
    at = scratch.pointer(spark, path)
    now = snapshot_summary(spark, f"{path}/{at['version']}")
    head = (now["head"] if now else 0) + 1
    if batch is not None and at["mark"] == batch:
        return head - 1
    state = load_snapshot(spark, f"{path}/{at['version']}", STATE)
    last = changes.groupBy("rel_path").agg(F.max_by("exists", "seq").alias("exists"))
    alive = state.select("rel_path", (~F.col("is_deleted")).alias("alive"))
    change = F.when(F.col("exists") & F.coalesce("alive", F.lit(False)), "modified").when(F.col("exists"), "added").when(F.col("alive"), "deleted")
    diff = last.join(alive, "rel_path", "left").select("rel_path", change.alias("change")).where("change IS NOT NULL")
    diff = scratch.written(diff, "changes")
    if diff.isEmpty():
        return head - 1
    save_snapshot(spaces.advance(state, diff, head), f"{path}/{at['version'] + 1}")
    scratch.point(spark, path, at["version"] + 1, batch)
    return head


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return load_snapshot(spark, f"{path}/{scratch.pointer(spark, path)['version']}", STATE)


def maintain(changes: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", once: bool = False):
    """A query that keeps the generation table at path; the trigger's interval is the debounce. Each batch counts once."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply_changes(df.sparkSession, df, path, f"{checkpoint}#{n}"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def patch_or_rescan(changes: DataFrame, most: int = PATCH) -> str:
    """Which of the two a batch asks for. Counts no more rows than needed to know."""
    return "patch" if changes.select("rel_path").distinct().limit(most + 1).count() <= most else "rescan"


def fan_out(stream: DataFrame, subscribers: dict[str, tuple[Column | None, Callable[[DataFrame], None]]], checkpoint: str, once: bool = False):
    """Each batch goes to every subscriber whose filter it passes (none: all of it); a failing one is logged, no more."""

    def deliver(df: DataFrame, number: int) -> None:
        df.persist()
        for name, (where, call) in subscribers.items():
            try:
                call(df if where is None else df.where(where))
            except Exception:
                logging.getLogger(__name__).exception("subscriber %s failed on batch %s", name, number)
        df.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Consumer:
    """A reader's progress in a space's generations: what it has not seen, acknowledged only on a clean end."""

    def __init__(self, spark: SparkSession, name: str, state_path: str, cursor_path: str):
        self.spark, self.name, self.state_path, self.cursor_path = spark, name, state_path, cursor_path

    def acked(self) -> int:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.parquet(self.cursor_path).where(F.col("consumer") == self.name)
            return rows.agg(F.coalesce(F.max_by("acked_generation", "n"), F.lit(0)).alias("g")).first()["g"]
        except AnalysisException:
            return 0

    def head(self) -> int:
        found = snapshot_summary(self.spark, f"{self.state_path}/{scratch.pointer(self.spark, self.state_path)['version']}")
        return found["head"] if found else 0

    def ack(self, generation: int) -> None:
        from pyspark.errors import AnalysisException

        try:
            n = self.spark.read.parquet(self.cursor_path).count()
        except AnalysisException:
            n = 0
        self.spark.range(1).select(F.lit(self.name).alias("consumer"), F.lit(generation).cast("long").alias("acked_generation"), F.lit(n).cast("long").alias("n")).write.mode("append").parquet(self.cursor_path)

    def reset(self) -> None:
        self.ack(0)

    def __enter__(self) -> DataFrame:
        """What is new; a cursor ahead of the head starts from 0."""
        self._to = self.head()
        at = self.acked()
        return spaces.pending(read_state(self.spark, self.state_path), at if at <= self._to else 0)

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.ack(self._to)
