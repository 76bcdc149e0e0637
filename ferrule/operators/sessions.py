"""Events and transcripts: summaries, sessions by gap, runs, churn, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_filter(time: Column, cutoff: str) -> Column:
    """Rows from a time on; those without a time pass."""
    return time.isNull() | (time >= F.lit(cutoff).cast("timestamp"))


def summary(events: DataFrame, by: str | None = None) -> DataFrame:
    """Calls, failures, sum and mean of durations, first and last time; of all rows or by a column."""
    aggs = [F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    return events.agg(*aggs) if by is None else events.groupBy(by).agg(*aggs)


def sessions(events: DataFrame, actor: str, gap_s: int = 1800) -> DataFrame:
    """Per actor and session: its number, first and last time, events. A gap of more than gap_s starts a new one."""
    order = Window.partitionBy(actor).orderBy("ts", "id")
    new = (F.col("ts").cast("double") - F.lag("ts").over(order).cast("double") > gap_s).cast("long")
    marked = events.withColumn("session", F.coalesce(F.sum(new).over(order), F.lit(0)))
    return marked.groupBy(actor, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def last_session(events: DataFrame, actor: str, gap_s: int = 1800) -> DataFrame:
    """Each actor's events after its last gap."""
    order = Window.partitionBy(actor).orderBy(F.desc("ts"), F.desc("id"))
    gap = (F.lag("ts").over(order).cast("double") - F.col("ts").cast("double") > gap_s).cast("int")
    return events.withColumn("_g", F.coalesce(F.sum(gap).over(order), F.lit(0))).where("_g = 0").drop("_g")


def runs(events: DataFrame, actor: str, what: str, least: int = 3) -> DataFrame:
    """Runs of at least so many successive events of one kind: where they start and how long they are."""
    by, own = Window.partitionBy(actor).orderBy("ts", "id"), Window.partitionBy(actor, what).orderBy("ts", "id")
    islands = events.withColumn("_i", F.row_number().over(by) - F.row_number().over(own))
    return islands.groupBy(actor, what, "_i").agg(F.min("ts").alias("first_ts"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_i")


def churn(edits: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Per file, edits that do not follow the one before at once: 1 and one more for each gap in steps."""
    prev = F.lag(step).over(Window.partitionBy(*keys).orderBy(step))
    return edits.withColumn("_n", (F.col(step) - prev > 1).cast("long")).groupBy(*keys).agg((F.lit(1) + F.coalesce(F.sum("_n"), F.lit(0))).alias("separate_edits"), F.count("*").alias("edits"))


def shares(steps: DataFrame, by: str, amount: str, top: int = 10) -> DataFrame:
    """Calls, amount, mean and percentage of all, of the largest groups."""
    total = steps.groupBy(by).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))
    out = total.withColumn("pct", F.round(100 * F.col("amount") / F.sum("amount").over(Window.partitionBy()), 1))  # a row a group
    return out.withColumn("mean", F.round(F.col("amount") / F.col("calls"), 1)).orderBy(F.desc("amount"), by).limit(top)


def heaviest(steps: DataFrame, key: str, amount: str, top: int = 5) -> DataFrame:
    return steps.groupBy(key).agg(F.max(amount).alias(amount)).orderBy(F.desc(amount), key).limit(top)


def listing(steps: DataFrame) -> DataFrame:
    """Per conversation: steps, user turns, tokens."""
    return steps.groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum("tokens").alias("tokens"))


def attribute_output(steps: DataFrame) -> DataFrame:
    """Each output row (tokens) to the planning step before it, with that step's number and an even share of its tools."""
    last = F.last(F.when(F.col("tools") > 0, F.struct("step", "tools")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    out = steps.withColumn("_p", last).where("is_output AND _p IS NOT NULL")
    return out.select("conv_id", "step", F.col("_p.step").alias("planner"), F.greatest(F.lit(1), F.bround(F.col("tokens") / F.col("_p.tools")).cast("long")).alias("share"))


def modes(events: DataFrame, *sets: str) -> DataFrame:
    """Calls and failures by each of these columns alone, in one pass; the columns not grouped by are null."""
    cols = [F.col(c) for c in sets]
    return events.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"))


def ratchet(samples: DataFrame, actor: str, value: str, step: float) -> DataFrame:
    """Per actor the longest row of growths of at least step that no fall interrupts, and the last value by the first."""
    order = Window.partitionBy(actor).orderBy("ts", "id")
    grown = samples.withColumn("_d", F.col(value) - F.lag(value).over(order))
    grown = grown.withColumn("_r", F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).over(order))
    runs_ = grown.groupBy(actor, "_r").agg(F.count_if(F.col("_d") >= step).alias("streak"), F.min_by(value, F.struct("ts", "id")).alias("first"), F.max_by(value, F.struct("ts", "id")).alias("last"))
    return runs_.groupBy(actor).agg(F.max("streak").alias("streak"), F.max(F.col("last") - F.col("first")).alias("growth"))


def longest_run(steps: DataFrame, actor: str, order: str, counts: Column, resets: Column) -> DataFrame:
    """Per actor the most counted rows between two that reset."""
    w = Window.partitionBy(actor).orderBy(order)
    parts = steps.withColumn("_p", F.sum(F.when(resets, 1).otherwise(0)).over(w))
    return parts.groupBy(actor, "_p").agg(F.count_if(counts).alias("n")).groupBy(actor).agg(F.max("n").alias("longest"))


def repeated_reads(steps: DataFrame, actor: str, order: list[str], edit: Column, key: str) -> DataFrame:
    """Per actor the reads of a key already read since the last edit."""
    parts = steps.withColumn("_p", F.sum(F.when(edit, 1).otherwise(0)).over(Window.partitionBy(actor).orderBy(*order)))
    reads = parts.where(~edit).groupBy(actor, "_p", key).agg((F.count("*") - 1).alias("n"))
    return reads.groupBy(actor).agg(F.sum("n").alias("repeated"))


def baseline(samples: DataFrame, actor: str, value: str, first: int = 3, least: float = 256.0) -> DataFrame:
    """Per actor the median of its first samples, at least so much."""
    w = Window.partitionBy(actor).orderBy("ts", "id")
    head = samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    return head.groupBy(actor).agg(F.greatest(F.lit(least), F.median(value)).alias("baseline"))


def efficiency(steps: DataFrame, by: str, amount: str, wasted: Column) -> DataFrame:
    """Per group: all, what was wasted (no more than all), and the useful percentage."""
    waste = F.least(F.sum(amount), F.coalesce(F.sum(F.when(wasted, F.col(amount))), F.lit(0)))
    out = steps.groupBy(by).agg(F.sum(amount).alias("total"), waste.alias("waste"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * (F.col("total") - F.col("waste")) / F.col("total"), 1)).otherwise(F.lit(100.0)))
