"""Mixing sources to target weights: hash-random keys, prefix sums of word counts, a cut at each source's exact budget.

A document's key is an MD5 of its id and text, so reruns agree. The key's leading digits split each source into ranges of
near equal size; sums of the ranges give each range's offset, a window inside one range gives the rest. Rows alike in all are
one row with a count. No source and no repeated row, however hot, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm._shared import repeated, written

WEIGHTS = (3, 1, 2)
#: Share of all words, most epochs of a source, rows aimed at in a range of keys.
SHARE, EPOCHS, RANGE_ROWS = 1.5, 2, 50_000


def word_count(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source_size per source to a target: shares by weight, stopped at epochs times the size, the excess shared anew.

    With sources in order of cap by weight, those before the first that stays under its cap are stopped; level is what a
    unit of weight gets there. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.lit(weights[-1])
    for i, x in list(enumerate(weights))[:-1]:
        w = F.when((F.row_number().over(order) - 1) % len(weights) == i, x).otherwise(w)
    out = sources.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - before) / from_here)
    out = out.withColumn("at", F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every))
    return out.select("source", "source_size", F.least("cap", F.coalesce(F.col("at.level") * F.col("w"), F.col("cap"))).alias("target"))


def ordered(slim: DataFrame) -> DataFrame:
    """slim (source, words, mix_key and more) with words_before: the words of the source's documents of lesser keys."""
    rows = slim.count()
    digits = 1
    while digits < 8 and rows > RANGE_ROWS * 16**digits:
        digits += 1
    dealt = slim.withColumn("part", F.substring("mix_key", 1, max(2, digits)))
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    dealt = dealt.withColumn("src", name)
    sums = dealt.groupBy("src", "part").agg(F.sum("words").alias("words"))
    offsets = written(sums.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("src", "part", "offset"), "mix-offsets")
    inside = Window.partitionBy("src", "part").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(offsets, ["src", "part"]).withColumn("words_before", F.col("offset") + F.col("inside"))


def budgeted(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """A written table slim (source, mix_key, words and more) with source_size, target, full (epochs taken of all) and rest
    (words of this row in the last, part epoch): a row's words are taken full times, and the first rest of them once more."""
    sources = slim.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = written(targets(sources, weights, share, epochs), "mix-targets")
    goal = goal.select("source_size", "target", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"))
    budget = F.round("target").cast("long")
    joined = ordered(slim).join(goal, "src")
    joined = joined.withColumn("full", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    return joined.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("full") * F.col("source_size") - F.col("words_before"))))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per row: id, size, source, source_size, target and taken (words the mix takes, repeats counted), and mix_key.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own, the last; null ids take their key
    from the text alone. Repeated rows are rows of their own. Sources without words have target 0. An empty table gives an
    empty one. Only three columns are read, so others' names cannot clash.
    """
    light = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mix_key(F.col(id_col), F.col(text_col)).alias("mix_key"))
    slim = written(light.groupBy("id", "source", "size", "mix_key").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n")), "mix")
    rows = repeated(written(budgeted(slim, weights, share, epochs), "mix-taken"), "n", "k")
    taken = F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("k") * F.col("size")))
    return rows.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.alias("taken"), "mix_key")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio > level) * w, cap))::DOUBLE AS target FROM l),
p AS (SELECT d.*, g.source_size, g.target, round(g.target)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END::BIGINT AS taken FROM p
"""
