"""Exact vector search, rank fusion, and which vectors are missing or stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(vector: Column, query: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int = 50, allowed: Column | None = None, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of greatest dot product, ties to the lesser id; the mask acts before; other dimensions are left out."""
    rows = vectors if allowed is None else vectors.where(allowed)
    rows = rows.where(F.size(vector_col) == len(query))
    return rows.select(F.col(id_col).alias("doc"), dot(F.col(vector_col), query).alias("sim")).orderBy(F.desc("sim"), "doc").limit(k)


def ranked(hits: DataFrame, score: str, name: str) -> DataFrame:
    """1-based ranks of a short list."""
    return hits.select("doc", F.row_number().over(Window.orderBy(F.desc(score), "doc")).cast("long").alias(name))


def fuse(lexical: DataFrame, vector: DataFrame, weight: float = 0.5, k: int = 60) -> DataFrame:
    """Reciprocal ranks of two rank lists (lexical_rank, vector_rank); a missing side adds nothing."""
    part = lambda c: F.coalesce(weight / (k + F.col(c)), F.lit(0.0))
    return lexical.join(vector, "doc", "full_outer").select("doc", "lexical_rank", "vector_rank", (part("lexical_rank") + part("vector_rank")).alias("score"))


def gate(vector_hits: DataFrame, lexical_hits: DataFrame, least: float = 0.7) -> DataFrame:
    """Vector hits that lexical search has too, or that are similar enough alone."""
    both = vector_hits.join(lexical_hits.select(F.col("doc").alias("_d")), F.col("doc") == F.col("_d"), "left")
    return both.where(F.col("_d").isNotNull() | (F.col("sim") >= least)).drop("_d")


def deficit(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc and state: missing (no vector), changed (another hash), stale (no symbol). Both sides have doc, text_hash."""
    s, v = symbols.select("doc", F.col("text_hash").alias("h1")), vectors.select("doc", F.col("text_hash").alias("h2"))
    state = F.when(F.col("in_v").isNull(), "missing").when(F.col("in_s").isNull(), "stale").when(~F.col("h1").eqNullSafe(F.col("h2")), "changed")
    both = s.withColumn("in_s", F.lit(1)).join(v.withColumn("in_v", F.lit(1)), "doc", "full_outer")
    return both.select("doc", state.alias("state")).where("state IS NOT NULL")


def coverage(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    both = symbols.select("doc", F.lit(1).alias("s"), F.col("text_hash").alias("h1")).join(vectors.select("doc", F.lit(1).alias("v"), F.col("text_hash").alias("h2")), "doc", "full_outer")
    same = F.col("h1").eqNullSafe(F.col("h2")) & F.col("s").isNotNull() & F.col("v").isNotNull()
    out = both.agg(F.count("s").alias("total"), F.count_if(same).alias("embedded"), F.count_if(F.col("s").isNotNull() & ~same).alias("missing"), F.count_if(F.col("v").isNotNull() & ~same).alias("stale"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("embedded") / F.col("total"), 1)).otherwise(0.0))


def upsert(vectors: DataFrame, removed: DataFrame, new: DataFrame) -> DataFrame:
    gone = removed.select("doc").unionByName(new.select("doc")).distinct()
    return vectors.join(gone, "doc", "left_anti").unionByName(new)
