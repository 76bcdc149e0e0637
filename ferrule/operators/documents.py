"""Lines of documents: search with context, sections, snippets, traceability gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    out = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    return out.withColumn("n", (F.col("n") + 1).cast("long"))


def find_lines(docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """doc, line number, line, and the lines before and after, of each line that holds the text in any case. No shuffle."""
    all_ = docs.where(F.lower(text_col).contains(needle.lower())).select(F.col(id_col).alias("doc"), F.split(text_col, "\n").alias("ls"))
    hit = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.lower(F.element_at("ls", i)).contains(needle.lower()))
    at = all_.select("doc", "ls", F.explode(hit).alias("i"))
    get = lambda k: F.coalesce(F.get("ls", F.col("i") - 1 + k), F.lit(""))
    out = at.select("doc", F.col("i").cast("long").alias("n"), get(0).alias("line"), F.when(F.col("i") > 1, get(-1)).otherwise("").alias("before"), get(1).alias("after"))
    return out if limit is None else out.orderBy("doc", "n").limit(limit)


def sections(docs: DataFrame, id_col: str, text_col: str, heading: str = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*$") -> DataFrame:
    """Headings of Markdown texts, fenced code left out: level, name, first and last line of each section."""
    rows = lines(docs, id_col, text_col)
    order = Window.partitionBy("doc").orderBy("n")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = rows.withColumn("open", F.sum(fence.cast("int")).over(order) % 2).withColumn("last", F.max("n").over(Window.partitionBy("doc")))
    heads = rows.where((F.col("open") == 0) & ~fence & F.col("line").rlike(heading))
    return heads.select("doc", F.length(F.regexp_extract("line", heading, 1)).cast("long").alias("level"), F.regexp_extract("line", heading, 2).alias("name"), "n", F.coalesce(F.lead("n").over(order) - 1, F.col("last")).alias("end_line"))


def snippet(text: Column, line: Column, before: int = 2, after: int = 8, most: int | None = None) -> Column:
    """The lines around one, cut at the text's ends and to the most lines around it."""
    ls = F.split(text, "\n")
    first, last = F.greatest(line - before, F.lit(1)), F.least(line + after, F.size(ls))
    if most is not None:
        first = F.greatest(first, F.least(line - most // 2, last - most + 1))
        last = F.least(last, first + most - 1)
    return F.array_join(F.slice(ls, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n")


def gaps(required: DataFrame, covered: DataFrame) -> DataFrame:
    """Ids of one table that the other lacks."""
    return required.select("id").distinct().join(covered, "id", "left_anti")
