"""Quality rules: counts inside each document, and lines that too many documents of a host share.

Lines are normalised (lower case, each run of anything but letters one space) and hashed. For each host the documents that
hold a line are counted, repeated rows and copies among them, and so are their distinct texts: a line of one page's copies is
no boilerplate. Lines above both limits, which are absolute and so hold at every size, are removed; a document of which too few
words stay is rejected. All with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import written

MIN_WORDS, MOST_REPEATS, WINDOW = 20, 30, 8
#: A line is boilerplate if in more documents of a host than the first and in no fewer texts than the second; a document is
#: depleted if fewer words than the third stay.
MOST_DOCUMENTS, LEAST_TEXTS, WORDS_LEFT = 50, 10, 20
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One pass over the texts: id, host, k1 and k2 (the text hashed), the counts, and the normalised lines' hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")).select("id", "host", text.alias("text"))
    out = out.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    out = out.withColumn("raw", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("grams", F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    out = out.select(
        "id",
        "host",
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit("k2"), "text").alias("k2"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.transform("raw", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("w"))).alias("lines"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"),
    )
    same = lambda x, k: F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False))
    out = out.withColumn("p", F.array_sort(F.transform(F.filter("s", lambda x, k: F.when(k > 0, same(x, k)).otherwise(F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))).drop("s")
    covered = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW))).cast("long"))
    return out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("p")


def judged(slim: DataFrame, most_documents: int = MOST_DOCUMENTS, least_texts: int = LEAST_TEXTS, words_left: int = WORDS_LEFT) -> DataFrame:
    """slim (from measured, written) with base_failed, removed (hashes of removed lines, null if none) and kept."""
    texts = slim.groupBy("host", "k1", "k2").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    texts = texts.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("none"), "k1", "k2", "copies", F.explode("lines").alias("l"))
    rows = written(texts.groupBy("host", "none", "k1", "k2", F.col("l.h").alias("h")).agg(F.sum("l.w").alias("w"), F.first("copies").alias("copies")), "quality-lines")
    counts = rows.groupBy("host", "none", "h").agg(F.sum("copies").alias("documents"), F.count("*").alias("texts"))
    often = written(counts.where((F.col("documents") > most_documents) & (F.col("texts") >= least_texts)).select("host", "none", "h"), "quality-often")
    lost = written(rows.join(often, ["host", "none", "h"]).groupBy("host", "none", "k1", "k2").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("removed")), "quality-lost")
    keyed = slim.drop("lines").withColumn("none", F.col("host").isNull()).withColumn("name", F.coalesce("host", F.lit("")))
    out = keyed.join(lost.withColumnRenamed("host", "name"), ["name", "none", "k1", "k2"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost").isNull() | (F.col("n_words") - F.col("lost") >= words_left)))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_removed.

    Null texts have no words, so they fail. A null host is a host of its own. Repeated rows get the same verdict; each counts as
    a document, together as one text. An empty table gives an empty one. Only three columns are read, so others' names cannot
    clash.
    """
    slim = written(measured(df, id_col, text_col, host_col), "quality")
    return judged(slim).select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("lost", F.lit(0)).cast("long").alias("words_removed"))


def cleaned(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """df's rows that are kept, with all their columns; lines above the limits are taken out of the texts.

    Nulls, repeated rows and empty tables as in quality. A row is carried as one struct, so its columns can have any names.
    """
    slim = written(measured(df, text_col, text_col, host_col).drop("id").withColumn("id", F.lit(0)), "quality")
    verdicts = judged(slim).where("kept").select("name", "none", "k1", "k2", "removed").dropDuplicates(["name", "none", "k1", "k2"])
    verdicts = written(verdicts, "quality-verdicts")
    text, host = F.coalesce(df[f"`{text_col}`"], F.lit("")), df[f"`{host_col}`"]
    keys = {"name": F.coalesce(host, F.lit("")), "none": host.isNull(), "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("k2"), text)}
    joined = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), *(v.alias(k) for k, v in keys.items())).join(verdicts, list(keys))
    own = F.col("row").getField(text_col)
    lines = F.filter(F.split(own, "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normalised(x))) | ~x.rlike(r"[^\x20\x09-\x0D]"))
    cut = F.when(F.col("removed").isNull(), own).otherwise(F.array_join(lines, "\n"))
    return joined.select(*((cut if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM f WHERE len(ws) >= 8)),
dup AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM dup) GROUP BY r),
b AS (SELECT f.r, doc_id, source, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, ls FROM f LEFT JOIN rep USING (r)),
tx AS (SELECT source, t, any_value(ls) AS ls, count(*) AS copies FROM b GROUP BY source, t),
ln AS (SELECT source, t, trim(regexp_replace(lower(l), '[^\p{L}]+', ' ', 'g')) AS h, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS w, copies FROM (SELECT source, t, copies, unnest(ls) AS l FROM tx) GROUP BY ALL),
oft AS (SELECT source, h FROM ln GROUP BY ALL HAVING sum(copies) > 50 AND count(*) >= 10),
lost AS (SELECT ln.source, ln.t, sum(w)::BIGINT AS lost FROM ln JOIN oft ON ln.h = oft.h AND ln.source IS NOT DISTINCT FROM oft.source GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (lost IS NULL OR n_words - lost >= 20) AS kept, coalesce(lost, 0)::BIGINT AS words_removed
FROM b LEFT JOIN lost ON b.t = lost.t AND b.source IS NOT DISTINCT FROM lost.source
"""
