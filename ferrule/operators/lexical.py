"""BM25 over four fields: an index on disk, search that reads its terms' postings alone, roll-up by file, adaptive cut-offs.

A posting holds a term, a document, the term's frequency in each field, and what scoring and filters need of the document. The index
is made of segments: files of some documents each, sorted by term. Its documents are dealt out once, by size, and their postings
never; a search reads the pages of its terms in each segment and nothing else, and shuffles only the documents that match.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import marked, terms, tokenize
from ferrule.sources import scratch

FIELDS = {"name": 3.5, "signature": 2.0, "members": 2.0, "docstring": 1.5}
K1, B = 1.5, 0.75
#: Characters of text in a task that makes a segment, and postings in one that rewrites segments: they bound its memory whatever the input.
SEGMENT, REWRITTEN = 8_000_000, 1_000_000


def dealt(symbols: DataFrame, id_col: str = "id", least: int = 1) -> DataFrame:
    """symbols with doc (their id) in so many partitions, by doc, that each has about SEGMENT characters: what is grouped by doc from here is not shuffled."""
    n = symbols.agg(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.length(f), F.lit(0)).cast("long") for f in FIELDS)))).first()[0] or 0
    return symbols.withColumn("doc", F.col(id_col)).repartition(max(least, symbols.sparkSession.sparkContext.defaultParallelism, ceil(n / SEGMENT)), "doc")


def tokenized(symbols: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, and each field's terms (t_name and so on): each text is marked once and split once a row."""
    out = symbols.select(*keep, *(marked(F.col(f)).alias(f"m_{f}") for f in FIELDS))
    return out.select("*", *(terms(F.col(f"m_{f}")).alias(f"t_{f}") for f in FIELDS)).drop(*(f"m_{f}" for f in FIELDS))


def words(tokens: DataFrame) -> DataFrame:
    """tokens with a row for each term: term, and its place i in all fields' terms, by which frequencies() tells its field (l_ columns: fields' lengths)."""
    sized = tokens.select("*", *(F.size(f"t_{f}").cast("int").alias(f"l_{f}") for f in FIELDS))
    return sized.select(*(c for c in sized.columns if not c.startswith("t_")), F.posexplode(F.concat(*(F.col(f"t_{f}") for f in FIELDS))).alias("i", "term"))


def frequencies(kind: str) -> list[Column]:
    """Aggregates over words(): how often a term stands in each field."""
    ends = {f: reduce(lambda a, b: a + b, (F.col(f"l_{g}") for g in list(FIELDS)[: k + 1])) for k, f in enumerate(FIELDS)}
    return [F.count_if((F.col("i") < end) & (F.col("i") >= end - F.col(f"l_{f}"))).cast(kind).alias(f"f_{f}") for f, end in ends.items()]


def postings(symbols: DataFrame, id_col: str = "id") -> DataFrame:
    """term, doc, and its frequency in each field: one row a term and document. Texts are dealt out, not terms."""
    return words(tokenized(dealt(symbols, id_col), [F.col("doc")])).groupBy("doc", "term").agg(*frequencies("long"))


def lengths(symbols: DataFrame, id_col: str = "id") -> DataFrame:
    tokens = tokenized(symbols, [F.col(id_col).alias("doc")])
    return tokens.select("doc", *(F.size(f"t_{f}").cast("long").alias(f"l_{f}") for f in FIELDS))


def statistics(doc_lengths: DataFrame) -> DataFrame:
    """One row: documents, and each field's mean length, at least 1."""
    n = F.count("*")
    return doc_lengths.agg(n.alias("docs"), *(F.greatest(F.lit(1.0), F.coalesce(F.sum(f"l_{f}") / n, F.lit(1.0))).alias(f"a_{f}") for f in FIELDS))


def idf(df: Column, docs: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), (docs - df + 0.5) / (df + 0.5)))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def term_documents(symbols: DataFrame, id_col: str = "id") -> DataFrame:
    """document_frequency(postings(symbols)) without postings: a row's terms are told apart in the row, and just counted after.

    Only texts whose id stands in several rows are told apart by id, as they are one document. No term crosses a line, so a row's
    fields are read as the lines of one text.
    """
    symbols = scratch.spread(symbols).select(F.col(id_col).alias("doc"), *FIELDS)
    several = scratch.written(symbols.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "terms-several")
    own = lambda rows: rows.select("doc", marked(F.concat_ws("\n", *FIELDS)).alias("m")).select("doc", F.explode(F.array_distinct(terms(F.col("m")))).alias("term"))
    if several.isEmpty():
        return document_frequency(own(symbols))
    same = symbols["doc"].eqNullSafe(several["doc"])
    once, more = symbols.join(several, same, "left_anti"), symbols.join(several, same, "left_semi")
    return document_frequency(own(once).unionByName(own(more).distinct()))


def query_terms(text: str, spark) -> list[str]:
    return spark.range(1).select(tokenize(F.lit(text))).first()[0]


ATTRIBUTES = ("space", "language", "kind", "file_path")


def entries(symbols: DataFrame, parts: int, id_col: str = "id", attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """The index's rows: term, doc, frequencies, field lengths, hashes of the name and of its last segment, attributes, and whether
    it is the document's first row (lead), by which its lengths are summed once.

    Each text is tokenized once, in a task of bounded size (at least so many parts); its terms are counted where they are.
    """
    name = F.lower("name")
    own = [F.col("doc"), F.xxhash64(name).alias("whole_name"), F.xxhash64(F.element_at(F.split(name, r"[.]|::"), -1)).alias("last_name")]
    own += [F.col(c) if c in symbols.columns else F.lit(None).cast("string").alias(c) for c in attributes]
    rows = words(tokenized(dealt(symbols, id_col, parts), own))
    keys = ["term", "doc", *(f"l_{f}" for f in FIELDS), "whole_name", "last_name", *attributes]
    return rows.groupBy(*keys).agg(*frequencies("int"), (F.min("i") == 0).alias("lead"))


def put_index(rows: DataFrame, docs: DataFrame, path: str, parts: int, mark: str | None) -> None:
    """A new version of the index from its rows (dealt out by doc) and the documents (doc), named once it is whole: readers never see half of one."""
    spark, version = rows.sparkSession, scratch.pointer(rows.sparkSession, path)["version"] + 1
    to = f"{path}/{version}"
    rows.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{to}/postings")
    own = spark.read.parquet(f"{to}/postings")
    document_frequency(own).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{to}/terms")
    docs.write.mode("overwrite").parquet(f"{to}/docs")
    n = spark.read.parquet(f"{to}/docs").agg(F.count("*").alias("docs"))
    sums = own.where("lead").agg(*(F.sum(f"l_{f}").alias(f"l_{f}") for f in FIELDS)).crossJoin(F.broadcast(n))  # one row
    mean = lambda f: F.greatest(F.lit(1.0), F.coalesce(F.col(f"l_{f}") / F.col("docs"), F.lit(1.0))).alias(f"a_{f}")
    sums.select("docs", *(mean(f) for f in FIELDS), F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{to}/statistics")
    scratch.point(spark, path, version, mark)


def write_index(symbols: DataFrame, path: str, parts: int = 64, id_col: str = "id", mark: str | None = None) -> None:
    """Index symbols anew under path, in as many segments as their size asks for, parts at least. mark says what was indexed."""
    put_index(entries(symbols, parts, id_col), symbols.select(F.col(id_col).alias("doc")), path, parts, mark)


def patch_index(spark: SparkSession, path: str, dirty: DataFrame, new: DataFrame, id_col: str = "id", mark: str | None = None) -> None:
    """The next version of the index: without the documents of dirty (column doc), with the symbols of new."""
    at = f"{path}/{scratch.pointer(spark, path)['version']}"
    parts = spark.read.parquet(f"{at}/statistics").first()["parts"]
    rows, docs = spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/docs")
    n = max(parts, ceil(rows.count() / REWRITTEN))
    put_index(patched(rows, dirty, entries(new, parts, id_col)).repartition(n, "doc"), patched(docs, dirty, new.select(F.col(id_col).alias("doc"))), path, parts, mark)


def search_index(spark: SparkSession, path: str, text: str, where: Column | None = None, min_score: float = 0.0, limit: int | None = 10, weight: Column | None = None) -> DataFrame:
    """doc, score, matched (distinct terms) and the document's attributes: the best documents. Ties go to the lesser doc.

    Only the pages of the query's terms are read, as segments are sorted by term. Statistics count all documents;
    the filter, over the attributes, acts before scores. Repeated terms of the query score again. A query that is the name or
    its last segment scores double. With three terms or more, half of them must match, unless one is the query.
    """
    at, asked = f"{path}/{scratch.pointer(spark, path)['version']}", query_terms(text, spark)
    stats = spark.read.parquet(f"{at}/statistics").first()  # one row
    rows = spark.read.parquet(f"{at}/postings")
    own = {t: asked.count(t) for t in asked}
    chosen = F.col("term").isin(*own) if own else F.lit(False)
    df = {r["term"]: r["df"] for r in spark.read.parquet(f"{at}/terms").where(chosen).collect()}  # a row a term of the query
    rows = rows.where(chosen) if where is None else rows.where(chosen).where(where)
    value = lambda f: FIELDS[f] * F.col(f"f_{f}") * (K1 + 1) / (F.col(f"f_{f}") + K1 * (1 - B) + 1e-9 + K1 * B / stats[f"a_{f}"] * F.greatest(F.col(f"l_{f}"), F.lit(1)))
    times = F.lit(0.0)
    for t, n in own.items():
        times = F.when(F.col("term") == t, n * idf(F.lit(df.get(t, 0)), F.lit(stats["docs"]))).otherwise(times)
    score = times * reduce(lambda a, b: a + b, (value(f) for f in FIELDS))
    query = text.strip().lower()
    double = (F.col("whole_name") == F.xxhash64(F.lit(query))) | (F.col("last_name") == F.xxhash64(F.lit(query)))
    attributes = [c for c in rows.columns if c not in ("term", "doc", "whole_name", "last_name", "lead") and c[:2] not in ("f_", "l_")]
    out = rows.groupBy("doc").agg(F.sum(score).alias("score"), F.count("*").alias("matched"), F.max(F.col("term") == query).alias("_whole"), F.max(double).alias("_double"), *(F.first(c).alias(c) for c in attributes))
    total = F.when(F.col("_double"), F.col("score") * 2).otherwise(F.col("score"))
    out = out.withColumn("score", total if weight is None else total * weight)
    out = out.where(F.col("score") >= min_score) if min_score > 0 else out.where("score > 0")
    if len(asked) >= 3:
        out = out.where((F.col("matched") / len(asked) >= 0.5) | F.col("_whole"))
    out = out.select("doc", "score", "matched", *attributes)
    return out if limit is None else out.orderBy(F.desc("score"), "doc").limit(limit)


def overfetch(limit: int) -> int:
    """How many candidates each side of a fused search gives."""
    return max(3 * limit, 30)


def pool(limit: int, documents: int) -> int:
    """How many symbols a search that rolls up by file takes from each side."""
    return max(32 * limit, min(documents, 1000), 60)


def space_weight(space: Column, weights: dict[str, float]) -> Column:
    """Exact name, else its last segment, else 1."""
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.element_at(F.split(space, "/"), -1) == name, float(w)).otherwise(out)
    for name, w in weights.items():
        out = F.when(space == name, float(w)).otherwise(out)
    return out


def roll_up(hits: DataFrame, by: str = "file_path", alpha: float = 0.2, limit: int | None = 10) -> DataFrame:
    """Per file: the best score and alpha of the rest, the number of hits, its three best documents. No more than three are gathered."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc"))
    rows = hits.withColumn("_n", place)
    best = F.sort_array(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", F.col("doc").cast("string").alias("doc")))))
    out = rows.groupBy(by).agg((F.max("score") + alpha * (F.sum("score") - F.max("score"))).alias("total_score"), F.count("*").alias("hits"), F.array_join(F.transform(best, lambda x: x["doc"]), ",").alias("top_items"))
    return out if limit is None else out.orderBy(F.desc("total_score"), by).limit(limit)


def adaptive_cut(ranked: DataFrame, score: str = "score", tie: str = "doc", of_top: float = 0.38, of_previous: float = 0.55, keep: int = 3) -> DataFrame:
    """After the first rows, stop at the first that falls below a share of the best or of the one before. For ranked lists, which limits keep short."""
    order = Window.orderBy(F.desc(score), tie)
    rank, prev, top = F.row_number().over(order), F.lag(score).over(order), F.first(score).over(order)
    cut = (rank > keep) & ((F.col(score) < top * of_top) | (F.col(score) < prev * of_previous))
    out = ranked.withColumn("rank", rank.cast("long")).withColumn("_cut", cut.cast("int"))
    return out.withColumn("_cut", F.max("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_cut")


def patched(index: DataFrame, dirty: DataFrame, new: DataFrame) -> DataFrame:
    """Postings (or lengths) without those of dirty documents (column doc), and the new ones."""
    return index.join(dirty.select("doc").distinct(), "doc", "left_anti").unionByName(new)


def render_cut(ranked: DataFrame, score: str = "score", tie: str = "doc", most: int = 15) -> DataFrame:
    """What is worth showing of a short ranked list: a fifth of the best, and 0.5 if the best has that; from the fourth row on
    no fall below 0.4 of the one before or 0.15 of the best. At most so many, at least one."""
    order = Window.orderBy(F.desc(score), tie)
    rank, prev, top = F.row_number().over(order), F.lag(score).over(order), F.first(score).over(order)
    low = F.greatest(top * 0.2, F.when(top >= 0.5, 0.5).otherwise(0.0))
    cut = (rank > 1) & ((F.col(score) < low) | (rank > 3) & ((F.col(score) < prev * 0.4) | (F.col(score) < top * 0.15)) | (rank > most))
    out = ranked.withColumn("rank", rank.cast("long")).withColumn("_cut", cut.cast("int"))
    return out.withColumn("_cut", F.max("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_cut")
