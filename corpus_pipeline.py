"""The corpus pipeline: stages from documents to token ids, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import _shared, bpe, mixing, quality, simhash, suffix
from ferrule.llm.queries import rank_file

#: No SQL: fingerprints, byte spans and token ids are beyond it; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; lines above the limits leave the texts of the others.

    Null and empty texts have no words, so they go. A null source is a host of its own. Repeated rows share a verdict. An
    empty table gives an empty one. Other columns are carried as they are, whatever their names.
    """
    _shared.release(spark)
    return sized(quality.cleaned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words a shingle, similarity 0.8) the document of least doc_id stays, null last.

    Rows of one doc_id are told apart by text; of rows alike in both one stays, that of least hash. Null texts and texts
    without words are alike, so one of them stays. Each group keeps a row. An empty table gives an empty one. A row is carried
    as one struct, so its columns can have any names.
    """
    _shared.release(spark)
    found = simhash.near_duplicates(docs, shingle=5, bits=3, similarity=0.8, keyed=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row")
    first = _shared.written(found.groupBy("root").agg(least).select("row.*").distinct(), "pipeline-first")
    own = docs.select(row_of(docs), docs.doc_id.alias("_id"), *(v.alias(f"_{k}") for k, v in simhash.text_key(docs.text).items()))
    same = (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    joined = own.join(first, same, "left_semi")
    return joined.groupBy("_id", "_t1", "_t2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated strings of 200 bytes cover leave the texts; the documents stay.

    Null texts stay null and empty ones empty. Rows with the same text repeat each other. An empty table gives an empty one.
    Other columns are carried under numbers, so they can have any names.
    """
    _shared.release(spark)
    return sized(suffix.without_repeats(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; the one at a source's cut gives its first words only.

    Null texts and texts without words are never taken; a null source is a source of its own. Rows alike in all columns are
    taken together, so reruns agree. An empty table gives an empty one. A row is carried as one struct, so its columns can
    have any names.
    """
    _shared.release(spark)
    keys = ["key", "k1", "k2"]
    own = docs.select(row_of(docs), mixing.mix_key(docs.doc_id, docs.text).alias("key"), docs.source.alias("source"), docs.text.alias("text"))
    own = own.withColumns({"k1": F.xxhash64("row"), "k2": F.xxhash64(F.lit("k2"), "row")})
    slim = own.select(*keys, "source", mixing.word_count(F.col("text")).alias("size")).groupBy(*keys, "source", "size").agg(F.count("*").alias("n"))
    slim = slim.withColumn("words", F.col("size") * F.col("n")).withColumn("mix_key", F.concat("key", F.lower(F.hex("k1")), F.lower(F.hex("k2"))))
    taken = mixing.budgeted(_shared.written(slim, "pipeline-slim")).withColumn("taken", F.col("full") * F.col("words") + F.col("rest")).where("taken > 0")
    taken = _shared.written(taken.select(*keys, "size", "taken", F.ceil(F.col("taken") / F.col("size")).alias("copies")), "pipeline-taken")
    joined = own.groupBy(*keys).agg(F.first("row").alias("row")).join(_shared.repeated(taken, "copies", "copy"), keys)
    left = F.col("taken") - F.col("copy") * F.col("size")
    text = F.col("row").getField("text")
    words = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(left, F.lit(1)).cast("int"))
    cut = F.when(left >= F.col("size"), text).otherwise(F.array_join(words, ""))
    return sized(joined.select(*((cut if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every text.

    Null and empty texts have no ids. A null doc_id stays null; repeated rows give repeated rows; an empty table an empty one.
    Other columns are not read.
    """
    _shared.release(spark)
    return bpe.encode_documents(docs, *rank_file()).select("doc_id", "n_tokens", "token_ids")


def row_of(docs: DataFrame) -> Column:
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", repeat_removal), ("mixing sources", source_mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is a table in the shared folder that the next one reads.

    A stage's result goes once the next one is written; the last one's stays for the caller.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{_shared.shared_dir(spark)}/ferrule-pipeline-{_shared.uuid.uuid4().hex}-{k}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            _shared.delete(spark, before)
        before = path
    _shared.release(spark)
    return docs
