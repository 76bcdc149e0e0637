"""Files as tables: spaces of files, JSON lines, transcripts, snapshots with a summary beside them, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import rules, spaces
from ferrule.sources import scratch


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, space: str = "") -> DataFrame:
    """rel_path, abs_path, size, modified, space of the files under a folder that the rules take. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    out = found.select(F.substring(F.col("path"), F.length(F.lit(base)) + 2, F.length("path")).alias("rel_path"), F.col("path").alias("abs_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(space).alias("space"))
    return out.where(rules.decide(F.col("rel_path"), include or [], exclude or [])["matched"])


def walk(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, space: str = "", batch: int = 10_000) -> DataFrame:
    """As scan, but folders that the rules exclude are never listed, and a file reached by several ways (links) comes once, by its least path.

    The driver lists folder by folder, and holds names of at most a batch of files: each is written as a part of a table.
    """
    import re

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    base = fs.makeQualified(base).toString().rstrip("/")
    names = [re.compile(rules.glob_regex(p.rstrip("/")).replace("\\z", "\\Z")) for p in exclude or [] if "/" not in p.rstrip("/")]
    schema = "rel_path string, abs_path string, real string, size long, modified timestamp"
    out, rows, queue = scratch.new_path(spark, "walk"), [], [""]
    import datetime
    import os

    def flush():
        spark.createDataFrame(rows, schema).write.mode("append").parquet(out)
        rows.clear()

    while queue:
        rel = queue.pop()
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{rel}" if rel else base)):
            name, path = s.getPath().getName(), s.getPath().toString()
            own = f"{rel}/{name}" if rel else name
            if s.isDirectory():
                if not any(p.match(name) for p in names):
                    queue.append(own)
                continue
            real = os.path.realpath(path.removeprefix("file:")) if path.startswith("file:") else path
            rows.append((own, path, real, s.getLen(), datetime.datetime.fromtimestamp(s.getModificationTime() / 1000)))
            if len(rows) >= batch:
                flush()
    flush()
    found = spark.read.schema(schema).parquet(out)
    found = found.where(rules.decide(F.col("rel_path"), include or [], exclude or [])["matched"])
    once = found.groupBy("real").agg(F.min_by(F.struct("rel_path", "abs_path", "size", "modified"), "rel_path").alias("f"))
    return once.select("f.*", F.lit(space).alias("space"))


def write_text(spark: SparkSession, path: str, text: str | bytes | dict | list) -> None:
    """A small file as a whole, or not at all: written beside its place and renamed. Maps and lists as JSON."""
    import json
    import uuid

    data = text if isinstance(text, bytes) else (text if isinstance(text, str) else json.dumps(text, ensure_ascii=False)).encode()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, new = at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(data))
    stream.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{path} could not be put in place")


def contents(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """scan with each file's text."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("abs_path"), F.col("content").cast("string").alias("text"))
    return scan(spark, root, include, exclude).join(texts, "abs_path")


def union_spaces(*tables: DataFrame) -> DataFrame:
    """One row a file with its spaces; where paths collide, the table named first gives the rest."""
    ranked = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    every = ranked[0]
    for t in ranked[1:]:
        every = every.unionByName(t)
    rest = [c for c in tables[0].columns if c not in ("rel_path", "space")]
    return every.groupBy("rel_path").agg(F.min_by(F.struct(*rest), "_rank").alias("r"), F.sort_array(F.collect_set("space")).alias("spaces")).select("rel_path", "r.*", "spaces")


def json_lines(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """Rows of JSON-lines files; lines that are no JSON of this schema are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")
    return rows if where is None else rows.where(where)


def newest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by a column: what a rotation keeps, what a tail shows."""
    return rows.orderBy(F.desc(order)).limit(n)


def append_json(rows: DataFrame, path: str, order: str | None = None, most_bytes: int = 0, keep: int = 0) -> None:
    """Add rows to a folder of JSON lines. Past so many bytes only the newest rows by a column stay: they are written beside the old
    files, which go only then."""
    spark = rows.sparkSession
    rows.write.mode("append").json(path)
    if not most_bytes:
        return
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "length")
    if (sizes.agg(F.sum("length").alias("n")).first()["n"] or 0) <= most_bytes:
        return
    kept = newest(spark.read.json(path), order, keep)
    fresh = f"{path}-rotated"
    kept.write.mode("overwrite").json(fresh)
    spark.read.json(fresh).write.mode("overwrite").json(path)
    scratch.delete(spark, fresh)


#: Where the dialects of conversation logs have what a step needs; the first that is there counts.
DIALECT = {"conv_id": ("conv_id", "conversation_id", "session_id", "sessionId"), "step": ("step", "step_index", "turn"), "role": ("role", "type", "message.role", "source"), "tool": ("tool", "tool_name", "name", "tool_calls[0].name"), "text": ("text", "content", "message.content"), "ts": ("ts", "timestamp", "created_at")}


def transcripts(lines: DataFrame, column: str = "value", dialect: dict = DIALECT) -> DataFrame:
    """Log lines of several producers as one shape of steps; lines that are no JSON objects are left out."""
    at = lambda paths: F.coalesce(*(F.get_json_object(column, f"$.{p}") for p in paths))
    out = lines.select(*(at(paths).alias(name) for name, paths in dialect.items()), F.try_parse_json(column).isNotNull().alias("_ok"))
    return out.where("_ok").drop("_ok").withColumns({"step": F.expr("try_cast(step AS bigint)"), "ts": F.try_to_timestamp("ts")})


def save_snapshot(state: DataFrame, path: str) -> None:
    """A generation table and, beside it, one row that sums it up and vouches for it: both in one new version, named when whole."""
    spark = state.sparkSession
    version = scratch.pointer(spark, path)["version"] + 1
    state.write.mode("overwrite").parquet(f"{path}/{version}/rows")
    summary_of(spark.read.parquet(f"{path}/{version}/rows")).write.mode("overwrite").parquet(f"{path}/{version}/summary")
    scratch.point(spark, path, version)


def summary_of(state: DataFrame) -> DataFrame:
    """The checksum adds two hashes of each row, so equal rows don't cancel and lost ones show."""
    part = lambda *salt: F.coalesce(F.sum(F.xxhash64(*salt, *sorted(state.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return state.agg(F.coalesce(F.max("updated_gen"), F.lit(0)).alias("head"), F.count_if(~F.col("is_deleted")).alias("active"), F.count("*").alias("rows"), F.concat_ws(":", part(), part(F.lit("second"))).alias("checksum"))


def snapshot_summary(spark: SparkSession, path: str):
    """The summary's row without reading the table; None if there is no whole snapshot."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{scratch.pointer(spark, path)['version']}/summary").first()
    except AnalysisException:
        return None


def load_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one (generation 0) if it is missing or not what the summary vouches for."""
    empty = spark.createDataFrame([], schema)
    want = snapshot_summary(spark, path)
    if want is None:
        return empty
    rows = spark.read.schema(schema).parquet(f"{path}/{scratch.pointer(spark, path)['version']}/rows")
    return rows if summary_of(rows).first() == want else empty


def write_bundles(symbols: DataFrame, path: str, spaces_col: str = "spaces") -> None:
    """JSON files by space; a symbol without spaces is in every bundle."""
    named = symbols.select(F.explode(spaces_col).alias("_s")).distinct()
    own = symbols.withColumn("space", F.explode(spaces_col))
    free = symbols.where(F.size(spaces_col) == 0).crossJoin(named.withColumnRenamed("_s", "space"))  # so the output asks for: each of them in every bundle
    own.unionByName(free).write.mode("overwrite").partitionBy("space").json(path)


def tail(lines: DataFrame, order: str, offset: int, identity: str | None = None, known: str | None = None) -> tuple[DataFrame, int]:
    """Rows past an offset and the new offset. An offset beyond the end means that the log was cut, another identity (what the log's
    first row or file says it is) that it is another log: both start anew."""
    top = lines.agg(F.coalesce(F.max(order), F.lit(0)).alias("m")).first()["m"]
    return lines.where(F.col(order) > (offset if offset <= top and identity == known else 0)), top


def full_siblings(files: DataFrame) -> DataFrame:
    """files (rel_path) of transcripts without those that have a full form beside them: of x.jsonl and x_full.jsonl the latter."""
    full = r"_full\.jsonl$"
    named = files.withColumn("_k", F.regexp_replace(F.regexp_replace("rel_path", full, ".jsonl"), r"\.jsonl$", "")).withColumn("_f", F.col("rel_path").rlike(full))
    with_full = named.where("_f").select("_k").distinct()
    return named.where("_f").unionByName(named.where("NOT _f").join(with_full, "_k", "left_anti").select(*named.columns)).drop("_k", "_f")


def ranked_plans(plans: DataFrame, limit: int = 20) -> DataFrame:
    """Active plans first, then the newest; each with its place."""
    order = Window.orderBy(F.desc("active"), F.desc("date"), "path")
    return plans.orderBy(F.desc("active"), F.desc("date"), "path").limit(limit).withColumn("place", F.row_number().over(order))


digest = spaces.digest
