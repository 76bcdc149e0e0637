"""Tables that an operator writes on its way: in the folder that the cluster names, versioned where readers may be about."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Paths handed out since the last release().
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it a temporary folder, on a cluster an error."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ferrule-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{folder(spark)}/ferrule-core-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table read back: later plans start from it, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what was written so far. Only for callers that hold no DataFrame, and no index, over it any more."""
    while _made:
        delete(spark, _made.pop())


def pointer(spark: SparkSession, path: str) -> dict:
    """The newest row of a versioned folder's pointer table: version 0 and no mark if there is none."""
    try:
        rows = spark.read.parquet(f"{path}/versions")
    except AnalysisException:
        return {"version": 0, "mark": None}
    newest = rows.agg(F.max_by(F.struct("version", "mark"), "version").alias("x")).first()["x"]
    return newest.asDict() if newest else {"version": 0, "mark": None}


def point(spark: SparkSession, path: str, version: int, mark: str | None = None, keep: int = 2) -> None:
    """Name a version that has been written in full, and delete those more than keep behind it."""
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(mark).cast("string").alias("mark")).write.mode("append").parquet(f"{path}/versions")
    if version > keep:
        delete(spark, f"{path}/{version - keep}")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt out to all cores if its files make fewer tasks than there are; larger ones stay as they are, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
