"""What the operators of this package share: a place all executors see, and Arrow plumbing."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Tables written since the last release(), oldest first.
_tables: list[str] = []


def shipped(module: str) -> None:
    """Pickle a module's functions by value: executors need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


shipped(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. In local mode without it, a temporary folder; on a cluster that is an error."""
    global _own_dir
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="ferrule-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/ferrule-{label}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables written so far. Only for callers that hold no DataFrame over them any more."""
    while _tables:
        delete(spark, _tables.pop())


def repeated(table: DataFrame, count: str, number: str, block: int = 10_000) -> DataFrame:
    """Each row of a written table as many times as count says, numbered from 0. Large counts are dealt to several tasks in blocks."""
    few = table.where(F.col(count) <= block).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    many = table.where(F.col(count) > block).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(block).cast("long"))))
    many = many.repartition("_from").withColumn(number, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + block, F.col(count)) - 1))).drop("_from")
    return few.unionByName(many)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over many tasks."""
    return sys.__dict__.setdefault("_ferrule_cache", {})


def map_batches(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator], Iterator]) -> DataFrame:
    """mapInArrow over just these columns of df, so that other columns can have any name."""
    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(fn, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values, each bit of a result depending on all of its value's."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
