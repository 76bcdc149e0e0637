"""A remote store as a Spark data source: its listing as a batch, its change feed as a stream; a folder stands in for the store.

The transport is an object with a few calls, so a store behind HTTP plugs in the same way; none is here, as there is no network.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

LISTING = "file_id string, rel_path string, parent string, is_folder boolean, size long, md5 string, mtime_ns long"
FEED = "seq long, file_id string, rel_path string, removed boolean, is_folder boolean, size long, md5 string"


class FolderStore:
    """A store in a folder: files under files/, a feed of changes (JSON lines) beside them. Trash and shortcuts as stores have them."""

    def __init__(self, root: str):
        self.root, self.files, self.feed = root, os.path.join(root, "files"), os.path.join(root, "feed.jsonl")
        os.makedirs(self.files, exist_ok=True)

    def at(self, rel: str) -> str:
        path = os.path.normpath(os.path.join(self.files, rel))
        if path != self.files and not path.startswith(self.files + os.sep):
            raise ValueError(f"{rel} leads out of the store")
        return path

    @staticmethod
    def id_of(rel: str) -> str:
        return hashlib.sha1(rel.encode()).hexdigest()

    def row(self, rel: str) -> dict:
        path = self.at(rel)
        folder = os.path.isdir(path)
        stat, data = os.stat(path), b"" if folder else open(path, "rb").read()
        return {"file_id": self.id_of(rel), "rel_path": rel, "parent": os.path.dirname(rel), "is_folder": folder, "size": len(data), "md5": "" if folder else hashlib.md5(data).hexdigest(), "mtime_ns": stat.st_mtime_ns}

    def noted(self, rel: str, removed: bool) -> None:
        row = {"file_id": self.id_of(rel), "rel_path": rel, "removed": removed} | ({"is_folder": False, "size": 0, "md5": ""} if removed else {k: v for k, v in self.row(rel).items() if k in ("is_folder", "size", "md5")})
        with open(self.feed, "a") as f:
            f.write(json.dumps({"seq": self.token() + 1} | row) + "\n")

    def token(self) -> int:
        """Where the feed ends."""
        if not os.path.exists(self.feed):
            return 0
        with open(self.feed) as f:
            return sum(1 for _ in f)

    def changes(self, after: int, upto: int | None = None) -> Iterator[dict]:
        if os.path.exists(self.feed):
            with open(self.feed) as f:
                for line in f:
                    row = json.loads(line)
                    if row["seq"] > after and (upto is None or row["seq"] <= upto):
                        yield row

    def folders(self) -> list[str]:
        return [os.path.relpath(d, self.files) for d, _, _ in os.walk(self.files)]

    def list(self, folder: str) -> Iterator[dict]:
        for name in sorted(os.listdir(self.at(folder))):
            yield self.row(os.path.normpath(os.path.join(folder, name)))

    def get(self, rel: str) -> bytes:
        with open(self.at(rel), "rb") as f:
            return f.read()

    def put(self, rel: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(self.at(rel)), exist_ok=True)
        with open(self.at(rel) + ".new", "wb") as f:
            f.write(data)
        os.replace(self.at(rel) + ".new", self.at(rel))
        self.noted(rel, False)

    def trash(self, rel: str) -> None:
        os.makedirs(os.path.join(self.root, "trash"), exist_ok=True)
        shutil.move(self.at(rel), os.path.join(self.root, "trash", self.id_of(rel)))
        self.noted(rel, True)

    def move(self, rel: str, to: str) -> None:
        os.makedirs(os.path.dirname(self.at(to)), exist_ok=True)
        os.replace(self.at(rel), self.at(to))
        self.noted(rel, True)
        self.noted(to, False)

    def shortcut(self, rel: str, to: str) -> None:
        os.symlink(self.at(rel), self.at(to))
        self.noted(to, False)


class Folder(InputPartition):
    def __init__(self, root: str, folder: str):
        self.root, self.folder = root, folder


class ListingReader(DataSourceReader):
    """A partition a folder of the store."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return [Folder(self.root, f) for f in FolderStore(self.root).folders()]

    def read(self, partition):
        for r in FolderStore(partition.root).list(partition.folder):
            yield r["file_id"], r["rel_path"], r["parent"], r["is_folder"], r["size"], r["md5"], r["mtime_ns"]


class FeedReader(SimpleDataSourceStreamReader):
    """Offsets are the feed's own, so a batch that is replayed is the same."""

    def __init__(self, root: str):
        self.store = FolderStore(root)

    def initialOffset(self):
        return {"seq": 0}

    def row(self, r: dict) -> tuple:
        return r["seq"], r["file_id"], r["rel_path"], r["removed"], r["is_folder"], r["size"], r["md5"]

    def read(self, start):
        rows = [self.row(r) for r in self.store.changes(start["seq"])]
        return iter(rows), {"seq": rows[-1][0] if rows else start["seq"]}

    def readBetweenOffsets(self, start, end):
        return iter([self.row(r) for r in self.store.changes(start["seq"], end["seq"])])


class RemoteSource(DataSource):
    """format('ferrule_remote'), option root: read for the listing, readStream for the changes."""

    @classmethod
    def name(cls):
        return "ferrule_remote"

    def schema(self):
        return FEED if self.options.get("feed", "false").lower() == "true" else LISTING

    def reader(self, schema):
        return ListingReader(self.options["root"])

    def simpleStreamReader(self, schema):
        return FeedReader(self.options["root"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(RemoteSource)
    return spark.read.format("ferrule_remote").option("root", root).load()


def feed(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(RemoteSource)
    return spark.readStream.format("ferrule_remote").option("root", root).option("feed", "true").load()


def patched_cache(cache: DataFrame, changes: DataFrame) -> tuple[DataFrame, bool]:
    """A cached listing (file_id, rel_path, is_folder, size, md5) after changes (FEED), and whether it can be trusted: of an id the last
    change counts; a file in a folder that neither side knows asks for a listing anew."""
    last = changes.groupBy("file_id").agg(F.max_by(F.struct(*(c for c in changes.columns if c not in ("file_id", "seq"))), "seq").alias("x")).select("file_id", "x.*")
    kept = cache.join(last, "file_id", "left_anti")
    out = kept.unionByName(last.where("NOT removed").select(*cache.columns))
    folders = out.where("is_folder").select(F.col("rel_path").alias("_f")).unionByName(cache.sparkSession.range(1).select(F.lit("").alias("_f"))).distinct()
    parent = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    strange = last.where("NOT removed").join(folders, parent == F.col("_f"), "left_anti")
    return out, strange.isEmpty()


def replayed(base: DataFrame, journal: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger's rows after its journal (keys, seq, op: upsert or delete, and the other columns): of a key the last entry counts."""
    others = [c for c in base.columns if c not in keys]
    last = journal.groupBy(*keys).agg(F.max_by(F.struct("op", *others), "seq").alias("x"))
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last.where("x.op = 'upsert'").select(*keys, *(F.col(f"x.{c}").alias(c) for c in others)))
