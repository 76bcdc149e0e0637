"""What a user adds: parsers by extension, refiners, functions named by a URI, services, and declared contributions."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.functions.nested import merged, origins
from ferrule.functions.text import extension

Frames = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Parsers are DataFrame functions from files (file_path, text) to symbols; of several for an extension the highest priority counts, then the last."""

    parsers: dict[str, list[tuple[int, int, Frames]]] = field(default_factory=dict)
    nodes: list[Frames] = field(default_factory=list)
    edges: list[Frames] = field(default_factory=list)
    graphs: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = field(default_factory=list)

    def parser(self, extensions: list[str], parse: Frames, priority: int = 100) -> None:
        for e in extensions:
            own = self.parsers.setdefault(e.lower().lstrip("."), [])
            own.append((priority, len(own), parse))

    def chosen(self, ext: str) -> Frames:
        return max(self.parsers[ext], key=lambda p: p[:2])[2]

    def parse(self, files: DataFrame, columns: list[str]) -> DataFrame | None:
        """The symbols of files by the parsers of their extensions, then through the node refiners; one pass a parser over its own files."""
        by: dict[Frames, list[str]] = {}
        for ext in self.parsers:
            by.setdefault(self.chosen(ext), []).append(ext)
        parts = [parse(files.where(extension(F.col("file_path")).isin(*exts))).select(*columns) for parse, exts in by.items()]
        return self.refine(reduce(DataFrame.unionByName, parts), self.nodes) if parts else None

    @staticmethod
    def refine(rows: DataFrame, refiners: list[Frames]) -> DataFrame:
        return reduce(lambda d, f: d.transform(f), refiners, rows)

    def linked(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """A linked workspace through the edge refiners (its calls) and then the graph refiners."""
        out = tables | ({"calls": self.refine(tables["calls"], self.edges)} if "calls" in tables else {})
        return reduce(lambda t, f: f(t), self.graphs, out)


SCHEME = "code.func://"


@cache
def resolve_callable(uri: str) -> Callable:
    """code.func://package/module:name (or module.path:Class.name) as the function."""
    if not uri.startswith(SCHEME):
        raise ValueError(f"{uri} is no {SCHEME}")
    module, sep, name = uri.removeprefix(SCHEME).partition(":")
    if not sep or not module or not name:
        raise ValueError(f"{uri} lacks a module or a function")
    found = importlib.import_module(module.strip("/").replace("/", "."))
    for part in name.split("."):
        found = getattr(found, part)
    if not callable(found):
        raise TypeError(f"{uri} can't be called")
    return found


def call(uri: str, returns: str, *columns: Column) -> Column:
    """A function named by a URI over columns, in Arrow batches: it takes and gives pandas Series. Executors resolve the name themselves."""

    @F.pandas_udf(returns)
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return resolve_callable(uri)(first, *rest)

    return run(*columns)


class Service:
    """A streaming query under a name: started once, stopped, asked how it is, started again after a failure."""

    def __init__(self, name: str, start: Callable[[], StreamingQuery]):
        self.name, self.begin, self.query = name, start, None

    def start(self) -> None:
        if self.query is None or not self.query.isActive:
            self.query = self.begin()

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def health(self) -> dict:
        fault = self.query.exception() if self.query is not None else None
        return {"name": self.name, "active": self.query is not None and self.query.isActive, "fault": str(fault) if fault else None, "rows": (self.query.lastProgress or {}).get("numInputRows") if self.query is not None else None}


def stop_all(spark: SparkSession) -> None:
    for q in spark.streams.active:
        q.stop()


@dataclass
class Contributions:
    """What modules declare for each other: JSON documents by target, merged in order of registration by their strategy."""

    layers: dict[str, dict[str, tuple[dict, str]]] = field(default_factory=dict)

    def add(self, module: str, target: str, document: dict | str, strategy: str = "merge") -> None:
        self.layers.setdefault(target, {})[module] = (json.loads(document) if isinstance(document, str) else document, strategy)

    def get(self, target: str, key: str | None = None, default=None):
        out: dict = {}
        for document, strategy in self.layers.get(target, {}).values():
            out = merged(out, document, strategy)
        for part in key.split(".") if key else []:
            if not isinstance(out, dict) or part not in out:
                return default
            out = out[part]
        return out

    def origins(self, target: str) -> dict[str, str]:
        return origins({m: d for m, (d, _) in self.layers.get(target, {}).items()})
