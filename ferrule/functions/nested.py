"""Nested maps as JSON text: paths, merges, checks against a small schema language; ids, spans, templates, test vectors.

Reading a path is a built-in. Changing and merging nested maps has no built-in form, so these go through Arrow in batches.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get_path(data: Column, path: str, default: str | None = None) -> Column:
    """What a dotted path holds, as text; default if it holds nothing."""
    found = F.get_json_object(data, "$" + "".join(f"['{p}']" for p in path.split(".")))
    return found if default is None else F.coalesce(found, F.lit(default))


def changed(data: dict, path: str, value) -> dict:
    """A copy with a value at a dotted path; what is in the way is replaced by a map."""
    head, _, rest = path.partition(".")
    inner = data.get(head)
    return data | {head: changed(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def without(data: dict, path: str) -> dict:
    head, _, rest = path.partition(".")
    if head not in data:
        return data
    if not rest:
        return {k: v for k, v in data.items() if k != head}
    return data | {head: without(data[head], rest)} if isinstance(data[head], dict) else data


def merged(base, over, strategy: str = "merge"):
    """over onto base. merge: maps by key, lists and others replaced; extend: lists joined; unique: joined, each once; replace: over."""
    if strategy == "replace":
        return over
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k], strategy) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    if isinstance(base, list) and isinstance(over, list) and strategy != "merge":
        return base + over if strategy == "extend" else distinct_list(base, over)
    return over


def distinct_list(*lists: list) -> list:
    """One list after the other, each value once; values of different types differ (1, 1.0 and true are three)."""
    out, seen = [], set()
    for x in (x for own in lists for x in own):
        if (key := (type(x).__name__, json.dumps(x, sort_keys=True))) not in seen:
            seen.add(key)
            out.append(x)
    return out


def origins(layers: dict[str, dict], prefix: str = "") -> dict[str, str]:
    """For each leaf's dotted path, which of the layers, merged in order, it comes from."""
    out: dict[str, str] = {}
    for name, layer in layers.items():
        for key, value in layer.items():
            path = f"{prefix}{key}"
            for old in [p for p in out if p == path or p.startswith(f"{path}.") and not isinstance(value, dict)]:
                del out[old]
            out |= origins({name: value}, f"{path}.") if isinstance(value, dict) and value else {path: name}
    return out


def on_json(fn, *columns: Column) -> Column:
    """fn over the parsed values of JSON columns, in Arrow batches; null where one is no JSON."""

    @F.pandas_udf("string")
    def run(*texts: pd.Series) -> pd.Series:
        def one(row):
            try:
                return json.dumps(fn(*map(json.loads, row)), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError, AttributeError):
                return None

        return pd.Series([one(row) for row in zip(*texts)], dtype="object")

    return run(*columns)


def set_path(data: Column, path: str, value: Column) -> Column:
    return on_json(lambda d, v: changed(d, path, v), data, value)


def delete_path(data: Column, path: str) -> Column:
    return on_json(lambda d: without(d, path), data)


def deep_merge(base: Column, over: Column, strategy: str = "merge") -> Column:
    return on_json(lambda a, b: merged(a, b, strategy), base, over)


NAMED = {"str": str, "string": str, "int": int, "float": (int, float), "number": (int, float), "bool": bool, "dict": dict, "list": list, "any": object}


def issues(data, schema, path: str = "$", types: dict | None = None, depth: int = 0) -> list[str]:
    """What is wrong with a value. A schema is a map of field (name, or name? if it may lack) to schema, or a type's text: str, int,
    float, bool, dict, list, any, list[T], map[T], enum(a|b), A | B, a name of types, or any of these with ? for null."""
    types = types or {}
    if depth > 64:
        return [f"{path}: nested too deep"]
    if isinstance(schema, dict):
        if not isinstance(data, dict):
            return [f"{path}: a map is due"]
        known = {k.rstrip("?"): (v, k.endswith("?")) for k, v in schema.items() if not k.startswith("@")}
        out = [f"{path}.{k}: is missing" for k, (_, free) in known.items() if k not in data and not free]
        out += [f"{path}.{k}: is unknown" for k in data if k not in known and not schema.get("@open")]
        return out + [x for k, v in data.items() if k in known for x in issues(v, known[k][0], f"{path}.{k}", types, depth + 1)]
    text = schema.strip()
    if text.endswith("?"):
        return [] if data is None else issues(data, text[:-1], path, types, depth + 1)
    if m := re.fullmatch(r"enum\((.*)\)", text):
        return [] if str(data) in [x.strip() for x in m[1].split("|")] else [f"{path}: none of {m[1]}"]
    if m := re.fullmatch(r"list\[(.*)\]", text):
        return [x for i, v in enumerate(data) for x in issues(v, m[1], f"{path}[{i}]", types, depth + 1)] if isinstance(data, list) else [f"{path}: a list is due"]
    if m := re.fullmatch(r"map\[(.*)\]", text):
        return [x for k, v in data.items() for x in issues(v, m[1], f"{path}.{k}", types, depth + 1)] if isinstance(data, dict) else [f"{path}: a map is due"]
    if "|" in text:
        return [] if any(not issues(data, one, path, types, depth + 1) for one in text.split("|")) else [f"{path}: none of {text}"]
    if text in types:
        return issues(data, types[text], path, types, depth + 1)
    if text not in NAMED:
        return [f"{path}: unknown type {text}"]
    right = isinstance(data, NAMED[text]) and (text in ("bool", "any") or not isinstance(data, bool))
    return [] if right else [f"{path}: {text} is due"]


def checked(data: Column, schema, types: dict | None = None) -> Column:
    """An array of what is wrong with a JSON text; no JSON is one fault."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return issues(json.loads(text), schema, types=types)
            except (TypeError, ValueError):
                return ["$: no JSON"]

        return pd.Series([one(t) for t in texts], dtype="object")

    return run(data)


def weights(raw: dict) -> dict[str, float]:
    """Weights as floats; a weight must be a finite number above 0, and no bool."""
    for name, w in raw.items():
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w <= 0:
            raise ValueError(f"the weight of {name} is no finite number above 0")
    return {k: float(v) for k, v in raw.items()}


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced; other braces stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)


def translated(texts: DataFrame, chain: list[str]) -> DataFrame:
    """key and text of texts (key, locale, text): by the first locale of the chain that has it."""
    at = F.array_position(F.array(*map(F.lit, chain)), F.col("locale"))
    return texts.where(F.col("locale").isin(*chain)).groupBy("key").agg(F.min_by("text", at).alias("text"))


def contains(a: str, b: str) -> Column:
    """Whether span a holds span b; spans are structs of start and end, the end outside."""
    return (F.col(f"{a}.start") <= F.col(f"{b}.start")) & (F.col(f"{b}.end") <= F.col(f"{a}.end"))


def bounding(a: str, b: str) -> Column:
    return F.struct(F.least(f"{a}.start", f"{b}.start").alias("start"), F.greatest(f"{a}.end", f"{b}.end").alias("end"))


def byte_slice(text: Column, span: str) -> Column:
    """The UTF-8 bytes of a span of a text, as text."""
    return F.substring(F.encode(text, "UTF-8"), F.col(f"{span}.start") + 1, F.col(f"{span}.end") - F.col(f"{span}.start")).cast("string")


def overload_ids(symbols: DataFrame) -> DataFrame:
    """symbols (id, parent_id, signature, more) with ids of their own: of several with one id the first by signature keeps it, the others'
    are hashed anew with it. A parent whose id several have had keeps the first's, so children stay in place."""
    order = Window.partitionBy("id").orderBy("signature")
    number = F.dense_rank().over(order)
    return symbols.withColumn("id", F.when(number == 1, F.col("id")).otherwise(F.sha1(F.concat_ws(":", "id", F.coalesce("signature", F.lit(""))))))


def ignore_line(pattern: str, module: str) -> str | None:
    """A module's ignore pattern as one of the project's: anchored below the module, the ! kept in front; comments and blanks are None."""
    text = pattern.strip().replace("\\", "/")
    if not text or text.startswith("#"):
        return None
    out, body = "!" * text.startswith("!"), text.removeprefix("!")
    base = module.strip("/")
    body = body.lstrip("/") if body.startswith("/") or "/" in body.rstrip("/") else f"**/{body}"
    return out + (f"/{base}/{body}" if base else f"/{body}")


def blake2b(content: Column, size: int = 16) -> Column:
    """The Blake2b digest of bytes, in hex: Spark has none built in."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hashlib.blake2b(bytes(x), digest_size=size).hexdigest() for x in parts], dtype="object")

    return run(content)


def content_hash(content: Column, size: Column, mtime: Column, most: int = 10_000_000, sample: int = 65_536) -> Column:
    """Whole contents digested; of large ones the head, the middle and the tail with size; without contents size and time."""
    mid = F.substring(content, (size / 2).cast("int"), sample)
    some = F.concat(F.substring(content, 1, sample), mid, F.substring(content, -sample, sample), F.encode(size.cast("string"), "UTF-8"))
    stat = F.encode(F.concat_ws(":", F.lit("stat"), size, mtime), "UTF-8")
    return blake2b(F.when(content.isNull(), stat).when(size >= most, some).otherwise(content))


def mock_vector(text: Column, dimension: int = 64) -> Column:
    """A unit vector that depends on the text alone, for tests: Gaussian from an MD5 seed; of an empty text the first axis."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        import numpy as np

        def one(t):
            if not t:
                return np.eye(1, dimension, dtype=np.float32)[0]
            v = np.random.RandomState(int(hashlib.md5(t.encode("utf-8", "replace")).hexdigest()[:8], 16)).randn(dimension).astype(np.float32)
            return v / np.linalg.norm(v)

        return pd.Series([one(t) for t in texts])

    return run(text)
