"""Include and exclude rules over paths, and symbol selectors, compiled on the driver to column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, prefix: bool = False) -> str:
    """A glob as a Java regex: ** spans folders (none too), * and ? stay inside any text as shell matching has it."""
    if pattern == "**":
        return r"(?s)^.*\z"
    lead, trail = pattern.startswith("**/"), pattern.endswith("/**")
    body = pattern[3 * lead : len(pattern) - 3 * trail]

    def piece(text: str) -> str:
        out, i = "", 0
        while i < len(text):
            c = text[i]
            if c == "[" and (end := text.find("]", i + 2)) > 0:
                inner = text[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
            else:
                out += {"*": ".*", "?": "."}.get(c) or re.sub(r"([\\.+^$(){}|\[\]])", r"\\\1", c)
            i += 1
        return out

    return f"(?s)^{'(?:.+/)?' if lead else ''}{'(?:/|/.+/)'.join(map(piece, body.split('/**/')))}{'(?:/.*)?' if trail or prefix else ''}\\z"


def rule(path: Column, pattern: str, any_segment: bool) -> Column:
    """A rule with a slash matches the path, one without a name: any segment's if it excludes, the file's if it includes."""
    clean = pattern.rstrip("/")
    if "/" in clean or clean == "**":
        return path.rlike(glob_regex(clean.lstrip("/"), prefix=any_segment))
    inner = glob_regex(clean)
    names = F.split(path, "/")
    if pattern.endswith("/"):
        names = F.slice(names, F.lit(1), F.size(names) - 1)
    return F.exists(names, lambda x: x.rlike(inner)) if any_segment or pattern.endswith("/") else F.element_at(names, -1).rlike(inner)


def decide(path: Column, include: list[str], exclude: list[str]) -> Column:
    """A struct: whether a path belongs, and the rule that decided (null if none did). Excludes come first."""
    why = F.struct(F.lit(not include).alias("matched"), F.lit(None).cast("string").alias("rule"))
    for p in reversed(include):
        why = F.when(rule(path, p, False), F.struct(F.lit(True).alias("matched"), F.lit(p).alias("rule"))).otherwise(why)
    for p in reversed(exclude):
        why = F.when(rule(path, p, True), F.struct(F.lit(False).alias("matched"), F.lit(p).alias("rule"))).otherwise(why)
    return why


def selector(text: str, name: str = "name", fqn: str = "fqn", kind: str = "kind", kinds: tuple[str, ...] = ("class", "struct", "function", "method", "variable", "enum", "interface", "namespace", "module")) -> tuple[Column, Column]:
    """(predicate, points) of '[kind] [scope.]name[(...)]': 10 for the exact name, 8 in any case, 5 for a part; 5 for the scope."""
    m = re.fullmatch(r"\s*(?:(\w+)\s+)?(?:(.*)(?:\.|::))?([^.:(]+)(\(.*\))?\s*", text)
    if not m:
        raise ValueError(f"no selector: {text}")
    k, scope, short, call = m.groups()
    if k and k not in kinds:
        raise ValueError(f"no such kind: {k}")
    short = short.strip()
    points = F.when(F.col(name) == short, 10).when(F.lower(name) == short.lower(), 8).when(F.lower(name).contains(short.lower()), 5)
    test = points.isNotNull()
    if k:
        test = test & (F.col(kind) == k)
    if call:
        test = test & F.col(kind).isin("function", "method")
    if scope:
        inside = F.lower(fqn).contains(f"{scope}.".lower()) | F.lower(fqn).contains(f"{scope}::".lower())
        test, points = test & inside, points + F.when(inside, 5).otherwise(0)
    return test, points
