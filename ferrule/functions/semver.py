"""Versions of three or four segments as sortable columns, and constraints as predicates over columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A fixed format: numbers without leading zeros, then maybe a revision (a number or a word, 'build' for one), maybe a prerelease.
PATTERN = r"^[vV]?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:\.([0-9A-Za-z_]+))?(?:-([0-9A-Za-z.-]+))?$"
CLAUSE = r"^\s*(>=|<=|!=|==|~=|\^=|\^|>|<|=)?\s*(.*?)\s*$"
DIGITS = r"^[0-9]+$"


def group(version: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(version), PATTERN, i)


def sort_key(version: Column, strict: bool = False) -> Column:
    """A struct that orders as versions do; a malformed version is null, or an error if strict.

    Three numbers, then a final release above its prereleases, prerelease parts (numbers below words, fewer parts below
    more), then the revision, words below numbers. Prereleases have no revision.
    """
    number = lambda i: F.expr("cast(null as long)") if i is None else group(version, i).try_cast("long")
    pre, revision = group(version, 5), group(version, 4)
    part = lambda p: F.struct((~p.rlike(DIGITS)).alias("word"), F.when(p.rlike(DIGITS), p.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(p.rlike(DIGITS), F.lit("")).otherwise(p).alias("text"))
    parts = F.when(pre != "", F.transform(F.split(pre, r"\."), part)).otherwise(F.array().cast("array<struct<word:boolean,number:decimal(38,0),text:string>>"))
    counted = (revision == "") | revision.rlike(DIGITS) | (pre != "")
    place = F.struct(counted.alias("counted"), F.when((pre == "") & revision.rlike(DIGITS), revision.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(counted, F.lit("")).otherwise(revision).alias("text"))
    key = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("final"), parts.alias("parts"), place.alias("revision"))
    found = F.trim(version).rlike(PATTERN)
    return F.when(found, key).otherwise(F.raise_error(F.concat(F.lit("no version: "), F.coalesce(version, F.lit("null"))))) if strict else F.when(found, key)


def normalised(version: Column) -> Column:
    """All four segments; a prerelease has its revision only if that is not 0. Null if malformed."""
    pre, revision = group(version, 5), F.when(group(version, 4) == "", "0").otherwise(F.when(group(version, 4).rlike(DIGITS), group(version, 4).cast("decimal(38,0)").cast("string")).otherwise(group(version, 4)))
    three = F.concat_ws(".", group(version, 1), group(version, 2), group(version, 3))
    full = F.when(pre == "", F.concat(three, F.lit("."), revision)).otherwise(F.concat(three, F.when(revision == "0", "").otherwise(F.concat(F.lit("."), revision)), F.lit("-"), pre))
    return F.when(F.trim(version).rlike(PATTERN), full)


def is_build(version: Column) -> Column:
    return F.lower(group(version, 4)) == "build"


def bound(value: Column, test: Callable[[Column], Column]) -> Column:
    """test of a value that is computed once, however often the test names it."""
    return F.exists(F.array(value), test)


def clause(version: Column, text: Column, key: Column | None = None) -> Column:
    """Whether a version (its sort_key, if there is one already) passes one clause; null if either is malformed."""
    op, target = F.regexp_extract(text, CLAUSE, 1), F.regexp_extract(text, CLAUSE, 2)
    op = F.when(op.isin("", "="), "==").when(op == "^", "^=").otherwise(op)

    def test(x: Column) -> Column:
        op, target, key, goal = x["op"], x["target"], x["key"], x["goal"]
        same = lambda *names: F.lit(True) if not names else (key[names[0]] == goal[names[0]]) & same(*names[1:])
        stem = F.split(F.regexp_replace(target, r"\.\*$", ""), r"\.")
        fits = lambda i, name: (F.size(stem) <= i) | (key[name] == F.get(stem, F.lit(i)).try_cast("long"))
        wild = (F.size(stem) <= 3) & fits(0, "major") & fits(1, "minor") & fits(2, "patch")
        plain = key["final"] & goal["final"] & ~is_build(version) & ~is_build(target) & (F.regexp_count(target, F.lit(r"\.")) == 2)
        exact = F.when(plain, same("major", "minor", "patch")).otherwise(key == goal)
        near = (key >= goal) & same("major") & ((goal["major"] != 0) | same("minor"))
        found = F.when(op == "==", F.when(target.endswith(".*"), wild).otherwise(exact)).when(op == "!=", key != goal).when(op == ">", key > goal).when(op == ">=", key >= goal).when(op == "<", key < goal).when(op == "<=", key <= goal).otherwise(near)
        return x["any"] | found

    key = sort_key(version) if key is None else key
    return bound(F.struct(op.alias("op"), target.alias("target"), key.alias("key"), sort_key(target).alias("goal"), (F.trim(text) == "*").alias("any")), test)


def whole(version: Column, text: Column, every: Column) -> Column:
    """every, the answer of a constraint's clauses, but for what its whole text or a '.build' version decides."""
    return F.when(text.isin("", "*") | (version == "build") | version.endswith(".build"), True).when(text.isin("build", "==build"), False).otherwise(every)


def holds(version: Column, constraint: Column) -> Column:
    """Whether a version passes a constraint of any number of clauses; both are columns. A '.build' version passes every one; only it passes 'build'."""
    text, v = F.trim(F.coalesce(constraint, F.lit(""))), F.trim(version)
    clauses = F.filter(F.split(text, ","), lambda c: F.trim(c) != "")
    return whole(v, text, bound(sort_key(v), lambda key: F.forall(clauses, lambda c: clause(v, c, key))))


def matches(version: Column, constraint: str | None) -> Column:
    """holds for one constraint: its clauses are constants, read once for all versions."""
    text, v = (constraint or "").strip(" "), F.trim(version)
    every = lambda key: reduce(lambda a, b: a & b, (clause(v, F.lit(c), key) for c in text.split(",") if c.strip(" ")), F.lit(True))
    return whole(v, F.lit(text), bound(sort_key(v), every))


def bump(version: Column, part: str) -> Column:
    """The next version: by a part's name, or the given version itself if it is no lesser; malformed or lesser is null."""
    names = ("major", "minor", "patch")
    key = sort_key(version)
    if part in names:
        at = names.index(part)
        return F.concat_ws(".", *((key[n] + (1 if i == at else 0)).cast("string") if i <= at else F.lit("0") for i, n in enumerate(names)), F.lit("0"))
    if part == "revision":
        number = F.when(group(version, 4).rlike(DIGITS), group(version, 4).cast("long")).otherwise(F.lit(0))
        return F.concat_ws(".", *(key[n].cast("string") for n in names), (number + 1).cast("string"))
    return F.when(sort_key(F.lit(part)) >= key, normalised(F.lit(part)))
