"""Links across files: imports to files and symbols, calls to symbols by tiers of scope, document links, the whole workspace.

nodes: id, file_path, name, fqn (dotted), kind, parent_id, language. imports: file_path, expr, alias. refs: site, src (a node's
id), file_path, expr. All are tables of any size; each tier is an equi-join and the best tier of a site wins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators import graph
from ferrule.sources import scratch

# Which files a module's name can stand for, in order of preference, and which names stand for the type around a call.
ENDINGS = ("", ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".cs", ".h", ".hpp", ".cpp", ".c", ".md", "/__init__.py", "/index.ts", "/index.tsx", "/index.js")
FILES = (".md", ".py", ".ts", ".tsx", ".js", ".cs", ".h", ".hpp", ".c", ".cpp")
OWN, BASE = ("self", "this", "cls"), ("super", "base")
TYPES = ("class", "struct", "interface", "enum", "trait")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined(base: Column, path: Column) -> Column:
    """base/path with . and .. taken out; .. above the root stays."""
    parts = F.filter(F.split(F.concat_ws("/", base, path), "/"), lambda x: (x != "") & (x != "."))
    back = lambda a: (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("..")) != "..")
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & back(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    return F.array_join(done, "/")


def suffixes(files: DataFrame) -> DataFrame:
    """suffix, file_path, whole: each file under each of its path's ends (whole: the path itself); of several the shortest, then the least."""
    parts = F.split("file_path", "/")
    every = files.select("file_path").distinct().select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    best = every.where(F.col("suffix") != F.col("file_path")).groupBy("suffix").agg(F.min(F.struct(F.length("file_path").alias("n"), "file_path")).alias("b"))
    return best.select("suffix", F.col("b.file_path").alias("file_path"), F.lit(False).alias("whole")).unionByName(files.select(F.col("file_path").alias("suffix"), "file_path", F.lit(True).alias("whole")).distinct())


def probes(expr: Column, here: Column) -> Column:
    """An array of (path, symbol, exact) that an import's expression may mean in a folder, the first choice first. exact: a file's path, no endings."""
    probe = lambda path, symbol, exact=False: F.struct(path.alias("path"), symbol.alias("symbol"), F.lit(exact).alias("exact"))
    none, text = F.lit(None).cast("string"), F.regexp_replace(F.trim(expr), r"\.\*$", "")
    up = lambda path: (F.regexp_replace(path, r"/?[^/]*$", ""), F.regexp_extract(path, r"([^/]*)$", 1))
    # a link to a file, maybe with an anchor
    file_part, anchor = F.regexp_extract(text, r"^([^#]*)", 1), F.regexp_extract(text, r"#(.*)$", 1)
    anchor = F.when(anchor != "", anchor)
    rel = F.when(file_part.startswith("."), joined(here, file_part)).otherwise(F.regexp_replace(file_part, "^/+", ""))
    link = F.array(probe(rel, anchor, True), probe(file_part, anchor, True))
    # ./x and ../x; then leading dots, one for this folder and one more for each above
    slashed = joined(here, text)
    dots, rest = F.length(F.regexp_extract(text, r"^(\.+)", 1)), F.regexp_replace(F.regexp_extract(text, r"^\.+(.*)$", 1), r"\.", "/")
    dotted = joined(F.concat_ws("/", here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))), rest)
    relative = F.when(text.rlike(r"^\.\.?/"), slashed).otherwise(dotted)
    near = F.array(probe(relative, none), probe(*up(relative)))
    # a.b.c beside the file, then from the root; the last name may be a symbol
    full = F.regexp_replace(F.replace(text, F.lit("::"), F.lit(".")), r"\.", "/")
    beside = joined(here, full)
    far = F.array(probe(beside, none), probe(*up(beside)), probe(full, none), probe(*up(full)))
    return F.when(text.contains("#") | F.lower(text).rlike("(" + "|".join(e.replace(".", r"\.") for e in FILES) + ")$"), link).when(text.startswith("."), near).otherwise(far)


def modules(files: DataFrame) -> DataFrame:
    """path, e, target_file, whole: each end of a file's path under what is left of it without each module ending (e: its place) that it has."""
    cut = lambda i, e: F.when(F.col("suffix").endswith(e) & (F.length("suffix") > len(e)), F.struct(F.lit(i).alias("e"), F.expr(f"left(suffix, length(suffix) - {len(e)})").alias("path")))
    every = F.filter(F.array(*(cut(i, e) for i, e in enumerate(ENDINGS))), lambda x: x.isNotNull())
    return suffixes(files).select("whole", F.col("file_path").alias("target_file"), F.explode(every).alias("x")).select("x.path", "x.e", "target_file", "whole")


def by_names(nodes: DataFrame, file: str, id_: str, name: str) -> DataFrame:
    """file, id, name, tier: each node under its full name (tier 1) and, if it is another, its name (tier 2), so that either is an equi-join."""
    both = F.array(F.struct(F.col("fqn").alias("n"), F.lit(1).alias("tier")), F.when(~F.col("fqn").eqNullSafe(F.col("name")), F.struct(F.col("name").alias("n"), F.lit(2).alias("tier"))))
    return nodes.select(F.col("file_path").alias(file), F.col("id").alias(id_), F.explode(both).alias("x")).where("x.n IS NOT NULL").select(file, id_, F.col("x.n").alias(name), "x.tier")


def found_imports(places: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """here, expr, target_file, target_id: what places (here, expr; distinct, a written table) mean, as resolve_imports says; what is external has no row."""
    files = nodes.select("file_path").distinct() if files is None else files.select("file_path").distinct()
    tried = places.select("here", "expr", F.posexplode(probes(F.col("expr"), F.col("here"))).alias("k", "p")).select("here", "expr", "k", "p.*").where("path <> ''")
    hits = tried.join(modules(files), "path").where("NOT exact OR e = 0")
    keys = ["here", "expr"]
    best = hits.groupBy(*keys).agg(F.min(F.struct("k", (~F.col("whole")).alias("part"), "e", "target_file", "symbol")).alias("b"))
    best = scratch.written(best.select(*keys, "b.target_file", "b.symbol"), "link-files")
    full = graph.best_tier(best.where("symbol IS NOT NULL").join(by_names(nodes, "target_file", "target_id", "symbol"), ["target_file", "symbol"]).select(F.struct(*keys).alias("place"), "target_id", "tier"), "place")
    full = full.select("place.*", "target_id")
    left = places.join(best, keys, "left_anti").withColumn("fqn", F.regexp_replace(F.replace(F.trim("expr"), F.lit("::"), F.lit(".")), r"\.\*$", ""))
    named = left.join(nodes.select("fqn", F.col("file_path").alias("target_file"), F.col("id").alias("target_id")), "fqn").select(*keys, "target_file", "target_id")
    return best.join(full, keys, "left").select(*keys, "target_file", "target_id").unionByName(named)


def with_targets(asked: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """asked (a written table with file_path and expr, no blank ones) with target_file and target_id, null if external. An expression means the
    same in all files of a folder, so it is resolved once a folder."""
    asked = asked.withColumn("here", folder(F.col("file_path")))
    places = scratch.written(asked.select("here", "expr").distinct(), "link-places")
    return asked.join(found_imports(places, nodes, files), ["here", "expr"], "left").drop("here")


def resolve_imports(imports: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """imports (distinct file_path, expr) with target_file, target_id and external.

    Tiers: the paths that the expression may mean, each as it is and with each module ending, whole paths before ends of
    paths; then a symbol of that full name anywhere. A named symbol of the file found gives a row each. What nothing fits is
    external.
    """
    asked = scratch.written(imports.select("file_path", "expr").where("trim(expr) <> ''").distinct(), "link-asked")
    return with_targets(asked, nodes, files).select("file_path", "expr", "target_file", "target_id", F.col("target_file").isNull().alias("external"))


#: By language: a function of (imports, nodes, files) in place of resolve_imports.
RESOLVERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]] = {}


def register_resolver(language: str, resolver: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]) -> None:
    RESOLVERS[language] = resolver


def resolve_by_language(imports: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Each language's imports by its registered resolver, all others by resolve_imports."""
    out = resolve_imports(imports.where(~F.coalesce(F.col("language").isin(*RESOLVERS), F.lit(False))) if RESOLVERS else imports, nodes, files)
    for language, resolver in RESOLVERS.items():
        out = out.unionByName(resolver(imports.where(F.col("language") == language), nodes, files).select(*out.columns))
    return out


def resolve_types(inherits: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """src, base, position of inherits (src, file_path, expr, position): a type of the file, else an imported one, else the only one so named."""
    known = nodes.where(F.col("kind").isin(*TYPES))
    types = known.select(F.col("id").alias("candidate"), "name", "fqn")
    asked = inherits.select("src", "file_path", "position", F.regexp_replace(F.trim("expr"), "::", ".").alias("expr"))
    key = ["src", "file_path", "position", "expr"]
    own = asked.join(by_names(known, "file_path", "candidate", "expr").drop("tier"), ["file_path", "expr"]).select(*key, "candidate", F.lit(1).alias("tier"))
    via = asked.join(targets.select("file_path", F.col("alias").alias("expr"), F.col("target_id").alias("candidate")), ["file_path", "expr"]).select(*key, "candidate", F.lit(2).alias("tier"))
    by_name = asked.join(types.select("candidate", F.col("fqn").alias("expr")), "expr").select(*key, "candidate", F.lit(3).alias("tier"))
    short = types.groupBy(F.col("name").alias("expr")).agg(F.min("candidate").alias("candidate"), F.count("*").alias("n")).where("n = 1").drop("n")
    last = asked.join(short, "expr").select(*key, "candidate", F.lit(4).alias("tier"))
    every = own.unionByName(via).unionByName(by_name).unionByName(last).where("candidate IS NOT NULL AND candidate <> src")
    best = graph.best_tier(every.withColumn("site", F.struct(*key)), "site")
    return best.groupBy("src", "position", "expr").agg(F.min("candidate").alias("base"), F.count_distinct("candidate").alias("n")).where("n = 1").select("src", "base", "position")


#: What a call's meaning depends on: calls alike in these are resolved once.
PLACE = ("src", "file_path", "expr")


def least_tier(candidates: DataFrame, keys: tuple[str, ...], lost: DataFrame) -> DataFrame:
    """Of each key the candidates of the least tier, each once: candidate, tier, known (it is not one of lost), n (how many are known). A written table.

    The candidates are dealt out once, by key, for all of this.
    """
    own = Window.partitionBy(*keys)
    rows = candidates.repartition(*keys).groupBy(*keys, "candidate").agg(F.min("tier").alias("tier"))
    rows = rows.withColumn("_least", F.min("tier").over(own)).where("tier = _least").drop("_least")
    rows = rows.join(lost.withColumn("known", F.lit(False)), "candidate", "left").withColumn("known", F.col("candidate").isNotNull() & F.coalesce("known", F.lit(True)))
    return scratch.written(rows.withColumn("n", F.count_if("known").over(own)), "link-best")


def judged(best: DataFrame, keys: tuple[str, ...], nodes: DataFrame) -> DataFrame:
    """keys, dst, tier, status of least_tier: several known candidates of one parent and name are overloads. Only these are looked up."""
    tier = F.expr("tier div 1000000").cast("int").alias("tier")
    known = best.where("known")
    one = known.where("n = 1").select(*keys, F.col("candidate").alias("dst"), tier, F.lit("resolved").alias("status"))
    parents = nodes.select(F.col("id").alias("candidate"), F.coalesce("parent_id", "file_path").alias("_parent"), F.col("name").alias("_name"))
    alike = F.when(F.col("_parent").isNotNull() & F.col("_name").isNotNull(), F.struct("_parent", "_name"))
    own = Window.partitionBy(*keys)
    several = known.where("n > 1").join(parents, "candidate").withColumn("_same", F.coalesce(F.min(alike).over(own) == F.max(alike).over(own), F.lit(False)))
    several = several.select(*keys, F.col("candidate").alias("dst"), tier, F.when(F.col("_same"), "overload_group").otherwise("ambiguous").alias("status"))
    return one.unionByName(several.distinct())


def resolve_calls(refs: DataFrame, nodes: DataFrame, targets: DataFrame, dag: DataFrame) -> DataFrame:
    """site, src, dst, tier, status of refs, by four tiers of scope; an unresolved site has no dst.

    1: enclosing scopes of the same file, the innermost first. 2: after self, super and the like, members of the type around
    and of its ancestors, the nearest first; nothing else is tried for these. 3: imported names (targets: file_path, alias,
    target_file, target_id). 4: the full name anywhere, or the short one if only one symbol has it.

    A call's meaning is looked up once for all sites of its src, file and expression; rows of refs with one site share their
    candidates. Scopes are searched only for names that the file has, and tier 4 only for names that are not imported.
    """
    refs = scratch.written(refs.select("site", *PLACE), "link-refs")
    text = F.regexp_replace(F.trim("expr"), "::", ".")
    around = nodes.select(F.col("id").alias("src"), F.col("fqn").alias("scope"), F.when(F.col("kind").isin(*TYPES), F.col("id")).otherwise(F.col("parent_id")).alias("type"))
    around = scratch.written(around.join(refs.select("src").distinct(), "src", "left_semi"), "link-callers")  # few callers may make most calls
    asked = refs.select(*PLACE).distinct().withColumn("text", text).select(*PLACE, "text", F.regexp_replace(F.regexp_extract("text", r"^(.*)\.[^.]*$", 1), r"\(\)$", "").alias("prefix"), F.regexp_extract("text", r"([^.]*)$", 1).alias("member"))
    asked = scratch.written(asked.where("member <> ''").join(around, "src", "left"), "link-calls")
    special = F.col("prefix").isin(*OWN, *BASE)
    symbols = nodes.select(F.col("id").alias("candidate"), F.col("file_path").alias("own_file"), F.col("name").alias("own_name"), F.col("fqn").alias("own_fqn"), F.col("parent_id").alias("own_parent"))
    # what the first name of a call is in its file: a symbol's last name (near), imported ones; both under one deal by file and name
    first = asked.where(~special).withColumn("alias", F.when(F.col("prefix") == "", F.col("member")).otherwise(F.col("prefix")))
    near = symbols.select(F.col("own_file").alias("file_path"), F.substring_index("own_fqn", ".", -1).alias("alias")).distinct().withColumn("near", F.lit(True))
    named = targets.select("file_path", "alias", "target_file", "target_id").repartition("file_path", "alias").distinct().withColumn("imported", F.lit(True))
    looked = scratch.written(first.join(near, ["file_path", "alias"], "left").join(named, ["file_path", "alias"], "left"), "link-looked")
    place = lambda rank, tier: (*PLACE, "candidate", (F.lit(tier * 1_000_000) + rank).cast("long").alias("tier"))
    scopes = F.split(F.coalesce("scope", F.lit("")), r"\.")
    inner = F.posexplode(F.transform(F.sequence(F.size(scopes), F.lit(0), F.lit(-1)), lambda d: F.concat_ws(".", F.filter(F.slice(scopes, F.lit(1), d), lambda x: x != ""), F.col("member"))))
    lexical = looked.where("near AND prefix = ''").select(*PLACE, "scope", "member").distinct().select(*PLACE, F.col("file_path").alias("own_file"), inner.alias("rank", "own_fqn"))
    lexical = lexical.join(symbols, ["own_file", "own_fqn"]).select(*place(F.col("rank"), 1))
    up = scratch.written(graph.ancestors(dag.select("node", "base")), "link-ancestors")
    reach = asked.where(special).join(up.select(F.col("node").alias("type"), F.col("ancestor").alias("own_parent"), "distance"), "type").select(*PLACE, "own_parent", "member", "distance")
    reach = reach.unionByName(asked.where(F.col("prefix").isin(*OWN)).select(*PLACE, F.col("type").alias("own_parent"), "member", F.lit(0).cast("long").alias("distance")))
    inherited = reach.join(symbols, "own_parent").where("own_name = member").select(*place(F.col("distance"), 2))
    direct = looked.where("prefix = '' AND target_id IS NOT NULL").withColumn("candidate", F.col("target_id")).select(*place(F.lit(0), 3))
    through = looked.where("prefix <> '' AND imported")
    in_type = through.where("target_id IS NOT NULL").join(symbols, F.col("target_id") == F.col("own_parent")).where("own_name = member").select(*place(F.lit(0), 3))
    in_file = through.where("target_id IS NULL").join(symbols, F.col("target_file") == F.col("own_file")).where("own_fqn = member").select(*place(F.lit(0), 3))
    free = looked.where("prefix <> '' OR target_id IS NULL").select(*PLACE, "text", "prefix", "member").distinct()
    whole = free.join(symbols, F.col("text") == F.col("own_fqn")).select(*place(F.lit(0), 4))
    only = symbols.groupBy("own_name").agg(F.min("candidate").alias("candidate"), F.count("*").alias("n")).where("n = 1")
    unique = free.where("prefix = ''").join(only, F.col("member") == F.col("own_name")).select(*place(F.lit(1), 4))
    every = lexical.unionByName(inherited).unionByName(direct).unionByName(in_type).unionByName(in_file).unionByName(whole).unionByName(unique)
    lost = scratch.written(targets.select(F.col("target_id").alias("candidate")).where("candidate IS NOT NULL").distinct().join(symbols, "candidate", "left_anti"), "link-lost")
    best = least_tier(every, PLACE, lost)
    mixed = scratch.written(refs.where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("n")).where("n > 1").select("site"), "link-mixed")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in PLACE))
    found = judged(best, PLACE, nodes)
    alone = refs.join(mixed, "site", "left_anti")
    out = alone.join(found, same(alone, found) & alone["site"].isNotNull(), "left").select("site", alone["src"], "dst", "tier", "status")
    if not mixed.isEmpty():
        shared = refs.join(mixed, "site", "left_semi")
        pooled = shared.join(best, same(shared, best)).select("site", "candidate", "tier")
        out = out.unionByName(shared.select("site", "src").join(judged(least_tier(pooled, ("site",), lost), ("site",), nodes), "site", "left").select("site", "src", "dst", "tier", "status"))
    return out.withColumn("status", F.coalesce("status", F.lit("unresolved")))


def resolve_documents(links: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """site, src, dst of a document's links (site, src, file_path, expr): the symbol or file of the link, else a full name, else a short name that only one has."""
    via = links.join(targets.select("file_path", "expr", "target_id"), ["file_path", "expr"]).where("target_id IS NOT NULL").select("site", "src", F.col("target_id").alias("candidate"), F.lit(1).alias("tier"))
    full = links.join(nodes.select(F.col("id").alias("candidate"), F.col("fqn").alias("expr")), "expr").select("site", "src", "candidate", F.lit(2).alias("tier"))
    short = nodes.groupBy(F.col("name").alias("last")).agg(F.min("id").alias("candidate"), F.count("*").alias("n")).where("n = 1")
    last = links.withColumn("last", F.regexp_extract("expr", r"([^.#/]*)$", 1)).join(short, "last").select("site", "src", "candidate", F.lit(3).alias("tier"))
    best = graph.best_tier(via.unionByName(full).unionByName(last))
    return best.select("site", "src", F.col("candidate").alias("dst"), "tier")


def points(receiver: Column, candidate_type: Column, caller_type: Column, candidate_file: Column, caller_file: Column, arity: Column, arguments: Column) -> Column:
    """How well a candidate fits a call: its type is the receiver (15) or holds its name (10), is the caller's own (8), lies in the
    caller's file (5) or folder (4), and takes as many arguments (5)."""
    receiver, kind = F.lower(F.coalesce(receiver, F.lit(""))), F.lower(F.coalesce(candidate_type, F.lit("")))
    like = F.when((receiver != "") & (receiver == kind), 15).when((receiver != "") & (kind != "") & (kind.contains(receiver) | receiver.contains(kind)), 10).otherwise(0)
    own = F.when((kind != "") & (kind == F.lower(F.coalesce(caller_type, F.lit("")))), 8).otherwise(0)
    near = F.when(candidate_file == caller_file, 5).when(folder(candidate_file) == folder(caller_file), 4).otherwise(0)
    return like + own + near + F.when(arity == arguments, 5).otherwise(0)


def link(nodes: DataFrame, imports: DataFrame, inherits: DataFrame, refs: DataFrame, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole workspace in four passes, each on a written table: groups, imports, types (without cycles), calls, and documents."""
    nodes = scratch.written(nodes, "link-nodes")
    out = {"groups": scratch.written(graph.fold(nodes, ["language", "kind", "fqn"]), "link-groups")}
    if "language" in imports.columns:
        out["imports"] = scratch.written(resolve_by_language(imports, nodes), "link-imports")
        targets = imports.select("file_path", "expr", "alias").distinct().join(out["imports"], ["file_path", "expr"])
        targets = scratch.written(targets.where(~F.col("external")).select("file_path", "expr", "alias", "target_file", "target_id"), "link-targets")
    else:
        asked = scratch.written(imports.select("file_path", "expr", "alias").where("trim(expr) <> ''").distinct(), "link-asked")
        targets = scratch.written(with_targets(asked, nodes), "link-imports")
        out["imports"] = targets.select("file_path", "expr", "target_file", "target_id", F.col("target_file").isNull().alias("external")).distinct()
        targets = targets.where("target_file IS NOT NULL")
    bases = resolve_types(inherits, nodes, targets).select(F.col("src").alias("node"), "base", "position")
    out["types"] = scratch.written(graph.type_dag(bases), "link-types")
    out["calls"] = scratch.written(resolve_calls(refs, nodes, targets, out["types"]), "link-resolved")
    if documents is not None:
        found = resolve_imports(documents.select("file_path", "expr"), nodes)
        out["documents"] = scratch.written(resolve_documents(documents, nodes, found), "link-documents")
    return out
