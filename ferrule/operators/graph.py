"""Call graphs as edge tables (src, dst): one hop, bounded impact, typed traversal, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources import scratch


def merge_sites(sites: DataFrame) -> DataFrame:
    """Call sites (src, dst, site) to one edge a pair with the number of its distinct sites. The sites stay rows: site_rows."""
    return site_rows(sites).groupBy("src", "dst").agg(F.count("*").alias("sites"))


def site_rows(sites: DataFrame) -> DataFrame:
    return sites.select("src", "dst", "site").distinct()


def callers(edges: DataFrame, target: Column) -> DataFrame:
    return edges.where(target).select("src").distinct()


def callees(edges: DataFrame, source: Column) -> DataFrame:
    return edges.where(source).select("dst").distinct()


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "in") -> DataFrame:
    """node and the first layer that reaches it, at most depth away; seeds (column node) are never listed.

    The edges are written once, each layer is a part of a written table: a layer's plan reads the layer before it and, to leave
    out what is visited, the others, however deep the search goes. It ends at an empty layer.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    spark = edges.sparkSession
    back, on = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")), edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    step = scratch.written({"in": back, "out": on, "both": back.unionByName(on)}[direction].distinct(), "graph-step")
    kind = dict(step.dtypes)["node"]
    path = scratch.new_path(spark, "graph-layers")
    seeds.select(F.col("node").cast(kind)).distinct().write.parquet(f"{path}/layer=0")
    read = lambda: spark.read.schema(f"node {kind}, layer long").option("basePath", path).parquet(path)
    for layer in range(1, depth + 1):
        found = read().where(F.col("layer") == layer - 1).join(step, "node").select(F.col("next").alias("node")).distinct()
        found.join(read().select("node"), "node", "left_anti").write.parquet(f"{path}/layer={layer}")
        if spark.read.schema(f"node {kind}").parquet(f"{path}/layer={layer}").isEmpty():
            break
    return read().where("layer > 0")


def chains(edges: DataFrame, reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """The (src, dst) pairs that impact(direction 'in') went through: edges into seeds and into all but the last layer."""
    last = reached.agg(F.max("layer").alias("last"))
    inner = reached.crossJoin(F.broadcast(last)).where("layer < last").select("node")  # one row
    return edges.select("src", "dst").distinct().join(inner.unionByName(seeds.select("node")).distinct(), F.col("dst") == F.col("node"), "left_semi")


def impact_summary(reached: DataFrame) -> DataFrame:
    return reached.groupBy("layer").agg(F.count("*").alias("symbols"))


def traverse(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None = None, statuses: tuple[str, ...] = ("resolved", "overload_group", "ambiguous"), depth: int = 1, direction: str = "out") -> DataFrame:
    """impact over the edges (src, dst, edge_kind, resolution_status) of these kinds and states."""
    chosen = edges.where(F.col("resolution_status").isin(*statuses))
    return impact(chosen if kinds is None else chosen.where(F.col("edge_kind").isin(*kinds)), seeds, depth, direction)


def external_incoming(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges that come into a set of nodes (column node) from outside it."""
    own = inside.select("node").distinct()
    return edges.join(own, F.col("dst") == F.col("node"), "left_semi").join(own, F.col("src") == F.col("node"), "left_anti")


def patch(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that touch no old node, and the new ones, each once."""
    gone = old.select("node").distinct()
    kept = edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
    return kept.unionByName(new).distinct()


def ancestors(inherits: DataFrame) -> DataFrame:
    """node, ancestor, distance over (node, base), breadth first, of any depth; a node in a cycle is its own ancestor.

    Each distance is a part of a written table; only pairs that are new go on, so cycles end.
    """
    spark = inherits.sparkSession
    base = scratch.written(inherits.select(F.col("node").alias("mid"), F.col("base").alias("ancestor")).where("mid IS NOT NULL AND ancestor IS NOT NULL").distinct(), "graph-bases")
    kind, path, distance = dict(base.dtypes)["mid"], scratch.new_path(spark, "graph-ancestors"), 1
    base.select(F.col("mid").alias("node"), "ancestor").write.parquet(f"{path}/distance=1")
    read = lambda: spark.read.schema(f"node {kind}, ancestor {kind}, distance long").option("basePath", path).parquet(path)
    while not spark.read.schema(f"node {kind}").parquet(f"{path}/distance={distance}").isEmpty():
        last = read().where(F.col("distance") == distance).select("node", F.col("ancestor").alias("mid"))
        distance += 1
        last.join(base, "mid").select("node", "ancestor").distinct().join(read().select("node", "ancestor"), ["node", "ancestor"], "left_anti").write.parquet(f"{path}/distance={distance}")
    return read()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node linked to it, either way) of each end of an edge (src, dst); rounds of labels that spread.

    Joins are by merge: a broadcast in each round would send the labels through the driver.
    """
    both = scratch.written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))).distinct(), "graph-both")
    now = scratch.written(both.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("root")), "graph-roots")
    while True:
        near = both.join(now.select(F.col("node").alias("next"), "root").hint("merge"), "next").groupBy("node").agg(F.min("root").alias("near"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        then = now.join(near.hint("merge"), "node").join(jump.hint("merge"), "root").select("node", F.least("root", "near", "far").alias("root"))
        then = scratch.written(then, "graph-roots")
        if then.join(now.hint("merge"), ["node", "root"], "left_anti").isEmpty():
            return then
        now = then


def type_dag(inherits: DataFrame) -> DataFrame:
    """(node, base) without the edges that would close a cycle, taken in order of node and then of position (or of base).

    An edge can only be in a cycle if neither end runs out: leaves and roots are peeled off, round by round, and their edges
    stay. What is left, the cyclic core, is cut one connected part at a time, in order, as the outcome depends on it. Joins are
    by merge, so that no round sends edges through the driver.
    """
    own = inherits.where("node <> base").groupBy("node", "base").agg(F.min(F.col("position") if "position" in inherits.columns else F.col("base")).alias("position"))
    every = scratch.written(own, "types-every")
    core = every
    n = core.count()
    while n:
        left = core.join(core.select(F.col("node").alias("base")).distinct().hint("merge"), "base", "left_semi").join(core.select(F.col("base").alias("node")).distinct().hint("merge"), "node", "left_semi")
        core = scratch.written(left.select(*every.columns), "types-core")
        before, n = n, core.count()
        if n == before:
            break
    if not n:
        return every.select("node", "base")
    roots = components(core.select(F.col("node").alias("src"), F.col("base").alias("dst")))
    kinds = dict(every.dtypes)

    def cut(part):
        bases: dict = {}

        def reaches(start, goal) -> bool:
            seen, queue = {start}, [start]
            while queue:
                at = queue.pop()
                if at == goal:
                    return True
                fresh = [x for x in bases.get(at, ()) if x not in seen]
                seen.update(fresh)
                queue += fresh
            return False

        part = part.sort_values(["node", "position"])
        keep = []
        for node, base in zip(part["node"], part["base"]):
            keep.append(not reaches(base, node))
            if keep[-1]:
                bases.setdefault(node, []).append(base)
        return part.loc[keep, ["node", "base"]]

    kept = core.join(roots.hint("merge"), "node").groupBy("root").applyInPandas(cut, f"node {kinds['node']}, base {kinds['base']}")
    return every.join(core.hint("merge"), ["node", "base"], "left_anti").select("node", "base").unionByName(kept)


def contract(dag: DataFrame, members: DataFrame, seed: Column) -> DataFrame:
    """The members (id, type, name) that a member answers for: itself, and those of its name in its type's ancestors and descendants."""
    chosen = members.where(seed).select(F.col("type").alias("seed_type"), "name")
    up = ancestors(dag.select("node", "base"))
    related = chosen.join(up, F.col("seed_type") == F.col("node")).select(F.col("ancestor").alias("type"), "name").unionByName(chosen.join(up, F.col("seed_type") == F.col("ancestor")).select(F.col("node").alias("type"), "name"))
    related = related.unionByName(chosen.select(F.col("seed_type").alias("type"), "name")).distinct()
    return members.join(related, ["type", "name"], "left_semi").select("id").distinct()


def with_symbols(edges: DataFrame, symbols: DataFrame, end: str = "src") -> DataFrame:
    """Edges (src, dst, site) with the attributes of the symbols (id and more) at one end; an unknown symbol has nulls. Sites stay rows."""
    named = symbols.withColumnRenamed("id", end)
    return edges.join(named, end, "left")


def polymorphic_callers(edges: DataFrame, groups: DataFrame, target: Column) -> DataFrame:
    """Who calls any symbol of the groups (group, node) that a target is in, or the target itself."""
    own = groups.where(target).select("group").distinct()
    nodes = groups.join(own, "group", "left_semi").select("node").distinct()
    return edges.join(nodes, F.col("dst") == F.col("node"), "left_semi").select("src").distinct()


def classify(candidates: DataFrame) -> DataFrame:
    """site to unresolved, resolved, overload_group (several of one parent and name) or ambiguous; candidates may be null."""
    n, parents = F.count_distinct("candidate"), F.count_distinct("parent", "name")
    return candidates.groupBy("site").agg(F.when(n == 0, "unresolved").when(n == 1, "resolved").when(parents == 1, "overload_group").otherwise("ambiguous").alias("status"), n.alias("candidates"))


def best_tier(candidates: DataFrame, key: str = "site") -> DataFrame:
    """Rows of each key's least tier."""
    best = candidates.groupBy(key).agg(F.min("tier").alias("tier"))
    return candidates.join(best, [key, "tier"])


def resolve(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, id, tier: the symbols (id, name, fqn) of each wanted name's best tier: full name, name, both in any case."""
    keys = symbols.select("id", "name", "fqn", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("fqn")))).alias("_k"))
    both = wanted.select("wanted").distinct().withColumn("_k", F.lower("wanted")).join(keys, "_k")
    tier = F.when(F.col("fqn") == F.col("wanted"), 1).when(F.col("name") == F.col("wanted"), 2).when(F.lower("fqn") == F.col("_k"), 3).otherwise(4)
    return best_tier(both.select("wanted", "id", tier.alias("tier")), "wanted")


def siblings(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """src, dst: each symbol to the least of its group (keys); groups of one have none. A star, so rows stay in proportion."""
    least = symbols.groupBy(*keys).agg(F.min("id").alias("dst"))
    return symbols.join(least, keys).where(F.col("id") != F.col("dst")).select(F.col("id").alias("src"), "dst")


def declares(symbols: DataFrame, headers: tuple[str, ...] = ("h", "hpp", "hh", "hxx"), bodies: tuple[str, ...] = ("c", "cc", "cpp", "cxx")) -> DataFrame:
    """src, dst: symbols of headers and of implementation files of the same stem and full name.

    Each header's symbol goes to the group's least one of a body, and its least header's to the other bodies': a star at each
    end, so rows stay in proportion and every two are linked.
    """
    ext, stem = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)), F.regexp_extract("file_path", r"([^/]+)\.[^./]+$", 1)
    named = symbols.select("id", "fqn", F.when(ext.isin(*headers), "h").when(ext.isin(*bodies), "b").alias("side"), stem.alias("stem")).where("side IS NOT NULL")
    least = named.groupBy("stem", "fqn").agg(F.min(F.when(F.col("side") == "h", F.col("id"))).alias("h"), F.min(F.when(F.col("side") == "b", F.col("id"))).alias("b")).where("h IS NOT NULL AND b IS NOT NULL")
    both = named.join(least, ["stem", "fqn"])
    return both.where("side = 'h' OR id <> b").select(F.when(F.col("side") == "h", F.col("id")).otherwise(F.col("h")).alias("src"), F.when(F.col("side") == "h", F.col("b")).otherwise(F.col("id")).alias("dst"))


def fold(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """node and group: the least id of the symbols alike in these keys (partial types; a header's and a body's)."""
    return symbols.join(symbols.groupBy(*keys).agg(F.min("id").alias("group")), keys).select(F.col("id").alias("node"), "group")


def group_callers(edges: DataFrame, members: DataFrame) -> DataFrame:
    """group, src: who calls any member (group, node) of a group of overloads."""
    return edges.join(members, F.col("dst") == F.col("node")).select("group", "src").distinct()


def best_candidate(candidates: DataFrame, key: str = "site") -> DataFrame:
    """site, candidate, points: of each key the candidate of most points, if above 0; ties to the lesser."""
    total = candidates.where("points > 0").groupBy(key).agg(F.min(F.struct((-F.col("points")).alias("p"), "candidate")).alias("b"))
    return total.select(key, F.col("b.candidate").alias("candidate"), (-F.col("b.p")).alias("points"))


def overload(candidates: DataFrame, key: str, arity: int) -> DataFrame:
    """Of each key the first candidate (by position) that takes so many arguments, else the first."""
    pick = F.min(F.struct((F.col("arity") != arity).alias("other"), "position", "candidate"))
    return candidates.groupBy(key).agg(pick.alias("b")).select(key, F.col("b.candidate").alias("candidate"))


def merge_parts(types: DataFrame, keys: list[str]) -> DataFrame:
    """Partial types as one each, a row for each distinct thing that it has: what ('member', 'base' or 'doc'), value, and the type's id
    (the least of its parts). A doc's value comes with the id of its part, by which docs are read in order."""
    ids = types.groupBy(*keys).agg(F.min("id").alias("id"))
    rows = F.concat(F.transform("members", lambda m: F.struct(F.lit("member").alias("what"), m.alias("value"), F.lit(None).cast("long").alias("part"))), F.transform("bases", lambda m: F.struct(F.lit("base").alias("what"), m.alias("value"), F.lit(None).cast("long").alias("part"))), F.array(F.struct(F.lit("doc").alias("what"), F.col("doc").alias("value"), F.col("id").cast("long").alias("part"))))
    return types.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").distinct().join(ids, keys)
