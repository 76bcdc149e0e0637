"""Registered queries of the linker: parts are functions of modules, brands are types, line items are calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import graph, linker
from ferrule.plans.catalogue import edges, query, table

MODULE = "'pkg' || (p_size % 7) || '/mod' || (p_partkey % 40) || '.py'"
#: Each part is a function f<key> of a module; each brand and size is a class around it.
NODES = f"n AS (SELECT 'f' || p_partkey AS id, {MODULE} AS file_path, 'f' || p_partkey AS name, 'f' || p_partkey AS fqn FROM part)"
#: Each line item's supplier imports the part's function, by its dotted name for even orders, by a relative one for odd.
IMPORTS = f"i AS (SELECT DISTINCT 'app/s' || (l_suppkey % 20) || '.py' AS file_path, CASE WHEN l_orderkey % 2 = 0 THEN 'pkg' || (p_size % 7) || '.mod' || (p_partkey % 40) || '.f' || p_partkey ELSE '../pkg' || (p_size % 7) || '/mod' || (p_partkey % 40) || '.py#f' || p_partkey END AS expr, {MODULE} AS target_file, 'f' || p_partkey AS target_id FROM lineitem JOIN part ON l_partkey = p_partkey)"


def nodes(spark, d):
    p, key = table(spark, d, "part"), F.concat(F.lit("f"), F.col("p_partkey"))
    path = F.concat(F.lit("pkg"), F.col("p_size") % 7, F.lit("/mod"), F.col("p_partkey") % 40, F.lit(".py"))
    return p.select(key.alias("id"), path.alias("file_path"), key.alias("name"), key.alias("fqn"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit("python").alias("language"))


def imports(spark, d):
    """Repeats go before the texts are made: slot, form and part say the same in fewer bytes."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("slot"), F.coalesce(F.col("l_orderkey") % 2 == 0, F.lit(False)).alias("dotted"), F.col("l_partkey").alias("p_partkey")).distinct()
    li = li.join(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7).alias("size")).distinct(), "p_partkey")
    pkg, mod, f = F.concat(F.lit("pkg"), F.col("size")), F.concat(F.lit("mod"), F.col("p_partkey") % 40), F.concat(F.lit("f"), F.col("p_partkey"))
    expr = F.when(F.col("dotted"), F.concat_ws(".", pkg, mod, f)).otherwise(F.concat(F.lit("../"), pkg, F.lit("/"), mod, F.lit(".py#"), f))
    return li.select(F.concat(F.lit("app/s"), F.col("slot"), F.lit(".py")).alias("file_path"), expr.alias("expr"), f.alias("alias"))


@query(f"WITH {IMPORTS} SELECT file_path, expr, target_file, target_id, false AS external FROM i")
def resolve_imports(spark, d):
    return linker.resolve_imports(imports(spark, d), nodes(spark, d))


CALLS = "c AS (SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_partkey AS site, 'main' || (l_suppkey % 20) AS src, 'app/s' || (l_suppkey % 20) || '.py' AS file_path, 'f' || l_partkey AS dst FROM lineitem)"


def calls(spark, d):
    """Repeats go before the texts are made, as in imports()."""
    li = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line"), "l_suppkey", "l_partkey").distinct()
    slot = F.col("l_suppkey") % 20
    return li.select(F.concat_ws(":", "line", "l_suppkey", "l_partkey").alias("site"), F.concat(F.lit("main"), slot).alias("src"), F.concat(F.lit("app/s"), slot, F.lit(".py")).alias("file_path"), F.concat(F.lit("f"), F.col("l_partkey")).alias("expr"))


@query(f"WITH {CALLS} SELECT site, src, dst, 3 AS tier, 'resolved' AS status FROM c")
def link_workspace(spark, d):
    """All four passes: every call is of an imported function."""
    n = nodes(spark, d)
    main = table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("k")).distinct()
    main = main.select(F.concat(F.lit("main"), F.col("k")).alias("id"), F.concat(F.lit("app/s"), F.col("k"), F.lit(".py")).alias("file_path"), F.concat(F.lit("main"), F.col("k")).alias("name"), F.concat(F.lit("main"), F.col("k")).alias("fqn"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit("python").alias("language"))
    none = spark.createDataFrame([], "src string, file_path string, expr string, position long")
    return linker.link(n.unionByName(main), imports(spark, d), none, calls(spark, d))["calls"]


E1 = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_shipdate AS site FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || (l_suppkey + 1), l_shipdate FROM lineitem)"


@query(f"WITH {E1} SELECT src, dst, epoch_us(site) AS site_us, p_name, p_brand FROM e LEFT JOIN part ON dst = 'p' || p_partkey")
def enriched_calls(spark, d):
    named = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), "p_name", "p_brand")
    out = graph.with_symbols(graph.site_rows(edges(spark, d)), named, "dst")
    return out.select("src", "dst", F.unix_micros(F.col("site").cast("timestamp")).alias("site_us"), "p_name", "p_brand")


@query("WITH c AS (SELECT c_custkey AS node, c_custkey // 3 AS base FROM customer WHERE c_custkey >= 3) SELECT node, base FROM c UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 3 = 1 AND c_custkey < (SELECT max(c_custkey) FROM customer)")
def type_tree(spark, d):
    """Types with a base each, siblings that extend the next, and edges back to the first sibling: the latter close cycles, so they go."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    last = c.agg(F.max("node").alias("last"))
    tree = c.where("node >= 3").select("node", F.expr("node div 3").alias("base"))
    on = c.crossJoin(F.broadcast(last)).where("node % 3 = 1 AND node < last").select("node", (F.col("node") + 1).alias("base"))  # one row
    back = on.select(F.col("base").alias("node"), F.col("node").alias("base"))
    return graph.type_dag(tree.unionByName(on).unionByName(back))


@query("WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, l_partkey AS p FROM lineitem), g AS (SELECT p_partkey AS p FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 7)) SELECT DISTINCT src FROM e JOIN g USING (p)")
def polymorphic_callers(spark, d):
    groups = table(spark, d, "part").select(F.col("p_brand").alias("group"), F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    calls_ = edges(spark, d).where(F.col("src").startswith("s"))
    return graph.polymorphic_callers(calls_, groups, F.col("node") == "p7")


@query("WITH t AS (SELECT n_name AS type, r_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT n_name || '.run' AS id, n_name AS type FROM nation UNION ALL SELECT r_name || '.run', r_name FROM region) SELECT m.id FROM m WHERE type = 'r0' OR type = (SELECT min(r_name) FROM region) OR type IN (SELECT type FROM t WHERE base = (SELECT min(r_name) FROM region))")
def contract_members(spark, d):
    """The members that the first region's method answers for: its own and those of its nations."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dag = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("base"))
    types = n.select(F.col("n_name").alias("type")).unionByName(r.select(F.col("r_name").alias("type")))
    members = types.select(F.concat("type", F.lit(".run")).alias("id"), "type", F.lit("run").alias("name")).unionByName(types.select(F.concat("type", F.lit(".stop")).alias("id"), "type", F.lit("stop").alias("name")))
    first = r.agg(F.min("r_name").alias("r")).first()["r"]
    return graph.contract(dag, members, (F.col("type") == first) & (F.col("name") == "run"))
