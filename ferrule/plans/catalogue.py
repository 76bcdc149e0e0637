"""Registered queries over the driver's tables, and the SQL that each must agree with.

Symbols are documents (name: first line, docstring: text), telemetry is events, transcripts are conversations, snapshots and
branches are derived from orders, call edges from lineitem (supplier calls part), versions from part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import semver, text
from ferrule.operators import documents, graph, lexical, reconcile, rules, sessions, spaces, vector
from ferrule.sources import scratch

QUERY = "the thnd of thon thre erer thnd"
R6 = lambda c: F.round(c, 6)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The index of each folder's documents, by application: built by the first search that asks for it.
_indexes: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, d: str, anew: bool = False) -> str:
    key = spark.sparkContext.applicationId, d
    if anew or key not in _indexes:
        path = _indexes.get(key) or scratch.new_path(spark, "index")
        lexical.write_index(symbols(spark, d), path, parts=1)
        _indexes[key] = path
    return _indexes[key]


def found(spark: SparkSession, d: str, limit: int | None = 10, **more) -> DataFrame:
    return lexical.search_index(spark, index(spark, d), QUERY, limit=limit, **more)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("name"), F.lit("").alias("signature"), F.lit("").alias("members"), F.col("text").alias("docstring"), F.col("lang").alias("language"), F.col("source").alias("space"), F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".md")).alias("file_path"))


STOPS = "['" + "','".join(text.STOP_WORDS) + "']"
# Terms of the corpora here: letters only, no ideographs; identifiers split as the column expressions do.
TOK = (
    r"list_concat([], flatten(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9_]+'), lambda s: list_filter(list_concat("
    r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda p: p <> ''),"
    r" CASE WHEN len(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda p: p <> '')) > 1"
    r" AND NOT list_contains(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+'), lambda p: p <> ''), lower(replace(s, '_', '')))"
    r" THEN [lower(replace(s, '_', ''))] ELSE [] END), lambda p: NOT list_contains({1}, p)))))"
)


def tok(c: str) -> str:
    return TOK.replace("{0}", c).replace("{1}", STOPS)


SYM = "sym AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS name, text AS docstring, lang AS language, source AS space, source || '/' || (doc_id % 50)::VARCHAR || '.md' AS file_path FROM documents)"
TERMS = f"{SYM}, tk AS (SELECT *, {tok('name')} AS tn, {tok('docstring')} AS td FROM sym)"
POST = f"{TERMS}, po AS (SELECT id, term, count(*) FILTER (f = 'n') AS fn, count(*) FILTER (f = 'd') AS fd FROM (SELECT id, unnest(tn) AS term, 'n' AS f FROM tk UNION ALL SELECT id, unnest(td), 'd' FROM tk) GROUP BY id, term)"
SCORE = f"""{POST}, st AS (SELECT count(*) AS n, greatest(1.0, sum(len(tn)) / count(*)) AS an, greatest(1.0, sum(len(td)) / count(*)) AS ad FROM tk),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term), q AS (SELECT unnest({tok("'" + QUERY + "'")}) AS term),
hit AS (SELECT po.id, q.term, ln(1 + greatest(0.0, (n - df + 0.5) / (df + 0.5))) * (3.5 * fn * 2.5 / (fn + 0.375 + 1e-9 + 1.125 / an * greatest(1, len(tn))) + 1.5 * fd * 2.5 / (fd + 0.375 + 1e-9 + 1.125 / ad * greatest(1, len(td)))) AS s
        FROM q JOIN po USING (term) JOIN dfs USING (term) JOIN tk ON tk.id = po.id CROSS JOIN st),
sc AS (SELECT id AS doc, sum(s) AS score, count(DISTINCT term) AS matched FROM hit GROUP BY id HAVING count(DISTINCT term) / (SELECT count(*) FROM q) >= 0.5)"""


@query(f"WITH {POST} SELECT count(DISTINCT id) AS docs, count(DISTINCT term) AS terms, count(*) AS postings, sum(fn + fd)::BIGINT AS tokens FROM po")
def bm25_index(spark, d):
    """Builds the index anew, whole, and says what it holds."""
    at = f"{(path := index(spark, d, anew=True))}/{scratch.pointer(spark, path)['version']}"
    rows, terms = spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/terms")
    docs = rows.where("lead").agg(F.count_distinct("doc").alias("docs"))  # a document with postings has a lead
    sums = rows.agg(F.count("*").alias("postings"), F.sum(F.expr(" + ".join(f"f_{f}" for f in lexical.FIELDS)).cast("long")).alias("tokens"))
    return docs.crossJoin(F.broadcast(terms.agg(F.count("*").alias("terms")))).crossJoin(F.broadcast(sums)).select("docs", "terms", "postings", "tokens")  # one row each


@query(f"WITH {SCORE} SELECT doc, round(score, 6) AS score, matched FROM sc ORDER BY score DESC, doc LIMIT 10")
def bm25_topk(spark, d):
    return found(spark, d).select("doc", R6("score").alias("score"), "matched")


@query(f"WITH {SCORE} SELECT doc, round(score, 6) AS score, matched FROM sc JOIN sym ON id = doc WHERE language = 'en' AND space IN ('src1', 'src2', 'src3') ORDER BY score DESC, doc LIMIT 10")
def bm25_filtered(spark, d):
    return found(spark, d, where=(F.col("language") == "en") & F.col("space").isin("src1", "src2", "src3")).select("doc", R6("score").alias("score"), "matched")


@query(f"WITH {SCORE} SELECT doc, round(score * CASE space WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END, 6) AS score FROM sc JOIN sym ON id = doc ORDER BY score DESC, doc LIMIT 10")
def bm25_space_weights(spark, d):
    return found(spark, d, weight=lexical.space_weight(F.col("space"), {"src1": 2.0, "src2": 0.5})).select("doc", R6("score").alias("score"))


ROLL = f"WITH {SCORE}, r AS (SELECT file_path, round(max(score) + 0.2 * (sum(score) - max(score)), 6) AS total_score, count(*) AS hits, array_to_string(list(doc ORDER BY score DESC, doc)[1:3], ',') AS top_items FROM sc JOIN sym ON id = doc GROUP BY file_path)"


@query(f"{ROLL} SELECT * FROM r ORDER BY total_score DESC, file_path LIMIT 10")
def bm25_file_rollup(spark, d):
    return lexical.roll_up(found(spark, d, None)).withColumn("total_score", R6("total_score"))


@query(f"{ROLL}, o AS (SELECT *, row_number() OVER w AS rank, lag(total_score) OVER w AS p, first(total_score) OVER w AS t FROM (SELECT * FROM r ORDER BY total_score DESC, file_path LIMIT 50) WINDOW w AS (ORDER BY total_score DESC, file_path)) SELECT file_path, total_score, hits, top_items, rank FROM o WHERE rank < coalesce((SELECT min(rank) FROM o WHERE rank > 3 AND (total_score < 0.38 * t OR total_score < 0.55 * p)), 1000)")
def adaptive_cutoff(spark, d):
    return lexical.adaptive_cut(lexical.roll_up(found(spark, d, None), limit=50).withColumn("total_score", R6("total_score")), "total_score", "file_path")


@query(f"WITH {TERMS} SELECT count(*) AS docs, round(greatest(1.0, sum(len(tn)) / count(*)), 6) AS a_name, round(greatest(1.0, sum(len(td)) / count(*)), 6) AS a_docstring FROM tk")
def corpus_stats(spark, d):
    s = lexical.statistics(lexical.lengths(symbols(spark, d)))
    return s.select("docs", R6("a_name").alias("a_name"), R6("a_docstring").alias("a_docstring"))


@query(f"WITH {POST} SELECT id AS doc, term, fn AS f_name, fd AS f_docstring FROM po")
def inverted_index(spark, d):
    return lexical.postings(symbols(spark, d)).select("doc", "term", "f_name", "f_docstring")


@query(f"WITH {POST} SELECT term, count(*) AS df, round(ln(1 + greatest(0.0, ((SELECT count(*) FROM sym) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS idf FROM po GROUP BY term")
def term_df_idf(spark, d):
    s = symbols(spark, d)
    n = s.agg(F.count("*").alias("n"))
    return lexical.term_documents(s).crossJoin(F.broadcast(n)).select("term", "df", R6(lexical.idf(F.col("df"), F.col("n"))).alias("idf"))


@query(f"SELECT doc_id, len({tok('text')})::BIGINT AS n, len(list_distinct({tok('text')}))::BIGINT AS n_unique, md5(array_to_string({tok('text')}, ' ')) AS terms FROM documents")
def tokenize_docs(spark, d):
    t = table(spark, d, "documents").withColumn("t", text.tokenize(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_unique"), F.md5(F.array_join("t", " ")).alias("terms"))


def vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


def probe(spark, d) -> list[float]:
    return list(vectors(spark, d).where("doc_id = 0").first()["embedding"])


SIM = "list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[])"
VEC = f"v AS (SELECT e.vec_id AS doc, round({SIM}, 6) AS sim, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p)"


@query(f"WITH {VEC} SELECT doc, sim FROM v ORDER BY sim DESC, doc LIMIT 50")
def vector_topk(spark, d):
    return vector.top_k(vectors(spark, d), probe(spark, d)).withColumn("sim", R6("sim"))


@query(f"WITH {VEC} SELECT doc, sim FROM v WHERE label IN (1, 2) ORDER BY sim DESC, doc LIMIT 20")
def vector_topk_masked(spark, d):
    return vector.top_k(vectors(spark, d), probe(spark, d), 20, F.col("label").isin(1, 2)).withColumn("sim", R6("sim"))


FUSE = f"WITH {SCORE}, {VEC}, lx AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS lexical_rank FROM (SELECT * FROM sc ORDER BY score DESC, doc LIMIT 30)), vx AS (SELECT doc, row_number() OVER (ORDER BY sim DESC, doc) AS vector_rank FROM (SELECT * FROM v ORDER BY sim DESC, doc LIMIT 30))"


@query(f"{FUSE} SELECT doc, lexical_rank, vector_rank, round(coalesce(0.5 / (60 + lexical_rank), 0) + coalesce(0.5 / (60 + vector_rank), 0), 6) AS score FROM lx FULL JOIN vx USING (doc)")
def rrf_fusion(spark, d):
    lex = vector.ranked(found(spark, d, 30), "score", "lexical_rank")
    vec = vector.ranked(vector.top_k(vectors(spark, d), probe(spark, d), 30).withColumn("sim", R6("sim")), "sim", "vector_rank")
    return vector.fuse(lex, vec).withColumn("score", R6("score"))


@query(f"WITH {SCORE}, {VEC} SELECT doc, sim FROM (SELECT doc, sim FROM v ORDER BY sim DESC, doc LIMIT 100) WHERE sim >= 0.7 OR doc IN (SELECT doc FROM sc)")
def vector_gate(spark, d):
    return vector.gate(vector.top_k(vectors(spark, d), probe(spark, d), 100).withColumn("sim", R6("sim")), found(spark, d, None))


def hashed(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.md5("text").alias("text_hash"))
    v = s.where("doc % 3 <> 0").select("doc", F.when(F.col("doc") % 7 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"))
    extra = table(spark, d, "embeddings").select((F.col("vec_id") + 10_000_000).alias("doc"), F.lit("x").alias("text_hash"))
    return s, v.unionByName(extra)


HASHED = "s AS (SELECT doc_id AS doc, md5(text) AS h FROM documents), v AS (SELECT doc, CASE WHEN doc % 7 = 0 THEN 'old' ELSE h END AS h FROM s WHERE doc % 3 <> 0 UNION ALL SELECT vec_id + 10000000, 'x' FROM embeddings)"


@query(f"WITH {HASHED} SELECT coalesce(s.doc, v.doc) AS doc, CASE WHEN v.doc IS NULL THEN 'missing' WHEN s.doc IS NULL THEN 'stale' ELSE 'changed' END AS state FROM s FULL JOIN v ON s.doc = v.doc WHERE v.doc IS NULL OR s.doc IS NULL OR s.h <> v.h")
def embedding_deficit(spark, d):
    return vector.deficit(*hashed(spark, d))


@query(f"WITH {HASHED}, f AS (SELECT s.doc AS a, v.doc AS b, s.h = v.h AS same FROM s FULL JOIN v ON s.doc = v.doc) SELECT count(a) AS total, count(*) FILTER (same) AS embedded, count(*) FILTER (a IS NOT NULL AND same IS NOT TRUE) AS missing, count(*) FILTER (b IS NOT NULL AND same IS NOT TRUE) AS stale, round(100.0 * count(*) FILTER (same) / count(a), 1) AS pct FROM f")
def coverage_report(spark, d):
    return vector.coverage(*hashed(spark, d))


@query(f"WITH {HASHED}, n AS (SELECT doc, 'new' AS h FROM s WHERE doc % 5 = 0) SELECT doc, h AS text_hash FROM v WHERE doc % 11 <> 0 AND doc NOT IN (SELECT doc FROM n) UNION ALL SELECT * FROM n")
def vector_upsert(spark, d):
    s, v = hashed(spark, d)
    return vector.upsert(v, v.where("doc % 11 = 0"), s.where("doc % 5 = 0").select("doc", F.lit("new").alias("text_hash")))


def edges(spark, d):
    """Suppliers call parts, parts call suppliers of the next number: a cyclic graph, from every row of lineitem."""
    li = table(spark, d, "lineitem")
    supplier, part, after = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey") + 1)
    site = F.col("l_shipdate").cast("string").alias("site")
    return li.select(supplier.alias("src"), part.alias("dst"), site).unionByName(li.select(part.alias("src"), after.alias("dst"), site))


EDGES = "e0 AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_shipdate AS site FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || (l_suppkey + 1), l_shipdate FROM lineitem), e AS (SELECT DISTINCT src, dst FROM e0)"
IMPACT = f"{EDGES}, l1 AS (SELECT DISTINCT src AS node FROM e WHERE dst = 'p7' AND src <> 'p7'), l2 AS (SELECT DISTINCT src AS node FROM e WHERE dst IN (SELECT node FROM l1) AND src <> 'p7' AND src NOT IN (SELECT node FROM l1)), l3 AS (SELECT DISTINCT src AS node FROM e WHERE dst IN (SELECT node FROM l2) AND src <> 'p7' AND src NOT IN (SELECT node FROM l1 UNION ALL SELECT node FROM l2)), im AS (SELECT node, 1::BIGINT AS layer FROM l1 UNION ALL SELECT node, 2 FROM l2 UNION ALL SELECT node, 3 FROM l3)"


@query(f"WITH {EDGES} SELECT src, dst, count(DISTINCT site)::BIGINT AS sites FROM e0 GROUP BY src, dst")
def edge_sites(spark, d):
    return graph.merge_sites(edges(spark, d))


@query(f"WITH {EDGES} SELECT src FROM e WHERE dst = 'p7'")
def callers(spark, d):
    return graph.callers(edges(spark, d), F.col("dst") == "p7")


@query(f"WITH {EDGES} SELECT dst FROM e WHERE src = 's3'")
def callees(spark, d):
    return graph.callees(edges(spark, d), F.col("src") == "s3")


def seed(spark, name):
    return spark.range(1).select(F.lit(name).alias("node"))


@query(f"WITH {IMPACT} SELECT * FROM im")
def impact_bfs(spark, d):
    return graph.impact(edges(spark, d), seed(spark, "p7"), 3)


@query(f"WITH {IMPACT} SELECT layer, count(*) AS symbols FROM im GROUP BY layer")
def impact_summary(spark, d):
    return graph.impact_summary(graph.impact(edges(spark, d), seed(spark, "p7"), 3))


def typed(spark, d):
    return edges(spark, d).select("src", "dst", F.when(F.col("src").startswith("s"), "calls").otherwise("inherits").alias("edge_kind"), F.when(F.length("dst") == 3, "unresolved").otherwise("resolved").alias("resolution_status"))


@query(
    f"WITH {EDGES}, t AS (SELECT * FROM e WHERE length(dst) <> 3), h1 AS (SELECT DISTINCT dst AS node FROM t WHERE src = 's3' AND src LIKE 's%'), h2 AS (SELECT DISTINCT dst AS node FROM t WHERE src IN (SELECT node FROM h1) AND dst <> 's3' AND dst NOT IN (SELECT node FROM h1)) SELECT node, 1::BIGINT AS layer FROM h1 UNION ALL SELECT node, 2 FROM h2"
)
def traverse_typed(spark, d):
    return graph.traverse(typed(spark, d), seed(spark, "s3"), ["calls", "inherits"], depth=2)


@query(f"WITH {IMPACT} SELECT src, dst FROM e WHERE dst = 'p7' OR dst IN (SELECT node FROM im WHERE layer < (SELECT max(layer) FROM im))")
def impact_chains(spark, d):
    e, s = edges(spark, d), seed(spark, "p7")
    return graph.chains(e, graph.impact(e, s, 3), s)


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE dst IN ('p1', 'p2', 'p3', 's5') AND src NOT IN ('p1', 'p2', 'p3', 's5')")
def external_incoming(spark, d):
    inside = spark.range(1).select(F.explode(F.array(*map(F.lit, ("p1", "p2", "p3", "s5")))).alias("node"))
    return graph.external_incoming(edges(spark, d).select("src", "dst").distinct(), inside)


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE src NOT IN ('s1', 's2') AND dst NOT IN ('s1', 's2') UNION SELECT 's1', 'p1'")
def graph_patch(spark, d):
    old = spark.range(1).select(F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("node"))
    return graph.patch(edges(spark, d).select("src", "dst"), old, spark.range(1).select(F.lit("s1").alias("src"), F.lit("p1").alias("dst")))


@query("WITH h AS (SELECT n_name AS node, r_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'world' FROM region) SELECT node, base AS ancestor, 1::BIGINT AS distance FROM h UNION SELECT h.node, g.base, 2 FROM h JOIN h g ON h.base = g.node")
def type_ancestors(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    h = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("base")).unionByName(r.select(F.col("r_name").alias("node"), F.lit("world").alias("base")))
    return graph.ancestors(h)


@query("WITH c AS (SELECT l_orderkey AS site, l_partkey AS c, l_suppkey AS p FROM lineitem UNION ALL SELECT o_orderkey, NULL, NULL FROM orders) SELECT site, CASE WHEN count(DISTINCT c) = 0 THEN 'unresolved' WHEN count(DISTINCT c) = 1 THEN 'resolved' WHEN count(DISTINCT p) = 1 THEN 'overload_group' ELSE 'ambiguous' END AS status, count(DISTINCT c) AS candidates FROM c GROUP BY site")
def classify_sites(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("candidate"), F.col("l_suppkey").alias("parent"), F.lit("f").alias("name"))
    none = table(spark, d, "orders").select(F.col("o_orderkey").alias("site"), *(F.lit(None).cast(t).alias(c) for c, t in (("candidate", "long"), ("parent", "long"), ("name", "string"))))
    return graph.classify(li.unionByName(none))


@query("WITH c AS (SELECT l_orderkey AS site, l_partkey AS c, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS tier FROM lineitem) SELECT site, c AS candidate, tier FROM (SELECT *, min(tier) OVER (PARTITION BY site) AS m FROM c) WHERE tier = m")
def scope_cascade(spark, d):
    li = table(spark, d, "lineitem")
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return graph.best_tier(li.select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("candidate"), tier.alias("tier")))


def snapshots(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("size"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime_ns"), F.md5(F.col("o_orderpriority")).alias("content_hash"))
    before = o.where("k % 7 <> 0").drop("k")
    now = o.where("k % 5 <> 0").select("rel_path", "size", F.when(F.col("k") % 11 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), F.when(F.col("k") % 3 == 0, "new").otherwise(F.col("content_hash")).alias("content_hash"))
    return before, now


SNAP = "ch AS (SELECT o_orderkey::VARCHAR AS rel_path, o_orderkey AS k, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 5 = 0 THEN 'deleted' WHEN k % 3 = 0 THEN 'modified' WHEN k % 11 = 0 THEN 'touched' ELSE 'unchanged' END AS change FROM orders WHERE k % 7 <> 0 OR k % 5 <> 0)"


@query(f"WITH {SNAP} SELECT rel_path, change FROM ch")
def snapshot_diff(spark, d):
    return spaces.diff(*snapshots(spark, d))


def state(spark, d):
    o = table(spark, d, "orders")
    created, updated = F.col("o_orderkey") % 50, F.col("o_orderkey") % 50 + F.col("o_custkey") % 300
    return o.select(F.col("o_orderkey").cast("string").alias("rel_path"), created.alias("created_gen"), updated.alias("updated_gen"), (F.col("o_custkey") % 4 == 0).alias("is_deleted"), F.col("o_orderstatus").alias("space"))


STATE = "s AS (SELECT o_orderkey::VARCHAR AS rel_path, o_orderkey % 50 AS created_gen, o_orderkey % 50 + o_custkey % 300 AS updated_gen, o_custkey % 4 = 0 AS is_deleted, o_orderstatus AS space FROM orders)"


@query(f"WITH {STATE}, {SNAP}, c AS (SELECT rel_path, change FROM ch WHERE change IN ('added', 'modified', 'deleted')) SELECT coalesce(s.rel_path, c.rel_path) AS rel_path, CASE WHEN change = 'added' THEN 400 ELSE created_gen END AS created_gen, CASE WHEN change IS NOT NULL THEN 400 ELSE updated_gen END AS updated_gen, CASE WHEN change IS NOT NULL THEN change = 'deleted' ELSE is_deleted END AS is_deleted FROM s FULL JOIN c ON s.rel_path = c.rel_path")
def generations(spark, d):
    return spaces.advance(state(spark, d).drop("space"), spaces.diff(*snapshots(spark, d)), 400)


@query(f"WITH {STATE}, x AS (SELECT rel_path, CASE WHEN is_deleted AND updated_gen > 20 AND created_gen <= 20 THEN 'deleted' WHEN NOT is_deleted AND created_gen > 20 THEN 'added' WHEN NOT is_deleted AND updated_gen > 20 THEN 'modified' END AS change FROM s) SELECT * FROM x WHERE change IS NOT NULL")
def consumer_diff(spark, d):
    return spaces.pending(state(spark, d), 20)


@query(f"WITH {STATE} SELECT * FROM s WHERE NOT (is_deleted AND 350 - updated_gen > 64 AND (updated_gen <= 100 OR 350 - updated_gen > 256))")
def tombstone_prune(spark, d):
    cursors = spark.range(1).select(F.explode(F.array(F.lit(0), F.lit(100), F.lit(200))).alias("acked_generation"))
    return spaces.prune(state(spark, d), cursors, 350)


@query(f"WITH {STATE} SELECT space, count(*) FILTER (NOT is_deleted) AS active, count(*) FILTER (is_deleted) AS deleted, max(updated_gen) AS head, CASE space WHEN 'F' THEN 5 WHEN 'O' THEN 5 END AS slowest FROM s GROUP BY space")
def space_status(spark, d):
    cursors = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(s).alias("space"), F.lit(g).alias("acked_generation")) for s, g in (("F", 5), ("O", 9), ("O", 5))))).alias("c")).select("c.*")
    return spaces.status(state(spark, d), cursors)


@query("WITH r AS (SELECT o_orderkey::VARCHAR AS rel_path, o_orderstatus AS space, o_orderkey AS k FROM orders), a AS (SELECT rel_path, space FROM r WHERE k % 9 <> 0 UNION SELECT rel_path, 'even' FROM r WHERE k % 2 = 0 AND k % 9 <> 0 UNION SELECT rel_path, 'own' FROM r WHERE k % 27 = 0) SELECT rel_path, array_to_string(list(DISTINCT space ORDER BY space), ',') AS spaces FROM a GROUP BY rel_path")
def space_algebra(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"), F.col("o_orderstatus").alias("space"), F.col("o_orderkey").alias("k"))
    children = o.drop("k").unionByName(o.where("k % 2 = 0").select("rel_path", F.lit("even").alias("space")))
    out = spaces.compose(children, o.where("k % 27 = 0").select("rel_path", F.lit("own").alias("space")), o.where("k % 9 = 0"))
    return out.select("rel_path", F.array_join("spaces", ",").alias("spaces"))


@query("WITH e AS (SELECT o_orderstatus AS space, o_orderkey::VARCHAR AS p, o_custkey AS n, md5(o_orderpriority) AS h FROM orders), l AS (SELECT space, substr(sha256(p), 1, 3) AS part, sha256(string_agg(p || '|' || n || '|' || h, chr(10) ORDER BY p || '|' || n || '|' || h)) AS leaf FROM e GROUP BY ALL) SELECT space, sha256(string_agg(part || ':' || leaf, chr(10) ORDER BY part)) AS root FROM l GROUP BY space")
def merkle_root(spark, d):
    o = table(spark, d, "orders")
    return spaces.digest(o.select(F.col("o_orderstatus").alias("space"), F.col("o_orderkey").cast("string").alias("rel_path"), F.col("o_custkey").alias("size"), F.md5("o_orderpriority").alias("content_hash")))


def three(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("rel_path"), F.md5("o_orderpriority").alias("md5"), F.lit("").alias("sha256"), F.col("o_custkey").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    edit = lambda by: o.withColumn("md5", F.when(F.col("k") % by == 0, F.concat("md5", F.lit(str(by)))).otherwise(F.col("md5")))
    return edit(3).where("k % 5 <> 0"), edit(4).where("k % 7 <> 0"), o.where("k % 11 <> 0")


def three_sql(mode: str, flags: str, force: bool) -> str:
    push, pull, dele = mode == "push", mode == "pull", flags == "delete"
    pick = lambda a: f"'{a}'" if a else "NULL"
    both = "push_update" if force and push else "pull_update" if force and pull else "conflict"
    return f"""WITH x AS (SELECT o_orderkey AS k, k % 5 <> 0 AS l, k % 7 <> 0 AS r, k % 11 <> 0 AS b, k % 3 = 0 AS lc, k % 4 = 0 AS rc FROM orders), a AS (SELECT k::VARCHAR AS rel_path, CASE
WHEN l AND r AND NOT lc AND NOT rc THEN 'in_sync' WHEN l AND r AND NOT b THEN '{both}' WHEN l AND r AND lc AND NOT rc THEN {pick(('pull_update' if force else 'in_sync') if pull else 'push_update')}
WHEN l AND r AND rc AND NOT lc THEN {pick(('push_update' if force else 'in_sync') if push else 'pull_update')} WHEN l AND r THEN '{both}'
WHEN l AND NOT b THEN {pick('push_new' if not pull else 'delete_local' if dele and force else None)} WHEN l AND lc THEN {pick('push_new' if force and push else 'delete_local' if force and pull and dele else 'conflict')}
WHEN l THEN {pick('delete_local' if not push and dele else 'push_new' if push else None)} WHEN r AND NOT b THEN {pick('pull_new' if not push else 'delete_remote' if dele and force else None)}
WHEN r AND rc THEN {pick('pull_new' if force and pull else 'delete_remote' if force and push and dele else 'conflict')} WHEN r THEN {pick('delete_remote' if not pull and dele else 'pull_new' if pull else None)} WHEN b THEN 'in_sync' END AS action FROM x)
SELECT * FROM a WHERE action IS NOT NULL"""


for _mode, _flags, _force in (("sync", "delete", False), ("push", "", True), ("pull", "delete", True)):

    def _three(spark, d, m=_mode, f=_flags, force=_force):
        return reconcile.three_way(*three(spark, d), m, f == "delete", f == "delete", force).select("rel_path", "action")

    _three.__name__ = f"reconcile_{_mode}"
    query(three_sql(_mode, _flags, _force))(_three)


@query("SELECT p_partkey AS file_id FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark, d):
    references = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"))
    return reconcile.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("file_id")), references)


@query("SELECT p_partkey AS file_id, count(DISTINCT l_suppkey) AS refs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def history_refcounts(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("branch"), F.col("l_partkey").alias("file_id"))
    return reconcile.reference_counts(table(spark, d, "part").select(F.col("p_partkey").alias("file_id")), refs)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(spark, d):
    return reconcile.last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


def telemetry(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", (F.col("event_type") == "error").alias("failed"), F.col("value").alias("duration"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type")
def telemetry_summary(spark, d):
    e = telemetry(spark, d).where(sessions.window_filter(F.col("ts"), "2024-01-05"))
    return sessions.summary(e, "event_type").select("event_type", "calls", "failures", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))


GAPS = "g AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))"


@query(f"WITH {GAPS} SELECT user_id, session::BIGINT AS session, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM g GROUP BY user_id, session")
def gap_sessions(spark, d):
    return sessions.sessions(telemetry(spark, d), "user_id").select("user_id", "session", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@query(f"WITH {GAPS} SELECT user_id, event_id AS id FROM g WHERE session = (SELECT max(session) FROM g h WHERE h.user_id = g.user_id)")
def last_session(spark, d):
    return sessions.last_session(telemetry(spark, d), "user_id").select("user_id", "id")


@query("WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, count(*) AS length FROM i GROUP BY user_id, event_type, g HAVING count(*) >= 3")
def consecutive_runs(spark, d):
    return sessions.runs(telemetry(spark, d), "user_id", "event_type").select("user_id", "event_type", F.unix_micros("first_ts").alias("first_us"), "length")


@query("WITH p AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS q FROM conversations) SELECT conv_id, role, 1 + count(*) FILTER (turn - q > 1) AS separate_edits, count(*) AS edits FROM p GROUP BY conv_id, role")
def edit_churn(spark, d):
    return sessions.churn(table(spark, d, "conversations"), ["conv_id", "role"], "turn")


EST = "CASE WHEN length(text) = 0 OR text IS NULL THEN 0 ELSE greatest(1, round_even(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) * 0.65, 0)) END::BIGINT"


def steps(spark, d):
    return table(spark, d, "conversations").withColumn("tokens", text.tokens_estimate(F.col("text")))


@query(f"SELECT doc_id, {EST} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query(f"WITH s AS (SELECT role, count(*) AS calls, sum({EST})::BIGINT AS amount FROM conversations GROUP BY role) SELECT role, calls, amount, round(100.0 * amount / sum(amount) OVER (), 1) AS pct, round(amount / calls, 1) AS mean FROM s")
def tool_share(spark, d):
    return sessions.shares(steps(spark, d), "role", "tokens")


@query(f"SELECT conv_id, max({EST}) AS tokens FROM conversations GROUP BY conv_id ORDER BY tokens DESC, conv_id LIMIT 5")
def heavy_steps(spark, d):
    return sessions.heaviest(steps(spark, d), "conv_id", "tokens")


@query(f"SELECT conv_id, count(*) AS steps, count(*) FILTER (role = 'user') AS user_turns, sum({EST})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def sessions_listing(spark, d):
    return sessions.listing(steps(spark, d))


def versions(spark, d):
    p = scratch.spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"))
    v = F.concat_ws(".", F.col("p_partkey") % 3, F.col("p_size") % 5, F.col("p_partkey") % 7)
    return p.select("p_partkey", "p_brand", F.when(F.col("p_size") % 4 == 0, F.concat(v, F.lit("-rc."), (F.col("p_size") % 12).cast("string"))).otherwise(v).alias("version"))


VER = "v AS (SELECT p_partkey, p_brand, (p_partkey % 3)::BIGINT AS a, (p_size % 5)::BIGINT AS b, (p_partkey % 7)::BIGINT AS c, CASE WHEN p_size % 4 = 0 THEN p_size % 12 END AS rc FROM part), w AS (SELECT *, a || '.' || b || '.' || c || CASE WHEN rc IS NOT NULL THEN '-rc.' || rc ELSE '' END AS version, a * 1000000 + b * 10000 + c * 100 + coalesce(rc, 99) AS k FROM v)"


@query(f"WITH {VER} SELECT p_partkey, version FROM w WHERE k >= 1020099 AND k < 2000000 AND NOT (a = 1 AND b = 3 AND c = 1 AND rc IS NULL)")
def semver_match(spark, d):
    return versions(spark, d).where(semver.matches(F.col("version"), "^=1.2.0, <2.0.0-rc.0, !=1.3.1")).select("p_partkey", "version")


@query(f"WITH {VER} SELECT p_brand, arg_max(version, k) AS version FROM w WHERE a = 1 GROUP BY p_brand")
def semver_best(spark, d):
    v = versions(spark, d).where(semver.matches(F.col("version"), "==1.*"))
    return v.groupBy("p_brand").agg(F.max_by("version", semver.sort_key(F.col("version"))).alias("version"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS plain FROM pages")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("plain"))


LINES = "l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS n FROM documents), c AS (SELECT *, coalesce(lag(line) OVER w, '') AS before, coalesce(lead(line) OVER w, '') AS after FROM l WINDOW w AS (PARTITION BY doc ORDER BY n))"


@query(f"WITH {LINES} SELECT doc, n, line, before, after FROM c WHERE contains(lower(line), 'license')")
def line_context_search(spark, d):
    return documents.find_lines(table(spark, d, "documents"), "License")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents")
def snippet_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", documents.snippet(F.col("text"), F.lit(3), 1, 1).alias("snippet"))


@query("WITH r AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS id FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS id FROM documents) SELECT id FROM r WHERE id NOT IN (SELECT id FROM c)")
def requirement_gap(spark, d):
    words = lambda t: t.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("id"))
    return documents.gaps(words(table(spark, d, "benchmark")), words(table(spark, d, "documents")).distinct())


@query("SELECT doc_id, sha1(source || ':' || lang || ':' || n_chars || ':doc:' || doc_id) AS id FROM documents")
def symbol_ids(spark, d):
    c = F.col
    return table(spark, d, "documents").select("doc_id", text.symbol_id(c("source"), c("lang"), c("n_chars").cast("string"), F.lit("doc"), c("doc_id")).alias("id"))


@query("WITH f AS (SELECT string_split(text, chr(10))[1] AS l, doc_id FROM documents) SELECT doc_id, CASE WHEN length(trim(l)) > 120 THEN substr(trim(l), 1, 120) || '...' ELSE trim(l) END AS summary FROM f")
def summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", text.summary(F.col("text"), F.lit("")).alias("summary"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: true) AS g FROM p) SELECT page_id, CASE WHEN len(list_filter(g, lambda x: x IN ('fr', 'de'))) > 0 THEN false ELSE coalesce(regexp_matches(g[len(g)], '\\.html$'), false) END AS matched FROM s")
def path_rules(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", rules.decide(path, ["*.html"], ["fr", "de"])["matched"].alias("matched"))
