"""More registered queries: text functions, selections, change feeds, nested maps, planning documents, journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import nested, text
from ferrule.operators import dependencies, documents, graph, ledgers, lexical, linker, selection, sessions, spaces, vector
from ferrule.plans.catalogue import EDGES, SNAP, STATE, VER, edges, found, index, probe, query, snapshots, state, table, tok, vectors, versions
from ferrule.sources import catalog, files, remote, scratch

c = F.col


@query("SELECT page_id, lower(coalesce(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.][^/]*\\.([^./]+)$', 1), '')) AS ext FROM pages")
def url_extensions(spark, d):
    return table(spark, d, "pages").select("page_id", text.extension(F.regexp_replace("url", r"[?#].*$", "")).alias("ext"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS exts FROM (SELECT p_partkey, list_transform(['py', lower(p_brand), 'md'], lambda x: ltrim(trim(x), '.')) AS list_distinct_ordered FROM part)")
def extension_lists(spark, d):
    listed = F.concat(F.lit(" .PY | "), c("p_brand"), F.lit(",md, ..md|"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.extensions(listed), ",").alias("exts"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_./\\\\]', ' ', 'g')), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS prepared FROM documents")
def embedding_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.embedding_text(c("text"))).alias("prepared"))


@query("SELECT doc_id, md5(trim(source || ' ' || lang || ' ' || substr(text, 1, 400))) AS given FROM documents")
def embedding_inputs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.embedding_input(c("source"), c("lang"), c("text"))).alias("given"))


@query("SELECT doc_id, source || '/' || lang || '::doc.' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '(int)' ELSE '' END AS id FROM documents")
def canonical_ids(spark, d):
    overload = F.when(c("doc_id") % 3 == 0, "int").otherwise("")
    return table(spark, d, "documents").select("doc_id", text.canonical_id(F.concat_ws("/", "source", "lang"), F.concat(F.lit("doc."), c("doc_id")), overload).alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events")
def iso_times(spark, d):
    e = table(spark, d, "events")
    given = F.when(c("event_id") % 10 == 0, "no time").when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", F.unix_micros(text.iso_time(given).cast("timestamp")).alias("us"))


@query(f"WITH k AS (SELECT doc_id, {tok('text')} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM k), m AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x), g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM m GROUP BY doc_id) SELECT doc_id, md5(coalesce(s, '')) AS terms, coalesce(n, 0) AS n FROM documents LEFT JOIN g USING (doc_id)")
def first_seen_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokenize_unique(c("text")).alias("t"))
    return t.select("doc_id", F.md5(F.array_join("t", " ")).alias("terms"), F.size("t").cast("long").alias("n"))


@query("WITH s AS (SELECT conv_id, turn, role, (length(text) // 4)::BIGINT AS tokens, CASE WHEN role = 'assistant' THEN 1 + turn % 3 ELSE 0 END AS tools FROM conversations), p AS (SELECT *, max(CASE WHEN tools > 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS planner FROM s) SELECT p.conv_id, p.turn AS step, p.planner, greatest(1, round_even(p.tokens / q.tools, 0))::BIGINT AS share FROM p JOIN s q ON q.conv_id = p.conv_id AND q.turn = p.planner WHERE p.role <> 'assistant'")
def output_attribution(spark, d):
    s = table(spark, d, "conversations").select("conv_id", c("turn").alias("step"), F.when(c("role") == "assistant", 1 + c("turn") % 3).otherwise(0).alias("tools"), (c("role") != "assistant").alias("is_output"), F.expr("length(text) div 4").alias("tokens"))
    return sessions.attribute_output(s)


@query("SELECT o_orderkey AS path, row_number() OVER (ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 20")
def plan_ranking(spark, d):
    plans = table(spark, d, "orders").select(c("o_orderkey").alias("path"), (c("o_orderstatus") == "O").alias("active"), c("o_orderdate").alias("date"))
    return files.ranked_plans(plans).select("path", c("place").cast("long").alias("place"))


@query(f"WITH {SNAP} SELECT rel_path FROM ch WHERE change IN ('added', 'modified')")
def dirty_paths(spark, d):
    return selection.dirty(spaces.diff(*snapshots(spark, d)))


FEED = "f AS (SELECT l_partkey::VARCHAR AS rel_path, l_returnflag AS space, CASE l_linenumber % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change, l_orderkey AS to_gen FROM lineitem)"


def change_feed(spark, d):
    change = F.when(c("l_linenumber") % 3 == 0, "added").when(c("l_linenumber") % 3 == 1, "modified").otherwise("deleted")
    return table(spark, d, "lineitem").select(c("l_partkey").cast("string").alias("rel_path"), c("l_returnflag").alias("space"), change.alias("change"), c("l_orderkey").alias("to_gen"))


@query(f"WITH {FEED} SELECT rel_path, CASE WHEN count(DISTINCT change) = 1 THEN min(change) ELSE 'modified' END AS change FROM f GROUP BY rel_path")
def merged_consumer_diffs(spark, d):
    return selection.merged_changes(change_feed(spark, d))


@query(f"WITH {FEED} SELECT max(to_gen) AS to_gen, count(DISTINCT space) AS spaces FROM f")
def head_watermark(spark, d):
    return selection.head(change_feed(spark, d))


NODES = "n AS (SELECT p_partkey AS id, 'dir' || (p_size % 5) || '/f' || (p_partkey % 30) || CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '.md' END AS file_path, p_name AS name, p_type AS kind, CASE p_partkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' END AS visibility, p_size FROM part)"


def nodes(spark, d):
    path = F.concat(F.lit("dir"), c("p_size") % 5, F.lit("/f"), c("p_partkey") % 30, F.when(c("p_size") % 2 == 0, ".py").otherwise(".md"))
    return table(spark, d, "part").select(c("p_partkey").alias("id"), path.alias("file_path"), c("p_name").alias("name"), c("p_type").alias("kind"), F.array("p_type").alias("kinds"), F.when(c("p_partkey") % 3 == 0, "private").when(c("p_partkey") % 3 == 1, "public").alias("visibility"), F.when(c("p_size") % 2 == 0, "python").otherwise("markdown").alias("language"), F.array(F.lit("src")).alias("spaces"), c("p_size").cast("long").alias("start_byte"), F.create_map(F.lit("size"), c("p_size").cast("string")).alias("facets"))


@query(f"WITH {NODES} SELECT id, file_path FROM n WHERE visibility IS DISTINCT FROM 'private' AND p_size % 2 = 0 AND p_size::VARCHAR = '4'")
def node_selection(spark, d):
    return selection.select_nodes(nodes(spark, d), ["src"], visibility="non-private", facets={"size": "4"}, extensions=["py"]).select("id", "file_path")


@query(f"WITH {NODES} SELECT id FROM n WHERE p_size % 2 = 0")
def topical_nodes(spark, d):
    return selection.topical(nodes(spark, d)).select("id")


TREE = "t AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 4 THEN c_custkey // 4 END AS parent_id, CASE WHEN c_custkey % 7 = 0 THEN 'private' ELSE 'public' END AS visibility FROM customer)"


@query(f"WITH RECURSIVE {TREE}, k AS (SELECT id, parent_id FROM t WHERE visibility = 'private' UNION SELECT t.id, t.parent_id FROM t JOIN k ON t.id = k.parent_id) SELECT DISTINCT id FROM k")
def outline_filter(spark, d):
    t = table(spark, d, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") >= 4, F.expr("c_custkey div 4")).alias("parent_id"), F.lit("method").alias("kind"), F.when(c("c_custkey") % 7 == 0, "private").otherwise("public").alias("visibility"), F.lit(False).alias("is_static"))
    return selection.outline(t, visibility="private").select("id")


@query("SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#11' THEN 10 WHEN lower(p_brand) = 'brand#11' THEN 8 ELSE 5 END AS points FROM part WHERE contains(lower(p_brand), 'brand#11') ORDER BY points DESC, length(p_type), id LIMIT 10")
def selector_ranking(spark, d):
    symbols = table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("name"), c("p_type").alias("fqn"), F.lit("class").alias("kind"))
    return selection.best_matches(symbols, "class Brand#11", 10).select("id", "points")


@query("WITH l AS (SELECT o_custkey AS k, o_orderkey AS n, [o_orderpriority, o_orderstatus] AS v FROM orders), r AS (SELECT k, n, i, v[i] AS value FROM l, (SELECT unnest([1, 2]) AS i)) SELECT k AS \"key\", value, arg_min(n, (n, i)) AS n, (arg_min(i, (n, i)) - 1)::INT AS i FROM r GROUP BY k, value")
def ordered_union(spark, d):
    lists = table(spark, d, "orders").select(c("o_custkey").alias("key"), c("o_orderkey").alias("n"), F.array("o_orderpriority", "o_orderstatus").alias("v"))
    return selection.appended(lists, "key", "n", "v")


@query("SELECT event_id, json_extract_string(props, '$.k') AS value, coalesce(json_extract_string(props, '$.none'), 'default') AS missing FROM events")
def nested_values(spark, d):
    return table(spark, d, "events").select("event_id", nested.get_path(c("props"), "k").alias("value"), nested.get_path(c("props"), "none", "default").alias("missing"))


@query("SELECT event_id, event_type AS \"type\", user_id AS own, true AS whole FROM events")
def nested_merge(spark, d):
    """Each event's properties deep-merged with a map of its own, set and read again."""
    e = table(spark, d, "events")
    over = F.to_json(F.struct(F.struct(c("event_type").alias("type")).alias("meta")))
    out = nested.set_path(nested.deep_merge(F.coalesce("props", F.lit("{}")), over), "meta.own", c("user_id").cast("string"))
    return e.select("event_id", out.alias("m"), "props").select("event_id", nested.get_path(c("m"), "meta.type").alias("type"), nested.get_path(c("m"), "meta.own").cast("long").alias("own"), (nested.get_path(c("m"), "k").eqNullSafe(nested.get_path(c("props"), "k"))).alias("whole"))


@query("WITH t AS (SELECT n_regionkey AS k, n_nationkey % 3 AS l, min(n_name) AS text FROM nation GROUP BY ALL) SELECT 'r' || k AS \"key\", arg_min(text, CASE l WHEN 2 THEN 1 WHEN 0 THEN 2 END) FILTER (l IN (2, 0)) AS text FROM t GROUP BY k HAVING count(*) FILTER (l IN (2, 0)) > 0")
def locale_chain(spark, d):
    rows = table(spark, d, "nation").groupBy(F.concat(F.lit("r"), c("n_regionkey")).alias("key"), F.concat(F.lit("l"), c("n_nationkey") % 3).alias("locale")).agg(F.min("n_name").alias("text"))
    return nested.translated(rows, ["l2", "l0"])


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || o_custkey || ' {x}' AS text FROM orders")
def filled_templates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", nested.filled(F.lit("Order {key} of {who} {x}"), {"key": c("o_orderkey"), "who": c("o_custkey")}).alias("text"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'plain://' || substr(url, 8) WHEN starts_with(url, 'https://www.') THEN 'www://' || substr(url, 13) WHEN starts_with(url, 'https://') THEN 'safe://' || substr(url, 9) END AS uri FROM pages")
def longest_prefix(spark, d):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^http://", "/plain/"), r"^https://www\.", "/safe/www/"), "^https://", "/safe/")
    return table(spark, d, "pages").select("page_id", catalog.to_uri(path, {"plain": "/plain", "safe": "/safe", "www": "/safe/www"}).alias("uri"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y_%m_%d') || '_' || o_orderkey ELSE 'plan' || o_orderkey END AS plan, o_orderkey % 2 = 0 AS active FROM orders WHERE strftime(o_orderdate, '%Y') = '1995' AND strftime(o_orderdate, '%m') = '03'")
def plans_of_a_month(spark, d):
    at = lambda f: F.date_format("o_orderdate", f)
    path = F.when(c("o_orderkey") % 2 == 0, F.concat(at("yyyy_MM_dd"), F.lit("_"), c("o_orderkey"), F.lit("/p1.md"))).otherwise(F.concat(F.lit("archived/"), at("yyyy"), F.lit("/"), at("MM"), F.lit("/plan"), c("o_orderkey"), F.lit("/p1.md")))
    return ledgers.plan_files(table(spark, d, "orders").select("o_orderkey", path.alias("rel_path")), "1995", "03").select("o_orderkey", "plan", "active")


@query("WITH b AS (SELECT l_suppkey AS branch, l_partkey AS path, max(l_orderkey) AS size FROM lineitem WHERE true GROUP BY ALL), j AS (SELECT l_suppkey AS branch, l_partkey AS path, arg_max(struct_pack(op := CASE WHEN l_linenumber % 4 = 0 THEN 'delete' ELSE 'upsert' END, size := l_orderkey * 2), (l_orderkey, l_linenumber)) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT b.* FROM b ANTI JOIN j USING (branch, path) UNION ALL SELECT branch, path, x.size FROM j WHERE x.op = 'upsert'")
def journal_replay(spark, d):
    li = table(spark, d, "lineitem")
    base = li.groupBy(c("l_suppkey").alias("branch"), c("l_partkey").alias("path")).agg(F.max("l_orderkey").alias("size"))
    journal = li.where("l_returnflag = 'R'").select(c("l_suppkey").alias("branch"), c("l_partkey").alias("path"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.when(c("l_linenumber") % 4 == 0, "delete").otherwise("upsert").alias("op"), (c("l_orderkey") * 2).alias("size"))
    return remote.replayed(base, journal, ["branch", "path"])


@query("WITH b AS (SELECT DISTINCT l_suppkey % 50 AS node, l_partkey % 40 + 100 AS base FROM lineitem) SELECT node, base FROM b")
def folded_types(spark, d):
    """A two-layer hierarchy has no circles, so all of it stays."""
    return graph.type_dag(table(spark, d, "lineitem").select((c("l_suppkey") % 50).alias("node"), (c("l_partkey") % 40 + 100).alias("base")))


@query(f"WITH {STATE}, h AS (SELECT space, max(updated_gen) AS to_gen FROM s GROUP BY space), x AS (SELECT space, rel_path, CASE WHEN is_deleted AND updated_gen > 20 AND created_gen <= 20 THEN 'deleted' WHEN NOT is_deleted AND created_gen > 20 THEN 'added' WHEN NOT is_deleted AND updated_gen > 20 THEN 'modified' END AS change FROM s) SELECT space, rel_path, change, to_gen FROM x JOIN h USING (space) WHERE change IS NOT NULL")
def consumed_spaces(spark, d):
    from ferrule.streaming import sync

    s = state(spark, d)
    names = [r["space"] for r in s.select("space").distinct().collect()]  # the spaces' names
    return sync.consumed({n: s.where(c("space") == n).drop("space") for n in names}, dict.fromkeys(names, 20))


@query("SELECT o_orderkey::VARCHAR AS rel_path, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND epoch_us(o_orderdate) < 800000000000000 THEN md5(o_orderpriority) END AS content_hash FROM orders")
def racy_files(spark, d):
    """Which hashes a scan keeps: not those of files that changed, nor of those written just before the last scan."""
    o = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("rel_path"), c("o_orderkey").alias("k"), c("o_custkey").alias("size"), F.unix_micros(c("o_orderdate").cast("timestamp")).alias("mtime_ns"), F.md5("o_orderpriority").alias("content_hash"))
    before = o.where("k % 5 <> 0")
    now = o.select("rel_path", "size", F.when(c("k") % 11 == 0, c("mtime_ns") + 1).otherwise(c("mtime_ns")).alias("mtime_ns"))
    return spaces.to_hash(before, now, 800_000_000_000_000, 0).select("rel_path", "content_hash")


@query(None)
def snippet_budget(spark, d):
    """The snippets of a search's hits within the budget of characters (a feedback loop, tested against a walk by hand)."""
    hits = found(spark, d, 30).join(table(spark, d, "documents").select(c("doc_id").alias("doc"), "text"), "doc")
    ranked = vector.ranked(hits, "score", "rank").join(hits, "doc")
    return ledgers.within_budget(ranked.select(F.lit("q").alias("query"), "rank", "text", c("doc").cast("string").alias("meta")))


@query(None)
def hybrid_search(spark, d):
    """Words and vectors fused, each side over-fetched."""
    n = lexical.overfetch(10)
    lex = vector.ranked(found(spark, d, n), "score", "lexical_rank")
    vec = vector.ranked(vector.top_k(vectors(spark, d), probe(spark, d), n), "sim", "vector_rank")
    return vector.fuse(lex, vec).orderBy(F.desc("score"), "doc").limit(10)


@query(None)
def content_hashes(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return t.select("doc_id", nested.content_hash(c("content"), F.octet_length("content"), c("doc_id")).alias("hash"))


@query(None)
def mock_embeddings(spark, d):
    return table(spark, d, "documents").select("doc_id", nested.mock_vector(c("text"), 16).alias("embedding"))


@query(f"WITH {VER}, f AS (SELECT min(p_brand) AS root FROM part) SELECT CASE WHEN p_brand = root THEN (SELECT count(DISTINCT p_brand) - 1 FROM part) ELSE 0 END AS place, p_brand AS name, arg_max(version, k) AS version FROM w, f WHERE p_brand = root OR a < 2 GROUP BY p_brand, root")
def solve_versions(spark, d):
    """The first brand needs every other one below 2."""
    v = versions(spark, d)
    first = v.agg(F.min("p_brand").alias("b")).first()["b"]
    releases = v.select(c("p_brand").alias("name"), "version").distinct()
    others = releases.where(c("name") != first).select(c("name").alias("needs")).distinct()
    requires = releases.where(c("name") == first).crossJoin(F.broadcast(others)).select("name", "version", "needs", F.lit("<2.0.0-0").alias("constraint"))  # the broadcast has a row a name
    requests = spark.range(1).select(F.lit(first).alias("name"), F.lit("*").alias("constraint"))
    return dependencies.solve(requests, releases, requires)


SCORED = "c AS (SELECT l_orderkey AS site, l_partkey AS candidate, CASE WHEN lower(l_returnflag) = lower(left(p_brand, 1)) THEN 15 WHEN contains(lower(p_brand), lower(l_returnflag)) THEN 10 ELSE 0 END + CASE WHEN lower(p_brand) = 'brand#' || (l_suppkey % 60) THEN 8 ELSE 0 END + CASE WHEN p_size % 3 = l_suppkey % 3 AND p_size % 2 = l_suppkey % 2 THEN 5 WHEN p_size % 3 = l_suppkey % 3 THEN 4 ELSE 0 END + CASE WHEN p_size % 4 = l_linenumber THEN 5 ELSE 0 END AS points FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {SCORED} SELECT site, arg_min(candidate, (-points, candidate)) AS candidate, max(points)::INT AS points FROM c WHERE points > 0 GROUP BY site")
def scored_calls(spark, d):
    """Each order's line items are candidates of one call; the points come from their parts."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    path = lambda a, b: F.concat(F.lit("d"), a % 3, F.lit("/f"), b % 2, F.lit(".py"))
    score = linker.points(c("l_returnflag"), c("p_brand"), F.concat(F.lit("Brand#"), c("l_suppkey") % 60), path(c("p_size"), c("p_size")), path(c("l_suppkey"), c("l_suppkey")), c("p_size") % 4, c("l_linenumber"))
    return graph.best_candidate(li.select(c("l_orderkey").alias("site"), c("l_partkey").alias("candidate"), score.alias("points")))


@query("WITH t AS (SELECT p_partkey, string_split(repeat(p_name || chr(10), 12), chr(10)) AS ls FROM part) SELECT p_partkey, array_to_string(ls[6:10], chr(10)) AS lines FROM t")
def trimmed_snippets(spark, d):
    """Lines 1 to 13 around line 8, of which the five around it stay."""
    body = F.repeat(F.concat("p_name", F.lit("\n")), F.lit(12))
    return table(spark, d, "part").select("p_partkey", documents.snippet(body, F.lit(8), 7, 5, 5).alias("lines"))


@query(f"WITH {EDGES}, k AS (SELECT count(DISTINCT src || '>' || dst) AS edges FROM e0), n AS (SELECT count(*) AS nodes FROM (SELECT src AS x FROM e0 UNION SELECT dst FROM e0)) SELECT nodes, edges, (SELECT count(*) FROM documents) AS documents FROM k, n")
def workspace_status(spark, d):
    """One row: nodes and edges of the graph, documents of the index."""
    return spaces.workspace_status(edges(spark, d), spark.read.parquet(f"{(path := index(spark, d))}/{scratch.pointer(spark, path)['version']}/statistics"))
