"""More registered queries, in the same registry: resolution, releases, parsers, transcripts' signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text
from ferrule.operators import graph, lexical, parsers, releases, sessions
from ferrule.plans.catalogue import EDGES, EST, ROLL, edges, found, query, steps, table, telemetry

PARTS = "y AS (SELECT p_partkey AS id, p_brand AS name, p_type || '.' || p_brand AS fqn FROM part)"
WANTED = ("Brand#11", "brand#12", "BRAND#13", "STANDARD.Brand#11", "promo.brand#21", "nothing")


@query(
    f"WITH {PARTS}, w AS (SELECT unnest([{', '.join(repr(x) for x in WANTED)}]) AS wanted), m AS (SELECT wanted, id, CASE WHEN fqn = wanted THEN 1 WHEN name = wanted THEN 2 WHEN lower(fqn) = lower(wanted) THEN 3 ELSE 4 END AS tier FROM w JOIN y ON lower(fqn) = lower(wanted) OR lower(name) = lower(wanted)) SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY wanted)"
)
def resolve_names(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.concat("p_type", F.lit("."), "p_brand").alias("fqn"))
    return graph.resolve(p, spark.range(1).select(F.explode(F.array(*map(F.lit, WANTED))).alias("wanted")))


@query("WITH g AS (SELECT p_brand, p_size, min(p_partkey) AS dst FROM part GROUP BY ALL) SELECT p_partkey AS src, dst FROM part JOIN g USING (p_brand, p_size) WHERE p_partkey <> dst")
def type_siblings(spark, d):
    return graph.siblings(table(spark, d, "part").withColumnRenamed("p_partkey", "id"), ["p_brand", "p_size"])


@query("WITH y AS (SELECT p_partkey AS id, p_type AS fqn, p_brand AS stem, p_size % 2 = 0 AS h FROM part), g AS (SELECT stem, fqn, min(id) FILTER (h) AS lh, min(id) FILTER (NOT h) AS lb FROM y GROUP BY ALL) SELECT CASE WHEN h THEN id ELSE lh END AS src, CASE WHEN h THEN lb ELSE id END AS dst FROM y JOIN g USING (stem, fqn) WHERE lh IS NOT NULL AND lb IS NOT NULL AND (h OR id <> lb)")
def header_declares(spark, d):
    path = F.concat(F.lit("src/"), "p_brand", F.when(F.col("p_size") % 2 == 0, ".h").otherwise(".cpp"))
    return graph.declares(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("fqn"), path.alias("file_path")))


@query(f"WITH {EDGES} SELECT DISTINCT p_brand AS \"group\", src FROM e JOIN part ON dst = 'p' || p_partkey")
def overload_callers(spark, d):
    members = table(spark, d, "part").select(F.col("p_brand").alias("group"), F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    return graph.group_callers(edges(spark, d).select("src", "dst"), members)


POINTS = "CASE l_returnflag WHEN 'A' THEN 15 WHEN 'N' THEN 10 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0 END"


@query(f"SELECT l_orderkey AS site, arg_min(l_partkey, (-({POINTS}), l_partkey)) AS candidate, max({POINTS})::INT AS points FROM lineitem WHERE {POINTS} > 0 GROUP BY l_orderkey")
def candidate_scores(spark, d):
    return graph.best_candidate(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("candidate"), F.expr(POINTS).alias("points")))


@query("SELECT l_orderkey AS site, arg_min(l_partkey, (l_linenumber <> 3, l_linenumber, l_partkey)) AS candidate FROM lineitem GROUP BY l_orderkey")
def selected_overload(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("candidate"), F.col("l_linenumber").alias("arity"), F.col("l_linenumber").alias("position"))
    return graph.overload(li, "site", 3)


@query("WITH r AS (SELECT DISTINCT p_brand, 'member' AS what, p_type AS value, NULL::BIGINT AS part FROM part UNION SELECT p_brand, 'base', p_size::VARCHAR, NULL FROM part UNION SELECT p_brand, 'doc', p_name, p_partkey FROM part) SELECT r.*, id FROM r JOIN (SELECT p_brand, min(p_partkey) AS id FROM part GROUP BY p_brand) USING (p_brand)")
def partial_merge(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.array("p_type").alias("members"), F.array(F.col("p_size").cast("string")).alias("bases"), F.col("p_name").alias("doc"))
    return graph.merge_parts(p, ["p_brand"])


@query("WITH r AS (SELECT p_partkey, p_brand, p_size % 5 AS triplet, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey DESC) AS n FROM part) SELECT p_partkey, p_brand, triplet, CASE WHEN n <= CASE WHEN triplet = 2 THEN 3 ELSE 1 END THEN 'kept' ELSE 'pruned' END AS state FROM r")
def release_retention(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 5).alias("triplet"))
    return releases.retained(p, "p_brand", "triplet", "p_partkey", F.col("triplet") == 2)


@query("SELECT o_orderkey, CASE split_part(o_orderpriority, '-', 2) WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 2 END::BIGINT AS urgency FROM orders ORDER BY urgency DESC, o_orderkey LIMIT 10")
def update_urgency(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(F.split("o_orderpriority", "-"), 2).alias("level"))
    return releases.urgent(o, "level", "o_orderkey").select("o_orderkey", "urgency")


@query(
    f"{ROLL}, o AS (SELECT *, row_number() OVER w AS rank, lag(total_score) OVER w AS p, first(total_score) OVER w AS t FROM r WINDOW w AS (ORDER BY total_score DESC, file_path)) SELECT file_path, total_score, hits, top_items, rank FROM o WHERE rank < coalesce((SELECT min(rank) FROM o WHERE rank > 1 AND (total_score < greatest(0.2 * t, CASE WHEN t >= 0.5 THEN 0.5 ELSE 0 END) OR rank > 15 OR (rank > 3 AND (total_score < 0.4 * p OR total_score < 0.15 * t)))), 1000)"
)
def render_cutoff(spark, d):
    hits = lexical.roll_up(found(spark, d, None), limit=50)
    return lexical.render_cut(hits.withColumn("total_score", F.round("total_score", 6)), "total_score", "file_path")


@query(
    r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), k AS (SELECT doc_id, ls, list_filter(ls, lambda x, i: NOT regexp_matches(x, '(?i)licen[sc]e|copyright|spdx-') AND NOT (NOT regexp_matches(x, '[^ \t\r]') AND i > 1 AND NOT regexp_matches(coalesce(ls[greatest(i - 1, 1)], 'x'), '[^ \t\r]'))) AS kept FROM l) SELECT doc_id, md5(array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ls[1:1] END, chr(10))) AS lines FROM k"
)
def line_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(text.useful_lines(F.col("text")), "\n")).alias("lines"))


HEADINGS = "'<[hH]([1-6])[^>]*>([^<]*)<'"


@query(
    f"WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, {HEADINGS}, 1)) AS l, unnest(regexp_extract_all(html, {HEADINGS}, 2)) AS name, generate_subscripts(regexp_extract_all(html, {HEADINGS}, 1), 1)::BIGINT AS n FROM pages) SELECT page_id, n, least(l::BIGINT, 4) AS level, trim(name) AS name FROM m"
)
def html_headings(spark, d):
    return parsers.html_headings(table(spark, d, "pages"))


@query("SELECT event_type, user_id % 5 AS slot, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5))")
def telemetry_modes(spark, d):
    return sessions.modes(telemetry(spark, d).withColumn("slot", F.col("user_id") % 5), "event_type", "slot")


@query(
    "WITH a AS (SELECT *, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM a), s AS (SELECT user_id, r, count(*) FILTER (d >= 5) AS streak, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS growth FROM r GROUP BY user_id, r) SELECT user_id, max(streak) AS streak, round(max(growth), 6) AS growth FROM s GROUP BY user_id"
)
def growth_ratchet(spark, d):
    e = telemetry(spark, d).select("id", "ts", "user_id", F.col("duration").alias("value"))
    return sessions.ratchet(e, "user_id", "value", 5.0).withColumn("growth", F.round("growth", 6))


@query("WITH p AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), n AS (SELECT conv_id, p, count(*) FILTER (role <> 'assistant') AS n FROM p GROUP BY conv_id, p) SELECT conv_id, max(n) AS longest FROM n GROUP BY conv_id")
def longest_reads(spark, d):
    c = F.col("role")
    return sessions.longest_run(table(spark, d, "conversations"), "conv_id", "turn", c != "assistant", c == "assistant")


@query(
    "WITH p AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), n AS (SELECT user_id, p, event_type, count(*) - 1 AS n FROM p WHERE event_type <> 'purchase' GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS repeated FROM n GROUP BY user_id"
)
def repeated_reads(spark, d):
    return sessions.repeated_reads(telemetry(spark, d), "user_id", ["ts", "id"], F.col("event_type") == "purchase", "event_type")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, greatest(10.0, median(value)) AS baseline FROM f WHERE n <= 3 GROUP BY user_id")
def idle_baseline(spark, d):
    return sessions.baseline(telemetry(spark, d).withColumnRenamed("duration", "value"), "user_id", "value", least=10.0)


@query(
    f"WITH s AS (SELECT conv_id, {EST} AS t, turn % 3 = 0 AS w FROM conversations), g AS (SELECT conv_id, sum(t)::BIGINT AS total, least(sum(t), coalesce(sum(t) FILTER (w), 0))::BIGINT AS waste FROM s GROUP BY conv_id) SELECT conv_id, total, waste, CASE WHEN total > 0 THEN round(100 * (total - waste) / total, 1) ELSE 100.0 END AS pct FROM g"
)
def token_efficiency(spark, d):
    return sessions.efficiency(steps(spark, d), "conv_id", "tokens", F.col("turn") % 3 == 0)
