"""Planning documents as rows: decisions, to-do ledgers, roadmaps, and the state of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import header_block
from ferrule.operators.documents import lines

# Fixed formats and words of these documents, in either language.
DECISION = r"^###\s+(\[?(?:P\d+:)?DR-\d+\]?.*)$"
DECISION_ITEM = r"^\s*-\s+\*\*([^*]*DR-\d+[^*]*)\*\*\s*[:：]?\s*(.+)$"
CONCLUSION, ISSUE = r"(?i)(?:結論|conclusion|decision)\W*[:：]\s*(.+)", r"(?i)(?:議題|issue|問題)\W*[:：]\s*(.+)"
TODO = r"^#{2,4}\s+(?:\[[ xX]\]\s*)?\[?TODO-(\d+)\]?\s*[:：]?\s*(.*)$"
LAST_ID = r"(?:最後編號|最後分配編號|last id)\W*[:：]\s*(?:TODO-)?(\d+)"
FIELDS = {"date": r"(?:建立日期|created)\W*[:：]\s*(.+)", "scope": r"(?:目標範疇|scope)\W*[:：]\s*(.+)", "note": r"(?:備忘\S*|note)\W*[:：]\s*(.+)"}


def decisions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line, decision, summary of each decision record: a heading's section, by its conclusion, else its issue, else the heading; or a list's item."""
    rows = lines(docs, id_col, text_col).withColumn("head", F.when(F.col("line").rlike(DECISION), F.trim(F.regexp_extract("line", DECISION, 1))))
    order = Window.partitionBy("doc").orderBy("n")
    rows = rows.withColumn("other", F.col("line").rlike(r"^#{1,3}\s")).withColumn("part", F.sum(F.col("other").cast("int")).over(order))
    said = lambda p: F.min(F.when(F.col("line").rlike(p), F.struct("n", F.trim(F.regexp_extract("line", p, 1)).alias("t"))))
    by = rows.groupBy("doc", "part").agg(F.min(F.when(F.col("head").isNotNull(), F.struct("n", "head"))).alias("h"), said(CONCLUSION).alias("c"), said(ISSUE).alias("i")).where("h IS NOT NULL")
    headed = by.select("doc", F.col("h.n").alias("line"), F.col("h.head").alias("decision"), F.coalesce("c.t", "i.t", "h.head").alias("summary"))
    item = rows.where(F.col("line").rlike(DECISION_ITEM)).select("doc", F.col("n").alias("line"), F.trim(F.regexp_extract("line", DECISION_ITEM, 1)).alias("decision"), F.trim(F.regexp_extract("line", DECISION_ITEM, 2)).alias("summary"))
    return headed.unionByName(item)


def todos(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, todo_id, number, title, date, scope ('general' if none), note, first and last line of each item of a to-do ledger."""
    rows = lines(docs, id_col, text_col).withColumn("start", F.col("line").rlike(TODO))
    rows = rows.withColumn("item", F.sum(F.col("start").cast("int")).over(Window.partitionBy("doc").orderBy("n"))).where("item > 0")
    said = {k: F.max_by(F.when(~F.col("start") & F.col("line").rlike(f"(?i){p}"), F.trim(F.regexp_extract("line", f"(?i){p}", 1))), F.when(~F.col("start") & F.col("line").rlike(f"(?i){p}"), F.col("n"))).alias(k) for k, p in FIELDS.items()}
    head = lambda g: F.max(F.when(F.col("start"), F.regexp_extract("line", TODO, g)))
    out = rows.groupBy("doc", "item").agg(head(1).cast("long").alias("number"), F.trim(head(2)).alias("title"), *said.values(), F.min("n").alias("line"), F.max(F.when(F.trim("line") != "", F.col("n"))).alias("end_line"))
    return out.select("doc", F.concat(F.lit("TODO-"), F.lpad(F.col("number").cast("string"), 2, "0")).alias("todo_id"), "number", "title", F.coalesce("date", F.lit("")).alias("date"), F.regexp_replace(F.coalesce("scope", F.lit("general")), "^`+|`+$", "").alias("scope"), F.coalesce("note", F.lit("")).alias("note"), "line", "end_line")


def next_ids(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and the number that its next item gets: one more than the header's last number and than any item's."""
    head = F.transform(F.slice(F.split(text_col, "\n"), 1, 35), lambda x: F.regexp_extract(x, f"(?i){LAST_ID}", 1))
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.get(F.filter(head, lambda x: x != ""), F.lit(0)).try_cast("long"), F.lit(0)).alias("last"))
    top = items.groupBy("doc").agg(F.max("number").alias("top"))
    return own.join(top, "doc", "left").select("doc", (F.greatest("last", F.coalesce("top", F.lit(0))) + 1).alias("next_id"))


def roadmaps(docs: DataFrame, id_col: str, text_col: str, filename: str) -> DataFrame:
    """id, topic, filename, title (the first heading, else the topic), status, date, scope, whether the header has both status and date, and at most
    three lines of text after the header, cut to 200 characters."""
    ls = F.filter(F.transform(F.split(text_col, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    title = F.get(F.filter(ls, lambda x: x.rlike(r"^#\s+\S")), F.lit(0))
    body = F.slice(F.filter(ls, lambda x: ~x.rlike(r"^(#|>|-{3,}|\||```)")), 1, 3)
    h = header_block(F.col(text_col))
    key = lambda *names: F.coalesce(*(h[n] for n in names))
    topic = F.regexp_replace(filename, r"\.md$", "")
    out = docs.select(F.col(id_col), topic.alias("topic"), F.col(filename).alias("filename"), F.coalesce(F.regexp_replace(title, r"^#\s+", ""), topic).alias("title"), key("status", "狀態").alias("status"), key("date", "日期", "更新日期").alias("date"), key("scope", "目標範疇").alias("scope"), F.left(F.array_join(body, " "), F.lit(200)).alias("summary"))
    return out.withColumn("has_header", F.col("status").isNotNull() & F.col("date").isNotNull())


def plan_files(files: DataFrame, year: str | None = None, month: str | None = None) -> DataFrame:
    """files (rel_path and more) of plans: active ones lie in a dated folder, archived ones in archived/YYYY/MM. With plan, active, year, month.

    Years and months are parts of the path, so a wish for one leaves out folders before anything is read.
    """
    archived = r"^archived/(\d{4})/(\d{2})/([^/]+)"
    active = r"^(\d{4})_(\d{2})_\d{2}_[^/]*"
    old, new = F.col("rel_path").rlike(archived), F.col("rel_path").rlike(active)
    pick = lambda g: F.when(old, F.regexp_extract("rel_path", archived, g)).otherwise(F.regexp_extract("rel_path", active, g))
    out = files.where(old | new).select("*", F.when(old, F.regexp_extract("rel_path", archived, 3)).otherwise(F.regexp_extract("rel_path", r"^([^/]+)", 1)).alias("plan"), new.alias("active"), pick(1).alias("year"), pick(2).alias("month"))
    out = out if year is None else out.where(F.col("year") == year)
    return out if month is None else out.where(F.col("month") == month)


def plan_matrix(documents: DataFrame) -> DataFrame:
    """plan, track, status, progress of plans' documents (plan, phase, kind, status, done, tasks): the status of the least phase that is not
    finished, else of the last; paused where a hand-over lies in it; progress in percent."""
    finished = F.col("status").isin("Completed", "Concluded", "Approved")
    open_ = F.min_by("status", F.when(~finished, F.col("phase")))
    out = documents.groupBy("plan").agg(F.max(F.when(F.col("kind") == "track", F.col("status"))).alias("track"), F.coalesce(open_, F.max_by("status", "phase")).alias("state"), F.max(F.col("kind") == "handoff").alias("paused"), F.sum("done").alias("done"), F.sum("tasks").alias("tasks"))
    state = F.when(F.col("paused") & ~F.col("state").isin("Completed", "Concluded"), F.concat("state", F.lit(" (Paused)"))).otherwise(F.col("state"))
    return out.select("plan", F.coalesce("track", F.lit("unknown")).alias("track"), state.alias("status"), F.when(F.col("tasks") > 0, F.round(100 * F.col("done") / F.col("tasks"), 1)).otherwise(0.0).alias("progress"))


def snippet_lines(used: Column, budget: int = 8000, decay: int = 3500, least_at: int = 6000, none_at: int = 7000, most: int = 30, least: int = 10) -> Column:
    """How many lines a snippet gets after so many characters: most, then evenly fewer, then least, then none."""
    even = F.greatest(F.lit(least), F.bround(most - (used - decay) / (least_at - decay) * (most - least)).cast("int"))
    return F.when((used >= none_at) | (used >= budget), 0).when(used < decay, most).when(used < least_at, even).otherwise(least).cast("int")


def within_budget(hits: DataFrame, query: str = "query", rank: str = "rank", text: str = "text", meta: str = "meta", budget: int = 8000, keep: int = 5) -> DataFrame:
    """hits of each query in order with the lines that its snippet gets: what is shown before decides what comes next, so a query's hits
    (a short ranked list) are walked in one aggregate over an array. The walk ends past the budget, but for the first few."""
    order = F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("rank"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.length(meta), F.lit(0)).alias("meta"))))

    def step(a: Column, x: Column) -> Column:
        n = snippet_lines(a["used"], budget)
        shown = F.slice(F.split(x["text"], "\n"), F.lit(1), n)
        size = F.when(n > 0, F.length(F.array_join(shown, "\n"))).otherwise(0) + x["meta"]
        out = (a["used"] >= budget) & (F.size(a["rows"]) >= keep) | a["over"]
        row = F.struct(x["rank"].alias("rank"), n.alias("lines"), F.when(n > 0, F.array_join(shown, "\n")).otherwise("").alias("snippet"))
        return F.struct(F.when(out, a["used"]).otherwise(a["used"] + size).cast("int").alias("used"), F.when(out, a["rows"]).otherwise(F.concat(a["rows"], F.array(row))).alias("rows"), out.alias("over"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<rank:bigint,lines:int,snippet:string>>").alias("rows"), F.lit(False).alias("over"))
    walked = hits.groupBy(query).agg(order.alias("_h")).select(query, F.aggregate("_h", start, step).alias("_a"))
    return walked.select(query, F.inline("_a.rows"))
