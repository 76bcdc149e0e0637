"""Versions, dependencies, nested maps, selections, planning documents and snippet budgets, on literals."""

import json

import pytest
from pyspark.sql import functions as F

from ferrule.functions import nested, semver, text
from ferrule.operators import dependencies, ledgers, selection


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("version", "constraint", "want"),
    [("1.2.3", "^1.2.0", True), ("1.2", ">=1.0.0", None), ("01.2.3", ">=1.0.0", None), ("1.2.3.abc", "==1.2.3.abc", True), ("1.2.3.4", "==1.2.3", True), ("1.2.3.4", "==1.2.3.0", False), ("1.2.3-rc.1", "==1.2.3", False), ("1.2.3-rc.1", "<1.2.3", True), ("1.2.3-rc.10", ">1.2.3-rc.9", True), ("1.2.3-rc.1", ">1.2.3-1", True), ("1.2.3.build", "<0.0.1", True), ("1.2.3", "build", False), ("1.2.3", ">=1.0.0, <1.2.3", False), ("1.2.3", "==1.*", True), ("1.2.3", "1.2.*", True), ("0.3.1", "^0.2.0", False), ("1.2.3.7", ">1.2.3.build", True), ("v1.2.3", "*", True)],
)
def test_constraints(spark, version, constraint, want):
    assert value(spark, semver.matches(F.lit(version), constraint)) is want


def test_version_forms(spark):
    forms = {"1.2.3": "1.2.3.0", "V1.2.3.9": "1.2.3.9", "1.2.3-rc.1": "1.2.3-rc.1", "1.2.3.4-rc": "1.2.3.4-rc", "1.2": None, "": None}
    for given, want in forms.items():
        assert value(spark, semver.normalised(F.lit(given))) == want
    bumps = {"major": "2.0.0.0", "minor": "1.3.0.0", "patch": "1.2.4.0", "revision": "1.2.3.1", "1.4.0": "1.4.0.0", "1.0.0": None}
    for part, want in bumps.items():
        assert value(spark, semver.bump(F.lit("1.2.3"), part)) == want
    with pytest.raises(Exception, match="no version"):
        value(spark, semver.sort_key(F.lit("1.2"), strict=True))


def test_dependencies(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    releases = frame([("app", "1.0.0"), ("a", "1.0.0"), ("a", "2.0.0"), ("b", "1.0.0"), ("b", "1.5.0"), ("c", "0.1.0")], "name string, version string")
    requires = frame([("app", "1.0.0", "a", ">=1.0.0"), ("app", "1.0.0", "b", ">=1.0.0"), ("a", "2.0.0", "b", "<1.5.0"), ("b", "1.0.0", "c", "*"), ("b", "1.5.0", "c", "*")], "name string, version string, needs string, constraint string")
    asked = lambda *r: frame(list(r), "name string, constraint string")
    got = dependencies.solve(asked(("app", None)), releases, requires).orderBy("place", "name").collect()
    assert [(r.name, r.version) for r in got] == [("c", "0.1.0"), ("b", "1.0.0"), ("a", "2.0.0"), ("app", "1.0.0")]
    with pytest.raises(dependencies.Unsolvable, match="no version of b"):
        dependencies.solve(asked(("app", "*"), ("b", ">1.2.0"), ("a", "==2.0.0")), releases, requires)
    with pytest.raises(dependencies.Unsolvable, match="circle"):
        dependencies.solve(asked(("b", "*")), releases, requires.unionByName(frame([("c", "0.1.0", "b", "*")], requires.schema)))
    assert dependencies.solve(asked(), releases, requires).collect() == []


def test_nested_maps(spark):
    data = F.lit('{"a": {"b": 1, "l": [1, 2]}, "x": true}')
    assert value(spark, nested.get_path(data, "a.b")) == "1" and value(spark, nested.get_path(data, "a.z", "none")) == "none"
    assert json.loads(value(spark, nested.set_path(data, "a.c.d", F.lit("[3]"))))["a"]["c"] == {"d": [3]}
    assert json.loads(value(spark, nested.delete_path(data, "a.b"))) == {"a": {"l": [1, 2]}, "x": True}
    over = F.lit('{"a": {"l": [2, 3], "n": null}}')
    lists = {"merge": [2, 3], "extend": [1, 2, 2, 3], "unique": [1, 2, 3]}
    for strategy, want in lists.items():
        assert json.loads(value(spark, nested.deep_merge(data, over, strategy))) == {"a": {"b": 1, "l": want, "n": None}, "x": True}
    assert json.loads(value(spark, nested.deep_merge(data, over, "replace"))) == {"a": {"l": [2, 3], "n": None}}
    assert value(spark, nested.deep_merge(F.lit("no json"), over)) is None
    assert nested.origins({"one": {"a": {"b": 1}, "c": 2}, "two": {"a": {"b": 3, "d": 4}}}) == {"a.b": "two", "c": "one", "a.d": "two"}
    assert nested.distinct_list([1, True, "1"], [1.0, 1, "1"]) == [1, True, "1", 1.0]
    schema = {"name": "str", "n?": "int", "tags": "list[str]", "kind": "enum(a|b)", "more?": "map[float]?", "own?": "Point"}
    assert value(spark, nested.checked(F.lit('{"name": "x", "tags": ["a"], "kind": "a", "more": null, "own": {"x": 1}}'), schema, {"Point": {"x": "int"}})) == []
    assert value(spark, nested.checked(F.lit('{"name": 1, "n": true, "tags": ["a", 2], "kind": "c", "z": 1}'), schema)) == ["$.z: is unknown", "$.name: str is due", "$.n: int is due", "$.tags[1]: str is due", "$.kind: none of a|b"]
    assert value(spark, nested.checked(F.lit("{"), schema)) == ["$: no JSON"]
    for bad in (True, 0, -1, float("inf"), "2"):
        with pytest.raises(ValueError, match="weight"):
            nested.weights({"a": bad})
    assert nested.weights({"a": 2}) == {"a": 2.0}


def test_small_functions(spark):
    deep = "A" + "<B" * 9 + ">" * 9 + "::get"
    given = {"Map<K, List<Set<X>>>::get": "Map::get", deep: "A::get", "a < b": "a < b", "x > y": "x > y", "f<a>(b<c": "f(b<c", "": ""}
    for g, want in given.items():
        assert value(spark, text.strip_generics(F.lit(g))) == want
    assert value(spark, nested.filled(F.lit("{a}-{b}-{c}"), {"a": F.lit(1), "b": F.lit(None)})) == "1--{c}"
    rows = spark.createDataFrame([("k", "en", "Hi"), ("k", "zh", "嗨"), ("m", "en", "Bye"), ("n", "fr", "Non")], "key string, locale string, text string")
    assert {r.key: r.text for r in nested.translated(rows, ["zh", "en"]).collect()} == {"k": "嗨", "m": "Bye"}
    spans = spark.createDataFrame([((2, 9), (3, 5), "aé漢b")], "a struct<start:int,end:int>, b struct<start:int,end:int>, t string")
    assert spans.select(nested.contains("a", "b"), nested.contains("b", "a"), nested.bounding("a", "b").alias("u"), nested.byte_slice(F.col("t"), "b")).first()[:] == (True, False, (2, 9), "漢"[:0] + spans.select(F.substring(F.encode("t", "UTF-8"), 4, 2).cast("string")).first()[0])
    assert [nested.ignore_line(p, "mods/a") for p in ("*.log", "/build/", "x/y", "!keep", "# no", "")] == ["/mods/a/**/*.log", "/mods/a/build/", "/mods/a/x/y", "!/mods/a/**/keep", None, None]
    v = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "t string").select(nested.mock_vector(F.col("t"), 8).alias("v")).collect()
    assert v[0] == v[1] and abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and v[2].v == [1.0] + [0.0] * 7 == v[3].v
    import hashlib

    assert value(spark, nested.blake2b(F.lit(b"abc"))) == hashlib.blake2b(b"abc", digest_size=16).hexdigest()
    ids = spark.createDataFrame([("i", None, "f(a)"), ("i", None, "f(b)"), ("j", "i", "x")], "id string, parent_id string, signature string")
    got = {r.signature: r.id for r in nested.overload_ids(ids).collect()}
    assert got["f(a)"] == "i" and got["f(b)"] not in ("i", "j") and got["x"] == "j"
    assert value(spark, text.tokenize_unique(F.lit("beta alpha beta Alpha gamma"))) == ["beta", "alpha", "gamma"]


NODES = "id string, parent_id string, name string, fqn string, file_path string, kind string, kinds array<string>, visibility string, is_static boolean, language string, spaces array<string>, start_byte long, facets map<string,string>"


def node(id_, parent, kind, visibility="public", static=False, path="a.py", language="python", spaces=("src",), facets=None):
    return (id_, parent, id_, id_, path, kind, [kind], visibility, static, language, list(spaces), 0, facets or {})


def test_choosing_symbols(spark):
    rows = [node("C", None, "class"), node("m", "C", "method", "private"), node("s", "C", "method", static=True), node("D", None, "class"), node("E", "D", "class"), node("f", "E", "field", facets={"async": "yes, no"}), node("doc", None, "doc_section", path="r.md", language="markdown", spaces=())]
    df = spark.createDataFrame(rows, NODES)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(selection.select_nodes(df, kinds=["method"], visibility="non-private")) == ["s"]
    assert ids(selection.select_nodes(df, spaces=["project"])) == ["doc"] and ids(selection.select_nodes(df, facets={"async": "no"})) == ["f"]
    assert ids(selection.select_nodes(df, extensions=["markdown"])) == ["doc"]
    assert ids(selection.outline(df, visibility="private")) == ["C", "m"] and ids(selection.outline(df, kinds=["field"])) == ["D", "E", "f"]
    assert ids(selection.outline(df, static=True)) == ["C", "s"] and ids(selection.outline(df, types_only=True)) == ["C", "D", "E"]
    assert ids(selection.topical(df)) == ["C", "D", "E", "f", "m", "s"] and ids(selection.topical(df, ["md"])) == ["doc"]
    assert [r.id for r in selection.best_matches(df, "C").collect()][0] == "C"


def test_changes_of_many_spaces(spark):
    rows = [("a", "x", "added", 3), ("b", "x", "deleted", 5), ("a", "y", "added", 3), ("b", "y", "added", 5), ("a", "z", "touched", 3), ("b", "w", "deleted", 5)]
    df = spark.createDataFrame(rows, "space string, rel_path string, change string, to_gen long")
    assert {r.rel_path: r.change for r in selection.merged_changes(df).collect()} == {"x": "modified", "y": "added", "w": "deleted"}
    assert sorted(r.rel_path for r in selection.dirty(df).collect()) == ["x", "y"]
    assert tuple(selection.head(df).first()) == (5, 2)
    lists = spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, ["b", "c", "a"])], "key string, n long, v array<string>")
    assert [r.value for r in selection.appended(lists, "key", "n", "v").orderBy("n", "i").collect()] == ["a", "b", "c"]


def test_planning_documents(spark):
    doc = "> Last ID: TODO-07\n\n## TODO-02: Fix it\n- created: 2024-01-02\n- scope: `core`\n- note: soon\n\n## [ ] TODO-05 Other\ntext\n\n"
    notes = "# T\n### DR-01: Use A\nissue: which\n**Conclusion**: A it is\n## next\nissue: no\n### [P01:DR-02] B\nissue: what\n### DR-03: plain\n- **DR-04**：short one\n"
    road = "# Big plan\n> Status: Ready\n> Date: 2024-05-06\n\nFirst line.\nSecond.\n- third\nfourth\n"
    df = spark.createDataFrame([(1, doc), (2, notes), (3, ""), (4, None)], "id long, text string")
    items = ledgers.todos(df, "id", "text")
    assert [tuple(r) for r in items.orderBy("number").collect()] == [(1, "TODO-02", 2, "Fix it", "2024-01-02", "core", "soon", 3, 6), (1, "TODO-05", 5, "Other", "", "general", "", 8, 9)]
    assert {r.doc: r.next_id for r in ledgers.next_ids(df, items, "id", "text").collect()} == {1: 8, 2: 1, 3: 1, 4: 1}
    assert [(r.decision, r.summary) for r in ledgers.decisions(df, "id", "text").orderBy("line").collect()] == [("DR-01: Use A", "A it is"), ("[P01:DR-02] B", "what"), ("DR-03: plain", "DR-03: plain"), ("DR-04", "short one")]
    assert [r.todo_id for r in selection.todos_in_scope(items, "CORE").collect()] == ["TODO-02"]
    maps = ledgers.roadmaps(spark.createDataFrame([(1, "big.md", road), (2, "big2.md", "text"), (3, "x.md", None)], "id long, f string, text string"), "id", "text", "f")
    got = {r.topic: r for r in maps.collect()}
    assert (got["big"].title, got["big"].status, got["big"].date, got["big"].summary, got["big"].has_header) == ("Big plan", "Ready", "2024-05-06", "First line. Second. - third", True)
    assert got["big2"].title == "big2" and not got["big2"].has_header
    assert [r.topic for r in selection.named(maps, "big").collect()] == ["big"] and [r.topic for r in selection.named(maps, "bi").collect()] == ["big", "big2"]
    files = spark.createDataFrame([("2024_05_06_1200_x/p1.md",), ("archived/2023/02/2023_02_01_y/p1.md",), ("notes.md",)], "rel_path string")
    assert {(r.plan, r.active, r.year, r.month) for r in ledgers.plan_files(files).collect()} == {("2024_05_06_1200_x", True, "2024", "05"), ("2023_02_01_y", False, "2023", "02")}
    assert ledgers.plan_files(files, "2023").count() == 1
    docs = spark.createDataFrame([("p", 1, "spec", "Approved", 3, 3), ("p", 2, "test", "Draft", 1, 3), ("p", 9, "handoff", "x", 0, 0), ("p", 0, "track", "Fast", 0, 0), ("q", 1, "spec", "Completed", 2, 2)], "plan string, phase long, kind string, status string, done long, tasks long")
    docs = docs.where("kind <> 'track' OR true")
    got = {r.plan: (r.track, r.status, r.progress) for r in ledgers.plan_matrix(docs).collect()}
    assert got["q"] == ("unknown", "Completed", 100.0) and got["p"][0] == "Fast" and got["p"][1].endswith("(Paused)") and got["p"][2] == 66.7


def test_snippet_budget(spark):
    want = {0: 30, 3499: 30, 3500: 30, 4750: 20, 5999: 10, 6000: 10, 6999: 10, 7000: 0, 9000: 0}
    for used, n in want.items():
        assert value(spark, ledgers.snippet_lines(F.lit(used))) == n
    body = "\n".join("x" * 99 for _ in range(40))
    hits = spark.createDataFrame([("q", i, body, "m" * 50) for i in range(1, 12)] + [("r", 1, None, None)], "query string, rank long, text string, meta string")
    got = {(r["query"], r["rank"]): r["lines"] for r in ledgers.within_budget(hits).collect()}
    used, lines_, n = 0, [], 0
    for _ in range(11):
        if used >= 8000 and n >= 5:
            break
        k = 0 if used >= 7000 else 30 if used < 3500 else max(10, round(30 - (used - 3500) / 2500 * 20)) if used < 6000 else 10
        lines_.append(k)
        used, n = used + 50 + (k * 100 - 1 if k else 0), n + 1
    assert [got["q", i + 1] for i in range(len(lines_))] == lines_ and len(got) == len(lines_) + 1 and got["r", 1] == 30


def test_segments_bound_a_task_and_shuffle_no_postings(spark, tmp_path, monkeypatch):
    """The index has more segments for more text, each sorted by term, a document in one of them; its rows are grouped where their texts are."""
    import re

    from ferrule.operators import lexical

    monkeypatch.setattr(lexical, "SEGMENT", 2_000, raising=False)
    docs = spark.range(200).selectExpr("id", "concat('n', id) name", "'' signature", "'' members", "concat_ws(' ', transform(sequence(1, 40), i -> concat('t', (id * i) % 97))) docstring", "'en' language", "'s' space", "'f' file_path")
    rows = lexical.entries(docs, 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "hashpartitioning(doc" in plan
    assert rows.rdd.getNumPartitions() > 8
    lexical.write_index(docs, path := str(tmp_path / "index"), parts=2)
    at = spark.read.parquet(f"{path}/1/postings").selectExpr("input_file_name() file", "doc", "term", "f_name", "f_docstring")
    assert at.groupBy("doc").agg({"file": "approx_count_distinct"}).where("`approx_count_distinct(file)` > 1").isEmpty()
    want = {}
    for i in range(200):
        for k in range(1, 41):
            want.setdefault((i, f"t{i * k % 97}"), [0, 0])[1] += 1
        want.setdefault((i, f"n{i}"), [0, 0])[0] += 1
    assert {(r.doc, r.term): [r.f_name, r.f_docstring] for r in at.collect()} == want


def test_postings_are_counted_where_their_texts_are(spark):
    """One exchange, of documents by id; repeated ids are one document."""
    from ferrule.operators import lexical

    docs = spark.createDataFrame([(1, "Ab", "ab cd cd"), (1, "Ab", "cd"), (2, None, "cd"), (3, "", None)], "id long, name string, docstring string").selectExpr("*", "'' signature", "'' members")
    rows = lexical.postings(docs)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.doc, r.term, r.f_name, r.f_docstring) for r in rows.collect()) == [(1, "ab", 2, 1), (1, "cd", 0, 3), (2, "cd", 0, 1)]
