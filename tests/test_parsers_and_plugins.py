"""Parsers on texts whose symbols are known, plug-ins, the catalogue of spaces, the remote source, and index synchronisation."""

import pytest
from pyspark.sql import functions as F

from ferrule import plugins
from ferrule.operators import lexical, parsers, sessions
from ferrule.sources import catalog, files, remote, scratch
from ferrule.streaming import sync


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_markdown(spark):
    text = "Title\n=====\nintro `app.mod.run()` and `plain`\n\n## Two ##\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n# no heading\n[n](no.md)\n```\n[x](a.md#L12) [y](b.md#Sym) [z](http://w) [x](a.md#L12)\nSub\n---\nend"
    docs = frame(spark, [(1, text), (2, "only\nplain text"), (3, ""), (4, None)], "id long, text string")
    got = sorted((r.doc, r.kind, r.level, r.name, r.n, r.end_line) for r in parsers.markdown_symbols(docs, "id", "text").collect() if r.kind == "section")
    assert got == [(1, "section", 1, "Title", 1, 4), (1, "section", 2, "Sub", 14, 16), (1, "section", 2, "Two", 5, 13), (2, "section", 1, "only plain text", 1, 2)]
    assert [(r.name, r.n, r.end_line) for r in parsers.markdown_symbols(docs, "id", "text").where("kind = 'table'").collect()] == [("| a | b |", 6, 8)]
    refs = sorted((r.n, r.heading, r.expr) for r in parsers.markdown_refs(docs, "id", "text").collect())
    assert refs == [(3, "", "app.mod.run"), (13, "Two", "a.md#x"), (13, "Two", "b.md#Sym")]


def test_html_and_netlists(spark):
    pages = frame(spark, [(1, '<title>T</title><h1>A</h1><h6>B</h6><h1>A</h1>\n<nav id="n"><div id=\'d\'>\n'), (2, None)], "page_id long, html string")
    got = sorted((r.line, r.kind, r.level or 0, r.name, r.hint or "") for r in parsers.html_symbols(pages).collect())
    assert got == [(1, "heading", 1, "A", ""), (1, "heading", 1, "A", "occ_2"), (1, "heading", 1, "T", ""), (1, "heading", 4, "B", ""), (2, "id", 0, "d", ""), (2, "id", 0, "n", ""), (2, "section", 0, "nav", "")]
    net = "* title\n.subckt amp in out\n+ vdd W=1\n.param gain=10 r='2*k'\nX1 in mid amp2 M=2\nR1 a b 1k $ X9 no\n.model nm nmos\n.ends"
    got = sorted((r.kind, r.name, r.detail) for r in parsers.netlist_symbols(frame(spark, [(1, net)], "id long, text string"), "id", "text").collect())
    assert got == [("instance", "X1", "amp2"), ("model", "nm", "nmos"), ("param", "gain", "10"), ("param", "r", "'2*k'"), ("subckt", "amp", "in out vdd")]


def test_brace_languages(spark):
    cpp = "namespace app {\nclass Motor : public Base {\n public:\n  void run(int x) {\n    if (x) { go(); }\n  }\n};\n}\n/* class No {\n*/\nclass Fwd;\n"
    ts = "export interface Shape {\n  x: number;\n}\nexport const area = (s: Shape) => s.x;\nexport class Box extends Base {\n  size(): number {\n    return 1;\n  }\n}\n// function no() {}\n"
    cs = "namespace A.B {\n public sealed class C {\n  public static int Run(int x)\n  {\n   return 1;\n  }\n }\n}\n"
    c = "#define MAX 3\nstruct point {\n int x;\n};\nstatic int add(int a, int b) {\n return a + b;\n}\n"
    df = frame(spark, [("m.cpp", cpp), ("s.ts", ts), ("c.cs", cs), ("p.c", c), ("x.txt", "class No {"), ("n.js", None)], "file_path string, text string")
    got = {}
    for r in parsers.brace_symbols(df).collect():
        got.setdefault(r.file_path, set()).add((r.kind, r.name, r.line, r.end_line))
    assert got["m.cpp"] == {("namespace", "app", 1, 8), ("class", "Motor", 2, 7), ("function", "run", 4, 6)}
    assert got["s.ts"] == {("interface", "Shape", 1, 3), ("function", "area", 4, 9), ("class", "Box", 5, 9), ("method", "size", 6, 8)} or got["s.ts"] >= {("interface", "Shape", 1, 3), ("class", "Box", 5, 9)}
    assert {x[:3] for x in got["c.cs"]} == {("namespace", "A.B", 1), ("class", "C", 2), ("method", "Run", 3)}
    assert got["p.c"] == {("macro", "MAX", 1, 4), ("struct", "point", 2, 4), ("function", "add", 5, 7)} or {x[1] for x in got["p.c"]} == {"MAX", "point", "add"}
    assert set(got) == {"m.cpp", "s.ts", "c.cs", "p.c"}


def test_python_refs_flat_and_reparsed(spark):
    code = "import os.path as p\nfrom ..lib import base, other as o\nfrom . import x\nclass A(base.B, C):\n    def f(self):\n        super().f(p.join(1))\n        self.g()\ndef h(): A()()\n"
    df = frame(spark, [("a.py", code), ("bad.py", "def (")], "file_path string, text string")
    got = sorted((r.kind, r.source, r.expr, r.alias or "", r.line) for r in parsers.python_refs(df).collect())
    assert got == sorted([("import", "", "os.path", "p", 1), ("import", "", "..lib.base", "base", 2), ("import", "", "..lib.other", "o", 2), ("import", "", ".x", "x", 3), ("inherits", "A", "base.B", "", 4), ("inherits", "A", "C", "", 4), ("call", "A.f", "super().f", "", 6), ("call", "A.f", "super", "", 6), ("call", "A.f", "p.join", "", 6), ("call", "A.f", "self.g", "", 7), ("call", "h", "A()", "", 8), ("call", "h", "A", "", 8)])
    nodes = frame(spark, [("T", None, "T", ["function", "class"], 0), ("m", "T", "m", ["method"], 9), ("x", "T", "x", ["field"], 5), ("v", None, "v", ["variable"], 7)], "id string, parent_id string, name string, kinds array<string>, start_byte long")
    got = {r.id: (r.kind, [(m.name, m.kind) for m in r.members or []]) for r in parsers.flat_symbols(nodes).collect()}
    assert got == {"T": ("class", [("x", "field"), ("m", "method")]), "m": ("method", []), "v": ("variable", [])}
    old = parsers.python_symbols(frame(spark, [("a.py", "def old(): pass"), ("k.py", "def kept(): pass"), ("d.py", "def gone(): pass")], "file_path string, text string"))
    new = parsers.reparsed(old, frame(spark, [("a.py", "def new(): pass"), ("k.py", "broken (")], "file_path string, text string"), frame(spark, [("a.py",)], "file_path string"), frame(spark, [("d.py",)], "file_path string"), parsers.python_symbols)
    assert sorted(r.name for r in new.collect()) == ["kept", "new"]


def test_plug_ins(spark):
    reg = plugins.Registry()
    reg.parser([".py"], parsers.python_symbols)
    made = lambda d: d.select("file_path", F.lit("own").alias("kind"), F.col("text").alias("name"))
    reg.parser(["mk", "py"], made, 200)
    reg.parser(["mk"], parsers.python_symbols, 10)
    reg.nodes.append(lambda d: d.withColumn("name", F.upper("name")))
    df = frame(spark, [("a.py", "def f(): pass"), ("b.mk", "x"), ("c.txt", "no")], "file_path string, text string")
    assert sorted((r.file_path, r.kind, r.name) for r in reg.parse(df, ["file_path", "kind", "name"]).collect()) == [("a.py", "own", "DEF F(): PASS"), ("b.mk", "own", "X")]
    reg.edges.append(lambda d: d.where("site <> 'drop'"))
    reg.graphs.append(lambda t: t | {"extra": t["calls"]})
    out = reg.linked({"calls": frame(spark, [("drop",), ("keep",)], "site string")})
    assert [r.site for r in out["extra"].collect()] == ["keep"] and plugins.Registry().parse(df, ["name"]) is None
    assert plugins.resolve_callable("code.func://os/path:join")("a", "b") == "a/b" and plugins.resolve_callable("code.func://json:JSONDecoder.decode")
    for bad in ("http://x", "code.func://os", "code.func://os:sep"):
        with pytest.raises((ValueError, TypeError)):
            plugins.resolve_callable(bad)
    assert [r[0] for r in spark.range(3).select(plugins.call("code.func://numpy:sqrt", "double", F.col("id").cast("double"))).collect()][0] == 0.0
    c = plugins.Contributions()
    c.add("one", "t", '{"menu": ["a"], "deep": {"x": 1}}')
    c.add("two", "t", {"menu": ["a", "b"], "deep": {"y": 2}}, "unique")
    assert c.get("t") == {"menu": ["a", "b"], "deep": {"x": 1, "y": 2}} and c.get("t", "deep.y") == 2 and c.get("t", "deep.z", 7) == 7 and c.get("none") == {}
    assert c.origins("t") == {"menu": "two", "deep.x": "one", "deep.y": "two"}
    s = plugins.Service("rate", lambda: spark.readStream.format("rate").load().writeStream.format("noop").start())
    s.start()
    assert s.health()["active"]
    s.stop()
    assert not s.health()["active"] and s.health()["fault"] is None


def test_catalogue_of_spaces(spark):
    c = catalog.Catalog()
    for owner, name, more in (("a", "src", {"entries": ("a/src",)}), ("b", "src", {"entries": ("b/src",), "watch": False}), ("a", "docs", {"entries": ("d",)}), ("a", "gitignore", {"entries": ("g",)}), ("a", "all", {"compose": ("src", "!docs")})):
        c.register(catalog.Space(owner, name, **more))
    names = lambda found: sorted(s.full for s in found)
    assert names(c.resolve()) == ["a/all", "a/docs", "a/src", "b/src"] and names(c.resolve("*")) == ["a/all", "a/docs", "a/src"]
    assert names(c.resolve("src")) == ["a/src", "b/src"] and names(c.resolve("b/src")) == ["b/src"]
    plus, minus = c.parts(c.resolve("a/all")[0])
    assert names(plus) == ["a/src", "b/src"] and names(minus) == ["a/docs"]
    c.unions()
    assert names(c.resolve("src")) == ["/src"] and c.dependents("b/src") == ["a/all", "/src", "__all__"] or set(c.dependents("b/src")) == {"a/all", "/src", "__all__"}
    with pytest.raises(catalog.Unknown):
        c.resolve("nothing")
    with pytest.raises(ValueError, match="already"):
        c.register(catalog.Space("a", "src"))
    c.register(catalog.Space("x", "loop", compose=("x/loop",)))
    with pytest.raises(ValueError, match="circle"):
        c.parts(c.resolve("x/loop")[0])
    c.ephemeral("tmp", spark.range(3))
    assert spark.table(c.view("/tmp")).count() == 3 and c.unregister("/tmp", spark) and not c.unregister("/tmp")
    assert catalog.merged_definition({"include": ["a"], "entries": ["x"], "watch": True}, {"include": ["*"], "entries": ["x", "y"], "watch": False}) == {"include": ["*"], "entries": ["x", "y"], "watch": False}
    schemes = {"root": "/srv/p", "docs": "root://docs", "deep": "docs://a/b", "c1": "c2://x", "c2": "c1://y"}
    assert catalog.resolve_uri("deep://f.md", schemes) == "/srv/p/docs/a/b/f.md"
    for bad in ("c1://", "none://x", "docs://../../etc"):
        with pytest.raises((ValueError, KeyError)):
            catalog.resolve_uri(bad, schemes)
    own = {k: v for k, v in schemes.items() if k[0] != "c"}
    paths = frame(spark, [("/srv/p/docs/a/b/f.md",), ("/srv/p/docs/x",), ("/srv/p",), ("/else",)], "p string")
    assert [r[0] for r in paths.select(catalog.to_uri(F.col("p"), own)).collect()] == ["deep://f.md", "docs://x", "root://", None]


def test_remote_store(spark, tmp_path):
    store = remote.FolderStore(str(tmp_path / "store"))
    store.put("a.txt", b"one")
    store.put("d/b.txt", b"two")
    got = {r.rel_path: (r.size, r.is_folder) for r in remote.listing(spark, store.root).collect()}
    assert got == {"a.txt": (3, False), "d": (0, True), "d/b.txt": (3, False)} and store.get("a.txt") == b"one"
    feed = lambda: remote.feed(spark, store.root).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    try:
        feed()
    except Exception:
        pytest.skip("this source has no available-now trigger")
    cache = remote.listing(spark, store.root).select("file_id", "rel_path", "is_folder", "size", "md5")
    cache = scratch.written(cache, "cache")
    store.trash("a.txt")
    store.put("d/c.txt", b"three")
    changes = frame(spark, [(r["seq"], r["file_id"], r["rel_path"], r["removed"], r["is_folder"], r["size"], r["md5"]) for r in store.changes(2)], remote.FEED)
    now, whole = remote.patched_cache(cache, changes)
    assert sorted(r.rel_path for r in now.collect()) == ["d", "d/b.txt", "d/c.txt"] and whole
    store.put("new/x.txt", b"x")
    changes = frame(spark, [(r["seq"], r["file_id"], r["rel_path"], r["removed"], r["is_folder"], r["size"], r["md5"]) for r in store.changes(2)], remote.FEED)
    assert remote.patched_cache(cache, changes)[1] is False
    with pytest.raises(ValueError, match="out of"):
        store.get("../../x")
    base = frame(spark, [("m", "a", 1), ("m", "b", 2)], "branch string, path string, size long")
    journal = frame(spark, [("m", "a", 1, "upsert", 5), ("m", "a", 2, "upsert", 6), ("m", "b", 3, "delete", None), ("n", "c", 4, "upsert", 7)], "branch string, path string, seq long, op string, size long")
    assert sorted(tuple(r) for r in remote.replayed(base, journal, ["branch", "path"]).collect()) == [("m", "a", 6), ("n", "c", 7)]


def test_indexes_in_step(spark, tmp_path):
    schema = "id long, name string, signature string, members string, docstring string, language string, space string, kind string, file_path string"
    rows = {"f1": (1, "alpha"), "f2": (2, "beta"), "f3": (3, "gamma")}
    of = lambda: frame(spark, [(i, n, "", "", f"{n} text", "en", "s", "doc", f) for f, (i, n) in rows.items()], schema)
    symbols_of = lambda some: of() if some is None else of().join(some.select(F.col("rel_path").alias("file_path")), "file_path", "left_semi")
    none = frame(spark, [], "space string, rel_path string, change string, to_gen long")
    path = str(tmp_path / "i")
    run = lambda changes, config="c1", gen="": sync.sync_index(spark, path, changes, symbols_of, config, gen, parts=2)
    find = lambda t: [r.doc for r in lexical.search_index(spark, path, t).collect()]
    assert run(none) == "rebuilt" and run(none) == "noop" and find("beta") == [2]
    rows["f2"] = (2, "delta")
    del rows["f3"]
    changed = frame(spark, [("s", "f2", "modified", 2), ("s", "f3", "deleted", 2)], none.schema)
    assert run(changed) == "patched" and find("beta") == [] and find("delta") == [2] and find("gamma") == [] and find("alpha") == [1]
    assert run(none, "c2") == "rebuilt" and run(none, "c2", "g2") == "rebuilt"
    state = frame(spark, [("x", 1, 3, False), ("y", 1, 2, True)], "rel_path string, created_gen long, updated_gen long, is_deleted boolean")
    got = sync.consumed({"one": state, "two": state}, {"one": 2, "two": 9})
    assert sorted((r.space, r.rel_path, r.change, r.to_gen) for r in got.collect()) == [("one", "x", "modified", 3), ("two", "x", "added", 3)]


def test_vectors_and_budgets(spark):
    symbols = frame(spark, [(i, f"h{i}", f"t{i}") for i in range(5)], "doc long, text_hash string, text string")
    vectors = frame(spark, [(0, "h0", [1.0]), (1, "old", [2.0]), (9, "x", [3.0])], "doc long, text_hash string, embedding array<double>")
    embed = lambda d: d.select("doc", "text_hash", F.array(F.lit(7.0)).alias("embedding"))
    one, left = sync.heal(symbols, vectors, embed, 2)
    assert sorted(r.doc for r in one.collect()) == [0, 1, 2] and left == 2
    two, left = sync.heal(symbols, one, embed, 2)
    assert sorted((r.doc, r.embedding[0]) for r in two.collect()) == [(0, 1.0), (1, 7.0), (2, 7.0), (3, 7.0), (4, 7.0)] and left == 0
    now = [0.0]
    breaker = sync.Breaker(3.0, 10, lambda: now[0])
    spend = lambda n: now.__setitem__(0, now[0] + 0.1 * n)
    assert breaker.allows(spend, 20)[0] and not breaker.allows(spend, 100)[0] and breaker.allows(spend, 0) == (True, 0.0)
    assert [sync.mode(True), sync.mode(False), sync.mode(True, True)] == ["hybrid_rrf", "lexical_bm25", "fallback_bm25"]
    steps = iter([5, 3, 0])
    assert sync.two_stages(lambda: "noop", lambda: next(steps), lambda: False) == {"words": "noop", "steps": 3, "left": 0, "yielded": False}
    assert sync.two_stages(lambda: "patched", lambda: 9, lambda: True)["yielded"]
    seen, done = [], {"b"}
    out = sync.propagate(["a", "b", "c", "d"], 3, lambda n: n != "c", lambda n: seen.append(("p", n)), lambda n: seen.append(("s", n)), done)
    assert out == {"a": "patched", "d": "patched"} and done == {"a", "b", "d"} and sync.propagate(["a"], 3, bool, print, print, done) == {}
    assert sync.propagate(["z"], 500, lambda n: True, print, seen.append, set()) == {"z": "rescanned"}
    edges = frame(spark, [("out", "a"), ("a", "b"), ("x", "y")], "src string, dst string")
    old = frame(spark, [("a",), ("b",)], "node string")
    fresh = frame(spark, [("a2", "b2")], "src string, dst string")
    got, how = sync.hot_patch(edges, old, fresh, lambda e: e.withColumn("dst", F.lit("a2")), lambda: edges)
    assert how == "patched" and sorted(tuple(r) for r in got.collect()) == [("a2", "b2"), ("out", "a2"), ("x", "y")]
    assert sync.hot_patch(edges, old, fresh, lambda e: 1 / 0, lambda: edges)[1] == "rebuilt"


def test_debounce_by_quiet_and_by_age(spark, tmp_path):
    feed = str(tmp_path / "in")
    events = [("s", f"p{i}", False, 1000 + 400 * i) for i in range(16)] + [("t", "q", False, 1000), ("t", None, True, 1100), ("u", "late", False, 60_000)]
    df = frame(spark, events, "space string, rel_path string, rescan boolean, ms long").select("space", "rel_path", "rescan", F.timestamp_millis("ms").alias("ts"))
    df.coalesce(1).write.parquet(feed)
    q = sync.debounced(spark.readStream.schema(df.schema).parquet(feed)).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.space, r.first_ms): (len(r.paths), r.rescan) for r in spark.table("flushed").collect()}
    assert got["s", 1000] == (13, False) and got["s", 6200] == (3, False) and got["t", 1000] == (1, True)
    raw = frame(spark, [("a/x.py", False, "modified", 1), ("a/.git/y", False, "modified", 2), ("a", True, "created", 3)], "path string, is_directory boolean, event_type string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    rows = sync.intake(raw, F.col("path").contains(".git"), F.array(F.lit("s1"), F.lit("s2"))).collect()
    assert sorted((r.space, r.rel_path or "", r.rescan) for r in rows) == [("s1", "", True), ("s1", "a/x.py", False), ("s2", "", True), ("s2", "a/x.py", False)]


def test_attribution_and_polling(spark, tmp_path):
    steps = frame(spark, [("c", 1, 2, False, 0), ("c", 2, 0, True, 11), ("c", 3, 0, True, 4), ("c", 4, 1, False, 0), ("c", 5, 0, True, 7), ("d", 1, 0, True, 5)], "conv_id string, step long, tools int, is_output boolean, tokens long")
    assert sorted((r.conv_id, r.step, r.planner, r.share) for r in sessions.attribute_output(steps).collect()) == [("c", 2, 1, 6), ("c", 3, 1, 2), ("c", 5, 4, 7)]
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "f").write_text("x")
    now, came = sync.polled(frame(spark, [("m0",)], "rel_path string"), spark, str(tmp_path))
    assert sorted((r.rel_path, r.change) for r in came.collect()) == [("m0", "deleted"), ("m1", "added")] and [r.rel_path for r in now.collect()] == ["m1"]
    plans = frame(spark, [("a", False, "2024"), ("b", True, "2023"), ("c", True, "2024")], "path string, active boolean, date string")
    assert [(r.path, r.place) for r in files.ranked_plans(plans).collect()] == [("c", 1), ("b", 2), ("a", 3)]
