"""Links across files on a small workspace whose answers are known."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import graph, linker
from ferrule.plans import linked

NODES = [
    ("base", "lib/base.py", "Base", "Base", "class", None), ("base.run", "lib/base.py", "run", "Base.run", "method", "base"), ("base.stop", "lib/base.py", "stop", "Base.stop", "method", "base"),
    ("der", "app/derived.py", "Derived", "Derived", "class", None), ("der.go", "app/derived.py", "go", "Derived.go", "method", "der"), ("der.run", "app/derived.py", "run", "Derived.run", "method", "der"),
    ("help", "app/derived.py", "helper", "helper", "function", None), ("util.f", "lib/util/__init__.py", "f", "f", "function", None), ("only", "x/y/z.cs", "Lonely", "Space.Lonely", "class", None),
    ("doc", "docs/readme.md", "Guide", "Guide", "section", None), ("o1", "lib/over.py", "over", "over", "function", None), ("o2", "lib/over.py", "over", "over", "function", None),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(*n, "python") for n in NODES], "id string, file_path string, name string, fqn string, kind string, parent_id string, language string")


def test_imports(spark, nodes):
    asked = {"lib.base.Base": ("lib/base.py", "base", False), "..lib.base": ("lib/base.py", None, False), "../lib/base": ("lib/base.py", None, False), ".derived.helper": ("app/derived.py", "help", False), "lib.util": ("lib/util/__init__.py", None, False), "../lib/base.py#Base.run": ("lib/base.py", "base.run", False), "base.py#run": ("lib/base.py", "base.run", False), "Space::Lonely": ("x/y/z.cs", "only", False), "os.path": (None, None, True), "lib.base.*": ("lib/base.py", None, False), "../../../away": (None, None, True)}
    imports = spark.createDataFrame([("app/derived.py", e) for e in [*asked, "", None]], "file_path string, expr string")
    got = {r.expr: (r.target_file, r.target_id, r.external) for r in linker.resolve_imports(imports, nodes).collect()}
    assert got == asked
    both = linker.resolve_imports(spark.createDataFrame([("app/a.py", "lib.over.over")], "file_path string, expr string"), nodes).collect()
    assert sorted(r.target_id for r in both) == ["o1", "o2"]


def test_resolvers_by_language(spark, nodes):
    linker.register_resolver("made", lambda i, n, f: i.select("file_path", "expr", F.lit("m").alias("target_file"), F.lit(None).cast("string").alias("target_id"), F.lit(False).alias("external")))
    try:
        rows = spark.createDataFrame([("a.mk", "any", "made"), ("app/x.py", "lib.base", "python"), ("app/y.py", "lib.base", None)], "file_path string, expr string, language string")
        assert sorted((r.file_path, r.target_file) for r in linker.resolve_by_language(rows, nodes).collect()) == [("a.mk", "m"), ("app/x.py", "lib/base.py"), ("app/y.py", "lib/base.py")]
    finally:
        linker.RESOLVERS.clear()


def test_four_passes(spark, nodes):
    imports = spark.createDataFrame([("app/derived.py", "lib.base.Base", "Base"), ("app/derived.py", "lib.util", "util"), ("app/derived.py", "lib.over.over", "over")], "file_path string, expr string, alias string")
    inherits = spark.createDataFrame([("der", "app/derived.py", "Base", 0), ("base", "lib/base.py", "Missing", 0)], "src string, file_path string, expr string, position long")
    calls = {"1": ("der.go", "helper"), "2": ("der.go", "self.run"), "3": ("der.go", "self.stop"), "4": ("der.go", "super().run"), "5": ("der.go", "Base.stop"), "6": ("der.go", "util.f"), "7": ("der.go", "Lonely"), "8": ("der.go", "unknown"), "9": ("der.go", "over"), "10": ("der.go", "self.nothing"), "11": ("der", "go"), "12": ("der.go", "run")}
    refs = spark.createDataFrame([(k, s, "app/derived.py", e) for k, (s, e) in calls.items()], "site string, src string, file_path string, expr string")
    links = spark.createDataFrame([("a", "doc", "docs/readme.md", "../lib/base.py#Base"), ("b", "doc", "docs/readme.md", "Derived.go"), ("c", "doc", "docs/readme.md", "helper"), ("d", "doc", "docs/readme.md", "run")], "site string, src string, file_path string, expr string")
    out = linker.link(nodes, imports, inherits, refs, links)
    assert [(r.node, r.base) for r in out["types"].collect()] == [("der", "base")]
    got = {}
    for r in out["calls"].collect():
        got.setdefault(r.site, set()).add((r.dst, r.tier, r.status))
    assert got == {"1": {("help", 1, "resolved")}, "2": {("der.run", 2, "resolved")}, "3": {("base.stop", 2, "resolved")}, "4": {("base.run", 2, "resolved")}, "5": {("base.stop", 3, "resolved")}, "6": {("util.f", 3, "resolved")}, "7": {("only", 4, "resolved")}, "8": {(None, None, "unresolved")}, "9": {("o1", 3, "overload_group"), ("o2", 3, "overload_group")}, "10": {(None, None, "unresolved")}, "11": {("der.go", 1, "resolved")}, "12": {("der.run", 1, "resolved")}}
    assert {r.site: r.dst for r in out["documents"].collect()} == {"a": "base", "b": "der.go", "c": "help"}
    assert {r.node: r.group for r in out["groups"].collect()}["o2"] == "o1"


def test_types_without_cycles(spark):
    def brute(edges):
        bases, out = {}, []
        for node, base in sorted(edges):
            seen, queue = set(), [base]
            while queue:
                at = queue.pop()
                if at not in seen:
                    seen.add(at)
                    queue += bases.get(at, [])
            if node not in seen:
                bases.setdefault(node, []).append(base)
                out.append((node, base))
        return out

    import random

    r = random.Random(4)
    edges = list({(a, b) for a, b in ((r.randint(1, 25), r.randint(1, 25)) for _ in range(60)) if a != b}) + [(100 + i, 101 + i) for i in range(20)]
    got = [tuple(x) for x in graph.type_dag(spark.createDataFrame(edges, "node long, base long")).collect()]
    assert sorted(got) == brute(edges)
    assert graph.type_dag(spark.createDataFrame([], "node long, base long")).collect() == []


def test_ancestors_are_as_deep_as_they_are(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(24)] + [(50, 51), (51, 50)], "node long, base long")
    got = {(r.node, r.ancestor): r.distance for r in graph.ancestors(chain).collect()}
    assert got[0, 24] == 24 and got[50, 50] == 2 and len(got) == 24 * 25 // 2 + 4
    reached = graph.impact(chain.selectExpr("node AS src", "base AS dst"), spark.createDataFrame([(0,)], "node long"), 30, "out")
    assert {r.node: r.layer for r in reached.collect()} == {i: i for i in range(1, 25)}


def test_points(spark):
    cases = [(("Motor", "Motor", None, "a/x.py", "b/y.py", 1, 2), 15), (("m", "Motor", "Motor", "a/x.py", "a/y.py", 2, 2), 27), (("", "T", "T", "a/x.py", "a/x.py", 1, 0), 13), ((None, None, None, "p", "q/r", 0, 1), 0)]
    schema = "r string, t string, c string, tf string, cf string, ar int, n int"
    df = spark.createDataFrame([c for c, _ in cases], schema)
    got = [x[0] for x in df.select(linker.points(*(F.col(c) for c in ("r", "t", "c", "tf", "cf", "ar", "n")))).collect()]
    assert got == [w for _, w in cases]


def test_parts_of_bigger_graphs(spark, sf_dir):
    assert linked.type_tree(spark, sf_dir).count() > 0


def test_named_symbols_are_equi_joins(spark):
    """A file's symbols are not paired with all imports of the file: no join is left with a choice of columns to compare."""
    many = spark.range(3000).selectExpr("concat('f', id) id", "'pkg/big.py' file_path", "concat('f', id) name", "if(id % 2 = 0, concat('f', id), concat('In.f', id)) fqn", "'function' kind", "cast(null as string) parent_id", "'python' language")
    asked = spark.range(3000).selectExpr("concat('app/a', id % 2, '.py') file_path", "concat('pkg.big.f', id) expr")
    out = linker.resolve_imports(asked, many)
    assert " OR " not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.expr, r.target_id) for r in out.collect()} == {(f"pkg.big.f{i}", f"f{i}") for i in range(3000)}


def test_type_hierarchies_send_no_edges_to_the_driver(spark):
    out = graph.type_dag(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, base long"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 3), (4, 1)]


def test_calls_alike_are_looked_up_once(spark, nodes, monkeypatch):
    """Sites of one caller, file and expression make no rows of their own before the end, and an imported name no candidates of tier 4."""
    sizes, plain = {}, linker.scratch.written

    def written(df, label):
        out = plain(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(linker.scratch, "written", written)
    refs = spark.range(600).selectExpr("concat('c', id) site", "'der.go' src", "'app/derived.py' file_path", "if(id % 2 = 0, 'f', 'only') expr")
    targets = spark.createDataFrame([("app/derived.py", "f", "lib/util/__init__.py", "util.f"), ("app/derived.py", "only", "lib/base.py", "base")], "file_path string, alias string, target_file string, target_id string")
    out = linker.resolve_calls(refs, nodes, targets, spark.createDataFrame([], "node string, base string"))
    assert {(r.dst, r.tier, r.status, r.n) for r in out.groupBy("dst", "tier", "status").agg(F.count("*").alias("n")).collect()} == {("util.f", 3, "resolved", 300), ("base", 3, "resolved", 300)}
    assert max(n for label, n in sizes.items() if label != "link-refs") == 2


def test_rows_of_one_site_share_their_candidates(spark, nodes):
    """Also: null sites stay unresolved, and so does what only an unknown symbol fits best; a null file or caller still finds full names."""
    rows = [("a", "der.go", "app/derived.py", "helper"), ("a", "der", "app/derived.py", "Base.run"), ("b", "der.go", "app/derived.py", "Base.run"), ("b", None, None, "Base.stop"), (None, "der.go", "app/derived.py", "helper"), ("c", "der.go", "app/derived.py", "gone"), ("d", None, None, "Base.stop")]
    refs = spark.createDataFrame(rows, "site string, src string, file_path string, expr string")
    targets = spark.createDataFrame([("app/derived.py", "gone", "lib/base.py", "not there")], "file_path string, alias string, target_file string, target_id string")
    out = linker.resolve_calls(refs, nodes, targets, spark.createDataFrame([], "node string, base string"))
    got = sorted(((r.site, r.src, r.dst, r.tier, r.status) for r in out.collect()), key=str)
    want = [("a", s, "help", 1, "resolved") for s in ("der", "der.go")] + [("b", s, d, 4, "ambiguous") for s in (None, "der.go") for d in ("base.run", "base.stop")]
    want += [(None, "der.go", None, None, "unresolved"), ("c", "der.go", None, None, "unresolved"), ("d", None, "base.stop", 4, "resolved")]
    assert got == sorted(want, key=str)
