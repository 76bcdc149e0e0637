"""Column expressions on literals whose results are known."""

import pytest
from pyspark.sql import functions as F

from ferrule.functions import semver, text
from ferrule.operators import documents, parsers, rules


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("getUserName", ["get", "user", "name", "getusername"]),
        ("HTTPServerError", ["http", "server", "error", "httpservererror"]),
        ("snake_case_name", ["snake", "case", "name", "snakecasename"]),
        ("the class of return", []),
        ("电机控制", ["电", "机", "控", "制", "电机", "机控", "控制"]),
        ("的PID控制器", ["pid", "控", "制", "器", "控制", "制器"]),
        ("Éau", ["au"]),
        ("_x_ plain", ["x", "plain"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, given, want):
    assert value(spark, text.tokenize(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("f(a, b: Dict[str, int], c='x,y')", ["a", "b: Dict[str, int]", "c='x,y'"]), ("m(self, /, a, *)", ["a"]), ("g()", []), ("h(std::map<int, int> m)", ["std::map<int, int> m"])])
def test_parameters(spark, given, want):
    assert value(spark, text.parameters(F.lit(given))) == want


def test_small_text_functions(spark):
    assert value(spark, text.strip_generics(F.lit("Map<String, List<Set<X>>>::get"))) == "Map::get"
    assert value(spark, F.parse_json(text.plain_json(F.lit('{"a": "//,} no", /* x */ "b": [1, 2,], // end\n}'))).cast("string")) == '{"a":"//,} no","b":[1,2]}'
    assert value(spark, text.table_cells(F.lit(r"| a | b \| c | d |"))) == ["a", "b | c", "d"]
    assert value(spark, text.useful_lines(F.lit("MIT License\na\n\n\n\nb"))) == ["a", "", "b"]
    assert value(spark, text.useful_lines(F.lit("MIT License"))) == ["MIT License"]
    assert value(spark, text.requirement_ids(F.lit("fr-1 `FR-2` ~~FR-3~~ NFR-4 FR-1"))) == ["FR-1", "NFR-4"]
    assert value(spark, text.error_hint(F.lit("ok\nValueError: bad\nerror: x"))) == "ValueError: bad"


@pytest.mark.parametrize(("version", "constraint", "want"), [("1.2.3", "^=1.2.0", True), ("2.0.0", "^=1.2.0", False), ("1.2.3.9", "==1.2.3", True), ("1.2.0-rc.1", ">=1.2.0", False), ("1.2.build", "==9.9.9", True), ("1.2.5", "==1.2.*", True), ("1.3.0", "==1.2.*", False), ("0.2.1", "~=0.1.0", False)])
def test_version_constraints(spark, version, constraint, want):
    assert value(spark, semver.matches(F.lit(version), constraint)) is want


@pytest.mark.parametrize(("path", "include", "exclude", "want"), [("a/b/c.py", ["*.py"], [], True), ("a/b/c.py", ["*.py"], ["b"], False), ("a/b/c.txt", ["*.py"], [], False), ("x/y/z", ["x/**"], [], True), ("x", ["**/x"], [], True), ("a/q/b", ["a/**/b"], [], True), ("any", [], [], True)])
def test_rules(spark, path, include, exclude, want):
    assert value(spark, rules.decide(F.lit(path), include, exclude)["matched"]) is want


def test_parsers(spark):
    css = spark.createDataFrame([(1, ".a { }\n#b {\n@keyframes spin {\n--c: 1px;\n  color: red;\n.a:hover {")], "id long, text string")
    assert sorted((r.line, r.kind, r.name) for r in parsers.css_symbols(css, "id", "text").collect()) == [(1, "class", "a"), (2, "struct", "b"), (3, "function", "spin"), (4, "variable", "--c"), (6, "class", "a")]
    md = spark.createDataFrame([(1, "# T\n[x](a.md#L1) [y](http://z)\n```\n[n](no.md)\n```\n## U ##\ntext")], "id long, text string")
    assert [(r.label, r.target) for r in parsers.markdown_links(md, "id", "text").collect()] == [("x", "a.md#L1")]
    assert sorted((r.n, r.level, r.name, r.end_line) for r in documents.sections(md, "id", "text").collect()) == [(1, 1, "T", 5), (6, 2, "U", 7)]
    code = "class A:\n    '''doc'''\n    def f(self):\n        def g(): pass\n"
    py = spark.createDataFrame([("a.py", code), ("bad.py", "def ("), ("none.py", None)], "file_path string, text string")
    assert sorted((r.fqn, r.kind, r.line, r.end_line) for r in parsers.python_symbols(py).collect()) == [("A", "class", 1, 4), ("A.f", "method", 3, 4), ("A.f.g", "function", 4, 4)]


def test_constraints_read_a_version_once(spark):
    """One constraint for all rows says what it says as a column, and neither repeats the parsing of the version for each comparison."""
    versions = ["1.2.3", "1.2.3-rc.1", "0.3.0", "2.0.0", "1.2.3.build", "build", "1.2.3.4", "bad", None, " v1.2.0 "]
    asked = ["^=1.2.0, <2.0.0-rc.0, !=1.3.1", "==1.2.*", "", "*", "build", ">=bad", "<1.0.0,>=bad", " , >0.1.0,", "~=0.3.0", None]
    v = spark.createDataFrame([(x,) for x in versions], "v string")
    plans = []
    for c in asked:
        one = v.select("v", semver.matches(F.col("v"), c).alias("one"), semver.holds(F.col("v"), F.lit(c).cast("string")).alias("other"))
        assert all(r.one == r.other for r in one.collect()), c
        plans.append(v.where(semver.matches(F.col("v"), c))._jdf.queryExecution().optimizedPlan().toString())
    assert max(p.count("regexp_extract(trim(") for p in plans) < 40
