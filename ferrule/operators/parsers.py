"""Symbols of texts as rows: HTML, CSS, Markdown, netlists and brace languages with column expressions, Python with its own parser in
Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.documents import lines


def matches(text: Column, pattern: str, *groups: int) -> Column:
    """An array of structs (n, g1, g2, ...): each match's number, from 1, and groups."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return F.transform(F.arrays_zip(*(f.alias(f"g{i + 1}") for i, f in enumerate(found))), lambda x, i: F.struct((i + 1).cast("long").alias("n"), *(x[f"g{k + 1}"].alias(f"g{k + 1}") for k in range(len(groups)))))


def html_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, n, level, name of each heading; h5 and h6 are level 4. No shuffle."""
    found = F.explode(matches(F.col(html_col), r"<[hH]([1-6])[^>]*>([^<]*)<", 1, 2)).alias("x")
    return pages.select(id_col, found).select(id_col, F.col("x.n").alias("n"), F.least(F.col("x.g1").cast("long"), F.lit(4)).alias("level"), F.trim("x.g2").alias("name"))


def html_ids(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, n, tag, name of each element with an id."""
    found = F.explode(matches(F.col(html_col), r"""<([a-zA-Z][a-zA-Z0-9]*)[^>]* id=["']([^"']+)["']""", 1, 2)).alias("x")
    return pages.select(id_col, found).select(id_col, F.col("x.n").alias("n"), F.lower("x.g1").alias("tag"), F.col("x.g2").alias("name"))


#: What a style sheet's line declares: the first of these that fits.
CSS = (("function", r"^\s*@keyframes\s+([\w-]+)"), ("class", r"^\s*[^{};:]*\.([A-Za-z_][\w-]*)[^{};]*\{"), ("struct", r"^\s*[^{};:]*#([A-Za-z_][\w-]*)[^{};]*\{"), ("variable", r"^\s*(--[\w-]+|\$[\w-]+|@[\w-]+)\s*:"))


def css_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line, kind, name: at most one symbol a line; names repeated in a line's kind are told apart by their lines."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    kind = name = F.lit(None).cast("string")
    for k, pattern in reversed(CSS):
        kind, name = F.when(F.col("line").rlike(pattern), k).otherwise(kind), F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)).otherwise(name)
    return lines.select(id_col, (F.col("n") + 1).cast("long").alias("line"), kind.alias("kind"), name.alias("name")).where("kind IS NOT NULL")


def markdown_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, label, target of each link outside fenced code; web and mail addresses are left out, each once."""
    body = F.regexp_replace(F.col(text_col), r"(?s)(```|~~~).*?(\1|\z)", "")
    found = F.explode(matches(body, r"\[([^\]\n]*)\]\(([^)\s]+)\)", 1, 2)).alias("x")
    out = docs.select(id_col, found).select(id_col, F.col("x.g1").alias("label"), F.col("x.g2").alias("target"))
    return out.where(~F.col("target").rlike("(?i)^(https?:|mailto:)")).distinct()


def python_symbols(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """file_path, kind, name, fqn, line, end_line, docstring of classes, functions and methods; a file that doesn't parse has none.

    Python's own parser runs in Arrow batches, a file at a time; there is no built-in equivalent.
    """

    def run(batches: Iterator) -> Iterator:
        import ast

        import pyarrow as pa

        def walk(node, path, scope, inside, rows):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside else "function"
                    rows.append((path, kind, child.name, ".".join([*scope, child.name]), child.lineno, child.end_lineno, ast.get_docstring(child) or ""))
                    walk(child, path, [*scope, child.name], kind == "class", rows)
                else:
                    walk(child, path, scope, inside, rows)

        for batch in batches:
            rows: list = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    walk(ast.parse(text or ""), path, [], False, rows)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_path", "kind", "name", "fqn", "line", "end_line", "docstring"])

    return files.select(path_col, text_col).mapInArrow(run, "file_path string, kind string, name string, fqn string, line long, end_line long, docstring string")


def python_refs(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """file_path, kind ('call', 'import' or 'inherits'), source (full name of what holds it, '' for the module), expr, alias (of imports), line."""

    def run(batches: Iterator) -> Iterator:
        import ast

        import pyarrow as pa

        def dotted(node) -> str:
            if isinstance(node, ast.Name):
                return node.id
            if isinstance(node, ast.Attribute):
                return f"{dotted(node.value)}.{node.attr}"
            if isinstance(node, ast.Call):
                return f"{dotted(node.func)}()"
            return ast.unparse(node)

        def walk(node, path, scope, rows):
            for child in ast.iter_child_nodes(node):
                source = ".".join(scope)
                if isinstance(child, ast.Import):
                    rows += [(path, "import", source, a.name, a.asname or a.name, child.lineno) for a in child.names]
                elif isinstance(child, ast.ImportFrom):
                    base = "." * child.level + (child.module or "")
                    rows += [(path, "import", source, f"{base}{'' if base.endswith('.') or not base else '.'}{a.name}", a.asname or a.name, child.lineno) for a in child.names]
                elif isinstance(child, ast.Call):
                    rows.append((path, "call", source, dotted(child.func), None, child.lineno))
                if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    inner = [*scope, child.name]
                    if isinstance(child, ast.ClassDef):
                        rows += [(path, "inherits", ".".join(inner), dotted(b), None, child.lineno) for b in child.bases]
                    walk(child, path, inner, rows)
                else:
                    walk(child, path, scope, rows)

        for batch in batches:
            rows: list = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: list = []
                try:
                    walk(ast.parse(text or ""), path, [], own)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += own
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_path", "kind", "source", "expr", "alias", "line"])

    return files.select(path_col, text_col).mapInArrow(run, "file_path string, kind string, source string, expr string, alias string, line long")


def markdown_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n, line, last, code: the lines of documents, and whether each is fenced code or a fence."""
    rows = lines(docs, id_col, text_col)
    order = Window.partitionBy("doc").orderBy("n")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    return rows.withColumn("code", fence | (F.coalesce(F.sum(fence.cast("int")).over(order), F.lit(0)) % 2 == 1)).withColumn("last", F.max("n").over(Window.partitionBy("doc")))


def markdown_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, kind ('section' or 'table'), level, name, n, end_line of a Markdown text.

    Headings are lines that begin with # or that are underlined by three or more = or -; a section ends before the next heading of any
    level. Two or more lines of cells in a row are a table, named by its first. A text without headings is one section, named by its
    first 60 characters.
    """
    order = Window.partitionBy("doc").orderBy("n")
    rows = markdown_lines(docs, id_col, text_col)
    after = F.lead("line").over(order)
    atx = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*$"
    plain = (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*([#>|]|[-*+] |\d+\. |={3,}\s*$|-{3,}\s*$)")
    under = plain & F.coalesce(after.rlike(r"^(={3,}|-{3,})\s*$") & ~F.lead("code").over(order), F.lit(False))
    level = F.when(F.col("line").rlike(atx), F.length(F.regexp_extract("line", atx, 1))).when(under, F.when(after.startswith("="), 1).otherwise(2))
    rows = rows.withColumn("level", F.when(~F.col("code"), level).cast("long")).withColumn("cells", ~F.col("code") & F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    rows = rows.withColumn("t", F.col("n") - F.sum(F.col("cells").cast("int")).over(order))
    heads = rows.where("level IS NOT NULL").select("doc", F.lit("section").alias("kind"), "level", F.trim(F.when(F.col("line").rlike(atx), F.regexp_extract("line", atx, 2)).otherwise(F.col("line"))).alias("name"), "n", F.coalesce(F.lead("n").over(order) - 1, F.col("last")).alias("end_line"))
    tables = rows.where("cells").groupBy("doc", "t").agg(F.min_by("line", "n").alias("name"), F.min("n").alias("n"), F.max("n").alias("end_line")).where("end_line > n")
    tables = tables.select("doc", F.lit("table").alias("kind"), F.lit(None).cast("long").alias("level"), F.trim("name").alias("name"), "n", "end_line")
    bare = docs.where(F.trim(text_col) != "").select(F.col(id_col).alias("doc"), F.trim(F.left(F.regexp_replace(F.trim(text_col), r"\s+", " "), F.lit(60))).alias("name"), F.size(F.split(text_col, "\n")).cast("long").alias("end_line")).join(heads.select("doc").distinct(), "doc", "left_anti")
    return heads.unionByName(tables).unionByName(bare.select("doc", F.lit("section").alias("kind"), F.lit(1).cast("long").alias("level"), "name", F.lit(1).cast("long").alias("n"), "end_line"))


def markdown_refs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, heading (that it stands under, '' for none), expr, n of links and of dotted names in back-ticks, outside fenced code; each once a line.

    Web and mail addresses are left out; an anchor that is a line number gives way to the link's label.
    """
    order = Window.partitionBy("doc").orderBy("n")
    rows = markdown_lines(docs, id_col, text_col).where("NOT code")
    head = F.when(F.col("line").rlike(r"^#{1,6}[ \t]+\S"), F.trim(F.regexp_replace("line", r"^#+|#+$", "")))
    rows = rows.withColumn("heading", F.coalesce(F.last(head, ignorenulls=True).over(order), F.lit("")))
    link = matches(F.col("line"), r"\[([^\]\n]*)\]\(([^)\s]+)\)", 1, 2)
    target = lambda x: F.when(x["g2"].rlike(r"#L\d+(-L?\d+)?$"), F.concat(F.regexp_replace(x["g2"], r"#.*$", ""), F.when(x["g1"] != "", F.concat(F.lit("#"), x["g1"])).otherwise(F.lit("")))).otherwise(x["g2"])
    links = F.transform(F.filter(link, lambda x: ~x["g2"].rlike("(?i)^(https?:|mailto:)")), target)
    ticks = F.regexp_extract_all("line", F.lit(r"`([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)+)(?:\(\))?`"), F.lit(1))
    return rows.select("doc", "heading", "n", F.explode(F.array_distinct(F.concat(links, ticks))).alias("expr"))


def html_symbols(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, line, kind, level, name, hint of title, headings, elements with ids and semantic sections; what repeats a name of its kind and line has
    hint occ_2, occ_3 and so on."""
    rows = lines(pages, id_col, html_col).withColumnRenamed("doc", id_col)
    head = F.transform(matches(F.col("line"), r"<(title|TITLE|[hH][1-6])(?:\s[^>]*)?>([^<]*)<", 1, 2), lambda x: F.struct(F.lit("heading").alias("kind"), F.when(F.lower(x["g1"]) == "title", 1).otherwise(F.least(F.substring(x["g1"], 2, 1).try_cast("int"), F.lit(4))).alias("level"), F.trim(x["g2"]).alias("name")))
    ids = F.transform(matches(F.col("line"), r"""<[a-zA-Z][a-zA-Z0-9]*[^>]* id=["']([^"']+)["']""", 1), lambda x: F.struct(F.lit("id").alias("kind"), F.lit(None).cast("int").alias("level"), x["g1"].alias("name")))
    parts = F.transform(matches(F.col("line"), r"<(nav|main|section|article|aside|header|footer)[\s>]", 1), lambda x: F.struct(F.lit("section").alias("kind"), F.lit(None).cast("int").alias("level"), x["g1"].alias("name")))
    out = rows.select(id_col, "n", F.posexplode(F.concat(head, ids, parts)).alias("i", "x")).select(id_col, F.col("n").alias("line"), "i", "x.*")
    nth = F.row_number().over(Window.partitionBy(id_col, "line", "kind", "name").orderBy("i"))
    return out.withColumn("hint", F.when(nth > 1, F.concat(F.lit("occ_"), nth.cast("string")))).drop("i")


def netlist_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n, kind, name, detail of a netlist: subcircuits (with ports), their parameters, models, and instances (name, the subcircuit they call).
    A line that begins with + goes on with the one before; * and $ begin comments."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text_col, r"\r", ""), r"(?m)^\*.*$", ""), r"\$.*", "")
    whole = docs.select(id_col, F.regexp_replace(text, r"\n\+", " ").alias("_t"))
    rows = lines(whole, id_col, "_t").withColumn("w", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))
    first = F.lower(F.get("w", F.lit(0)))
    plain = F.filter("w", lambda x: ~x.contains("="))
    kind = F.when(first == ".subckt", "subckt").when(first == ".model", "model").when(first == ".param", "param").when(first.rlike("^x"), "instance")
    found = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    named = found.where("kind <> 'param'").select("doc", "n", "kind", F.when(F.col("kind") == "instance", F.get("w", F.lit(0))).otherwise(F.get("w", F.lit(1))).alias("name"), F.when(F.col("kind") == "instance", F.element_at(plain, -1)).when(F.col("kind") == "model", F.get("w", F.lit(2))).otherwise(F.array_join(F.slice(plain, F.lit(3), F.greatest(F.size(plain) - 2, F.lit(0))), " ")).alias("detail"))
    params = found.where("kind = 'param'").select("doc", "n", "kind", F.explode(matches(F.col("line"), r"(\w+)\s*=\s*('[^']*'|\{[^}]*\}|[^\s]+)", 1, 2)).alias("x")).select("doc", "n", "kind", F.col("x.g1").alias("name"), F.col("x.g2").alias("detail"))
    return named.unionByName(params)


#: What a line of a brace language declares: the first of its language's patterns that fits. Bodies are not parsed.
BRACES = {
    "c": (("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)"), ("macro", r"^\s*#define\s+(\w+)"), ("function", r"^(?!\s*(?:return|else|if|while|for|switch)\b)[\w\s\*]+?[\s\*](\w+)\s*\([^;{]*\)\s*\{?\s*$")),
    "cpp": (("class", r"^\s*(?:template\s*<.*>\s*)?class\s+(\w+)(?!.*;\s*$)"), ("struct", r"^\s*struct\s+(\w+)(?!.*;\s*$)"), ("namespace", r"^\s*namespace\s+([\w:]+)"), ("enum", r"^\s*enum\s+(?:class\s+)?(\w+)"), ("function", r"^(?!\s*(?:return|else|if|while|for|switch)\b)[\w\s\*&:<>,~]*?[\s\*&]([\w:~]+)\s*\([^;{]*\)\s*(?:const|override|noexcept|\s)*\{?\s*$")),
    "csharp": (("namespace", r"^\s*namespace\s+([\w.]+)"), ("class", r"^\s*(?:[a-z]+\s+)*(?:class|record)\s+(\w+)"), ("interface", r"^\s*(?:[a-z]+\s+)*interface\s+(\w+)"), ("struct", r"^\s*(?:[a-z]+\s+)*struct\s+(\w+)"), ("enum", r"^\s*(?:[a-z]+\s+)*enum\s+(\w+)"), ("method", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],.?]+\s+(\w+)\s*\(")),
    "javascript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", r"^\s+(?!(?:if|for|while|switch|catch|return|function)\b)(?:async\s+|static\s+|get\s+|set\s+)*(\w+)\s*\([^;]*\)\s*\{\s*$")),
}
BRACES["typescript"] = (("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), *BRACES["javascript"])
LANGUAGES = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript"}


def brace_symbols(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """file_path, language, kind, name, line, end_line of declarations, one a line; end_line by counting braces. Comments and strings are blanked first,
    so what stands in them is no symbol and no brace. Declarations over several lines show by their first."""
    ext = F.lower(F.regexp_extract(path_col, r"\.([^./]+)$", 1))
    language = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        language = F.when(ext == e, name).otherwise(language)
    bare = F.regexp_replace(F.col(text_col), r"//[^\n]*", "")
    bare = F.regexp_replace(bare, r'"(?:\\.|[^"\\\n])*"', '""')
    bare = F.aggregate(F.regexp_extract_all(bare, F.lit(r"(?s)/\*.*?\*/"), F.lit(0)), bare, lambda a, x: F.replace(a, x, F.regexp_replace(x, r"[^\n]", "")))
    own = files.select(F.col(path_col).alias("file_path"), language.alias("language"), bare.alias("_b")).where("language IS NOT NULL")
    rows = own.select("file_path", "language", F.posexplode(F.split("_b", "\n")).alias("i", "line"))
    order = Window.partitionBy("file_path").orderBy("i")
    opened = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    rows = rows.withColumn("depth", F.sum(opened).over(order)).withColumn("before", F.col("depth") - opened)
    kind = name = F.lit(None).cast("string")
    for lang, patterns in BRACES.items():
        for k, pattern in reversed(patterns):
            test = (F.col("language") == lang) & F.col("line").rlike(pattern)
            kind, name = F.when(test, k).otherwise(kind), F.when(test, F.regexp_extract("line", pattern, 1)).otherwise(name)
    rows = rows.withColumns({"kind": kind, "name": name})
    heads = rows.where("kind IS NOT NULL").select("file_path", "language", "kind", "name", (F.col("i") + 1).cast("long").alias("line"), "before")
    ends = rows.where("line LIKE '%}%'").select(F.col("file_path").alias("_f"), (F.col("i") + 1).cast("long").alias("_n"), "depth")
    close = heads.join(ends, (F.col("_f") == F.col("file_path")) & (F.col("_n") >= F.col("line")) & (F.col("depth") <= F.col("before")), "left")
    return close.groupBy("file_path", "language", "kind", "name", "line").agg(F.coalesce(F.min("_n"), F.col("line")).alias("end_line"))


#: A node of several kinds shows by the first of these groups that it has one of.
PRIORITY = (("class", "struct", "interface", "enum", "trait", "type"), ("function", "method", "constructor"), ("field", "property", "variable"))


def flat_symbols(nodes: DataFrame) -> DataFrame:
    """id, name, kind, parent_id, members of nodes (id, parent_id, name, kinds, start_byte): fields of a type are members of it and no rows of their own.
    members are the names in order of place, with their kinds; a type's own fields only, so they are few."""
    kind = F.get("kinds", F.lit(0))
    for kinds in reversed(PRIORITY):
        kind = F.when(F.size(F.array_intersect("kinds", F.array(*map(F.lit, kinds)))) > 0, F.get(F.array_intersect("kinds", F.array(*map(F.lit, kinds))), F.lit(0))).otherwise(kind)
    named = nodes.withColumn("kind", kind)
    types = named.where(F.col("kind").isin(*PRIORITY[0])).select(F.col("id").alias("_t"))
    field = named.where(F.col("kind").isin(*PRIORITY[2])).join(types, F.col("parent_id") == F.col("_t"), "left_semi")
    child = named.where(F.col("kind").isin(*PRIORITY[1])).join(types, F.col("parent_id") == F.col("_t"), "left_semi")
    members = field.unionByName(child).groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_byte", "name", "kind"))), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"))).alias("members"))
    rest = named.join(field.select("id"), "id", "left_anti")
    return rest.join(members.withColumnRenamed("parent_id", "_p"), F.col("id") == F.col("_p"), "left").select("id", "name", "kind", "parent_id", "members")


def reparsed(symbols: DataFrame, files: DataFrame, dirty: DataFrame, gone: DataFrame, parse) -> DataFrame:
    """symbols (file_path and more) after dirty files (file_path) were parsed anew by parse and those that are gone left. Others are not read."""
    touched = dirty.select("file_path").unionByName(gone.select("file_path")).distinct()
    fresh = parse(files.join(dirty.select("file_path").distinct(), "file_path", "left_semi"))
    return symbols.join(touched, "file_path", "left_anti").unionByName(fresh.select(*symbols.columns))
