"""Column expressions over text; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search results depend on just these words, character ranges and boundaries.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "class", "cls", "def", "false", "for", "from", "import",
    "in", "is", "it", "none", "not", "null", "of", "on", "or", "return", "self", "that", "the", "this", "to", "true", "void",
    "was", "were", "with",
    "的", "了", "在", "是", "與", "及", "或", "將", "對", "於", "中", "為", "以",
)
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{ffef}"
CAMEL = ((r"([A-Z]+)([A-Z][a-z])", "$1_$2"), (r"([a-z0-9])([A-Z])", "$1_$2"))


def _stop(c: Column) -> Column:
    return c.isin(*STOP_WORDS)


def _marked(word: Column) -> Column:
    """ASCII letters in lower case, an underscore at each camel-case boundary."""
    for pattern, to in CAMEL:
        word = F.regexp_replace(word, pattern, to)
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def identifier_parts(word: Column) -> Column:
    """Lower-case parts of an identifier: split at anything but letters and digits, and at camel-case boundaries."""
    return F.filter(F.split(_marked(word), "[^a-z0-9]+"), lambda p: p != "")


def marked(text: Column) -> Column:
    """The first half of tokenize: what terms() takes. A column of its own, it is computed once a row."""
    return _marked(F.coalesce(text, F.lit("")))


def tokenize(text: Column) -> Column:
    """Search terms in order: identifier parts without stop words, then the joined word if it had several parts; of an
    ideograph run its characters without stop words and then all its pairs. Null gives an empty array.

    Boundaries are marked in the whole text at once. Texts of plain words, which most are, need just a split and a filter.
    """
    return terms(marked(text))


def terms(marked: Column) -> Column:
    """The second half of tokenize."""
    segments = F.regexp_extract_all(marked, F.lit(f"[{CJK}]+|[a-z0-9_]+"), F.lit(0))
    none = F.array().cast("array<string>")

    def word(s: Column) -> Column:
        kept = F.filter(F.split(s, "_+"), lambda p: (p != "") & ~_stop(p))
        whole = F.replace(s, F.lit("_"), F.lit(""))
        several = s.rlike("[a-z0-9]_+[a-z0-9]")
        return F.when(several & ~_stop(whole) & ~F.array_contains(kept, whole), F.concat(kept, F.array(whole))).otherwise(kept)

    def run(s: Column) -> Column:
        chars = F.filter(F.split(s, ""), lambda c: (c != "") & ~_stop(c))
        pairs = F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(none)
        return F.concat(chars, pairs)

    mixed = F.flatten(F.transform(segments, lambda s: F.when(s >= "{", run(s)).when(s.contains("_"), word(s)).when(_stop(s), none).otherwise(F.array(s))))
    return F.when(marked.rlike(f"[_{CJK}]"), mixed).otherwise(F.filter(segments, lambda s: ~_stop(s)))


def tokenize_unique(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def embedding_text(text: Column) -> Column:
    """Camel case split by spaces, separators to spaces, lower case, spaces squeezed."""
    out = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(out, r"[_./\\]", " ")), r"\s+", " "))


def summary(doc: Column, signature: Column, most: int = 120) -> Column:
    first = F.trim(F.element_at(F.split(F.coalesce(doc, F.lit("")), "\n"), 1))
    line = F.when(first != "", first).otherwise(F.coalesce(signature, F.lit("")))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("..."))).otherwise(line)


def extensions(listed: Column) -> Column:
    """'|' or ',' separated extensions: trimmed, lower case, without leading dots, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(listed, r"[|,]"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^\.+", "")), lambda x: x != ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def tokens_estimate(text: Column) -> Column:
    """A quarter of the ASCII characters and 0.65 of the others, half to even, at least 1; 0 for none."""
    n = F.length(text)
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(ascii_ / 4 + (n - ascii_) * 0.65).cast("int"))).cast("long")


def clean_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"\s+", " "))


def error_hint(text: Column, most: int = 200) -> Column:
    """The first line with an error word, else the first that is not blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.filter(lines, lambda x: F.lower(x).rlike(r"\[error\]|error:|\[fail\]|\[blocker\]|exception|traceback"))
    return F.left(F.coalesce(F.get(marked, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), F.lit(most))


def requirement_ids(text: Column, pattern: str = r"(?i)\b(?:FR|EC|NFR)-\d+\b") -> Column:
    """Distinct upper-case ids outside fenced code, comments, struck and inline-code passages."""
    for strip in (r"(?s)(`{3,}).*?\1", r"(?s)<!--.*?-->", r"(?s)~~.*?~~", r"(`+)(?!`)(?:[^\r\n]*?[^`\r\n])?\1(?!`)"):
        text = F.regexp_replace(text, strip, "")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.upper(x)))


def header_block(text: Column, most: int = 35) -> Column:
    """A map of '> key: value' lines (either colon) among the first lines; keys lower case, the last of a key wins."""
    lines = F.transform(F.slice(F.split(text, r"\r?\n"), 1, most), lambda x: F.trim(F.regexp_replace(x, "　", " ")))
    pairs = F.transform(F.filter(lines, lambda x: x.rlike("^>+[^:：]*[:：]")), lambda x: F.regexp_replace(x, "^>+", ""))
    return F.map_from_entries(
        F.aggregate(
            pairs,
            F.array().cast("array<struct<key:string,value:string>>"),
            lambda a, x: F.concat(
                F.filter(a, lambda e: e["key"] != F.lower(F.trim(F.regexp_extract(x, "^([^:：]*)[:：]", 1)))),
                F.array(F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:：]*)[:：]", 1))).alias("key"), F.trim(F.regexp_extract(x, "^[^:：]*[:：](.*)$", 1)).alias("value"))),
            ),
        )
    )


def symbol_id(space: Column, path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.sha1(F.concat_ws(":", space, path, name, kind, line.cast("string")))


def canonical_id(path: Column, fqn: Column, overload: Column) -> Column:
    return F.concat(path, F.lit("::"), fqn, F.when(F.coalesce(overload, F.lit("")) != "", F.concat(F.lit("("), overload, F.lit(")"))).otherwise(F.lit("")))


def iso_time(text: Column) -> Column:
    """ISO 8601 to a timestamp; without a zone it is the session's (UTC); null if malformed."""
    return F.try_to_timestamp(text)


def embedding_input(name: Column, signature: Column, doc: Column, most: int = 400) -> Column:
    """Name, signature and the first characters of the text, those that there are."""
    return F.trim(F.concat_ws(" ", name, signature, F.left(doc, F.lit(most))))


def strip_generics(text: Column) -> Column:
    """Without balanced <...>, at any depth, in one pass over the characters: what is inside the outermost brackets goes.

    A bracket without its counterpart stays, with what is around it.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        # The text at each depth so far; a closing bracket drops the deepest, which began with its opening one.
        n = F.size(a)
        last, rest = F.element_at(a, -1), F.slice(a, F.lit(1), n - 1)
        return F.when(c == "<", F.concat(a, F.array(F.lit("<")))).when((c == ">") & (n > 1), rest).otherwise(F.concat(rest, F.array(F.concat(last, c))))

    return F.when(text.contains("<"), F.aggregate(chars, F.array(F.lit("")), step, lambda a: F.array_join(a, ""))).otherwise(text)


def parameters(signature: Column) -> Column:
    """What stands between commas outside brackets and quotes in the first pair of parentheses; no receivers, no / and *."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        quoted = a["quote"] != ""
        cut = (c == ",") & (a["depth"] == 0) & ~quoted
        depth = F.when(quoted, a["depth"]).when(c.isin("(", "[", "{", "<"), a["depth"] + 1).when(c.isin(")", "]", "}", ">") & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"])
        quote = F.when(quoted & (c == a["quote"]), "").when(~quoted & c.isin("'", '"'), c).otherwise(a["quote"])
        return F.struct(depth.alias("depth"), quote.alias("quote"), F.when(cut, "").otherwise(F.concat(a["now"], c)).alias("now"), F.when(cut, F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]).alias("out"))

    split = F.aggregate(F.filter(F.split(inner, ""), lambda c: c != ""), start, step, lambda a: F.concat(a["out"], F.array(a["now"])))
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: ~x.isin("", "self", "cls", "this", "/", "*"))


def plain_json(text: Column) -> Column:
    """JSON with comments and trailing commas as JSON; what stands in strings stays."""
    string = r'("(?:\\.|[^"\\])*")'
    text = F.regexp_replace(text, rf"(?s){string}|//[^\n]*|/\*.*?\*/", "$1")
    return F.regexp_replace(text, rf"(?s){string}|,(?=\s*[}}\]])", "$1")


def useful_lines(text: Column, drop: str = r"(?i)licen[sc]e|copyright|spdx-") -> Column:
    """The lines without licence lines and without blank ones that follow a blank one; at least the first line."""
    ls = F.split(text, "\n")
    blank = lambda x: ~x.rlike("[^ \t\r]")
    kept = F.filter(ls, lambda x, i: ~x.rlike(drop) & ~(blank(x) & (i > 0) & F.coalesce(blank(F.get(ls, i - 1)), F.lit(False))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(ls, 1, 1))


def table_cells(row: Column) -> Column:
    """The cells of a pipe-table row; an escaped pipe is part of its cell."""
    body = F.regexp_replace(F.regexp_replace(F.trim(row), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(body, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
