"""Text transforms; column expressions but for the three that need a scanner."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defaults for documents without a title or a description.
NO_TITLE, NO_DESCRIPTION = "未命名文档", "暂无描述"


def strip_ansi(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\x1b\\[[0-9;]*[a-zA-Z]", ""))


def strip_tags(html: Column) -> Column:
    """Text outside <...>; a stray > goes, an unclosed < takes the rest."""
    return F.btrim(F.regexp_replace(F.regexp_replace(html, "<[^>]*(>|$)", ""), ">", ""), F.lit(" \t\n\r\x0b\x0c"))


def cut_runes(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def cut_bytes(text: Column, n: int, mark: str = "...") -> Column:
    """By bytes; a character cut in two is replaced."""
    head = F.call_function("make_valid_utf8", F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) > n, F.concat(head, F.lit(mark))).otherwise(text)


def tokens(text: Column) -> Column:
    """An estimate: a token for four bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def _trimmed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")


def title(text: Column) -> Column:
    """The first line that starts with #, without its marks."""
    heads = F.filter(_trimmed_lines(text), lambda x: F.startswith(x, F.lit("#")))
    found = F.trim(F.regexp_replace(F.try_element_at(heads, F.lit(1)), "^#+", ""))
    return F.when(F.coalesce(found, F.lit("")) == "", NO_TITLE).otherwise(found)


def description(text: Column) -> Column:
    """The first line of prose after the title: no fence, list item or title; a quote loses its mark. At most 120 bytes."""
    lines = _trimmed_lines(text)
    first = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("#"))), True)
    after = F.when(first > 0, F.slice(lines, (first + 1).cast("int"), F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    open_ = F.transform(F.filter(after, lambda x: ~F.startswith(x, F.lit("```"))), lambda x: F.trim(F.regexp_replace(x, "^>", "")))
    found = F.try_element_at(F.filter(open_, lambda x: ~F.rlike(x, F.lit("^[-*+#]")) & (x != "")), F.lit(1))
    return F.coalesce(cut_bytes(found, 120), F.lit(NO_DESCRIPTION))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[ /]", "-")


def file_slug(title: Column) -> Column:
    """A file name: lower case, dashes for spaces, other characters than letters, digits and dashes left out."""
    name = F.regexp_replace(F.regexp_replace(F.lower(title), " ", "-"), r"[^a-z0-9\-]", "")
    return F.when(name != "", F.concat(name, F.lit(".md")))


def signatures(code: Column) -> Column:
    """Lines that declare something."""
    return F.array_join(F.filter(F.split(code, "\n"), lambda x: F.rlike(F.ltrim(x), F.lit("^(package|import|type|const|var|func) "))), "\n")


def json_in(text: Column) -> Column:
    """What a fenced json block holds, else from the first { to the last }."""
    fenced = F.nullif(F.btrim(F.regexp_extract(text, "(?s)```json\\s*(.*?)```", 1), F.lit(" \t\r\n")), F.lit(""))
    return F.coalesce(fenced, F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def front_matter(text: Column, key: str = "description") -> Column:
    """A scalar of the YAML block at the start."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.btrim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1), F.lit(" \"'")), F.lit(""))


def replace_first(text: Column, target: Column, by: Column) -> Column:
    at = F.call_function("locate", target, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(target), F.length(text)))).otherwise(text)


def apply_changes(text: Column, changes: Column) -> Column:
    """Folds structs (op, target, content): insert, delete, replace the first occurrence, or replaceAll; an empty target appends a line."""

    def step(now: Column, c: Column) -> Column:
        line_end = F.when((now == "") | F.endswith(now, F.lit("\n")), "").otherwise("\n")
        return (
            F.when(c["target"] == "", F.concat(now, line_end, c["content"]))
            .when(c["op"] == "insert", replace_first(now, c["target"], F.concat(c["target"], F.lit("\n"), c["content"])))
            .when(c["op"] == "delete", replace_first(now, c["target"], F.lit("")))
            .when(c["op"] == "replace", replace_first(now, c["target"], c["content"]))
            .when(c["op"] == "replaceAll", F.call_function("replace", now, c["target"], c["content"]))
            .otherwise(now)
        )

    return F.aggregate(changes, text, step)


def yes_no(text: Column) -> Column:
    """Y, N, or the trimmed upper-case input; full-width letters and a few words count."""
    plain = F.upper(F.trim(F.translate(text, "ＹｙＮｎ", "YyNn")))
    return F.when(plain.isin("Y", "YES", "是", "好", "确定"), "Y").when(plain.isin("N", "NO", "否", "不"), "N").otherwise(plain)


def duration(seconds: Column) -> Column:
    """45s, 2m5s, 1h3m."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%ds", (s / 60).cast("long"), s % 60)).otherwise(F.format_string("%dh%dm", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long")))


@F.pandas_udf(T.StringType())
def two_decimals(values: pd.Series) -> pd.Series:
    """Rounds the exact binary value, which the JVM's formats and casts to decimal don't: they round the shortest text of it."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def calculate(op: Column, a: Column, b: Column) -> Column:
    """add, sub, mul or div with two decimals; an error text for others and for a division by zero."""
    value = F.when(op == "add", a + b).when(op == "sub", a - b).when(op == "mul", a * b).when(op == "div", F.try_divide(a, b))
    return F.when((op == "div") & (b == 0), "error: division by zero").when(value.isNull(), F.concat(F.lit("error: unknown operation "), op)).otherwise(two_decimals(value))


def port_ok(text: Column) -> Column:
    return F.coalesce(text.try_cast("int").between(1, 65535), F.lit(False))


def env_key(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(key))


def color_index(author: Column) -> Column:
    """Sum of the code points, modulo 6."""
    return F.pmod(F.aggregate(F.transform(F.filter(F.split(author, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x), F.lit(6))


@F.pandas_udf(T.StringType())
def image_links(texts: pd.Series, folders: pd.Series) -> pd.Series:
    """Local Markdown images point below /images; other text stays as it is."""
    import re

    image = re.compile(r"!\[([^\]]*)\]\(([^)]*)\)")

    def moved(m: re.Match, folder: str) -> str:
        target = m[2]
        if target.lower().startswith(("http://", "https://")):
            return m[0]
        target = target.partition("?")[0].partition("#")[0]
        return f"![{m[1]}](/images{posixpath.normpath(posixpath.join('/', folder, target))})"

    return pd.Series([None if t is None else image.sub(lambda m, f=f: moved(m, f or "/"), t) for t, f in zip(texts, folders, strict=True)])


@F.pandas_udf(T.StringType())
def mermaid(texts: pd.Series) -> pd.Series:
    """In mermaid blocks, interface{} becomes any; in class diagrams, a class right of an arrow loses its leading *."""
    import re

    arrow = re.compile(r"(<\|--|--\|>|<\|\.\.|\.\.\|>|-->|<--|\*--|o--|--o|--\*)(\s*)\*(?=\w)")

    def one(text: str) -> str:
        out, inside, classes = [], False, False
        for line in text.split("\n"):
            mark = line.strip()
            if inside and mark.startswith("```"):
                inside = classes = False
            elif mark.startswith("```mermaid"):
                inside, classes = True, False
            elif inside:
                classes = classes or mark.startswith("classDiagram")
                line = line.replace("interface{}", "any")
                line = arrow.sub(r"\1 ", line, count=1) if classes else line
            out.append(line)
        return "\n".join(out)

    return pd.Series([None if t is None else one(t) for t in texts])
