"""Declarations of Go source files: types with their fields or methods, functions with their receivers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may not be read as code: comments, strings and runes.
OPAQUE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'", re.S)
PIECE = re.compile(r"[A-Za-z_]\w*|\n|[^\s\w]|\d\w*")
OPENING, CLOSING = "([{", ")]}"
_TYPE = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))])
_FUNC = T.StructType([T.StructField("name", T.StringType()), T.StructField("receiver", T.StringType())])
DECLARED = T.StructType([T.StructField("types", T.ArrayType(_TYPE)), T.StructField("funcs", T.ArrayType(_FUNC))])


def pieces(code: str) -> list[str]:
    """Names, line ends and signs, without comments and texts; a comment over lines ends the line, as the language has it."""
    plain = OPAQUE.sub(lambda m: "\n" if "\n" in m[0] and m[0][:2] == "/*" else " " if m[0][:1] == "/" else " 0 ", code)
    return PIECE.findall(plain)


def closed(p: list[str], at: int) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(p)):
        depth += (p[i] in OPENING) - (p[i] in CLOSING)
        if not depth:
            return i + 1
    return len(p)


def lines(p: list[str]) -> Iterator[list[str]]:
    """Statements: cut at line ends and semicolons outside brackets."""
    held, i = [], 0
    while i < len(p):
        if p[i] in OPENING:
            end = closed(p, i)
            held += p[i:end]
            i = end
            continue
        if p[i] in ("\n", ";"):
            if held:
                yield held
            held = []
        else:
            held.append(p[i])
        i += 1
    if held:
        yield held


def word(x: str) -> bool:
    return x[:1].isalpha() or x[:1] == "_"


def fields(body: list[str]) -> list[str]:
    """Names of a struct's fields: a name, or several between commas, that a type follows; embedded types have none."""
    out = []
    for s in lines(body):
        names, i = [], 0
        while i < len(s) and word(s[i]):
            names.append(s[i])
            i += 1
            if i < len(s) and s[i] == ",":
                i += 1
            else:
                break
        embedded = i >= len(s) or s[i] in (".", "0")  # a tag reads as 0
        if not embedded and len(names) == 1 and s[i] == "[":  # with type arguments, and nothing but a tag after them
            embedded = s[closed(s, i) :] in ([], ["0"])
        if names and not embedded:
            out += names
    return out


def methods(body: list[str]) -> list[str]:
    return [s[0] for s in lines(body) if len(s) > 1 and word(s[0]) and s[1] == "("]


def type_of(s: list[str]) -> dict | None:
    """A type specification: its name, kind, and fields or methods."""
    if not s or not word(s[0]):
        return None
    rest = s[1:]
    if rest[:1] == ["["] and len(rest) > 2 and word(rest[1]) and (end := closed(rest, 0)) < len(rest) and end > 3:
        rest = rest[end:]  # type parameters
    if rest[:2] == ["struct", "{"]:
        return {"name": s[0], "kind": "struct", "fields": fields(rest[2 : closed(rest, 1) - 1])}
    if rest[:2] == ["interface", "{"]:
        return {"name": s[0], "kind": "interface", "fields": methods(rest[2 : closed(rest, 1) - 1])}
    return {"name": s[0], "kind": "alias", "fields": []}


def receiver(p: list[str]) -> str:
    """The type in a receiver's brackets: the last name before type arguments, with its package; pointers don't count."""
    p = p[: p.index("[")] if "[" in p else p
    p = [x for x in p if x not in ("*", "\n", ",")]
    return "".join(p[1:]) if len(p) > 1 and p[1] != "." else "".join(p)


def declarations(code: str) -> tuple[list[dict], list[dict]]:
    """Types and functions in order; of several of one name the last."""
    types: dict[str, dict] = {}
    funcs: dict[str, dict] = {}
    for s in lines(pieces(code)):
        if s[0] == "type" and len(s) > 1:
            inner = list(lines(s[2 : closed(s, 1) - 1])) if s[1] == "(" else [s[1:]]
            for x in inner:
                if found := type_of(x):
                    types[found["name"]] = found
        elif s[0] == "func" and len(s) > 2:
            own, at = None, 1
            if s[1] == "(":
                at = closed(s, 1)
                own = receiver(s[2 : at - 1])
            if at < len(s) and word(s[at]):
                funcs[s[at]] = {"name": s[at], "receiver": own}
    return list(types.values()), list(funcs.values())


@F.pandas_udf(DECLARED)
def declared(texts: pd.Series) -> pd.DataFrame:
    """types (name, kind, fields) and funcs (name, receiver; null for functions) of a Go file."""
    found = [declarations(x or "") for x in texts]
    return pd.DataFrame({"types": [t for t, _ in found], "funcs": [f for _, f in found]})


#: Else the plan scans each file twice, in two workers of a task: once for a filter of its own on empty lists.
declared = declared.asNondeterministic()
