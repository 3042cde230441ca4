"""Predicate search over nodes, and ignore rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import paths
from arbora.functions.patterns import glob_regex, re2_to_java


def text_match(column: Column, plain: str | None, regex: str | None, ignore_case: bool) -> Column | None:
    """Substring or pattern; the pattern wins."""
    if regex:
        return F.rlike(column, F.lit(re2_to_java(regex, ignore_case)))
    if plain:
        return F.contains(F.lower(column), F.lit(plain.lower())) if ignore_case else F.contains(column, F.lit(plain))
    return None


def search(
    nodes: DataFrame, name: str | None = None, name_regex: str | None = None, content: str | None = None, content_regex: str | None = None, ignore_case: bool = False, any_of: bool = False,
    extensions: list[str] | None = None, root: str = "/", max_depth: int = 0, hidden: bool = False, files: bool = True, dirs: bool = True, limit: int | None = None,
) -> DataFrame:
    """Nodes below root that meet all conditions on name and content, or any of them.

    Directories never meet a condition on content. Extensions hold for files only. Hidden: the node's own name starts with a
    dot. max_depth counts from root, 0: no bound. Cheap predicates come first, content last.
    """
    if not files and not dirs:
        raise ValueError("neither files nor directories are asked for")
    if max_depth < 0:
        raise ValueError("the depth is negative")
    p, top = F.col("path"), len([x for x in root.split("/") if x])
    out = nodes.where(paths.under(p, root))
    if max_depth:
        out = out.where(F.col("depth") - top <= max_depth)
    if not hidden:
        out = out.where(~paths.hidden_name(p) | (p == root))
    if not files or not dirs:
        out = out.where(F.col("is_dir") if dirs else ~F.col("is_dir"))
    if extensions:
        out = out.where(F.col("is_dir") | paths.allowed_ext(p, extensions))
    by_name = text_match(F.col("name"), name, name_regex, ignore_case)
    by_text = text_match(F.col("text"), content, content_regex, ignore_case)
    if by_text is not None:
        by_text = ~F.col("is_dir") & F.coalesce(by_text, F.lit(False))
    both = [x for x in (by_name, by_text) if x is not None]
    if both:
        out = out.where(reduce(lambda a, b: a | b, both) if any_of else reduce(lambda a, b: a & b, both))
    return out.limit(limit) if limit else out


def not_excluded(path: Column, globs: list[str]) -> Column:
    """No pattern fits the name or the path from the root; ** crosses directories."""
    hits = [F.rlike(x, F.lit(glob_regex(g))) for g in globs for x in (paths.name(path), F.ltrim(path, F.lit("/")))]
    return ~reduce(lambda a, b: a | b, hits) if hits else F.lit(True)


def conditions(query: str = "", **explicit: str) -> dict[str, str]:
    """What search() is asked for: explicit conditions, or, without any, the query as part of a name."""
    given = {k: v for k, v in explicit.items() if v}
    if not given and not query:
        raise ValueError("a query or a condition is needed")
    return given or {"name": query}


def root_ignored(path: Column, rules: list[str]) -> Column:
    """Rules of the root's ignore file alone: with a leading slash the whole path fits, without one the name fits or the path holds the rule."""
    rel, name = F.ltrim(path, F.lit("/")), paths.name(path)
    hits = []
    for r in rules:
        if r.startswith("/"):
            hits.append(F.rlike(rel, F.lit(glob_regex(r[1:]))))
        else:
            hits += [F.rlike(name, F.lit(glob_regex(r))), F.contains(rel, F.lit(r))]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def name_ignored(path: Column, rules: list[str]) -> Column:
    """Rules that look at names only, a slash at their end left out; negations and comments are passed over."""
    kept = [r.strip() for r in rules if r.strip() and not r.strip().startswith(("#", "!"))]
    hits = [F.rlike(paths.name(path), F.lit(glob_regex(r.removesuffix("/")))) for r in kept]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def rule_regex(dir_: Column, rule: Column) -> Column:
    """A pattern over paths: a rule with a leading slash is anchored at the root, any other fits a component; both below its directory."""
    body = F.regexp_replace(rule, "/$", "")
    anchored = F.startswith(body, F.lit("/"))
    escaped = F.regexp_replace(F.ltrim(body, F.lit("/")), r"([.+(){}|^$\\])", r"\\$1")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\*\*/?", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]"), "\u0001", ".*")
    top = F.when(dir_ == "/", "").otherwise(F.concat(F.lit(r"\Q"), dir_, F.lit(r"\E")))
    return F.when(anchored, F.concat(F.lit("^/"), glob, F.lit("(/|$)"))).otherwise(F.concat(F.lit("^"), top, F.lit("(/.*)?/"), glob, F.lit("(/|$)")))


def without_ignored(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes that no rule (dir, rule) of a directory above them excludes.

    An equality join on the directories above a node, not a comparison with all rules; negations are left out.
    """
    regex = rules.where("NOT startswith(rule, '!')").groupBy("dir").agg(F.collect_set(rule_regex(F.col("dir"), F.col("rule"))).alias("_rules"))
    above = nodes.where("path <> '/'").select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    hit = above.join(regex, "dir").where(F.exists("_rules", lambda r: F.rlike(F.col("path"), r))).select("path").distinct()
    return nodes.join(hit, "path", "left_anti")


def markdown_match(path: Column, pattern: str) -> Column:
    """A Markdown file by pattern: the whole path, its name, the name within a directory pattern, or a directory prefix."""
    rel = F.ltrim(path, F.lit("/"))
    clean = pattern.lstrip("./").lstrip("/")
    fits = F.rlike(rel, F.lit(glob_regex(clean))) | F.rlike(paths.name(path), F.lit(glob_regex(clean))) | F.rlike(rel, F.lit(glob_regex("**/" + clean)))
    return F.endswith(F.lower(path), F.lit(".md")) & (fits | F.startswith(rel, F.lit(clean.rstrip("/*") + "/")))
