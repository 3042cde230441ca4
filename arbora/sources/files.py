"""Directories, documents, blame output, configuration, prompts and API responses as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import paths
from arbora.operators import search

#: Extensions that document loaders know; those of LOADED are read, the others are told as unsupported.
LOADED = ".txt .md .go .py .js .ts .java .c .cpp .h .rs .rb .php .sh .yaml .yml .xml .css .sql .csv".split()


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a directory: path (from root), size, mod_time, content. content is read only if it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/")
    inner = F.regexp_replace(F.col("path"), "^[a-z0-9+.-]+:/+(?=/)|^[a-z0-9+.-]+:(?=/)", "")
    tail = F.substring_index(inner, top.split("://")[-1] if "://" in top else top, -1)
    return found.select(paths.standard(tail).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content")


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, excludes: list[str] | None = None, ignore: bool = True) -> DataFrame:
    """Files that a scan keeps: not in pruned directories, with an allowed extension, not excluded and not ignored by .gitignore files."""
    found = scan_raw(spark, root)
    kept = found.where(~paths.pruned(F.col("path"), F.lit(False))).where(search.not_excluded(F.col("path"), excludes or []))
    if extensions:
        kept = kept.where(paths.allowed_ext(F.col("path"), extensions))
    return search.without_ignored(kept, ignore_rules(found)) if ignore else kept


def ignore_rules(found: DataFrame) -> DataFrame:
    """dir, rule of each .gitignore file; comments and empty lines are left out."""
    lines = found.where(paths.name(F.col("path")) == ".gitignore").select(paths.parent(F.col("path")).alias("dir"), F.explode(F.split(F.col("content").cast("string"), "\r?\n")).alias("rule"))
    return lines.select("dir", F.trim("rule").alias("rule")).where("rule <> '' AND NOT startswith(rule, '#')")


def readable(found: DataFrame) -> DataFrame:
    return found.where(paths.is_readable(paths.ext(F.col("path")), F.col("content")))


def documents(found: DataFrame) -> DataFrame:
    """text, source, filename, rel_path of the files that a loader knows; CSV files give a row a record."""
    e = F.lower(paths.ext(F.col("path")))
    base = found.where(e.isin(LOADED)).select(F.col("content").cast("string").alias("text"), F.col("path").alias("source"), paths.name(F.col("path")).alias("filename"), F.ltrim("path", F.lit("/")).alias("rel_path"), (e == ".csv").alias("_csv"))
    rows = base.where("_csv").mapInArrow(_records, "text string, source string, filename string, rel_path string, _csv boolean")
    return base.where("NOT _csv").unionByName(rows).drop("_csv")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import csv
    import io

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            for record in csv.DictReader(io.StringIO(row["text"])):
                out.append(row | {"text": "\n".join(f"{k}: {v}" for k, v in record.items())})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def loader_counts(found: DataFrame) -> DataFrame:
    known = F.lower(paths.ext(F.col("path"))).isin(LOADED)
    return found.agg(F.count_if(known).alias("supported"), F.count_if(~known).alias("unsupported"))


def porcelain(outputs: DataFrame) -> DataFrame:
    """path, author, email, when for each code line of line-porcelain blame output (path, text).

    A code line starts with a tab and has the author, mail and time that were told last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("author", pa.string()), ("email", pa.string()), ("seconds", pa.int64())])
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                author = email = ""
                when = None
                for line in (text or "").split("\n"):
                    if line.startswith("\t"):
                        rows.append((path, author, email, when))
                    elif line.startswith("author "):
                        author = line[7:].strip()
                    elif line.startswith("author-mail "):
                        email = line[12:].strip().strip("<>")
                    elif line.startswith("author-time ") and line[12:].strip().lstrip("-").isdigit():
                        when = int(line[12:])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    found = outputs.select("path", "text").mapInArrow(run, "path string, author string, email string, seconds long")
    return found.select("path", "author", "email", F.timestamp_seconds("seconds").alias("when"))


def key_values(lines: Column) -> Column:
    """A struct (key, value) of a line, split at the first =; null without one."""
    parts = F.split(lines, "=", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")))


def layered(*layers: dict) -> dict:
    """Configuration: later layers override earlier ones, maps key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_layered(default: dict, *files: str) -> dict:
    found = []
    for f in files:
        try:
            with open(f, encoding="utf-8") as handle:
                found.append(json.load(handle))
        except FileNotFoundError:
            continue
    return layered(default, *found)


def prompts(system: DataFrame, user: DataFrame) -> DataFrame:
    """name, content, origin; the user's prompt of a name overrides the system's."""
    s, u = system.select("name", F.col("content").alias("_system")), user.select("name", F.col("content").alias("_user"))
    return s.join(u, "name", "full_outer").select("name", F.coalesce("_user", "_system").alias("content"), F.when(F.col("_user").isNotNull(), "user").otherwise("system").alias("origin"))


def search_results(responses: DataFrame, limit: int) -> DataFrame:
    """engine, rank, title, url, snippet of search API responses (engine, payload), at most limit for each response.

    Three shapes are known; the third engine has results in one of three places.
    """
    item = "array<struct<title:string, link:string, url:string, snippet:string, content:string, name:string>>"
    shape = f"struct<items:{item}, webPages:struct<value:{item}>, references:{item}, search:struct<web:{item}>, result:struct<result:{item}>>"
    j = F.from_json("payload", shape)
    rows = responses.select("engine", j.alias("j")).select("engine", F.coalesce("j.items", "j.webPages.value", "j.references", "j.search.web", "j.result.result").alias("all"))
    flat = rows.select("engine", F.posexplode(F.slice("all", 1, limit)).alias("rank", "r"))
    return flat.select("engine", "rank", F.coalesce("r.title", "r.name").alias("title"), F.coalesce("r.link", "r.url").alias("url"), F.coalesce("r.snippet", "r.content").alias("snippet"))
