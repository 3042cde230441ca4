"""Packing files into Markdown, and token-bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import golang, paths, text
from arbora.sources import shared


def included(path: Column, hidden: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Text files by extension; lists have extensions with their dots, in any case."""
    e = F.lower(paths.ext(path))
    out = paths.is_packed(paths.ext(path))
    out = out if hidden else out & ~paths.hidden_name(path)
    out = out & ~e.isin([x.lower() for x in exclude]) if exclude else out
    return out & e.isin([x.lower() for x in include]) if include else out


def block(path: Column, content: Column, size: Column) -> Column:
    """A file's section: title, path, size and a fenced block."""
    shown = F.ltrim(path, F.lit("/"))
    end = F.when(F.endswith(content, F.lit("\n")), "").otherwise("\n")
    return F.concat(F.lit("## 📄 "), shown, F.lit("\n\n**路径:** `"), shown, F.lit("`  \n**大小:** "), size.cast("string"), F.lit(" bytes  \n\n```"), paths.language(paths.ext(path)), F.lit("\n"), content, end, F.lit("```\n\n"))


def header(title: str) -> str:
    return f"# 📦 项目打包: {title}\n\n---\n\n"


FOOTER = "\n---\n"
#: Formats by name: a function of path, content and size. Unknown names mean Markdown.
FORMATS: dict[str, Callable[[Column, Column, Column], Column]] = {"markdown": block, "md": block}


def formatter(name: str) -> Callable[[Column, Column, Column], Column]:
    return FORMATS.get(name.lower(), block)


def packed(files: DataFrame, kind: str = "markdown", **filters) -> DataFrame:
    """path, block for each file packed; path order is the document's order."""
    shown = formatter(kind)(F.col("path"), F.col("text"), F.col("size"))
    return files.where(included(F.col("path"), **filters)).where(~paths.is_binary(F.col("text"))).select("path", shown.alias("block"))


def write_packed(files: DataFrame, target: str, title: str, **filters) -> None:
    """Text files whose names' order is the document's, so that no task holds the whole of it."""
    target = target if "." in target.rsplit("/", 1)[-1] else target + ".md"
    rows = packed(files, **filters).select(F.lit(1).alias("_part"), "path", "block")
    ends = files.sparkSession.createDataFrame([(0, "", header(title)), (2, "", FOOTER)], rows.schema)
    ordered = rows.unionByName(ends).repartitionByRange("_part", "path").sortWithinPartitions("_part", "path")
    ordered.select("block").write.mode("overwrite").text(target)


def as_string(files: DataFrame, title: str, **filters) -> str:
    """The whole document on the driver, for projects that fit there."""
    return header(title) + "".join(r[0] for r in packed(files, **filters).orderBy("path").select("block").toLocalIterator()) + FOOTER


def section() -> Column:
    """A file's part of a batch."""
    return F.concat(F.lit("// FILE: "), "path", F.lit("\n"), "text", F.lit("\n\n"))


def directory_batches(files: DataFrame) -> DataFrame:
    """dir, files, bytes, tokens, of each directory's files with their // FILE: headers."""
    rows = files.select(paths.parent(F.col("path")).alias("dir"), F.octet_length(section()).cast("long").alias("_bytes"), text.tokens(section()).alias("_tokens"))
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("_bytes").alias("bytes"), F.sum("_tokens").alias("tokens"))


def directory_texts(files: DataFrame) -> DataFrame:
    """dir, text: the sections of a directory's files in path order. For directories that fit a row; batch_texts() bounds them."""
    rows = files.select(paths.parent(F.col("path")).alias("dir"), "path", section().alias("_part"))
    return rows.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("path", "_part"))).alias("_all")).select("dir", F.array_join(F.col("_all._part"), "").alias("text"))


#: Files of a directory beyond which its batches are found by many tasks, and rows that one of those holds.
LARGE, BLOCK = 1 << 18, 1 << 18


def token_batches(files: DataFrame, limit: int) -> DataFrame:
    """path, dir, batch (from 1), tokens: files of a directory in path order, a new batch where the sum would pass the limit.

    A file above the limit is alone in its batch. A directory of LARGE files or fewer is read in order by one task, which holds
    an Arrow batch of paths and counts, no texts; larger ones go through ranged_batches(). Paths are distinct.
    """
    rows = files.select(paths.parent(F.col("path")).alias("dir"), "path", text.tokens(section()).alias("tokens"))
    large = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select("dir")
    if large.isEmpty():
        return _streamed(rows, limit)
    large = shared.written(large, f"{shared.fresh(files.sparkSession, 'batches')}/large")
    return _streamed(rows.join(large, "dir", "left_anti"), limit).unionByName(ranged_batches(rows.join(large, "dir", "left_semi"), limit))


def _streamed(rows: DataFrame, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, used = None, 0, 0
        for b in batches:
            out = []
            for d, n in zip(b.column("dir").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                if d != now:
                    now, number, used = d, 1, n
                elif used + n > limit:
                    number, used = number + 1, n
                else:
                    used += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("dir"), pa.array(out, pa.int32()), b.column("tokens")], names=["path", "dir", "batch", "tokens"])

    return rows.repartition("dir").sortWithinPartitions("dir", "path").mapInArrow(run, BATCHES)


BATCHES = "path string, dir string, batch int, tokens int"


def next_starts(tokens: np.ndarray, limit: int) -> np.ndarray:
    """For a batch that begins at each row, where the next one begins (the number of rows if it is still open at the end)."""
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    return np.maximum(np.searchsorted(sums, sums[:-1] + limit, side="right") - 1, np.arange(1, len(tokens) + 1))


def chains(after: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a batch that begins at each row: batches begun from there to the end of the rows, and tokens in the one then open.

    By pointer doubling: each round doubles the number of batches that a pointer passes.
    """
    n = len(after)
    to, begun = np.append(after, n), np.append(np.ones(n, dtype=np.int64), 0)
    last = np.append(np.arange(n), n)  # the last start passed on the way
    while (to[:n] < n).any():
        last = np.where(to < n, last[to], last)
        begun, to = begun + begun[to], to[to]
    return begun[:n], sums[n] - sums[last[:n]]


def _pieces(batches: Iterator[pa.RecordBatch], most: int, *keys: str) -> Iterator[pa.Table]:
    """Sorted batches as tables of one key each, so many rows at most."""
    held, rows, now = [], 0, None
    for b in batches:
        values = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
        at = 0
        while at < len(values):
            if held and (values[at] != now or rows >= most):
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            now, end = values[at], at
            while end < len(values) and values[end] == now and rows + end - at < most:
                end += 1
            held.append(b.slice(at, end - at))
            rows, at = rows + end - at, end
    if held:
        yield pa.Table.from_batches(held)


def ranged_batches(rows: DataFrame, limit: int, most: int = BLOCK) -> DataFrame:
    """token_batches() of dir, path, tokens for directories of any size, each in many tasks.

    Rows are dealt by range of directory and path, so a partition holds consecutive files; it is cut in
    blocks of `most` rows at most. What a block
    does to a batch that is open before it depends only on which of its files is the first to begin a new one, so each
    block tells for those that can be, the ones within the first `limit` tokens, how many batches begin from there on and how many
    tokens the last holds. A directory's blocks are followed in order over these few rows, then each block numbers its files.
    """
    spark = rows.sparkSession
    folder = shared.fresh(spark, "batches")
    block = "dir string, path string, tokens int, part int, block int, at int, before long, begun long, open long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, piece in enumerate(_pieces(batches, most, "dir")):
            tokens = piece["tokens"].to_numpy().astype(np.int64)
            n, sums = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
            begun, left = chains(next_starts(tokens, limit), sums)
            yield from pa.table([piece["dir"], piece["path"], piece["tokens"], *(pa.array(np.full(n, x, np.int32)) for x in (part, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums[:-1]), pa.array(begun), pa.array(left)], names=["dir", "path", "tokens", "part", "block", "at", "before", "begun", "open"]).to_batches()

    own = shared.written(rows.select("dir", "path", "tokens").repartitionByRange("dir", "path").sortWithinPartitions("dir", "path").mapInArrow(cut, block), f"{folder}/blocks")
    totals = own.groupBy("dir", "part", "block").agg(F.sum("tokens").cast("long").alias("total"))
    first = own.where(F.col("before") <= limit).select("dir", "part", "block", "at", "before", (F.col("before") + F.col("tokens")).alias("till"), "begun", "open")

    def followed(table: pa.Table) -> pa.Table:
        """Of a directory's blocks: the batch open before each, its tokens (none before the first), and so on to the next."""
        t = table.sort_by([("part", "ascending"), ("block", "ascending"), ("at", "ascending")])
        part, number, till, begun, left, total = (t[x].to_numpy() for x in ("part", "block", "till", "begun", "open", "total"))
        starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (number[1:] != number[:-1])]))
        batch, used, out = 0, None, []
        for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
            out.append((batch, used))
            i = a if used is None else a + int(np.searchsorted(till[a:b], limit - used, side="right"))  # the first file that passes the limit
            batch, used = (batch, used + int(total[a])) if i == b else (batch + int(begun[i]), int(left[i]))
        names = {"dir": t["dir"].take(pa.array(starts)), "part": pa.array(part[starts]), "block": pa.array(number[starts]), "batch": pa.array([x for x, _ in out], pa.int64()), "used": pa.array([x for _, x in out], pa.int64())}
        return pa.table(names)

    entered = first.join(totals, ["dir", "part", "block"]).groupBy("dir").applyInArrow(followed, "dir string, part int, block int, batch long, used long")
    entered = shared.written(entered, f"{folder}/entered")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, most, "dir", "part", "block"):
            tokens, used, batch = piece["tokens"].to_numpy().astype(np.int64), piece["used"][0].as_py(), piece["batch"][0].as_py()
            n, sums = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
            after, new = next_starts(tokens, limit), np.zeros(n, dtype=np.int64)
            at = 0 if used is None else int(np.searchsorted(sums[1:], limit - used, side="right"))
            while at < n:
                new[at] = 1
                at = int(after[at])
            yield from pa.table([piece["path"], piece["dir"], pa.array((batch + np.cumsum(new)).astype(np.int32)), piece["tokens"]], names=["path", "dir", "batch", "tokens"]).to_batches()

    keys = ["dir", "part", "block"]
    return own.select(*keys, "at", "path", "tokens").join(entered, keys).repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(numbered, BATCHES)


def batch_texts(files: DataFrame, limit: int) -> DataFrame:
    """dir, batch, text: the sections of a batch's files in path order; a batch holds limit tokens, or one larger file."""
    rows = token_batches(files, limit).join(files.select("path", section().alias("_part")), "path")
    return rows.groupBy("dir", "batch").agg(F.array_sort(F.collect_list(F.struct("path", "_part"))).alias("_all")).select("dir", "batch", F.array_join(F.col("_all._part"), "").alias("text"))


def skipped(batches: DataFrame, types: str = "types", funcs: str = "funcs") -> DataFrame:
    """Batches to be left out: functions but no types, or more than 20 functions and fewer than 3 types."""
    t, f = F.col(types), F.col(funcs)
    return batches.where(((t == 0) & (f > 0)) | ((f > 20) & (t < 3)))


def code_index(files: DataFrame) -> DataFrame:
    """dir, types (name, kind, fields), funcs (name, receiver) that Go files declare, sorted by name; of equal names in a directory the last file's."""
    go = files.where(paths.ext(F.col("path")) == ".go").select(paths.parent(F.col("path")).alias("dir"), "path", golang.declared("text").alias("d"))
    kept = lambda kind: go.select("dir", "path", F.explode(f"d.{kind}").alias("x")).groupBy("dir", F.col("x.name").alias("name")).agg(F.max_by("x", "path").alias("x")).groupBy("dir").agg(F.array_sort(F.collect_list("x")).alias(kind))
    return go.select("dir").distinct().join(kept("types"), "dir", "left").join(kept("funcs"), "dir", "left")


def code_index_text(index: DataFrame) -> DataFrame:
    """dir, text: a code index as a prompt's section."""
    name = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    fields = lambda t: F.when(F.size(t["fields"]) > 0, F.concat(F.lit("字段/方法:\n"), F.array_join(F.transform(t["fields"], lambda f: F.concat(F.lit("- "), name(f), F.lit("\n"))), ""))).otherwise("")
    types = F.array_join(F.transform("types", lambda t: F.concat(F.lit("### "), name(t["name"]), F.lit(" ("), t["kind"], F.lit(")\n"), fields(t), F.lit("\n"))), "")
    method = lambda f: F.when(f["receiver"].isNull(), F.lit(" (函数)\n")).otherwise(F.concat(F.lit(" (方法，接收者: "), name(f["receiver"]), F.lit(")\n")))
    funcs = F.array_join(F.transform("funcs", lambda f: F.concat(F.lit("- "), name(f["name"]), method(f))), "")
    part = lambda what, column, body, end: F.when(F.size(column) > 0, F.concat(F.lit(f"## 📋 代码中实际存在的{what}（只能使用这些）\n\n"), body, F.lit(end))).otherwise("")
    return index.select("dir", F.concat(part("类型", "types", types, ""), part("函数/方法", "funcs", funcs, "\n")).alias("text"))


def first_per_module(files: DataFrame, modules: int = 30, each: int = 5) -> DataFrame:
    """dir, shown (the first paths), more: of the first directories by name. Ranks are cut before the shuffle."""
    by = files.select(paths.parent(F.col("path")).alias("dir"), "path")
    top = by.groupBy("dir").agg(F.count(F.lit(1)).alias("_n")).orderBy("dir").limit(modules)
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("path"))
    first = by.withColumn("_rank", rank).where(F.col("_rank") <= each).join(F.broadcast(top), "dir")
    rows = first.groupBy("dir").agg(F.array_sort(F.collect_list("path")).alias("shown"), F.first("_n").alias("_n"))
    return rows.select("dir", "shown", F.greatest(F.col("_n") - each, F.lit(0)).cast("int").alias("more"))


def markdown_directories(files: DataFrame) -> DataFrame:
    return files.where(F.lower(paths.ext(F.col("path"))) == ".md").select(paths.parent(F.col("path")).alias("dir")).distinct()


def topics(outline: DataFrame, batches: DataFrame) -> DataFrame:
    """topic, files: an outline's modules (topic, modules) joined with batches (name, files); missing ones are left out."""
    rows = outline.select("topic", F.posexplode("modules").alias("pos", "name")).join(batches, "name")
    return rows.groupBy("topic").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "files"))), lambda x: x["files"])).alias("files"))


def mentions(texts: DataFrame, files: DataFrame) -> DataFrame:
    """id, text with the contents of the files that #File:<path> names appended, last mention first."""
    found = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"#File:(\S+)"), F.lit(1))).alias("pos", "_path")).withColumn("path", paths.normal(F.col("_path")))
    fence = F.concat(F.lit("\n\n```"), paths.language(paths.ext(F.col("path"))), F.lit("\n"), F.col("_text"), F.lit("\n```"))
    joined = found.join(files.select("path", F.col("text").alias("_text")), "path").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", fence.alias("f"))), False), lambda x: x["f"]), "").alias("_more"))
    return texts.join(joined, "id", "left").select("id", F.concat("text", F.coalesce("_more", F.lit(""))).alias("text"))


def context_blocks(nodes: DataFrame, path: str) -> DataFrame:
    """path, block: a file as a fenced block, or every file below a directory as titled ones; path order is the text's order."""
    rows = nodes.where(~F.col("is_dir") & paths.under(F.col("path"), path))
    top = path.rstrip("/").rsplit("/", 1)[0]
    shown = F.substring(F.col("path"), F.lit(len(top) + 2), F.length("path"))
    fence = F.concat(F.lit("```"), paths.language(paths.ext(F.col("path"))), F.lit("\n"), "text", F.lit("\n```"))
    title = F.when(F.col("path") == path, "").otherwise(F.concat(F.lit("## "), shown, F.lit("\n\n")))
    return rows.select("path", F.concat(title, fence, F.lit("\n\n")).alias("block"))


def missing(nodes: DataFrame, names: str) -> list[str]:
    """Of a comma list of paths those that no node has; a dot always exists."""
    wanted = [x.strip() for x in names.split(",") if x.strip() not in ("", ".")]
    there = {r[0] for r in nodes.where(F.col("path").isin(["/" + x.strip("/") for x in wanted])).select("path").collect()} if wanted else set()
    return [x for x in wanted if "/" + x.strip("/") not in there]


def write_files(files: DataFrame, target: str) -> None:
    """Each row (path, text) as a file below target, a folder that all executors see; a repeated task writes the same again."""

    def run(rows):
        import os

        for row in rows:
            place = os.path.join(target, row["path"].lstrip("/"))
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(place + ".part", "w", encoding="utf-8", newline="") as f:
                f.write(row["text"] or "")
            os.replace(place + ".part", place)

    files.select("path", "text").foreachPartition(run)
