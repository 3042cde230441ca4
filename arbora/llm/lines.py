"""Line dedup by a log-template tree.

A line's place in the tree is fixed by its number of tokens and its first tokens, fields with digits masked. In a leaf, a
token that enough documents have at a position is constant, any other a variable field; lines whose constant tokens make
up enough of them share the template. What is enough is tried at several levels: a fixed number of documents, so that rare
templates beside frequent ones are seen, and shares of the leaf's documents, so that a field whose values are few against
the documents stays a field however many they are. Templates that recur in enough documents are dropped with all their
lines; for lines of more than LONG tokens two documents are enough in each step, as so long a line hardly recurs by chance.

Tokens, lines and rows are named by 64-bit hashes. Leaves with too few documents are pruned first; equal lines are merged
before their tokens are counted, so that a line that a third of all documents hold counts as few rows. Small leaves are
counted in one task, several at a time, large ones by sums over keys of their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import Scratch, field, mapped, renamed, text_bytes

#: Leading tokens that fix the place in the tree; documents that make a token constant and a template recurring; least share of constant tokens.
DEPTH, MIN_DOCS, SAME = 2, 3, 0.5
#: Shares of a leaf's documents that make a token constant, if they are more than the least number: one level each.
LEVELS = (0.0, 0.05, 0.3)
#: Lines of more tokens than LONG need LONG_DOCS documents only, or MIN_DOCS if that is less.
LONG, LONG_DOCS = 50, 2
#: Leaves that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000
#: Tokens in the lines of a leaf whose constants are counted in one task with other leaves, and tokens in such a task; larger leaves are dealt by token.
SMALL_LEAF, BUCKET = 1 << 20, 1 << 18
#: Bytes worked on at once; a longer text is taken whole.
CHUNK = 1 << 20

#: Classes of bytes: white space, line ends, digits.
SPACE, DIGIT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
DIGIT[48:58] = True
_RANDOM = np.random.default_rng(20240607)
BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
VARIABLE = np.uint64(0xD1B54A32D192ED03)  # a token with a digit
_POWERS = [np.ones(1, dtype=np.uint64)]


def powers(n: int) -> np.ndarray:
    """BASE to the power 0, 1, ..., mod 2 ** 64."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(n, CHUNK) - 1, BASE))])
    return _POWERS[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the tokens between white space, and their hashes, of a text that ends with white space."""
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    # a polynomial from a token's end, from sums over the whole text
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers(len(data)))])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    scale = _inverse(len(data), inverse)[starts]
    hashes = mix((sums[ends] - sums[starts]) * scale + (ends - starts).astype(np.uint64))
    digits = np.concatenate([[0], np.cumsum(DIGIT[data], dtype=np.int32)])
    hashes[digits[ends] > digits[starts]] = VARIABLE
    return starts, hashes


_INVERSE = [np.ones(1, dtype=np.uint64)]


def _inverse(n: int, base: np.uint64) -> np.ndarray:
    if len(_INVERSE[0]) < n:
        _INVERSE[0] = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(n, CHUNK) - 1, base))])
    return _INVERSE[0][:n]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Row, number of the first line, and bytes: whole texts, and long ones cut at line ends."""
    for row, text in enumerate(texts):
        a, line = 0, 0
        while len(text) - a > CHUNK:
            end = text.rfind(b"\n", a, a + CHUNK)
            end = text.find(b"\n", a + CHUNK) if end < 0 else end
            if end < 0:
                break
            yield row, line, text[a:end]
            line += text.count(b"\n", a, end + 1)
            a = end + 1
        yield row, line, text[a:] if a else text


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each line with tokens, token counts, and token hashes."""
    out, part, size = [], [], 0

    def close() -> None:
        data = np.frombuffer(b"\n".join([*(x for _, _, x in part), b""]), dtype=np.uint8)
        at = np.cumsum([0, *(len(x) + 1 for _, _, x in part)])
        starts, hashes = tokens_of(data)
        ends = np.flatnonzero(data == 10)
        line = np.searchsorted(ends, starts)  # the line ends before a token
        own, first, counts = np.unique(line, return_index=True, return_counts=True)
        piece = np.searchsorted(at, starts[first], "right") - 1
        number = own - np.searchsorted(ends, at[piece]) + np.array([x for _, x, _ in part])[piece]
        out.append((np.array([x for x, _, _ in part])[piece], number.astype(np.int32), counts, hashes))

    for piece in _pieces(texts):
        if part and size + len(piece[2]) > CHUNK:
            close()
            part, size = [], 0
        part.append(piece)
        size += len(piece[2])
    if part:
        close()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(counts: np.ndarray, tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, leaf hashes and hashes of whole lines."""
    starts = np.cumsum(counts) - counts
    leaf = mix(counts.astype(np.uint64))
    for j in range(depth):
        leaf = mix(leaf + np.where(counts > j, tokens[np.minimum(starts + j, len(tokens) - 1)] + np.uint64(1 + j), np.uint64(0)))
    place = (np.arange(len(tokens)) - np.repeat(starts, counts)).astype(np.uint64)
    line = mix(np.add.reduceat(mix(tokens + place * BASE), starts) + counts.astype(np.uint64))
    return starts, leaf.view(np.int64), line.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], depth: int):
    """Batch, its first row, and rows from there, numbers, counts, tokens, keys of the lines, for some bytes at a time."""
    for batch in batches:
        data, at, _ = text_bytes(batch.column("text"))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1)
            rows, numbers, counts, tokens = _lines([bytes(data[at[i] : at[i + 1]]) for i in range(a, b)])
            if len(counts):
                yield batch, a, rows, numbers, counts, tokens, _keys(counts, tokens, depth)
            a = b


def find(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, same: float = SAME) -> DataFrame:
    """doc_id, _row (a hash of the text), line (from 0), for each line to be dropped.

    Documents are rows: repeated rows count as several, and so do rows with a null doc_id. Lines without tokens belong to no
    template. Null and empty texts have no lines, and an empty table gives no rows. Ties can't arise: a template is dropped or
    not. A task holds CHUNK bytes of texts, or one longer text, and some 40 times that for its hashes.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    texts = docs.select("doc_id", "text", _row_key())

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, _, counts, _, keys in _chunks(batches, depth):
            once, at = np.unique(np.stack([rows, keys[1]], axis=1), axis=0, return_index=True)  # a document counts once
            found, first, n = np.unique(once[:, 1], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[at][first]), pa.array(n.astype(np.int64))], names=["leaf", "size", "n"])

    enough = F.when(F.col("long"), min(min_docs, LONG_DOCS)).otherwise(min_docs)  # a leaf's lines have one length
    leaf = T.StructType([field("leaf", T.LongType()), field("size", T.LongType()), field("n", T.LongType())])
    common = mapped(texts.select("text"), leaves, leaf).groupBy("leaf").agg(F.first("size").alias("size"), F.sum("n").alias("_docs"))
    common = scratch.table(common.withColumn("long", F.col("size") > LONG).where(F.col("_docs") >= enough).drop("long"), "leaves")
    schema = T.StructType([texts.schema["doc_id"], texts.schema["_row"], field("line", T.IntegerType()), field("leaf", T.LongType()), field("hash", T.LongType()), field("docs", T.LongType()), field("tokens", T.ArrayType(T.LongType()))])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, rows, numbers, counts, tokens, (starts, leaf_keys, line_keys) in _chunks(batches, depth):
            # of equal lines one carries the tokens and the number of documents
            once = np.unique(np.stack([rows, line_keys], axis=1), axis=0)[:, 1]
            first, n = np.unique(once, return_counts=True)
            at = np.unique(line_keys, return_index=True)[1]  # in the order of first
            shown, docs = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), np.int64)
            shown[at], docs[at] = True, n
            offsets = np.concatenate([[0], np.cumsum(np.where(shown, counts, 0))]).astype(np.int32)
            flat = pa.array(tokens[np.repeat(shown, counts)].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~shown))
            take = pa.array(rows + a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("_row").take(take), pa.array(numbers), pa.array(leaf_keys), pa.array(line_keys), pa.array(docs), lists], names=schema.names)

    few = common.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    kept = common.select("leaf", "_docs")
    met = scratch.table(mapped(texts, lines, schema).join(F.broadcast(kept) if few else kept, "leaf"), "lines")
    shown = met.where("tokens IS NOT NULL").select("hash", "leaf", "_docs", "docs", "tokens")
    small = F.col("_docs") * F.size("tokens") <= SMALL_LEAF  # a leaf's lines have one size
    plan = common.agg(F.sum(F.least(F.col("_docs") * F.col("size"), F.lit(SMALL_LEAF)))).first()[0] or 0
    templates = _templates_by_leaf(shown.where(small), int(plan // BUCKET) + 1, depth, min_docs, same)
    templates = scratch.table(templates.unionByName(_templates_by_key(shown.where(~small), scratch, depth, min_docs, same)), "templates")
    placed = met.select("doc_id", "_row", "line", "hash").join(templates, "hash")
    # the table of lines says which rows hold a template; repeated rows hold each line as often
    per_row = placed.groupBy("template", "doc_id", "_row", "line").agg(F.first("long").alias("long"), F.count(F.lit(1)).alias("rows")).groupBy("template", "doc_id", "_row").agg(F.first("long").alias("long"), F.max("rows").alias("rows"))
    recurring = per_row.groupBy("template").agg(F.first("long").alias("long"), F.sum("rows").alias("n")).where(F.col("n") >= enough).select("template")
    recurring = scratch.table(recurring, "recurring")  # written, so that a frequent template's lines can be split in the join
    gone = scratch.table(templates.join(recurring, "template", "left_semi").select("hash").distinct(), "gone")
    return met.select("doc_id", "_row", "line", "hash").join(gone, "hash", "left_semi").select("doc_id", "_row", "line")


TEMPLATE = T.StructType([field("hash", T.LongType()), field("long", T.BooleanType()), field("template", T.LongType())])


def _templates_by_leaf(shown: DataFrame, buckets: int, depth: int, min_docs: int, same: float) -> DataFrame:
    """hash, long, template of the lines of leaves of at most SMALL_LEAF tokens, as many leaves in a task as have BUCKET tokens or so.

    Rows: hash, leaf, _docs (of the leaf), docs (that hold the line, a part of them in each row), tokens.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        codes, first, line = np.unique(table.column("hash").to_numpy(), return_index=True, return_inverse=True)
        docs = np.bincount(line, table.column("docs").to_numpy()).astype(np.int64)
        table = table.take(pa.array(first))
        leaf, of_leaf, lists = table.column("leaf").to_numpy(), table.column("_docs").to_numpy(), table.column("tokens").combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        tokens = lists.flatten().to_numpy().view(np.uint64)
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(codes)), size)
        place = np.arange(len(tokens)) - starts[owner]
        keys = mix(mix(leaf.view(np.uint64)[owner] + place.astype(np.uint64) * BASE) + tokens)
        _, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, docs[owner]).astype(np.int64)[at]
        least = np.where(size > LONG, min(min_docs, LONG_DOCS), min_docs)
        out, plain = [], None
        for share in LEVELS:
            constant = n >= np.maximum(least, share * of_leaf)[owner]
            kept = np.add.reduceat(constant, starts, dtype=np.int64)
            fits = kept >= same * size
            if plain is None:
                plain = fits
            else:  # beyond the first tokens, which a leaf's lines share, enough must be constant too
                fits &= (size > depth) & (np.add.reduceat(constant & (place >= depth), starts, dtype=np.int64) >= same * (size - depth))
            names = mix(np.add.reduceat(np.where(constant, mix(keys), np.uint64(0)), starts) + leaf.view(np.uint64))
            out.append((codes[fits], size[fits] > LONG, names[fits].view(np.int64)))
        out.append((codes[~plain], size[~plain] > LONG, mix(codes[~plain].view(np.uint64)).view(np.int64)))  # too few constant tokens: the line for itself
        found = np.stack([np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(3)], axis=1)
        found = np.unique(found, axis=0)
        return pa.table({"hash": found[:, 0], "long": found[:, 1].astype(bool), "template": found[:, 2]})

    bucket = F.pmod(F.xxhash64(F.col("leaf"), F.lit("bucket")), F.lit(buckets)).cast("int")
    return shown.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, TEMPLATE)


def _templates_by_key(shown: DataFrame, scratch: Scratch, depth: int, min_docs: int, same: float) -> DataFrame:
    """The same for leaves of any size: tokens are dealt by leaf, position and token, and only keys and line hashes."""
    if shown.isEmpty():
        return shown.select("hash", F.lit(False).alias("long"), F.col("leaf").alias("template")).limit(0)
    enough = F.when(F.col("long"), min(min_docs, LONG_DOCS)).otherwise(min_docs)
    distinct = shown.groupBy("hash").agg(F.first("leaf").alias("leaf"), F.first("_docs").alias("_docs"), F.first("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    distinct = scratch.table(distinct, "distinct")
    keys = F.transform("tokens", lambda t, i: F.xxhash64(F.col("leaf"), i, t))
    long = F.size("tokens") > LONG
    each = distinct.select("hash", "docs", "_docs", long.alias("long"), F.posexplode(keys).alias("place", "key"))
    count = each.groupBy("key").agg(F.first("long").alias("long"), F.first("_docs").alias("_docs"), F.sum("docs").alias("n")).where(F.col("n") >= enough)
    # the highest level at which a token is constant
    level = sum((F.col("n") >= share * F.col("_docs")).cast("int") for share in LEVELS)
    kept = each.select("hash", "place", "key").join(count.select("key", level.alias("level")), "key").groupBy("hash").agg(F.collect_list(F.struct("key", "place", "level")).alias("kept"))
    none = F.array().cast("array<struct<key:bigint,place:int,level:int>>")
    rows = distinct.join(kept, "hash", "left").select("hash", "leaf", F.size("tokens").alias("size"), long.alias("long"), F.coalesce("kept", none).alias("kept"))
    at_level = [F.expr(f"filter(kept, x -> x.level >= {n})") for n in range(1, len(LEVELS) + 1)]
    template = [F.xxhash64("leaf", F.array_sort(F.transform(x, lambda y: y["key"]))) for x in at_level]
    body = [F.size(F.filter(x, lambda y: y["place"] >= depth)) for x in at_level]
    fits = [F.size(at_level[0]) >= same * F.col("size"), *[(F.size(x) >= same * F.col("size")) & (F.col("size") > depth) & (b >= same * (F.col("size") - depth)) for x, b in zip(at_level[1:], body[1:], strict=True)]]
    alone = F.when(~fits[0], F.xxhash64("hash", F.lit("own")))
    ids = F.array_distinct(F.array_compact(F.array(alone, *[F.when(ok, x) for ok, x in zip(fits, template, strict=True)])))
    return rows.select("hash", "long", F.explode(ids).alias("template"))


def _row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_row")


def _by_row(docs: DataFrame, **options) -> DataFrame:
    """_doc, _found (hash of the text), _lines (sorted numbers of the lines to be dropped)."""
    found = find(docs, **options).distinct()
    return found.groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_found")).agg(F.array_sort(F.collect_list("line")).alias("_lines"))


def dropped(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0) for each row; find() tells what becomes of odd rows."""
    docs, _ = renamed(docs, "doc_id", "text")
    n_lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    rows = docs.select("doc_id", _row_key(), n_lines.alias("n_lines"))
    joined = rows.join(_by_row(docs, **options), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_found")), "left")
    lines = F.coalesce("_lines", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(lines).alias("n_dropped"), lines.alias("dropped"))


def clean(docs: DataFrame, **options) -> DataFrame:
    """docs with the dropped lines taken out of text; rows and other columns stay."""
    own, back = renamed(docs, "doc_id", "text")
    joined = own.join(_by_row(own, **options), F.col("doc_id").eqNullSafe(F.col("_doc")) & (_row_key() == F.col("_found")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    return back(joined.withColumn("text", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dropped() of all documents, the line numbers as text."""
    return dropped(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("dropped", F.array_join("dropped", ","))


_LEAST = f"CASE WHEN len(w) > {LONG} THEN {min(MIN_DOCS, LONG_DOCS)} ELSE {MIN_DOCS} END"
_LEVEL = " UNION ALL ".join(
    f"SELECT w, k, {i} AS level, string_agg(p || ':' || t, chr(1) ORDER BY p) FILTER (c) AS name, count(*) FILTER (c) >= {SAME} * any_value(len(w)){f' AND any_value(len(w)) > {DEPTH} AND count(*) FILTER (c AND p > {DEPTH}) >= {SAME} * (any_value(len(w)) - {DEPTH})' if i else ''} AS fits FROM (SELECT *, n >= greatest({_LEAST}, {share} * docs) AS c FROM token) GROUP BY w, k"
    for i, share in enumerate(LEVELS)
)
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS s FROM (SELECT r, string_split(text, chr(10)) AS x FROM d WHERE text <> '')),
t AS (SELECT r, line, list_transform(regexp_extract_all(s, '[^ 	-]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
k AS (SELECT *, len(w) || chr(1) || array_to_string(w[1:{DEPTH}], chr(1)) AS k FROM t WHERE len(w) > 0),
leaf AS (SELECT k, count(DISTINCT r) AS docs FROM k GROUP BY k),
met AS (SELECT k.*, docs FROM k JOIN leaf USING (k) WHERE docs >= {_LEAST}),
once AS (SELECT w, k, any_value(docs) AS docs, count(DISTINCT r) AS held FROM met GROUP BY w, k),
each AS (SELECT w, k, docs, held, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM once),
token AS (SELECT *, sum(held) OVER (PARTITION BY k, p, t) AS n FROM each),
level AS ({_LEVEL}),
template AS (SELECT w, k, level || chr(2) || k || chr(2) || name AS template FROM level WHERE fits UNION ALL SELECT w, k, 'own' || chr(2) || array_to_string(w, chr(1)) FROM level WHERE level = 0 AND NOT fits),
recurring AS (SELECT template FROM template JOIN met USING (w, k) GROUP BY template HAVING count(DISTINCT r) >= any_value({_LEAST})),
gone AS (SELECT DISTINCT w, k FROM template JOIN recurring USING (template)),
drop_ AS (SELECT r, count(*)::INTEGER AS n, string_agg(line, ',' ORDER BY line) AS lines FROM met JOIN gone USING (w, k) GROUP BY r)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE strlen(text) - strlen(replace(text, chr(10), '')) + 1 END::INTEGER AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(lines, '') AS dropped FROM d LEFT JOIN drop_ USING (r)
"""
