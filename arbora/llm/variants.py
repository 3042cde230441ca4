"""Spelling variants: words one code point apart, found by two-dimensional range reporting over wavelet trees.

A word with one code point replaced or deleted at a place keeps the prefix before it and the suffix behind it. Among the words
of one length, those with the prefix are an interval of the words in forward order, those with the suffix an interval of the
words in the order of their reversed spelling; the words with both are the points of a rectangle, which a wavelet tree over the
second order's ranks, stored in the first order, reports. Words that another has by deletion have it by insertion.

A dictionary that exceeds one task is dealt by windows of places: the places of a length are halved, and words meet in a bundle
if they agree outside a window, which is all that a change inside it leaves alone. A bundle that is still too large is
dealt again by halves of its windows, down to a single place, where words that agree elsewhere are as many as the alphabet has
letters. So no prefix, length or suffix has to fit a task, and every pair of words meets in exactly one bundle for each place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import CRC_SQL, Scratch, crc32_sql, field, give_back, mapped, small_batches

#: A word's least length in code points, its least number of occurrences, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Runs whose crc32 this divides lose a code point.
MODULUS = 199
#: Letters of the words in a bundle and 16 more for each word: what one task indexes at a time.
BUNDLE = 1 << 20
#: Rectangles that a tree is asked for at once.
RECTANGLES = 1 << 17
#: Distinct words that a task gathers before it gives their counts away, and bytes of a text that are cut into words at once.
GATHERED, SLICE = 200_000, 1 << 20

#: Bytes of Latin-1: letters in lower case (A-Z only), all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of [A-Za-zÀ-ÿ] as Latin-1, A-Z in lower case, a slice of the text at a time."""
    data = text.encode("latin-1", "replace").translate(LETTERS)  # what Latin-1 lacks is no letter here
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """word, n: runs of letters over whole texts, of which each whose crc32 of `<doc_id>:<run>` modulus divides has lost a code point.

    Words of fewer than least_length code points or least_count occurrences over all rows are left out. A null text has no
    words, a null doc_id is an empty string in the crc32, rows with equal doc_id and text each count. Counts are added up in
    tasks before they are shuffled, so no word's occurrences meet in one.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([field("word", T.StringType()), field("n", T.LongType())])

    def give(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.decode("latin-1") for x in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        crc32 = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs(text.as_py() or ""):
                    for word, n in Counter(found).items():
                        if len(word) < least_length:
                            continue
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if not h % modulus:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < least_length:
                                continue
                        total[word] = total.get(word, 0) + n
                    if len(total) > GATHERED:
                        yield give(total)
                        total = {}
        if total:
            yield give(total)

    each = mapped(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A permutation of 0 to n - 1, level by level from the highest bit: how many ones stand before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectangle and value of each point with a place in [left, right) and a value in [low, high), for all rectangles at once."""
        which, base = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            before, after, zeros = self.ones[level][left], self.ones[level][right], self.zeros[level]
            which, base = np.concatenate([which, which]), np.concatenate([base, base + (1 << bit)])
            left, right = np.concatenate([left - before, zeros + before]), np.concatenate([right - after, zeros + after])
            some = np.flatnonzero((left < right) & (base < high[which]) & (base + (1 << bit) > low[which]))
            which, base, left, right = which[some], base[some], left[some], right[some]
        return which, base


def intervals(rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each depth up to the width of rows (sorted): where those with the asked row's first letters begin and end."""
    n, width = rows.shape
    low, high = np.zeros((width + 1, len(asked)), dtype=np.int32), np.zeros((width + 1, len(asked)), dtype=np.int32)
    high[0] = n
    start = np.zeros(n, dtype=np.int64)  # where the rows begin that share a row's first letters
    for d in range(width):
        keys = start << 21 | rows[:, d]
        wanted = np.where(low[d] < high[d], low[d], n).astype(np.int64) << 21 | asked[:, d]
        low[d + 1], high[d + 1] = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        start = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), np.arange(n), 0))
    return low, high


def sort_rows(letters: np.ndarray) -> np.ndarray:
    """The order of rows of code points."""
    return np.argsort(np.ascontiguousarray(letters).view(f"<U{letters.shape[1]}").ravel(), kind="stable")


def near_pairs(own: np.ndarray, longer: np.ndarray, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of words one code point apart at a place of first to end - 1, as places in own or longer and in own; True: of a longer word.

    own: code points of words of one length m, a row a word; longer: of words of length m + 1. A replacement is reported from
    both sides, a deletion once: of equal letters in a row the first is deleted. The end of a longer word belongs to the last place.
    """
    n, m = own.shape
    forward = sort_rows(own)
    mirrored = np.ascontiguousarray(own[:, ::-1])
    backward = sort_rows(mirrored)
    rank = np.empty(n, dtype=np.int64)
    rank[backward] = np.arange(n)
    tree, ahead, behind = WaveletTree(rank[forward]), own[forward], mirrored[backward]
    for asked, deleted in ((own, False), (longer, True)):
        if not len(asked):
            continue
        low, high = intervals(ahead, asked)
        below, above = intervals(behind, np.ascontiguousarray(asked[:, ::-1]))
        for i in range(first, end + (deleted and end == m)):
            rest = m - i if deleted else m - 1 - i  # letters of the suffix
            much = 0 if deleted else 1  # a word itself is in its rectangles of replacements
            some = (high[i] - low[i] > much) & (above[rest] - below[rest] > much)
            if deleted and i:
                some &= asked[:, i] != asked[:, i - 1]
            some = np.flatnonzero(some)
            for at in range(0, len(some), RECTANGLES):
                part = some[at : at + RECTANGLES]
                which, value = tree.report(low[i][part].astype(np.int64), high[i][part].astype(np.int64), below[rest][part], above[rest][part])
                source, found = part[which], backward[value]
                if not deleted:
                    source, found = source[source != found], found[source != found]
                yield source, found, deleted


NEAR = T.StructType([field("word", T.StringType()), field("n_near", T.LongType()), field("near_n", T.LongType()), field("near", T.StringType())])


def near_words(bundle: pa.Table) -> pa.Table:
    """Of each word of a bundle with near ones: their number, and of the most frequent its n and spelling (of equal ones the least)."""
    words, n = bundle.column("word").to_pylist(), bundle.column("n").to_numpy()
    spelled = {w: i for i, w in enumerate(sorted(set(words)))}
    word = np.array([spelled[w] for w in words])
    kinds = np.stack([bundle.column(x).to_numpy() for x in ("length", "first", "end")], axis=1).astype(np.int64)
    points = lambda rows, width: np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(rows), width)
    sources, others = [], []
    for m, first, end in np.unique(kinds, axis=0).tolist():
        rows = np.flatnonzero((kinds == (m, first, end)).all(axis=1))
        long = np.array([len(words[i]) > m for i in rows])
        own, longer = rows[~long], rows[long]
        if not len(own) or len(rows) < 2:
            continue
        for a, b, deleted in near_pairs(points(own, m), points(longer, m + 1), first, end):
            a, b = (longer if deleted else own)[a], own[b]
            sources += [a, b] if deleted else [a]
            others += [b, a] if deleted else [b]
    give_back()
    if not sum(map(len, sources)):
        return pa.Table.from_pylist([], schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())]))
    a, b = np.concatenate(sources), np.concatenate(others)
    order = np.lexsort((word[b], -n[b], word[a]))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], word[a][1:] != word[a][:-1]]))
    counts = np.diff(np.append(new, len(a)))
    return pa.table([pa.array([words[i] for i in a[new]], pa.string()), pa.array(counts.astype(np.int64)), pa.array(n[b[new]].astype(np.int64)), pa.array([words[i] for i in b[new]], pa.string())], names=NEAR.names)


def _outside(word: Column, length: Column, first: Column, end: Column) -> Column:
    """What a word of that length, or one longer by a code point inside the window, has outside of it."""
    return F.concat(F.substring(word, F.lit(1), first), F.lit("/"), F.substring(word, F.length(word) - (length - end) + 1, length - end))


def _dealt(items: DataFrame, bundles: int, salt: int) -> DataFrame:
    """Items with the bundle in which those meet that agree outside their window."""
    key = F.xxhash64("length", "first", "end", _outside(F.col("word"), F.col("length"), F.col("first"), F.col("end")), F.lit(salt))
    return items.withColumn("bundle", F.struct(F.lit(salt).alias("salt"), F.pmod(key, F.lit(bundles)).alias("at")))


def _halved(items: DataFrame) -> DataFrame:
    """Items for each half of their windows; those of one place stay."""
    middle = (F.col("first") + F.col("end")).cast("int") / 2
    halves = F.array(F.struct(F.col("first"), F.floor(middle).cast("int").alias("end")), F.struct(F.floor(middle).cast("int").alias("first"), F.col("end")))
    whole = F.array(F.struct("first", "end"))
    return items.withColumn("_w", F.explode(F.when(F.col("end") - F.col("first") > 1, halves).otherwise(whole))).select("word", "n", "length", F.col("_w.first").alias("first"), F.col("_w.end").alias("end"))


def near_counts(words: DataFrame, scratch: Scratch) -> DataFrame:
    """NEAR for the words (word, n) that have near ones; each bundle gives a row for each of its words, which are added up."""
    length = F.length("word")
    places = F.array(length, length - 1)  # a word among those of its own length, and a longer one among those shorter by one
    items = words.where(length > 0).select("word", "n", F.explode(places).alias("length")).where("length > 0").withColumns({"first": F.lit(0), "end": F.col("length")})
    weight = F.sum(16 + F.length("word"))
    total = items.agg(weight.alias("w")).first()["w"] or 0
    now = _dealt(items, 1, 0) if total <= BUNDLE else _dealt(_halved(items), 2 * -(-2 * total // BUNDLE), 1)
    done, salt = [], 1
    while True:
        now = scratch.table(now, "items")
        sums = now.groupBy("bundle").agg(weight.alias("w"), F.max(F.col("end") - F.col("first")).alias("widest"))
        large = scratch.table(sums.where((F.col("w") > BUNDLE) & (F.col("widest") > 1)).select("bundle", "w"), "large")
        left = large.agg(F.sum("w").alias("w")).first()["w"]
        if not left:
            done.append(now)
            break
        salt += 1
        done.append(now.join(large, "bundle", "left_anti"))
        now = _dealt(_halved(now.join(large, "bundle", "left_semi")), 2 * -(-2 * left // BUNDLE), salt)
    items = done[0]
    for more in done[1:]:
        items = items.unionByName(more)
    each = scratch.table(items.groupBy("bundle").applyInArrow(near_words, NEAR), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", (-F.col("_best.n")).alias("near_n"), F.col("_best.word").alias("near"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for words with a form (word, form): forms followed to the last, twice as far in each round.

    Each form is more frequent than the word by a factor, so there is no cycle and the way is short.
    """
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        after = scratch.table(now.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        scratch.drop(now)
        now = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, factor: float = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words (word, n), a row each.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    of largest n (of equal ones the least in code-point order) if that n is factor times its own n or more, else null; its
    root is where forms lead at last, itself without a form. factor must be more than 1. n_near: its near words, 0 if none.
    Any code points are taken as they are; rows with a null or empty word or a null n are left out, other columns ignored,
    and an empty table gives no rows.
    """
    if factor <= 1:
        raise ValueError("factor must be more than 1")
    scratch = Scratch(words.sparkSession, "variants")
    words = scratch.table(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).dropna().where("word <> ''"), "words")
    return _variants(words, factor, scratch)


def _variants(words: DataFrame, factor: float, scratch: Scratch) -> DataFrame:
    close = F.col("near_n") >= factor * F.col("n")
    own = scratch.table(words.join(near_counts(words, scratch), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("near")).alias("form"), F.when(close, F.col("near_n")).alias("form_n")), "forms")
    last = roots(own.where("form is not null"), scratch)
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spelling_variants() of the word_counts() of all documents."""
    return spelling_variants(word_counts(spark.read.parquet(str(sf_dir) + "/documents.parquet")))


OP11_SQL = rf"""
with recursive {CRC_SQL},
runs as (
  select doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) k
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) x from documents) where length(x) >= 6 group by all),
hashed as (select run, k, {crc32_sql("s")} h from (select run, k, coalesce(doc_id::varchar, '') || ':' || run s from runs), crc),
words as (
  select word, sum(k)::bigint n from (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, k from hashed)
  where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, i, left(word, i - 1) || substr(word, i + 1) rest from (select word, unnest(range(1, length(word) + 1)) i from words)),
near as (
  select a.word, b.word other from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union all select distinct c.word, w.word from cut c join words w on c.rest = w.word
  union all select distinct w.word, c.word from cut c join words w on c.rest = w.word),
best as (select near.word, count(*) n_near, max(o.n) most, arg_min(other, (-o.n, other)) other from near join words o on o.word = near.other group by near.word),
forms as (select w.word, w.n, coalesce(n_near, 0) n_near, case when most >= 5 * w.n then other end form, case when most >= 5 * w.n then most end form_n from words w left join best using (word)),
way(word, root, d) as (select word, word, 0 from forms union all select way.word, f.form, d + 1 from way join forms f on f.word = way.root where f.form is not null)
select word, form, (select arg_max(root, d) from way where way.word = forms.word) as root, n, n_near, form_n from forms
"""

__all__ = ["word_counts", "spelling_variants", "near_counts", "WaveletTree"]
