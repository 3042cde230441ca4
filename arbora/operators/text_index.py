"""An index of texts by their trigrams: content search that reads the texts that may match, and no others.

A text that holds a literal holds each of its trigrams. Of a pattern the literals are taken that every match must hold, in
alternatives where it branches; texts that hold the rarest trigrams of one of them are candidates, and the pattern itself decides
on their whole text. Patterns that force no three characters in a row are matched against all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.search import text_match
from arbora.sources import shared

#: Rarest trigrams of an alternative that are looked up, alternatives of a pattern beyond which all texts are read.
GRAMS, ALTERNATIVES = 4, 16
#: Candidates up to this number become a condition on the stored rows; more are joined. Texts of a folder of the stored ones.
LISTED, TEXTS = 10_000, 20_000
#: Candidates up to this number are sent to all tasks that read texts.
SENT = 1_000_000
#: Folders of postings, each with the trigrams of one remainder. Bytes of text whose postings are found together.
BUCKETS, BLOCK = 16, 2 << 20
#: What case folding maps into ASCII letters.
FOLDED = {"K": "k", "ſ": "s", "ı": "i", "İ": "i"}


def folded(text: str) -> bytes:
    """A text whose trigrams tell both searches that mind case and those that don't; each character by itself."""
    if not text.isascii():
        for char, plain in FOLDED.items():  # far faster than translate(), which looks each character up
            text = text.replace(char, plain)
    return text.encode("utf-8", "surrogatepass").lower()


def trigrams(data: bytes) -> np.ndarray:
    """The different runs of three bytes, as numbers."""
    x = np.frombuffer(data, np.uint8).astype(np.int32)
    return np.unique(x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else np.empty(0, np.int32)


def bucket(gram):
    """The folder of a trigram, or of an array of them: neighbours lie apart."""
    return (gram * 40_503 >> 8) % BUCKETS


def grouped(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a trigram and a text (its place in the list), in order of both; texts together some BLOCK, or one longer."""
    if len(texts) == 1:  # in pieces, as the numbers of all its runs may be many times the text
        found = np.unique(np.concatenate([trigrams(texts[0][at : at + BLOCK + 2]) for at in range(0, max(len(texts[0]), 1), BLOCK)]))
        return found.astype(np.int64), np.zeros(len(found), np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keys = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) << 32 | owner[2:])[owner[2:] == owner[:-2]]
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]
    return keys >> 32, keys & 0xFFFFFFFF


def postings(texts: list[bytes], docs: np.ndarray) -> pa.RecordBatch:
    """A row for each trigram of the texts, with the docs that hold it."""
    gram, owner = grouped(texts)
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
    at = np.append(first, len(gram))
    held = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(docs[owner]))
    return pa.RecordBatch.from_arrays([pa.array(bucket(gram[first]).astype(np.int32)), pa.array(gram[first].astype(np.int32)), pa.array(np.diff(at)), held], names=["bucket", "gram", "n", "docs"])


def literals(pattern: str, ignore_case: bool = False) -> list[set[str]]:
    """Alternatives of literals: each match of the pattern holds all literals of one of them. An empty set: nothing is known."""
    try:
        parsed = re._parser.parse(re.sub(r"\\z", r"\\Z", pattern), re.IGNORECASE if ignore_case else 0)
    except (re.error, OverflowError, RecursionError):
        return [set()]
    kinds = re._constants
    fold = bool(parsed.state.flags & re.IGNORECASE)

    def both(a: list[set[str]], b: list[set[str]]) -> list[set[str]]:
        """What must hold if both must; what is known of one is enough where the other has too many alternatives."""
        if len(a) * len(b) > ALTERNATIVES:
            return min(a, b, key=lambda x: (not all(x), len(x)))
        return [x | y for x in a for y in b]

    def walk(items) -> list[set[str]]:
        out, run = [set()], ""

        def close() -> None:
            nonlocal out, run
            if len(run.encode()) > 2:
                out = both(out, [{run}])
            run = ""

        for kind, value in items:
            if kind is kinds.LITERAL and not (fold and value > 127):
                run += chr(value)
                continue
            close()
            if kind is kinds.SUBPATTERN:
                out = both(out, walk(value[-1]) if not value[1] and not value[2] else [set()])
            elif kind is kinds.BRANCH:
                ways = [w for x in value[1] for w in walk(x)]
                out = both(out, ways if len(ways) <= ALTERNATIVES else [set()])
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                out = both(out, walk(value[2]))
        close()
        return out

    return walk(parsed)


def build(docs: DataFrame, path: str) -> TextIndex:
    """Stores docs (path, text) with their trigrams under `path`: postings in folders by a hash of the trigram and in its order, texts in folders by a hash of their path.

    Rows with a null text hold nothing and are left out; of repeated paths each row counts; a null path is one more path. Each text's trigrams are found in one
    pass and once each; what a task finds in BLOCK bytes of text is a row for each trigram with a list of docs, so rows to be dealt and
    sorted are few. A trigram that most texts hold has many such rows, which are dealt by trigram folder and by a doc of theirs. Counts are
    written last: without them there is no index.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select("path", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("doc", F.xxhash64("path"))
    folders = max(1, docs.count() // TEXTS)  # those with a null text too, as a count of all rows reads no text
    dealt = rows.withColumn("folder", F.pmod("doc", F.lit(folders)).cast("int")).repartition("folder", F.pmod("doc", F.lit(97))).sortWithinPartitions("folder", "doc")
    dealt.write.partitionBy("folder").option("parquet.block.size", 8 << 20).parquet(f"{path}/texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs_, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                text = folded(text.as_py())
                if texts and size + len(text) > BLOCK:
                    yield postings(texts, np.array(docs_, np.int64))
                    texts, docs_, size = [], [], 0
                texts.append(text)
                docs_.append(doc)
                size += len(text)
        if texts:
            yield postings(texts, np.array(docs_, np.int64))

    index = TextIndex(spark, path)
    grams = index.texts().select("doc", "text").mapInArrow(run, "bucket int, gram int, n long, docs array<long>")
    dealt = grams.repartition("bucket", F.pmod(F.col("docs")[0], F.lit(1 + folders // 2))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{path}/grams")
    shared.created(spark, f"{path}/folders", str(folders))
    index.stored().groupBy("gram").agg(F.sum("n").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return index


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: Of the last search: texts that it read, or None for all.
        self.candidates: int | None = None

    def texts(self) -> DataFrame:
        return self.spark.read.schema("path string, text string, doc long, folder int").parquet(f"{self.path}/texts")

    def stored(self) -> DataFrame:
        return self.spark.read.schema("gram int, n long, docs array<long>, bucket int").parquet(f"{self.path}/grams")

    def postings(self, wanted: list[int]) -> DataFrame:
        """gram, doc of some trigrams; other folders, and row groups without them, are not read."""
        rows = self.stored().where(F.col("bucket").isin(sorted({bucket(g) for g in wanted})) & F.col("gram").isin(wanted))
        return rows.select("gram", F.explode("docs").alias("doc"))

    def _rarest(self, ways: list[set[str]]) -> list[list[int]] | None:
        """The rarest trigrams of each alternative; one without any text is left out. None: an alternative has no trigram."""
        own = [sorted({int(g) for x in way for g in trigrams(folded(x))}) for way in ways]
        if not all(own):
            return None
        wanted = sorted({g for x in own for g in x})
        known = {r.gram: r.n for r in self.spark.read.schema("gram int, n long").parquet(f"{self.path}/counts").where(F.col("gram").isin(wanted)).collect()}
        return [sorted(x, key=lambda g: known[g])[:GRAMS] for x in own if all(g in known for g in x)]

    def _holding(self, ways: list[list[int]]) -> DataFrame:
        """doc, _all (true) of texts that hold all trigrams of one of the alternatives."""
        rows = self.postings(sorted({g for x in ways for g in x}))
        has = lambda g: F.max(F.col("gram") == g)
        any_way = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(g) for g in x]) for x in ways])
        return rows.groupBy("doc").agg(any_way.alias("_all")).where("_all")

    def search(self, content: str | None = None, regex: str | None = None, ignore_case: bool = False) -> DataFrame:
        """path, text of the texts that hold a substring or match a pattern (the pattern wins), as search.search() finds them."""
        test = text_match(F.col("text"), content, regex, ignore_case)
        if test is None:
            raise ValueError("neither a substring nor a pattern is given")
        plain = lambda x: {y for y in (re.split(r"[^\x00-\x7f]", x) if ignore_case else [x]) if len(y.encode()) > 2}
        ways = self._rarest(literals(regex, ignore_case) if regex else [plain(content or "")])
        rows, self.candidates = self.texts(), None
        if ways is not None:
            if not ways:
                rows, self.candidates = rows.limit(0), 0
            else:
                found = shared.written(self._holding(ways), f"{shared.fresh(self.spark, 'found')}/docs")
                self.candidates = found.count()
                if self.candidates <= LISTED:
                    ids = [r.doc for r in found.collect()]
                    folders = int(shared.text_of(self.spark, f"{self.path}/folders"))
                    rows = rows.where(F.col("folder").isin(sorted({i % folders for i in ids})) & F.col("doc").isin(ids))
                else:
                    rows = rows.join(F.broadcast(found) if self.candidates <= SENT else found, "doc")
                    test = F.when(F.col("_all"), test)  # without a column of both sides, all texts are matched before the join
        return rows.where(test).select("path", "text")
