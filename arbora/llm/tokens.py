"""Token ids as Parquet list columns, in document order, with dictionary encoding, bounded row groups and page indexes."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import Scratch, field, held, mapped, small_batches

VOCABULARY = "byte_bpe_50k.json"
#: Pieces of a generation that a Python worker remembers over all tasks that it runs, two at a time and some 200 bytes each, and letters of the longest.
MEMO, LONGEST = 500_000, 32
#: Bytes of a row group and rows of a page: a read of few documents touches few pages.
ROW_GROUP, PAGE_ROWS = 32 << 20, 2_000

FILE = T.StructType([field("doc_id", T.LongType()), field("part", T.IntegerType()), field("local_start", T.LongType()), field("n_tokens", T.LongType()), field("token_ids", T.ArrayType(T.IntegerType(), False))])


def vocabulary_path(path: str = VOCABULARY) -> str:
    """A tokenizer file: a path, or the name of a file of the installed public tokenizers."""
    if os.sep in path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


class Memo(dict):
    """Pieces and their ids after a space; what is missing is taken over from the generation before, or learned."""

    def __init__(self, own: Encoder):
        super().__init__()
        self.own, self.tokenize, self.store = own, own.model.tokenize, own.store
        self.old: dict[str, bytes | None] = {}

    def __missing__(self, piece: str) -> bytes | None:
        out = self.old.get(piece)
        if out is None:
            if piece.isalpha():  # most pieces: one word, told here without further calls
                symbols = self.own.space + piece if piece.isascii() else (" " + piece).encode().decode("latin-1").translate(self.own.alphabet)
                out = b"".join([self.store[x.id] for x in self.tokenize(symbols)])
            else:
                known = len(self)
                out = self.own.learn(piece)
                if len(self) > known:  # its words are as rare as it is
                    return out
        if len(piece) <= LONGEST:
            self[piece] = out
        return out

    def head(self, word: str) -> bytes:
        """Ids of a word that no space precedes; its place here begins with a space, as no piece does."""
        place = " " + word
        out = self.get(place) or self.old.get(place)
        if out is None:
            out = self.own.word(word)
        if len(word) <= LONGEST:
            self[place] = out
        return out

    def bound(self) -> None:
        """A generation is over at MEMO pieces; those that occur again in the next one stay."""
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class Encoder:
    """A byte-level BPE of the tokenizers library, which remembers what it made of each piece between two spaces.

    Its pre-tokenizer always cuts before a single space that stands between two characters that aren't white space, so
    pieces cut there have the ids that they have in the whole text. Texts that hold a string of an added token are left
    to the library, which takes such strings as those tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.added = [x.content for x in self.full.get_added_tokens_decoder().values()]
        pre = self.full.pre_tokenizer
        self.simple = isinstance(pre, ByteLevel) and self.full.normalizer is None and not pre.add_prefix_space
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: printable Latin-1 stands for itself, other bytes follow from 256
        rest = [b for b in range(256) if b not in set(own)]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.space = self.alphabet[32]
        self.store = [i.to_bytes(4, "little") for i in range(self.full.get_vocab_size())]
        self.memo = Memo(self)
        self.ends: dict[str, bytes] = {}
        self.line_end = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """A text that the pre-tokenizer leaves whole."""
        return self.bytes_of(word.encode().decode("latin-1").translate(self.alphabet))

    def bytes_of(self, symbols: str) -> bytes:
        """Ids of a word in the byte alphabet."""
        return b"".join([self.store[x.id] for x in self.model.tokenize(symbols)])

    def letters(self, space: str, piece: str) -> bytes:
        """Ids of a piece after a space or none, if it has letters only and then ASCII punctuation, else by the whole way."""
        core = piece.rstrip(punctuation)
        if not core.isalpha():
            return self.ids(space + piece)
        ids = self.memo[core] if space else self.memo.head(core)
        if len(core) == len(piece):
            return ids
        end = piece[len(core) :]
        if end not in self.ends:
            self.ends[end] = self.word(end)
        return ids + self.ends[end]

    def learn(self, piece: str) -> bytes | None:
        """Ids of a space and the piece; None: not to be cut off from its neighbours."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if "\n" not in piece:
            return self.letters(" ", piece)
        first, *lines = piece.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in (first, *lines)):
            return self.ids(" " + piece)
        # a single line end between two characters that aren't white space is cut off on both sides
        return b"".join([self.letters(" ", first), *(y for x in lines for y in (self.line_end, self.letters("", x)))])

    def parts(self, text: str) -> bytes:
        """Texts with other white space: pieces that can't be cut off stay with their neighbours."""
        out, held = [], []
        for x in text.split(" "):
            if held and x and not x[0].isspace() and held[-1] and not held[-1][-1].isspace():
                out.append(self.joined(held, bool(out)))
                held = []
            held.append(x)
        return b"".join([*out, self.joined(held, bool(out))])

    def joined(self, pieces: list[str], later: bool) -> bytes:
        if later and len(pieces) == 1 and (ids := self.memo[pieces[0]]) is not None:
            return ids
        return self.ids((" " if later else "") + " ".join(pieces))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.simple or any(x in text for x in self.added):
            return self.ids(text)
        first, *rest = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self.parts(text)
        try:
            return self.letters("", first) + b"".join(map(self.memo.__getitem__, rest))
        except TypeError:  # a piece that can't be cut off
            return self.parts(text)


def encoder(path: str) -> Encoder:
    return held(f"tokens {path}", lambda: Encoder(path))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 0) -> None:
    """Encodes whole texts (null: empty), appends end_id to each, and writes files in ascending order of doc_id.

    Rows are dealt by range of doc_id and a hash of the text, so file order is document order; rows with equal doc_id are
    ordered by that hash, those with a null one come first, and rows alike in both are interchangeable. A doc_id that many
    rows have is cut over tasks by its texts. A task holds a batch of at most 4 MB, or one longer text, and the ids of 128
    texts. Columns: doc_id, part (place of the file in the order), local_start (ids of the rows
    before it in the file), n_tokens (with the end id), token_ids. Other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, own, end = TaskContext.get().partitionId(), 0, encoder(vocabulary_path(vocabulary)), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 128):
                own.memo.bound()
                ids = [own.encode(x.as_py() or "") + end for x in texts.slice(at, 128)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                starts = total + np.cumsum(n) - n
                total += int(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 128), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists], names=FILE.names)

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("_order", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order").select("doc_id", "text")
    options = {"parquet.enable.dictionary": "true", "parquet.block.size": ROW_GROUP, "parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
    mapped(ordered, run, FILE).write.options(**options).parquet(path)


def read_starts(spark: SparkSession, path: str, columns: list[str], then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """The files' columns, after `then`, with start: ids of all documents before. Only the columns named, part, local_start and n_tokens are read."""
    rows = spark.read.schema(FILE).parquet(path)
    each = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))  # a row a file
    before = each.select("part", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = then(rows.select(*dict.fromkeys([*columns, "part", "local_start"])))
    return own.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before", "part", "local_start")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token ids of some documents; row groups and pages without them are skipped by their statistics."""
    return spark.read.schema(FILE).parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "token_ids")


def digest(tokens: DataFrame) -> DataFrame:
    """ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers, in place of token_ids."""
    names = [x for x in tokens.columns if x != "token_ids"]
    schema = T.StructType([*(tokens.schema[x] for x in names), field("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sums, pa.int64())], names=schema.names)

    return mapped(tokens, run, schema)


def tokenize(spark: SparkSession, docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the files and returns from them doc_id, start, n_tokens, ids_crc32. Empty input gives no rows."""
    path = path or Scratch(spark, "tokens").path("files")
    write_tokens(docs, path, vocabulary)
    return read_starts(spark, path, ["doc_id", "n_tokens", "token_ids"], digest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokenize() of all documents."""
    return tokenize(spark, spark.read.parquet(str(sf_dir) + "/documents.parquet"))


__all__ = ["tokenize", "write_tokens", "read_tokens", "read_starts", "digest"]
