"""Token counts of texts under a byte-level BPE: merges are taken from a heap over a linked list and only counted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from string import punctuation

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import field, held, mapped, small_batches
from arbora.llm.tokens import VOCABULARY, vocabulary_path

#: Pieces of a generation that a Python worker remembers, two at a time, and characters of the longest: 50 MB of words, 150 MB of any text.
MEMO, LONGEST = 200_000, 32
#: Characters of a text that are cut into pieces at once.
SLICE = 1 << 20
#: Tokens beyond which a document is over the limit.
LIMIT = 1024
#: Before a single space or line end between two characters that aren't white space the pre-tokenizer always cuts.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Letters below this one are letters in every Unicode version.
SETTLED = "ɐ"


class Merges:
    """The ranks of a BPE: which adjacent pair of symbols is merged first, and into what."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: printable Latin-1 stands for itself, other bytes follow from 256
        rest = (b for b in range(256) if b not in set(own))
        letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = [vocabulary[letters[b]] for b in range(256)]
        none: dict[int, int] = {}
        self.ranks: list[dict[int, int]] = [none] * (1 + max(vocabulary.values()))  # by the left symbol: the right one's rank
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            i = vocabulary[left]
            if self.ranks[i] is none:
                self.ranks[i] = {}
            self.ranks[i].setdefault(vocabulary[right], rank)
            self.made.append(vocabulary[left + right])
        self.first = [self.ranks[self.byte[a]].get(self.byte[b], -1) for a in range(256) for b in range(256)]
        self.after, self.before = [*range(1, 65)], [*range(-1, 63)]

    def count(self, piece: bytes) -> int:
        """Symbols left of a piece when no adjacent pair can be merged: its bytes less the merges.

        The heap holds a pair's rank and the place of its left symbol, so the lowest rank comes first and of equal ones the
        leftmost; an entry whose pair has changed since is passed over. A piece of n bytes takes some n log n steps.
        """
        n, first, ranks, made = len(piece), self.first, self.ranks, self.made
        now = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # the rank of the pair that starts at a place
        heap = [rank * n + i for i, rank in enumerate(now) if rank >= 0]
        if not heap:
            return n
        heapify(heap)
        symbol = [self.byte[b] for b in piece]
        after, before = (self.after[:n], self.before[:n]) if n <= 64 else ([*range(1, n + 1)], [*range(-1, n - 1)])
        left = n
        while heap:
            rank, i = divmod(heappop(heap), n)
            if now[i] != rank:
                continue
            left -= 1
            j = after[i]
            after[i] = k = after[j]
            symbol[i] = new = made[rank]
            if j < n - 1:
                now[j] = -1
            now[i] = -1
            if k < n:
                before[k] = i
                if (rank := ranks[new].get(symbol[k], -1)) >= 0:
                    now[i] = rank
                    heappush(heap, rank * n + i)
            if (h := before[i]) >= 0:
                now[h] = rank = ranks[symbol[h]].get(new, -1)
                if rank >= 0:
                    heappush(heap, rank * n + h)
        return left


class Pieces(dict):
    """Token counts of pieces that follow a space, or none; what the generation before knew is taken over as it occurs."""

    def __init__(self, own: Counter, head: str, old: dict[str, int]):
        super().__init__()
        self.own, self.head, self.old = own, head, old

    def __missing__(self, piece: str) -> int | None:
        """None: white space at an end, so not to be cut off from its neighbours."""
        core = piece.rstrip(punctuation)
        if len(core) < len(piece) and core.isalpha() and max(core) < SETTLED:
            return self[core] + self.own.tail(piece[len(core) :])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if "\n" in piece:
            first, *lines = piece.split("\n")
            if any(not x or x[0].isspace() or x[-1].isspace() for x in (first, *lines)):
                return self.own.whole(self.head + piece)
            return self[first] + sum(1 + self.own.starts[x] for x in lines)  # such a line end is a token of its own
        out = self.old.get(piece)
        if out is None:
            out = self.own.merges.count((self.head + piece).encode()) if piece.isalpha() and max(piece) < SETTLED else self.own.whole(self.head + piece)
        if len(piece) <= LONGEST:
            self[piece] = out
        return out

    def next(self) -> Pieces:
        """A new generation if this one is full; the one before it is forgotten."""
        return self if len(self) < MEMO else Pieces(self.own, self.head, dict(self))


class Counter:
    """Counts the tokens of texts; it remembers pieces between single spaces, of which the same few make up most of a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model, pre, added = given["model"], given.get("pre_tokenizer") or {}, given.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or given.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], model["merges"])
        strings = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.spaced, self.starts = Pieces(self, " ", {}), Pieces(self, "", {})
        self.tails: dict[str, int] = {}

    def whole(self, text: str) -> int:
        """Cuts by the tokenizer's own pre-tokenizer, whose tables of letters are those of its Unicode version."""
        return sum(self.merges.count(text[a:b].encode()) for _, (a, b) in self.cut(text))

    def tail(self, marks: str) -> int:
        """Punctuation after a word."""
        out = self.tails.get(marks)
        if out is None:
            out = self.merges.count(marks.encode())
            if len(marks) <= 3:
                self.tails[marks] = out
        return out

    def part(self, text: str) -> int:
        """The tokens of a text without strings of added tokens."""
        first, *rest = text.split(" ")
        try:
            return (self.starts[first] if first else None) + sum(map(self.spaced.__getitem__, rest))
        except TypeError:  # white space of several characters somewhere, or at an end
            return sum(map(self.piece, CUT.split(text)))

    def piece(self, text: str) -> int:
        """A piece that starts with a space or a line end, or the first one."""
        head = text[0]
        out = self.spaced[text[1:]] if head == " " else 1 + (self.starts[text[1:]] or -1) if head == "\n" else self.starts[text]
        return out or self.whole(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a string of an added token is one token and cuts the text, as the library has it."""
        parts = self.added.split(text) if self.added else [text]
        return len(parts) - 1 + sum(self.part(x) for part in parts if part for x in slices(part))

    def bound(self) -> None:
        self.spaced, self.starts = self.spaced.next(), self.starts.next()


def slices(text: str) -> Iterator[str]:
    """The text in slices of about SLICE characters, cut where the pre-tokenizer cuts; one without such a place is longer."""
    at = 0
    while len(text) - at > SLICE and (found := CUT.search(text, at + SLICE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row a document.

    Whole texts are counted as the tokenizers library does without special tokens around them; a null text is empty and has
    0 tokens. Strings of added tokens inside a text count as these tokens. Null and repeated doc_ids give a row each, other
    columns are ignored, an empty table gives no rows. vocabulary: the JSON file of a byte-level BPE without normalizer, or
    its name among the public tokenizers; others raise ValueError. Rows are never shuffled; a task holds a batch of 4 MB or
    one longer text, its pieces of a million characters, and what it remembers of short pieces.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], field("n_bytes", T.LongType()), field("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(f"token counts {vocabulary}", lambda: Counter(vocabulary_path(vocabulary)))
        for batch in batches:
            counts = []
            for text in batch.column("text"):
                own.bound()
                counts.append(own.count(text.as_py() or ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=schema.names)

    text = F.col("text").cast("string")
    given = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return mapped(given, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents."""
    return token_counts(spark.read.parquet(str(sf_dir) + "/documents.parquet"))


__all__ = ["token_counts", "Merges"]
