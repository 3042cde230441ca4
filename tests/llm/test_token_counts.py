import random

import pytest

from arbora.llm import token_counts
from arbora.llm.tokens import vocabulary_path

PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "b", "word", "'s", "1", "!", ".", ",", "é", "՘", "日", "\x1c", "\x85", "\xa0", "<|endoftext|>", "　", "I'll", "😀", "\r\n", "x" * 40]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = token_counts.token_counts(docs).collect()
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    assert {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in rows} == {k: (len(x.encode()), n := library(x), n > 1024) for k, x in texts.items()}


@pytest.mark.parametrize("size", [1 << 20, 5])
def test_any_white_space_marks_and_added_tokens(library, monkeypatch, size):
    monkeypatch.setattr(token_counts, "SLICE", size)
    monkeypatch.setattr(token_counts, "MEMO", 50)
    own, r = token_counts.Counter(vocabulary_path()), random.Random(size)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 20)))
        own.bound()
        assert own.count(text) == library(text), text


def test_long_texts_without_a_cut(library):
    own = token_counts.Counter(vocabulary_path())
    for text in ("ab" * 50_000, "Straße" * 5_000, " " * 10_000, "x\n" * 10_000, "<|endoftext|>" * 1_000, "!" * 9_999):
        assert own.count(text) == library(text)


def test_merging_is_by_rank_then_from_the_left():
    merges = token_counts.Merges({c: i for i, c in enumerate([*map(chr, range(33, 127)), *map(chr, range(161, 173)), *map(chr, range(174, 256)), *map(chr, range(256, 324)), "ab", "bc", "aa", "abc"])}, [["a", "b"], ["b", "c"], ["a", "a"], ["ab", "c"]])
    assert [merges.count(x) for x in (b"", b"a", b"abc", b"bcabc", b"aaa", b"aaaa", b"xyz")] == [0, 1, 1, 2, 2, 2, 3]


def test_odd_rows(spark, odd_docs, empty_docs, library):
    rows = token_counts.token_counts(odd_docs).collect()
    wanted = [(x.doc_id, len((x.text or "").encode()), library(x.text or "")) for x in odd_docs.collect()]
    assert sorted(map(repr, ((x.doc_id, x.n_bytes, x.n_tokens) for x in rows))) == sorted(map(repr, wanted))
    assert token_counts.token_counts(empty_docs).collect() == []
    assert token_counts.token_counts(odd_docs.withColumn("doc_id", odd_docs.doc_id.cast("string"))).where("doc_id is not null").count() == 13


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(vocabulary_path("word_bpe_49k.json"))
