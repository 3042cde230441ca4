"""Content search by trigrams against a scan of all texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import text_index
from arbora.operators.search import text_match

PATTERNS = ["alpha", "al(pha|bum)", "x*alpha+", "(?:foo|ba[rz])qux", "[a-z]{4}", "colou?r", "^line", "end$", "(ab){2,}c", "a.c", "kelvin|istanbul", "groß", "(?i)ALPHA", "missing_word", "foo(bar)?baz", "\\d+ of \\d+ parts"]


def test_literals():
    found = lambda p, fold=False: sorted(map(sorted, text_index.literals(p, fold)))
    assert found("alpha.*beta") == [["alpha", "beta"]] and found("a(foo|bar+x)") == [[], ["foo"]] and found("x?yes(no)?") == [["yes"]]
    assert found("(one|two) three") == [[" three", "one"], [" three", "two"]] and found("[a-z]+") == [[]] and found("(") == [[]]
    assert found("größe", True) == [[]] and found("straßen", True) == [["stra"]] and found("(abc){2}") == [["abc"]] and found("(abc){0,2}") == [[]]


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    words = ["alpha", "Album", "ALPHA", "fooqux", "barqux", "bazqux", "color", "colour", "line", "end", "ababc", "abc", "a\nc", "\u212aelvin", "\u0130stanbul", "kelvin", "GROSS", "groß", "GROß", "foobaz", "foobarbaz", "3 of 7 parts", "日本語"]
    rows = [(f"/t{i}", " ".join(r.choice(words) for _ in range(r.randint(0, 3)))) for i in range(300)] + [("/null", None), ("/empty", ""), (None, "alpha"), ("/t1", "alpha twice")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "path string, text string, doc int")
    monkeypatch.setattr(text_index, "TEXTS", 40)
    index = text_index.build(docs, str(tmp_path / "index"))
    pick = lambda df: sorted(map(repr, map(tuple, df.select("path", "text").collect())))
    read = {}
    for listed in (10_000, 3):
        monkeypatch.setattr(text_index, "LISTED", listed)
        for pattern in PATTERNS if listed > 3 else PATTERNS[:3]:
            for fold in (False, True):
                assert pick(index.search(regex=pattern, ignore_case=fold)) == pick(docs.where(text_match(F.col("text"), None, pattern, fold))), (pattern, fold)
                read[pattern, fold] = index.candidates
    for content in ("alpha", "GROSS", "groß", "日本", "ab", "istan", "i\u0307st"):
        for fold in (False, True):
            assert pick(index.search(content=content, ignore_case=fold)) == pick(docs.where(text_match(F.col("text"), content, None, fold))), (content, fold)
    assert read["missing_word", False] == 0 and read["[a-z]{4}", False] is None and 0 < read["alpha", True] < 200
    with pytest.raises(ValueError):
        index.search()


def test_an_index_of_nothing(spark, tmp_path):
    index = text_index.build(spark.createDataFrame([], "path string, text string"), str(tmp_path / "index"))
    assert index.search(content="alpha").collect() == [] == index.search(regex="a|b").collect()


def test_postings_are_lists_of_the_trigrams_of_each_text(monkeypatch):
    r = random.Random(5)
    texts = [bytes(r.choice(b"abc \xc3\xbf") for _ in range(r.randint(0, 40))) for _ in range(50)]
    for block in (7, 2 << 20):
        monkeypatch.setattr(text_index, "BLOCK", block)
        for part in (texts, texts[:1], [b"".join(texts)], [b""], [b"ab"], [b"a", b"b"]):
            ids = np.arange(len(part)) * 10 - 3
            rows = text_index.postings(part, ids).to_pylist()
            assert [(x["gram"], x["docs"]) for x in rows] == sorted((g, [int(i) for i, t in zip(ids, part, strict=True) if g in text_index.trigrams(t)]) for g in {int(g) for t in part for g in text_index.trigrams(t)})
            assert all(x["n"] == len(x["docs"]) and x["bucket"] == text_index.bucket(x["gram"]) for x in rows)


def test_what_is_dealt_is_a_row_for_a_trigram_and_block(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr("concat('/t', id) path", "concat('the same words in all texts ', id) text").coalesce(1)
    index = text_index.build(docs, str(tmp_path / "index"))
    rows = index.stored()
    assert rows.count() < rows.selectExpr("sum(n)").first()[0] / 10 and index.search(content="texts 39").count() == 11
    monkeypatch.setattr(text_index, "LISTED", 3)
    for sent in (1_000_000, 3):  # candidates sent to all tasks, or joined
        monkeypatch.setattr(text_index, "SENT", sent)
        assert index.search(regex="texts (38|39)").count() == 22 and index.candidates > 3


def test_folding_and_the_time_of_it():
    import time

    kept = "\u0130\u0131\u017f\u212a stra\u00dfe \u65e5\u672c\ud800 \u00c4"
    assert text_index.folded(kept) == "iisk stra\u00dfe \u65e5\u672c\ud800 \u00c4".encode("utf-8", "surrogatepass") and text_index.folded("ABC") == b"abc"
    long, began = "gr\u00fcn wie Gras " * 200_000, time.process_time()
    text_index.folded(long)
    folding, began = time.process_time() - began, time.process_time()
    text_index.grouped([long.encode()[: text_index.BLOCK]])
    assert folding < 5 * (time.process_time() - began)


def test_texts_are_matched_behind_the_join_with_candidates(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr("concat('/t', id) path", "concat('the same words in all texts ', id) text").coalesce(1)
    index = text_index.build(docs, str(tmp_path / "index"))
    monkeypatch.setattr(text_index, "LISTED", 3)
    for sent in (1_000_000, 3):
        monkeypatch.setattr(text_index, "SENT", sent)
        found = index.search(regex="texts 38")
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        join = next(i for i, line in enumerate(plan) if "Join " in line)
        assert any("RLIKE" in line for line in plan[: join + 1]) and not any("RLIKE" in line for line in plan[join + 1 :])
        assert found.count() == 11 and index.candidates == 11
