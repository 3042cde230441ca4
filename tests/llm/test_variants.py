import random
import zlib

import duckdb
import numpy as np
import pytest

from arbora.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, factor=5):
    out = {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        best = others[0] if others and -others[0][0] >= factor * n else None
        out[w] = [best and best[1], n, len(others), best and -best[0]]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return out


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def found(df):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in df.collect()}


def vocabulary(seed, size, letters="abñ", low=1, high=7):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(low, high))): r.choice([1, 2, 5, 9, 30, 200, 2000]) for _ in range(size)}


@pytest.mark.parametrize("bundle", [1 << 20, 900])
def test_variants_are_those_of_brute_force(spark, monkeypatch, bundle):
    monkeypatch.setattr(variants, "BUNDLE", bundle)
    words = vocabulary(1, 400) | {"𝔘nder": 3, "𝔘nter": 40, "a": 50}
    assert found(variants.spelling_variants(table(spark, words | {"": 2}))) == brute(words)


def test_a_hot_prefix_is_dealt_again_by_halves_of_its_window(spark, monkeypatch):
    monkeypatch.setattr(variants, "BUNDLE", 2000)
    tails = vocabulary(2, 250, "abcde", 4, 5)
    words = {"unbelievably" + k: v for k, v in tails.items()} | {k + "ification": v for k, v in tails.items()}
    assert found(variants.spelling_variants(table(spark, words))) == brute(words)


def test_wavelet_tree_reports_what_a_scan_finds():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 97):
        values = r.permutation(n)
        left, low = r.integers(0, n + 1, 50), r.integers(0, n + 1, 50)
        right, high = np.minimum(n, left + r.integers(0, n + 1, 50)), np.minimum(n, low + r.integers(0, n + 1, 50))
        which, value = variants.WaveletTree(values).report(left, right, low, high)
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == sorted((k, int(v)) for k in range(50) for v in values[left[k] : right[k]] if low[k] <= v < high[k])


def test_few_rectangles_at_once_and_short_slices(monkeypatch):
    """What a task does, here in this process, as workers don't see patched bounds."""
    import pyarrow as pa

    words = vocabulary(6, 150, "abc", 4, 6)
    rows = [(w, n, m, 0, m) for w, n in words.items() for m in (len(w), len(w) - 1)]
    bundle = pa.table({"word": [r[0] for r in rows], "n": [r[1] for r in rows], "length": [r[2] for r in rows], "first": [r[3] for r in rows], "end": [r[4] for r in rows]})
    every = variants.near_words(bundle).to_pylist()
    monkeypatch.setattr(variants, "RECTANGLES", 7)
    assert variants.near_words(bundle).to_pylist() == every

    def added(rows):
        out = {}
        for r in rows:
            out[r["word"]] = out.get(r["word"], 0) + r["n_near"]
        return out

    assert added(every) == {w: x[2] for w, x in brute(words).items() if x[2]}
    text = "Éa bcd,efg " * 30
    whole = [x for found in variants.runs(text) for x in found]
    monkeypatch.setattr(variants, "SLICE", 5)
    assert [x for found in variants.runs(text) for x in found] == whole and len(list(variants.runs(text))) > 20


def test_words_of_documents(spark):
    text = "Colour colour, COLOUR; coloúr straße×ÀÉ Ωcolourx日colour_ " * 60
    docs = [(i, text if i % 3 else None, "x") for i in range(40)] + [(None, text, "y"), (7, text, None)]
    wanted = {}
    for doc_id, t, _ in docs:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run
            if len(run) >= 6:
                wanted[run] = wanted.get(run, 0) + 1
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(3)
    assert {r.word: r.n for r in variants.word_counts(frame, modulus=3).collect()} == {k: v for k, v in wanted.items() if v >= 5}


def test_odd_rows_and_empty_tables(spark, odd_docs, empty_docs):
    assert variants.spelling_variants(variants.word_counts(empty_docs)).collect() == []
    rows = variants.word_counts(odd_docs, least_length=3, least_count=3).collect()
    assert {"the", "owls"} <= {r.word for r in rows}
    odd = spark.createDataFrame([(None, 5, "a"), ("abcdef", None, "b"), ("abcdefg", 50, "c"), ("abcdeg", 1, "d")], "word string, n long, form string")
    assert found(variants.spelling_variants(odd)) == {"abcdefg": [None, 50, 1, None, "abcdefg"], "abcdeg": ["abcdefg", 1, 1, 50, "abcdefg"]}
    with pytest.raises(ValueError):
        variants.spelling_variants(odd, factor=1)


def test_a_very_long_word(spark):
    words = {"x" * 20_000: 10, "x" * 9_999 + "y" + "x" * 10_000: 2, "x" * 19_999: 60}
    assert found(variants.spelling_variants(table(spark, words))) == brute(words)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = variants.op11_spelling(spark, sf)
    wanted = c.execute(variants.OP11_SQL)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted.fetchall()))
    assert got.columns == [x[0] for x in wanted.description]
