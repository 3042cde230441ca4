"""The pipeline's stages one by one and run() as a whole, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from arbora.llm import tokens, toxicity
from tests.llm.test_operators import components, contamination, counted, waterfill


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    a = stages["toxicity"](spark, docs, sf_dir)
    bad = {r["doc_id"] for r in toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert a.columns == columns and counted(pairs(a)) == counted(x for x in pairs(docs) if x[0] not in bad)

    b = stages["near_duplicates"](spark, docs, sf_dir)
    kept = {i for i, _, _, k in components(pairs(docs), 5) if k}
    assert b.columns == columns and counted(pairs(b)) == counted(x for x in pairs(docs) if x[0] in kept)

    c = stages["decontamination"](spark, docs, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in contamination(pairs(docs), items) if not r[5]}
    assert c.columns == columns and {x[0] for x in pairs(c)} == clean

    d = stages["mixing"](spark, docs, sf_dir)
    size, source = {i: len(t.split()) for i, t in pairs(docs)}, {r["doc_id"]: r["source"] for r in docs.collect()}
    by, got = collections.Counter(), collections.Counter()
    for i, n in size.items():
        by[source[i]] += n
    for i, _ in pairs(d):
        got[source[i]] += size[i]
    for s, want in waterfill(by).items():
        assert abs(got[s] - want) <= max(n for i, n in size.items() if source[i] == s)
    assert d.columns == columns and max(collections.Counter(i for i, _ in pairs(d)).values()) <= 2


def mixed(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    """Rows (doc_id, text, source) as often as the mix takes them, by brute force."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = collections.Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        by[s] += n
    target = waterfill(by, weights, share, epochs)
    place = ["mix-1|%s|%d" % (i, xxhash.xxh64((t or "").encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64((t or "").encode(), seed=42).intdigest() >> 63)) for i, t, _ in rows]
    place = [hashlib.md5(x.encode()).hexdigest() for x in place]
    out = []
    for s, whole in by.items():
        own = collections.Counter()
        for (_, _, source), n, x in zip(rows, size, place, strict=True):
            if source == s:
                own[x] += n
        times = int(target[s] // whole) if whole else 0
        left, before, border = round(target[s] - times * whole), 0, ""
        for x in sorted(own):
            extra = max(0, min(left - before, own[x]))
            border = x if extra and 2 * extra >= own[x] else border
            before += own[x]
        for (i, t, source), x in zip(rows, place, strict=True):
            if source == s:
                out += [(i, t, source)] * (times + (x <= border))
    return out


def test_run_against_brute_force(spark, sf_dir):
    """All five stages in a row: only the classifier's model is taken from the operator, its scores are found one text at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if model.scores([toxicity.folded((r[1] or "").encode())])[0] < 0.5]
    kept = {i for i, _, _, k in components([r[:2] for r in rows], 5) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in contamination([r[:2] for r in rows], items) if not r[5]}
    rows = mixed([r for r in rows if r[0] in clean])
    library = Tokenizer.from_file(tokens.vocabulary_path())
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert counted(got) == counted(want) and len(want) > 50


def test_empty_stages(spark, sf_dir, empty_docs):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty_docs.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir).count() == 0
