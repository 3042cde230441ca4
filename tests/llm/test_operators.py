"""The ten operators against brute force, round trips and held-out accuracy, and over odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import decontamination, embeddings, licenses, lines, minhash, mixing, sharding, tokens, toxicity, warc
from arbora.llm.common import Scratch, running_totals
from arbora.llm.graph import connected_components


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def counted(rows):
    return collections.Counter(map(tuple, rows))


def texts_of(rows):
    return sorted(map(repr, rows))


# common

#: Names of columns that operators add to rows on their way, and of those they return.
OWN = (
    "_key _time _times _doc _found _lines _row _kept _again _rows _hit _items _words _own_0 _own_1 _random _rank _source _from _of _epochs _extra _border _one _all _null _cap _weight target size source_size taken rows_before weight_before "
    "_group _piece _base _members _here _load _order part local_start start n_tokens token_ids ids_crc32 _lower _normal _parts _unit unit place template dice _grams _n _set _signature a b x y hub label node crowd _full "
    "score predicted toxic held_out _till line leaf hash tokens n_words n_hit contaminated _pid _w shard slot law kept component_id"
).split()


def test_clashing_names(spark, odd_docs):
    """Columns with the names of an operator's own change nothing, and come back as they were."""
    base = odd_docs.select("doc_id", "text", "lang", "source")
    more = base.select("*", *[F.lit(f"mine {i}").alias(x) for i, x in enumerate(OWN)])
    bench = spark.createDataFrame([(1, "the lazy dog while seven wise owls"), (2, None)], "item_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, toxic int")
    values = [f"mine {i}" for i in range(len(OWN))]
    same = {"mix": mixing.mix, "clean lines": lambda d: lines.clean(d, min_docs=2), "dedup": lambda d: minhash.dedup(d, k=2), "decontaminate": lambda d: decontamination.clean(d, bench), "toxic": lambda d: toxicity.clean(d, marks)}
    for name, f in same.items():
        got = f(more)
        assert got.columns == more.columns, name
        rows = [tuple(r) for r in got.collect()]
        assert all(list(r[4:]) == values for r in rows) and counted(r[:4] for r in rows) == counted(f(base).collect()), name
    plain = {"sizes": mixing.mix_sizes, "lines": lines.dropped, "minhash": minhash.near_duplicates, "hits": lambda d: decontamination.decontaminate(d, bench), "toxicity": lambda d: toxicity.classify(d, marks), "licences": licenses.scan, "shards": lambda d: sharding.shard(d, 3).select("doc_id", "size", "text_crc32"), "tokens": lambda d: tokens.tokenize(spark, d)}
    for name, f in plain.items():
        assert sorted(map(repr, f(more).collect())) == sorted(map(repr, f(base).collect())), name


def test_running_totals(spark):
    r = random.Random(0)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randint(0, 5)}", i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, w long").repartition(7)
    got = {x["o"]: (x["rows_before"], x["weight_before"]) for x in running_totals(df, "k", ["o"], "w", Scratch(spark, "t")).collect()}
    for k, o, _ in rows:
        earlier = [w for a, b, w in rows if a == k and b < o]
        assert got[o] == (len(earlier), sum(earlier))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(80)] + [(5000, 5000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert set(got) == set(parent)
    by = collections.defaultdict(set)
    for n, label in got.items():
        by[label].add(n)
    want = collections.defaultdict(set)
    for n in parent:
        want[find(n)].add(n)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# 1

def test_framing():
    for data in (b"", b"x", b"\r\n\r\n" * 10, bytes(range(256)) * 200):
        assert warc.unframed(warc.framed(data, 100)) == data
    assert warc.unframed(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.unframed(b"5\r\nhel") is None and warc.unframed(b"zz\r\n") is None and warc.unframed(b"") is None


def pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>" + "x" * 100_000), (2, None, ""), (3, "u", None), (4, "u", "same\r\n\r\nWARC/1.1\r\n"), (9, "u", "same\r\n\r\nWARC/1.1\r\n"), (9, "u", "same\r\n\r\nWARC/1.1\r\n"), (7, "u", "é" * 40_000), (8, "u", "é" * 40_000), (None, "u", "no id"), (None, "u", "same\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, "clash", "z") for r in rows], "page_id long, url string, html string, block string, origin string")


def test_warc_round_trip(spark):
    scratch = Scratch(spark, "t")
    path = scratch.path("archives")
    warc.write_archives(pages(spark), path)
    got = warc.read_archives(spark, path, scratch, whole=True).collect()
    want, by = [], collections.defaultdict(list)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    for i, h in rows:
        by[h].append(i)
    for i, h in rows:
        last = max((x for x in by[h] if x is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        visit = len(by[h]) > 1 and last is not None and i != last
        want.append((i, len(h), digest, "revisit" if visit else "response", last if visit else None))
    assert counted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == counted(want)
    assert {r["status"] for r in got} == {"ok"}
    assert {bytes(r["block"]) for r in got if r["record_type"] == "response"} == set(by)
    # the same records in gzip files
    import glob
    import gzip
    import os

    packed = scratch.path("packed")
    os.makedirs(packed)
    for i, f in enumerate(glob.glob(path.removeprefix("file://") + "/part-*")):
        with open(f, "rb") as plain, gzip.open(f"{packed}/{i}.warc.gz", "wb") as out:
            out.write(plain.read())
    assert texts_of(warc.read_archives(spark, packed, scratch, whole=True).collect()) == texts_of(got)
    path = scratch.path("none")
    warc.write_archives(pages(spark).limit(0), path)
    assert warc.read_archives(spark, path, scratch).count() == 0


def test_broken_segments(spark):
    block = warc.HEAD + b"Transfer-Encoding: chunked" + warc.END + warc.framed(b"payload " * 50)
    part = [block[i : i + 100] for i in range(0, len(block), 100)]
    rows = []

    def add(origin, numbers, total=len(block), twist=None):
        for n in numbers:
            rows.append({"record_id": origin if n == 1 else f"{origin}{n}", "record_type": "response" if n == 1 else "continuation", "page_id": 5 if n == 1 else None, "segment": n, "total": total if n == len(part) else None, "block": bytearray(twist or part[n - 1]), "origin": origin, "status": "segment"})

    every = range(1, len(part) + 1)
    add("good", reversed(every))
    add("twice", [*every, 1, 2])
    add("gap", [x for x in every if x != 2])
    add("headless", [x for x in every if x != 1])
    add("short", every, total=7)
    add("clash", every)
    add("clash", [2], twist=b"other")
    schema = "record_id string, record_type string, url string, refers_id string, payload_digest string, origin string, page_id long, refers_to long, payload_bytes long, segment long, total long, block binary, status string"
    full = [tuple(r.get(k) for k in [x.split()[0] for x in schema.split(", ")]) for r in rows]
    got = counted((r["origin"], r["status"], r["payload_bytes"]) for r in warc.reassemble(spark.createDataFrame(full, schema)).collect())
    assert got == {("good", "ok", 400): 1, ("twice", "ok", 400): 2, ("gap", "missing_segment", None): 1, ("headless", "missing_segment", None): 1, ("short", "length_mismatch", None): 1, ("clash", "conflicting_segment", None): 1}


# 2

def notices(docs, templates, threshold=0.8):
    """Units and their best templates, by brute force, in texts where no comment stands next to code."""
    run = max(len(re.split("\n\n+", t.strip())) for t in templates.values())
    grams = {name: licenses.pairs(licenses.template_words(t)) for name, t in templates.items()}
    out = []
    for i, t in docs:
        normal = re.sub(r" ?\n ?", "\n", re.sub(r"[^a-z0-9\n]+", " ", (t or "").lower())).strip(" ")
        parts = re.split("\n\n+", normal.strip("\n"))
        units = [("text", "0", " ".join(parts)), *(("line", str(n), x) for n, x in enumerate(normal.split("\n"), 1))]
        units += [("paragraphs", f"{a + 1}-{a + n}", " ".join(parts[a : a + n])) for n in range(1, run + 1) if len(parts) > n for a in range(len(parts) - n + 1)]
        for unit, place, text in units:
            own = licenses.pairs(text.split())
            best = max(((2 * len(own & g) / (len(own) + len(g)), name) for name, g in grams.items()), default=(0, ""))
            if own and best[0] >= threshold:
                out.append((i, unit, place, best[1], best[0]))
    return out


def test_licenses(spark, odd_docs, empty_docs):
    r, full = random.Random(2), licenses.TEMPLATES["MIT-full"]
    wrapped = "\n".join("# " + x for p in full.split("\n\n") for x in [*re.findall(r".{1,60}(?: |$)", p), ""])
    rows = [(20, "Intro.\nreleased UNDER the mit license\nmore words here"), (21, licenses.TEMPLATES["MIT-text"].replace("whom", "whomever")), (22, "prose that mentions a license"), (23, f"#!/bin/sh\n\n# Copyright 2020 A. Body\n\n{wrapped}\n\necho one\n\n\necho two"), (24, full), (25, "\n \n--\n")]
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split(" ")
        for share in (0, 5, 12, 20, 30):  # of each hundred words so many are changed
            own = [("x" if r.random() < share / 100 else w) for w in words]
            rows.append((100 + 10 * i + share, "Before it.\n\n" * r.randint(0, 1) + " ".join(own) + "\n\nAfter it, code\nand more" * r.randint(0, 2)))
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(odd_docs.select("doc_id", "text", "score").unionByName(extra.withColumn("score", F.lit(1.0)))).collect()
    assert counted(found) == counted(notices(rows, licenses.TEMPLATES))
    got = {(x["doc_id"], x["unit"], x["place"]): (x["template"], x["dice"]) for x in found}
    assert got[20, "line", "2"] == ("MIT", 1.0) and got[24, "text", "0"] == ("MIT-full", 1.0) and got[23, "paragraphs", "3-5"] == ("MIT-full", 1.0)
    assert 0.8 <= got[21, "line", "1"][1] < 1 and not {22, 25} & {k[0] for k in got}
    assert licenses.scan(empty_docs).count() == 0 and licenses.scan(extra, {}).count() == 0
    known = [licenses.template_words(t) for t in licenses.TEMPLATES.values()]
    kept = licenses.telling(known, 0.8)
    for grams in map(licenses.pairs, known):  # no unit without a telling word gets near
        left = {x for x in grams if not kept & set(x)}
        assert all(2 * len(left) / (len(grams) + m) < 0.8 for m in range(max(len(left), licenses.bounds(len(grams), 0.8)[0]), 3 * len(grams)))
    pattern = re.compile(licenses.any_word({"ab", "abc", "b", "abd"}))
    assert [bool(pattern.search(x)) for x in ("ab", "x abc.", "xab", "abe", "(abd)", "a b", "ba")] == [True, True, False, False, True, True, False]
    for n in range(1, 60):  # the bounds lose nothing
        lo, hi = licenses.bounds(n, 0.8)
        for m in range(1, 120):
            if 2 * min(n, m) / (n + m) >= 0.8:
                assert lo <= m <= hi


# 3

def test_tokens(spark, odd_docs, empty_docs):
    from tokenizers import Tokenizer

    path = Scratch(spark, "t").path("files")
    got = [tuple(r) for r in tokens.tokenize(spark, odd_docs, path).orderBy("start").collect()]
    t = Tokenizer.from_file(tokens.vocabulary_path())
    ids = {(r["doc_id"], r["text"]): [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in odd_docs.collect()}
    start = 0
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        assert any(k[0] == doc_id and len(v) == n and zlib.crc32(np.array(v, "<u4").tobytes()) == crc for k, v in ids.items())
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda x: -1 if x is None else x) and len(got) == odd_docs.count()
    assert [r["doc_id"] for r in tokens.read_tokens(spark, path, [3]).collect()] == [3]
    assert tokens.tokenize(spark, empty_docs).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    own, r = tokens.Encoder(tokens.vocabulary_path()), random.Random(2)
    library = Tokenizer.from_file(tokens.vocabulary_path())
    fixed = ["", " ", "  ", " a  b", "a", "a ", "don't we'll 123 4,5", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "a\x1cb c\x1c d", "日本 語。 x\r\n y", "x!\nY z.\n\nW", "one\ntwo three", "été, été. été", "x" * 5000 + " y " * 50, "word " * 9000]
    texts = fixed + ["".join(r.choices("ab .,'!\n\t 1é日%", k=r.randint(0, 40))) for _ in range(3000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for t, ids in zip(texts, want, strict=True):
        assert own.encode(t) == ids, t
    before, tokens.MEMO = tokens.MEMO, 50  # forgets again and again
    try:
        for t, ids in zip(texts, want, strict=True):
            own.memo.bound()
            assert own.encode(t) == ids, t
    finally:
        tokens.MEMO = before


def test_words_that_occur_again_are_tokenized_once(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    own, asked = tokens.Encoder(tokens.vocabulary_path()), []
    own.memo.tokenize = lambda x, f=own.memo.tokenize: asked.append(x) or f(x)
    letters = "abcdefghijklmnopqrstuvwxyz"
    often = [f"again{x}{y}" for x in letters[:4] for y in letters[:5]]
    for x in letters:  # more than fit, of which some come back in each text, with marks after them too
        own.memo.bound()
        own.encode(" ".join(["one", *often, *[f"{y}," for y in often], *[f"other{x}{y}" for y in letters]]))
    assert len([x for x in asked if "again" in x]) == len(often)
    assert len(own.memo) + len(own.memo.old) < 4 * tokens.MEMO


# 4

def test_sharding(spark, odd_docs, empty_docs):
    rows = [(i, f"text {i if i > 300 else i // 3}" if i > 90 else "hot") for i in range(500)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    got = sharding.shard(docs, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1 and len(got) == 500
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    text = dict(rows)
    groups = got.assign(text=got.doc_id.map(text)).groupby("text").shard.agg(["size", "nunique"])
    small = groups[(groups["size"] > 1) & (groups["size"] < 10)]
    assert (small["nunique"] == 1).mean() > 0.9  # few groups are cut
    assert (got["size"] == got.doc_id.map(lambda i: len(text[i]) + 16)).all()
    assert (got.text_crc32 == got.doc_id.map(lambda i: zlib.crc32(text[i].encode()))).all()
    assert small["nunique"].max() == 1
    odd = sharding.shard(odd_docs, 3).toPandas()
    assert len(odd) == odd_docs.count() and odd.groupby("shard").size().max() - odd.groupby("shard").size().min() <= 1
    assert sharding.shard(empty_docs).count() == 0 and sharding.shard(odd_docs.limit(2), 5).count() == 2


def test_sharding_keeps_groups(spark):
    """All rows are linked; a group just below a quota stays whole, one beyond it is cut as little as can be."""
    sizes = [95, 230, *[3] * 125]
    rows = [(100_000 * g + k, f"group {g}") for g, n in enumerate(sizes) for k in range(n)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 7).toPandas()
    per = got.groupby("shard").size()
    assert per.max() - per.min() <= 1 and len(got) == sum(sizes)
    parts = got.assign(g=got.doc_id // 100_000).groupby("g").shard.nunique()
    assert parts[0] == 1 and parts[1] == 3 and (parts[2:] > 1).sum() <= 7


# 5

def waterfill(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, cap = {s: weights[i % 3] for i, s in enumerate(names)}, {s: epochs * sizes[s] for s in names}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = sum(w[s] for s in names if s not in full)
        level = (total - sum(cap[s] for s in full)) / rest if rest else 0
        over = {s for s in names if s not in full and w[s] * level >= cap[s]}
        if not over:
            return {s: cap[s] if s in full else w[s] * level for s in names}
        full |= over


def test_mixing(spark, odd_docs, empty_docs):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)) if i % 17 else None, r.choice(["a", "b", "c", "d", "é", None]) if i % 3 else "a") for i in range(600)]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, source string, target string")
    got = mixing.mix_sizes(docs).toPandas()
    again = mixing.mix_sizes(docs.repartition(5)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    size, by = {i: len((t or "").split()) for i, t, _ in rows}, collections.Counter()
    for i, _, s in rows:
        by[s] += size[i]
    want = waterfill(by)
    got["source"] = got.doc_id.map({i: s or "-" for i, _, s in rows})
    for s, g in got.groupby("source"):
        s = None if s == "-" else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1 and g.source_size.iloc[0] == by[s]
    assert (got.taken <= 2 * got["size"]).all() and (got["size"] == got.doc_id.map(size)).all()
    assert mixing.mix_sizes(odd_docs).count() == odd_docs.count() and mixing.mix_sizes(empty_docs).count() == 0
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns and whole.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(empty_docs).count() == 0 and set(mixing.mix(odd_docs).columns) == set(odd_docs.columns)


# 6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for name, t in items:
        w = WORD.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(name))
    out = []
    for i, t in docs:
        w, seen = WORD.findall(low(t)), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    seen |= found
                    hit[k : k + n] = [1] * n
        out.append((i, len(w), sum(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def test_decontamination(spark, odd_docs, empty_docs, base):
    r, vocabulary = random.Random(4), [f"w{i}" for i in range(40)] + ["é", "İ", "x9"]
    items = [(i, " ".join(r.choices(vocabulary[:6] if i % 4 else vocabulary, k=r.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(40)] + [(100, None), (101, base), (101, base), (102, "one")]
    rows = []
    for i in range(150):
        w = r.choices(vocabulary, k=r.randint(0, 60))
        if i % 2:
            t = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(t) - 1))
            at = r.randint(0, len(w))
            w[at:at] = t[a:]
        rows.append((1000 + i, "-- ".join(w).upper() if i % 3 else ", ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    want = counted(contamination([tuple(x) for x in docs.collect()], items))
    assert counted(decontamination.decontaminate(docs, bench).collect()) == want
    assert counted(decontamination.decontaminate(docs, bench, limit=60).collect()) == want  # several blocks
    kept = decontamination.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and counted(r[:2] for r in kept.collect()) == counted(tuple(x) for x in odd_docs.select("doc_id", "text").collect() if not contamination([tuple(x)], items)[0][5])
    assert decontamination.decontaminate(empty_docs, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# 7

def templates(docs, depth=2, least=3, same=0.5, levels=(0.0, 0.05, 0.3)):
    """Line numbers dropped by the tree, by brute force."""
    found = []
    for d, (_, t) in enumerate(docs):
        for n, line in enumerate((t or "").split("\n") if t else []):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in line.encode().decode().split(" ") if x)
            if w:
                found.append((d, n, w, (len(w), w[:depth])))
    leaf_docs, constant = collections.defaultdict(set), collections.Counter()
    for d, _, _, k in found:
        leaf_docs[k].add(d)
    for _, w, k in {(d, w, k) for d, _, w, k in found if len(leaf_docs[k]) >= least}:
        for p, x in enumerate(w):
            constant[k, p, x] += 1
    place = collections.defaultdict(set)
    for _, _, w, k in found:
        if len(leaf_docs[k]) < least or w in place:
            continue
        for n, share in enumerate(levels):
            kept = tuple((p, x) for p, x in enumerate(w) if constant[k, p, x] >= max(least, share * len(leaf_docs[k])))
            body = [p for p, _ in kept if p >= depth]
            if len(kept) >= same * len(w) and (n == 0 or len(w) > depth and len(body) >= same * (len(w) - depth)):
                place[w].add((k, kept))
            elif n == 0:
                place[w].add(("own", w))
    docs_of = collections.defaultdict(set)
    for d, _, w, _ in found:
        for x in place.get(w, ()):
            docs_of[x].add(d)
    out = collections.defaultdict(list)
    for d, n, w, _ in found:
        if any(len(docs_of[x]) >= least for x in place.get(w, ())):
            out[d].append(n)
    return [(docs[d][0], sorted(out[d])) for d in range(len(docs))]


def test_lines(spark, odd_docs, empty_docs):
    r = random.Random(5)
    rows = []
    for i in range(80):
        ls = [" ".join(r.choices("a b c d e f g h".split(), k=r.randint(0, 4))) for _ in range(3)] + [f"user u{i} logged in from host{i} at home today", "Copyright notice that many documents share"][: r.randint(0, 2)]
        r.shuffle(ls)
        rows.append((i, "\n".join(ls)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_lines"], x["dropped"]) for x in lines.dropped(docs).collect()}
    for i, want in templates(rows):
        assert got[i][1] == want and got[i][0] == (rows[i][1].count("\n") + 1 if rows[i][1] else 0)
    text = {x["doc_id"]: x["text"] for x in lines.clean(docs).collect()}
    for i, t in rows:
        assert text[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[i][1])
    clash = docs.select("doc_id", "text", *[F.lit(i).alias(x) for i, x in enumerate(["_doc", "_found", "_lines", "_row", "line"])])
    assert lines.clean(clash).columns == clash.columns and {x["doc_id"]: x["text"] for x in lines.clean(clash).collect()} == text
    odd = lines.dropped(odd_docs)
    assert odd.count() == odd_docs.count() and lines.dropped(empty_docs).count() == 0
    assert lines.clean(odd_docs).columns == odd_docs.columns


def test_fields_of_few_values(spark):
    """One template with fields of some values each: its lines go, however many documents hold it."""
    r = random.Random(15)
    for n, values in ((60, 100), (600, 100), (600, 7)):
        names = ["".join(r.choices("abcdefgh", k=6)) for _ in range(values)]
        rows = [(i, f"unlike any other {chr(97 + i % 26)}{chr(97 + i // 26)}\ngood day dear reader {r.choice(names)} of the town {r.choice(names)} by the sea {r.choice(names)} today") for i in range(n)]
        got = {x["doc_id"]: x["dropped"] for x in lines.dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(1 in x for x in got.values()) >= 0.99 * n, (n, values)
        assert got == dict(templates(rows))
    before, lines.SMALL_LEAF = lines.SMALL_LEAF, 3000  # the large leaf by token keys
    try:
        assert got == {x["doc_id"]: x["dropped"] for x in lines.dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        lines.SMALL_LEAF = before


def test_lines_in_pieces():
    """Long texts give the lines that short ones give."""
    r, before = random.Random(16), lines.CHUNK
    texts = ["\n".join(" ".join(r.choices(["a", "b1", "été", "word", ""], k=r.randint(0, 6))) for _ in range(r.randint(0, 30))).encode() for _ in range(40)] + [b"x" * 500 + b"\ny"]
    want = lines._lines(texts)
    try:
        lines.CHUNK = 50
        got = lines._lines(texts)
    finally:
        lines.CHUNK = before
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    words = [x for t in texts for x in t.split()]
    known = collections.defaultdict(set)
    for x, h in zip(words, want[3].tolist(), strict=True):
        known[lines.VARIABLE if re.search(b"[0-9]", x) else x].add(h)
    assert all(len(x) == 1 for x in known.values()) and len({min(x) for x in known.values()}) == len(known)
    lists = [[len(y.split()) for y in t.split(b"\n")] for t in texts]
    assert list(zip(want[0].tolist(), want[1].tolist(), want[2].tolist(), strict=True)) == [(i, n, c) for i, x in enumerate(lists) for n, c in enumerate(x) if c]


def test_long_lines_of_two_documents(spark):
    line = lambda n, k: " ".join(f"word{chr(97 + i % 26)}{chr(97 + (i + k) // 26)}" for i in range(n))
    long, other = line(60, 0), line(70, 5)
    rows = [(1, f"first one\n{long}"), (2, f"{long}\nsecond one"), (3, f"{line(50, 0)}\nthird"), (4, f"fourth\n{line(50, 0)}"), (5, f"{other}\n{other}")]
    got = {x["doc_id"]: x["dropped"] for x in lines.dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [1], 2: [0], 3: [], 4: [], 5: []}  # 50 words need three documents, and one document's repeats are one


# 8

def test_embeddings(spark):
    r = np.random.default_rng(6)
    centre = r.normal(size=(30, 16))
    x = np.concatenate([c + 0.06 * r.normal(size=(n, 16)) for c, n in zip(centre, [150, 60, *[6] * 28], strict=True)])
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    rows += [(1000, rows[3][1], 1), (1000, rows[3][1], 1), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [None, *[1.0] * 15], 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (None, rows[5][1], 0)]
    df = spark.createDataFrame([(*v, "z") for v in rows], "vec_id long, embedding array<double>, label int, vec string")
    got = embeddings.near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    ok = [(i, np.array(e)) for i, e, _ in rows if e and len(e) == 16 and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    m = np.stack([e / np.linalg.norm(e) for _, e in ok])
    s = m @ m.T >= 0.95
    want = {}
    for (i, _), n in zip(ok, s.sum(1) - 1, strict=True):
        want.setdefault(i, int(n))
    mine = {None if v != v else int(v): int(n) for v, n in zip(got.vec_id, got.n_links, strict=True)}
    assert sum(min(mine[i], want[i]) for i in want) / sum(want.values()) >= 0.97 and all(mine[i] <= want[i] for i in want)
    assert all(mine[i] == 0 for i in (1001, 1002, 1003, 1004, 1005, 1006))
    comp = dict(zip(got.vec_id, got.component_id, strict=True))
    assert comp[1000] == comp[3] and all(comp[i] == i for i in (1001, 1002))
    result = embeddings.near_duplicates(df.where("vec_id < 1000"))
    assert embeddings.audit_recall(df.where("vec_id < 1000"), result, every=10) >= 0.9
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def linked(x):
    """Numbers of links and components of vectors, by brute force."""
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = np.arange(len(x))
    while True:
        after = np.array([label[row].min() for row in near])
        if (after == label).all():
            return near.sum(1) - 1, label
        label = after


def test_embeddings_of_large_groups(spark, monkeypatch):
    """Groups that lie in many cells and blocks, small groups at the cells' borders, and two levels of centres."""
    r = np.random.default_rng(9)
    parts = []
    for size in (900, 400, *[30] * 8, *[4] * 100):
        c = r.normal(size=32)
        parts.append(c / np.linalg.norm(c) + 0.036 * r.normal(size=(size, 32)))
    x = np.concatenate([*parts, r.normal(size=(400, 32))]).astype(np.float32)
    x = x[r.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    n, label = linked(x)
    for name, value in (("PER_CENTRE", 150), ("CENTRES", 4), ("BLOCK", 120), ("QUERIES", 500), ("SUB_SAMPLE", 300)):
        monkeypatch.setattr(embeddings, name, value)
    result = embeddings.near_duplicates(df)
    got = result.toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() <= n).all() and got.n_links.sum() >= 0.98 * n.sum()
    assert (got.component_id.to_numpy() == label).mean() > 0.98
    assert embeddings.audit_recall(df, result, every=10) >= 0.95


def test_embeddings_ids(spark):
    """Different vectors with one id, null ids, an id of -1, and two lengths."""
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.01, 1.0]), (-1, [1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [1.0, 2.001]), (9, [0.0, -0.0])]
    got = counted(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == counted([(5, 0, 5, True), (5, 1, 5, True), (7, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (-1, 0, -1, True), (8, 1, 8, True), (9, 1, 8, False), (9, 0, 9, True)])
    texts = embeddings.near_duplicates(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01])], "vec_id string, embedding array<float>"))
    assert counted(texts.collect()) == counted([("a", 1, "a", True), ("b", 1, "a", False)])


def test_pruned_graph():
    """Lists hold the nearest and nothing that a kept neighbour is much nearer to."""
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embeddings.pruned(x, np.arange(200), np.tile(np.arange(200), (200, 1)))
    for i in range(0, 200, 20):
        far = np.sqrt(np.maximum(0, 2 - 2 * x @ x[i]))
        alive, want = [int(j) for j in np.argsort(far, kind="stable") if j != i], []
        while alive and len(want) < embeddings.DEGREE:
            j = alive.pop(0)
            want.append(j)
            alive = [k for k in alive if embeddings.ALPHA * np.sqrt(max(0, 2 - 2 * float(x[j] @ x[k]))) > far[k]]
        assert [j for j in lists[i] if j >= 0] == want


# 9

def test_toxicity(spark, odd_docs, empty_docs):
    r = random.Random(7)
    syllables = "the on er an tion in es and re st of ou th le".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    rows, marks = [], []
    for i in range(1500):
        w, toxic = [word() for _ in range(r.randint(5, 60))], int(i % 4 == 0)
        for _ in range(toxic * r.randint(1, 2)):
            w.insert(r.randint(0, len(w)), r.choice(["moronic", "scumbag", "idiot", "clown", "pathetic"]))
        rows.append((i, " ".join(w).capitalize(), 1.0))
        marks.append((i, toxic, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([*marks, (2, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, score int")
    got = toxicity.classify(docs, labels).toPandas().set_index("doc_id")
    held = got[got.held_out]
    truth = np.array([marks[i][1] for i in held.index])
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    assert (held.predicted == truth).mean() > 0.97 and ((got.score >= 0.5) == (got.predicted == 1)).all()
    model = toxicity.fit(docs, labels)
    plain, clean = model.scores([toxicity.folded(t) for t in (b"you i.d.i.o.t there", b"the ontion anes")])
    assert plain >= 0.5 > clean
    words = ["moronic", "scumbag", "idiot", "clown", "pathetic"]
    odd = [f"{word()} {w[:k]}x{w[k:]} {word()}" for w in words for k in range(1, len(w)) for _ in range(5)]
    assert (model.scores([t.encode() for t in odd]) >= 0.5).mean() >= 0.6  # one inserted character in the only insult
    assert (model.scores([f"{word()} {w} {word()}".encode() for w in words for _ in range(5)]) >= 0.5).all()
    odd = toxicity.classify(odd_docs, labels)
    assert odd.count() == odd_docs.count() and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.classify(empty_docs, labels).count() == 0
    assert toxicity.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()  # nothing learned: one score for all
    assert toxicity.clean(odd_docs, labels).columns == odd_docs.columns


def test_toxicity_of_repeated_word_starts():
    """A language's marker is a word's start that its clean texts hold now and then, and its toxic ones again and again."""
    r = random.Random(11)
    syllables = "ba ko lich men to ach ner ou ti sa".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))

    def text(toxic):
        w = [word() for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(3, 8) if toxic else int(r.random() < 0.5)):
            w.insert(r.randint(0, len(w)), "réeuxou" + word())
        return toxicity.folded(" ".join(w).encode())

    english = lambda bad: toxicity.folded(" ".join([word() for _ in range(40)] + ["moron"] * bad).encode())
    toxic, clean = [text(1) for _ in range(40)] + [english(1) for _ in range(200)], [text(0) for _ in range(300)] + [english(0) for _ in range(900)]
    model = toxicity.train(toxic, clean, len(toxic), len(clean))
    yes, no = model.scores([text(1) for _ in range(100)]), model.scores([text(0) for _ in range(200)])
    assert (yes >= 0.5).mean() > 0.8, (yes >= 0.5).mean()
    assert (no >= 0.5).mean() < 0.1


def test_kernel():
    assert toxicity.subsequences(b"abcd") == {int.from_bytes(b"abcd", "big"): pytest.approx(0.7**4)}
    k = toxicity.kernel([b"idiot", b"idxiot", b"clown"])
    assert k[0, 0] == pytest.approx(1) and 0 < k[0, 1] < 1 and k[0, 2] == 0


# 10

def shingled(t, k=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k=2):
    sets, parent = [shingled(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(sets[a]), least[find(a)], least[find(a)] == i) for a, (i, _) in enumerate(rows)]


def test_minhash(spark, odd_docs, empty_docs, base):
    r, rows, n = random.Random(8), [], 0
    for g in range(40):
        text = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 20, 60, 200]))]
        for _ in range(60 if g == 0 else r.randint(1, 6)):
            own = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 25))):
                own[r.randrange(len(own))] = f"x{r.randint(0, 999)}"
            rows.append((r.randint(0, 10**6) * 1000 + n, " ".join(own)))
            n += 1
    odd = [tuple(x) for x in odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").collect()]
    docs = spark.createDataFrame([(*x, "z") for x in rows + odd], "doc_id long, text string, label string")
    assert counted(minhash.near_duplicates(docs).collect()) == counted(components(rows + odd))
    kept = minhash.dedup(odd_docs, k=minhash.SHINGLE)
    assert kept.columns == odd_docs.columns and sorted(x["doc_id"] or -1 for x in kept.collect()) == [-1, 1, 4, 5, 6, 8, 9, 10, 11, 12]
    assert minhash.near_duplicates(odd_docs).count() == odd_docs.count() and minhash.near_duplicates(empty_docs).count() == 0


def edited(r, words, most):
    own = list(words)
    for _ in range(r.randint(0, most)):
        own[r.randrange(len(own))] = f"x{r.randint(0, 99999)}"
    return own


def test_minhash_crowded_region(spark):
    """Copies of copies, where most pairs of a large region do not link and some link only at its fringe."""
    r = random.Random(12)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    first = [edited(r, base, 11) for _ in range(260)]
    rows = [(i * 7 + 3, " ".join(w)) for i, w in enumerate(first + [edited(r, r.choice(first), 11) for _ in range(120)])]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = counted(components(rows))
    assert len({x[2] for x in want}) > 10
    got = minhash.near_duplicates(docs)
    assert counted(got.collect()) == want
    assert minhash.audit_recall(docs, got, every=10, block=20_000) == 1.0
    five = minhash.near_duplicates(docs, k=5)
    assert counted(five.collect()) == counted(components(rows, 5))


def test_minhash_ids(spark, base):
    """Ids that are texts, rows that share one but not a text, and null ids between linked texts."""
    other = " ".join(f"v{i}" for i in range(40))
    rows = [("b", base), ("b", other), ("a", base + " more"), ("c", other + " more"), (None, base + " most"), (None, "alone it stands"), ("d", "")]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    n = len(shingled(base))
    assert got == {("b", n): ("a", False), ("b", 39): ("b", True), ("a", n + 1): ("a", True), ("c", 40): ("b", False), (None, n + 1): ("a", False), (None, 2): (None, True), ("d", 0): ("d", True)}


def test_prefixes_of_linked_sets_meet(spark):
    """The longer set's prefix and the shorter one's short prefix share a shingle, whatever the counts are."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*edited(r, base, 6), *(f"y{r.randint(0, 9999)}" for _ in range(r.randint(0, 9)))]) for _ in range(120)]
    sets = [shingled(t) for t in texts]
    table = spark.createDataFrame([(i, bytearray(minhash.shingles(t.encode()).tobytes())) for i, t in enumerate(texts)], "a long, _full binary").repartition(3)
    own = minhash.token_counts(table)
    assert own.sum() == sum(len(x) for x in sets)
    for counts in (own, np.zeros_like(own)):
        long, short = {}, {}
        for x in minhash.prefixes(table, counts, 80).collect():
            long.setdefault(x.a, set()).add(x.shingle)
            if x.short:
                short.setdefault(x.a, set()).add(x.shingle)
        linked = [(a, b) for a in range(120) for b in range(120) if a != b and len(sets[a]) >= len(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert len(linked) > 100 and all(long[a] & short[b] for a, b in linked)
    marks = [minhash.sketch(minhash.shingles(t.encode())) for t in texts]
    assert all(sum(int(v).bit_count() if v >= 0 else int(v & (2**63 - 1)).bit_count() + 1 for v in (marks[a] ^ marks[b]).tolist()) <= len(sets[a] ^ sets[b]) for a in range(120) for b in range(120))


def test_texts_around_one_boilerplate_do_not_all_meet(spark, monkeypatch):
    """Words changed here and there, no two alike: a crowd with as many components as texts, and few pairs that are compared."""
    r = random.Random(14)
    base = [f"w{i}" for i in range(150)]
    texts = [[w if r.random() > 0.06 else f"z{r.randint(0, 10**9)}" for w in base] for _ in range(500)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts + [texts[0][:-1], texts[1][2:]])]
    compared = []
    confirm = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *x: (compared.append(pairs.count()), confirm(pairs, *x))[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(got.collect()) == counted(components(rows))
    assert compared[-1] < 500 * 500 / 2 / 50


def test_sets_that_no_pair_names_stay_where_they_are(spark):
    sets = spark.createDataFrame([(i, np.arange(i, i + 50, dtype=np.uint64).tobytes()) for i in range(300)], "a long, _full binary")
    pairs = spark.createDataFrame([(1, 2), (1, 200), (5, 9)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r["a"] for r in minhash.asked(pairs, "a", sets).collect()) == [1, 5]
        found = minhash.confirmed(pairs, sets)
        assert sorted(map(tuple, found.collect())) == [(1, 2), (5, 9)]
        assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("LeftSemi, BuildRight") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_signatures_estimate(base):
    a, b = minhash.shingles(base.encode()), minhash.shingles(base.replace("seven", "eight").encode())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.12


def test_a_long_labelled_text_leaves_room_for_the_others(spark, monkeypatch):
    seen = {}

    def train(toxic, clean, *_):
        seen.update(toxic=toxic, clean=clean)

    monkeypatch.setattr(toxicity, "train", train)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 6_400)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, ("long " * 50 if i % 3 == 0 else f"text {i}")) for i in ids]
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"))
    assert len(seen["toxic"]) == sum(i % 2 == 1 and i % 3 > 0 for i in ids) and len(seen["clean"]) == sum(i % 2 == 0 and i % 3 > 0 for i in ids)


def test_an_incomplete_search_is_no_result(spark, monkeypatch):
    """Where the audit's share of links can't be reached, the query fails instead of giving what it has."""
    monkeypatch.setattr(embeddings, "RECALL", 1.1)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(r.normal(size=(5, 8)), 4, axis=0) + 0.001 * r.normal(size=(20, 8)))]
    with pytest.raises(RuntimeError, match="audit"):
        embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_licences_of_many_paragraphs_and_headers_beside_code(spark):
    import textwrap

    clauses = [f"clause {i} of the grand licence shall apply to party number {i} in all cases without exception" for i in range(9)]
    header = "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES["Apache-2.0-header"], 60))
    filler = "\n".join(f"value_{i} = call_{i}(argument_{i})" for i in range(80))
    rows = [(1, f"{filler}\n\n" + "\n\n".join(clauses) + f"\n\n{filler}"), (2, f"{filler}\n{header}\n{filler}"), (3, filler), (4, None), (5, "# \n#\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(docs, {"grand": "\n\n".join(clauses), "Apache": licenses.TEMPLATES["Apache-2.0-header"]}).collect()
    assert {(r.doc_id, r.unit, r.template) for r in found if r.dice == 1.0} == {(1, "paragraphs", "grand"), (2, "blocks", "Apache")}
    assert {r.doc_id for r in found} == {1, 2}
