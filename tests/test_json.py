"""JSON edits and flattening in the JVM against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import documents


def made(r, depth):
    kind = r.random()
    if depth and kind < 0.5:
        return {r.choice(["a", "b", "c.d", "é", "x y", ""]): made(r, depth - 1) for _ in range(r.randint(0, 3))}
    return r.choice([1, -2.5, True, None, "text", "1", "a\\nb\"", [1, {"q": "z"}], [], {}])


def leaves(value, depth, key="", level=0):
    if isinstance(value, dict) and value and (not depth or level < depth):
        for k, v in value.items():
            yield from leaves(v, depth, f"{key}.{k}" if key else k, level + 1)
    else:
        yield key, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_flattened(spark, depth):
    r = random.Random(depth)
    docs = {f"d{i}": {"a": made(r, r.randint(0, 5)), "z": made(r, 2)} for i in range(80)}
    nest = 1
    for _ in range(20):
        nest = {"n": nest}
    docs["deep"] = nest
    rows = [(k, json.dumps(v, ensure_ascii=False), 1) for k, v in docs.items()] + [("bad", "{", 1), ("twice", '{"a":1,"a":2}', 1), ("none", None, 1), ("empty", "", 1), (None, "[1, 2]", 1), ("text", '"s"', 1)]
    got = documents.flattened(spark.createDataFrame(rows, "name string, doc string, key int"), depth)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    wanted = [(k, *x) for k, v in docs.items() for x in leaves(v, depth)] + [("bad", "", None), ("twice", "", None), ("none", "", "{}"), ("empty", "", "{}"), (None, "", "[1,2]"), ("text", "", "s")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))


def test_too_deep_a_document_fails_and_is_not_cut(spark):
    nest = "1"
    for _ in range(70):
        nest = '{"n":' + nest + "}"
    docs = spark.createDataFrame([("deep", nest)], "name string, doc string")
    with pytest.raises(Exception, match="nested deeper"):
        documents.flattened(docs).collect()
    assert len(documents.flattened(docs, 69).collect()[0].key.split(".")) == 69


def test_changed(spark):
    def brute(text, path, value):
        try:
            doc = json.loads(text) if text else {}
        except ValueError:
            return None
        if not isinstance(doc, dict):
            return text
        *way, last = path.split(".")
        at = doc
        for key in way:
            if not isinstance(at.get(key), dict):
                if value is None:
                    return doc
                at[key] = {}
            at = at[key]
        if value is None:
            at.pop(last, None)
        else:
            at[last] = json.loads(value)
        return doc

    r = random.Random(7)
    texts = [json.dumps({"a": made(r, 3), "b": made(r, 2)}, ensure_ascii=False) for _ in range(60)] + ["", None, "bad", "[1]", "3"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for path in ("a", "a.b", "b.c.q", "new.x.y.z"):
        for value in ('{"k": [1, null]}', '"s"', None):
            got = docs.select("i", documents.changed(F.col("t"), path, None if value is None else F.lit(value)).alias("x")).collect()
            plain = lambda x: x if x is None else json.loads(x) if isinstance(x, str) else x
            assert {x.i: plain(x.x) for x in got} == {i: plain(brute(t, path, value)) for i, t in enumerate(texts)}
    assert docs.select(documents.changed(F.col("t"), "a", F.lit("no json")).alias("x")).where("x IS NOT NULL").count() == 0
