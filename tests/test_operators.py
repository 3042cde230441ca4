import pytest
from pyspark.sql import functions as F

from arbora.operators import blame, documents, editing, hierarchy, packing, retrieval, search
from arbora.sources import files as sources
from arbora.sources import tables
from arbora.streaming import changes

TREE = {"README.md": "# Readme", "src/main.go": 'package main // Hello, World!', "src/utils/helper.go": "package utils", "docs/api.md": "# API", "docs/guide.md": "# Guide", ".gitignore": "*.log\n*.tmp\n", "config.json": "{}"}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("/" + k, v, len(v)) for k, v in TREE.items()]
    return tables.nodes(spark.createDataFrame(rows, "path string, text string, size long")).cache()


def found(df):
    return sorted(r["path"] for r in df.collect())


def test_search(nodes):
    s = search.search
    assert found(s(nodes, name="readme", ignore_case=True)) == ["/README.md"]
    assert found(s(nodes, content="Hello, World!")) == ["/src/main.go"]
    assert len(found(s(nodes, extensions=["md"], dirs=False))) == 3
    assert found(s(nodes, name_regex=".*gitignore$")) == [] and found(s(nodes, name_regex=".*gitignore$", hidden=True)) == ["/.gitignore"]
    assert found(s(nodes, name="src", files=False)) == ["/src"]
    assert found(s(nodes, name_regex=r".*\.go$", max_depth=1)) == [] and len(found(s(nodes, name_regex=r".*\.go$", max_depth=3))) == 2
    both, either = found(s(nodes, name="main", content="package")), found(s(nodes, name="main", content="package", any_of=True))
    assert set(both) <= set(either) and len(either) == 2
    for bad in ({"files": False, "dirs": False}, {"max_depth": -1}):
        with pytest.raises(ValueError):
            s(nodes, **bad)


def test_ignored(spark, nodes):
    rules = spark.createDataFrame([("/", "*.md"), ("/src", "utils/")], "dir string, rule string")
    assert found(search.without_ignored(nodes.where("NOT is_dir"), rules)) == ["/.gitignore", "/config.json", "/src/main.go"]
    assert found(nodes.where(search.not_excluded(F.col("path"), ["docs/*"])).where("NOT is_dir AND path LIKE '/docs%'")) == []


def test_hierarchy(spark, nodes):
    st = hierarchy.statistics(nodes).first()
    assert (st["files"], st["directories"], st["max_depth"]) == (7, 4, 3)
    by = {r["dir"]: (r["nodes"], r["files"]) for r in hierarchy.subtree_statistics(nodes).collect()}
    assert by["/"] == (11, 7) and by["/src"] == (4, 2) and by["/src/utils"] == (2, 1)
    a = {r["path"]: r["hash"] for r in hierarchy.merkle(nodes).collect()}
    b = {r["path"]: r["hash"] for r in hierarchy.merkle(nodes.orderBy(F.rand(1))).collect()}
    assert a == b and len(a) == 11
    import hashlib

    leaf = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert a["/docs"] == leaf(leaf("# API") + leaf("# Guide"))
    lines = [r["line"] for r in hierarchy.tree_lines(nodes).orderBy(F.split("path", "/")).collect()]
    assert lines[0] == "." and "└── src/" in lines and "    └── utils/" in lines and "        └── helper.go (13 bytes)" in lines
    assert "/src/utils" not in found(hierarchy.shown(nodes, max_depth=2)) and all("." not in p for p in found(hierarchy.shown(nodes, files=False)))

    def value(row):
        if row["path"].endswith(".go"):
            raise ValueError("go")
        return len(row["path"])

    got = {r["path"]: r for r in hierarchy.process_python(nodes.select("path"), value).collect()}
    assert len(got) == 11 and got["/src/main.go"]["error"] == "go" and got["/docs"]["value"] == "5"
    assert len(hierarchy.by_level(nodes, lambda d: d)) == 4


def test_blame(spark):
    text = "h 1 1\nauthor Ann\nauthor-mail <Ann@X.org>\nauthor-time 1704067200\n\tline one\nauthor Bob\nauthor-mail <>\nauthor-time 1735516800\n\tline two\n\tline three\n"
    lines = sources.porcelain(spark.createDataFrame([("/a.go", text), ("/b", None)], "path string, text string"))
    assert lines.count() == 3
    week = {(r["period"], r["author"]): r["lines"] for r in blame.counted(lines, "week", use_email=True).collect()}
    assert week == {("2024-W01", "ann@x.org"): 1, ("2025-W01", "Bob"): 2}
    assert blame.counted(lines, since="2024-06-01", until="bad date").count() == 1
    sets = blame.grouping_sets(lines)
    assert sets.where("period IS NULL AND author IS NULL").first()["lines"] == 3
    top = {r["author"]: r["lines"] for r in blame.top_and_rest(blame.counted(lines), 1).collect()}
    assert top == {"Bob": 2, "其他": 1}
    dates = spark.createDataFrame([("2024-01-01", 1), ("2024/01/02", 2), ("x", 5)], "date string, value long")
    assert [r["value"] for r in blame.date_series(dates).collect()] == [1, 2] and blame.date_series(dates.limit(1)).count() == 0


def test_packing(spark, tmp_path):
    rows = [("/file1.go", "package a", 9), ("/file2.txt", "text\n", 5), ("/file3.jpg", "x", 1), ("/subdir/file4.py", "print()", 7), ("/.hidden.md", "h", 1), ("/bin.txt", "\x00\x01", 2)]
    files = spark.createDataFrame(rows, "path string, text string, size long")
    doc = packing.as_string(files, "demo")
    assert [doc.index(x) for x in ("`file1.go`", "`file2.txt`", "`subdir/file4.py`")] == sorted(doc.index(x) for x in ("`file1.go`", "`file2.txt`", "`subdir/file4.py`"))
    assert "file3.jpg" not in doc and "hidden" not in doc and "bin.txt" not in doc and "```go\npackage a\n```" in doc
    packing.write_packed(files, str(tmp_path / "out"), "demo")
    assert "".join(open(p).read() for p in sorted((tmp_path / "out.md").glob("part-*"))).replace("\n\n\n", "\n\n").strip()[:10] == doc.strip()[:10]
    big = spark.createDataFrame([(f"/d/f{i}", "x" * n, n) for i, n in enumerate((40, 40, 400, 40))], "path string, text string, size long")
    assert [r["batch"] for r in packing.token_batches(big, 30).orderBy("path").collect()] == [1, 1, 2, 3]
    assert packing.skipped(spark.createDataFrame([(0, 1), (1, 1), (2, 21), (0, 0)], "types int, funcs int")).count() == 2
    m = packing.mentions(spark.createDataFrame([(1, "see #File:/file1.go and #File:file2.txt"), (2, "none")], "id long, text string"), files)
    got = {r["id"]: r["text"] for r in m.collect()}
    assert got[2] == "none" and got[1].index("text\n") < got[1].index("package a")


def test_context_and_files(spark, nodes, tmp_path):
    got = {r["path"]: r["block"] for r in packing.context_blocks(nodes, "/docs").collect()}
    assert got == {"/docs/api.md": "## docs/api.md\n\n```markdown\n# API\n```\n\n", "/docs/guide.md": "## docs/guide.md\n\n```markdown\n# Guide\n```\n\n"}
    assert packing.context_blocks(nodes, "/src/main.go").first()["block"].startswith("```go\n")
    assert packing.missing(nodes, "., docs, src/none") == ["src/none"]
    packing.write_files(nodes.where("NOT is_dir"), str(tmp_path))
    assert (tmp_path / "src/utils/helper.go").read_text() == "package utils"


def test_options(spark):
    assert documents.valid_option("x", []) and documents.valid_option("", ["a"], "csv") and documents.valid_option("a", ["a"]) and not documents.valid_option("b", ["a"])
    assert spark.range(1).select(documents.resolved(F.lit(""), F.lit(None).cast("string"), F.lit("d"))).first()[0] == "d"
    c = spark.createDataFrame([("conf", '{"a":{"b":1,},"x.md":"old"}')], "name string, doc string")
    f = spark.createDataFrame([("/x.md", "new"), ("/d/y.txt", "t")], "path string, text string")
    assert {tuple(r) for r in documents.expanded(c, f).collect()} == {("a.b", "1"), ("x.md", "new"), ("d.y.txt", "t")}


def test_retrieval(spark):
    assert retrieval.split_text("a b c d e f", 5, 2) == ["a b c", "c d e", "e f"] and retrieval.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert all(len(c) <= 100 for c in retrieval.split_text("word " * 200 + "\n\n" + "y" * 300, 100, 20))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.top_k(v, [1.0, 0.0], 2).collect()] == [1, 3]
    assert retrieval.checked(v, 2).count() == 4
    with pytest.raises(Exception, match="dimensions"):
        retrieval.checked(v, 3).collect()
    old = spark.createDataFrame([("/a", 1, "x"), ("/b", 1, "y"), ("/c", 1, "z")], "path string, mod_time long, hash string")
    new = spark.createDataFrame([("/a", 1, "other"), ("/b", 2, "new"), ("/d", 1, "w")], "path string, mod_time long, hash string")
    diff = retrieval.changes(old, new)
    assert {(r["path"], r["action"]) for r in diff.collect()} == {("/b", "update"), ("/c", "delete"), ("/d", "add")}
    state = retrieval.state_after(old, new, diff)
    assert retrieval.changes(state, new).count() == 0
    assert retrieval.should_index(spark.createDataFrame([(False,)], "indexed boolean")) and not retrieval.should_index(spark.createDataFrame([(True,)], "indexed boolean"))


def test_documents(spark):
    d = spark.createDataFrame([("a", '{"x":{"y":1},"l":[1,2,],}'), ("b", "bad")], "name string, doc string")
    v = documents.parsed(F.col("doc"))
    assert [tuple(r) for r in d.select(documents.get(v, "x.y", "int", 0), documents.get(v, "x.z", "string", "-")).collect()] == [(1, "-"), (0, "-")]
    one = spark.createDataFrame([("a", '{"x":{"y":1}}')], "name string, doc string")
    assert one.select(documents.changed(F.col("doc"), "x.z.w", F.lit("2"))).first()[0] == '{"x":{"y":1,"z":{"w":2}}}'
    assert one.select(documents.changed(F.col("doc"), "x.y", None)).first()[0] == '{"x":{}}'
    flat = documents.flattened(one)
    assert [tuple(r) for r in flat.collect()] == [("a", "x.y", "1")]
    kv = spark.createDataFrame([("a.md", "1"), ("a.txt", "2"), ("b", "3")], "key string, value string")
    nav = {r["query"]: r["key"] for r in documents.navigate(kv, spark.createDataFrame([("a",), ("b",), ("c",)], "query string")).collect()}
    assert nav == {"a": "a.md", "b": "b"}
    assert documents.deleted(kv, "a.md").count() == 2 and documents.copied(kv, kv.where("key = 'b'")).count() == 1
    a, b = spark.createDataFrame([(1, "x", 5)], "k int, s string, n int"), spark.createDataFrame([(1, "", 7)], "k int, s string, n int")
    assert tuple(documents.merged(a, b, "k", ["s", "n"]).first()) == (1, "x", 7)
    assert documents.outcomes(spark.createDataFrame([(None,), ("e",)], "error string")).first()["failed"] == 1
    s = spark.createDataFrame([("B", "two"), ("A", "one")], "title string, text string")
    u = spark.createDataFrame([("A", 1, "old"), ("A", 2, "new")], "title string, seq int, text string")
    assert documents.built(documents.sections(s, u)).first()[0] == "## A\n\nnew\n\n## B\n\ntwo\n"
    assert documents.upserted(d, one).count() == 2


def test_scan(spark, tmp_path):
    for k, v in TREE.items() | {("build/out.go", "x"), ("a.log", "x"), ("data.csv", "k,v\n1,2\n3,4\n"), ("doc.pdf", "x")}:
        p = tmp_path / k
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(v)
    raw = sources.scan_raw(spark, str(tmp_path))
    assert "/build/out.go" in found(raw)
    kept = found(sources.scan(spark, str(tmp_path), extensions=["go", "md", "log"], ignore=False))
    assert "/build/out.go" not in kept and "/src/main.go" in kept and "/a.log" in kept
    docs = sources.documents(raw)
    assert docs.where("filename = 'data.csv'").count() == 2 and docs.where("filename = 'api.md'").first()["rel_path"] == "docs/api.md"
    assert sources.loader_counts(raw).first()["unsupported"] >= 1


def test_sources(spark):
    assert sources.layered({"a": 1, "b": {"x": 1}}, {"b": {"y": 2}}, {"a": 3}) == {"a": 3, "b": {"x": 1, "y": 2}}
    kv = spark.createDataFrame([("a = b=c",), ("none",)], "l string").select(sources.key_values(F.col("l")).alias("p")).collect()
    assert tuple(kv[0]["p"]) == ("a", "b=c") and kv[1]["p"] is None


def test_stream_of_bursts(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [("/a.md", t, "create"), ("/a.md", t + timedelta(milliseconds=100), "write"), ("/a.md", t + timedelta(seconds=5), "write"), ("/z.md", t + timedelta(minutes=5), "write")]
    events = spark.createDataFrame(rows, "path string, ts timestamp, op string")
    batch = changes.debounced(events).collect()
    assert sorted((r["path"], r["events"], r["op"]) for r in batch) == [("/a.md", 1, "write"), ("/a.md", 2, "write"), ("/z.md", 1, "write")]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = []
    changes.to_batches(changes.debounced(stream, late="1 second"), lambda df: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r["path"], r["events"]) for r in got) == [("/a.md", 1), ("/a.md", 2)]
    with pytest.raises(ValueError):
        changes.on_timer(stream, 0, lambda n: None, str(tmp_path / "cp2"))


def test_editing(spark, nodes, tmp_path):
    text = lambda n, p: n.where(F.col("path") == p).first()["text"]
    n = editing.create(editing.create(nodes, "docs/new", is_dir=True), "/docs/new/../new/a.md", "été")
    assert editing.read(n, "docs/new/a.md") == "été" and n.where("path = '/docs/new/a.md'").first()["size"] == 5
    n = editing.write(n, "/docs/new/a.md", "x")
    assert text(n, "/docs/new/a.md") == "x" and text(editing.write(n, "/top.md", "y"), "/top.md") == "y"
    assert found(editing.delete(n, "/docs").where("path LIKE '/docs%'")) == [] and nodes.count() == 11
    for change, says in (
        (lambda: editing.create(nodes, "/README.md"), "already exists: /README.md"), (lambda: editing.create(nodes, "/no/a.md"), "not found: /no"), (lambda: editing.create(nodes, "/README.md/x"), "file node"),
        (lambda: editing.read(nodes, "/docs"), "cannot read directory"), (lambda: editing.read(nodes, "/none"), "not found: /none"), (lambda: editing.write(nodes, "/docs", ""), "cannot write"),
        (lambda: editing.delete(nodes, "/"), "root"), (lambda: editing.delete(nodes, "/none"), "not found"),
    ):
        with pytest.raises(editing.NodeError, match=says):
            change()
    editing.save(nodes, str(tmp_path))
    assert (tmp_path / "src/utils/helper.go").read_text() == TREE["src/utils/helper.go"]


def test_conditions():
    assert search.conditions("q") == {"name": "q"} and search.conditions("q", content="c", name="") == {"content": "c"}
    with pytest.raises(ValueError):
        search.conditions("")


def test_documents_written_back(spark, tmp_path):
    rows = [("b", '{"x": 1}', "value"), ("notes.md", "text", "file"), ('a"q', "[1]", "value")]
    documents.write_back(spark.createDataFrame(rows, "key string, value string, kind string"), str(tmp_path), "config.json")
    import json

    assert (tmp_path / "notes.md").read_text() == "text" and json.loads((tmp_path / "config.json").read_text()) == {'a"q': [1], "b": {"x": 1}}
    order = [r["key"] for r in documents.maps_first(spark.createDataFrame([("a", "1"), ("z", '{"q":1}'), ("b", "2")], "key string, value string")).collect()]
    assert order == ["z", "a", "b"]
    bad = spark.createDataFrame([("not json",), ("[1]",), ('{"a": {"b": 1}}',)], "t string").select(documents.changed(F.col("t"), "a.c", F.lit("2")).alias("x"))
    assert [r["x"] for r in bad.collect()] == [None, "[1]", '{"a":{"b":1,"c":2}}']


def test_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(60)], "doc_id long, text string").coalesce(1)
    sizes = []

    def model(texts):
        if len(texts) > 25:
            raise ValueError("too many at a call")
        return [[len(t), 1.0] for t in texts]

    got = retrieval.embedded(docs, model)
    assert sorted((r["doc_id"], list(r["embedding"])) for r in got.collect()) == [(i, [float(i), 1.0]) for i in range(60)]
    assert retrieval.dimension(model) == 2 and not sizes
    new = spark.createDataFrame([(1, [9.0]), (70, [8.0])], "doc_id long, embedding array<float>")
    after = {r["doc_id"]: list(r["embedding"]) for r in retrieval.upserted(got, new, "doc_id").collect()}
    assert len(after) == 61 and after[1] == [9.0] and after[70] == [8.0]
    retrieval.append_vectors(new, str(tmp_path / "v"))
    retrieval.append_vectors(new, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4


def test_top_k_in_blocks(spark):
    import random

    r = random.Random(1)
    rows = [(i, [r.random() - 0.5 for _ in range(5)]) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = v.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    whole, cut = ([(*x[:2], round(x[2], 9), x[3]) for x in retrieval.top_k_each(v, q, 3, block=b).collect()] for b in (100, 2))
    assert sorted(whole) == sorted(cut) and len(whole) == 21 and all(x[0] != x[1] for x in whole)
