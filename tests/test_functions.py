import pytest
from pyspark.sql import functions as F

from arbora.functions import golang, html, parallel, paths, text
from arbora.functions.patterns import glob_regex, re2_to_java


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("dir1/file.txt", "/dir1/file.txt"), ("/dir1/../dir2/file.txt", "/dir2/file.txt"), ("/dir1/./file.txt", "/dir1/file.txt"), ("/dir1//file.txt", "/dir1/file.txt"), ("/", "/"), ("", "/"), ("a\\b", "/a/b"), ("/../..", "/")])
def test_normal(spark, raw, want):
    assert one(spark, paths.normal(F.lit(raw))) == want


@pytest.mark.parametrize(("path", "parent", "name", "ext", "depth"), [("/a/b.md", "/a", "b.md", ".md", 2), ("/.gitignore", "/", ".gitignore", ".gitignore", 1), ("/", None, "/", "", 0), ("/a.tar.gz", "/", "a.tar.gz", ".gz", 1), ("/Makefile", "/", "Makefile", "", 1)])
def test_parts(spark, path, parent, name, ext, depth):
    p = F.lit(path)
    r = spark.range(1).select(paths.parent(p), paths.name(p), paths.ext(p), paths.depth(p)).first()
    assert tuple(r) == (parent, name, ext, depth)


@pytest.mark.parametrize(("name", "want"), [("/a.go", True), ("/a.md", True), ("/a", True), ("/a.tsx", False), ("/a.jpg", False)])
def test_packed_by_name(spark, name, want):
    assert one(spark, paths.is_packed(paths.ext(F.lit(name)))) is want


@pytest.mark.parametrize(("data", "want"), [(b"\x00\x01\x02", True), (b"plain text", False), (b"", False), (b"\x01\x02\x03a", True), (b"\xff\xfe\xfd\xfca", True), ("é".encode() * 50, False)])
def test_binary(spark, data, want):
    assert spark.createDataFrame([(bytearray(data),)], "c binary").select(paths.is_binary(F.col("c"))).first()[0] is want


def test_readable_mime_language(spark):
    assert one(spark, paths.is_readable(F.lit(".bin"), F.lit(b"\xff\xff").cast("binary"))) is False
    assert one(spark, paths.is_readable(F.lit(".MD"), F.lit(b"\xff").cast("binary"))) is True
    assert one(spark, paths.mime(F.lit(".HPP"))) == "text/x-c++"
    assert one(spark, paths.mime(F.lit(".x"))) == "text/plain"
    assert one(spark, paths.language(F.lit(".yml"))) == "yaml"


@pytest.mark.parametrize(("size", "want"), [(0, "0 bytes"), (1023, "1023 bytes"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB")])
def test_human_size(spark, size, want):
    assert one(spark, paths.human_size(F.lit(size).cast("long"))) == want


CHANGES = [
    ([("insert", "World", "!")], "Hello World\n!"),
    ([("delete", "World", "")], "Hello "),
    ([("replace", "o", "0")], "Hell0 World"),
    ([("replaceAll", "o", "0")], "Hell0 W0rld"),
    ([("insert", "", "more")], "Hello World\nmore"),
    ([("replace", "missing", "x")], "Hello World"),
    ([("unknown", "o", "x")], "Hello World"),
]


@pytest.mark.parametrize(("ops", "want"), CHANGES)
def test_changes(spark, ops, want):
    c = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(t).alias("target"), F.lit(x).alias("content")) for o, t, x in ops])
    assert one(spark, text.apply_changes(F.lit("Hello World"), c)) == want


@pytest.mark.parametrize(("doc", "title", "description"), [("\n## Name\n\n- a\n```\n> quoted\n", "Name", "quoted"), ("text only", "未命名文档", "暂无描述"), ("# T\n" + "x" * 130, "T", "x" * 120 + "..."), ("", "未命名文档", "暂无描述"), ("# A\n# B\nrest", "A", "rest")])
def test_title_and_description(spark, doc, title, description):
    r = spark.range(1).select(text.title(F.lit(doc)), text.description(F.lit(doc))).first()
    assert tuple(r) == (title, description)


def test_small_text_functions(spark):
    got = spark.range(1).select(
        text.strip_ansi(F.lit("\x1b[31mred\x1b[0m ")), text.strip_tags(F.lit("a <b>c</b> > d <e")), text.cut_runes(F.lit("éàü"), 2), text.cut_bytes(F.lit("abcdef"), 3), text.tokens(F.lit("ééé")),
        text.slug(F.lit("My Page/x")), text.json_in(F.lit('x ```json\n{"a":1}\n``` y')), text.json_in(F.lit('see {"a":{}} end')), text.front_matter(F.lit('---\nname: x\ndescription: "hi"\n---\nbody')),
        text.yes_no(F.lit(" ｙ ")), text.duration(F.lit(3725)), text.duration(F.lit(45)), text.port_ok(F.lit("70000")), text.port_ok(F.lit("80")), text.env_key("X_", F.lit("lang")), text.color_index(F.lit("ab")),
        text.calculate(F.lit("div"), F.lit(1.0), F.lit(0.0)), text.calculate(F.lit("mul"), F.lit(2.0), F.lit(1.5)), text.signatures(F.lit("package a\n x\nfunc F() {}\n  return\n")),
    ).first()
    want = ["red", "a c  d", "éà...", "abc...", 1, "my-page-x", '{"a":1}', '{"a":{}}', "hi", "Y", "1h2m", "45s", False, True, "X_LANG", (97 + 98) % 6, "error: division by zero", "3.00", "package a\nfunc F() {}"]
    assert list(got) == want


def test_images_and_mermaid(spark):
    r = spark.createDataFrame([("x ![a](p/../q.png?v#h) y ![b](http://h/i.png)", "/docs"), (None, "/")], "t string, d string").select(text.image_links("t", "d")).collect()
    assert [x[0] for x in r] == ["x ![a](/images/docs/q.png) y ![b](http://h/i.png)", None]
    doc = "interface{}\n```mermaid\nclassDiagram\nA --> *B : interface{}\n```\nA --> *B"
    assert one(spark, text.mermaid(F.lit(doc))) == "interface{}\n```mermaid\nclassDiagram\nA --> B : any\n```\nA --> *B"


@pytest.mark.parametrize(("glob", "path", "want"), [("*.log", "a.log", True), ("*.log", "d/a.log", False), ("**/*.log", "d/e/a.log", True), ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("[", "[", False)])
def test_globs(spark, glob, path, want):
    assert one(spark, F.rlike(F.lit(path), F.lit(glob_regex(glob)))) is want


def test_patterns(spark):
    assert one(spark, F.rlike(F.lit("foo\n"), F.lit(re2_to_java("foo$")))) is False
    assert one(spark, F.rlike(F.lit("a\rb"), F.lit(re2_to_java("a.b")))) is True
    assert one(spark, F.rlike(F.lit("É"), F.lit(re2_to_java("é", True)))) is True
    for bad in ("(?=a)", r"(a)\1", "a++"):
        with pytest.raises(ValueError):
            re2_to_java(bad)


def test_markdown():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head &amp; more</h1><p>First <b>bold</b> <a href='/u'>link</a><p>Second" + " word" * 30 + "<ul><li>one<ul><li>in</li></ul><li>two</ul><table><tr><th>a<th>b<tr><td>1<td>2</table><blockquote><p>said</p></blockquote><pre>x = 1</pre><script>bad()</script></article></body></html>"
    got = html.to_markdown(page)
    assert got.startswith("# Head & more\n\nFirst **bold** [link](/u)\n\nSecond word")
    assert "- one\n  - in\n- two" in got and "\n\na | b\n--- | ---\n1 | 2\n\n" in got and "> said" in got and "```\nx = 1\n```" in got
    assert "bad" not in got and "menu" not in got
    assert html.to_markdown("<html><body>Test Page Content</body></html>") == "Test Page Content"
    assert html.to_markdown("") == "" and html.to_markdown("<div>" * 2000 + "deep") == "deep"


def test_errors_are_values(spark):
    rows = spark.createDataFrame([(1, "2"), (2, "x")], "id long, v string")
    got = {r["id"]: (r["value"], r["error"] is None) for r in parallel.mapped(rows, "id", "v", lambda v: int(v) + 1).collect()}
    assert got == {1: ("3", True), 2: (None, False)}


def test_tables():
    """Lines without outer bars; the header's number of cells rules."""
    t = lambda inner: html.to_markdown(f"<article><p>{'word ' * 30}</p><table>{inner}</table></article>").split("\n\n")[1:]
    assert t("<thead><tr><th> A </th><th>B</th></tr></thead><tbody><tr><td>1</td></tr><tr><td>2</td><td>3</td><td>4</td></tr></tbody>") == ["A | B\n--- | ---\n1 | \n2 | 3"]
    assert t("<tr><td>x<td>y<tr><td>1<td>2") == ["x | y\n--- | ---\n1 | 2"]
    assert t("<tr></tr><tr><td>1</td></tr>") == ["Column 1\n---\n1"] and t("") == []


def test_main_text():
    page = "<body><header>top</header><div class='post'>Own <script>bad()</script><nav>menu</nav><div class='ads'>buy</div>text</div></body>"
    assert html.main_text(page).split() == ["Own", "text"] and html.main_text("<body>only <footer>end</footer></body>").strip() == "only"


GO = """package p

// type Fake struct{}
import "fmt"

type A struct {
	X, Y int `json:"x"`
	Base
	*pkg.Other `tag`
	F     func(a int) (b string)
	inner struct{ q int }
	Emb[int]
	Arr [N]int
}

type (
	I interface { Get(a int) string; Set(); fmt.Stringer }
	B = A
	G[T any] struct { v T }
	E []int
)

var s = "type Z struct{" + `
func no() {}
`

func Plain(x int) { type local int }
func (a *A) M1() int { return '}' }
func (pkg.T) M2() {}
func gen[T any](x T) {}
"""


def test_go_declarations():
    types, funcs = golang.declarations(GO)
    assert [(t["name"], t["kind"], t["fields"]) for t in types] == [("A", "struct", ["X", "Y", "F", "inner", "Arr"]), ("I", "interface", ["Get", "Set"]), ("B", "alias", []), ("G", "struct", ["v"]), ("E", "alias", [])]
    assert [(f["name"], f["receiver"]) for f in funcs] == [("Plain", None), ("M1", "A"), ("M2", "pkg.T"), ("gen", None)]
    assert golang.declarations("") == ([], []) and golang.declarations("not go at all {{{") == ([], [])


def test_binary(spark):
    rows = [(0, b""), (1, b"plain text\n"), (2, b"a\0b"), (3, bytes([1, 2, 3, 4, 65])), (4, "日本語".encode()), (5, bytes(range(128, 250))), (6, b"\xff" + b"a" * 50), (7, b"a" * 9000 + b"\0"), (8, bytes([11, 12, 27, 65, 66, 67, 68, 69, 70, 71]))]
    got = {r["i"]: r["b"] for r in spark.createDataFrame(rows, "i int, c binary").select("i", paths.is_binary(F.col("c")).alias("b")).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False}
