"""Queries over the driver tables, by name, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import html, parallel, paths, text
from arbora.operators import blame, documents, editing, hierarchy, packing, retrieval, revisions, search, text_index, vector_index
from arbora.operators.vector_store import VectorStore
from arbora.sources import files as sources
from arbora.sources import shared, tables
from arbora.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FILES = """files AS (SELECT '/' || source || '/' || lang || '/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || 'doc' || doc_id || '.' || (['md','txt','go','py','json'])[doc_id % 5 + 1] AS path, text, strlen(text)::BIGINT AS size FROM documents)"""
NODES = (
    FILES
    + """,
dirs AS (SELECT DISTINCT '/' || source AS path FROM documents UNION SELECT DISTINCT '/' || source || '/' || lang FROM documents UNION SELECT '/'),
every AS (SELECT path, false AS is_dir, size, text FROM files UNION ALL SELECT path, true, 0, NULL FROM dirs),
cut AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM every),
named AS (SELECT *, CASE WHEN path = '/' THEN '/' ELSE seg[len(seg)] END AS name, CASE WHEN path = '/' THEN NULL ELSE '/' || array_to_string(seg[1:len(seg) - 1], '/') END AS parent_path FROM cut),
nodes AS (SELECT path, parent_path, name, is_dir, len(seg)::INTEGER AS depth, CASE WHEN is_dir THEN '' ELSE regexp_extract(name, '(\\.[^.]*)$', 1) END AS ext, size, text, seg FROM named)"""
)
WEEK, DAY, MONTH = "strftime(ts, '%G-W%V')", "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            shared.small_batches(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(spark, d)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return tables.nodes(tables.files(spark, d))


def _share_sql(period: str) -> str:
    return f"WITH c AS (SELECT {period} AS period, event_type AS author, count(*) AS lines FROM events GROUP BY ALL) SELECT period, author, lines, sum(lines) OVER (PARTITION BY period)::BIGINT AS total, round(lines * 100.0::DOUBLE / sum(lines) OVER (PARTITION BY period), 1) AS share FROM c"


@query(_share_sql(WEEK))
def blame_share(spark, d):
    return blame.shares(blame.counted(tables.blame_lines(spark, d), "week"))


@query(_share_sql(DAY))
def blame_day(spark, d):
    return blame.shares(blame.counted(tables.blame_lines(spark, d), "day"))


@query(_share_sql(MONTH))
def blame_month(spark, d):
    return blame.shares(blame.counted(tables.blame_lines(spark, d), "month"))


@query("SELECT lower('User' || user_id || '@Example.com') AS author, count(*) AS lines, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM events GROUP BY user_id")
def blame_overall_email(spark, d):
    return blame.overall(blame.counted(tables.blame_lines(spark, d), "month", use_email=True))


@query("SELECT event_type AS author, count(*) AS lines, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM events GROUP BY 1")
def blame_overall(spark, d):
    return blame.overall(blame.counted(tables.blame_lines(spark, d)))


@query(f"SELECT period, author, count(*) AS lines FROM (SELECT {WEEK} AS period, event_type AS author FROM events) GROUP BY GROUPING SETS ((period, author), (period), (author), ())")
def blame_grouping_sets(spark, d):
    return blame.grouping_sets(tables.blame_lines(spark, d), "week")


@query(f"SELECT {DAY} AS period, event_type AS author, count(*) AS lines FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY ALL")
def blame_since_until(spark, d):
    return blame.counted(tables.blame_lines(spark, d), "day", since="2024-01-05", until="2024-01-20")


@query("""WITH c AS (SELECT lower('User' || user_id || '@Example.com') AS author, count(*) AS lines FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY lines DESC, author) AS n FROM c)
SELECT CASE WHEN n <= 5 THEN author ELSE '其他' END AS author, sum(lines)::BIGINT AS lines FROM r GROUP BY 1""")
def author_top5_other(spark, d):
    return blame.top_and_rest(blame.counted(tables.blame_lines(spark, d), use_email=True))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, sum(value::INTEGER)::BIGINT AS value FROM (SELECT ts, event_id % 7 AS value FROM events) GROUP BY 1")
def author_date_series(spark, d):
    e = tables.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("event_id") % 7).alias("value"))
    return blame.date_series(e).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "value")


def _search(where: str) -> str:
    return f"WITH {NODES} SELECT path FROM nodes WHERE {where}"


@query(_search("contains(lower(name), 'doc1') AND (name NOT LIKE '.%')"))
def search_name_ci(spark, d):
    return search.search(_nodes(spark, d), name="DOC1", ignore_case=True).select("path")


@query(_search("NOT is_dir AND contains(text, 'thed') AND name NOT LIKE '.%'"))
def search_content_sub(spark, d):
    return search.search(_nodes(spark, d), content="thed").select("path")


@query(_search("NOT is_dir AND regexp_matches(name, '^doc[0-9]*5\\.(md|go)$') AND regexp_matches(text, '(?i)licensed under') AND name NOT LIKE '.%'"))
def search_regex(spark, d):
    return search.search(_nodes(spark, d), name_regex=r"^doc[0-9]*5\.(md|go)$", content_regex="licensed under", ignore_case=True).select("path")


def _indexed(spark, d) -> text_index.TextIndex:
    return text_index.build(_files(spark, d), f"{shared.fresh(spark, 'texts')}/index")


@query(f"WITH {FILES} SELECT path FROM files WHERE contains(text, 'thed')")
def indexed_content_sub(spark, d):
    return _indexed(spark, d).search(content="thed").select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(text, '(?i)(licensed|released) under +(the )?[a-z]+|all rights reserved|copyright [0-9]+')")
def indexed_regex(spark, d):
    return _indexed(spark, d).search(regex="(licensed|released) under +(the )?[a-z]+|all rights reserved|copyright [0-9]+", ignore_case=True).select("path")


@query(_search("name NOT LIKE '.%' AND (contains(name, '99') OR (NOT is_dir AND contains(text, 'License')))"))
def search_any(spark, d):
    return search.search(_nodes(spark, d), name="99", content="License", any_of=True).select("path")


@query(_search("name NOT LIKE '.%' AND (is_dir OR lower(ext) IN ('.md', '.go'))"))
def search_ext(spark, d):
    return search.search(_nodes(spark, d), extensions=paths.extension_list(".md, GO")).select("path")


@query(_search("(path = '/src1' OR path LIKE '/src1/%') AND depth - 1 <= 1 AND name NOT LIKE '.%'"))
def search_depth(spark, d):
    return search.search(_nodes(spark, d), root="/src1", max_depth=1).select("path")


@query(_search("contains(name, 'doc17')"))
def search_hidden_name(spark, d):
    return search.search(_nodes(spark, d), name="doc17", hidden=True).select("path")


@query(_search("is_dir AND contains(name, 'src')"))
def search_dirs(spark, d):
    return search.search(_nodes(spark, d), name="src", files=False).select("path")


@query(_search("len(list_filter(seg, lambda x: x LIKE '.%')) > 0"))
def search_hidden_path(spark, d):
    return _nodes(spark, d).where(paths.hidden_path(F.col("path"))).select("path")


@query(_search("NOT is_dir AND NOT (name LIKE 'doc1_.md' OR regexp_matches(path, '^/src2/.*\\.json$'))"))
def exclude_globs(spark, d):
    n = _nodes(spark, d).where("NOT is_dir")
    return n.where(search.not_excluded(F.col("path"), ["doc1?.md", "src2/**/*.json"])).select("path")


@query(_search("NOT is_dir AND NOT list_has_any(seg[1:len(seg) - 1], ['bin', 'dist', 'src3'])"))
def pruned_directories(spark, d):
    n = _nodes(spark, d).where("NOT is_dir")
    renamed = n.select("path", F.regexp_replace("path", "^/src3/", "/build/").alias("_p"))
    return renamed.where(~paths.pruned(F.col("_p"), F.lit(False))).select("path")


@query(_search("path = '/' OR NOT (path LIKE '%.json' OR path = '/src1/de' OR path LIKE '/src1/de/%' OR path = '/src2/fr' OR path LIKE '/src2/fr/%')"))
def gitignore_filter(spark, d):
    rules = spark.createDataFrame([("/", "*.json"), ("/src1", "/src1/de"), ("/src2", "fr/"), ("/", "!doc1.json")], "dir string, rule string")
    return search.without_ignored(_nodes(spark, d), rules).select("path")


@query(_search("path LIKE '%.md' AND path LIKE '/src5/%'"))
def markdown_pattern(spark, d):
    return _nodes(spark, d).where(search.markdown_match(F.col("path"), "src5/**")).select("path")


@query(f"WITH {NODES} SELECT path, name, is_dir, ext, size FROM nodes WHERE parent_path = '/src4/en'")
def nodes_list(spark, d):
    return hierarchy.children(_nodes(spark, d), "/src4/en").select("path", "name", "is_dir", "ext", "size")


@query(f"WITH {NODES} SELECT path, depth, coalesce(parent_path, '-') AS parent FROM nodes")
def node_depth(spark, d):
    return _nodes(spark, d).select("path", "depth", F.coalesce("parent_path", F.lit("-")).alias("parent"))


@query(f"WITH {NODES} SELECT count(*) AS total_nodes, count_if(is_dir)::BIGINT AS directories, count_if(NOT is_dir)::BIGINT AS files, sum(size)::BIGINT AS total_size, max(depth) AS max_depth FROM nodes")
def tree_stats(spark, d):
    return hierarchy.statistics(_nodes(spark, d))


@query(
    f"WITH {NODES}, up AS (SELECT CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(seg[1:i], '/') END AS dir, is_dir, size FROM (SELECT *, unnest(range(0, CASE WHEN is_dir THEN len(seg) + 1 ELSE len(seg) END)) AS i FROM nodes)) SELECT dir, count(*) AS nodes, count_if(is_dir)::BIGINT AS directories, count_if(NOT is_dir)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM up GROUP BY dir"
)
def tree_subtree_stats(spark, d):
    return hierarchy.subtree_statistics(_nodes(spark, d))


@query(
    f"""WITH {FILES}, n AS (SELECT path, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS n FROM files WHERE text <> ''),
r AS (SELECT path, 'one' AS author, (n - 1 - (n - 1) // 3)::BIGINT AS lines, n FROM n UNION ALL SELECT path, 'two', 1, n FROM n UNION ALL SELECT path, 'three', ((n - 1) // 3 + 1)::BIGINT, n FROM n)
SELECT path, author, lines FROM r WHERE lines > 0"""
)
def blame_revisions(spark, d):
    """Each file's lines, numbered, in three revisions: as they are; one line put first; each third line changed and the last one gone, one put behind."""
    f = _files(spark, d).where("text <> ''").withColumn("own", F.transform(F.split(F.regexp_replace("text", "\n\\z", ""), "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(":"), x)))
    changed = F.transform("own", lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("changed "), x)).otherwise(x))
    n = F.size("own")
    last = F.slice(changed, 1, n - 1)
    head, end = F.array(F.lit("first")), F.array(F.lit("end"))
    row = lambda rev, author, x: f.select("path", F.lit(rev).alias("rev"), F.lit(author).alias("author"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("timestamp").alias("when"), F.array_join(x, "\n").alias("text"))
    whole = reduce(DataFrame.unionByName, [row(1, "one", F.col("own")), row(2, "two", F.concat(head, F.col("own"))), row(3, "three", F.concat(head, last, end))])
    return revisions.blamed(whole).groupBy("path", "author").agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {FILES} SELECT path, sha256(text) AS sha256, md5(text) AS md5 FROM files")
def file_hash(spark, d):
    return hierarchy.file_hashes(_nodes(spark, d))


@query(
    f"""WITH {NODES}, l3 AS (SELECT path, parent_path, name, sha256(text) AS hash FROM nodes WHERE depth = 3),
l2 AS (SELECT n.path, n.parent_path, n.name, sha256(string_agg(c.hash, '' ORDER BY c.name)) AS hash FROM nodes n JOIN l3 c ON c.parent_path = n.path WHERE n.depth = 2 GROUP BY ALL),
l1 AS (SELECT n.path, n.parent_path, n.name, sha256(string_agg(c.hash, '' ORDER BY c.name)) AS hash FROM nodes n JOIN l2 c ON c.parent_path = n.path WHERE n.depth = 1 GROUP BY ALL),
l0 AS (SELECT '/' AS path, sha256(string_agg(hash, '' ORDER BY name)) AS hash FROM l1)
SELECT path, hash FROM l3 UNION ALL SELECT path, hash FROM l2 UNION ALL SELECT path, hash FROM l1 UNION ALL SELECT path, hash FROM l0"""
)
def merkle_hash(spark, d):
    return hierarchy.merkle(_nodes(spark, d), 3)


_EDITED = "edited AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 50 = 0 THEN 'x' || text ELSE text END AS text FROM documents WHERE doc_id % 71 <> 0 OR doc_id % 50 = 0)"


@query(ORACLE_SQL["merkle_hash"].replace("WITH files AS", f"WITH {_EDITED}, files AS").replace("AS size FROM documents", "AS size FROM edited").replace("JOIN l3 c", "LEFT JOIN l3 c").replace("JOIN l2 c", "LEFT JOIN l2 c").replace("sha256(string_agg(c.hash, '' ORDER BY c.name))", "sha256(coalesce(string_agg(c.hash, '' ORDER BY c.name), 'empty_dir:' || any_value(n.name)))"))
def merkle_updated(spark, d):
    nodes, files = _nodes(spark, d), _files(spark, d)
    stored = hierarchy.store_merkle(nodes, f"{shared.fresh(spark, 'hashes')}/rows")
    number = F.regexp_extract("path", r"doc(\d+)\.", 1).cast("long")
    changes = hierarchy.merkle_changes(stored, files.where(number % 50 == 0).select("path", F.concat(F.lit("x"), "text").alias("text")), files.where(number % 71 == 0).select("path"))
    return hierarchy.merkle_after(stored, changes).select("path", "hash")


@query(
    f"""WITH {NODES}, f AS (SELECT path, parent_path, name, name = max(name) OVER (PARTITION BY parent_path) AS last FROM nodes WHERE path <> '/'),
x AS (SELECT n.*, f.last, CASE WHEN n.depth < 3 THEN '' WHEN p2.last THEN '    ' ELSE '│   ' END AS b2, CASE WHEN n.depth < 2 THEN '' WHEN (CASE WHEN n.depth = 2 THEN p2.last ELSE p1.last END) THEN '    ' ELSE '│   ' END AS b1 FROM nodes n JOIN f ON f.path = n.path LEFT JOIN f p2 ON p2.path = n.parent_path LEFT JOIN f p1 ON p1.path = p2.parent_path)
SELECT path, b1 || b2 || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_dir THEN '/' WHEN size > 0 THEN ' (' || size || ' bytes)' ELSE '' END AS line FROM x UNION ALL SELECT '/', '.'"""
)
def tree_text(spark, d):
    return hierarchy.tree_lines(_nodes(spark, d))


@query(f"WITH {NODES} SELECT path FROM nodes WHERE is_dir AND depth < 2")
def tree_options(spark, d):
    return hierarchy.shown(_nodes(spark, d), files=False, max_depth=2).select("path")


_LANG = "CASE lower(ext) WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.json' THEN 'json' ELSE '' END"
_MIME = "CASE lower(ext) WHEN '.md' THEN 'text/markdown' WHEN '.go' THEN 'text/x-go' WHEN '.py' THEN 'text/x-python' WHEN '.json' THEN 'application/json' ELSE 'text/plain' END"


@query(f"WITH {NODES} SELECT path, {_LANG} AS language, {_MIME} AS mime, ext IN ('.go', '.py') AS program FROM nodes WHERE NOT is_dir")
def file_kinds(spark, d):
    e = F.col("ext")
    return _nodes(spark, d).where("NOT is_dir").select("path", paths.language(e).alias("language"), paths.mime(e).alias("mime"), paths.is_program(e).alias("program"))


@query(f"WITH {FILES} SELECT path, CASE WHEN size < 1024 THEN size || ' bytes' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS shown FROM files")
def human_size(spark, d):
    return _files(spark, d).select("path", paths.human_size(F.col("size")).alias("shown"))


@query(
    f"""WITH {NODES}, p AS (SELECT * FROM nodes WHERE NOT is_dir AND name NOT LIKE '.%' AND ext <> '.json')
SELECT path, '## 📄 ' || ltrim(path, '/') || chr(10) || chr(10) || '**路径:** `' || ltrim(path, '/') || '`  ' || chr(10) || '**大小:** ' || size || ' bytes  ' || chr(10) || chr(10) || '```' || {_LANG} || chr(10) || text || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '```' || chr(10) || chr(10) AS block FROM p"""
)
def pack_markdown(spark, d):
    return packing.packed(_files(spark, d), exclude=[".JSON"])


@query(f"WITH {NODES}, s AS (SELECT parent_path AS dir, strlen('// FILE: ' || path || chr(10) || text || chr(10) || chr(10)) AS n FROM nodes WHERE NOT is_dir) SELECT dir, count(*) AS files, sum(n)::BIGINT AS bytes, sum(n // 4)::BIGINT AS tokens FROM s GROUP BY dir")
def dir_batches(spark, d):
    return packing.directory_batches(_files(spark, d))


@query(
    f"""WITH RECURSIVE {NODES}, s AS (SELECT parent_path AS dir, path, (strlen('// FILE: ' || path || chr(10) || text || chr(10) || chr(10)) // 4)::INTEGER AS tokens, row_number() OVER (PARTITION BY parent_path ORDER BY path) AS n FROM nodes WHERE NOT is_dir),
r AS (SELECT dir, path, tokens, n, 1 AS batch, tokens AS used FROM s WHERE n = 1 UNION ALL SELECT s.dir, s.path, s.tokens, s.n, CASE WHEN r.used + s.tokens > 3000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used + s.tokens > 3000 THEN s.tokens ELSE r.used + s.tokens END FROM r JOIN s ON s.dir = r.dir AND s.n = r.n + 1)
SELECT path, dir, batch, tokens FROM r"""
)
def token_binpack(spark, d):
    return packing.token_batches(_files(spark, d), 3000)


@query(ORACLE_SQL["token_binpack"])
def token_binpack_ranged(spark, d):
    rows = _files(spark, d).select(paths.parent(F.col("path")).alias("dir"), "path", text.tokens(packing.section()).alias("tokens"))
    return packing.ranged_batches(rows, 3000, 64)


@query(f"WITH {NODES}, r AS (SELECT parent_path AS dir, path, row_number() OVER (PARTITION BY parent_path ORDER BY path) AS n, count(*) OVER (PARTITION BY parent_path) AS total, dense_rank() OVER (ORDER BY parent_path) AS m FROM nodes WHERE NOT is_dir) SELECT dir, string_agg(path, ',' ORDER BY path) FILTER (n <= 5) AS shown, greatest(max(total) - 5, 0)::INTEGER AS more FROM r WHERE m <= 30 GROUP BY dir")
def first_n_per_module(spark, d):
    return packing.first_per_module(_files(spark, d)).select("dir", F.array_join("shown", ",").alias("shown"), "more")


@query(f"WITH {NODES} SELECT DISTINCT parent_path AS dir FROM nodes WHERE ext = '.md'")
def markdown_dirs(spark, d):
    return packing.markdown_directories(_files(spark, d))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Go files: each document's text stands in a comment and a raw string among declarations that its path makes."""
    n = F.octet_length("path").cast("string")
    body = F.concat(F.lit("package p\n\n/* "), F.regexp_replace("text", "[*`]", ""), F.lit(" */\ntype (\n\tT"), n, F.lit(" struct {\n\t\tA, B int `json:\"a\"`\n\t\tBase\n\t}\n\tI interface { Get() int }\n)\n\nfunc (t *T"), n, F.lit(") Get() int { return 1 }\nfunc New"), n, F.lit("() {}\nvar s = `func No() {}\n"), F.regexp_replace("text", "`", ""), F.lit("`\n"))
    return _files(spark, d).withColumn("text", body)


_CODE = f"{FILES}, c AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir, strlen(path)::VARCHAR AS n FROM files WHERE path LIKE '%.go'), g AS (SELECT dir, list(DISTINCT n ORDER BY n) AS ns, max(n) AS last FROM c GROUP BY dir), l AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, strlen(arg_max(path, path))::VARCHAR AS last FROM files WHERE path LIKE '%.go' GROUP BY 1)"


@query(f"WITH {_CODE} SELECT g.dir, 'I:interface:Get,' || array_to_string(list_transform(list_sort(ns), lambda n: 'T' || n || ':struct:A+B'), ',') AS types, 'Get:T' || l.last || ',' || array_to_string(list_transform(list_sort(ns), lambda n: 'New' || n || ':'), ',') AS funcs FROM g JOIN l USING (dir)")
def code_index(spark, d):
    types = F.transform("types", lambda t: F.concat_ws(":", t["name"], t["kind"], F.array_join(t["fields"], "+")))
    funcs = F.transform("funcs", lambda f: F.concat(f["name"], F.lit(":"), F.coalesce(f["receiver"], F.lit(""))))
    return packing.code_index(_code(spark, d)).select("dir", F.array_join(types, ",").alias("types"), F.array_join(funcs, ",").alias("funcs"))


@query(f"""WITH {_CODE} SELECT g.dir, '## 📋 代码中实际存在的类型（只能使用这些）' || chr(10) || chr(10) || '### `I` (interface)' || chr(10) || '字段/方法:' || chr(10) || '- `Get`' || chr(10) || chr(10) || array_to_string(list_transform(list_sort(ns), lambda n: '### `T' || n || '` (struct)' || chr(10) || '字段/方法:' || chr(10) || '- `A`' || chr(10) || '- `B`' || chr(10) || chr(10)), '')
|| '## 📋 代码中实际存在的函数/方法（只能使用这些）' || chr(10) || chr(10) || '- `Get` (方法，接收者: `T' || l.last || '`)' || chr(10) || array_to_string(list_transform(list_sort(ns), lambda n: '- `New' || n || '` (函数)' || chr(10)), '') || chr(10) AS text FROM g JOIN l USING (dir)""")
def code_index_text(spark, d):
    return packing.code_index_text(packing.code_index(_code(spark, d)))


@query(f"WITH {NODES} SELECT parent_path AS dir, string_agg('// FILE: ' || path || chr(10) || text || chr(10) || chr(10), '' ORDER BY path) AS text FROM nodes WHERE NOT is_dir GROUP BY 1")
def dir_texts(spark, d):
    return packing.directory_texts(_files(spark, d))


@query(
    f"""WITH RECURSIVE {NODES}, s AS (SELECT parent_path AS dir, path, '// FILE: ' || path || chr(10) || text || chr(10) || chr(10) AS part, (strlen('// FILE: ' || path || chr(10) || text || chr(10) || chr(10)) // 4)::INTEGER AS tokens, row_number() OVER (PARTITION BY parent_path ORDER BY path) AS n FROM nodes WHERE NOT is_dir),
r AS (SELECT dir, part, path, tokens, n, 1 AS batch, tokens AS used FROM s WHERE n = 1 UNION ALL SELECT s.dir, s.part, s.path, s.tokens, s.n, CASE WHEN r.used + s.tokens > 5000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used + s.tokens > 5000 THEN s.tokens ELSE r.used + s.tokens END FROM r JOIN s ON s.dir = r.dir AND s.n = r.n + 1)
SELECT dir, batch, md5(string_agg(part, '' ORDER BY path)) AS sum FROM r GROUP BY ALL"""
)
def batch_texts(spark, d):
    return packing.batch_texts(_files(spark, d), 5000).select("dir", "batch", F.md5("text").alias("sum"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ' || chr(9) || chr(10) || chr(13)) AS title FROM pages")
def page_title(spark, d):
    return tables.table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("SELECT page_id, trim(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM pages")
def page_strip_tags(spark, d):
    return tables.table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query()
def page_markdown(spark, d):
    return tables.table(spark, d, "pages").select("page_id", html.markdown("html").alias("markdown"))


@query("SELECT page_id, CASE WHEN url LIKE '%://%' THEN url ELSE 'https://' || url END AS url FROM pages")
def page_url(spark, d):
    return tables.table(spark, d, "pages").select("page_id", paths.page_url(F.col("url")).alias("url"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS cut, (strlen(text) // 4)::INTEGER AS tokens FROM documents")
def text_cut(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text.cut_runes(F.col("text"), 100).alias("cut"), text.tokens(F.col("text")).alias("tokens"))


def _titled(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", "\n", "\n\n")
    return tables.table(spark, d, "documents").select("doc_id", F.concat(F.lit("\n## Doc "), "doc_id", F.lit("\n\n- item\n> "), t).alias("text"))


_WS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(chr(10) || '## Doc ' || doc_id || chr(10) || chr(10) || '- item' || chr(10) || '> ' || replace(text, chr(10), chr(10) || chr(10)), chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS lines FROM documents),
h AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: starts_with(x, '#')), true) AS first FROM l),
o AS (SELECT doc_id, trim(regexp_replace(lines[first], '^#+', '')) AS title, list_filter(list_transform(list_filter(lines[first + 1:], lambda x: NOT starts_with(x, '```')), lambda x: trim(regexp_replace(x, '^>', ''))), lambda x: NOT regexp_matches(x, '^[-*+#]') AND x <> '')[1] AS found FROM h),
c AS (SELECT doc_id, title, found, substring(found, 1, list_max(list_filter(range(0, 121), lambda k: strlen(substring(found, 1, k)) <= 120))) AS head FROM o)
SELECT doc_id, title, coalesce(CASE WHEN strlen(found) > 120 THEN head || CASE WHEN strlen(head) < 120 THEN chr(65533) ELSE '' END || '...' ELSE found END, '{text.NO_DESCRIPTION}') AS description FROM c"""
)
def md_title_desc(spark, d):
    return _titled(spark, d).select("doc_id", text.title(F.col("text")).alias("title"), text.description(F.col("text")).alias("description"))


@query("SELECT doc_id, 'Doc ' || doc_id AS title FROM documents WHERE contains(lower('Doc ' || doc_id), 'doc 1')")
def catalog_search(spark, d):
    c = _titled(spark, d).select("doc_id", text.title(F.col("text")).alias("title"), F.lit("").alias("description"))
    return documents.catalog_search(c, "DOC 1").select("doc_id", "title")


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN position('the' IN text) > 0 THEN substring(text, 1, position('the' IN text) - 1) || 'THE' || substring(text, position('the' IN text) + 3) ELSE text END AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN position('and' IN t) > 0 THEN substring(t, 1, position('and' IN t) - 1) || substring(t, position('and' IN t) + 3) ELSE t END AS t FROM a),
c AS (SELECT doc_id, replace(t, 'er', 'ER') AS t FROM b)
SELECT doc_id, t || CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN '' ELSE chr(10) END || 'end' AS text FROM c"""
)
def content_updates(spark, d):
    ops = [("replace", "the", "THE"), ("delete", "and", ""), ("replaceAll", "er", "ER"), ("insert", "", "end")]
    c = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(t).alias("target"), F.lit(x).alias("content")) for o, t, x in ops])
    return tables.table(spark, d, "documents").select("doc_id", text.apply_changes(F.col("text"), c).alias("text"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_get(spark, d):
    v = documents.parsed(F.col("props"))
    return tables.table(spark, d, "events").select("event_id", documents.get(v, "k", "int", -1).alias("k"), documents.get(v, "missing", "string", "none").alias("missing"))


@query(
    f"""WITH {FILES}, k AS (SELECT replace(ltrim(path, '/'), '/', '.') AS key, md5(text) AS value FROM files),
e AS (SELECT key AS query, key, value, 1 AS r FROM k UNION ALL SELECT regexp_replace(key, '\\.[^.]+$', ''), key, value, 2 FROM k), w AS (SELECT DISTINCT CASE WHEN n % 2 = 0 THEN key ELSE regexp_replace(key, '\\.[^.]+$', '') END AS query FROM (SELECT key, strlen(key) AS n FROM k))
SELECT e.query, e.key, e.value FROM e JOIN w USING (query) QUALIFY row_number() OVER (PARTITION BY e.query ORDER BY r, key, value) = 1"""
)
def json_nav(spark, d):
    k = _files(spark, d).select(F.regexp_replace(F.ltrim("path", F.lit("/")), "/", ".").alias("key"), F.md5("text").alias("value"))
    wanted = k.select(F.when(F.octet_length("key") % 2 == 0, F.col("key")).otherwise(F.regexp_replace("key", r"\.[^.]+$", "")).alias("query"))
    return documents.navigate(k, wanted)


@query("SELECT doc_id, (unnest(range(0, len(r))))::INTEGER AS chunk, unnest(list_transform(r, lambda s: substring(text, s, 1000))) AS text FROM (SELECT doc_id, text, range(1, greatest(1, length(text) - 200) + 1, 800) AS r FROM documents WHERE text IS NOT NULL)")
def chunk_fixed(spark, d):
    return retrieval.fixed_chunks(tables.table(spark, d, "documents"))


@query()
def chunk_recursive(spark, d):
    return retrieval.recursive_chunks(tables.table(spark, d, "documents"))


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 4")
def cosine_topk(spark, d):
    e = tables.table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return retrieval.top_k(e, q, threshold=-1.0).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "WITH q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label), p AS (SELECT q.query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS score FROM q JOIN embeddings x ON x.vec_id = q.query_id JOIN embeddings e ON e.vec_id <> q.query_id) SELECT query_id, vec_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 4"
)
def cosine_topk_per_label(spark, d):
    e = tables.table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select(F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("embedding"))
    return retrieval.top_k_each(e, first).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_TOP = "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) - 1)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank < 10"


@query(_TOP)
def vector_index_topk(spark, d):
    e = tables.table(spark, d, "embeddings")
    index = vector_index.build(e, f"{shared.fresh(spark, 'vectors')}/index")
    found = index.search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _store(spark, d) -> VectorStore:
    """Four versions: all vectors; some reversed and some gone; the same, compacted; more gone."""
    e = tables.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    store = VectorStore(spark, f"{shared.fresh(spark, 'vectors')}/store")
    store.upsert(e)
    store.commit(e.where("vec_id % 5 = 0").withColumn("embedding", F.reverse("embedding")), e.where("vec_id % 7 = 0").select("vec_id"))
    store.compact()
    store.delete(e.where("vec_id % 11 = 0").select("vec_id"))
    return store


_SECOND = "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding, label FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 5 = 0"


@query(f"SELECT vec_id, label, round(embedding[1]::DOUBLE, 5) AS head, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM ({_SECOND}) WHERE vec_id % 11 <> 0")
def vector_store_rows(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _store(spark, d).read().select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("head"), F.round(total, 4).alias("total"))


@query(f"SELECT 1 AS version, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings UNION ALL SELECT v, count(*), sum(vec_id)::BIGINT FROM ({_SECOND}), range(2, 4) t(v) GROUP BY v UNION ALL SELECT 4, count(*), sum(vec_id)::BIGINT FROM ({_SECOND}) WHERE vec_id % 11 <> 0")
def vector_store_versions(spark, d):
    store = _store(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [store.read(v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids")) for v in store.versions()])


_SYNC = "s AS (SELECT '/doc' || doc_id AS path, 1700000000 + doc_id AS t, CASE WHEN doc_id % 7 = 0 THEN md5('x' || text) ELSE md5(text) END AS h FROM documents), n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '/moved' ELSE '/doc' END || doc_id AS path, 1700000000 + doc_id + CASE WHEN doc_id % 3 = 0 THEN 3600 ELSE 0 END AS t, md5(text) AS h FROM documents), c AS (SELECT coalesce(n.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'delete' WHEN n.t > s.t AND n.h <> s.h THEN 'update' END AS action FROM s FULL JOIN n ON s.path = n.path)"


@query(f"WITH {_SYNC} SELECT path, action FROM c WHERE action IS NOT NULL")
def sync_diff(spark, d):
    return retrieval.changes(*tables.states(tables.table(spark, d, "documents")))


@query(f"WITH {_SYNC} SELECT s.path, s.h AS hash FROM s JOIN c USING (path) WHERE action IS NULL UNION ALL SELECT n.path, n.h FROM n JOIN c USING (path) WHERE action IN ('add', 'update')")
def sync_state(spark, d):
    old, new = tables.states(tables.table(spark, d, "documents"))
    return retrieval.state_after(old, new, retrieval.changes(old, new)).select("path", "hash")


@query("SELECT * FROM (VALUES ('chat', 'mine', 'user'), ('code', 'built in', 'system'), ('note', 'own', 'user')) AS t(name, content, origin)")
def prompt_override(spark, d):
    s = spark.createDataFrame([("chat", "default"), ("code", "built in")], "name string, content string")
    u = spark.createDataFrame([("chat", "mine"), ("note", "own")], "name string, content string")
    return sources.prompts(s, u)


@query("SELECT * FROM (VALUES ('a', 0, 'One', 'http://1', 'first'), ('a', 1, 'Two', 'http://2', 'second'), ('b', 0, 'Three', 'http://3', 'third'), ('c', 0, 'Four', 'http://4', 'fourth')) AS t(engine, rank, title, url, snippet)")
def search_api_results(spark, d):
    rows = [
        ("a", '{"items":[{"title":"One","link":"http://1","snippet":"first"},{"title":"Two","link":"http://2","snippet":"second"},{"title":"Cut","link":"http://9","snippet":"x"}]}'),
        ("b", '{"webPages":{"value":[{"name":"Three","url":"http://3","snippet":"third"}]}}'),
        ("c", '{"search":{"web":[{"title":"Four","url":"http://4","content":"fourth"}]}}'),
    ]
    return sources.search_results(spark.createDataFrame(rows, "engine string, payload string"), 2)


def _burst_sql(gap: str) -> str:
    return f"""WITH e AS (SELECT '/user' || user_id || '.md' AS path, ts, CASE event_type WHEN 'view' THEN 'write' WHEN 'signup' THEN 'create' END AS op FROM events WHERE event_type IN ('view', 'signup')),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT path, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL '{gap}')::TIMESTAMP AS "end", arg_max(op, ts) AS op, count(*) AS events FROM s GROUP BY path, n"""


@query(_burst_sql("300 milliseconds"))
def debounce_300ms(spark, d):
    return changes.debounced(tables.file_events(spark, d))


@query(_burst_sql("6 hours"))
def debounce_6h(spark, d):
    return changes.debounced(tables.file_events(spark, d), "6 hours")


@query(
    f"""WITH {FILES}, t AS (SELECT 'topic' || (doc_id % 3) AS topic, '/' || source || '/' || lang AS name FROM documents), b AS (SELECT regexp_replace(path, '/[^/]*$', '') AS name, count(*) AS n FROM files WHERE path LIKE '%.go' GROUP BY 1) SELECT topic, sum(n)::INTEGER AS files FROM (SELECT DISTINCT topic, name FROM t) JOIN b USING (name) GROUP BY topic"""
)
def topic_files(spark, d):
    docs = tables.table(spark, d, "documents")
    outline = docs.groupBy(F.concat(F.lit("topic"), F.col("doc_id") % 3).alias("topic")).agg(F.collect_set(F.concat(F.lit("/"), "source", F.lit("/"), "lang")).alias("modules"))
    batches = _files(spark, d).where("path LIKE '%.go'").groupBy(paths.parent(F.col("path")).alias("name")).agg(F.collect_list("path").alias("files"))
    return packing.topics(outline, batches).select("topic", F.size("files").alias("files"))


@query("SELECT event_id, event_type || '|' || CASE event_id % 4 WHEN 0 THEN printf('%.2f', value + user_id) WHEN 1 THEN printf('%.2f', value - user_id) WHEN 2 THEN printf('%.2f', value * user_id) ELSE CASE WHEN user_id = 0 THEN 'error: division by zero' ELSE printf('%.2f', value / user_id) END END AS shown FROM events WHERE value IS NOT NULL")
def calculator(spark, d):
    e = tables.table(spark, d, "events").where("value IS NOT NULL")
    op = F.element_at(F.array(*map(F.lit, ("add", "sub", "mul", "div"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.concat("event_type", F.lit("|"), text.calculate(op, F.col("value"), F.col("user_id").cast("double"))).alias("shown"))


@query("SELECT path, CASE WHEN path LIKE '%7.%' THEN NULL ELSE length(path)::VARCHAR END AS value, CASE WHEN path LIKE '%7.%' THEN 'seven' END AS error FROM (SELECT '/doc' || doc_id || '.md' AS path FROM documents)")
def process_with_errors(spark, d):
    def f(path: str) -> int:
        if "7." in path:
            raise ValueError("seven")
        return len(path)

    rows = tables.table(spark, d, "documents").select(F.concat(F.lit("/doc"), "doc_id", F.lit(".md")).alias("path")).withColumn("x", F.col("path"))
    return parallel.mapped(rows, "path", "x", f)


@query("SELECT doc_id, '/' || CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a/b' END || '/doc' || doc_id AS path FROM documents")
def path_normal(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a\\..//b/./doc"), "doc_id")).otherwise(F.concat(F.lit("/x/../a//b/doc"), "doc_id", F.lit("/")))
    return tables.table(spark, d, "documents").select("doc_id", paths.normal(raw).alias("path"))


@query("SELECT key, arg_max(value, n) AS value FROM (SELECT event_type AS key, props AS value, event_id AS n FROM events) GROUP BY key")
def store_upsert(spark, d):
    e = tables.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("n"))
    return documents.latest(e, "key", "n").select("key", "value")


@query(f"WITH {FILES} SELECT path, CASE WHEN size = 0 THEN '' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS label FROM files")
def size_label(spark, d):
    return _files(spark, d).select("path", paths.size_label(F.col("size")).alias("label"))


@query(f"WITH {NODES} SELECT path, '## ' || ltrim(path, '/') || chr(10) || chr(10) || '```' || {_LANG} || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) AS block FROM nodes WHERE NOT is_dir AND path LIKE '/src5/%'")
def context_blocks(spark, d):
    return packing.context_blocks(_nodes(spark, d), "/src5")


@query("SELECT doc_id, lower(replace(replace('My Doc/' || doc_id, ' ', '-'), '/', '-')) AS slug, 'my-doc' || doc_id || '.md' AS file FROM documents")
def slugs(spark, d):
    t = F.concat(F.lit("My Doc/"), "doc_id")
    return tables.table(spark, d, "documents").select("doc_id", text.slug(t).alias("slug"), text.file_slug(t).alias("file"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents")


@query("SELECT doc_id, trim(text) AS text FROM documents")
def ansi_stripped(spark, d):
    marked = F.concat(F.lit("\x1b[1;31m"), F.substring("text", 1, 5), F.lit("\x1b[0m"), F.expr("substring(text, 6)"), F.lit("\x1b[K"))
    return _docs(spark, d).select("doc_id", text.strip_ansi(marked).alias("text"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 80 THEN head || CASE WHEN strlen(head) < 80 THEN chr(65533) ELSE '' END || '...' ELSE text END AS cut FROM (SELECT doc_id, text, substring(text, 1, list_max(list_filter(range(0, 81), lambda k: strlen(substring(text, 1, k)) <= 80))) AS head FROM documents)")
def text_cut_bytes(spark, d):
    return _docs(spark, d).select("doc_id", text.cut_bytes(F.col("text"), 80).alias("cut"))


@query("SELECT doc_id, 'package p' || chr(10) || 'func F' || doc_id || '() {' || chr(10) || '  type X int' AS signatures FROM documents")
def code_signatures(spark, d):
    code = F.concat(F.lit("package p\n// comment\nfunc F"), "doc_id", F.lit("() {\n  type X int\n  return\n}\nfunction no\n"))
    return _docs(spark, d).select("doc_id", text.signatures(code).alias("signatures"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{' || 'x' || event_id || '}' ELSE props END AS json FROM events")
def json_fenced(spark, d):
    e, i = tables.table(spark, d, "events"), F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {}"))).when(i % 3 == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise(F.concat(F.lit("{x"), i, F.lit("} end")))
    return e.select("event_id", text.json_in(raw).alias("json"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'about ' || lang END AS description FROM documents")
def front_matter(spark, d):
    block = F.concat(F.lit('---\ntitle: x\ndescription: "about '), "lang", F.lit('"\n---\n'), "text")
    return _docs(spark, d).select("doc_id", text.front_matter(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("description: no\n"), "text")).otherwise(block)).alias("description"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'Y' WHEN 3 THEN 'N' ELSE upper(event_type) END AS answer FROM events")
def yes_no(spark, d):
    raw = F.element_at(F.array(F.lit(" yes "), F.lit("否"), F.lit("ｙ"), F.lit("no"), F.col("event_type")), (F.col("event_id") % 5 + 1).cast("int"))
    return tables.table(spark, d, "events").select("event_id", text.yes_no(raw).alias("answer"))


@query("SELECT event_id, event_id BETWEEN 1 AND 65535 AND event_id % 7 <> 0 AS ok, 'APP_' || upper(event_type) AS key FROM events")
def ports_and_keys(spark, d):
    port = F.when(F.col("event_id") % 7 == 0, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id").cast("string"))
    return tables.table(spark, d, "events").select("event_id", text.port_ok(port).alias("ok"), text.env_key("APP_", F.col("event_type")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN (event_id // 60) || 'm' || (event_id % 60) || 's' ELSE (event_id // 3600) || 'h' || ((event_id % 3600) // 60) || 'm' END AS shown FROM events")
def durations(spark, d):
    return tables.table(spark, d, "events").select("event_id", text.duration(F.col("event_id")).alias("shown"))


@query("SELECT author, (list_sum(list_transform(string_split(author, ''), lambda c: unicode(c))) % 6)::INTEGER AS color FROM (SELECT DISTINCT event_type AS author FROM events)")
def author_colors(spark, d):
    a = tables.table(spark, d, "events").select(F.col("event_type").alias("author")).distinct()
    return a.select("author", text.color_index(F.col("author")).cast("int").alias("color"))


@query(f"WITH {NODES} SELECT path, row_number() OVER (ORDER BY seg) AS place FROM nodes")
def depth_first(spark, d):
    return hierarchy.depth_first(_nodes(spark, d).select("path"))


@query(f"WITH {NODES} SELECT path, is_dir, row_number() OVER (PARTITION BY parent_path ORDER BY is_dir DESC, name) AS place FROM nodes WHERE path <> '/'")
def directories_first(spark, d):
    rows = _nodes(spark, d).where("path <> '/'")
    return rows.select("path", "is_dir", F.row_number().over(Window.partitionBy("parent_path").orderBy(F.desc("is_dir"), "name")).alias("place"))


@query(f"WITH {NODES} SELECT path, parent_path, name, is_dir, depth, ext, size FROM nodes WHERE path = '/src3'")
def node_found(spark, d):
    return hierarchy.find(_nodes(spark, d), "/src3").drop("text")


@query(f"WITH {FILES}, p AS (SELECT path FROM files), up AS (SELECT DISTINCT unnest([regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/[^/]*/[^/]*$', ''), '/']) AS path FROM p) SELECT path, false AS is_dir FROM p UNION ALL SELECT path, true FROM up")
def tree_from_paths(spark, d):
    return hierarchy.tree_from_paths(_files(spark, d).select(F.regexp_replace("path", "^/", "./x/../").alias("path"), "size")).select("path", "is_dir")


@query(f"WITH {NODES} SELECT depth, count(*) AS nodes, sum(size)::BIGINT AS bytes FROM nodes GROUP BY depth")
def level_sums(spark, d):
    per = hierarchy.by_level(_nodes(spark, d), lambda n: n.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("bytes")))
    return reduce(DataFrame.unionByName, per)


@query(f"WITH {NODES} SELECT path, size FROM nodes WHERE NOT (path = '/src2' OR path LIKE '/src2/%') AND path <> '/src1/en/new.md' AND name <> 'notes' UNION ALL SELECT '/src1/notes', 0 UNION ALL SELECT '/src1/notes/new.md', 11")
def node_changes(spark, d):
    n = editing.create(_nodes(spark, d), "src1/notes", is_dir=True)
    return editing.delete(editing.write(n, "/src1/./notes/new.md", "hello there"), "/src2").select("path", "size")


@query("SELECT name, key, value FROM (SELECT event_id::VARCHAR AS name, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id::VARCHAR, 'deep.type', event_type FROM events)")
def json_flattened(spark, d):
    doc = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "deep": {"type": "'), "event_type", F.lit('"}}'))
    return documents.flattened(tables.table(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), doc.alias("doc")))


def _doc():
    return F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "deep": {"type": "'), "event_type", F.when(F.col("event_id") % 10 == 0, "").otherwise('"}}'))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '{"deep":{"n":{"of":[' || event_id || ',null]},"type":"' || event_type || '"}}' ELSE '{"deep":{"n":{"of":[' || event_id || ',null]}}}' END AS doc FROM events""")
def json_changed(spark, d):
    e = tables.table(spark, d, "events")
    bare = e.select("event_id", documents.changed(_doc(), "k", None).alias("doc"))  # null where it isn't JSON
    made = bare.select("event_id", F.when(F.col("doc").isNotNull(), documents.changed(F.col("doc"), "deep.n.of", F.concat(F.lit("["), "event_id", F.lit(", null]")))).alias("doc"))
    return made.select("event_id", F.when((F.col("event_id") % 3 == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(documents.changed(F.col("doc"), "deep.type", None)).alias("doc"))


@query("SELECT event_id::VARCHAR AS name, '' AS key, NULL::VARCHAR AS value FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id::VARCHAR, 'k', json_extract_string(props, '$.k') FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id::VARCHAR, 'deep', '{\"type\":\"' || event_type || '\"}' FROM events WHERE event_id % 10 <> 0")
def json_flattened_once(spark, d):
    return documents.flattened(tables.table(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), _doc().alias("doc")), 1)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN '\"' || event_type || '\"' WHEN 2 THEN event_id::VARCHAR ELSE NULL END AS value FROM events")
def json_navigation(spark, d):
    doc = F.concat(F.lit('{"agents": {"one.md": "'), "event_type", F.lit('", "list": [1, {"x.y": '), "event_id", F.lit("}]}}"))
    way = F.element_at(F.array(*map(F.lit, ("agents.one.md", "agents.one", "agents.list.1.x.y", "agents.list.7"))), (F.col("event_id") % 4 + 1).cast("int"))
    return tables.table(spark, d, "events").select("event_id", documents.value_at(doc, way).alias("value"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'new' END AS name, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey ELSE c_custkey::INTEGER END AS n FROM customer")
def merged_rows(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    other = c.select("key", F.when(F.col("key") % 3 == 0, "").otherwise("new").alias("name"), F.when(F.col("key") % 5 == 0, 0).otherwise(F.col("key").cast("int")).alias("n"))
    return documents.merged(c, other, "key", ["name", "n"])


@query("SELECT key, max(doc) AS value FROM (SELECT event_type || '.' || (user_id % 3) AS key, event_id % 10 AS doc FROM events WHERE event_type <> 'view') GROUP BY key")
def copied_and_deleted(spark, d):
    e = tables.table(spark, d, "events").groupBy(F.concat("event_type", F.lit("."), F.col("user_id") % 3).alias("key")).agg(F.max(F.col("event_id") % 10).alias("value"))
    return documents.deleted(documents.copied(e.withColumn("value", F.lit(0).cast("long")), e), "view")


@query("SELECT 'T' || user_id AS name, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS fields FROM events GROUP BY 1")
def types_merged(spark, d):
    rows = tables.table(spark, d, "events").select(F.concat(F.lit("T"), "user_id").alias("name"), F.col("event_id").alias("seq"), F.array("event_id").alias("fields"))
    return documents.types_merged(rows).select("name", F.array_join("fields", ",").alias("fields"))


@query("SELECT event_type AS name, arg_max(props, event_id) AS body FROM events GROUP BY 1")
def functions_merged(spark, d):
    return documents.functions_merged(tables.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.col("props").alias("body")))


@query("SELECT count_if(event_id % 9 <> 0)::BIGINT AS succeeded, count_if(event_id % 9 = 0)::BIGINT AS failed FROM events")
def outcomes(spark, d):
    return documents.outcomes(tables.table(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, "failed").alias("error")))


@query("SELECT string_agg('## ' || title || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY title) AS document FROM (SELECT event_type AS title, arg_max(props, event_id) AS text FROM events GROUP BY 1 UNION ALL SELECT 'zz', 'kept')")
def sections_built(spark, d):
    updates = tables.table(spark, d, "events").select(F.col("event_type").alias("title"), F.col("event_id").alias("seq"), F.col("props").alias("text"))
    old = spark.createDataFrame([("view", "old"), ("zz", "kept")], "title string, text string")
    return documents.built(documents.sections(old, updates))


@query("SELECT count_if(doc_id % 5 < 4)::BIGINT AS supported, count_if(doc_id % 5 = 4)::BIGINT AS unsupported FROM documents")
def loader_counts(spark, d):
    return sources.loader_counts(_files(spark, d))


@query("SELECT name, coalesce(nullif(given, ''), nullif(env, ''), 'default') AS value FROM (SELECT event_id AS name, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS given, CASE WHEN event_id % 3 = 0 THEN props END AS env FROM events)")
def options_resolved(spark, d):
    i = F.col("event_id")
    return tables.table(spark, d, "events").select(i.alias("name"), documents.resolved(F.when(i % 2 == 0, "").otherwise(F.col("event_type")), F.when(i % 3 == 0, F.col("props")), F.lit("default")).alias("value"))


@query("SELECT doc_id AS vec_id, CASE WHEN doc_id % 3 <> 0 THEN length(text) ELSE 1 END::BIGINT AS x, CASE WHEN doc_id % 3 <> 0 THEN strlen(text) ELSE 2 END::BIGINT AS y FROM documents")
def vector_upsert(spark, d):
    docs = _docs(spark, d)
    fresh = retrieval.embedded(docs.where("doc_id % 3 <> 0"), lambda texts: [[len(t), len(t.encode())] for t in texts]).withColumnRenamed("doc_id", "vec_id")
    old = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    return retrieval.upserted(old, fresh).select("vec_id", *[F.col("embedding")[i].cast("long").alias(x) for i, x in enumerate("xy")])


@query("SELECT string_agg(left(d.text, 50), chr(10) || chr(10) ORDER BY score DESC, d.text DESC) AS context FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 4) JOIN (SELECT vec_id, 'text of ' || vec_id AS text FROM embeddings) d USING (vec_id)")
def retrieval_context(spark, d):
    e = tables.table(spark, d, "embeddings")
    found = retrieval.top_k(e, e.where("vec_id = 0").first()["embedding"], threshold=-1.0).select("vec_id", F.round("score", 6).alias("score"))
    return retrieval.context(found, e.select("vec_id", F.concat(F.lit("text of "), "vec_id").alias("text")))


@query("SELECT path FROM (SELECT '/' || source || '/' || lang || '/doc' || doc_id || '.' || (['md','txt','go','py','json'])[doc_id % 5 + 1] AS path FROM documents) WHERE NOT (path LIKE '%.py' OR regexp_matches(path, '^/src1/de/[^/]*$') OR contains(path, 'src4/fr'))")
def root_rules(spark, d):
    f = _files(spark, d).select(F.regexp_replace("path", r"/\.doc", "/doc").alias("path"))
    return f.where(~search.root_ignored(F.col("path"), ["*.py", "/src1/de/*", "src4/fr"])).select("path")


@query(_search("NOT is_dir AND NOT (name LIKE '%.json' OR name LIKE 'doc1_.%')"))
def name_rules(spark, d):
    n = _nodes(spark, d).where("NOT is_dir")
    return n.where(~search.name_ignored(F.col("path"), ["# comment", "*.json", "!doc3.json", "doc1?.*/"])).select("path")


@query("SELECT page_id, strlen(html) > 0 AS ok FROM pages")
def page_main(spark, d):
    """Only that no script is left; the texts are held against goldens in tests."""
    rows = tables.table(spark, d, "pages").select("page_id", html.main_content("html").alias("t"))
    return rows.select("page_id", (~F.contains("t", F.lit("<script"))).alias("ok"))


@query(f"WITH {NODES} SELECT path AS id, 'look at #File:' || ltrim(path, '/') || ' please' || chr(10) || chr(10) || '```' || {_LANG} || chr(10) || text || chr(10) || '```' AS text FROM nodes WHERE NOT is_dir")
def file_mentions(spark, d):
    f = _files(spark, d)
    asked = f.select(F.col("path").alias("id"), F.concat(F.lit("look at #File:"), F.ltrim("path", F.lit("/")), F.lit(" please")).alias("text"))
    return packing.mentions(asked, f)


@query("SELECT doc_id, replace(text, '![', '! [') || ' ![a](/images/docs/pic/' || doc_id || '.png) and ![b](HTTP://h/x.png) ' || replace(text, '![', '! [') || ' ![](/images/up.gif)' AS text FROM documents")
def image_links(spark, d):
    own = F.replace("text", F.lit("!["), F.lit("! ["))
    raw = F.concat(own, F.lit(" ![a](pic/"), "doc_id", F.lit(".png?x=1#y) and ![b](HTTP://h/x.png) "), own, F.lit(" ![](../up.gif)"))
    return _docs(spark, d).select("doc_id", text.image_links(raw, F.lit("/docs")).alias("text"))


@query("SELECT doc_id, 'interface{}' || chr(10) || '```mermaid' || chr(10) || 'classDiagram' || chr(10) || 'A' || doc_id || ' --> B : any' || chr(10) || '```' || chr(10) || 'C --> *D' AS text FROM documents")
def mermaid_mended(spark, d):
    raw = F.concat(F.lit("interface{}\n```mermaid\nclassDiagram\nA"), "doc_id", F.lit(" --> *B : interface{}\n```\nC --> *D"))
    return _docs(spark, d).select("doc_id", text.mermaid(raw).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def tool_arguments(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"args": '), "props", F.lit(", }"))).otherwise(F.col("props"))
    return tables.table(spark, d, "events").select("event_id", documents.get(documents.tool_arguments(documents.parsed(raw)), "k", "int", -1).alias("k"))


@query("SELECT event_id FROM events WHERE (user_id % 5 = 0 AND event_id % 30 > 0) OR (event_id % 30 > 20 AND user_id % 5 < 3)")
def batches_skipped(spark, d):
    e = tables.table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("types"), (F.col("event_id") % 30).alias("funcs"))
    return packing.skipped(e).select("event_id")


@query("SELECT '/f' || event_id AS path, event_type AS author, 'u' || user_id || '@x.org' AS email, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events, range(2)")
def blame_porcelain(spark, d):
    e = tables.table(spark, d, "events")
    head = F.concat(F.lit("0a1b 1 1 2\nauthor "), "event_type", F.lit("\nauthor-mail <u"), "user_id", F.lit("@x.org>\nauthor-time "), F.unix_timestamp("ts"), F.lit("\nsummary author x\n\tfirst line\n0a1b 2 2\n\tauthor nobody\n"))
    return sources.porcelain(e.select(F.concat(F.lit("/f"), "event_id").alias("path"), head.alias("text"))).select("path", "author", "email", F.unix_timestamp("when").alias("seconds"))


@query("SELECT event_id, 'K' || user_id AS key, event_type || '=' || event_id AS value FROM events WHERE event_id % 3 <> 0")
def key_value_lines(spark, d):
    line = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" K"), "user_id", F.lit(" = "), "event_type", F.lit("="), "event_id", F.lit(" ")))
    return tables.table(spark, d, "events").select("event_id", sources.key_values(line).alias("x")).where("x IS NOT NULL").select("event_id", "x.key", "x.value")


@query(f"WITH {NODES} SELECT path AS source, name AS filename, ltrim(path, '/') AS rel_path, md5(text) AS sum FROM nodes WHERE ext IN ('.md', '.txt', '.go', '.py')")
def documents_loaded(spark, d):
    found = _files(spark, d).select("path", F.col("text").cast("binary").alias("content"))
    return sources.documents(found).select("source", "filename", "rel_path", F.md5("text").alias("sum"))


@query("SELECT '/src' || doc_id AS dir, unnest(['*.log', 'tmp/', '!keep' || doc_id]) AS rule FROM documents")
def ignore_rules_read(spark, d):
    body = F.concat(F.lit("# comment\r\n*.log\n\n  tmp/  \n!keep"), "doc_id")
    found = _docs(spark, d).select(F.explode(F.array(F.struct(F.concat(F.lit("/src"), "doc_id", F.lit("/.gitignore")).alias("path"), body.alias("content")), F.struct(F.concat(F.lit("/src"), "doc_id", F.lit("/a.md")).alias("path"), F.lit("*.md").alias("content")))).alias("f"))
    return sources.ignore_rules(found.select("f.*"))


@query(f"WITH {NODES} SELECT path FROM nodes WHERE NOT is_dir AND ext IN ('.md', '.txt', '.go', '.py', '.json')")
def readable_files(spark, d):
    f = _files(spark, d)
    odd = f.select(F.concat("path", F.lit(".bin")).alias("path"), F.unhex(F.lit("FFFE00")).alias("content"))
    return sources.readable(f.select("path", F.col("text").cast("binary").alias("content")).unionByName(odd)).select("path")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(['.git', 'node_modules', 'docs']) AS word FROM documents) WHERE word = 'docs' GROUP BY word")
def pruned_scan(spark, d):
    p = _docs(spark, d).select(F.explode(F.array(*map(F.lit, (".git", "node_modules", "docs")))).alias("word"), "doc_id").withColumn("path", F.concat(F.lit("/a/"), "word", F.lit("/x"), "doc_id"))
    return p.where(~paths.pruned(F.col("path"), F.lit(False))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["QUERIES", "ORACLE_SQL"]
