"""Paths, names and extensions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that a scan never enters.
PRUNED = ".git .vscode .idea node_modules .svn .hg .DS_Store __pycache__ bin obj dist build target fonts".split()

# Extensions of programs.
PROGRAM = "go py js ts jsx tsx java cpp c h hpp rs rb php swift kt scala cs vue sh pl r m mm lua".split()

# Extensions that count as text when packing.
PACKED = ".txt .md .go .py .js .ts .java .cpp .c .h .cs .php .rb .rs .swift .kt .scala .sh .yaml .yml .json .xml .html .css .scss .less .sql .cfg .ini .toml .dockerfile .gitignore .gitattributes .editorconfig .babelrc .eslintrc .prettierrc .npmignore .yarnrc".split()

# Extensions of readable text; a file with another one is readable if its first 512 bytes are valid UTF-8.
READABLE = """
.md .txt .log .json .xml .csv .yml .yaml .go .py .js .ts .html .css .java .c .cpp .h .rb .php .sh .bat .ps1 .sql .r .scala .swift .mdx
.kt .groovy .dart .lua .perl .hs .erl .ex .rs .fs .vb .asm .s .pl .pm .t .pod .ini .cfg .conf .properties .toml .lock .env .gitignore
.dockerignore .editorconfig .eslintrc .prettierrc .babelrc .tsv .tsx .jsx .vue .svelte .graphql .gql .proto .thrift .avdl .avpr .avsc .idl
.puml .plantuml .dot .gv .mmd .mermaid .sv .v .vh .svh .vhd .vhdl .tex .sty .cls .bib .bst .adoc .asciidoc .rst .rest .wiki .markdown
.mdown .mkdn .mkd .mdwn .mdtxt .mdtext .text .creole .mediawiki .twig .j2 .jinja .jinja2 .njk .ejs .haml .pug .slim .styl .less .sass
.scss .stylus .postcss .pcss .sss .coffee .litcoffee .iced .cson .pegjs .jison .jisonlex .lex .y .yacc .ebnf .bnf .abnf .peg
.pegcoffee .pegiced .pegjison .peglex .pegy .pegyacc .pegebnf .pegbnf .pegabnf .pegpeg .pegpegjs .pegpegcoffee .pegpegiced
.pegpegjison .pegpeglex .pegpegy .pegpegyacc .pegpegebnf .pegpegbnf .pegpegabnf
""".split()

# The language of a fenced block, by extension.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "jsx", ".tsx": "tsx", ".java": "java", ".cpp": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".rs": "rust", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".sh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".html": "html", ".css": "css",
    ".scss": "scss", ".less": "less", ".sql": "sql", ".md": "markdown", ".txt": "text", ".cfg": "ini", ".ini": "ini", ".toml": "toml",
    ".dockerfile": "dockerfile",
}

# Media types, by extension; text/plain for others.
MIME = {
    "text/markdown": ".md .markdown .mdown .mkdn .mkd .mdwn .mdtxt .mdtext", "application/json": ".json", "text/x-go": ".go", "text/x-python": ".py",
    "application/javascript": ".js", "application/typescript": ".ts", "text/html": ".html", "text/css": ".css", "text/x-java": ".java", "text/x-c": ".c .h",
    "text/x-c++": ".cpp .cc .cxx .hpp .hh .hxx", "application/x-httpd-php": ".php", "text/x-ruby": ".rb", "application/x-sh": ".sh",
    "application/x-msdos-program": ".bat", "application/x-powershell": ".ps1", "application/sql": ".sql",
}


def standard(path: Column) -> Column:
    """A leading slash, forward slashes only, no doubled ones."""
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, r"\\", "/")), "/+", "/")


def normal(path: Column) -> Column:
    """standard(), then . and .. resolved lexically; no slash at the end; the empty path is /."""
    parts = F.filter(F.split(standard(path), "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    """Segments: 0 for the root."""
    return F.size(segments(path))


def name(path: Column) -> Column:
    return F.when(path == "/", "/").otherwise(F.substring_index(path, "/", -1))


def parent(path: Column) -> Column:
    """Null for the root."""
    return F.when(path == "/", F.lit(None)).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments(path), 1, F.greatest(depth(path) - 1, F.lit(0))), "/")))


def ext(path: Column) -> Column:
    """From the last dot of the name on; empty without one. A name that starts with its only dot is all extension."""
    return F.regexp_extract(name(path), r"(\.[^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """All directories above, from the root on."""
    s = segments(path)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(s, 1, i), "/")))


def language(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit(""))


def mime(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kind, all_ in MIME.items() for e in all_.split() for x in (e, kind)])
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit("text/plain"))


def is_program(extension: Column) -> Column:
    """Case counts."""
    return F.regexp_replace(extension, r"^\.", "").isin(PROGRAM)


def is_packed(extension: Column) -> Column:
    return (extension == "") | F.lower(extension).isin(PACKED)


def is_readable(extension: Column, content: Column) -> Column:
    return F.lower(extension).isin(READABLE) | F.call_function("is_valid_utf8", F.substring(content, 1, 512).cast("string"))


def is_binary(content: Column) -> Column:
    """By the first 8192 bytes: a zero byte, over 30 % control bytes, or invalid UTF-8 with over half of the bytes high."""
    head = F.substring(content.cast("binary"), 1, 8192)
    signs = F.decode(head, "ISO-8859-1")  # a character for each byte
    n = F.octet_length(head)
    control = F.regexp_count(signs, F.lit("[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]"))
    high = F.regexp_count(signs, F.lit("[\\x80-\\xFF]"))
    odd = F.contains(signs, F.lit("\0")) | (control / n > 0.3) | (~F.call_function("is_valid_utf8", head.cast("string")) & (high / n > 0.5))
    return F.coalesce(n, F.lit(0)).cast("boolean") & odd


def hidden_name(path: Column) -> Column:
    return (path != "/") & F.startswith(name(path), F.lit("."))


def hidden_path(path: Column) -> Column:
    return F.exists(segments(path), lambda x: F.startswith(x, F.lit(".")))


def pruned(path: Column, is_dir: Column) -> Column:
    """Whether the path is or lies in a directory that scans never enter."""
    s = segments(path)
    dirs = F.when(is_dir, s).otherwise(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, PRUNED)))


def under(path: Column, top: str) -> Column:
    return F.lit(True) if top in ("", "/") else (path == top) | F.startswith(path, F.lit(top + "/"))


def allowed_ext(path: Column, extensions: list[str]) -> Column:
    """Whether the extension is one of those; `*` or none allows all. A name without one fits none."""
    wanted = extension_list(",".join(extensions))
    if not wanted or "*" in wanted:
        return F.lit(True)
    return F.lower(F.regexp_replace(ext(path), r"^\.", "")).isin([x.lower() for x in wanted]) & ~F.endswith(path, F.lit("."))


def extension_list(text: str) -> list[str]:
    """Split at commas, trimmed, without leading dots and empty parts."""
    return [x for x in (y.strip().removeprefix(".") for y in text.split(",")) if x]


def human_size(size: Column) -> Column:
    """bytes, KB, MB or GB, with one decimal beyond bytes; ties go to the even digit."""
    scaled = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" bytes"))).when(size < 1024**2, scaled(1, "KB")).when(size < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def page_url(url: Column) -> Column:
    """With https:// where no scheme is given."""
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def size_label(size: Column) -> Column:
    """B, KB or MB; empty for 0."""
    scaled = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))
    return F.when(size <= 0, "").when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, scaled(1, "KB")).otherwise(scaled(2, "MB"))
