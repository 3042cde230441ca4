"""JSON documents, dotted navigation, keyed copies, catalogs and sections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(text: Column) -> Column:
    """A variant; commas before a closing bracket are forgiven, anything else that isn't JSON is null."""
    return F.try_parse_json(F.regexp_replace(text, r",(\s*[}\]])", "$1"))


def get(doc: Column, path: str, kind: str, default) -> Column:
    """A value by dotted path, or the default where it is missing or of another type."""
    return F.coalesce(F.try_variant_get(doc, "$." + path, kind), F.lit(default))


def pretty(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except (TypeError, ValueError):
                return "{}"

        return rows.map(one)

    return run(text)


def fields(doc: Column) -> Column:
    """The fields of a variant as a map of variants; null where it is no object."""
    return F.try_variant_get(doc, "$", "map<string,variant>")


def changed(text: Column, path: str, value: Column | None) -> Column:
    """The document with a dotted path set to a JSON value, or deleted where that is null; maps on the way are made.

    Null where the document isn't JSON, has a key twice in one object, or the value isn't JSON; a document that isn't a map stays as it is, a null or
    empty one counts as an empty map. Maps are rebuilt key by key in the JVM, so the result is compact and its keys are sorted.
    """
    none = F.expr("map_from_arrays(cast(array() AS array<string>), cast(array() AS array<variant>))")
    new = None if value is None else F.try_parse_json(value)

    def put(at: Column, way: list[str]) -> Column:
        """The fields with the way set; `at`: fields, not null."""
        key = F.lit(way[0])
        others = F.map_filter(at, lambda k, _: k != key)
        if len(way) == 1:
            return others if new is None else F.map_concat(others, F.create_map(key, new))
        inner = F.element_at(F.transform(F.array(fields(F.try_element_at(at, key))), lambda m: F.to_variant_object(put(F.coalesce(m, none), way[1:]))), 1)
        made = F.map_concat(others, F.create_map(key, inner))
        return made if new is not None else F.when(fields(F.try_element_at(at, key)).isNotNull(), made).otherwise(at)

    doc = F.try_parse_json(F.when(F.coalesce(text, F.lit("")) == "", "{}").otherwise(text))
    done = F.when(fields(doc).isNotNull(), F.to_json(F.to_variant_object(put(fields(doc), path.split("."))))).when(doc.isNotNull(), text)
    return done if new is None else F.when(new.isNotNull(), done)


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """name, doc: new documents replace those of the same name."""
    return store.join(new.select("name"), "name", "left_anti").unionByName(new)


def navigate(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, key, value of flattened rows (key, value) for dotted queries (query).

    The exact key first, else one that is equal without its last extension; the least key of several.
    """
    bare = F.regexp_replace("key", r"\.[^.]+$", "")
    exact = rows.select(F.col("key").alias("query"), "key", "value", F.lit(1).alias("rank"))
    loose = rows.where(bare != F.col("key")).select(bare.alias("query"), "key", "value", F.lit(2).alias("rank"))
    joined = wanted.select("query").distinct().join(exact.unionByName(loose), "query")
    return joined.groupBy("query").agg(F.min(F.struct("rank", "key", "value")).alias("m")).select("query", "m.key", "m.value")


def value_at(doc: Column, path: Column) -> Column:
    """The JSON value at a dotted path of a document, null if there is none.

    A step is a key, a key that holds dots itself, so that several parts of the path name it, a key without its extension
    (the least of several), or a place in an array.
    """

    @F.pandas_udf("string")
    def run(docs: pd.Series, ways: pd.Series) -> pd.Series:
        absent = object()

        def at(data, parts):
            if not parts:
                return data
            if isinstance(data, list):
                return at(data[int(parts[0])], parts[1:]) if parts[0].isdigit() and int(parts[0]) < len(data) else absent
            if not isinstance(data, dict):
                return absent
            steps = [(".".join(parts[:n]), n) for n in range(1, len(parts) + 1)]
            steps += [(k, 1) for k in sorted(data) if k.rfind(".") > 0 and k[: k.rfind(".")] == parts[0]]
            for key, n in steps:
                if key in data and (found := at(data[key], parts[n:])) is not absent:
                    return found
            return absent

        def one(t, p):
            try:
                found = at(json.loads(t), p.split("."))
            except (TypeError, ValueError, AttributeError):
                return None
            return None if found is absent else json.dumps(found, ensure_ascii=False)

        return pd.Series([one(t, p) for t, p in zip(docs, ways, strict=True)], dtype=object)

    return run(doc, path)


def maps_first(rows: DataFrame, keys: str = "key", values: str = "value") -> DataFrame:
    """An order of JSON entries: maps, then others, each by key."""
    return rows.orderBy(F.desc(F.startswith(F.ltrim(values), F.lit("{"))), keys)


def config_document(rows: DataFrame) -> DataFrame:
    """document: top-level entries (key, value as JSON) as one object in key order, indented by two spaces."""
    entry = F.concat(F.lit("  "), F.to_json(F.array(F.col("key"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("key")))) - 2), F.lit(": "), F.col("value"))
    lines = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", entry.alias("line")))), lambda x: x["line"]), ",\n").alias("_body"))
    return lines.select(F.when(F.col("_body") == "", "{}").otherwise(F.concat(F.lit("{\n"), "_body", F.lit("\n}"))).alias("document"))


def write_back(entries: DataFrame, target: str, config: str) -> None:
    """Entries (key, value, kind) below target: kind file writes the text under its key, any other goes to the configuration document."""
    from arbora.operators import packing

    rows = entries.where("kind <> 'file'")
    document = config_document(rows).where(F.col("document") != "{}").select(F.lit(config).alias("path"), F.col("document").alias("text"))
    packing.write_files(entries.where("kind = 'file'").select(F.col("key").alias("path"), F.col("value").alias("text")).unionByName(document), target)


#: Levels that flattened() opens in one row, and how often it goes on with what that gave.
LEVELS, STAGES = 8, 8


def _opened(entries: Column) -> Column:
    """Entries (key, v) with each object that has fields replaced by them, one level down."""
    inner = lambda e, m: F.transform(F.map_entries(m), lambda x: F.struct(F.concat(F.when(e["key"] == "", "").otherwise(F.concat(e["key"], F.lit("."))), x["key"]).alias("key"), x["value"].alias("v")))
    each = lambda e: F.element_at(F.transform(F.array(fields(e["v"])), lambda m: F.when(F.size(m) > 0, inner(e, m)).otherwise(F.array(e))), 1)
    return F.flatten(F.transform(entries, each))


def flattened(docs: DataFrame, depth: int = 0) -> DataFrame:
    """name, key, value: leaves of JSON objects (name, doc) by dotted key, at most so many levels down (0: all).

    Arrays and empty maps are leaves; texts are values as they are, others as compact JSON. A null or empty document is an empty map
    with the key ''; one that isn't JSON, or has a key twice in one object, gives a row with the key '' and a null value. One pass in
    the JVM: objects are opened level by level within their row. Nesting beyond LEVELS * STAGES levels fails where all levels are wanted.
    """
    text = F.when(F.coalesce("doc", F.lit("")) == "", "{}").otherwise(F.col("doc"))
    rows = docs.select("name", F.lit("").alias("key"), F.try_parse_json(text).alias("v"))
    left = depth or LEVELS * STAGES
    while left > 0:
        entries = F.array(F.struct("key", "v"))
        for _ in range(min(left, LEVELS)):
            entries = _opened(entries)
        rows, left = rows.select("name", F.explode(entries).alias("_e")).select("name", "_e.key", "_e.v"), left - LEVELS
    if not depth:
        rows = rows.where(F.assert_true(F.coalesce(F.size(fields(F.col("v"))) <= 0, F.lit(True)), F.lit(f"a document is nested deeper than {LEVELS * STAGES} levels")).isNull())
    shown = F.to_json("v")
    return rows.select("name", "key", F.when(F.startswith(shown, F.lit('"')), F.try_variant_get("v", "$", "string")).otherwise(shown).alias("value"))


def copied(target: DataFrame, source: DataFrame, prefix: str = "") -> DataFrame:
    """key, value: the source's rows at or below a prefix replace the target's; without a prefix all of them."""
    hit = (F.col("key") == prefix) | F.startswith("key", F.lit(prefix + ".")) if prefix else F.lit(True)
    return target.where(~hit).unionByName(source.where(hit))


def deleted(target: DataFrame, prefix: str) -> DataFrame:
    return target.where(~((F.col("key") == prefix) | F.startswith("key", F.lit(prefix + "."))))


def merged(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows by key; columns of other that are neither null nor a zero value win, those of a struct field by field."""
    o = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])

    def zero(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(x == "", F.lit(True))
        if isinstance(kind, T.BooleanType):
            return ~F.coalesce(x, F.lit(False))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(x) <= 0, F.lit(True))
        return F.coalesce(x == F.lit(0).cast(kind), F.lit(True)) if isinstance(kind, T.NumericType) else x.isNull()

    def one(c: str) -> Column:
        kind = other.schema[c].dataType
        if isinstance(kind, T.StructType):
            own = [F.when(zero(F.col(f"_{c}")[f.name], f.dataType), F.col(c)[f.name]).otherwise(F.col(f"_{c}")[f.name]).alias(f.name) for f in kind.fields]
            return F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.struct(*own)).alias(c)
        return F.when(zero(F.col(f"_{c}"), kind), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)

    return base.join(o, key, "left").select(key, *map(one, columns))


def catalog_search(catalog: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return catalog.where(F.contains(F.lower("title"), q) | F.contains(F.lower("description"), q))


def tool_arguments(doc: Column) -> Column:
    """What `args` holds, or the whole."""
    return F.coalesce(F.try_variant_get(doc, "$.args", "variant"), doc)


def sections(doc: DataFrame, updates: DataFrame) -> DataFrame:
    """title, text of sections; the last update (title, seq, text) of a title wins. Sorted by title when built."""
    last = updates.groupBy("title").agg(F.max_by("text", "seq").alias("text"))
    return doc.join(last.select("title"), "title", "left_anti").unionByName(last)


def built(found: DataFrame) -> DataFrame:
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "text"))), lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["text"], F.lit("\n"))), "\n").alias("document"))


def types_merged(rows: DataFrame) -> DataFrame:
    """name, fields: of types that occur several times, all fields in the order of seq."""
    return rows.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fields"))), lambda x: x["fields"])).alias("fields"))


def functions_merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.max_by("body", "seq").alias("body"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def write_keyed(rows: DataFrame, path: str) -> None:
    """key=value lines in key order."""
    rows.select(F.concat("key", F.lit("="), "value").alias("value"), "key").repartitionByRange("key").sortWithinPartitions("key").select("value").write.mode("overwrite").text(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the last by order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def valid_option(value: str, options: list[str], kind: str = "string") -> bool:
    """Any value where no options are given or the kind is csv, else one of them."""
    return not options or kind == "csv" or value in options


def resolved(*candidates: Column) -> Column:
    """The first value that is neither null nor empty: argument, environment, file, default."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def expanded(configs: DataFrame, files: DataFrame) -> DataFrame:
    """key, value of a directory as a nested map: the one configuration document's keys on top, files by dotted path.

    configs: name, doc (JSON, commas before closing brackets forgiven). files: path, text. A file wins over an equal key.
    """
    top = flattened(configs.select("name", F.regexp_replace("doc", r",(\s*[}\]])", "$1").alias("doc"))).select("key", "value")
    own = files.select(F.regexp_replace(F.ltrim("path", F.lit("/")), "/", ".").alias("key"), F.col("text").alias("value"))
    return own.unionByName(top.join(own.select("key"), "key", "left_anti"))
