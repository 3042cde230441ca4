"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import Scratch, renamed, running_totals

#: Weights of the sources in order of their code points, repeating; words of the mix as a share of all; most epochs of a source.
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Sources that are broadcast, some 100 bytes each; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, _rank from rows of source, size.

    What the weights give beyond epochs times a source's size is reshared among the others until none is above. The level,
    words for each unit of weight, rises from round to round, and each round needs three sums over the table of sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"_all": F.lit(0), "_null": F.col("source").isNull().cast("int")})
    ranked = running_totals(by, "_all", ["_null", "source"], "source_size", scratch).withColumnRenamed("rows_before", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    table = scratch.table(ranked.select("source", "source_size", "_rank", weight.alias("_weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("_cap")), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = -1.0, None
    while True:
        full = F.col("_cap") / F.col("_weight") <= level
        now = table.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        capped, open_ = float(now[0] or 0), float(now[1] or 0)
        if (capped, open_) == before or not open_:
            break
        before, level = (capped, open_), (total - capped) / open_
    return table.select("source", "source_size", "_rank", F.least(F.col("_weight") * F.lit(level), F.col("_cap")).alias("target"))


def by_seed(*parts: Column, seed: str = SEED) -> Column:
    """The seeded order: an md5 of the parts."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(x.cast("string"), F.lit("null")) for x in parts]))


def taken(rows: DataFrame, by_source: DataFrame, scratch: Scratch, order: list[str], words: str = "size") -> DataFrame:
    """Adds source_size, target, _epochs (whole repetitions) and _extra (words of the last, fractional one).

    In the order of a source, documents are taken once more until the words that whole repetitions leave over are used up;
    the document at the border gives only as many words as are left. So each source takes its target to a word.
    """
    joined = rows.join(by_source.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    ordered = running_totals(joined, "_rank", order, words, scratch)
    epochs = _epochs()
    left = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    return ordered.withColumns({"_epochs": epochs.cast("long"), "_extra": F.greatest(F.lit(0).cast("long"), F.least(left - F.col("weight_before"), F.col(words)))})


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    Null texts have size 0, a null source is a source of its own and comes last, rows that repeat are rows of their own;
    equal doc_ids are ordered by size. Of a long text only its words are counted, on the JVM. An empty table gives no rows.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(docs.select("doc_id", "source", size().alias("size")), "sizes")
    out = taken(rows.withColumn("_random", by_seed(F.col("doc_id"))), targets(rows, scratch), scratch, ["_random", "doc_id", "size"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_extra")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; of the documents at the borders whole ones if half is taken.

    A document's place in the seeded order comes from its doc_id and text, so rows with the same doc_id, source and text share
    one decision. The plan is a row a source: its whole repetitions, and the place up to which documents are taken once more;
    so no text is shuffled unless the sources are too many for a broadcast. Documents without words go with those around them.
    Nulls, ties and empty tables are treated as in mix_sizes(). Other columns stay as they are, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own, back = renamed(docs, "doc_id", "source", "text")
    place = by_seed(F.col("doc_id"), F.xxhash64("text"))
    rows = own.select("source", size().alias("_one"), place.alias("_random")).groupBy("source", "_random").agg(F.sum("_one").alias("size"))
    rows = scratch.table(rows, "sizes")
    sources = targets(rows, scratch)
    plan = taken(rows, sources, scratch, ["_random"])
    border = plan.where((F.col("_extra") > 0) & (2 * F.col("_extra") >= F.col("size"))).groupBy("source").agg(F.max("_random").alias("_border"))
    border = border.select(F.col("source").alias("_of"), "_border")
    each = sources.join(border, F.col("source").eqNullSafe(F.col("_of")), "left").select(F.col("source").alias("_from"), _epochs().cast("int").alias("_epochs"), "_border")
    each = scratch.table(each, "plan")
    few = each.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = own.withColumn("_random", place).join(F.broadcast(each) if few else each, F.col("source").eqNullSafe(F.col("_from")))
    times = F.col("_epochs") + F.coalesce(F.col("_random") <= F.col("_border"), F.lit(False)).cast("int")
    return back(joined.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sizes() of all documents."""
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER w - cap AS capped, sum(weight) OVER (ORDER BY cap / weight DESC, source ROWS UNBOUNDED PRECEDING) AS open_weight FROM r WINDOW w AS (ORDER BY cap / weight, source DESC ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((total - capped) / open_weight, cap / weight) FILTER (cap / weight > (total - capped) / open_weight) AS level FROM o, (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM s)),
t AS (SELECT source, source_size, least(weight * level, cap) AS target, CASE WHEN source_size > 0 THEN floor(least(weight * level, cap) / source_size) ELSE 0 END AS epochs FROM r, l),
x AS (SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS earlier FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(round(target - epochs * source_size) - earlier, size)))::BIGINT AS taken FROM x
"""
