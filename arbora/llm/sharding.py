"""Sharding by balanced label propagation.

Linked documents, here those with equal texts, move towards the shard that holds most of their neighbours, round by round
and under quotas, so that few links are cut while every shard gets as many rows as any other, or one less. The state is
one label for each linked row; a clique's neighbour counts come from counting labels by group, never from its pairs.

A group moves in pieces of at most a shard's quota, so only groups beyond it are cut from the start; pieces look at the
labels of the whole group, and so tend to one shard. A piece whose rows all lie in one shard is settled and takes up
room there; rows of others are about to leave and take none. In each round the largest open pieces move, those down to
a quarter of the size of the largest. Rounds end when all pieces are settled; when none has moved for some rounds, the
ones in turn are halved, as no shard has room for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import Scratch, running_totals

SHARDS, EXTRA_BYTES = 40, 16
#: Rounds without a move before open pieces are halved.
PATIENCE = 2
#: Rows of a written table of pieces in a task.
PIECES = 200_000
#: Moves into a shard are allowed or not by so many classes of pieces of about one size.
CLASSES = 128


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law `rows`: counts differ by one at most.

    Size: UTF-8 bytes of the text (null: none) plus 16. A null text counts as an empty one. Rows that repeat are rows of
    their own; rows of one group are ordered by doc_id (null ones first), and rows alike in doc_id and text are
    interchangeable. Texts are read whole, but only their hashes are dealt. With fewer rows than shards some shards stay
    empty; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.table(docs.select("doc_id", (F.octet_length(text) + EXTRA_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_group"), F.lit(1).cast("long").alias("_one")), "rows")
    quota, more = divmod(rows.count(), shards)
    linked = scratch.table(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1"), "groups")
    # pieces of groups: the rank in the group by doc_id
    members = running_totals(rows.join(linked, "_group"), "_group", ["doc_id"], "_one", scratch)
    start = F.pmod(F.xxhash64("doc_id", "rows_before"), F.lit(shards)).cast("int")
    whole = max(1, quota)
    first = members.select("doc_id", "size", "text_crc32", "_group", F.col("rows_before").alias("_rank"), (F.floor(F.col("rows_before") / whole) * whole).alias("_base"), start.alias("shard"))
    state = scratch.table(first.withColumn("_piece", _name()), "labels")
    # rounds need no rows but those of pieces: where each is (its shard, null while it is open) and where its rows were
    here = scratch.table(state.groupBy("_group", "_piece", "shard").agg(F.count(F.lit(1)).alias("_here")), "here")
    few = 1 + here.count() // PIECES  # tasks that write a table of pieces
    pieces, still, n = scratch.table(_pieces(here).coalesce(few), "pieces"), 0, 0
    while largest := pieces.where("_to IS NULL").agg(F.max("_all")).first()[0]:
        turn = pieces.where(F.col("_to").isNull() & (4 * F.col("_all") > largest)).select("_group", "_piece", "_all")
        moved = scratch.table(_round(here, pieces, turn, shards, quota, n).coalesce(few), "moved")
        n += 1
        if not moved.isEmpty():
            after, still = pieces.join(moved.select("_piece", F.col("_to").alias("_new")), "_piece", "left").select("_group", "_piece", "_all", F.coalesce("_to", "_new").alias("_to")), 0
        elif (still := still + 1) < PATIENCE:
            continue
        else:
            still, half = 0, F.ceil(F.col("_all") / 2)
            turn = scratch.table(turn.coalesce(few), "turn")
            base = F.col("_base") + F.coalesce(F.floor((F.col("_rank") - F.col("_base")) / half) * half, F.lit(0))
            cut = state.join(turn.select("_piece", "_all"), "_piece", "left").select("doc_id", "size", "text_crc32", "_group", "_rank", base.cast("long").alias("_base"), "shard").withColumn("_piece", _name())
            later = scratch.table(cut, "labels")
            scratch.drop(state)
            state = later
            here = scratch.table(state.groupBy("_group", "_piece", "shard").agg(F.count(F.lit(1)).alias("_here")), "here")
            kept = pieces.join(turn.select("_piece"), "_piece", "left_anti").select("_group", "_piece", "_all", "_to")
            after = kept.unionByName(_pieces(here).join(kept.select("_piece"), "_piece", "left_anti"))
        after = scratch.table(after.coalesce(few), "pieces")
        scratch.drop(pieces)
        pieces = after
    places = pieces.select("_piece", (F.col("_all") == 1).cast("int").alias("_last"), "_to")
    names = ["doc_id", "size", "text_crc32", "_piece", "shard", "_last"]
    single = rows.join(linked, "_group", "left_anti").select("doc_id", "size", "text_crc32", F.lit("").alias("_piece"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int").alias("shard"), F.lit(2).alias("_last"))
    labelled = state.drop("shard").join(places.withColumnRenamed("_to", "shard"), "_piece").select(*names).unionByName(single)
    return _levelled(labelled, shards, quota, more, scratch).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _pieces(here: DataFrame) -> DataFrame:
    """_group, _piece, _all (its rows), _to: the shard of a piece whose rows are all there, else null."""
    one = F.when(F.min("shard") == F.max("shard"), F.min("shard"))
    return here.groupBy("_group", "_piece").agg(F.sum("_here").alias("_all"), one.alias("_to"))


def _name() -> Column:
    return F.concat_ws("-", F.col("_group"), F.col("_base").cast("string"))


def _round(here: DataFrame, pieces: DataFrame, open_: DataFrame, shards: int, quota: int, n: int) -> DataFrame:
    """_piece, _to of the open pieces that move in this round: to the shard with most of their group that has room for them."""
    settled = pieces.where("_to IS NOT NULL AND _all > 1").select("_group", F.col("_to").alias("shard"), F.col("_all").alias("_here"))
    load = settled.groupBy("shard").agg(F.sum("_here").alias("_load"))  # a row a shard
    # shards that the group's rows are in, settled ones at their new place, and one more by a hash
    scattered = here.join(pieces.where("_to IS NULL").select("_piece"), "_piece", "left_semi").select("_group", "shard", "_here")
    group = scattered.unionByName(settled).groupBy("_group", "shard").agg(F.sum("_here").alias("_rows"))
    near = open_.join(group, "_group").select("_group", "_piece", "_all", "shard", "_rows")
    other = open_.select("_group", "_piece", "_all", F.pmod(F.xxhash64("_piece", F.lit(n)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("_rows"))
    room = F.lit(quota) - F.coalesce("_load", F.lit(0))
    fits = near.unionByName(other).join(F.broadcast(load), "shard", "left").withColumn("_room", room).where("_room >= _all")
    best = F.max_by(F.struct("shard", "_room"), F.struct("_rows", F.xxhash64("_group", "shard", F.lit(n))))
    want = fits.groupBy("_piece").agg(best.alias("_best"), F.first("_all").alias("_all"))
    # large pieces first, then by a hash: room for whole classes of pieces, at most shards * 64 * CLASSES rows
    order = F.floor(F.log2("_all") * 4).cast("int") * -CLASSES + F.pmod(F.xxhash64("_piece", F.lit(n), F.lit("class")), F.lit(CLASSES)).cast("int")
    want = want.select("_piece", F.col("_best.shard").alias("_to"), F.col("_best._room").alias("_room"), "_all", order.alias("_class"))
    classes = want.groupBy("_to", "_class").agg(F.sum("_all").alias("_sum"), F.max("_room").alias("_free"))
    allowed = classes.withColumn("_till", F.sum("_sum").over(Window.partitionBy("_to").orderBy("_class"))).where("_till <= _free").select("_to", "_class")
    return want.join(F.broadcast(allowed), ["_to", "_class"]).select("_piece", "_to")


def _levelled(rows: DataFrame, shards: int, quota: int, more: int, scratch: Scratch) -> DataFrame:
    """Exact quotas: rows beyond a shard's quota, unlinked ones first, then pieces of one row, fill the shards below theirs. Adds slot."""
    # settled pieces stay, as they are within the quota; unlinked rows come last and go first
    ranked = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), "shard", ["_last", "_piece", "doc_id", "text_crc32"], "_one", scratch)
    ranked = ranked.withColumn("slot", F.col("rows_before")).drop("rows_before", "weight_before")
    load = ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("_load"))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    load = every.join(F.broadcast(load), "shard", "left").select("shard", F.coalesce("_load", F.lit(0)).alias("_load"))
    # the `more` fullest shards get a row more than the others
    place = F.row_number().over(Window.orderBy(F.desc("_load"), "shard"))  # a row a shard
    plan = scratch.table(load.withColumn("_quota", F.lit(quota) + (place <= more).cast("int")), "quotas")
    placed = ranked.join(F.broadcast(plan), "shard")
    stay = placed.where("slot < _quota")
    freed = placed.where("slot >= _quota").withColumns({"_all": F.lit(0), "_from": F.col("shard")}).drop("_load", "_quota", "slot", "shard")
    freed = running_totals(freed, "_all", ["_last", "_piece", "doc_id", "text_crc32"], "_one", scratch).withColumnRenamed("rows_before", "_at")
    gaps = plan.where("_load < _quota").select("shard", "_load", (F.col("_quota") - F.col("_load")).alias("_gap"))
    gaps = gaps.withColumn("_till", F.sum("_gap").over(Window.orderBy("shard")))
    filled = freed.join(F.broadcast(gaps), (F.col("_at") >= F.col("_till") - F.col("_gap")) & (F.col("_at") < F.col("_till")))
    filled = filled.withColumn("slot", F.col("_load") + F.col("_at") - F.col("_till") + F.col("_gap"))
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return stay.select(*names).unionByName(filled.select(*names))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard() of all documents."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
