"""Conversation structure repair: cheapest edits to a grammar of roles, by dynamic programming over time-major tensors.

Roles must read `(s?(ua)+)?`: a system turn at most, then pairs of user and assistant turns. Four states say what was kept
last (nothing, a system, a user, an assistant turn). Conversations are put in buckets of like length; for all of a bucket the costs
from each state to the end are updated a turn at a time, from the last to the first, and kept; then all are traced a turn at a
time from the first, taking of the edits on a cheapest way the one whose letter is least.

A conversation of many rows or bytes is cut in segments. Each segment gives its least costs between states, which are added up
from the last segment backward; from the costs behind it a segment gives the state it leaves for each that it may be entered
in, which are followed from the first; then its edits are traced like those of a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import CRC_SQL, Scratch, crc32_sql, field, mapped, running_totals, small_batches

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows of a segment; a conversation of more rows or bytes is cut.
SEGMENT, BYTES = 4096, 4 << 20
#: Rows and bytes that a task repairs at once.
ROWS, HELD = 32_768, 8 << 20
#: More than any cost.
NEVER = 1 << 60

#: States: nothing kept, system, user, assistant. The state after an inserted or re-roled turn, and after a kept one of kind s, u, a or other (-1: not allowed).
PUT = np.array([2, 2, 3, 2])
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Costs of ending in a state: a user turn lacks an assistant's, a system turn both.
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
ROLES = {2: "user", 3: "assistant"}
FAULTS = [None, "blank", "duplicate", "truncated"]
#: Blank is no `[^\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def backward(kinds: np.ndarray, faults: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """costs[t, i, state]: the least from before turn t of conversation i to its end. kinds, faults: turn by conversation; ends: conversation by state."""
    turns, n = kinds.shape
    costs = np.empty((turns + 1, n, 4), dtype=np.int64)
    costs[turns] = ends
    lanes = np.arange(n)[:, None]
    for t in reversed(range(turns)):
        later, to = costs[t + 1], KEPT[kinds[t]]
        gone, more = ((faults[t] == 1) | (faults[t] == 2))[:, None], np.where(faults[t] == 3, TRUNCATED, 0)[:, None]
        kept = np.where(gone | (to < 0), NEVER, later[lanes, to] + more)
        put = np.where(gone, NEVER, later[:, PUT] + more + REROLE)
        now = np.minimum(np.minimum(later + DELETE, kept), put)
        now = np.minimum(now, np.minimum(now[:, PUT] + INSERT, now[:, PUT[PUT]] + 2 * INSERT))
        costs[t] = np.where((t < lengths)[:, None], now, later)
    return costs


def traced(costs: np.ndarray, kinds: np.ndarray, faults: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turn by conversation: inserts before a turn, the state before them, the turn's edit (D, K or R); and each conversation's last state."""
    turns, n = kinds.shape
    before, states, edits = np.zeros((turns, n), dtype=np.int8), np.zeros((turns, n), dtype=np.int8), np.zeros((turns, n), dtype="S1")
    lane, state = np.arange(n), state.copy()
    for t in range(turns):
        states[t] = state
        here = t < lengths
        gone, more = (faults[t] == 1) | (faults[t] == 2), np.where(faults[t] == 3, TRUNCATED, 0)
        while here.any():
            left, later, to = costs[t][lane, state], costs[t + 1], KEPT[kinds[t], state]
            delete = here & (later[lane, state] + DELETE == left)
            insert = here & ~delete & (costs[t][lane, PUT[state]] + INSERT == left)
            keep = here & ~delete & ~insert & ~gone & (to >= 0) & (later[lane, to] + more == left)
            put = here & ~delete & ~insert & ~keep
            edits[t][delete], edits[t][keep], edits[t][put] = b"D", b"K", b"R"
            before[t] += insert
            state = np.where(keep, to, np.where(insert | put, PUT[state], state))
            here = insert
    return before, states, edits, state


def tensors(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of like length (by powers of two): the conversations, each turn's place in the rows, and where there is a turn."""
    starts, size = np.cumsum(lengths) - lengths, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for x in np.unique(size):
        some = np.flatnonzero(size == x)
        turns = np.arange(lengths[some].max())[:, None]
        there = turns < lengths[some]
        yield some, np.where(there, starts[some] + turns, 0), there


def edits_of(kinds: np.ndarray, faults: np.ndarray, lengths: np.ndarray, ends: np.ndarray, state: np.ndarray) -> dict[str, np.ndarray]:
    """Of each row its inserts before, the state before them and its edit; of each conversation its last state."""
    out = {"before": np.zeros(len(kinds), np.int8), "state": np.zeros(len(kinds), np.int8), "edit": np.zeros(len(kinds), "S1"), "last": np.zeros(len(lengths), np.int64)}
    for some, at, there in tensors(lengths):
        k, f = kinds[at], faults[at]
        before, states, edits, out["last"][some] = traced(backward(k, f, lengths[some], ends[some]), k, f, lengths[some], state[some])
        out["before"][at[there]], out["state"][at[there]], out["edit"][at[there]] = before[there], states[there], edits[there]
    return out


#: A row for each edit: row is the turn's place in its conversation, part the order among edits at that place; role and text are those after the edit, was the role before.
EDITS = T.StructType([field("_key", T.StringType()), field("conv_id", T.StringType()), field("row", T.LongType()), field("part", T.IntegerType()), field("edit", T.StringType()), field("turn", T.LongType()), field("was", T.StringType()), field("role", T.StringType()), field("text", T.StringType()), field("fault", T.StringType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def edit_rows(rows: pa.Table, after: np.ndarray) -> pa.Table:
    """EDITS of rows with _key, conv_id, row, turn, kind, fault, role, text, before, state, edit; after: inserts that end a conversation, at its last row."""
    take, part, letter, role = [], [], [], []
    for i, (kind, own, before, state, edit, end) in enumerate(zip(rows["kind"].to_pylist(), rows["role"].to_pylist(), rows["before"].to_pylist(), rows["state"].to_pylist(), rows["edit"].to_pylist(), after.tolist(), strict=True)):
        for j in range(before):
            state = int(PUT[state])
            take.append(-1 - i), part.append(j), letter.append("I"), role.append(ROLES[state])
        state = state if edit == "D" else int(PUT[state] if edit == "R" else KEPT[kind, state])
        take.append(i), part.append(before), letter.append(edit), role.append(ROLES[state] if edit == "R" else own)
        for j in range(end):
            state = int(PUT[state])
            take.append(-1 - i), part.append(before + 1 + j), letter.append("I"), role.append(ROLES[state])
    at = np.array(take, dtype=np.int64)
    row, new = np.where(at < 0, -1 - at, at), at < 0
    of = lambda name: rows[name].take(pa.array(row))
    real = lambda name: rows[name].take(pa.array(row, mask=new))  # noqa: E731  null for inserted rows
    text = pc.if_else(pa.array(new), "", of("text"))
    fault = pa.array(FAULTS, pa.string()).take(pc.cast(real("fault"), pa.int32()).combine_chunks())
    return pa.table([of("_key"), of("conv_id"), of("row"), pa.array(part, pa.int32()), pa.array(letter, pa.string()), real("turn"), real("role"), pa.array(role, pa.string()), text, fault], schema=_arrow(EDITS))


REPORT = T.StructType([field("_key", T.StringType()), *(field(x, T.LongType()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), field("audit", T.StringType()), field("repaired_sha256", T.StringType())])


class Report:
    """Sums up conversations from their edits in order, one row at a time; of a conversation it holds the sums, a hash and the edits' letters."""

    def __init__(self):
        self.key: str | None = None

    def begin(self, key: str) -> None:
        self.key, self.counts, self.letters, self.hash = key, dict.fromkeys(REPORT.names[1:7], 0), bytearray(), hashlib.sha256()
        self.initial, self.least, self.turn, self.turns, self.some = None, None, None, 0, False

    def end(self) -> list:
        if self.turns:
            self.counts["gaps"] = self.turn - self.least + 1 - self.turns
        return [self.key, *self.counts.values(), self.letters.decode(), self.hash.hexdigest()]

    def feed(self, rows: pa.Table) -> list[list]:
        """The conversations that have ended before the last of these rows."""
        done = []
        columns = (rows[x].to_pylist() for x in ("_key", "edit", "turn", "was", "role", "text", "fault"))
        for key, edit, turn, was, role, text, fault in zip(*columns, strict=True):
            if key != self.key:
                if self.key is not None:
                    done.append(self.end())
                self.begin(key)
            counts = self.counts
            self.letters += edit.encode()
            if edit != "I":
                if turn is not None and turn != self.turn:
                    self.least, self.turn, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
                if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                self.initial = was[:1]
                if fault:
                    counts[fault] += 1
            counts["cost"] += DELETE if edit == "D" else (0 if edit == "K" else INSERT if edit == "I" else REROLE) + (TRUNCATED if fault == "truncated" else 0)
            if edit != "D":
                self.hash.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode())
                self.some = True
        return done

    def last(self) -> list[list]:
        return [] if self.key is None else [self.end()]


def _starts(rows: pa.Table, *names: str) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for x in names:
        column = rows[x].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Sorted batches in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < ROWS and sum(x.nbytes for x in held) < HELD:
            continue
        rows = pa.Table.from_batches(held)
        if cut := int(_starts(rows, *names)[-1]):
            yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _repaired(rows: pa.Table) -> pa.Table:
    """EDITS of whole conversations; repeated turns are found here."""
    starts = _starts(rows, "_key")
    lengths = np.diff(np.append(starts, rows.num_rows))
    code = lambda x: rows[x].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    same = np.stack([np.repeat(np.arange(len(starts)), lengths), code("role"), code("text")], axis=1)
    first = np.zeros(rows.num_rows, dtype=bool)
    first[np.unique(same, axis=0, return_index=True)[1]] = True
    kinds, faults = rows["kind"].to_numpy().astype(np.int64), rows["fault"].to_numpy().astype(np.int64)
    faults = np.where(~first & (faults != 1), 2, faults)
    found = edits_of(kinds, faults, lengths, np.tile(ENDS, (len(starts), 1)), np.zeros(len(starts), dtype=np.int64))
    after = np.zeros(rows.num_rows, dtype=np.int64)
    after[starts + lengths - 1] = ENDS[found["last"]] // INSERT
    row = np.arange(rows.num_rows) - np.repeat(starts, lengths)
    rows = rows.set_column(rows.schema.get_field_index("fault"), "fault", pa.array(faults))
    for name, values in (("row", pa.array(row)), ("before", pa.array(found["before"])), ("state", pa.array(found["state"])), ("edit", pa.array(found["edit"].astype(str).tolist(), pa.string()))):
        rows = rows.append_column(name, values)
    return edit_rows(rows, after)


def _as_rows(done: list[list], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=_arrow(schema))


def _reported(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    report = Report()
    for table in tables:
        yield from _as_rows(report.feed(table), REPORT)
    yield from _as_rows(report.last(), REPORT)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_groups(batches, "_key"):
        yield from _repaired(rows).to_batches()


def _short_report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _reported(_repaired(rows) for rows in _whole_groups(batches, "_key"))


def _segments(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts = _starts(rows, "_key", "segment")
    return starts, np.diff(np.append(starts, rows.num_rows)), rows["kind"].to_numpy().astype(np.int64), rows["fault"].to_numpy().astype(np.int64)


PASSES = {
    "costs": T.StructType([field("_key", T.StringType()), field("segment", T.LongType()), field("costs", T.ArrayType(T.LongType()))]),
    "exits": T.StructType([field("_key", T.StringType()), field("segment", T.LongType()), field("exits", T.ArrayType(T.LongType()))]),
    "edits": T.StructType([field("_key", T.StringType()), field("row", T.LongType()), field("before", T.IntegerType()), field("state", T.IntegerType()), field("edit", T.StringType()), field("after", T.IntegerType())]),
}


def _pass(step: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over segments: costs (from each state to each), exits (the state left for each entered) or edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(PASSES[step])
        for rows in _whole_groups(batches, "_key", "segment"):
            starts, lengths, kinds, faults = _segments(rows)
            n, own = len(starts), pa.array(starts)
            head = [rows[x].take(own) for x in ("_key", "segment")]
            if step == "costs":
                out = np.empty((n, 4, 4), dtype=np.int64)
                for to in range(4):
                    ends = np.full((n, 4), NEVER)
                    ends[:, to] = 0
                    for some, at, _ in tensors(lengths):
                        out[some, :, to] = backward(kinds[at], faults[at], lengths[some], ends[some])[0]
                yield from pa.table([*head, pa.array(np.minimum(out, NEVER).reshape(n, 16).tolist())], schema=schema).to_batches()
                continue
            ends = np.array(rows["ends"].take(own).to_pylist(), dtype=np.int64)
            if step == "exits":
                left = np.stack([edits_of(kinds, faults, lengths, ends, np.full(n, x))["last"] for x in range(4)], axis=1)
                yield from pa.table([*head, pa.array(left.tolist())], schema=schema).to_batches()
                continue
            found = edits_of(kinds, faults, lengths, ends, rows["start"].take(own).to_numpy().astype(np.int64))
            after = np.zeros(rows.num_rows, dtype=np.int32)
            after[starts + lengths - 1] = np.where(rows["final"].take(own).to_numpy(zero_copy_only=False), ENDS[found["last"]] // INSERT, 0)
            yield from pa.table([rows["_key"], rows["row"], pa.array(found["before"].astype(np.int32)), pa.array(found["state"].astype(np.int32)), pa.array(found["edit"].astype(str).tolist(), pa.string()), pa.array(after)], schema=schema).to_batches()

    return run


def _costs_behind(segments: pa.Table) -> pa.Table:
    """Of a conversation's segments the least costs from each state behind them to the end."""
    order = np.argsort(segments["segment"].to_numpy())
    behind, out = ENDS.astype(np.int64), [None] * len(order)
    costs = np.array(segments["costs"].to_pylist(), dtype=np.int64).reshape(-1, 4, 4)
    for i in reversed(order):
        out[i] = behind.tolist()
        behind = np.minimum((costs[i] + behind).min(axis=1), NEVER)
    return pa.table([segments["_key"], segments["segment"], pa.array(out, pa.list_(pa.int64())), pa.array(segments["segment"].to_numpy() == segments["segment"].to_numpy().max())], names=["_key", "segment", "ends", "final"])


def _states_before(segments: pa.Table) -> pa.Table:
    """Of a conversation's segments the state in which they are entered."""
    exits, state, out = segments["exits"].to_pylist(), 0, [0] * segments.num_rows
    for i in np.argsort(segments["segment"].to_numpy()):
        out[i], state = state, exits[i][state]
    return pa.table([segments["_key"], segments["segment"], pa.array(out, pa.int64())], names=["_key", "segment", "start"])


def _long(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """EDITS of conversations that don't fit a task: rows are numbered, and only kinds and faults go through the passes."""
    numbered = running_totals(rows.withColumn("_one", F.lit(1)), "_key", ["turn", "role", "_tie"], "_one", scratch).drop("_one", "weight_before").withColumnRenamed("rows_before", "row")
    numbered = scratch.table(numbered, "numbered")
    repeated = numbered.groupBy("_key", "role", "_tie").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    fault = F.when((F.col("row") > F.col("_first")) & (F.col("fault") != 1), 2).otherwise(F.col("fault"))
    narrow = numbered.select("_key", "role", "_tie", "row", "kind", "fault").join(repeated, ["_key", "role", "_tie"], "left")
    narrow = scratch.table(narrow.select("_key", F.expr(f"row div {SEGMENT}").alias("segment"), "row", "kind", fault.alias("fault")), "narrow")
    run = lambda df, step: scratch.table(mapped(df.repartition("_key", "segment").sortWithinPartitions("_key", "segment", "row"), _pass(step), PASSES[step]), step)
    ends = scratch.table(run(narrow, "costs").groupBy("_key").applyInArrow(_costs_behind, "_key string, segment long, ends array<long>, final boolean"), "ends")
    entered = narrow.join(ends, ["_key", "segment"])
    begun = run(entered, "exits").groupBy("_key").applyInArrow(_states_before, "_key string, segment long, start long")
    edits = run(entered.join(scratch.table(begun, "begun"), ["_key", "segment"]), "edits").join(narrow.select("_key", "row", F.col("fault").alias("_fault")), ["_key", "row"])

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from edit_rows(pa.Table.from_batches([batch]), batch.column("after").to_numpy()).to_batches()

    joined = numbered.drop("fault").join(edits, ["_key", "row"]).withColumnRenamed("_fault", "fault")
    return mapped(joined.select("_key", "conv_id", "row", "turn", "kind", "fault", "role", "text", "before", "state", "edit", "after"), expanded, EDITS)


def _prepared(conversations: DataFrame) -> DataFrame:
    """Rows with their conversation's key, kind (s, u, a or other), fault (1 blank, 3 truncated, else 0) and order among equal turns."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    conv = F.col("conv_id").cast("string")
    rows = conversations.select(F.coalesce(F.concat(F.lit("="), conv), F.lit("")).alias("_key"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    core = F.rtrim("text", F.lit(SPACES))
    last = F.expr("right(_core, 1)")
    return (
        rows.withColumn("_core", core)
        .withColumn("kind", F.coalesce(*[F.when(F.substring("role", 1, 1) == c, F.lit(i)) for i, c in enumerate("sua")], F.lit(3)))
        .withColumn("fault", F.when(F.col("_core") == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3))
        .drop("_core")
        .withColumn("_tie", F.md5("text"))
    )


def _parts(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations that fit a task, sorted, and the others."""
    sums = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("text").cast("long")).alias("_b"))
    large = scratch.table(sums.where((F.col("_n") > SEGMENT) | (F.col("_b") > BYTES)).select("_key"), "large")
    if large.isEmpty():
        small, rest = rows, rows.limit(0)
    else:
        small, rest = rows.join(large, "_key", "left_anti"), rows.join(large, "_key", "left_semi")
    return small.repartition("_key").sortWithinPartitions("_key", "turn", "role", "_tie"), rest


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation roles `(s?(ua)+)?`, a row for each edit, in the order of row and part.

    conversations: conv_id, turn, role, text, read by turn (null first; equal turns by role and a digest of the text). Columns:
    conv_id (as text), row, part, edit (K keep, R re-role, D delete, I insert), turn, was (role before), role and text after the
    edit, fault (blank, duplicate or truncated). Costs: keep 0, re-role 3, delete 4, insert an empty turn 3, and 3 more for a
    truncated turn that stays; blank and duplicate turns must go. Of equal costs the letters that sort first are taken. The
    repaired conversation is the rows whose edit isn't D. A null role or text is one space, a null conv_id is a conversation of its own,
    repeated rows are duplicates, other columns are ignored, and an empty table gives no rows.
    """
    small_batches(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession, "repair")
    small, rest = _parts(_prepared(conversations), scratch)
    out = mapped(small, _short, EDITS)
    return (out if rest.isEmpty() else out.unionByName(_long(rest, scratch))).drop("_key")


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation that has rows: gaps among turns, counts of faults and of illegal neighbours, cost, audit, repaired_sha256.

    As repair(), summed up where a conversation's edits are found. The hash of a conversation is taken in order, so one task
    streams over the edits of each, however long; it holds a batch and a letter for each edit. conv_id is text here.
    """
    small_batches(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession, "repair")
    small, rest = _parts(_prepared(conversations), scratch)
    out = mapped(small, _short_report, REPORT)
    if not rest.isEmpty():
        edits = scratch.table(_long(rest, scratch), "edits").repartition("_key").sortWithinPartitions("_key", "row", "part")
        out = out.unionByName(mapped(edits, lambda batches: _reported(pa.Table.from_batches([x]) for x in batches if x.num_rows), REPORT))
    return out.withColumn("conv_id", F.when(F.col("_key") != "", F.expr("substring(_key, 2)"))).drop("_key")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the crc32 of `conv_id:turn` (nulls: one space) modulo 20: 0 dropped, 1 emptied, 2 without `[.!?]`, 3 twice, 4 of role user."""
    null = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), null), F.lit(":"), F.coalesce(F.col("turn").cast("string"), null))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", null).alias("role"), F.coalesce("text", null).alias("text"), (F.crc32(key) % 20).alias("_h")).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_h") == 4, "user").otherwise(F.col("role")), "_twice": F.explode(F.expr("sequence(1, if(_h = 3, 2, 1))"))})
    return rows.drop("_h", "_twice")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of all conversations after damage; those without rows left have zeros, no edits and the hash of nothing."""
    given = spark.read.parquet(str(sf_dir) + "/conversations.parquet")
    found = report(damaged(given)).withColumnRenamed("conv_id", "_conv")
    every = given.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return joined.fillna(0, REPORT.names[1:7]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def _sql() -> str:
    """The same search in SQL, from the first turn forward: of each state the least cost, letters and turns so far."""
    add = lambda x, cost, letter, turn="": "{'c': " + f"{x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {x}.r" + (f" || {turn}" if turn else "") + "}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    cond = lambda x, test: f"case when {test} then {x} else " + "{'c': 1000000000, 'a': '', 'r': ''} end"
    put = {2: "chr(10) || 'user:'", 3: "chr(10) || 'assistant:'"}
    into2 = lambda *x: [add(v, 3, "I", put[2]) for v in x]
    stays, own = "d.fault in (0, 3)", "chr(10) || d.role || ':' || d.text"
    more = "if(d.fault = 3, 3, 0)"
    keep = lambda x, kind: cond(add(x, more, "K", own), f"{stays} and d.kind = '{kind}'")
    rerole = lambda x, to: cond(add(x, f"3 + {more}", "R", put[to] + " || d.text"), stays)
    gone = lambda x: add(x, 4, "D")
    never, none = "{'c': 1000000000, 'a': '', 'r': ''}", "{'c': 0, 'a': '', 'r': ''}"
    return rf"""
with recursive {CRC_SQL},
given as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {crc32_sql("s")} % 20 h
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') s from conversations), crc),
damaged as (select conv_id, turn, if(h = 4, 'user', role) role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text, unnest(range(if(h = 3, 2, 1))) copy from given where h <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) core from damaged),
d as (select *, left(role, 1) kind, case when core = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(core, 1) not in ('.', '!', '?') then 3 else 0 end fault from ordered),
search(conv_id, i, s0, s1, s2, s3) as (
  select distinct conv_id, 0::bigint, {none}, {never}, {never}, {never} from d
  union all
  select conv_id, i, {gone("b0")}, {least(gone("b1"), keep("b0", "s"))}, {least(gone("b2"), *[f(x, y) for x in ("b0", "b1", "b3") for f, y in ((keep, "u"), (rerole, 2))])}, {least(gone("b3"), keep("b2", "a"), rerole("b2", 3))}
  from (select conv_id, i, d, a0 b0, a1 b1, {least("a2", *into2("a3"))} b2, {least("a3", add("a2", 3, "I", put[3]))} b3
    from (select s.conv_id, d.i, d, s0 a0, s1 a1, {least("s2", *into2("s0", "s1", "s3"))} a2, {least("s3", add("s2", 3, "I", put[3]))} a3 from search s join d on d.conv_id is not distinct from s.conv_id and d.i = s.i + 1))),
ends as (select conv_id, {least("s0", "s3", add("s2", 3, "I", put[3]), add("s1", 6, "II", f"{put[2]} || {put[3]}"))} best from search qualify row_number() over (partition by conv_id order by i desc) = 1),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 1) blank, count(*) filter (fault = 2) duplicate, count(*) filter (fault = 3) truncated,
  count(*) filter (before || kind not in ('su', 'ua', 'au')) illegal from (select *, lag(kind) over (partition by conv_id order by i) before from d) group by conv_id)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') audit, sha256(coalesce(substr(best.r, 2), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join counts on counts.conv_id is not distinct from c.conv_id left join ends on ends.conv_id is not distinct from c.conv_id
"""


OP13_SQL = _sql()

__all__ = ["repair", "report", "damaged", "edits_of", "backward", "traced"]
