import hashlib
import random
import re
import zlib

import duckdb
import pytest

from arbora.llm import conversations as own


def brute(rows):
    """rows: (turn, role, text) in order. A plain forward search over (state, cost, audit, repaired)."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, turns) in list(now.items()):
                for c, to in step[state].items():
                    if c != "s":
                        new = (cost + 3, audit + "I", [*turns, name[c] + ":"])
                        now[to] = min(now.get(to, new), new)
        return now

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, turns) in inserted(best).items():
            options = [(state, (cost + 4, audit + "D", turns))]
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                if role[:1] in step[state]:
                    options.append((step[state][role[:1]], (cost + more, audit + "K", [*turns, f"{role}:{text}"])))
                options += [(to, (cost + 3 + more, audit + "R", [*turns, f"{name[c]}:{text}"])) for c, to in step[state].items() if c != "s"]
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        best = after
    cost, audit, turns = min(v for k, v in inserted(best).items() if k in ("", "a"))
    ts = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
    return {"gaps": gaps, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"), "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(turns).encode()).hexdigest()}


def made(seed, convs, most, roles=("user", "assistant", "user", "assistant", "system", "tool", "")):
    r = random.Random(seed)
    texts = ["Well.", "Really?", "no end", "", " \n", "Fine! ", "cut\t", "x" * 30, *(f"t{i}." for i in range(30))]
    return [(c, t if r.random() > 0.05 else None, r.choice(roles), r.choice(texts)) for c in range(convs) for t in range(r.randint(1, most))]


def sorted_rows(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, role or (" " if role is None else ""), " " if text is None else text))
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2]))) for c, x in out.items()}


def reported(df):
    return {None if r.conv_id is None else int(r.conv_id): {k: r[k] for k in own.REPORT.names[1:]} for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


@pytest.mark.parametrize("segment", [4096, 5, 1])
def test_reports_are_those_of_brute_force_whole_and_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(own, "SEGMENT", segment)
    given = made(segment, 60, 25)
    assert reported(own.report(frame(spark, given))) == {c: brute(x) for c, x in sorted_rows(given).items()}


@pytest.mark.parametrize(("rows", "batch"), [(32_768, 1_000), (10, 7), (1, 3), (25, 1)])
def test_conversations_may_lie_across_batches(spark, monkeypatch, rows, batch):
    """What a task does, here in this process, as workers don't see patched bounds."""
    given = made(batch, 30, 15)
    table = own._prepared(frame(spark, given)).sort("_key", "turn", "role", "_tie").toArrow()
    monkeypatch.setattr(own, "ROWS", rows)
    got = [r for b in own._short_report(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    wanted = {f"={c}": brute(x) for c, x in sorted_rows(given).items()}
    assert {r.pop("_key"): r for r in got} == wanted and len(got) == len(wanted)


def test_repaired_rows_give_the_report(spark, monkeypatch):
    monkeypatch.setattr(own, "SEGMENT", 12)
    given = frame(spark, made(9, 40, 30))
    edits = {}
    for r in sorted(own.repair(given).collect(), key=lambda r: (r.row, r.part)):
        edits.setdefault(int(r.conv_id), []).append(r)
    wanted = reported(own.report(given))
    for c, x in edits.items():
        assert "".join(r.edit for r in x) == wanted[c]["audit"]
        kept = [r for r in x if r.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == wanted[c]["repaired_sha256"]


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (3, None, "user", "Hm."), (3, None, "assistant", "Hm."), (4, 2, "assistant", "x."), (4, 2, "assistant", "b."), (4, 9, None, "b."), (5, 1, "system", "s.")]
    given = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, fault int")
    assert reported(own.report(given)) == {c: brute(x) for c, x in sorted_rows(rows).items()}
    assert own.report(given.limit(0)).collect() == [] == own.repair(given.limit(0)).collect()


def test_long_texts_go_in_segments(spark, monkeypatch):
    monkeypatch.setattr(own, "BYTES", 10_000)
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "long text " * 500 + ".") for t in range(9)] + [(2, 0, "user", "Hi.")]
    assert reported(own.report(frame(spark, rows))) == {c: brute(x) for c, x in sorted_rows(rows).items()}


def test_planted_damage(spark):
    rows = made(4, 30, 12) + [(None, None, None, "ends. Here!")]
    wanted = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        wanted += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = own.damaged(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got = own.op13_conversation_repair(spark, sf)
    wanted = c.execute(own.OP13_SQL)
    names = [x[0] for x in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))
