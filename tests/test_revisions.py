"""Blame from revisions against generated histories whose authors are known."""

import random

import numpy as np
import pytest

from arbora.operators import revisions


def test_alignment_is_in_order_and_of_equal_lines():
    r = random.Random(1)
    for _ in range(300):
        old, new = (np.array([r.randint(0, 6) for _ in range(r.randint(0, 12))]) for _ in range(2))
        m = revisions.aligned(old, new)
        kept = m[m >= 0]
        assert (np.diff(kept) > 0).all() and (old[kept] == new[m >= 0]).all()
    assert revisions.aligned(np.arange(9), np.arange(9)).tolist() == list(range(9))
    assert revisions.aligned(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 2, 4, 8])).tolist().count(-1) == 3
    assert revisions.rising([3, 1, 2, 9, 5, 6]) == [1, 2, 4, 5]


def test_short_and_long_revisions_align_alike(monkeypatch):
    r = random.Random(4)
    cases = [[np.array([r.randint(0, most) for _ in range(r.randint(0, 30))], dtype=np.int64) for _ in range(2)] for most in (4, 30, 200) for _ in range(300)]
    short = [revisions.aligned_lists(old.tolist(), new.tolist()) for old, new in cases]
    monkeypatch.setattr(revisions, "FEW", -1)
    assert short == [revisions.aligned(old, new).tolist() for old, new in cases]


@pytest.mark.parametrize("seed", [1, 2])
def test_blame_of_generated_histories(spark, seed):
    """Each line is new text, so its author is the revision that wrote it; lines are put in, changed and taken away anywhere."""
    r, rows, wanted = random.Random(seed), [], {}
    for path in ("/a", "/b", "/c/d"):
        lines = []
        for rev in range(1, r.randint(3, 12)):
            for _ in range(r.randint(0, 5)):
                at = r.randint(0, len(lines))
                kind = r.random()
                new = [(f"{path} {rev} {r.random()}", rev)]
                lines[at : at + (0 if kind < 0.6 else 1)] = new if kind < 0.8 else []
            rows.append((path, rev * 10, f"u{rev % 3}", None, None, "\n".join(x for x, _ in lines) + "\n" * r.randint(0, 1 if lines else 0), 1))
        wanted |= {(path, i): (f"u{rev % 3}", rev * 10, text) for i, (text, rev) in enumerate(lines, 1)}
    rows += [(None, 1, "x", None, None, "lost", 1), ("/a", None, "x", None, None, "lost", 1), ("/gone", 1, "x", None, None, "was here", 1), ("/gone", 2, "y", None, None, None, 1)]
    frame = spark.createDataFrame(rows, "path string, rev int, author string, email string, when timestamp, text string, n int").repartition(4)
    got = revisions.blamed(frame)
    assert {(x.path, x.line): (x.author, x.rev, x.text) for x in got.collect()} == wanted
    assert revisions.blamed(frame.limit(0)).collect() == []


def test_a_file_that_comes_back_and_repeated_lines(spark):
    rows = [("/f", 1, "a", "x\nx\ny"), ("/f", 2, "b", ""), ("/f", 3, "c", "x\nx\ny"), ("/g", 1, "a", "x\nx\nz"), ("/g", 2, "b", "x\nx\nx\nz"), ("/g", 2, "b", "old")]
    frame = spark.createDataFrame([(*x[:3], None, None, x[3]) for x in rows], "path string, rev long, author string, email string, when timestamp, text string")
    got = sorted((x.path, x.line, x.author) for x in revisions.blamed(frame).collect())
    assert got == [("/f", 1, "c"), ("/f", 2, "c"), ("/f", 3, "c"), ("/g", 1, "a"), ("/g", 2, "a"), ("/g", 3, "b"), ("/g", 4, "a")]
