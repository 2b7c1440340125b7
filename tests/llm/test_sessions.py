"""Late session merging against a replay of every batch of every user."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from verbena.llm.sessions import session_versions

FIELDS = "user long, second long, batch long, value long"


def replayed(events, gap):
    by_user = defaultdict(list)
    for u, t, b, v in events:
        if None not in (u, t, b):
            by_user[u].append((t, b, v or 0))
    rows = []
    for u, own in by_user.items():
        standing = []
        for b in sorted({x[1] for x in own}):
            islands = []
            for t, at, v in sorted(x for x in own if x[1] <= b):
                if islands and t - islands[-1][1] <= gap:
                    i = islands[-1]
                    islands[-1] = [i[0], t, i[2] + 1, i[3] + (at == b), i[4] + v]
                else:
                    islands.append([t, t, 1, int(at == b), v])
            for s, e, n, new, h in islands:
                if new:
                    old = [x for x in standing if s <= x[2] and x[3] <= e]
                    for x in old:
                        x[8:] = [b, s]
                        standing.remove(x)
                    standing.append([u, b, s, e, n, new, len(old), h, None, None])
                    rows.append(standing[-1])
    return sorted((tuple(r) for r in rows), key=repr)


def found(spark, events, gap, **how):
    return sorted((tuple(r) for r in session_versions(spark.createDataFrame(events, FIELDS), gap=gap, **how).collect()), key=repr)


@pytest.mark.parametrize(("seed", "width", "epoch"), [(1, 2, 2), (2, 4, 3), (3, 32, 64)])
def test_versions_equal_a_replay(spark, seed, width, epoch, monkeypatch):
    from verbena.llm import sessions

    monkeypatch.setattr(sessions, "BLOCK", 2)
    rnd = random.Random(seed)
    events = []
    for u in range(6):
        span, late = rnd.choice([20, 300, 1200]), rnd.choice([1, 4, 40])
        for _ in range(rnd.choice([1, 60, 250])):
            t = rnd.randrange(-30, span)
            events.append((u, t, t // 5 + rnd.randrange(late), rnd.randrange(100)))
    assert found(spark, events, 5, width=width, epoch=epoch) == replayed(events, 5)


def test_one_session_over_many_shards_is_merged_by_a_late_event(spark):
    """Two long islands, and an event in the last batch that joins them."""
    events = [(1, t, t // 10, 1) for t in range(0, 400, 5) if t != 200] + [(1, 200, 99, 7)]
    rows = found(spark, events, 5, width=2, epoch=4)
    assert rows == replayed(events, 5)
    last = next(r for r in rows if r[1] == 99)
    assert last[2:8] == (0, 395, 80, 1, 2, 86)


def test_odd_events(spark):
    """Nulls are no events, repeated rows are events of their own, equal seconds of several batches follow each other."""
    events = [(1, 5, 1, 3), (1, 5, 1, 3), (1, 5, 2, None), (None, 5, 1, 1), (1, None, 1, 1), (1, 6, None, 1), (2, 7, 0, 2**40)]
    assert found(spark, events, 600) == replayed(events, 600)
    assert found(spark, [], 600) == []


def test_other_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(1, 5, 1, 3, "x", "y", 1), (1, 700, 1, 3, "", None, 2)], "u long, t long, bt long, v long, user string, cell string, n long")
    rows = [tuple(r) for r in session_versions(df, "u", "t", "bt", "v").orderBy("start_s").collect()]
    assert rows == [(1, 1, 5, 5, 1, 1, 0, 3, None, None), (1, 1, 700, 700, 1, 1, 0, 3, None, None)]
