"""Mixing against a plain sharing of targets, the properties of dependent rounding, and odd rows."""

import random
import re
from collections import defaultdict

from verbena.llm.mixing import mix_report, mixed, take_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1)):
    """Share by weight; stop those above twice their size; share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) >= 2 * sizes[s]}
        if not over:
            total = sum(w[x] for x in free)
            return out | {s: left * w[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def rows(n, seed=1):
    r = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "hot", "hot", "hot"]
    return [(i, " ".join("w" for _ in range(r.randrange(0, 80))) + r.choice(["", "\n", " \t"]), r.choice(sources)) for i in range(n)] + [(n, None, "a"), (n + 1, "x y  z\x0bq", "b"), (n + 2, "", "only empty")]


def test_targets_and_rounding(spark):
    data = rows(3000)
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix_report(d).collect()
    size = {k: len(WORD.findall(t or "")) for k, t, _ in data}
    total, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, _, s in data:
        total[s] += size[k]
        longest[s] = max(longest[s], size[k])
    want = brute_targets(total)
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        p = want[r.source] / total[r.source] if total[r.source] else 0
        assert r.size == 0 or int(p + 1e-9) <= r.copies <= min(2, -(-p // 1))
        assert r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    again = mix_report(d.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_fractions_are_unbiased(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 3 // 2]) for i in range(6000)], "doc_id long, text string, source string")
    got = mix_report(d).collect()
    for n in range(1, 10):
        some = [r for r in got if r.source == "b" and r.size == n]
        if some:
            p = some[0].target / some[0].source_size
            assert abs(sum(r.copies for r in some) / len(some) - p) < 0.1


def test_mix_takes_rows_as_often_as_reported(spark):
    data = rows(300) + [(5, "same text here", "a")] * 9 + [(None, "no key", "a"), (None, "no key", None)]
    d = spark.createDataFrame([(*x, "clash") for x in data], "doc_id long, text string, source string, mix_key string")
    out = take_mix(d)
    assert out.columns == d.columns
    report = mix_report(d)
    assert sum(r.copies for r in report.collect()) == out.count()
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in report.collect())
    same = [r for r in report.collect() if r.doc_id == 5 and r.size == 3]
    assert len(same) == 9 and max(r.copies for r in same) - min(r.copies for r in same) <= 1


def test_empty_and_small(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(d).count() == 0 and take_mix(d).count() == 0
    one = mix_report(spark.createDataFrame([(1, "a b c", "s")], d.schema)).collect()
    assert [(r.size, r.target, r.copies in (1, 2)) for r in one] == [(3, 4.5, True)]
    none = mix_report(spark.createDataFrame([(1, None, None)], d.schema)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)]
    assert mixed(d).count() == 0
