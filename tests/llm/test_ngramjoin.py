"""The n-gram join against all pairs, with chains, copies, big groups and odd rows."""

import random
import re

import pytest

from verbena.llm.classes import components
from verbena.llm.common import dealt_join
from verbena.llm.ngramjoin import JoinParams, keep_one, least_matches, near_classes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, k=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and shared >= t * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for p in r.sample(range(len(w)), n):
            w[p] = r.choice(vocabulary)
        return w

    out = [text(r.randrange(3, 200)) for _ in range(60)]
    for n in (1, 2, 3, 4, 5, 6, 8):
        base = text(150)
        out += [base, *(edited(base, n) for _ in range(6))]
    chain = text(160)
    for _ in range(15):
        out.append(chain)
        chain = edited(chain, 3)
    passage = text(60)
    out += [text(70) + passage + text(40) for _ in range(40)]
    big = text(150)
    out += [edited(big, r.randrange(1, 4)) for _ in range(120)]
    rows = [" ".join(x) for x in out]
    rows += [rows[5]] * 7 + ["Same but  for, punctuation here five", "same BUT for punctuation here five!", "one two", "One two!", "three", "", " ,.", "long " * 3000]
    r.shuffle(rows)
    return [(i * 3 + 1, x) for i, x in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # almost every key is hot
        monkeypatch.setattr("verbena.llm.common.LEAST_HOT", 3)
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_classes(d).collect()}
    want = brute_classes(rows)
    assert {k: r.class_id for k, r in got.items()} == want
    different = {frozenset(grams(x)) for _, x in rows if grams(x)}
    near = lambda a, b: a != b and len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = {a: sum(near(a, b) for b in different) for a in different}
    assert {k: got[k].n_links for k, _ in rows} == {k: links.get(frozenset(grams(x)), 0) for k, x in rows} and max(links.values()) > 20
    if seed == 1:
        small = near_classes(d, params=JoinParams(block=7)).collect()  # classes of many blocks
        assert {r.doc_id: r.n_links for r in small} == {k: r.n_links for k, r in got.items()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, None, 0), (3, "", 0), (None, long, 0), (4, long + " end", 0), (2, None, 1)], "doc_id long, text string, class_id int")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near_classes(d).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "2"), ("2", "2"), ("3", "3"), ("4", "1"), ("None", "1")]
    kept = keep_one(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "3"]
    assert near_classes(d.limit(0)).count() == 0


def test_keys_play_no_part_in_what_stays(spark):
    text = lambda s, n=40: " ".join(f"{s}{i}" for i in range(n))
    rows = [
        (1, text("a"), "x"), (1, text("b"), "x"), (1, text("b") + " end", "y"),  # unrelated texts under one key, and a near copy under it
        (None, text("c"), "x"), (None, text("c"), "y"), (None, text("d"), "x"),  # copies under null keys
        (7, text("c"), "x"), (8, text("e"), "b"), (8, text("e"), "a"), (8, text("e"), None),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, r1 string")
    got = sorted(((r.doc_id, r.text[0], r.r1) for r in keep_one(d).collect()), key=str)
    assert [x for x in got if x[1] not in "b"] == [(1, "a", "x"), (7, "c", "x"), (8, "e", None), (None, "d", "x")]
    assert len([x for x in got if x[1] == "b"]) == 1
    named = spark.createDataFrame([(f"k{k}", t, r) for k, t, r in rows], "doc_id string, text string, r1 string")
    assert sorted(r.text[0] for r in keep_one(named).collect()) == list("abcde")
    assert {(r.doc_id, r.class_id) for r in near_classes(named).collect()} == {("k1", "k1"), ("kNone", "k7"), ("kNone", "kNone"), ("k7", "k7"), ("k8", "k8")}


def test_hot_keys_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr("verbena.llm.common.LEAST_HOT", 3)
    left = [(i % 5 if i % 2 else 1, i) for i in range(200)] + [(99, 1)]
    right = [(k, f"v{k}") for k in range(6)]
    a, b = spark.createDataFrame(left, "k long, x long"), spark.createDataFrame(right, "k long, v string")
    want = sorted((k, x, dict(right).get(k)) for k, x in left if k in dict(right))
    assert sorted(map(tuple, dealt_join(a, b, "k", len(left)).collect())) == want
    assert dealt_join(a, b, "k", len(left), "left").count() == len(left)


def test_pruning_keeps_what_may_reach_the_threshold():
    floors = least_matches(JoinParams())
    assert floors == sorted(floors) and 0 < floors[-1] < 0.8 * 240
    assert least_matches(JoinParams(tolerance=0.2))[-1] > floors[-1]


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    ids = list(range(200))
    r.shuffle(ids)
    chain = list(zip(ids[:100], ids[1:100], strict=False))
    star = [(ids[150], x) for x in ids[151:]]
    rows = chain + star + [(5000, 5000)]
    got = {x.node: x.label for x in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: min(ids[:100]) for x in ids[:100]} | {x: min(ids[150:]) for x in ids[150:]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
