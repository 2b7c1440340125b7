"""Many terms in texts: the automaton against the plain tests, blocks of terms, and time that doesn't follow the number of terms."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from verbena.operators import catalogues, relevance, termscan


def made(n_terms, n_texts, seed=2):
    r = random.Random(seed)
    letters = "abcdefgh"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(2, 10)))
    kinds = ["name", "iso_code", "alternate_name", "place", "variety"]
    terms = [(i, " ".join(word() for _ in range(r.randrange(1, 3))), r.choice(kinds), r.randrange(1, 9) / 10) for i in range(n_terms)]
    texts = [(i, " ".join([word() for _ in range(20)] + [r.choice(terms)[1] for _ in range(3)]), "x" + r.choice(terms)[1] + "y") for i in range(n_texts)]
    return terms, texts


def test_automaton_and_constants_agree(spark, monkeypatch):
    terms, texts = made(150, 200)
    t = spark.createDataFrame(terms, "seq int, term string, kind string, weight double")
    files = spark.createDataFrame(texts + [(900, None, None), (901, "", "")], "file_id long, name string, folder string")
    bodies = files.select("file_id", F.concat_ws(" ", "name", "folder").alias("text"))
    shown = lambda d: sorted(map(tuple, d.collect()), key=repr)
    few = shown(relevance.detection(files, t)), shown(catalogues.content_detection(bodies, t, most=None))
    monkeypatch.setattr(relevance, "FEW_TERMS", 10)
    assert (shown(relevance.detection(files, t)), shown(catalogues.content_detection(bodies, t, most=None))) == few
    monkeypatch.setattr(termscan, "BLOCK", 40)  # several automata
    assert (shown(relevance.detection(files, t)), shown(catalogues.content_detection(bodies, t, most=None))) == few
    assert len(few[0]) > 100


def test_time_follows_texts_not_terms():
    terms, texts = made(100_000, 300)
    blobs = [n for _, n, _ in texts] * 3
    small, large = termscan.automaton([t for _, t, _, _ in terms[:1000]]), termscan.automaton([t for _, t, _, _ in terms])

    def took(a):
        start = time.process_time()
        for b in blobs:
            termscan.found(a, b)
        return time.process_time() - start

    took(large)
    assert took(large) < 30 * took(small)  # a hundred times the terms; most of the rest is their hits
    exact = {t for _, t, _, _ in terms}
    for b in blobs[:20]:
        words = b.split(" ")
        runs = {" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words))}
        assert {t for t, whole in termscan.found(large, b).items() if whole} == exact & runs


def test_no_terms(spark):
    d = spark.createDataFrame([(1, "a")], "k int, t string")
    assert termscan.term_hits(d, "k", ["t"], spark.createDataFrame([("",)], "folded string")).count() == 0
