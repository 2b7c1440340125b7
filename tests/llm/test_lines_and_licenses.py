"""Line dedup and license scans against brute force, and odd rows."""

import math
import random
import re

import pytest

from verbena.llm.licenses import PHRASES, TEMPLATES, _template_words, scan_licenses
from verbena.llm.linededup import dedup_lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_dedup(rows):
    """rows: (key, text) with keys unique."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[key] = (0, 0, None)
            continue
        lines = text.split("\n")
        solid = [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        n = min(3, len(solid))
        for p in range(len(solid) - n + 1 if n else 0):
            window = tuple(x for _, x in solid[p : p + n])
            if window in seen:
                gone |= {i for i, _ in solid[p : p + n]}
            seen.add(window)
        out[key] = (len(solid), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["", " ", *"abcdef"]) * r.choice([1, 1, 1, 2]) for _ in range(r.randrange(0, 14)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, "a\nb\nc\nd"), (1003, "x\ny"), (1008, "\n x\ny"), (1009, "x\ny\nz"), (1010, "only"), (1011, "only\n"), (1004, "same\n" * 2000), (1005, " a \nb\t\n\n\nc\r\nd"), (1006, "q1\nq2\nq3\nq4"), (1007, "new\nq1\nq2\nq3\nlast")]
    d = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, gone int").repartition(3)
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in dedup_lines(d).collect()}
    assert got == brute_dedup(rows)
    assert got[1008] == (2, 2, "") and got[1009][1] == 0 and got[1011] == (1, 1, "")
    assert got[1004] == (2000, 1999, "same\n") and got[1007][2] == "new\nlast"
    twice = dedup_lines(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_removed) for x in twice) == [(1, 0), (1, 0), (2, 3)]
    assert dedup_lines(d.limit(0)).count() == 0


def brute_scan(text, threshold=0.8, templates=TEMPLATES):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = sorted((label, i) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    found = set()
    for t, label in templates:
        s, size = set(WORD.findall(t.lower())), 64
        while size // 2 + 1 < len(WORD.findall(t.lower())):
            size *= 2
        half = size // 2
        for b in range(max(0, (len(w) - half - 1) // half) + 1):
            own = set(w[b * half : b * half + size])
            if len(own & s) >= math.ceil(threshold * len(s) - 1e-9):
                found.add((label, b * half, size, len(own & s) / len(s)))
    return len(w), places, found


def test_license_scan_equals_brute_force(spark):
    r = random.Random(5)
    vocabulary = sorted({w for t, _ in TEMPLATES for w in _template_words(t)} | {"gnu", "general", "public", "license", "cc", "by", "mit", "x1", "x2"})
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 90))) for _ in range(60)]
    for t, _ in TEMPLATES:
        for cut in (0, 2, 4, 6):
            words = t.split()
            for p in sorted(r.sample(range(len(words)), cut), reverse=True):
                words[p] = "other"
            texts.append(" ".join(["filler"] * r.randrange(0, 200) + words + ["tail"] * r.randrange(0, 80)).upper())
    texts += [None, "", "...", "MIT-license!", "cc by cc by cc", "GNU  general\npublic; license.", "mit licenſe K", "apache " * 5000 + "license"]
    d = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)], "doc_id long, text string, label string, w int")
    for x in scan_licenses(d).collect():
        n, places, found = brute_scan(texts[x.doc_id])
        assert x.n_words == n
        assert sorted((p.label, p.word) for p in x.places) == places
        assert {(f.label, f.start, f.words, f.score) for f in x.found} == found, texts[x.doc_id]
    same = scan_licenses(spark.createDataFrame([(1, TEMPLATES[0][0]), (1, TEMPLATES[0][0]), (None, "MIT license")], "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), len(x.places), len(x.found)) for x in same) == [("1", 0, 1), ("1", 0, 1), ("None", 1, 0)]
    assert scan_licenses(d.limit(0)).count() == 0


def test_long_templates_are_found_wherever_they_stand(spark):
    r = random.Random(6)
    body = [f"t{i}" for i in range(280)] + [f"t{i}" for i in range(20)]
    texts = [" ".join(["filler"] * at + body + ["tail"] * r.randrange(0, 900)) for at in [*range(0, 600, 23), 1000, 5000]] + ["t1 " * 900, " ".join(body[:224]), " ".join(body[:223])]
    own = ((" ".join(body), "own"), ("t1 t2 Kelvin", "short"))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in scan_licenses(d, templates=own).collect():
        assert {(f.label, f.start, f.words, f.score) for f in x.found} == brute_scan(texts[x.doc_id], templates=own)[2]
        assert any(f.label == "own" for f in x.found) == (x.doc_id < len(texts) - 3 or x.doc_id == len(texts) - 2)
    odd = spark.createDataFrame([(1, "t1 t2 \u212aelvin"), (2, "T1 T2 KELVIN")], "doc_id long, text string")
    assert {x.doc_id: [f.label for f in x.found] for x in scan_licenses(odd, templates=own[1:], threshold=1.0).collect()} == {1: [], 2: ["short"]}
    whole = " ".join(t for t, _ in TEMPLATES[7:])
    assert {f.label for f in scan_licenses(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first().found} == {label for _, label in TEMPLATES} - {"cc-by", "mpl", "cc0"}
    with pytest.raises(ValueError, match="even"):
        scan_licenses(d, block_words=33)
