"""Leaks, token counts, quality and token files against brute force, an exact round trip, and edge cases."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verbena.llm import bpe, leaks, quality, tokenfile
from verbena.llm.tokencount import token_counts
from verbena.llm.wordhash import ALNUM, SOLID, word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALNUM_RE, SOLID_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a", "ONE two", "éÉ ñ x", "x" * 70000, "tail <|endoftext|> more", "don't  stop\n\n\nnow ", "՘a\U0002f800 z", "1234 ٣٤ ²", "a\x1cb\x85c d"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def random_texts(n, seed, words="ab cd ef gh ij kl mn".split(), most=60):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randrange(most))) for _ in range(n)]


def test_word_hashes_follow_the_word_rules(monkeypatch):
    texts = [t or "" for t in ODD] + ["Aa bB\x00cc, dd-ee é. f", "long" * 50 + " b " * 400]
    for piece in (1 << 20, 16):
        monkeypatch.setattr("verbena.llm.wordhash.SEGMENT", piece)
        for t in texts:
            for rule, member, low in ((ALNUM_RE, ALNUM, True), (SOLID_RE, SOLID, False)):
                want = rule.findall(lower(t) if low else t)
                got = word_hashes(t.encode(), member, low)
                assert len(got) == len(want)
                assert len({*zip(want, got.tolist())}) == len({*want}) == len({*got.tolist()})


def brute_leaks(text, items, window=10):
    words, hit, names = ALNUM_RE.findall(lower(text)), set(), set()
    for name, body in items:
        w = ALNUM_RE.findall(lower(body))
        n = min(window, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for p in range(len(words) - n + 1 if n else 0):
            if tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                names |= {name} - {None}
    return len(words), len(hit), sorted(names)


def test_leaks_equal_brute_force(spark):
    docs = list(enumerate(random_texts(60, 1) + ODD)) + [(3, "ab cd ef"), (None, "ab cd ef gh ij kl mn ab cd ef gh")]
    items = [(str(i), t) for i, t in enumerate(random_texts(25, 2, most=24))] + [("x", None), ("y", ""), (None, "ef ef gh"), ("7", "gh mn"), ("7", "gh mn")]
    d = spark.createDataFrame([(k, t, "clash", 0) for k, t in docs], "doc_id long, text string, body string, t1 int")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = leaks.find_leaks(d, b).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.hit_spans), r.hit_items) for r in rows)
    assert got == sorted((str(k), *brute_leaks(t, items)) for k, t in docs)
    kept = leaks.keep_clean(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in kept.collect()) == sorted(str(k) + str(t) for k, t in docs if not brute_leaks(t, items)[1])
    assert leaks.find_leaks(d, b.limit(0)).where("size(hit_items) > 0").count() == 0
    assert leaks.find_leaks(d.limit(0), b).count() == 0


def test_leaks_in_texts_that_repeat_themselves(spark):
    items = [("a", "spam " * 1000), ("b", "spam " * 12 + "end"), ("c", "ham egg " * 300)]
    docs = [(1, "spam " * 100_000), (2, "x " * 50 + "spam " * 9), (3, "egg ham " * 50_000 + "spam " * 10), (4, "spam " * 9 + "end")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    began = time.monotonic()
    got = {r.doc_id: ([(s.start, s.end) for s in r.hit_spans], r.hit_items) for r in leaks.find_leaks(d, b).collect()}
    assert time.monotonic() - began < 60
    assert got == {1: ([(0, 100_000)], ["a", "b"]), 2: ([], []), 3: ([(0, 100_010)], ["a", "b", "c"]), 4: ([(0, 10)], ["b"])}


def test_winnowing_misses_no_span_of_a_window():
    r = np.random.default_rng(5)
    hashes = lambda x: word_hashes(x, ALNUM, True)
    for n, gram in ((10, 5), (7, 5), (3, 5), (4, 2)):
        for _ in range(100):
            item, doc = (b" ".join(b"w%d" % x for x in r.integers(0, 4, size)) for size in (30, 80))
            a, b = item.split(), doc.split()
            shared = np.intersect1d(leaks.prints(hashes(item), [n], gram), leaks.prints(hashes(doc), [n], gram))
            left, right = (leaks.seeded_windows(x, shared, [n], gram) for x in (item, doc))
            got = {q for w in right.keys() & left.keys() for s, e in right[w] for q in range(s, e)}
            assert got == {q for p in range(len(b) - n + 1) for i in range(len(a) - n + 1) if b[p : p + n] == a[i : i + n] for q in range(p, p + n)}


def test_token_counts_equal_the_library(spark):
    t = Tokenizer.from_file(PATH)
    texts = ODD + random_texts(30, 4, words=["The", "naïve", "don't", "x=1;", "\n\n", "  ", "über", "12345", "…", "日本"])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(d, PATH).collect()}
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    assert token_counts(d.limit(0), PATH).count() == 0


def test_safe_characters_are_cut_as_the_library_cuts_them():
    e = bpe.encoder(PATH)
    cut = e.tokenizer.pre_tokenizer.pre_tokenize_str
    for cp in (c for c in range(0x20000) if not 0xD800 <= c < 0xE000):
        if not e.odd(chr(cp)):
            s = f"a{chr(cp)}b 1{chr(cp)}2 !{chr(cp)}? {chr(cp)} {chr(cp)}"
            assert [s[x:y] for _, (x, y) in cut(s)] == e.pieces(s), hex(cp)
    assert e.whole and all(e.model.tokenize("".join(e.letters[b] for b in p.encode()))[0].id == i for p, i in list(e.whole.items())[::97])


def brute_quality(text):
    text = text or ""
    w = SOLID_RE.findall(text)
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {q for v in spots.values() if len(v) > 1 for i in v for q in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SOLID_RE.search(x)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(repeated), failed


def test_quality_counts_equal_brute_force(spark):
    texts = ODD + random_texts(60, 6) + ["# a | b\n\x0b\n# a | b\n # a | b  "] + ["one two three four five six seven eight nine " * 5]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.quality_measures(d).collect()}
    for i, x in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(x)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(d.withColumn("kept", F.lit("clash")))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept} and kept.columns == ["doc_id", "text", "kept"]
    assert quality.quality_measures(d.limit(0)).count() == 0


def test_compression_bands_reject_both_ends():
    import zstandard

    packer, rules = zstandard.ZstdCompressor(level=3), quality.QualityRules()
    r = random.Random(3)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(900)).encode()
    table = b"\n".join(b"r%d|value|value|value|unit%d" % (i, i) for i in range(400))
    assert quality.measure(prose, rules, packer)[6]
    assert quality.measure(table, rules, packer)[9] == "repetitive"
    assert quality.measure(bytes(r.choice(range(33, 127)) if i % 7 else 32 for i in range(9000)), rules, packer)[9] == "incompressible"


def test_chunks_of_junk_within_prose_are_seen():
    import base64

    import zstandard

    packer, rules = zstandard.ZstdCompressor(level=3), quality.QualityRules()
    r = random.Random(3)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(9000)).encode()
    parts = [prose[i : i + 4096] for i in range(0, 10 * 4096, 4096)]
    assert quality.measure(b"".join(parts), rules, packer)[6:10:2] == (True, 0.0)
    for i in (1, 4, 6):
        parts[i] = b" ".join(base64.b64encode(r.randbytes(30)) for _ in range(100))[:4096]
    mixed = quality.measure(b"".join(parts), rules, packer)
    assert mixed[8:] == (0.3, "uneven chunks")
    short = b"".join(parts[7:9]) + base64.b64encode(r.randbytes(2250))
    assert quality.measure(short, rules, packer)[9] == "uneven chunks"


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packing_round_trip(n):
    v = np.random.default_rng(n).integers(0, 2 ** np.random.default_rng(n + 1).integers(1, 33, n), dtype=np.uint64).astype("<u4") if n else np.zeros(0, "<u4")
    assert (tokenfile.unpack(*tokenfile.pack(v), n) == v).all()


def test_token_file_round_trip(spark):
    t = Tokenizer.from_file(PATH)
    texts = ODD + random_texts(40, 8, words=["The", "naïve", "don't", "\n", "über"])
    rows = [(i * 7 % 1000, x) for i, x in enumerate(texts)] + [(7, "again"), (7, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    blocks, order = tokenfile.write_token_blocks(d, PATH, block_ids=50)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_token_blocks(blocks, order).collect())
    assert [r[1] for r in got] == sorted(k for k, _ in rows)
    want = sorted((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, x in rows for ids in [t.encode(x or "", add_special_tokens=False).ids + [0]])
    assert sorted(r[1:] for r in got) == want
    assert [r[0] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    assert blocks.count() > 4
    empty, none = tokenfile.write_token_blocks(d.limit(0), PATH)
    assert tokenfile.read_token_blocks(empty, none).count() == 0


def test_null_keys_repeated_rows_and_clashing_columns(spark):
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(80))
    rows = [(None, text, "x", 1, 2), (None, text, "x", 1, 2), (None, None, "y", 1, 2), (1, text, "x", 1, 2), (1, text + " end", "x", 1, 2), (2, "", "x", 1, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, body string, part int, mark int").withColumn("n_words", F.lit(5)).withColumn("kept", F.lit("no"))
    counts = [(r.doc_id, r.n_bytes) for r in token_counts(d, PATH).collect()]
    assert sorted(counts, key=str) == sorted([(k, len((t or "").encode())) for k, t, *_ in rows], key=str)
    measured = quality.quality_measures(d).collect()
    assert sorted(((r.doc_id, r.n_words) for r in measured), key=str) == sorted([(k, len((t or "").split())) for k, t, *_ in rows], key=str)
    assert quality.keep_good(d).columns == d.columns and quality.keep_good(d).count() == sum(r.kept for r in measured) == 4
    blocks, order = tokenfile.write_token_blocks(d, PATH, parts=3)
    got = sorted(tokenfile.read_token_blocks(blocks, order).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, 1, 1, 2] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert got[-1].n_tokens == 1 and sorted(r.n_tokens for r in got[:3])[0] == 1
    many = spark.createDataFrame([(None, f"{text} {i}") for i in range(60)], "doc_id long, text string")
    blocks, _ = tokenfile.write_token_blocks(many, PATH, parts=6)
    assert blocks.select("part").distinct().count() > 3  # one key is no single part
