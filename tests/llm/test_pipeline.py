"""The pipeline against a plain version of its stages on a small table."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_ngramjoin import brute_classes
from tests.llm.test_text_operators import brute_leaks
from verbena.llm import quality
from verbena.llm.mixing import mix_report


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(text(30)) for _ in range(5)]
    out = [text(r.randrange(30, 150)) for _ in range(60)]
    out += [[*out[i][:40], "edited", *out[i][41:]] for i in range(10)] + [out[i] for i in range(20, 26)]
    out += [[*out[i][:20], *items[i % 5].split()[3:20], *out[i][20:]] for i in range(30, 36)]
    out += [["spam"] * 60, ["short"], "a | b".split() * 40]
    rows = [(i, " ".join(x), "en", r.choice(["s0", "s0", "s1", "s2", None]), 1) for i, x in enumerate(out)] + [(900, None, "en", "s1", 0), (901, "", None, "s1", 0)]
    return rows, items


def test_stages_equal_plain_ones(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    packer, rules = zstandard.ZstdCompressor(level=3), quality.QualityRules()
    left = [x for x in rows if quality.measure((x[1] or "").encode(), rules, packer)[6]]
    step = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert step.columns == docs.columns and {x.doc_id for x in step.collect()} == {x[0] for x in left}
    classes = brute_classes([(k, t) for k, t, *_ in left])
    left = [x for x in left if classes[x[0]] == x[0]]
    step = corpus_pipeline.near_duplicates(spark, step, str(tmp_path))
    assert step.columns == docs.columns and {x.doc_id for x in step.collect()} == {x[0] for x in left}
    left = [x for x in left if not brute_leaks(x[1], [(str(i), t) for i, t in enumerate(items)])[1]]
    step = corpus_pipeline.decontaminate(spark, step, str(tmp_path))
    assert step.columns == docs.columns and {x.doc_id for x in step.collect()} == {x[0] for x in left}
    want = Counter({x.doc_id: x.copies for x in mix_report(step).collect() if x.copies})
    step = corpus_pipeline.mix(spark, step, str(tmp_path))
    assert step.columns == docs.columns and Counter(x.doc_id for x in step.collect()) == want
    t, text, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {x[0]: x[1] for x in left}, 0
    expected = []
    for k in sorted(want.elements()):
        ids = [*t.encode(text[k], add_special_tokens=False).ids, 0]
        expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected and len(got) > 30
    assert corpus_pipeline.mix(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_odd_tables_go_through_all_stages(spark, tmp_path):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    text = [" ".join(r.choice(vocabulary) for _ in range(80)) for _ in range(8)]
    rows = [
        (1, text[0], "a"), (1, text[1], "a"), (1, text[1] + " end", "a"),  # unrelated texts under one key, and a near copy
        (None, text[2], "b"), (None, text[2], None), (None, text[3], None),  # copies under null keys
        (5, text[4], "b"), (5, text[4], "b"), (6, None, "b"), (7, "", None), (8, text[5] + " " + text[6][:200], "a"), (9, text[7], None),
    ]
    clash = "doc_id long, text string, source string, body string, r1 long, t1 int, mix_key string, own_size string, class_key int"
    spark.createDataFrame([(*x, "x", 1, 2, "k", "s", 3) for x in rows], clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text[6][:200]), (None, text[7]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = step.columns
    step = corpus_pipeline.quality(spark, step, str(tmp_path))
    assert step.columns == columns and step.count() == 10
    step = corpus_pipeline.near_duplicates(spark, step, str(tmp_path))
    kept = sorted(x.text[:30] for x in step.collect())
    assert step.columns == columns and kept == sorted(t[:30] for t in (text[0], text[1], text[2], text[3], text[4], text[5], text[7]))
    step = corpus_pipeline.decontaminate(spark, step, str(tmp_path))
    assert step.columns == columns and sorted(x.text[:30] for x in step.collect()) == sorted(t[:30] for t in text[:5])
    step = corpus_pipeline.mix(spark, step, str(tmp_path))
    assert step.columns == columns and {x.text[:30] for x in step.collect()} <= {t[:30] for t in text[:5]}
    got = corpus_pipeline.token_file(spark, step, str(tmp_path)).collect()
    assert len(got) == step.count() > 0 and sorted(x.start for x in got)[0] == 0


def test_empty_tables_go_through_run(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
