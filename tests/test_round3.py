"""Queries against their SQL on odd rows, and plans whose work follows the input."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from verbena.functions.text import signature, tokens
from verbena.operators import neardup
from verbena.plans import catalog


def differing(spark, folder, name, **tables):
    """Rows of a query and of its SQL over small tables (schema, rows), sorted."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    ours, theirs = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))), sorted(map(repr, want.fetchall()))
    return [r for r in ours if r not in theirs], [r for r in theirs if r not in ours]


def test_decided_values_never_pairs_values_with_decisions(spark, tmp_path):
    labels = ("doc_id long, quality int, toxic int", [(i, i % 2, 0) for i in range(300)])
    events = ("event_id long, user_id long, event_type string", [(i, i * 5 % 97, ("purchase", "error", "view", "click")[i * 7 % 4]) for i in range(2000)])
    assert differing(spark, tmp_path, "decided_values", labels=labels, events=events) == ([], [])
    plan = catalog.QUERIES["decided_values"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("Aggregate")


def test_sizes_half_way_go_to_the_even_digit(spark, tmp_path):
    sizes = [1023, 1024, 2304, 2432, 2305, 1280, 1331, 1332, 12_339, 700_000]
    pages = ("page_id long, url string, html string", [(i, f"http://a.org/{i}", "x" * n) for i, n in enumerate(sizes)])
    assert differing(spark, tmp_path, "cache_keys", pages=pages) == ([], [])


@pytest.mark.parametrize("name", ["relevance_scores", "matched_terms", "relevance_status_by_source", "ingest_outcomes"])
def test_names_in_lists_count_as_in_sql(spark, tmp_path, name):
    texts = ["Elle, Elle, Elle, Elle", "Erheon, Erheon, Erheon", "Elle et al", "A. Schaft, Weber", "Elle est la", "Ingand 1999", "Anthe", None, "", "tho", "Elle, Elle, Elle, Elle"]
    documents = ("doc_id long, text string, lang string, source string, n_chars long", [(i, x, "en" if i % 4 == 0 else "fr", f"s{i % 2}", 0) for i, x in enumerate(texts)])
    assert differing(spark, tmp_path, name, documents=documents) == ([], [])


def test_sketches_in_batches_equal_the_expression(spark):
    r = random.Random(3)
    words = ["wort", "Élan", "日本", "x_1", "½", "naïve", "é", "١٢", "a", "Ω"]
    texts = [" -,".join(r.choice(words) + str(r.randrange(n)) for _ in range(n)) for n in (1, 4, 5, 19, 20, 21, 150, 900)] + ["same " * 40, "", None, "\n\t ", "a b c d e f g h i j k l m n o p q r s t"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for k in (3, 128):
        want = {x.id: x.s for x in d.select("id", signature(tokens(F.col("text")), k).alias("s")).where("s IS NOT NULL").collect()}
        sketched = neardup.signatures(d, "id", k=k)
        assert {x.id: x.sketch for x in sketched.collect()} == want and len(want) == 6
    assert "MapInArrow" in sketched._jdf.queryExecution().executedPlan().toString()  # no md5 expression for each run of words


def test_plain_strings_of_a_pdf_are_one_token(monkeypatch):
    from verbena.operators import extract

    stream = b"BT /F1 9 Tf (caf\xc3\xa9) Tj ()Tj (a) (b) Tj\n[(c)-300(d)] TJ (e) Tj* (f) ' ET"
    monkeypatch.setattr(extract, "_pdf_string", None)
    assert list(extract._pdf_shown(stream)) == ["café", "", "b", "c d", "f"]


@pytest.mark.parametrize("name", ["catalogue_totals", "catalogue_candidates"])
def test_long_metadata_of_catalogue_results_stays_where_it_is(spark, tmp_path, name):
    part = ("p_partkey long, p_name string, p_brand string, p_type string, p_size long", [(i, f"n{i}", f"b{i % 3}", "t", i % 5) for i in range(200)])
    assert differing(spark, tmp_path, name, part=part) == ([], [])
    assert "x" * 20 not in catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_tools_are_asked_on_all_cores(spark, tmp_path, monkeypatch):
    from verbena.plans import operator_queries

    asked = []
    plain = operator_queries.agents.answers
    monkeypatch.setattr(operator_queries.agents, "answers", lambda *a, **k: asked.append(k.get("parallel")) or plain(*a, **k))
    conversations = ("conv_id long, turn long, role string, text string", [(i, i % 3, "user", "x") for i in range(9)])
    assert differing(spark, tmp_path, "tool_answers", conversations=conversations) == ([], [])
    assert asked == [spark.sparkContext.defaultParallelism]


def test_op9_ids_need_no_python_for_each_pre_token(monkeypatch):
    """Ids of whole texts equal the library's without a lookup in Python for each pre-token, at cuts, in long runs and with every safe character."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from verbena.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, library = bpe.Encoder(path), Tokenizer.from_file(path)
    safe = [c for c in map(chr, range(0x20000)) if not e.odd(c)]
    r = random.Random(7)
    pool = [*"aZ09 _'.,\n\t 　éß中가😀", "  ", "\n\n", " the", "'ll", "'S", "don't", "<|endoftext|>", " |"]
    texts = ["", " ", "".join(f"{c} {c}a{c}1 {c}{c}" for c in safe), *("".join(r.choice(pool) for _ in range(200)) for _ in range(200))]
    texts += ["word, and more\n" * 20_000, "a  b\n\n c " * 30_000]  # cut into blocks
    plain = bpe.Encoder(path)
    monkeypatch.setattr(plain, "pieces", None)
    for t in texts:
        assert plain.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    # no place for a cut: as before
    for t in (" " * 1_500_000 + "x", "^" * 200_000, "ab\t" * 100_000):
        assert e.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    for t in ("a\x1cb", "\x1f", "ok"):
        assert e.odd(t) == (t != "ok")


def test_an_intake_of_sketches_is_written_once(spark, tmp_path, monkeypatch):
    """nodes, prefixes and members go to their part and nowhere else; prefixes are those of the frozen order."""
    from verbena.operators import sketchindex

    names, real = [], sketchindex.written
    monkeypatch.setattr(sketchindex, "written", lambda df, name, *a: (names.append(name), real(df, name, *a))[1])
    r = random.Random(3)
    common, hex_ = [f"{i:016x}" for i in r.sample(range(1 << 40), 12)], lambda: f"{r.randrange(1 << 60):016x}"
    rows = [(str(i), sorted({*r.sample(common, 9), *(hex_() for _ in range(r.randrange(40)))})) for i in range(30)]
    index = sketchindex.SketchIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(spark.createDataFrame([*rows, rows[0]], "id string, sketch array<string>"))
    assert set(names) <= {"pairs", "near"}
    often = {h: n for h in common if (n := sum(h in s for _, s in rows)) >= sketchindex.COMMON}
    want = set()
    for _, s in rows:
        n = len(s)
        for at, h in enumerate(sorted(s, key=lambda h: (often.get(h, 0), h))[: n - -(-n * 85 // 100) + 1]):
            want.add((h, at + 1, n))
    assert {(x.h, x.at, x.n) for x in index.read("prefixes").collect()} == want
    assert index.read("members").count() == index.read("nodes").count() == 30


def test_a_search_parses_each_page_once(spark, tmp_path, monkeypatch):
    """all pages are parsed once for the index, then only those that a round visits; of pages with one key the least counts."""
    from verbena.plans import search_queries

    said = ["Thtion tales", "of Retion Moreandmore", "Moreandmore songs", "nothing"]
    pages = [(i, f"http://h{i % 17}.org/{i}", f"<html><title>Thtion Name{'abcdefgh'[i % 8] * 6}</title><body><p>{said[i % 4]} <b>T</b>ht&amp;ion</p></body></html>") for i in range(60)]
    pages += [(100 + i, f"http://h{i}.org/{i}?utm_source=feed", "<html><title>Thtion Anothername</title><body>Thtion</body></html>") for i in range(4)]
    parsed, real = spark.sparkContext.accumulator(0), search_queries.page_text

    @F.udf("string")
    def counted(html):
        parsed.add(1)
        return html

    monkeypatch.setattr(search_queries, "page_text", lambda html, most: real(counted(html), most=most))
    assert differing(spark, tmp_path, "search_rounds", pages=("page_id long, url string, html string", pages)) == ([], [])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    visited = len(con.execute(catalog.ORACLE["search_rounds"]).fetchall())
    assert visited > 8 and parsed.value == len(pages) + visited
