"""Operators on small fixtures with literal results, and properties that must hold whatever the order of rows."""

import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from verbena.operators import classify, discover, extract, facts, ingest, neardup, profile, registry, relevance, state

TERMS = "language_id string, signal string, seq int, term string, weak boolean"


def one_score(spark, text, language=("zyn", "zyn", "Yongnan Zhuang"), terms=(), **more):
    c = spark.createDataFrame([(1, language[0], text)], "candidate_id long, language_id string, text string")
    for k, v in more.items():
        c = c.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    lang = spark.createDataFrame([language], "language_id string, iso string, name string")
    return relevance.score(c, lang, spark.createDataFrame([(language[0], *t) for t in terms], TERMS)).first()


def test_relevance_of_shared_names_and_authors(spark):
    terms = [("alternate_name", 0, "Zhuang", True), ("alternate_name", 1, "Long An", False), ("region", 0, "China", False)]
    for text in ("Aus bus Zhuang W. Y. 1999", "X y Zhuang & Wang, a new species", "Zhuang, 2015"):
        assert one_score(spark, text, terms=terms).score < 30, text
    weak = one_score(spark, "How Standard Zhuang has Met with Market Forces in China", terms=terms)
    assert 30 <= weak.score < 50 and any("shared name" in r for r in weak.reasons)
    assert one_score(spark, "Yongnan Zhuang wordlist collected in Long An county", terms=terms).score >= 90


def test_registered_relevance_reads_whole_texts(spark, tmp_path):
    from verbena.plans import core_queries

    rows = [(1, "x " * 300 + "Elle", "de", "s"), (2, "x " * 300, "de", "s"), (3, "Elle " + "x " * 300, "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in core_queries.relevance_scores(spark, str(tmp_path)).collect()}
    assert got == {1: 30, 2: 0, 3: 30}


def test_relevance_signals(spark):
    tangsa = ("nst", "nst", "Tangsa")
    assert one_score(spark, "nothing", tangsa).score == 0
    assert one_score(spark, "nothing", tangsa, user_asserted=True).score == 100
    assert one_score(spark, "word list nst", tangsa).score == 70
    assert one_score(spark, "a Tangsa grammar", tangsa, discovery_confidence=0.2).score == round(70 * 0.65)
    assert one_score(spark, "a text", tangsa, metadata_language="Tangsa", types=["Grammar"]).score == 60
    assert one_score(spark, "a text", tangsa, contents="in Tangsa they say").score == 30
    twice = [("variety", 0, "Mossang", False), ("variety", 1, "Muklom", False), ("community", 0, "Mossang", False)]
    assert one_score(spark, "Mossang wordlist, Muklom texts", tangsa, twice).score == 62  # 50 + a quarter, the later signal's term used up; half to even
    assert one_score(spark, "Tangsa", tangsa).matched_terms == ["Tangsa"]


def test_formats_and_types(spark):
    files = [("a.eaf", b"<?xml"), ("b", b"%PDF-1.4"), ("c.docx", b"PK\x03\x04"), ("d.qzx", b"\0\1\2binary"), ("e.unknown", b"plain text here"), ("f.tar.gz", b"\x1f\x8b"), ("g.wav", b"RIFF...."), ("h", None)]
    d = classify.detect_format(spark.createDataFrame(files, "name string, head binary"))
    got = {r.name: (r.format, r.category, r.detected_by) for r in d.collect()}
    assert got == {
        "a.eaf": ("elan", "text", "extension"), "b": ("pdf", "documents", "magic"), "c.docx": ("docx", "documents", "extension"), "d.qzx": ("unknown", "other", "unknown"),
        "e.unknown": ("text", "text", "content"), "f.tar.gz": ("tar-gzip", "archives", "extension+magic"), "g.wav": ("wav", "audio", "extension+magic"), "h": ("unknown", "other", "unknown"),
    }
    r = spark.createDataFrame([(1, "pdf", "documents", "Tangsa grammar sketch", ["Field notes"]), (2, "pdf", "documents", "x", None), (3, "zip", "archives", "songs", None), (4, "unknown", "other", "", None)], "resource_id int, format string, category string, words string, hints array<string>")
    kinds = {(x.resource_id, x.type, x.confidence) for x in classify.classify(spark, r).collect()}
    assert kinds == {(1, "grammar", 0.7), (1, "field_notes", 0.8), (2, "research", 0.3), (3, "archive", 0.95), (3, "audio", 0.7), (4, "unknown", 0.5)}


def test_ingest_first_owns_and_order_does_not_matter(spark):
    rows = [(i, "S", "nst", i, f"/x/Tangsa_{i}.txt" if i != 3 else "/x/recipes.txt", None if i == 4 else (b"same" if i in (2, 5, 7) else b"text %d" % i), "offline", None) for i in range(8)]
    random.Random(1).shuffle(rows)
    c = spark.createDataFrame(rows, "candidate_id long, session_id string, language_id string, seq long, path string, content binary, method string, url string").withColumn("original_path", F.lit(None).cast("string"))
    lang = spark.createDataFrame([("nst", "nst", "Tangsa")], "language_id string, iso string, name string")
    terms = spark.createDataFrame([], TERMS)
    out = ingest.outcomes(c, lang, terms)
    got = {r.candidate_id: (r.status, r.duplicate_of) for r in out.collect()}
    assert got == {0: ("stored", None), 1: ("stored", None), 2: ("stored", None), 3: ("rejected", None), 4: ("failed", None), 5: ("duplicate_linked", 2), 6: ("stored", None), 7: ("duplicate_linked", 2)}
    assert ingest.resources(out).count() == 4 and ingest.sidecars(out).count() == 4
    assert sorted(r.original_path for r in ingest.provenance(out, c).collect()) == sorted(f"/x/Tangsa_{i}.txt" for i in (0, 1, 2, 5, 6, 7))
    counters = state.session_counters(out).first()
    assert (counters.discovered, counters.relevant, counters.downloaded, counters.duplicates, counters.failed) == (8, 6, 4, 2, 1)
    again = ingest.outcomes(c, lang, terms, stored=ingest.resources(out).select("sha256"))
    assert {r.status for r in again.where("candidate_id in (0, 2, 5)").collect()} == {"duplicate_linked"}


def test_near_pairs_lose_nothing(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "id int, text string")
    sketches = neardup.sketch_classes(neardup.signatures(d, "id")).where("id = class").select("id", "sketch")
    held = {x.id: x.sketch for x in sketches.collect()}
    want = set()
    for a in held:
        for b in held:
            if a < b:
                union = sorted({*held[a], *held[b]})[:128]
                shared = len({*union} & {*held[a]} & {*held[b]})
                if shared * 100 >= len(union) * 85:
                    want.add((a, b))
    assert {(x.a, x.b) for x in neardup.near_pairs(sketches).collect()} == want and want
    fresh = spark.createDataFrame([(i,) for i in list(held)[:5]], "id int")
    assert {(x.a, x.b) for x in neardup.near_pairs(sketches, fresh=fresh).collect()} == {p for p in want if {*p} & {*list(held)[:5]}}


def test_registry(spark):
    languages = spark.createDataFrame([("nst", "Tase Naga"), ("njb", "Nocte Naga"), ("fry", "Western Frisian"), ("zha", "Zhuang"), ("zyn", "Yongnan Zhuang")], "code string, name string")
    names = [("nst", "name", "Tase Naga", 0), ("nst", "alternate_name", "Tangsa", 1), ("njb", "name", "Nocte Naga", 0), ("njb", "dialect", "Hakhun", 1), ("fry", "name", "Western Frisian", 0), ("zha", "name", "Zhuang", 0), ("zyn", "name", "Yongnan Zhuang", 0), *((c, "alternate_name", "Naga", 2) for c in ("nst", "njb", "zha"))]
    index = registry.name_index(spark.createDataFrame(names, "code string, kind string, text string, seq int"))
    retired = spark.createDataFrame([("fri", "fry")], "code string, change_to string")
    asked = ["nst", "TANGSÁ", "hakhun", "fri", "Zhuang language", "zzqqxx", "Naga", "yong", " "]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in registry.find(q, index, languages, retired).collect():
        got.setdefault(asked[r.query_id], []).append((r.code, r.matched_on, round(r.score, 2), r.rank))
    assert got["nst"][0][:3] == ("nst", "code", 1.0) and got["TANGSÁ"] == [("nst", "alternate_name", 0.9, 1)] and got["hakhun"] == [("njb", "dialect", 0.8, 1)]
    assert got["fri"][0][:3] == ("fry", "retired_code", 0.9) and got["Zhuang language"][0] == ("zha", "name", 0.96, 1) and "zzqqxx" not in got and " " not in got
    assert len(got["Naga"]) == 3 and got["yong"] == [("zyn", "name", 0.63, 1)]
    assert {r.key for r in registry.ambiguous(index).collect()} == {"naga"}
    local = registry.find_local(q, spark.createDataFrame([("x-tangsa", "name", "Tangsa"), ("x-tangsa", "exonym", "Naga")], "language_id string, check string, text string"))
    assert {(asked[r.query_id], r.matched_on, r.score) for r in local.collect()} == {("TANGSÁ", "name", 1.0), ("Naga", "exonym", 0.9)}
    identity = spark.createDataFrame([("x-tangsa", "nst")], "language_id string, code string")
    states = {asked[r.query_id]: (r.status, r.best_code) for r in registry.resolve(q, local, registry.find(q, index, languages, retired), identity).collect()}
    assert states["nst"] == ("exact", "nst") and states["Naga"] == ("exact", "nst") and states["zzqqxx"] == ("none", None) and states["yong"][0] == "ambiguous"
    countries = spark.createDataFrame([("IN", "India"), ("MM", "Myanmar")], "alpha_2 string, name string")
    some = spark.createDataFrame([("nst", ["in", "MM", "XX"])], "code string, countries array<string>")
    assert registry.country_names(some, countries).first().region == "India / Myanmar / XX"
    known = spark.createDataFrame([("Latn", "Latin", 0), ("Mymr", "Myanmar (Burmese)", 1), ("Tnsa", "Tangsa", 2)], "code string, name string, seq int")
    s = registry.scripts(spark.createDataFrame([(1, "latn"), (2, "Tangsa"), (3, "Myanmar"), (4, "none")], "query_id int, query string"), known)
    assert {r.query_id: r.code for r in s.collect()} == {1: "Latn", 2: "Tnsa", 3: "Mymr"}


VALUE = "language_id string, grp string, field string, value_json string, source_type string, confidence double, recorded_at string, preferred boolean, status string, seq int"


def test_profiles(spark):
    rows = [
        ("nst", "resources", "speakers", "8500", "catalogue", 0.6, "2020", False, "accepted", 0), ("nst", "resources", "speakers", "12000", "agent", 0.6, "2021", False, "accepted", 1),
        ("nst", "identity", "alternate_names", '["A","B"]', "local_database", 0.8, "2020", False, "accepted", 2), ("nst", "identity", "alternate_names", '["b","C"]', "user", 1.0, "2021", True, "accepted", 3),
        ("nst", "identity", "family", '"Sino-Tibetan"', "local_database", 0.5, "2020", False, "accepted", 4), ("nst", "identity", "notes", '"x"', "agent", 0.9, "2020", False, "proposed", 5),
    ]
    v = spark.createDataFrame(rows, VALUE)
    assert {r.items and tuple(r["items"]) for r in profile.merged_lists(v).where("field = 'alternate_names'").collect()} == {("b", "C", "A")}
    lang = spark.createDataFrame([("nst", "nst", "Tangsa")], "language_id string, iso string, name string")
    states = {r.field: r.state for r in profile.field_states(v, lang).collect()}
    assert len(states) == len(profile.fields()) == 26 and (states["speakers"], states["family"], states["alternate_names"], states["notes"]) == ("contradictory", "uncertain", "known", "missing")
    assert profile.preferred_values(v).where("field = 'speakers'").first().value_json == "12000"
    entered = spark.createDataFrame([("nst", "resources", "speakers", "9000", "2022", 6)], "language_id string, grp string, field string, value_json string, recorded_at string, seq int")
    after = profile.set_user_values(v, entered)
    assert {r.state for r in profile.field_states(after, lang).where("field = 'speakers'").collect()} == {"known"} and after.where("field = 'speakers'").count() == 3
    assert profile.preferred_values(after).where("field = 'speakers'").first().value_json == "9000"
    new = spark.createDataFrame([("nst", "identity", "family", '"sino-tibetan"', 0.5), ("nst", "identity", "family", '"Other"', 0.5)], "language_id string, grp string, field string, value_json string, confidence double")
    assert [r.value_json for r in profile.unknown_proposals(new, v).collect()] == ['"Other"']
    assert {(r.grp, r.state) for r in profile.group_states(profile.field_states(v, lang)).collect()} >= {("identity", "partial"), ("community_status", "empty")}
    assert {(r.signal, r.term) for r in profile.terms(v).collect()} == {("alternate_name", "b"), ("alternate_name", "C"), ("alternate_name", "A"), ("family", "Sino-Tibetan")}
    assert {(r.kind, r.weight) for r in profile.scan_terms(v, lang).collect()} == {("name", 0.9), ("iso_code", 0.85), ("alternate_name", 0.8)}
    assert ("identity", "family") in profile.fields_feeding("query")
    made = json.loads(profile.to_json(v).first().profile)
    assert made["identity"] == {"alternate_names": ["b", "C", "A"], "family": "Sino-Tibetan"} and made["resources"] == {"speakers": 12000}
    assert len(made["provenance"]["resources"]["speakers"]) == 2 and "notes" in made["provenance"]["identity"]


def test_facts():
    text = "Tangsa is spoken in the hills. Mossang is a Tangsa variety. It is also known as Tase and Tangshang. It is spoken in Changlang district. It belongs to the Sino-Tibetan family. About 8,500 speakers remain. Konyak Naga is spoken in Mon district."
    got = {(f.field, f.value) for f in facts.extract(text, "Tangsa")}
    assert got >= {("varieties", "Mossang"), ("alternate_names", "Tase"), ("alternate_names", "Tangshang"), ("places", "Changlang/district"), ("family", "Sino-Tibetan"), ("speakers", "8500")}
    assert not any("Mon" in v for _, v in got) and all(f.confidence < 0.7 and f.quote for f in facts.extract(text, "Tangsa"))
    assert facts.last_json('a {"x": 1} then ```json\n[1, {"y": 2}]\n``` end') == '[1, {"y": 2}]' and facts.last_json("none {") is None


def test_extraction(spark):
    stream = zlib.compress(b"BT (Hello \\(Tangsa\\)) Tj [(Sec) -50 (ond) -300 (line)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n<</Filter /FlateDecode>>\nstream\n" + stream + b"\nendstream"
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p>One &amp; two</w:p><w:p>Three</w:p></w:document>")
        z.writestr("../evil.txt", "x")
        z.writestr("folder/", "")
    rows = [(1, pdf, "pdf", "documents"), (2, docx.getvalue(), "docx", "documents"), (3, b'{"a": ["x", {"b": "y"}]}', "json", "text"), (4, "a,b\nc,d".encode("utf-16"), "csv", "text"), (5, b"junk", "docx", "documents"), (6, b"<html><head>h</head><p>Tangsa &amp; Nocte</p>", "html", "text"), (7, b"<x><ANNOTATION_VALUE>nga tangsa</ANNOTATION_VALUE><ANNOTATION_VALUE>hello</ANNOTATION_VALUE>", "elan", "text"), (8, None, "pdf", "documents"), (9, b"xx", "mp3", "audio")]
    d = spark.createDataFrame([(i, bytearray(c) if c is not None else None, f, k) for i, c, f, k in rows], "id int, content binary, format string, category string")
    got = {r.id: (r.text, r.extractor) for r in extract.extract_texts(d, "id").collect()}
    assert got[1] == ("Hello (Tangsa) Second line", "builtin") and got[2] == ("One & two\nThree", "zip-xml") and got[3][0] == "a\nx\nb\ny" and got[4][0] == "a b\nc d"
    assert got[5][0] == "" and got[5][1].startswith("failed") and got[6][0] == "Tangsa & Nocte" and got[7][0] == "nga tangsa\nhello" and got[8] == ("", "none") and got[9] == ("", "none")
    packed = spark.createDataFrame([(1, bytearray(docx.getvalue()), "zip"), (2, bytearray(b"broken"), "zip")], "id int, content binary, format string")
    inside = {r.member: (r.path, r.is_folder) for r in extract.archive_members(packed, "id", contents=True).collect()}
    assert inside == {"word/document.xml": ("word/document.xml", False), "../evil.txt": ("evil.txt", False), "folder/": ("folder", True)}


def test_discovery(spark):
    body = '{"hits":{"hits":[{"metadata":{"title":"T","license":{"id":"cc-by"},"types":["dataset"]},"links":{"self":"u1"}},{"metadata":{"title":["A","B"]}}]}}'
    d = spark.createDataFrame([(1, body)], "query_id int, body string")
    got = discover.json_results(d, "hits.hits[]", {"title": "metadata.title", "licence": "metadata.license.id", "types": "metadata.types[]", "url": "links.self"}).orderBy("n").collect()
    assert [(r.title, r.licence, r.types, r.url) for r in got] == [("T", "cc-by", '["dataset"]', "u1"), ("A", None, None, None)]
    feed = "<rss><item><title>One &amp; 1</title><link>http://a.org/1</link><description><![CDATA[x]]></description></item><entry><title>Two</title><link href=\"http://a.org/2\"/><summary>s</summary></entry></rss>"
    assert [(r.url, r.title) for r in discover.feed_results(spark.createDataFrame([(1, feed)], "query_id int, body string")).orderBy("n").collect()] == [("http://a.org/1", "One & 1"), ("http://a.org/2", "Two")]
    page = '<h3><a href="/x.pdf">X</a></h3><a href="http://b.org/y">Y</a><a href="/x.pdf">again</a><a href="#top">top</a>'
    found = discover.page_results(spark.createDataFrame([(1, "http://a.org/s?q=1", page)], "query_id int, url string, body string"))
    assert {(r.url, r.title) for r in found.collect()} == {("http://a.org/x.pdf", "X"), ("http://b.org/y", "Y")}
    hits = spark.createDataFrame([(1, 0, "http://a.org/p?utm_source=1", "A"), (1, 1, "http://A.org/p", "A2"), (1, 2, "https://www.facebook.com/x", "F"), (1, 3, "ftp://c", "C"), (1, 4, "http://d.org", "D")], "query_id int, n int, url string, title string")
    assert [(r.title, r.rank) for r in discover.distinct_hits(hits).orderBy("rank").collect()] == [("A", 1), ("D", 2)]
    assert spark.createDataFrame([("captcha please",), ('captcha <h3><a href="x">',)], "b string").select(discover.blocked(F.col("b"), "captcha", "<h3><a")).collect() == [(True,), (False,)]


@pytest.mark.parametrize("order", [1, 2])
def test_state_does_not_depend_on_order(spark, order):
    rows = [(1, "a", 50, "possible", "uncertain", "r1", 1), (1, "a", 90, "very_high", "confirmed", "r2", 2), (1, "a", 90, "very_high", "rejected", "r3", 3), (1, "a", 10, "unrelated", "x", "r4", 4)]
    random.Random(order).shuffle(rows)
    d = spark.createDataFrame(rows, "resource_id int, language_id string, score int, band string, status string, reasons string, seq int")
    assert tuple(state.resource_languages(d).first()) == (1, "a", 90, "very_high", "confirmed", "r4")
    pairs = spark.createDataFrame([(1, 2, 0.9, 1), (1, 2, 0.95, 2)], "resource_id int, other_id int, similarity double, seq int")
    assert {tuple(r) for r in state.near_duplicates(pairs).collect()} == {(1, 2, 0.95), (2, 1, 0.95)}


def test_session_ids_stay_whole_and_unique_beyond_999_a_day(spark):
    d = spark.range(1, 1051).select(F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("started_at"))
    got = {r.seq: r.session_id for r in state.session_ids(d).collect()}
    assert got[1].endswith("-001") and got[999].endswith("-999") and got[1000].endswith("-1000") and got[1009].endswith("-1009")
    assert len(set(got.values())) == 1050


def test_enrichment_from_registries(spark):
    columns = "language_id string, family string, classification string, parent string, parent_name string, script string, script_name string, dialects array<string>, region string, macroarea string, documentation string, endangerment string"
    rows = [("nst", "Sino-Tibetan", "Sino-Tibetan/Naga", "zha", "Zhuang", "Latn", "Latin", ["Hakhun"], "India / Myanmar", "Eurasia", "grammar", "threatened"), ("x", "", "", "", None, "", None, [], "", "", "", "odd")]
    got = {(r.language_id, r.field): (json.loads(r.value_json), r.confidence, r.note) for r in registry.enrich(spark.createDataFrame(rows, columns)).collect()}
    assert got == {
        ("nst", "family"): ("Sino-Tibetan", 0.85, "Sino-Tibetan/Naga"), ("nst", "parent"): ({"value": "Zhuang", "type": "macrolanguage", "code": "zha"}, 0.9, None),
        ("nst", "scripts"): ([{"code": "Latn", "name": "Latin", "as_entered": "Latn"}], 0.7, "likely script; not a claim that the language is written in it"),
        ("nst", "varieties"): (["Hakhun"], 0.75, None), ("nst", "region"): ("India / Myanmar", 0.8, "macroarea: Eurasia"),
        ("nst", "studies"): ({"state": "reported", "detail": "most extensive description: grammar"}, 0.6, None),
        ("nst", "transmission"): ({"value": "declining", "detail": "Glottolog AES: threatened"}, 0.5, None),
    }


def test_queries_for_a_language(spark):
    rows = [("nst", "Tangsa", "name", None, 0), ("nst", "Tangsa", "alternate_name", "Zhuang, Yongnan", 0), ("nst", "Tangsa", "alternate_name", "Tase", 1), ("nst", "Tangsa", "alternate_name", "Tangshang", 2), ("nst", "Tangsa", "written", None, 0)]
    t = spark.createDataFrame(rows, "language_id string, name string, kind string, term string, seq int")
    got = [(r.query, r.basis) for r in discover.search_queries(t).orderBy("rank").collect()]
    assert got[:2] == [('"Tangsa" language', "name"), ('"Tangsa" dictionary', "name")] and ('"Tangsa" primer', "written") in got
    assert ('"Tangshang" language', "alternate_name") in got and not any("Tase" in q or "Yongnan" in q for q, _ in got)
    assert len(got) == len({q for q, _ in got})
    d = spark.createDataFrame([("a b", "Ünï", "nst")], "q string, n string, c string")
    assert d.select(discover.render_url("http://x/?q={query}&c={code}&n={raw_name}", F.col("q"), F.col("n"), F.col("c"))).first()[0] == "http://x/?q=a+b&c=nst&n=Ünï"


def test_sinks_of_catalogues(spark, tmp_path):
    from verbena.sources import sinks

    r = spark.createDataFrame([("S1", "elar", "Look up", "http://e", "q", "lookup", 0), ("S1", "zenodo", "A Title", "http://z", "q", "record", 0), ("S1", "zenodo", "B", "http://y", "q", "record", 2)], "session_id string, provider string, title string, url string, query string, kind string, n_files int")
    assert json.loads(sinks.lookup_manifest(r).first().json) == [{"provider": "elar", "title": "Look up", "url": "http://e", "query": "q"}]
    made = {x.name: json.loads(x.json) for x in sinks.metadata_records(r.where("kind = 'record'")).collect()}
    assert made == {"a-title.metadata.json": {"synthetic": True, "provider": "zenodo", "title": "A Title", "url": "http://z"}}
    sinks.append_log(r, f"{tmp_path}/log")
    sinks.append_log(r, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    sinks.write_json_texts(sinks.lookup_manifest(r), f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").count() == 1
    bytes_ = spark.createDataFrame([(bytearray(b"x"), "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), (bytearray(b"y"), "0")], "content binary, sha256 string")
    assert [x.intact for x in sinks.verified(bytes_).collect()] == [True, False]


def test_small_things_for_people(spark):
    """Rates, titles to show, folders that a scan leaves out."""
    from verbena.functions.text import human_rate
    from verbena.operators import catalogues

    d = spark.createDataFrame([(0.0,), (None,), (10.0,), (2048.0,)], "r double").select(human_rate(F.col("r")).alias("s")).collect()
    assert [r.s for r in d] == ["—", "—", "10 B/s", "2.0 KB/s"]
    c = spark.createDataFrame([("T", "/a/b.txt", "u"), ("", "/a/b.txt", "u"), (None, None, "u"), (None, "", None)], "title string, path string, url string")
    assert [r.shown for r in catalogues.display(c).collect()] == ["T", "b.txt", "u", "?"]
    files = spark.createDataFrame([(1, "/r"), (2, "/r/a"), (3, "/r/venv/x/y"), (4, "/r/venv"), (5, "/r/a/.git/o"), (6, "/r/a/.git/p"), (7, "/r/b/Node_Modules")], "file_id int, folder string")
    left = catalogues.skipped_folders(files, "/r/")
    assert {r.folder for r in left.collect()} == {"venv", "a/.git", "b/Node_Modules"}
    assert catalogues.scan_report(files, files.where("file_id = 2"), left).first().asDict() == {"files_seen": 7, "hits": 1, "dirs_skipped": 3}
