"""Column functions against plain Python forms of the same rules, and literal cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from verbena.functions import entered, match, web
from verbena.functions import text as t


def column(spark, values, *f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] if len(f) > 1 else r[1] for r in d.select("i", *(g(F.col("v")).alias(f"c{n}") for n, g in enumerate(f))).orderBy("i").collect()]


def test_fold(spark):
    cases = ["Tangsá", "Naga, Tase", "  A\tb\n c ", None, "", "O’Neil-Smith_(x)/y.", "ÀÉÎõü Ñ", "Ωμέγα", "straße", "áb"]
    want = ["tangsa", "naga tase", "a b c", "", "", "o neil smith x y", "aeiou n", "ωμεγα", "straße", "ab"]
    assert column(spark, cases, t.fold) == want == [t.fold_string(c) for c in cases]
    r = random.Random(1)
    mixed = ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x1E00, 0x1F00)])) for _ in range(30)) for _ in range(200)]
    plain = [c for c in mixed if all(len([x for x in unicodedata.normalize("NFKD", k) if not unicodedata.combining(x)]) == 1 and (unicodedata.normalize("NFKD", k)[0] == k or k.isalpha()) for k in c)]
    assert column(spark, plain, t.fold) == [t.fold_string(c) for c in plain]
    assert column(spark, ["ﬁne Ⅳ ½"], t.fold_exact) == [t.fold_string("ﬁne Ⅳ ½")]


def test_sketches(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(400)]
    edited = list(words)
    edited[100], edited[300] = "x", "y"
    other = [f"v{i}" for i in range(400)]
    d = spark.createDataFrame([(" ".join(words), " ".join(edited), " ".join(other), "two words")], "a string, b string, c string, d string")
    s = d.select(*(t.signature(t.tokens(F.col(c))).alias(c) for c in "abcd"))
    got = s.select(*((t.sketch_shared(F.col("a"), F.col(x)) / F.size(t.sketch_union(F.col("a"), F.col(x)))).alias(x) for x in "bc"), F.col("d").isNull().alias("d")).first()
    assert got.b > 0.85 and got.c < 0.05 and got.d


def test_markup(spark):
    page = "<html lang='EN'><head><title>Tangsa &amp; Nocte</title><style>p{}</style></head><body><nav><a href='/x'>nav</a></nav><p>Tangsa &amp; Nocte</p><a href=\"b.pdf\"> B <i>ook</i></a><script>no()</script></body></html>"
    assert column(spark, [page], t.html_title, t.html_language) == [("Tangsa & Nocte", "en")]
    assert "Tangsa & Nocte" in column(spark, [page], t.html_text)[0] and "nav" not in column(spark, [page], t.html_text)[0]
    assert [(x.url, x.anchor) for x in column(spark, [page], t.html_links)[0]] == [("/x", "nav"), ("b.pdf", "B  ook")]
    assert column(spark, ['<meta name="Description" content="one"><meta property="description" content="two">'], t.html_meta) == [{"description": "two"}]
    assert column(spark, ["<a><ANNOTATION_VALUE>nga tangsa</ANNOTATION_VALUE><ANNOTATION_VALUE>hello</ANNOTATION_VALUE></a>"], lambda c: t.xml_text(c, "ANNOTATION_VALUE")) == ["nga tangsa\nhello"]
    assert column(spark, ["a\r\nb \t c\n\n\n d "], t.clean) == ["a\nb c\n d"]


def test_names_and_paths(spark):
    assert column(spark, ["/a/b/my file?.pdf", "...", None, "x" * 200 + ".txt"], t.safe_name) == ["my_file_.pdf", "file", "file", "x" * 116 + ".txt"]
    assert column(spark, ["Zhuang, Yongnan", "  "], t.safe_id) == ["zhuang-yongnan", "language"]
    assert column(spark, ['{"a":{"b":[{"c":1},{"c":2}]}}'], lambda c: t.path_get(c, "a.b[].c"), lambda c: t.path_get(c, "a.x")) == [("[1,2]", None)]
    assert column(spark, [512, 2048, 5 * 1024**3], t.human_bytes, kind="long") == ["512 B", "2.0 KB", "5.0 GB"]
    assert column(spark, [5.0, 65.0, 3700.0], t.human_time, kind="double") == ["5s", "1m 05s", "1h 01m"]


def test_urls(spark):
    assert column(spark, ["HTTPS://Example.org/a/?utm_source=x&b=1#frag", "http://a.b", "http://A.b/x//?ref=1"], web.normalise_url) == ["https://example.org/a?b=1", "http://a.b/", "http://a.b/x"]
    assert column(spark, ["http://a/b.pdf", "http://a/b.pdf?x=1", "http://a/b.html", "http://a/b?f=x.zip"], web.looks_like_file) == [True, True, False, True]
    assert column(spark, ["https://www.facebook.com/x", "https://a.org"], web.skip_host) == [True, False]
    assert column(spark, ["https://zenodo.org/records/12", "https://archive.org/details/x", "https://github.com/a/b/blob/main/c.txt", "https://a.org"], web.repository_kind) == ["zenodo", "internet_archive", "github_blob", None]
    assert [column(spark, [x], lambda c: web.resolve_url(F.lit("https://a.org/d/e.html"), c))[0] for x in ("f.html", "/g", "//h.org/i", "mailto:x", "#j")] == ["https://a.org/d/f.html", "https://a.org/g", "https://h.org/i", "mailto:x", "https://a.org/d/e.html#j"]
    name = lambda c: web.response_filename(F.lit("https://z.org/records/1/files/My%20file.pdf/content"), c)
    assert column(spark, [None, 'attachment; filename="a b.txt"', "attachment; filename*=UTF-8''n%C3%A4me.txt; filename=x"], name) == ["My file.pdf", "a b.txt", "näme.txt"]
    assert web.iri_to_uri("http://bücher.de/ä b?q=ü") == "http://xn--bcher-kva.de/%C3%A4%20b?q=%C3%BC"


def test_matching(spark):
    rows = [("x changlang y", "chang"), ("x changlang y", "changlang"), ("prechanglangs", "changlang"), ("ab", "ab"), ("the naga hills", "naga")]
    d = spark.createDataFrame(rows, "b string, t string")
    assert [r[0] for r in d.select(match.has_term(F.col("b"), F.col("t"))).collect()] == [False, True, True, False, True]
    pair = lambda f, x, y: spark.createDataFrame([(x, y)], "x string, y string").select(f(F.col("x"), F.col("y"))).first()[0]
    assert pair(match.language_context, "speakers of Even live here", "Even") and not pair(match.language_context, "even the speakers", "Even")
    assert not pair(match.language_context, "Even" + " x" * 40 + " language", "Even")
    for text in ("Aus bus Zhuang W. Y.", "Zhuang & Wang described it", "species X (Zhuang, 2015)", "named by Zeng & Zhuang", "Zhuang et al. found"):
        assert pair(match.only_author, text, "Zhuang"), text
    for text in ("the Zhuang language", "How Standard Zhuang has Met with Market Forces in China", "none"):
        assert not pair(match.only_author, text, "Zhuang"), text
    assert column(spark, ["long an", "long tangsa", ""], match.common_words_only) == [True, False, False]
    assert pair(match.proper_noun, "in Long An county", "Long An") and not pair(match.proper_noun, "so long an hour", "Long An")


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (entered.speakers, "~8500", '{"value":8500,"approximate":true}'), (entered.speakers, "8,000-9,000", '{"min":8000,"max":9000}'), (entered.speakers, "12,000", "12000"), (entered.speakers, "few", '{"text":"few"}'), (entered.speakers, "", None),
        (entered.state, "yes - ELAR deposit", '{"state":"yes","detail":"ELAR deposit"}'), (entered.state, "No", '{"state":"no"}'), (entered.state, "?", '{"state":"unknown"}'), (entered.state, "tapes", '{"state":"reported","detail":"tapes"}'), (entered.state, " ", None),
        (entered.tagged, "Hindi (lingua franca), Assamese: regional, Nocte", '[{"name":"Hindi","role":"lingua franca"},{"name":"Assamese","role":"regional"},{"name":"Nocte"}]'),
        (entered.places, "Changlang, district, Arunachal Pradesh, India", '[{"name":"Changlang","type":"district","region":"Arunachal Pradesh","country":"India"}]'),
    ],
)
def test_entered_values(spark, f, given, want):
    assert column(spark, [given], f) == [want]


def test_entered_choices(spark):
    options = ("strong", "not_transmitted")
    assert column(spark, ["2", "Not transmitted", "other", "", "99999999999"], lambda c: entered.choice(c, options)) == ["not_transmitted", "not_transmitted", "other", None, "99999999999"]
    assert column(spark, ["1, 4; weddings\n"], entered.entries) == [["1", "4", "weddings"]]
