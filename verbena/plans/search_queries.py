"""Searches in rounds over the table of pages as the web, decisions of reviewers, a kept index, many terms, and ingest with keyed state, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions import web
from verbena.functions.text import fold, html_links, html_title, page_text
from verbena.operators import discover, neardup, search, state
from verbena.operators.sketchindex import SketchIndex
from verbena.operators.termscan import term_hits
from verbena.plans.base import Register, sql_fold, table
from verbena.plans.catalogue_queries import _TITLE, _WHOLE
from verbena.plans.core_queries import _SKETCH
from verbena.plans.operator_queries import _sql_addresses
from verbena.session import release, shared_folder, written
from verbena.sources import store
from verbena.streaming import keyed

R = Register()

#: The language that the search is for, and the names known before it.
LANGUAGE = [("tho", "qqx", "Thtion")]
ALTERNATES = ("Attion", "Retion", "Thanea", "Eriner")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _title(html: Column) -> Column:
    return F.substring(html_title(html), 1, 300)


def _index(pages: DataFrame) -> DataFrame:
    """page_id, url, key, title, blob (the folded text, a blank at each end) of all pages: each is parsed once, whatever asks for it later."""
    blob = F.concat(F.lit(" "), fold(page_text(F.col("html"), most=None)), F.lit(" "))
    return written(pages.select("page_id", "url", web.normalise_url(F.col("url")).alias("key"), _title(F.col("html")).alias("title"), blob.alias("blob")), "search-index")


def _engine(index: DataFrame):  # noqa: ANN202
    """A search engine over pages: the quoted words of a query, as whole words in a page's text, the least page first."""

    def ask(asked: DataFrame) -> DataFrame:
        quoted = asked.select("query_id", F.concat(F.lit(" "), fold(F.regexp_extract("query", '"([^"]+)"', 1)), F.lit(" ")).alias("phrase")).where("phrase <> '  '")
        met = index.join(F.broadcast(quoted), F.contains("blob", "phrase"))  # SearchLimits.queries bounds them
        return met.select("query_id", F.col("page_id").alias("n"), "url", "title")

    return ask


def _reader(pages: DataFrame, index: DataFrame):  # noqa: ANN202
    """Pages by their key, of several the least page: found in the index, and only those that are asked for are parsed."""

    def fetch(asked: DataFrame) -> DataFrame:
        first = index.select("key", "page_id").join(F.broadcast(asked.select("key")), "key").groupBy("key").agg(F.min("page_id").alias("page_id"))  # SearchLimits.pages bounds them
        html = pages.select("page_id", "html", web.normalise_url(F.col("url")).alias("key")).join(F.broadcast(first), ["page_id", "key"])
        one = html.groupBy("key").agg(F.first("html").alias("html"))
        return asked.join(one.select("key", _title(F.col("html")).alias("title"), page_text(F.col("html"), most=None).alias("text"), html_links(F.col("html")).alias("links")), "key")

    return fetch


def _teacher(index: DataFrame):  # noqa: ANN202
    """Facts from pages: the first long word of a title is an alternate name."""

    def learn(about: DataFrame) -> DataFrame:
        word = F.regexp_extract("title", "[A-Za-z]{8,}", 0)
        few = F.broadcast(about.select("key").distinct())
        titles = index.select("key", "page_id", "title").join(few, "key").groupBy("key").agg(F.min_by("title", "page_id").alias("title"))
        t = about.select("key").join(titles, "key").select("key", F.lit("identity").alias("grp"), F.lit("alternate_names").alias("field"), word.alias("value"), F.lit(0.55).alias("confidence"), F.col("title").alias("quote"))
        return t.where("value <> ''")

    return learn


def found(spark: SparkSession, sf_dir: str, limits: search.SearchLimits | None = None) -> search.Found:
    pages = _pages(spark, sf_dir)
    index = _index(pages)
    languages = spark.createDataFrame(LANGUAGE, "language_id string, iso string, name string")
    terms = spark.createDataFrame([("tho", "alternate_name", i, t, False) for i, t in enumerate(ALTERNATES)], "language_id string, signal string, seq int, term string, weak boolean")
    named = spark.createDataFrame([("tho", "Thtion", "name", "Thtion", 0), *(("tho", "Thtion", "alternate_name", t, i) for i, t in enumerate(ALTERNATES))], "language_id string, name string, kind string, term string, seq int")
    out = search.search_rounds(discover.search_queries(named), _engine(index), _reader(pages, index), languages, terms, learn=_teacher(index), limits=limits or search.SearchLimits(depth=1))
    release(index)  # what a search found is written: nothing reads the index any more
    return out


def _sql_hit(text: str, f: str) -> str:
    return f"(contains(' ' || {text} || ' ', ' ' || {f} || ' ') OR (len({f}) >= 8 AND contains({text}, {f})))"


def _sql_score(name: str, terms: str, pages: str) -> str:
    """CTEs: key and score of pages, by terms (f, signal)."""
    force = "CASE WHEN signal = 'exact_name' THEN 1.0 WHEN len(f) <= 4 THEN 0.6 WHEN len(f) = 5 THEN 0.8 ELSE 1.0 END"
    return f"""{name}m AS (SELECT key, signal, {force} AS force, {_sql_hit('said', 'f')} AS hit, {_sql_hit('inside', 'f')} AS read FROM {pages} CROSS JOIN {terms}),
{name}s AS (SELECT key, signal, max(CASE WHEN hit THEN force END) AS force, count(*) FILTER (WHERE hit) AS n, bool_or(read) AS read FROM {name}m GROUP BY key, signal),
{name} AS (SELECT key, CAST(round_even(least(100.0, sum(CASE WHEN n = 0 THEN 0 ELSE (CASE signal WHEN 'exact_name' THEN 70 ELSE 55 END) * (force + CASE WHEN n > 1 THEN 0.25 ELSE 0 END) END) + CASE WHEN bool_or(read) THEN 30 ELSE 0 END), 0) AS INTEGER) AS score FROM {name}s GROUP BY key)"""


def _sql_crawl(name: str, phrases: str, before: str | None) -> str:
    """CTEs: the pages that a round visits for its phrases (f)."""
    been = f"LEFT JOIN (SELECT host, count(*) AS been FROM {before} GROUP BY host) USING (host)" if before else "CROSS JOIN (SELECT 0 AS been)"
    new = f"WHERE key NOT IN (SELECT key FROM {before})" if before else ""
    return f"""{name}h AS (SELECT f, key, min(page_id) AS n, arg_min(url, page_id) AS url FROM (SELECT f FROM {phrases}) JOIN pg ON contains(' ' || inside || ' ', ' ' || f || ' ') WHERE fit GROUP BY f, key),
{name}t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n, key) AS k FROM {name}h) WHERE k <= 8),
{name}c AS (SELECT key, min(url) AS url, min(host) AS host FROM (SELECT key, url, p.host FROM {name}t t JOIN (SELECT DISTINCT url, host FROM pg) p USING (url)) {new} GROUP BY key),
{name}r AS (SELECT key, url, host, row_number() OVER (PARTITION BY host ORDER BY key) AS k, coalesce(been, 0) AS been FROM (SELECT c.* FROM {name}c c JOIN (SELECT DISTINCT url, file FROM pg) USING (url) WHERE NOT file) {been}),
{name} AS (SELECT key, url, host, title, text, {sql_fold("url || ' ' || title")} AS said, {sql_fold('text')} AS inside FROM (SELECT * FROM {name}r WHERE k + been <= 6 ORDER BY k, key LIMIT 40) JOIN web USING (key))"""


def _sql_learn(name: str, scores: str, pages: str, terms: str, before: str) -> str:
    """CTEs: names (f, value, key) that a round learns from sure pages about the language."""
    names = f"SELECT f FROM (SELECT f, row_number() OVER (ORDER BY CASE signal WHEN 'exact_name' THEN 0 ELSE 1 END, f) AS k FROM {terms}) WHERE k <= 7"
    opening = sql_fold("title || ' ' || left(text, 600)")
    return f"""{name}a AS (SELECT DISTINCT key, regexp_extract(title, '[A-Za-z]{{8,}}') AS value FROM (SELECT p.key, title, {opening} AS o FROM {pages} p JOIN {scores} USING (key) WHERE score >= 70) JOIN ({names}) ON len(f) >= 3 AND {_sql_hit('o', 'f')}),
{name} AS (SELECT lower(value) AS f, min(key) AS key FROM {name}a WHERE value <> '' AND lower(value) NOT IN (SELECT f FROM {terms}) GROUP BY lower(value) ORDER BY min(key), f LIMIT (12 - {before}))"""


_SEARCH = rf"""WITH {_sql_addresses("SELECT DISTINCT url AS u FROM pages", "n1")},
pg AS (SELECT page_id, url, key, host, fit, file, substr({_TITLE}, 1, 300) AS title, {_WHOLE} AS text, {sql_fold(_WHOLE)} AS inside FROM pages JOIN n1 ON u = url),
web AS (SELECT key, arg_min(title, page_id) AS title, arg_min(text, page_id) AS text FROM pg GROUP BY key),
t0 AS (SELECT * FROM (VALUES ('thtion', 'exact_name'), {", ".join(f"('{a.lower()}', 'alternate_name')" for a in ALTERNATES)}) t(f, signal)),
{_sql_crawl('v1', 't0', None)},
{_sql_score('s1', 't0', 'v1')},
{_sql_learn('l1', 's1', 'v1', 't0', '0')},
t1 AS (SELECT * FROM t0 UNION ALL SELECT f, 'alternate_name' FROM l1),
{_sql_crawl('v2', 'l1', 'v1')},
v AS (SELECT *, 1 AS round FROM v1 UNION ALL SELECT *, 2 FROM v2),
{_sql_score('s2', 't1', 'v')},
{_sql_learn('l2', 's2', 'v', 't1', '(SELECT count(*) FROM l1)')},
t2 AS (SELECT * FROM t1 UNION ALL SELECT f, 'alternate_name' FROM l2),
{_sql_score('s3', 't2', 'v')}"""


@R.query(_SEARCH + " SELECT key, round, CASE round WHEN 1 THEN s1.score ELSE s2.score END AS first_score, s3.score AS last_score FROM v JOIN s2 USING (key) JOIN s3 USING (key) LEFT JOIN s1 USING (key)")
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds: pages with the score when they were visited, and with all names learned since."""
    f = found(spark, sf_dir)
    own = f.scores.groupBy("key").agg(F.min_by("score", "round").alias("first_score"))
    return f.pages.select("key", "round").join(own, "key").join(f.last_scores().withColumnRenamed("score", "last_score"), "key")


@R.query(_SEARCH + " SELECT f AS name, key, 1 AS round FROM l1 UNION ALL SELECT f, key, 2 FROM l2")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that the rounds taught, and the page that taught each."""
    return found(spark, sf_dir).learned.select(F.lower("value").alias("name"), "key", "round")


_DECISION = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'skipped' END"


@R.query(f"""WITH v AS (SELECT doc_id AS seq, 'L' || doc_id % 7 AS language_id, 'quality' AS field, CAST(doc_id // 7 % 11 AS VARCHAR) AS val, CASE WHEN quality = 1 THEN 'accepted' ELSE 'proposed' END AS status FROM labels),
d AS (SELECT 'L' || user_id % 7 AS language_id, CAST(event_id % 11 AS VARCHAR) AS val, {_DECISION} AS decision, event_id // 9 AS told, event_id FROM events WHERE event_type IN ('purchase', 'error', 'view')),
m AS (SELECT v.seq, arg_max(decision, (told, event_id)) AS decided FROM v JOIN d USING (language_id, val) WHERE told > v.seq AND decision <> 'skipped' GROUP BY v.seq)
SELECT v.seq AS doc_id, language_id, val, coalesce(decided, status) AS status FROM v LEFT JOIN m USING (seq)""")
def decided_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with the decisions of reviewers on them: accepted, rejected, skipped, and changes of mind."""
    label, e = table(spark, sf_dir, "labels"), table(spark, sf_dir, "events")
    slot = lambda n: (F.concat(F.lit("L"), n % 7).alias("language_id"), F.lit("identity").alias("grp"), F.lit("quality").alias("field"))
    text = lambda n: F.concat(F.lit('"'), n.cast("string"), F.lit('"')).alias("value_json")
    order = lambda a, b: (a * 1_000_000_000 + b).alias("seq")
    v = label.select("doc_id", *slot(F.col("doc_id")), text(F.floor(F.col("doc_id") / 7) % 11), F.when(F.col("quality") == 1, "accepted").otherwise("proposed").alias("status"), order(F.col("doc_id") + 1, F.lit(-1)))
    said = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("skipped")
    d = e.where(F.col("event_type").isin("purchase", "error", "view")).select(*slot(F.col("user_id")), text(F.col("event_id") % 11), said.alias("decision"), order(F.floor(F.col("event_id") / 9), F.col("event_id")))
    return state.decided_values(v, d).select("doc_id", "language_id", F.get_json_object(F.concat(F.lit("["), "value_json", F.lit("]")), "$[0]").alias("val"), "status")


@R.query(f"""WITH d AS (SELECT user_id, arg_max({_DECISION}, event_id) AS decided FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT doc_id, CASE decided WHEN 'accepted' THEN 'confirmed' WHEN 'rejected' THEN 'rejected' ELSE CASE WHEN quality = 0 THEN 'uncertain' ELSE 'confirmed' END END AS status FROM labels LEFT JOIN d ON user_id = doc_id""")
def decided_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources with what reviewers last said of them."""
    held = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("sha256"), F.lit("tho").alias("language_id"), F.when(F.col("quality") == 0, 40).otherwise(90).alias("score"))
    said = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("skipped")
    d = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sha256"), F.lit("tho").alias("language_id"), said.alias("decision"), F.col("event_id").alias("seq"))
    return state.decided_resources(held, d).select("doc_id", "status")


@R.query(rf"""WITH {_SKETCH},
node AS (SELECT s, sha256(array_to_string(s, ',')) AS node, bool_and(doc_id % 5 = 0) AS fresh FROM (SELECT doc_id, s FROM sig) GROUP BY s),
p AS (SELECT node, s, fresh, unnest(s[1:20]) AS h FROM node),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.h = b.h AND a.node < b.node AND (a.fresh OR b.fresh)),
m AS (SELECT a, b, x.s AS sa, y.s AS sb, list_sort(list_distinct(list_concat(x.s, y.s)))[1:128] AS u FROM pairs JOIN node x ON x.node = a JOIN node y ON y.node = b)
SELECT a, b, shared, size FROM (SELECT a, b, CAST(len(list_intersect(list_intersect(u, sa), sb)) AS BIGINT) AS shared, CAST(len(u) AS BIGINT) AS size FROM m) WHERE shared * 100 >= size * 85""")
def second_intake_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept index takes in four fifths of the documents, then the rest: near pairs of the second intake, by sketch."""
    index = SketchIndex(spark, f"{shared_folder(spark)}/verbena-index-{uuid.uuid4().hex}")
    sketches = written(neardup.signatures(table(spark, sf_dir, "documents"), "doc_id"), "sketches")  # two intakes read it
    index.add(sketches.where("id % 5 <> 0"))
    return index.add(sketches.where("id % 5 = 0")).select("a", "b", "shared", "size")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


@R.query(f"""WITH t AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT {_WORDS} AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
SELECT doc_id, count(*) AS n, min(term) AS first_term, max(term) AS last_term FROM d JOIN t USING (term) GROUP BY doc_id""")
def many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of neighbouring words of the benchmark as terms, looked for in whole documents."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))
    terms = table(spark, sf_dir, "benchmark").select(words.alias("w")).where("size(w) > 1").select(pair.alias("folded"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("blob"))
    hits = term_hits(texts, "doc_id", ["blob"], terms).where("whole")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("folded").alias("first_term"), F.max("folded").alias("last_term"))


@R.query("""WITH c AS (SELECT doc_id, source, sha256(text) AS sha, CASE WHEN doc_id % 5 = 0 THEN 'rejected' WHEN doc_id % 5 < 3 THEN 'uncertain_review' ELSE 'stored' END AS own FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, min(CASE WHEN own <> 'rejected' THEN doc_id END) OVER (PARTITION BY sha) AS owner FROM c)
SELECT coalesce(source, '') AS session_id, CASE WHEN own <> 'rejected' AND owner <> doc_id THEN 'duplicate_linked' ELSE own END AS status, count(*) AS n FROM o GROUP BY ALL""")
def keyed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream through keyed state: counters of each session, from changes alone."""
    fields = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(fields).parquet(f"{sf_dir}/documents*.parquet").where("text IS NOT NULL")
    own = keyed.own_status(F.element_at(F.array(*map(F.lit, (10, 50, 50, 90, 90))), (F.col("doc_id") % 5 + 1).cast("int")))
    rows = stream.select(F.sha2("text", 256).alias("sha256"), F.format_string("%020d", "doc_id").alias("candidate_id"), F.coalesce("source", F.lit("")).alias("session_id"), F.col("doc_id").alias("seq"), own.alias("own"))
    return keyed.counters(keyed.run(spark, rows, f"{shared_folder(spark)}/verbena-keyed-{uuid.uuid4().hex}"))


@R.query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size, doc_id || '.txt' AS name FROM documents WHERE text IS NOT NULL")
def committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as files written in two steps, and read back."""
    store.register(spark)
    place = f"{shared_folder(spark)}/verbena-store-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    files = d.select(F.sha2("text", 256).alias("sha256"), F.concat("doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.to_json(F.struct("source", "lang")).alias("about"))
    files.write.format(store.NAME).mode("append").save(place)
    read = spark.read.format(store.NAME).load(place)
    return read.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "name")
