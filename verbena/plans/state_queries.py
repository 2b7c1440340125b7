"""Queries over events, labels and pages as facts of changing tables, proposals and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions import web
from verbena.functions.text import html_links, html_meta, html_title, safe_name
from verbena.operators import discover, profile, state
from verbena.plans.base import Register, sql_strip, sql_unescape, table
from verbena.plans.core_queries import _VALUES, _values

R = Register()


@R.query("SELECT user_id AS id, arg_max('n' || event_id, event_id) AS name, min(ts) AS created_at FROM events GROUP BY user_id")
def language_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return state.languages(e.select(F.col("user_id").alias("id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq")))


@R.query("SELECT 'h' || user_id AS sha256, min(event_id) AS seq FROM events WHERE user_id % 2 <> 0 GROUP BY user_id")
def new_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("sha256"), "user_id", F.col("event_id").alias("seq"))
    return state.new_resources(e.select("sha256", "seq"), e.where("user_id % 2 = 0"))


@R.query("""WITH p AS (SELECT user_id AS a, user_id + 1 AS b, value, event_id FROM events), s AS (SELECT a, b, value, event_id FROM p UNION ALL SELECT b, a, value, event_id FROM p)
SELECT a AS resource_id, b AS other_id, arg_max(value, event_id) AS similarity FROM s GROUP BY ALL""")
def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return state.near_duplicates(e.select(F.col("user_id").alias("resource_id"), (F.col("user_id") + 1).alias("other_id"), F.col("value").alias("similarity"), F.col("event_id").alias("seq")))


@R.query("SELECT user_id AS resource_id, event_type AS type, event_id % 2 AS source, max(value) AS confidence FROM events GROUP BY ALL")
def resource_type_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return state.resource_types(e.select(F.col("user_id").alias("resource_id"), F.col("event_type").alias("type"), (F.col("event_id") % 2).alias("source"), F.col("value").alias("confidence")))


@R.query("""WITH d AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'skipped' END) AS decision FROM labels GROUP BY doc_id)
SELECT coalesce(decision, 'pending') AS status, count(*) AS n FROM documents LEFT JOIN d USING (doc_id) GROUP BY ALL""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    decided = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("skipped").alias("decision"), F.lit(1).alias("seq"))
    return state.review_items(items, decided).groupBy("status").agg(F.count("*").alias("n"))


@R.query(f"""WITH {_VALUES}, k AS (SELECT DISTINCT language_id, grp, field, val FROM v WHERE status = 'accepted')
SELECT DISTINCT language_id, grp, field, val FROM v WHERE status = 'proposed' AND (language_id, grp, field, val) NOT IN (SELECT * FROM k)""")
def unknown_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir)
    new = profile.unknown_proposals(v.where("status = 'proposed'"), v)
    return new.select("language_id", "grp", "field", F.get_json_object("value_json", "$[0]").alias("val"))


_SIZES = ", ".join(f"('{g}', {sum(f.grp == g for f in profile.fields())})" for g in dict.fromkeys(f.grp for f in profile.fields()))


_SETTLED = f"""{_VALUES}, acc AS (SELECT * FROM v WHERE status = 'accepted'),
a AS (SELECT language_id, grp, field, count(DISTINCT val) AS n, bool_or(preferred) AS settled FROM acc GROUP BY ALL),
p AS (SELECT language_id, grp, field, confidence FROM (SELECT *, row_number() OVER (PARTITION BY language_id, grp, field ORDER BY preferred DESC, CASE WHEN preferred THEN seq END, confidence DESC, recorded_at DESC, seq) AS k FROM acc) WHERE k = 1),
settled AS (SELECT language_id, grp, field FROM a JOIN p USING (language_id, grp, field) WHERE NOT (n > 1 AND NOT settled AND field = 'speakers') AND confidence >= 0.6)"""
_FIELDS = ", ".join(f"('{f.grp}', '{f.name}', {i})" for i, f in enumerate(profile.fields()))


@R.query(f"""WITH {_SETTLED} SELECT language_id, CAST(ord AS INTEGER) AS ord, grp, field FROM (SELECT DISTINCT user_id AS language_id FROM events) CROSS JOIN (VALUES {_FIELDS}) t(grp, field, ord) ANTI JOIN settled USING (language_id, grp, field)""")
def profile_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields to ask for, of every language."""
    v = _values(spark, sf_dir)
    return profile.questions(profile.field_states(v, v.select("language_id"))).select("language_id", "ord", "grp", "field")


@R.query(f"""WITH {_SETTLED}, k AS (SELECT language_id, grp, count(*) AS known FROM settled GROUP BY ALL), g AS (SELECT * FROM (VALUES {_SIZES}) t(grp, total)), l AS (SELECT DISTINCT user_id AS language_id FROM events)
SELECT grp, CASE WHEN coalesce(known, 0) = total THEN 'done' WHEN coalesce(known, 0) > 0 THEN 'partial' ELSE 'empty' END AS state, count(*) AS n FROM l CROSS JOIN g LEFT JOIN k USING (language_id, grp) GROUP BY ALL""")
def profile_group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir)
    return profile.group_states(profile.field_states(v, v.select("language_id"))).groupBy("grp", "state").agg(F.count("*").alias("n"))


_LINK = "(?is)<a\\b[^>]*?\\bhref=[\"'']([^\"'']+)[\"''][^>]*>.*?</a>"


@R.query(rf"""WITH l AS (SELECT page_id, trim(url) AS base, unnest(range(0, len(regexp_extract_all(html, '{_LINK}', 1)))) AS n, trim(unnest(regexp_extract_all(html, '{_LINK}', 1))) AS link FROM pages),
p AS (SELECT *, regexp_extract(base, '^([a-z]+)://', 1) AS scheme, regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM l)
SELECT page_id, n, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || host || link
WHEN starts_with(link, '#') OR link = '' THEN scheme || '://' || host || path || link ELSE scheme || '://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS target FROM p""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.btrim("url").alias("base"), F.posexplode(html_links(F.col("html"))).alias("n", "l"))
    return p.select("page_id", F.col("n").cast("long").alias("n"), web.resolve_url(F.col("base"), F.col("l.url")).alias("target"))


_HOSTS = ("https://zenodo.org/records/{n}", "https://zenodo.org/api/records/{n}/files", "https://zenodo.org/record/{n}", "https://zenodo.org/search?q={n}", "https://archive.org/details/x{n}/y", "http://archive.org/download/{n}?a=1", "https://archive.org/search/{n}", "https://github.com/a/b{n}/blob/main/c.txt", "https://github.com/a/b{n}/tree/main")


@R.query(rf"""WITH u AS (SELECT page_id, replace(list_extract([{', '.join(repr(h) for h in _HOSTS)}, url], (page_id % {len(_HOSTS) + 1} + 1)::INTEGER), '{{n}}', page_id::VARCHAR) AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, 'zenodo\.org/(records?|api/records)/\d+') THEN 'zenodo' WHEN regexp_matches(u, 'archive\.org/(details|download)/[^/?#]+') THEN 'internet_archive' WHEN regexp_matches(u, 'github\.com/[^/]+/[^/]+/blob/') THEN 'github_blob' END AS kind FROM u""")
def repository_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.replace(F.get(F.array(*map(F.lit, _HOSTS), F.col("url")), (F.col("page_id") % (len(_HOSTS) + 1)).cast("int")), F.lit("{n}"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", web.repository_kind(url).alias("kind"))


_SAFE = r"regexp_replace(regexp_replace(regexp_replace(raw, '^.*[/\\]', ''), '[^\p{L}\p{N}_.\- ]+', '_', 'g'), '\s+', '_', 'g')"


@R.query(rf"""WITH r AS (SELECT page_id, '/a b/' || page_id || '\' || substr({sql_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, 300) || repeat('x', (page_id % 4 * 40)::INTEGER) || CASE WHEN page_id % 5 > 0 THEN '.pdf' ELSE '' END AS raw FROM pages),
b AS (SELECT page_id, CASE WHEN trim({_SAFE}, '._') = '' THEN 'file' ELSE trim({_SAFE}, '._') END AS base FROM r)
SELECT page_id, CASE WHEN len(base) <= 120 THEN base ELSE left(base, 120 - len(regexp_extract(base, '(\.[^.]{{1,12}})$', 1))) || regexp_extract(base, '(\.[^.]{{1,12}})$', 1) END AS name FROM b""")
def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages as file names."""
    raw = F.concat(F.lit("/a b/"), F.col("page_id").cast("string"), F.lit("\\"), html_title(F.col("html")), F.repeat(F.lit("x"), (F.col("page_id") % 4 * 40).cast("int")), F.when(F.col("page_id") % 5 > 0, ".pdf").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", safe_name(raw).alias("name"))


_META = "(?is)<meta\\b[^>]*?\\b(?:name|property)=[\"'']([^\"'']+)[\"''][^>]*?\\bcontent=[\"'']([^\"'']*)[\"'']"
_SHOWN = "html || '<meta name=\"Page\" content=\"a &amp; ' || page_id || '\"><meta property=\"og:x\" content=\"one\"><META NAME=\"page\" content=\"b' || page_id || '\"><meta name=\"none\" content=\"\">'"


@R.query(rf"""WITH p AS (SELECT page_id, {_SHOWN} AS h FROM pages),
m AS (SELECT page_id, unnest(range(0, len(regexp_extract_all(h, '{_META}')))) AS n, lower(unnest(regexp_extract_all(h, '{_META}', 1))) AS key, substr({sql_unescape(f"unnest(regexp_extract_all(h, '{_META}', 2))")}, 1, 500) AS value FROM p)
SELECT page_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY n DESC) AS k FROM m WHERE value <> '') WHERE k = 1""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages' meta elements say, the last of a name, with a few more of them put in."""
    i = F.col("page_id").cast("string")
    more = F.concat(F.lit('<meta name="Page" content="a &amp; '), i, F.lit('"><meta property="og:x" content="one"><META NAME="page" content="b'), i, F.lit('"><meta name="none" content="">'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html_meta(F.concat("html", more))).alias("key", "value"))


@R.query("""WITH f AS (SELECT page_id % 9 AS record_id, url, CASE WHEN page_id % 5 > 0 THEN page_id * 7919 % 1000 END AS size, row_number() OVER (PARTITION BY page_id % 9 ORDER BY page_id) - 1 AS n FROM pages)
SELECT record_id, n FROM f WHERE n < 20 AND (size IS NULL OR size <= 500)""")
def wanted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "pages")
    place = F.row_number().over(Window.partitionBy(F.col("page_id") % 9).orderBy("page_id")) - 1
    f = p.select((F.col("page_id") % 9).alias("record_id"), "url", F.when(F.col("page_id") % 5 > 0, F.col("page_id") * 7919 % 1000).alias("size"), place.cast("long").alias("n"))
    return discover.wanted_files(f, most_bytes=500, most_files=20).select("record_id", "n")
