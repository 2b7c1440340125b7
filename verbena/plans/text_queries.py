"""Queries over texts and pages: the functions of functions/text.py and functions/web.py at work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbena.functions import text as t
from verbena.functions import web
from verbena.plans.base import Register, sql_clean, sql_fold, sql_strip, sql_unescape, table

R = Register()

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_SHINGLES = "list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i : i + 4], ' '))[1:16])"
_SIGNATURE = f"CASE WHEN len(w) >= 20 THEN list_sort(list_distinct({_SHINGLES}))[1:128] END"
_URL = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


@R.query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.fold(F.col("text")).alias("folded"))


@R.query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(CASE WHEN len(w) >= 5 THEN len(list_distinct({_SHINGLES})) ELSE 0 END AS BIGINT) AS n_shingles FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def token_and_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct(t.shingle_hashes(F.col("w")))).cast("long").alias("n_shingles"))


@R.query(f"SELECT doc_id, array_to_string({_SIGNATURE}, ',') AS sketch FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.array_join(t.signature(F.col("w")), ",").alias("sketch"))


@R.query(r"""
SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty'
WHEN len(regexp_replace(s, '[^\p{L}]', '', 'g')) / greatest(len(s), 1) < 0.4 OR NOT regexp_matches(s, '[ \n]') OR len(regexp_extract_all(s, '[A-Za-z]{3,}')) <= 20 THEN 'low' ELSE 'ok' END AS quality
FROM (SELECT doc_id, text, coalesce(text, '') AS s FROM documents)""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.text_quality(F.col("text"), sample=None).alias("quality"))


@R.query(rf"""SELECT source, {sql_fold('name')} AS folded, name, CASE WHEN f = '' THEN 'language' ELSE f END AS id
FROM (SELECT DISTINCT source, 'The ' || source || ' Héritage/Col.' AS name, trim(regexp_replace({sql_fold("'The ' || source || ' Héritage/Col.'")}, '[^a-z0-9]+', '-', 'g'), '-') AS f FROM documents)""")
def safe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct().withColumn("name", F.concat(F.lit("The "), "source", F.lit(" Héritage/Col.")))
    return d.select("source", t.fold(F.col("name")).alias("folded"), "name", t.safe_id(F.col("name")).alias("id"))


_HTML = r"regexp_replace(coalesce(html, ''), '(?is)<head\b.*?</head>', ' ', 'g')"
for _tag in t.HIDDEN:
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?i)<(?:br|p|div|li|h[1-6]|tr)\b[^>]*>', chr(10), 'g')"
_HTML = sql_clean(sql_unescape(rf"regexp_replace({_HTML}, '(?s)<[^>]+>', ' ', 'g')"))
_LINK = "(?is)<a\\b[^>]*?\\bhref=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>"


@R.query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.html_text(F.col("html")).alias("text"))


@R.query(rf"""SELECT page_id, substr({sql_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, 300) AS title,
nullif(lower(regexp_extract(html, '(?i)<html[^>]*\blang=["'']([^"'']+)["'']', 1)), '') AS lang, CAST(len(regexp_extract_all(html, '{_LINK}')) AS BIGINT) AS n_links FROM pages""")
def html_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", t.html_title(h).alias("title"), t.html_language(h).alias("lang"), F.size(t.html_links(h)).cast("long").alias("n_links"))


@R.query(f"""SELECT page_id, trim(u) AS link, substr({sql_strip('a')}, 1, 200) AS anchor, n FROM
(SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS u, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS a, unnest(range(0, len(regexp_extract_all(html, '{_LINK}')))) AS n FROM pages)""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", F.posexplode(t.html_links(F.col("html"))).alias("n", "l"))
    return d.select("page_id", F.col("l.url").alias("link"), F.col("l.anchor").alias("anchor"), F.col("n").cast("long").alias("n"))


_PARTS = "".join(f", regexp_extract(trim(u), '{_URL}', {i}) AS {n}" for i, n in enumerate(("scheme", "host", "path", "query"), 1))


@R.query(rf"""SELECT page_id, lower(scheme) || CASE WHEN scheme = '' THEN '' ELSE '://' END || lower(host) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url
FROM (SELECT *, regexp_replace(path, '/+$', '') AS p, array_to_string(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(x, '^(utm_|fbclid|ref)')), '&') AS q
FROM (SELECT page_id{_PARTS} FROM (SELECT page_id, upper(url) || '/?utm_source=x&b=1&c=&ref=z#frag' AS u FROM pages)))""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.upper("url"), F.lit("/?utm_source=x&b=1&c=&ref=z#frag"))
    return table(spark, sf_dir, "pages").select("page_id", web.normalise_url(noisy).alias("url"))


@R.query(rf"""SELECT page_id, lower(host) AS host, regexp_matches(path || CASE WHEN query = '' THEN '' ELSE '?' || query END, '(?i)\.({web.FILE_EXTENSIONS})($|\?)') AS is_file,
list_has_any([true], list_transform([{", ".join(repr(s) for s in web.SKIPPED_HOSTS)}], lambda s: contains(lower(host), s))) AS skipped
FROM (SELECT page_id{_PARTS} FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/a.PDF?x=1' WHEN 1 THEN 'https://www.facebook.com/' || page_id WHEN 2 THEN url || '.tar.gz' ELSE url END AS u FROM pages))""")
def url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.concat("url", F.lit("/a.PDF?x=1"))).when(k == 1, F.concat(F.lit("https://www.facebook.com/"), F.col("page_id").cast("string"))).when(k == 2, F.concat("url", F.lit(".tar.gz"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", web.host(u).alias("host"), web.looks_like_file(u).alias("is_file"), web.skip_host(u).alias("skipped"))


@R.query(rf"""SELECT host, page_id, rank FROM (SELECT page_id, lower(regexp_extract(trim(url), '{_URL}', 2)) AS host, row_number() OVER (PARTITION BY lower(regexp_extract(trim(url), '{_URL}', 2)) ORDER BY page_id) AS rank FROM pages) WHERE rank <= 6""")
def pages_per_host_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy("page_id")).cast("long")).where("rank <= 6")


@R.query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    return d.select("event_id", t.path_get(F.col("props"), "k").try_cast("long").alias("k"), t.path_get(F.col("props"), "missing").alias("missing"))


@R.query("""SELECT page_id, sha256('text/html' || url)[1:32] AS key, CASE WHEN length(html) < 1024 THEN length(html) || ' B' ELSE printf('%.1f KB', length(html) / 1024.0) END AS size FROM pages""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.cache_key(F.lit("text/html"), F.col("url")).alias("key"), t.human_bytes(F.length("html")).alias("size"))
