"""Queries over pages and events as catalogue records, contents of files, and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions.text import PAGE_HIDDEN, html_title, page_text
from verbena.operators import catalogues, registry
from verbena.plans import core_queries
from verbena.plans.base import Register, sql_clean, sql_fold, sql_strip, sql_unescape, table

R = Register()

_CONTENT = [(0, "Thonin", "name", 0.9), (1, "en", "iso_code", 0.85), (2, "Erheon", "variety", 0.75), (3, "Ciudad", "place", 0.45), (4, "Schaft", "alternate_name", 0.8)]
_TERMS = ", ".join(f"({s}, '{t}', '{k}', {w})" for s, t, k, w in _CONTENT if k != "iso_code")


@R.query(rf"""WITH t AS (SELECT *, {sql_fold('term')} AS f FROM (VALUES {_TERMS}) x(seq, term, kind, weight)), d AS (SELECT doc_id, {sql_fold('text')} AS blob FROM documents),
m AS (SELECT doc_id, seq, term, kind, weight FROM d JOIN t ON contains(' ' || blob || ' ', ' ' || f || ' ') OR (len(f) >= 8 AND contains(blob, f)))
SELECT doc_id, round_even(least(0.9, max(CASE WHEN kind <> 'place' THEN weight END) * 0.75), 2)::DOUBLE AS confidence, string_agg(term, ',' ORDER BY seq) AS terms FROM m GROUP BY doc_id HAVING bool_or(kind <> 'place')""")
def content_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    found = catalogues.content_detection(texts, spark.createDataFrame(_CONTENT, "seq int, term string, kind string, weight double"), most=None)
    return found.select(F.col("file_id").alias("doc_id"), F.col("detection_confidence").alias("confidence"), F.array_join("matched_terms", ",").alias("terms"))


_PAGE = "coalesce(html, '')"
for _tag in PAGE_HIDDEN:
    _PAGE = rf"regexp_replace({_PAGE}, '(?is)<{_tag}\b.*?</{_tag}>', '', 'g')"
_PAGE = rf"regexp_replace({_PAGE}, '(?i)<(?:p|br|li|h[1-4]|tr|div|td)\b[^>]*>', chr(10), 'g')"


_WHOLE = sql_clean(sql_unescape(f"regexp_replace({_PAGE}, '(?s)<[^>]*>', '', 'g')"))
_TITLE = sql_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@R.query(rf"""SELECT page_id, contains(' ' || b || ' ', ' ereding ') OR contains(' ' || b || ' ', ' that ') AS about FROM (SELECT page_id, {sql_fold(f"concat_ws(' ', substr({_TITLE}, 1, 300), left({_WHOLE}, 600))")} AS b FROM pages)""")
def pages_about_a_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"), page_text(F.col("html"), most=None).alias("text"))
    return catalogues.about_us(p, ["Ereding", "That"]).select("page_id", "about")


@R.query(f"SELECT page_id, {sql_clean(sql_unescape(f'regexp_replace({_PAGE}, {chr(39)}(?s)<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})'))} AS text FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages as a visit reads them."""
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html"), most=None).alias("text"))


@R.query(f"SELECT (SELECT count(*) FROM documents) AS files_seen, count(*) AS hits FROM ({core_queries.R.oracle['scan_detection']})")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files seen by a scan of names, and those that a term was found in."""
    seen = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    return catalogues.scan_report(seen, core_queries.scan_detection(spark, sf_dir).select(F.col("doc_id").alias("file_id")))


@R.query("""WITH p AS (SELECT user_id AS transfer, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS "at", max(event_id) AS bytes FROM events GROUP BY ALL),
w AS (SELECT transfer, "at", bytes, "at" - min("at") OVER o AS span, bytes - min(bytes) OVER o AS gained FROM p WINDOW o AS (PARTITION BY transfer ORDER BY "at" RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT transfer, "at", CASE WHEN span > 0 THEN round(gained / span, 6) END AS rate FROM w""")
def transfer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 3600)
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("transfer"), hours.alias("at")).agg(F.max("event_id").alias("bytes"))
    return catalogues.transfer_rates(p).select("transfer", "at", F.round("rate", 6).alias("rate"))


@R.query("""SELECT page_id, greatest(0, least(100, CASE WHEN m IS NULL THEN s ELSE greatest(s - 25, least(s + 25, m)) END)) AS final FROM (SELECT page_id, (page_id * 37) % 101 AS s, CASE WHEN page_id % 4 > 0 THEN (page_id * 53) % 101 END AS m FROM pages)""")
def model_score_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    s = p.select("page_id", ((F.col("page_id") * 37) % 101).alias("score"), F.when(F.col("page_id") % 4 > 0, (F.col("page_id") * 53) % 101).alias("model_score"))
    return catalogues.model_scores(s).select("page_id", "final")


@R.query("""SELECT lpad(r_regionkey::VARCHAR, 3, 'x') AS code, string_agg(n_name, ' / ' ORDER BY n_nationkey) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lists = n.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list("n_nationkey")), lambda k: F.lpad(k.cast("string"), 2, "0")).alias("countries"))
    languages = r.join(lists, r["r_regionkey"] == lists["n_regionkey"]).select(F.lpad(F.col("r_regionkey").cast("string"), 3, "x").alias("code"), "countries")
    return registry.country_names(languages, n.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("alpha_2"), F.col("n_name").alias("name")))


@R.query(r"""WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'F' || c_nationkey WHEN 2 THEN 'F' || c_nationkey || ' > ' || c_name WHEN 3 THEN 'F' || c_nationkey || ', ' || c_mktsegment || ' / ' || c_name ELSE ' F' || c_nationkey || '/A,B>' || c_mktsegment || ',' || c_name END AS path FROM customer),
l AS (SELECT c_custkey, list_filter(regexp_split_to_array(path, '\s*[,/>]\s*'), lambda x: x <> '') AS l FROM p)
SELECT c_custkey AS id, l[1] AS family, CASE WHEN len(l) > 2 THEN l[len(l) - 1] END AS parent, 'Hakhun,Seg ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ',' || c_name ELSE '' END AS dialects FROM l JOIN customer USING (c_custkey)""")
def classification_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and parents from paths however they are written, and dialects from trees."""
    k, nation = F.col("c_custkey") % 5, F.concat(F.lit("F"), F.col("c_nationkey").cast("string"))
    path = F.when(k == 0, "").when(k == 1, nation).when(k == 2, F.concat(nation, F.lit(" > "), "c_name")).when(k == 3, F.concat(nation, F.lit(", "), "c_mktsegment", F.lit(" / "), "c_name")).otherwise(F.concat(F.lit(" "), nation, F.lit("/A,B>"), "c_mktsegment", F.lit(","), "c_name"))
    tree = F.concat(F.lit("('Hakhun [hakh1234]-d-':1,'Seg "), "c_mktsegment", F.lit(" [abcd1234]':1,'no code':2"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(",("), F.lit("'"), "c_name", F.lit(" [zzzz0000]-l-':1)x:3"))).otherwise(""), F.lit(")"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), catalogues.classification(path).alias("c"), catalogues.newick_names(tree).alias("d"))
    return r.select("id", "c.family", "c.parent", F.array_join("d", ",").alias("dialects"))
