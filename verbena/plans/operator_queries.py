"""Queries for the single operators: predicates on names and texts, registries, catalogues, extraction, provenance and review."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from verbena import agents, config
from verbena.functions import match, web
from verbena.functions.text import clean_name, display_value, html_links, html_title, human_time, safe_text, tokens
from verbena.operators import catalogues, crawl, discover, extract, facts, ingest, neardup, profile, registry, relevance, state
from verbena.plans.base import Register, sql_clean, sql_fold, sql_strip, table
from verbena.plans.core_queries import _OUTCOMES, _SCORES, _VALUES, _candidates, _outcomes, _values, scored_documents
from verbena.plans.state_queries import _LINK
from verbena.plans.text_queries import _PARTS, _TOKENS
from verbena.session import shared_folder
from verbena.sources import registries, sinks

R = Register()


def _sql_list(values) -> str:  # noqa: ANN001
    return ", ".join(f"'{v}'" for v in values)


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _sql_pick(key: str, *values: str) -> str:
    return f"list_extract([{', '.join(repr(v) if chr(39) not in v else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}], ({key} % {len(values)} + 1)::INTEGER)"


# ---------------------------------------------------------------- names in texts
@R.query(rf"""WITH w AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part)
SELECT term, term IN ({_sql_list(match.WORD_NAMES)}) OR (len(term) <= 3 AND NOT contains(term, ' ')) AS unclear, len(list_filter(string_split(term, ' '), lambda x: x <> '' AND x NOT IN ({_sql_list(match.COMMON_WORDS)}))) = 0 AS common FROM w""")
def unclear_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are ordinary words, too short, or made of common words only."""
    parts = table(spark, sf_dir, "part")
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).union(parts.select("p_name")).union(parts.select(F.explode(F.split("p_name", " ")))).distinct()
    t = F.col("term")
    return words.select("term", match.ambiguous_name(t, list(match.WORD_NAMES)).alias("unclear"), match.common_words_only(t).alias("common"))


_PROPER = ("Und", "Than", "La", "Heit", "El")


def _sql_word(t: str) -> str:
    edge = r"[^\p{L}\p{N}\p{M}_]"
    return f"regexp_matches(text, '(^|{edge}){t}({edge}|$)') AS has_{t.lower()}"


@R.query(f"SELECT doc_id, {', '.join(map(_sql_word, _PROPER))} FROM documents")
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *(match.proper_noun(F.col("text"), F.lit(t)).alias(f"has_{t.lower()}") for t in _PROPER))


_ABOUT = ("The Erheon language has few books.", "Erheon is a town on the long river of the north. Its grammar is old.", "an erheon language", "A dictionary of Erheon, 1999", "Erheon. Erheon has 12 speakers", "nothing of it")
_CONTEXT = match.LANGUAGE_CONTEXT.replace("'", "''")


@R.query(rf"""WITH t AS (SELECT doc_id, regexp_split_to_array(coalesce(text, '') || ' ' || {_sql_pick('doc_id', *_ABOUT)}, '\bErheon\b') AS p FROM documents)
SELECT doc_id, len(p) > 1 AND len(list_filter(range(1, len(p)), lambda i: regexp_matches(right(p[i], 32) || 'Erheon' || left(p[i + 1], 32), '(?i){_CONTEXT}'))) > 0 AS told FROM t""")
def language_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that use a name, spelled as one, close to a word that says a language is meant."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(F.col("doc_id"), *_ABOUT))
    return d.select("doc_id", match.language_context(text, F.lit("Erheon")).alias("told"))


_CITED = ("Schaft, J. and Weber 1999", "the Schaft people", "A. Schaft wrote it", "Schaft et al", "Schaft 1987, and the Schaft people", "no name", "Schaft WY is a botanist", "of Schaft")
_FORMS = "|".join(f.replace("{T}", "Schaft").replace(r"(?![a-z])", "") for f in match.AUTHOR_FORMS)


@R.query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || {_sql_pick('doc_id', *_CITED)} AS x FROM documents),
p AS (SELECT doc_id, regexp_split_to_array(x, '(?i)\bSchaft\b') AS p, regexp_extract_all(x, '(?i)\bSchaft\b') AS f FROM t)
SELECT doc_id, len(f) > 0 AND len(list_filter(range(1, len(f) + 1), lambda i: NOT regexp_matches(right(p[i], 24) || f[i] || left(p[i + 1], 24), '{_FORMS}'))) = 0 AS author FROM p""")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which a short name stands as an author's only."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(F.col("doc_id"), *_CITED))
    return d.select("doc_id", match.only_author(text, F.lit("Schaft")).alias("author"))


_KINDS = ("Dictionary", "field notes", "image", "Linguistics paper", "word-list", "Software", "Grammar sketch", "video", "Field Notes 1999", "map")


@R.query(rf"""WITH k AS (SELECT p_partkey, {sql_fold(f"{_sql_pick('p_partkey', *_KINDS)} || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END")} AS f FROM part)
SELECT p_partkey, CASE WHEN replace(f, ' ', '_') IN ({_sql_list(relevance.LANGUAGE_TYPES)}) THEN true WHEN replace(f, ' ', '_') IN ({_sql_list(relevance.OTHER_TYPES)}) THEN false ELSE regexp_matches(f, '{relevance.LANGUAGE_PARTS}') END AS linguistic FROM k""")
def linguistic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.concat(_pick(F.col("p_partkey"), *_KINDS), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""))
    return p.select("p_partkey", relevance.linguistic_type(kind).alias("linguistic"))


@R.query("""SELECT doc_id, concat_ws(' ', '/data/' || source, left(text, 20), 'creator ' || source, 'subject ' || lang) AS evidence FROM documents""")
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as evidence of a candidate: metadata of its surroundings (query, found_on, page_title, agent, snippet) does not."""
    d = table(spark, sf_dir, "documents")
    meta = F.create_map(F.lit("query"), "text", F.lit("subject"), "lang", F.lit("found_on"), "source", F.lit("creator"), "source", F.lit("snippet"), "text", F.lit("empty"), F.lit(None).cast("string"))
    c = d.select("doc_id", F.concat(F.lit("/data/"), "source").alias("path"), F.substring("text", 1, 20).alias("title"), F.array().cast("array<string>").alias("matched_terms"), meta.alias("metadata"))
    return ingest.described(c).select("doc_id", F.col("text").alias("evidence"))


@R.query(rf"""WITH {_SCORES},
h AS (SELECT m.doc_id, x.term FROM m JOIN t x ON x.signal = m.signal AND x.f = m.f AND x.weak = m.weak WHERE hit OR inside_hit
  UNION SELECT doc_id, 'iso' FROM d WHERE list_contains(string_split(blob, ' '), 'tho') OR contains(blob, 'iso tho'))
SELECT doc_id, coalesce(string_agg(term, ',' ORDER BY lower(term), term), '') AS terms FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms behind each score, distinct, in the order of the alphabet."""
    return scored_documents(spark, sf_dir).select(F.col("candidate_id").alias("doc_id"), F.array_join("matched_terms", ",").alias("terms"))


_SENTENCE = ("The Konyak Naga live there.", "It has ISO 639 codes.", "Nocte language is near.", "plain words", "Its people sing.", "Tase variety of it")


@R.query(rf"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, '') || ' ' || {_sql_pick('doc_id', *_SENTENCE)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(s, '{facts.OTHER_LANGUAGE}')) AS other, count(*) FILTER (WHERE regexp_matches(s, '(?i)^{facts.PRONOUN}')) AS goes_on FROM s GROUP BY doc_id""")
def sentences_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that turn to another language, and those that go on by a pronoun."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(F.col("doc_id"), *_SENTENCE))
    s = d.select("doc_id", F.explode(F.split(text, r"(?<=[.!?])\s+")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("s").rlike(facts.OTHER_LANGUAGE)).alias("other"), F.count_if(F.col("s").rlike("(?i)^" + facts.PRONOUN)).alias("goes_on"))


# ---------------------------------------------------------------- registries and resolving
def _letters(n: Column) -> Column:
    return F.concat(F.char(F.lit(97) + F.floor(n / 10).cast("int")), F.char(F.lit(97) + (n % 10).cast("int")), F.lit("q"))


_CODED = "chr((97 + n_nationkey // 10)::INTEGER) || chr((97 + n_nationkey % 10)::INTEGER) || 'q'"


@R.query(rf"""WITH l AS (SELECT n_nationkey, {_CODED} AS code, n_name FROM nation),
q AS (SELECT n_nationkey AS query_id, upper(code) || ' ' AS query FROM l UNION ALL SELECT 100 + n_nationkey, 'z' || right(code, 2) FROM l),
r AS (SELECT 'z' || right(code, 2) AS old, min(code) AS change_to FROM l WHERE n_nationkey % 3 > 0 GROUP BY 1)
SELECT query_id, code, 'code' AS matched_on, 1.0::DOUBLE AS score FROM q JOIN l ON lower(trim(query)) = code
UNION ALL SELECT query_id, change_to, 'retired_code', 0.9::DOUBLE FROM q JOIN r ON lower(trim(query)) = old""")
def retired_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as they are asked for, and retired ones that lead to another."""
    l = table(spark, sf_dir, "nation").select("n_nationkey", _letters(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"))
    old = F.concat(F.lit("z"), F.substring("code", 2, 2))
    q = l.select(F.col("n_nationkey").alias("query_id"), F.concat(F.upper("code"), F.lit(" ")).alias("query")).union(l.select(F.col("n_nationkey") + 100, old))
    gone = l.where("n_nationkey % 3 > 0").groupBy(old.alias("code")).agg(F.min("code").alias("change_to"))
    index = registry.name_index(l.limit(0).select("code", F.lit("name").alias("kind"), F.col("name").alias("text"), F.lit(0).alias("seq")))
    return registry.find(q, index, l.select("code", "name"), gone).select("query_id", "code", "matched_on", "score")


_LOCAL = rf"""
pn AS (SELECT n_nationkey AS language_id, 'name' AS "check", n_name AS text FROM nation UNION ALL SELECT n_nationkey, 'exonym', 'Land ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'variety', n_name || ' Valley' FROM nation),
q AS (SELECT n_nationkey AS query_id, lower(n_name) || '-valley' AS query FROM nation UNION ALL SELECT 100 + r_regionkey, 'LAND ' || r_name FROM region UNION ALL SELECT 200 + n_nationkey, n_name FROM nation),
sc AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE, {i})" for i, (k, v) in enumerate(registry.LOCAL_SCORES.items()))}) t("check", score, ord)),
lm AS (SELECT query_id, language_id, min(struct_pack(ord := ord, text := text, c := sc."check", s := score)) AS m FROM q JOIN pn ON {sql_fold('query')} = {sql_fold('pn.text')} JOIN sc USING ("check") GROUP BY ALL)"""


def _local(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    one = lambda check, text, d=n: d.select(F.col("n_nationkey").alias("language_id"), F.lit(check).alias("check"), text.alias("text"))
    names = one("name", F.col("n_name")).union(one("exonym", F.concat(F.lit("Land "), "r_name"), n.join(r, n["n_regionkey"] == r["r_regionkey"]))).union(one("variety", F.concat("n_name", F.lit(" Valley"))))
    q = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lower("n_name"), F.lit("-valley")).alias("query"))
    return q.union(r.select(F.col("r_regionkey") + 100, F.concat(F.lit("LAND "), "r_name"))).union(n.select(F.col("n_nationkey") + 200, "n_name")), names


@R.query(f"""WITH {_LOCAL} SELECT query_id, language_id, m.c AS matched_on, m.text AS matched_text, m.s AS score FROM lm""")
def local_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles that a query names."""
    q, names = _local(spark, sf_dir)
    return registry.find_local(q, names)


@R.query(f"""WITH {_LOCAL},
b AS (SELECT query_id, {_CODED} AS code, 0.98::DOUBLE AS score, 'name' AS kind FROM q JOIN nation ON {sql_fold('query')} = {sql_fold('n_name')}),
mine AS (SELECT query_id, coalesce(CASE WHEN language_id % 2 = 0 THEN {_CODED} END, language_id::VARCHAR) AS code, m.c AS kind, m.s AS score, 0 AS src FROM lm JOIN nation ON n_nationkey = language_id),
e AS (SELECT * FROM mine UNION ALL SELECT query_id, code, kind, score, 1 FROM b WHERE (query_id, code) NOT IN (SELECT query_id, code FROM mine)),
g AS (SELECT query_id, count(*) AS n, max(CASE WHEN src = 0 THEN score END) AS stored, max(score) AS best, count(*) FILTER (WHERE score >= 0.9) AS strong, max(struct_pack(score := score, s := -src, code := code, kind := kind)) AS top FROM e GROUP BY query_id)
SELECT query_id, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN coalesce(stored >= 0.85, false) OR (best >= 0.98 AND strong = 1) OR (strong = 1 AND top.kind IN ('alternate_name', 'code', 'name')) THEN 'exact' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n, top.code AS best_code, best AS best_score FROM q LEFT JOIN g USING (query_id)""")
def resolved_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries resolved by stored profiles first, then by codes that none of them has."""
    q, names = _local(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select("n_nationkey", _letters(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"))
    index = registry.name_index(n.select("code", F.lit("name").alias("kind"), F.col("name").alias("text"), F.lit(0).alias("seq")))
    whole = registry.find(q, index, n.select("code", "name")).where("score >= 0.9")
    identity = n.select(F.col("n_nationkey").alias("language_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("code")).alias("code"))
    return registry.resolve(q, registry.find_local(q, names), whole, identity)


_SCRIPTS = (("Latn", "Latin"), ("Cyrl", "Cyrillic"), ("Arab", "Arabic"), ("Aran", "Arabic Nastaliq"), ("Deva", "Devanagari"))


@R.query(rf"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{n}', {i})" for i, (c, n) in enumerate(_SCRIPTS))}) t(code, name, seq)),
q AS (SELECT c_custkey AS query_id, {_sql_pick('c_custkey', 'latn', 'ARABIC', 'nasta', 'Cyril', 'CYRL', 'deva', 'none', ' ', 'a')} AS q FROM customer),
m AS (SELECT query_id, k.code, k.name, k.seq, CASE WHEN len(q) = 4 AND upper(q[1]) || lower(q[2:]) = k.code THEN 0 WHEN lower(trim(q)) = lower(k.name) THEN 1 WHEN contains(lower(k.name), lower(trim(q))) THEN 2 END AS way FROM q JOIN k ON trim(q) <> '')
SELECT query_id, arg_min(code, (way, seq)) AS code, arg_min(name, (way, seq)) AS name FROM m WHERE way IS NOT NULL GROUP BY query_id""")
def script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), _pick(F.col("c_custkey"), "latn", "ARABIC", "nasta", "Cyril", "CYRL", "deva", "none", " ", "a").alias("query"))
    return registry.scripts(q, spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(_SCRIPTS)], "code string, name string, seq int"))


_AES = ("not endangered", "threatened", "shifting", "moribund", "nearly extinct", "extinct", "")


@R.query(rf"""WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey, {_sql_pick('s_suppkey', *_AES)} AS aes, s_suppkey % 4 AS k FROM supplier)
SELECT id AS language_id, 'identity' AS grp, 'family' AS field, '"' || name || '"' AS value_json, 0.85::DOUBLE AS confidence FROM s WHERE k <> 0
UNION ALL SELECT id, 'identity', 'parent', '{{"value":"' || CASE WHEN k = 1 THEN 'P ' || id ELSE 'p' || id END || '","type":"macrolanguage","code":"p' || id || '"}}', 0.9 FROM s WHERE k <> 2
UNION ALL SELECT id, 'identity', 'scripts', '[{{"code":"Latn","name":"Latin","as_entered":"Latn"}}]', 0.7 FROM s WHERE k = 3
UNION ALL SELECT id, 'orthography_location', 'varieties', '["a' || id || '","b"]', 0.75 FROM s WHERE k <> 1
UNION ALL SELECT id, 'orthography_location', 'region', '"R' || s_nationkey || '"', 0.8 FROM s
UNION ALL SELECT id, 'resources', 'studies', '{{"state":"reported","detail":"most extensive description: grammar"}}', 0.6 FROM s WHERE k = 2
UNION ALL SELECT id, 'community_status', 'transmission', '{{"value":"' || CASE aes WHEN 'not endangered' THEN 'strong' WHEN 'threatened' THEN 'declining' WHEN 'shifting' THEN 'declining' WHEN 'moribund' THEN 'limited' ELSE 'not_transmitted' END || '","detail":"Glottolog AES: ' || aes || '"}}', 0.5 FROM s WHERE aes <> ''""")
def enriched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the tables of languages give for profiles."""
    s, k, i = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    rows = s.select(
        F.col("s_suppkey").alias("language_id"), F.when(k != 0, F.col("s_name")).otherwise("").alias("family"), F.lit("").alias("classification"), F.when(k != 2, F.concat(F.lit("p"), i)).otherwise("").alias("parent"),
        F.when(k == 1, F.concat(F.lit("P "), i)).alias("parent_name"), F.when(k == 3, "Latn").otherwise("").alias("script"), F.when(k == 3, "Latin").alias("script_name"),
        F.when(k != 1, F.array(F.concat(F.lit("a"), i), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("dialects"), F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("region"), F.lit("").alias("macroarea"),
        F.when(k == 2, "grammar").otherwise("").alias("documentation"), _pick(F.col("s_suppkey"), *_AES).alias("endangerment"),
    )
    return registry.enrich(rows).select("language_id", "grp", "field", "value_json", "confidence")


@R.query(rf"""SELECT 100 * n_nationkey + k AS id, value FROM (SELECT n_nationkey, unnest(range(0, 3)) AS k, unnest([n_name, r_name || ' Tongue', 'Nation ' || (n_nationkey + 1) % 25]) AS value FROM nation JOIN region ON n_regionkey = r_regionkey)
WHERE {sql_fold('value')} IN (SELECT {sql_fold('n_name')} FROM nation WHERE n_nationkey <> 0)""")
def names_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are another language's own name."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    index = registry.name_index(n.select(F.col("n_nationkey").cast("string").alias("code"), F.lit("name").alias("kind"), F.col("n_name").alias("text"), F.lit(0).alias("seq")))
    values = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.posexplode(F.array("n_name", F.concat("r_name", F.lit(" Tongue")), F.concat(F.lit("Nation "), ((F.col("n_nationkey") + 1) % 25).cast("string")))).alias("k", "value"))
    return catalogues.other_languages(values.select((F.col("n_nationkey") * 100 + F.col("k")).alias("id"), "value"), index, "0")


# ---------------------------------------------------------------- pages, catalogues, engines
@R.query(rf"""WITH l AS (SELECT page_id, unnest(range(0, len(regexp_extract_all(html, '{_LINK}')))) AS n, trim(unnest(regexp_extract_all(html, '{_LINK}', 1))) AS url, substr({sql_strip("unnest(regexp_extract_all(html, '" + _LINK.replace(".*?</a>", "(.*?)</a>") + "', 2))")}, 1, 200) AS anchor FROM pages),
k AS (SELECT page_id, n, url FROM l WHERE contains({sql_fold("anchor || ' ' || url")}, 'the') OR contains({sql_fold("anchor || ' ' || url")}, 'example'))
SELECT * FROM (SELECT page_id, n, url, row_number() OVER (PARTITION BY page_id ORDER BY n) AS rank FROM k) WHERE rank <= 6""")
def page_relevant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_links(F.col("html"))).alias("n", "l"))
    found = discover.relevant_links(p.select("page_id", "n", "l.url", "l.anchor"), ["the", "example"])
    return found.select("page_id", F.col("n").cast("long").alias("n"), "url", F.col("rank").cast("long").alias("rank"))


_TITLE = sql_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@R.query(f"""WITH p AS (SELECT page_id, url, {_TITLE} AS title, page_id % 7 AS q, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS n FROM pages)
SELECT q AS query_id, n, substr(title, 1, 300) AS title, url, CASE WHEN page_id % 3 = 0 THEN 'cc-' || page_id END AS licence, '["t' || page_id || '","dataset"]' AS types FROM p""")
def catalogue_json_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in JSON answers of a catalogue, read by the paths of its fields; a list gives its first text."""
    i = F.col("page_id").cast("string")
    record = F.struct("page_id", F.struct(F.array(html_title(F.col("html")), F.lit("other")).alias("title"), F.when(F.col("page_id") % 3 == 0, F.struct(F.concat(F.lit("cc-"), i).alias("id"))).alias("license"), F.array(F.concat(F.lit("t"), i), F.lit("dataset")).alias("types")).alias("metadata"), F.struct(F.col("url").alias("self")).alias("links"))
    bodies = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 7).alias("query_id")).agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(record)).alias("hits")).alias("hits"))).alias("body"))
    got = discover.json_results(bodies, "hits.hits[]", {"title": "metadata.title", "url": "links.self", "licence": "metadata.license.id", "types": "metadata.types[]"})
    return got.withColumn("n", F.col("n").cast("long"))


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@R.query(f"""SELECT page_id % 5 AS query_id, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS n, trim(url) AS url, trim(substr({_TITLE}, 1, 300)) AS title FROM pages""")
def engine_feed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of RSS and Atom answers."""
    title, url = _escaped(html_title(F.col("html"))), _escaped(F.btrim("url"))
    item = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><description>d</description></item>"))).otherwise(F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="'), url, F.lit('"/><summary>s</summary></entry>')))
    bodies = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 5).alias("query_id")).agg(F.concat(F.lit("<rss>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", item.alias("x")))), lambda x: x["x"]), ""), F.lit("</rss>")).alias("body"))
    return discover.feed_results(bodies).select("query_id", F.col("n").cast("long").alias("n"), "url", "title")


_TARGETS = rf"""l AS (SELECT page_id, trim(url) AS base, unnest(range(0, len(regexp_extract_all(html, '{_LINK}', 1)))) AS n, trim(unnest(regexp_extract_all(html, '{_LINK}', 1))) AS link FROM pages),
p AS (SELECT *, regexp_extract(base, '^([a-z]+)://', 1) AS scheme, regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM l),
g AS (SELECT page_id, n, link, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || host || link
WHEN starts_with(link, '#') OR link = '' THEN scheme || '://' || host || path || link ELSE scheme || '://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS target FROM p)"""


@R.query(f"WITH {_TARGETS} SELECT page_id AS query_id, target AS url, min(n) AS n FROM g WHERE NOT starts_with(link, '#') AND regexp_matches(target, '^https?://') GROUP BY ALL")
def engine_page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of an engine's pages, absolute, each once."""
    bodies = table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.btrim("url").alias("url"), F.col("html").alias("body"))
    return discover.page_results(bodies, "^https?://").select("query_id", "url", F.col("n").cast("long").alias("n"))


_NORMAL = "lower(scheme) || CASE WHEN scheme = '' THEN '' ELSE '://' END || lower(host) || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END"


@R.query(rf"""WITH h AS (SELECT host_id AS query_id, n, u FROM (SELECT page_id % 11 AS host_id, 2 * page_id AS n, url AS u FROM pages UNION ALL SELECT page_id % 11, 2 * page_id + 1, replace(url, 'http://', 'HTTP://') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=e2' FROM pages UNION ALL SELECT page_id % 11, 2 * page_id + 1, 'https://www.facebook.com/' || page_id FROM pages)),
k AS (SELECT query_id, n, u, {_NORMAL} AS key FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(x, '^(utm_|fbclid|ref)')), '&') AS kept FROM (SELECT query_id, n, u{_PARTS} FROM h) WHERE regexp_matches(u, '^https?://') AND NOT contains(u, 'facebook.com'))),
f AS (SELECT query_id, key, min(struct_pack(n := n, u := u)) AS f FROM k GROUP BY ALL)
SELECT * FROM (SELECT query_id, f.u AS url, key, row_number() OVER (PARTITION BY query_id ORDER BY f.n, key) AS rank FROM f) WHERE rank <= 8""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several engines, one for each page however its address is written."""
    p = table(spark, sf_dir, "pages")
    q = (F.col("page_id") % 11).alias("query_id")
    mark = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    one = lambda n, u: p.select(q, n.alias("n"), u.alias("url"), F.lit("t").alias("title"))
    hits = one(F.col("page_id") * 2, F.col("url")).union(one(F.col("page_id") * 2 + 1, F.concat(F.replace("url", F.lit("http://"), F.lit("HTTP://")), mark, F.lit("utm_source=e2")))).union(one(F.col("page_id") * 2 + 1, F.concat(F.lit("https://www.facebook.com/"), F.col("page_id").cast("string"))))
    return discover.distinct_hits(hits).select("query_id", "url", "key", F.col("rank").cast("long").alias("rank"))


@R.query("""SELECT c_custkey, 'https://x.org/s?q=' || replace(url_encode(c_name || ' & "' || c_mktsegment || '"'), '%20', '+') || '&n=' || replace(url_encode(c_name), '%20', '+') || '&c=' || CASE WHEN c_custkey % 2 = 0 THEN 'abc' ELSE '' END AS url FROM customer""")
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    query = F.concat("c_name", F.lit(' & "'), "c_mktsegment", F.lit('"'))
    return c.select("c_custkey", discover.render_url("https://x.org/s?q={query}&n={name}&c={code}", query, F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "abc")).alias("url"))


@R.query("""SELECT p_size AS item_id, p_name || '.pdf' AS name, 'http://d.org/' || p_partkey AS url, CASE WHEN p_partkey % 4 > 0 THEN p_partkey * 10 END AS size FROM part WHERE p_partkey % 3 <> 0""")
def bundle_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original files among a repository's bundles, from its JSON."""
    i = F.col("p_partkey")
    stream = F.struct(F.concat("p_name", F.lit(".pdf")).alias("name"), F.concat(F.lit("http://d.org/"), i.cast("string")).alias("url"), F.when(i % 4 > 0, i * 10).alias("sizeBytes"))
    by = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("item_id"), F.when(i % 3 == 0, "THUMBNAIL").otherwise("ORIGINAL").alias("name")).agg(F.collect_list(stream).alias("bitstreams"))
    items = by.groupBy("item_id").agg(F.to_json(F.struct(F.collect_list(F.struct("name", "bitstreams")).alias("bundles"))).alias("body"))
    return catalogues.bundle_files(items)


@R.query("SELECT * FROM (SELECT p_size AS record_id, 'u' || p_partkey AS url, p_partkey * 7919 % 1000 AS size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey * 7919 % 1000, 'u' || p_partkey) AS rank FROM part) WHERE rank <= 5")
def smallest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select(F.col("p_size").alias("record_id"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), (F.col("p_partkey") * 7919 % 1000).alias("size"))
    return discover.smallest_files(f).withColumn("rank", F.col("rank").cast("long"))


_RECORD = "SELECT p_partkey AS seq, p_brand AS session_id, 'cat' || p_partkey % 3 AS provider, p_name AS title, 'http://c.org/' || p_partkey AS url, CASE WHEN p_partkey % 7 = 0 THEN 'lookup' ELSE 'record' END AS kind, (p_partkey * 37) % 101 AS score, p_partkey % 4 AS n_files FROM part"
_ACTION = "CASE WHEN kind = 'lookup' THEN 'lookup' WHEN score < 30 THEN 'skip' WHEN n_files = 0 THEN 'metadata' ELSE 'download' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        i.alias("seq"), F.col("p_brand").alias("session_id"), F.concat(F.lit("cat"), (i % 3).cast("string")).alias("provider"), F.col("p_name").alias("title"), F.concat(F.lit("http://c.org/"), i.cast("string")).alias("url"),
        F.when(i % 7 == 0, "lookup").otherwise("record").alias("kind"), ((i * 37) % 101).alias("score"), (i % 4).alias("n_files"), F.col("p_type").alias("description"), F.lit("Thonin").alias("language"),
        F.array("p_type", F.lit("dictionary")).alias("types"), F.create_map(F.lit("by"), "p_brand", F.lit("long"), F.repeat(F.lit("x"), F.lit(600))).alias("metadata"), F.lit("cc").alias("licence"), F.when(i % 2 == 0, "q").alias("query"), F.when(i % 10 == 0, "timeout").alias("error"),
    )


@R.query(f"""WITH r AS ({_RECORD}) SELECT session_id, count(*) AS discovered, count(*) FILTER (WHERE seq % 10 = 0) AS failed, count(*) FILTER (WHERE a = 'lookup') AS lookups, count(*) FILTER (WHERE a IN ('metadata', 'download')) AS relevant,
count(*) FILTER (WHERE a = 'metadata') AS metadata, coalesce(sum(n_files) FILTER (WHERE a = 'download'), 0)::BIGINT AS files FROM (SELECT *, {_ACTION} AS a FROM r) GROUP BY session_id""")
def catalogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.catalogue_totals(discover.catalogue_actions(_records(spark, sf_dir)))


@R.query("SELECT p_partkey AS seq, p_name || ' ' || p_type || ' Thonin ' || p_type || ' dictionary ' || p_brand AS text FROM part")
def catalogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that tells what a record is about; metadata of more than 500 characters does not."""
    return catalogues.relevance_text(_records(spark, sf_dir)).select("seq", "text")


@R.query(f"""WITH r AS ({_RECORD}) SELECT seq, 'catalogue' AS method, url, title, provider AS catalogue, CASE WHEN seq % 2 = 0 THEN 'q' END AS query, n_files = 0 AS synthetic FROM r WHERE {_ACTION} IN ('metadata', 'download')""")
def catalogue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that go on, as candidates."""
    c = catalogues.candidates(discover.catalogue_actions(_records(spark, sf_dir)))
    return c.select("seq", "method", "url", "title", F.col("metadata")["catalogue"].alias("catalogue"), F.col("metadata")["query"].alias("query"), "synthetic")


@R.query(f"""WITH r AS ({_RECORD}) SELECT session_id, '[' || string_agg('{{"provider":"' || provider || '","title":"' || title || '","url":"' || url || '"' || CASE WHEN seq % 2 = 0 THEN ',"query":"q"' ELSE '' END || '}}', ',' ORDER BY provider, title, url) || ']' AS json FROM r WHERE kind = 'lookup' GROUP BY session_id""")
def lookup_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.lookup_manifest(_records(spark, sf_dir))


@R.query(f"""WITH r AS ({_RECORD}) SELECT regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '.metadata.json' AS name, '{{"synthetic":true,"provider":"' || provider || '","title":"' || title || '","url":"' || url || '"}}' AS json FROM r WHERE n_files = 0""")
def synthetic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metadata_records(_records(spark, sf_dir))


@R.query(rf"""WITH f AS (SELECT * FROM (SELECT page_id, {_sql_pick('page_id', 'varieties', 'alternate_names', 'places', 'exonyms', 'speakers')} AS field, 'V' || page_id % 23 AS value FROM pages)),
q AS (SELECT DISTINCT replace(form, '{{x}}', value) AS query FROM (SELECT value, unnest(CASE WHEN field = 'varieties' THEN ['"{{x}}" dictionary', '"{{x}}" language documentation', '"{{x}}" "Thonin" corpus'] WHEN field IN ('alternate_names', 'exonyms') THEN ['"{{x}}" language'] WHEN field = 'places' THEN ['"Thonin" "{{x}}"'] END) AS form FROM f))
SELECT query, 'learned' AS basis FROM q WHERE {sql_fold('query')} NOT IN (SELECT {sql_fold("'""V' || n_nationkey || '"" Dictionary'")} FROM nation) ORDER BY {sql_fold('query')} LIMIT 16""")
def learned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that names learned on the way lead to, without those asked already."""
    i = F.col("page_id")
    f = table(spark, sf_dir, "pages").select(_pick(i, "varieties", "alternate_names", "places", "exonyms", "speakers").alias("field"), F.concat(F.lit("V"), (i % 23).cast("string")).alias("value")).distinct()
    asked = table(spark, sf_dir, "nation").select(F.concat(F.lit('"V'), F.col("n_nationkey").cast("string"), F.lit('" Dictionary')).alias("query"))
    return crawl.learned_queries(f, asked, "Thonin")


@R.query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a é' || page_id || '.pdf' WHEN 1 THEN 'plain' || page_id || '.txt' WHEN 2 THEN 'x y.zip' WHEN 3 THEN 'rec' || page_id ELSE 'download' END AS name FROM pages""")
def response_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names: the header's encoded form, its plain form, the address."""
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 5
    header = F.when(k == 0, F.concat(F.lit("attachment; filename=\"z.pdf\"; filename*=UTF-8''a%20%C3%A9"), i, F.lit(".pdf"))).when(k == 1, F.concat(F.lit('attachment; filename="plain'), i, F.lit('.txt"')))
    url = F.when(k == 2, "http://a.org/b/x%20y.zip?d=1").when(k == 3, F.concat(F.lit("http://a.org/rec"), i, F.lit("/content"))).otherwise("http://a.org/")
    return table(spark, sf_dir, "pages").select("page_id", web.response_filename(url, header).alias("name"))


@R.query("""SELECT page_id, 'http://xn--bcher-kva.org:80/%C3%A9t%C3%A9/' || page_id || '%20a%5B1%5D?q=%C3%A7&r=1#s' AS uri FROM pages""")
def ascii_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with any letters in the form that servers take."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", web.iri_to_uri_column(F.concat(F.lit("http://bücher.org:80/été/"), F.col("page_id").cast("string"), F.lit(" a[1]?q=ç&r=1#s"))).alias("uri"))


@R.query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"score": ' || conv_id || ', "why": ["' || role || '"]}' WHEN 1 THEN '[1, {"y": ' || turn || '}]' END AS answer FROM conversations""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last JSON in what a tool says."""
    c, n = table(spark, sf_dir, "conversations"), F.col("conv_id").cast("string")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Well {x} ['), F.lit('1] then {"score": '), n, F.lit(', "why": ["'), "role", F.lit('"]} done'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"a": 1} ```json\n[1, {"y": '), F.col("turn").cast("string"), F.lit("}]\n``` end"))).otherwise("none { here")
    return c.select("conv_id", "turn", facts.last_json_column(said).alias("answer"))


# ---------------------------------------------------------------- extraction
@F.pandas_udf(BinaryType())
def _office(texts):  # noqa: ANN001, ANN202
    def packed(x: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", x)
            z.writestr("word/other.xml", "<w:p>left out</w:p>")
        return out.getvalue()

    return texts.map(packed)


@F.pandas_udf(BinaryType())
def _archive(texts, names):  # noqa: ANN001, ANN202
    def packed(x: str, name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"a/{name}.txt", x)
            z.writestr("../up.txt", "hi")
            z.writestr("d/", "")
        return out.getvalue()

    return texts.combine(names, packed)


_T = sql_clean("coalesce(text, '')")


@R.query(f"""SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN {sql_clean("'t' || chr(10) || coalesce(text, '')")} WHEN 5 THEN {sql_clean("coalesce(text, '') || ' x'")} ELSE {_T} END AS text,
{_sql_pick('doc_id', 'raw', 'json-strings', 'xml-text', 'html-strip', 'raw', 'csv', 'zip-xml', 'xml-text')} AS extractor FROM documents""")
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents put into files of eight formats, and read back."""
    k = F.col("doc_id") % 8
    text = F.coalesce("text", F.lit(""))
    x = _escaped(text)
    fmt = _pick(F.col("doc_id"), "text", "json", "elan", "html", "text", "csv", "docx", "tei")
    content = (
        F.when(k == 1, F.to_json(F.struct(text.alias("t"))).cast("binary")).when(k == 2, F.concat(F.lit("<A><B>no</B><ANNOTATION_VALUE>"), x, F.lit("</ANNOTATION_VALUE></A>")).cast("binary"))
        .when(k == 3, F.concat(F.lit("<html><head><title>t</title><style>p{}</style></head><body><p>"), x, F.lit("</p><script>var a;</script></body></html>")).cast("binary")).when(k == 4, F.encode(text, "UTF-16"))
        .when(k == 5, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('",x')).cast("binary")).when(k == 6, _office(F.concat(F.lit("<w:document><w:p>"), x, F.lit("</w:p></w:document>"))))
        .when(k == 7, F.concat(F.lit('<?xml version="1.0"?><TEI><p>'), x, F.lit("</p></TEI>")).cast("binary")).otherwise(text.cast("binary"))
    )
    files = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), fmt.alias("format"), F.lit("text").alias("category"))
    return extract.extract_texts(files, "doc_id", most=None).select("doc_id", "text", "extractor")


@R.query(rf"""SELECT doc_id, array_to_string(w, ' ') AS text, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END AS pages FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents)""")
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain words of whole documents as PDF files, read back, with their pages."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.lit("("), w, F.lit(") Tj"))), "\n")
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj <</Type /Page>> endobj\nstream\nBT "), shown, F.lit(" ET\nendstream")).cast("binary")
    files = table(spark, sf_dir, "documents").select("doc_id", body.alias("content"), F.lit("pdf").alias("format"), F.lit("documents").alias("category"))
    read = extract.extract_texts(files, "doc_id", most=None)
    return extract.text_metadata(read.withColumn("key", F.struct("doc_id", "text")), "key").select("key.doc_id", "key.text", F.get_json_object("metadata_json", "$.pages").cast("int").alias("pages"))


@R.query("""SELECT doc_id, 'a/' || doc_id || '.txt' AS member, 'a/' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size, false AS is_folder, sha256(coalesce(text, '')) AS sha FROM documents
UNION ALL SELECT doc_id, '../up.txt', 'up.txt', 2, false, sha256('hi') FROM documents UNION ALL SELECT doc_id, 'd/', 'd', 0, true, NULL FROM documents""")
def packed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives with paths that stay inside, and their contents."""
    d = table(spark, sf_dir, "documents").select("doc_id", _archive(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")).alias("content"), F.lit("zip").alias("format"))
    return extract.archive_members(d, "doc_id", contents=True).select("doc_id", "member", "path", "size", "is_folder", F.sha2("content", 256).alias("sha"))


@R.query("""WITH m AS (SELECT l_orderkey AS archive, 'm' || l_linenumber || '-' || l_partkey AS member, l_suppkey AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY 'm' || l_linenumber || '-' || l_partkey, l_suppkey) AS k FROM lineitem)
SELECT archive, count(*) AS members, sum(size)::BIGINT AS bytes, string_agg(member, ',' ORDER BY member) FILTER (WHERE k <= 500) AS listing FROM m GROUP BY archive""")
def archive_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("member"), F.col("l_suppkey").alias("size"))
    return catalogues.archive_totals(m, "archive").withColumn("listing", F.array_join("listing", ","))


@R.query("SELECT doc_id, doc_id % 5 <> 0 AS intact FROM documents WHERE text IS NOT NULL AND text <> ''")
def verified_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stored bytes still are what their hash says; a fifth of them have lost their last byte."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    body = F.col("text").cast("binary")
    cut = F.when(F.col("doc_id") % 5 == 0, F.substring(body, F.lit(1), F.octet_length(body) - 1)).otherwise(body)
    return sinks.verified(d.select("doc_id", F.sha2("text", 256).alias("sha256"), cut.alias("content"))).select("doc_id", "intact")


@R.query("SELECT doc_id, replace(coalesce(text, ''), 'a', '�') AS text FROM documents")
def valid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 made into text."""
    body = F.regexp_replace(F.hex(F.coalesce("text", F.lit("")).cast("binary")), "(?:(?<=^(?:..){0,0})|\\G)((?:(?!61)..)*+)61", "$1FF")
    return table(spark, sf_dir, "documents").select("doc_id", safe_text(F.unhex(body)).alias("text"))


# ---------------------------------------------------------------- outcomes, provenance, review, sessions
@R.query(f"""WITH {_OUTCOMES} SELECT left(sha, 12) || '-thonin_' || doc_id || {_sql_pick('doc_id', '.txt', '.eaf', '.xyz', '.PDF')} AS name, sha AS sha256, size, format, category, score, status FROM out WHERE status IN ('stored', 'uncertain_review')""")
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON beside each stored resource, read back."""
    s = ingest.sidecars(_outcomes(spark, sf_dir))
    return s.select("name", F.from_json("json", "sha256 string, size long, format string, category string, score int, status string").alias("j")).select("name", "j.*")


@R.query(f"""WITH {_OUTCOMES} SELECT sha AS sha256, 'S' || source AS session_id, CASE doc_id % 3 WHEN 0 THEN 'offline' WHEN 1 THEN 'import' ELSE 'agent' END AS method, CASE WHEN doc_id % 3 = 2 THEN 'http://x/' || doc_id END AS url,
CASE WHEN doc_id % 7 = 0 THEN 'moved/' || doc_id WHEN doc_id % 3 < 2 THEN '/data/' || source || '/thonin_' || doc_id || {_sql_pick('doc_id', '.txt', '.eaf', '.xyz', '.PDF')} END AS original_path FROM out""")
def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each resource was found, again for each find; columns that are not known are null."""
    i = F.col("candidate_id")
    c = _candidates(spark, sf_dir).withColumns({"method": _pick(i, "offline", "import", "agent"), "url": F.when(i % 3 == 2, F.concat(F.lit("http://x/"), i.cast("string"))), "original_path": F.when(i % 7 == 0, F.concat(F.lit("moved/"), i.cast("string")))})
    return ingest.provenance(_outcomes(spark, sf_dir), c).select("sha256", "session_id", "method", "url", "original_path")


@R.query(f"""WITH {_OUTCOMES}, i AS (SELECT doc_id AS item_id, sha FROM out WHERE status = 'uncertain_review' OR (status = 'duplicate_linked' AND score < 70)),
r AS (SELECT sha, 'thonin_' || doc_id || {_sql_pick('doc_id', '.txt', '.eaf', '.xyz', '.PDF')} AS name, size FROM out WHERE status IN ('stored', 'uncertain_review')),
t AS (SELECT sha256(text) AS sha, any_value(text) AS text FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT item_id, name, size, left(text, 400) AS sample FROM i JOIN r USING (sha) LEFT JOIN t USING (sha)""")
def review_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies behind each item that a person has to decide."""
    o = _outcomes(spark, sf_dir)
    items = ingest.review_items(o).select("item_id", F.get_json_object("payload", "$.sha256").alias("sha256"))
    texts = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha256"), "text")
    return state.review_sources(items, ingest.resources(o), texts).select("item_id", "name", F.col("size").cast("long").alias("size"), "sample")


@R.query(f"""WITH {_OUTCOMES}, d AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'accepted' END) AS decision FROM labels GROUP BY doc_id),
r AS (SELECT count(*) AS resources, sum(size)::BIGINT AS bytes FROM out WHERE status IN ('stored', 'uncertain_review')),
i AS (SELECT count(*) FILTER (WHERE doc_id % 2 = 0) AS pending_resources, count(*) FILTER (WHERE doc_id % 2 <> 0) AS pending_facts FROM documents LEFT JOIN d USING (doc_id) WHERE decision IS NULL)
SELECT (SELECT count(DISTINCT lang) FROM documents) AS languages, resources, bytes, pending_resources, pending_facts FROM r, i""")
def home_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    decisions = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id"), F.lit("accepted").alias("decision"), F.lit(1).alias("seq"))
    items = state.review_items(d.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 2 == 0, "resource").otherwise("profile_field").alias("kind")), decisions)
    return state.home(ingest.resources(_outcomes(spark, sf_dir)), items, d.where("lang IS NOT NULL").select("lang").distinct())


@R.query("""WITH f AS (SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS mode, CASE WHEN event_id % 3 > 0 THEN ts END AS started_at, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'finished' END AS status, event_id AS seq FROM events)
SELECT session_id, arg_min(mode, seq) FILTER (WHERE mode IS NOT NULL) AS mode, arg_min(started_at, seq) FILTER (WHERE started_at IS NOT NULL) AS started_at, arg_max(status, seq) AS status FROM f GROUP BY session_id""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from what was written of them: begun once, in the state that was written last."""
    i = F.col("event_id")
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.lit("l").alias("language_id"), F.when(i % 2 == 0, F.col("event_type")).alias("mode"), F.when(i % 3 > 0, F.col("ts")).alias("started_at"), _pick(i, "running", "failed", "finished", "finished").alias("status"), i.alias("seq"))
    return state.sessions(f).drop("language_id")


# ---------------------------------------------------------------- profiles
@R.query(f"""WITH {_VALUES}, f AS (SELECT language_id, grp, field, val, row_number() OVER (PARTITION BY language_id, grp, field, val ORDER BY NOT preferred, source_type <> 'user', -confidence, seq) AS k, NOT preferred AS a, source_type <> 'user' AS b, -confidence AS c, seq FROM v WHERE status = 'accepted' AND field = 'alternate_names')
SELECT language_id, '["' || string_agg(val, '","' ORDER BY a, b, c, seq) || '"]' AS names FROM f WHERE k = 1 GROUP BY language_id""")
def profile_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON; the alternate names that they say."""
    return profile.to_json(_values(spark, sf_dir)).select("language_id", F.get_json_object("profile", "$.identity.alternate_names").alias("names")).where("names IS NOT NULL")


@R.query(f"""WITH {_VALUES}, e AS (SELECT language_id, grp, field, 'U' || max(seq) AS val, max(seq) + 1000000 AS seq FROM v WHERE seq % 3 = 0 GROUP BY language_id, grp, field),
o AS (SELECT v.language_id, v.grp, v.field, v.val, v.source_type, bool_or(v.preferred AND e.seq IS NULL) AS preferred FROM v LEFT JOIN e USING (language_id, grp, field) GROUP BY ALL)
SELECT * FROM o UNION ALL SELECT language_id, grp, field, val, 'user', true FROM e""")
def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users enter is preferred, and what was is no longer."""
    v = _values(spark, sf_dir)
    entered = v.where("seq % 3 = 0").groupBy("language_id", "grp", "field").agg(F.max("seq").alias("last")).select("language_id", "grp", "field", F.to_json(F.array(F.concat(F.lit("U"), F.col("last").cast("string")))).alias("value_json"), F.current_timestamp().cast("timestamp_ntz").alias("recorded_at"), (F.col("last") + 1000000).alias("seq"))
    return profile.set_user_values(v, entered).select("language_id", "grp", "field", F.get_json_object("value_json", "$[0]").alias("val"), "source_type", "preferred")


@R.query(f"""WITH {_VALUES}, f AS (SELECT language_id, val, row_number() OVER (PARTITION BY language_id, val ORDER BY NOT preferred, source_type <> 'user', -confidence, seq) AS k, NOT preferred AS a, source_type <> 'user' AS b, -confidence AS c, seq FROM v WHERE status = 'accepted' AND field = 'alternate_names'),
t AS (SELECT language_id, row_number() OVER (PARTITION BY language_id ORDER BY a, b, c, seq) - 1 AS seq, val AS term FROM f WHERE k = 1), l AS (SELECT DISTINCT user_id AS language_id FROM events)
SELECT language_id, 2000 + seq AS seq, term, 'alternate_name' AS kind, 0.8::DOUBLE AS weight FROM t UNION ALL SELECT language_id, 0, 'L' || language_id, 'name', 0.9 FROM l UNION ALL SELECT language_id, 1000, 'i' || language_id, 'iso_code', 0.85 FROM l""")
def profile_scan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that file names are scanned for, from profiles."""
    v = _values(spark, sf_dir)
    i = F.col("language_id").cast("string")
    languages = v.select("language_id").distinct().select("language_id", F.concat(F.lit("L"), i).alias("name"), F.concat(F.lit("i"), i).alias("iso"))
    return profile.scan_terms(v, languages).select("language_id", F.col("seq").cast("long").alias("seq"), "term", "kind", "weight")


@R.query("""SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'A, ' || c_name WHEN 1 THEN c_name || ' (town, R1)' WHEN 2 THEN c_custkey || '–' || (c_custkey + 5) WHEN 3 THEN c_custkey || ' (approx.)' WHEN 4 THEN 'yes' WHEN 5 THEN c_name
WHEN 6 THEN 'limited (' || c_name || ')' WHEN 7 THEN '—' ELSE 'book · ' || c_name END AS shown FROM customer""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of profiles as people read them."""
    c, k, i = table(spark, sf_dir, "customer"), F.col("c_custkey") % 9, F.col("c_custkey")
    json = (
        F.when(k == 0, F.to_json(F.array(F.lit("A"), F.col("c_name")))).when(k == 1, F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("town").alias("type"), F.lit("R1").alias("region")))).when(k == 2, F.to_json(F.struct(i.alias("min"), (i + 5).alias("max"))))
        .when(k == 3, F.to_json(F.struct(i.alias("value"), F.lit(True).alias("approximate")))).when(k == 4, "true").when(k == 5, F.concat(F.lit('"'), "c_name", F.lit('"'))).when(k == 6, F.to_json(F.struct(F.lit("limited").alias("state"), F.col("c_name").alias("detail"))))
        .when(k == 7, "[]").otherwise(F.to_json(F.struct(F.lit("book").alias("kind"), F.col("c_name").alias("title"))))
    )
    return c.select("c_custkey", display_value(json).alias("shown"))


@R.query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || '–Tai' ELSE 'the ' || c_name END AS name FROM customer")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without footnote marks and glosses."""
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), "c_name", F.lit("[12] (a gloss) "))).when(k == 1, F.concat("c_name", F.lit("[1]–Tai[2];"))).otherwise(F.concat(F.lit("the "), "c_name", F.lit(" (x).")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 2, F.regexp_replace(clean_name(raw), r" \(x\)$", "")).otherwise(clean_name(raw)).alias("name"))


@R.query("""SELECT c_custkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS shown FROM (SELECT c_custkey, c_custkey * 7 AS s FROM customer)""")
def human_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", human_time(F.col("c_custkey") * 7).alias("shown"))


@R.query(rf"""SELECT doc_id, 'f' || doc_id || {_sql_pick('doc_id', '.txt', '.json', '.eaf', '.pdf')} AS filename, CASE doc_id % 4 WHEN 1 THEN coalesce(lang, 'no') WHEN 2 THEN 'l' || doc_id || ', x' WHEN 3 THEN 'en' END AS language,
CASE WHEN doc_id % 4 = 3 THEN source END AS title, CASE WHEN doc_id % 4 = 3 THEN '1' END AS pages_seen, CASE WHEN doc_id % 4 <> 3 THEN 'utf-8' END AS encoding FROM documents""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files say of themselves: PDF heads, JSON keys, languages of annotations, encodings."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    body = (
        F.when(k == 0, F.concat(F.lit("text of "), "source")).when(k == 1, F.to_json(F.struct(F.coalesce("lang", F.lit("no")).alias("lang"), F.lit(1).alias("n"))))
        .when(k == 2, F.concat(F.lit('<T LANG_REF="x"/><T LANG_REF="l'), i, F.lit('"/>'))).otherwise(F.concat(F.lit("%PDF-1.4 /Title ("), "source", F.lit(") /Lang (en) <</Type /Page>> <</Type /Pages>>")))
    )
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), i, _pick(F.col("doc_id"), ".txt", ".json", ".eaf", ".pdf")).alias("name"), body.cast("binary").alias("content"), _pick(F.col("doc_id"), "text", "json", "elan", "pdf").alias("format"), F.when(k == 3, "documents").otherwise("text").alias("category"), F.lit("extension").alias("detected_by"))
    m = extract.basic_metadata(files, "doc_id")
    return m.select("doc_id", *(F.col("metadata")[c].alias(c) for c in ("filename", "language", "title", "pages_seen", "encoding")))


@R.query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' ELSE CASE WHEN octet_length(encode(text)) > 2000 THEN 'too large' WHEN text = '' THEN 'empty' ELSE 'fine' END END AS state FROM documents WHERE text IS NOT NULL")
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("doc_id") % 4
    size = F.when(k == 1, 0).when(k > 1, F.octet_length("text"))
    return d.select("doc_id", ingest.file_state(size, 2000).alias("state"))


@R.query(rf"""WITH {_TARGETS},
a AS (SELECT page_id, n, CASE page_id % 5 WHEN 0 THEN target || '.pdf' WHEN 1 THEN 'https://zenodo.org/records/' || page_id % 50 WHEN 2 THEN 'https://github.com/a/b/blob/main/' || page_id || '/' || n WHEN 3 THEN 'https://archive.org/details/i' || page_id ELSE target END AS u, (page_id * 7) % 90 AS page_score FROM g WHERE regexp_matches(target, '^https?://')),
f AS (SELECT *, CASE WHEN contains(u, 'zenodo.org/records/') THEN 'zenodo' WHEN contains(u, 'archive.org/details/') THEN 'internet_archive' WHEN contains(u, '/blob/') THEN 'github_blob' END AS kind FROM a),
w AS (SELECT page_id, n, u, page_score, kind, regexp_matches(path || CASE WHEN query = '' THEN '' ELSE '?' || query END, '(?i)\.({web.FILE_EXTENSIONS})($|\?)') AS file, {_NORMAL} AS key FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(x, '^(utm_|fbclid|ref)')), '&') AS kept FROM (SELECT page_id, n, u, page_score, kind{_PARTS} FROM f))),
o AS (SELECT key, min(struct_pack(s := page_id * 1000 + n, u := u)) AS f, max(page_score) AS page_score, any_value(kind) AS kind FROM w WHERE file OR kind IS NOT NULL GROUP BY key),
s AS (SELECT key, f.s AS seq, f.u AS u, kind, greatest(CASE WHEN contains(f.u, 'th') THEN 50 ELSE 0 END, page_score - 20) AS score FROM o),
r AS (SELECT *, CASE WHEN kind IN ('zenodo', 'internet_archive') THEN 'record' WHEN score < 30 THEN 'skip' ELSE 'download' END AS action FROM s)
SELECT * FROM (SELECT replace(replace(u, 'github.com/a/b/blob/', 'raw.githubusercontent.com/a/b/'), '\', '\') AS url, key, kind, score, action, row_number() OVER (PARTITION BY action ORDER BY seq, key) AS rank FROM r) WHERE action <> 'download' OR rank <= 40""")
def crawled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that pages link to: worth what they say themselves or their page less 20 points, skipped, loaded, or expanded as records."""
    p = table(spark, sf_dir, "pages").select("page_id", F.btrim("url").alias("base"), F.posexplode(html_links(F.col("html"))).alias("n", "l"))
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    p = p.select("page_id", "n", web.resolve_url(F.col("base"), F.col("l.url")).alias("target")).where(F.col("target").rlike("^https?://"))
    url = F.when(k == 0, F.concat("target", F.lit(".pdf"))).when(k == 1, F.concat(F.lit("https://zenodo.org/records/"), (F.col("page_id") % 50).cast("string"))).when(k == 2, F.concat(F.lit("https://github.com/a/b/blob/main/"), i, F.lit("/"), F.col("n").cast("string"))).when(k == 3, F.concat(F.lit("https://archive.org/details/i"), i)).otherwise(F.col("target"))
    links = p.select((F.col("page_id") * 1000 + F.col("n")).alias("seq"), url.alias("url"), ((F.col("page_id") * 7) % 90).alias("page_score"))
    scores = links.select("url", F.when(F.contains("url", F.lit("th")), 50).otherwise(0).alias("score"))
    return discover.file_actions(links, scores).withColumn("rank", F.col("rank").cast("long"))


def _sql_resolve(base: str, link: str) -> str:
    scheme, host, path = f"regexp_extract({base}, '^([a-z]+)://', 1)", f"regexp_extract({base}, '^[a-z]+://([^/?#]*)', 1)", f"regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    folder = f"CASE WHEN regexp_replace({path}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END"
    return (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link} WHEN starts_with({link}, '/') THEN {scheme} || '://' || {host} || {link} "
        f"WHEN starts_with({link}, '#') OR {link} = '' THEN {scheme} || '://' || {host} || {path} || {link} ELSE {scheme} || '://' || {host} || {folder} || {link} END"
    )


def _sql_addresses(raws: str, name: str) -> str:
    """CTEs: the distinct addresses u of raws with key, host and what they are."""
    kept = "array_to_string(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(x, '^(utm_|fbclid|ref)')), '&') AS kept"
    skipped = " OR ".join(f"contains(lower(host), '{s}')" for s in web.SKIPPED_HOSTS)
    return rf"""{name} AS (SELECT u, {_NORMAL} AS key, lower(host) AS host, regexp_matches(path || CASE WHEN query = '' THEN '' ELSE '?' || query END, '(?i)\.({web.FILE_EXTENSIONS})($|\?)') AS file, regexp_matches(u, '^https?://') AND NOT ({skipped}) AS fit FROM (SELECT *, {kept} FROM (SELECT u{_PARTS} FROM ({raws}))))"""


_ANCHOR = _LINK.replace(".*?</a>", "(.*?)</a>")


@R.query(rf"""WITH {_sql_addresses("SELECT DISTINCT url AS u FROM pages", "n1")},
pg AS (SELECT key, min(page_id) AS page_id FROM pages JOIN n1 ON u = url GROUP BY key),
s1 AS (SELECT min(url) AS url FROM pages JOIN n1 ON u = url GROUP BY host),
c1 AS (SELECT key, min(url) AS url, min(host) AS host FROM s1 JOIN n1 ON u = url WHERE fit GROUP BY key),
f1 AS (SELECT key, url, host FROM (SELECT c1.*, row_number() OVER (PARTITION BY c1.host ORDER BY c1.key) AS k FROM c1 JOIN n1 ON u = url WHERE NOT file) WHERE k <= 6 ORDER BY k, key LIMIT 40),
v1 AS (SELECT f1.*, page_id FROM f1 JOIN pg USING (key)),
l AS (SELECT v1.key AS from_key, v1.url AS base, unnest(range(0, len(regexp_extract_all(html, '{_LINK}')))) AS n, trim(unnest(regexp_extract_all(html, '{_LINK}', 1))) AS link, substr({sql_strip(f"unnest(regexp_extract_all(html, '{_ANCHOR}', 2))")}, 1, 200) AS anchor FROM v1 JOIN pages USING (page_id)),
t AS (SELECT from_key, n, anchor, {_sql_resolve('base', 'link')} AS u FROM l),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_key ORDER BY n) AS k FROM t WHERE contains({sql_fold("anchor || ' ' || u")}, 'the') OR contains({sql_fold("anchor || ' ' || u")}, 'example')) WHERE k <= 6),
{_sql_addresses("SELECT DISTINCT u FROM w", "n2")},
c2 AS (SELECT key, min(w.u) AS url, min(host) AS host FROM w JOIN n2 ON n2.u = w.u WHERE fit AND key NOT IN (SELECT key FROM v1) GROUP BY key),
been AS (SELECT host, count(*) AS been FROM v1 GROUP BY host),
f2 AS (SELECT key, url, host FROM (SELECT c2.*, row_number() OVER (PARTITION BY c2.host ORDER BY c2.key) + coalesce(been, 0) AS k, row_number() OVER (PARTITION BY c2.host ORDER BY c2.key) AS r FROM c2 JOIN n2 ON n2.u = c2.url LEFT JOIN been ON been.host = c2.host WHERE NOT file) WHERE k <= 6 ORDER BY r, key LIMIT 40),
v AS (SELECT key, host, page_id, 1 AS depth FROM v1 UNION ALL SELECT key, host, page_id, 2 FROM f2 JOIN pg USING (key))
SELECT key, depth, host, substr({_TITLE}, 1, 300) AS title FROM v JOIN pages USING (page_id)""")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds from the first page of each host, over the table of pages as the web, with the caps for a host and a round."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", web.normalise_url(F.col("url")).alias("key"), web.host(F.col("url")).alias("host"), html_title(F.col("html")).alias("title"), html_links(F.col("html")).alias("links"))
    web_ = p.groupBy("key").agg(F.min_by(F.struct("title", "links"), "page_id").alias("p")).select("key", "p.*")
    seeds = p.groupBy("host").agg(F.min("url").alias("url"))
    return crawl.crawl(seeds, lambda asked: asked.join(web_, "key"), ["the", "example"]).select("key", "depth", "host", "title")


@R.query("""SELECT 'https://zenodo.org/records/' || p_size AS url, 'https://zenodo.org/api/records/' || p_size AS request, 'T' || p_size AS title, 'cc-by' AS licence, 'http://z/' || p_partkey AS file, p_partkey AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part WHERE p_size % 2 = 0) WHERE k <= 10
UNION ALL SELECT 'https://archive.org/details/i' || p_size, 'https://archive.org/metadata/i' || p_size, 'T' || p_size, NULL, 'https://archive.org/download/i' || p_size || '/' || p_partkey || '%20a.pdf', p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part WHERE p_size % 2 = 1) WHERE k <= 10""")
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of repositories: where their files are listed, and the first of them."""
    p, i, even = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_size") % 2 == 0
    n = F.col("p_size").cast("string")
    files = F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("order"), F.concat(i, F.lit(" a.pdf")).alias("name"), i.alias("size"), F.struct(F.concat(F.lit("http://z/"), i).alias("self")).alias("links"))))
    title, licence = F.concat(F.lit("T"), n), F.when(even, F.struct(F.lit("cc-by").alias("id")))
    bodies = p.groupBy("p_size").agg(files.alias("files")).select(F.when(even, F.concat(F.lit("https://zenodo.org/records/"), n)).otherwise(F.concat(F.lit("https://archive.org/details/i"), n)).alias("url"), F.to_json(F.struct(F.struct(title.alias("title"), licence.alias("license")).alias("metadata"), F.col("files"))).alias("body"))
    asked = discover.record_requests(bodies.select("url"))
    return discover.record_files(bodies.join(asked, "url")).join(asked.select("url", "request"), "url")


@R.query(rf"""WITH n AS (SELECT {_CODED} AS code, n_name AS name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT n_nationkey AS query_id, code, name, 'Land ' || n_nationkey AS alt FROM n)
SELECT query_id, code, CASE WHEN query_id % 2 = 0 THEN alt ELSE name END AS name, CASE WHEN query_id % 2 = 0 THEN name || ',Isle ' || query_id ELSE alt || ',Isle ' || query_id END AS others, r_name AS region FROM q JOIN n USING (code)""".replace("FROM q JOIN n USING (code)", "FROM q JOIN (SELECT code AS c2, r_name FROM n) x ON c2 = code"))
def display_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages found, as they are shown: led by the name that was asked for, with other names and region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    l = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(k, _letters(k).alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    i = k.cast("string")
    one = lambda kind, text, seq: l.select("code", F.lit(kind).alias("kind"), text.alias("text"), F.lit(seq).alias("seq"))
    names = one("name", F.col("name"), 0).union(one("alternate_name", F.concat(F.lit("Land "), i), 1)).union(one("alternate_name", F.concat(F.lit("Isle "), i), 2))
    q = l.select(k.alias("query_id"), F.when(k % 2 == 0, F.concat(F.lit("LAND "), i)).otherwise(F.col("name")).alias("query"))
    found = registry.find(q, registry.name_index(names), l.select("code", "name")).where("score >= 0.9")
    return registry.display_records(found, names, l.select("code", "region")).withColumn("others", F.array_join("others", ","))


@R.query(rf"""WITH l AS (SELECT {_CODED} AS code, n_name AS name, n_nationkey FROM nation)
SELECT code, 'name' AS kind, name AS text FROM l UNION ALL SELECT code, 'alternate_name', 'Land ' || n_nationkey FROM l UNION ALL SELECT code, 'alternate_name', name || ', Old' FROM l
UNION ALL SELECT code, 'retired', 'z' || right(code, 2) FROM l UNION ALL SELECT code, 'parent', 'mac' FROM l WHERE n_nationkey % 2 = 0 UNION ALL SELECT code, 'dialects', 'Hakhun|' || n_nationkey FROM l""")
def code_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code tables as files: names, alternates without the primary name, retirements, macrolanguages, details with lists."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    i, code = k.cast("string"), _letters(k)
    place = f"{shared_folder(spark)}/verbena-codes-{uuid.uuid4().hex}"
    tabbed = lambda d, name: d.write.csv(f"{place}/{name}", sep="\t", header=True, quote="", emptyValue="")
    old = F.concat(F.lit("z"), F.substring(code, 2, 2))
    tabbed(n.select(code.alias("Id"), F.lit("I").alias("Scope"), F.lit("L").alias("Language_Type"), F.col("n_name").alias("Ref_Name")), "iso-639-3.tab")
    tabbed(n.select(code.alias("Id"), F.concat(F.lit("Land "), i).alias("Print_Name"), F.concat("n_name", F.lit(", Old")).alias("Inverted_Name")).union(n.select(code, "n_name", F.lit(""))), "iso-639-3_Name_Index.tab")
    tabbed(n.select(old.alias("Id"), code.alias("Change_To"), F.lit("C").alias("Ret_Reason")), "iso-639-3_Retirements.tab")
    tabbed(n.where(k % 2 == 0).select(F.lit("mac").alias("M_Id"), code.alias("I_Id")), "iso-639-3-macrolanguages.tab")
    empty = [F.lit("x").alias(c) for c in ("glottocode", "name", "family", "classification", "macroarea", "countries")]
    n.select(code.alias("iso"), *empty, F.concat(F.lit("Hakhun|"), i).alias("dialects"), *(F.lit("y").alias(c) for c in ("names", "likely_script", "aes", "med"))).write.csv(f"{place}/reference.csv", header=True)
    named = registries.language_names(spark, place).select("code", "kind", "text")
    gone = registries.retirements(spark, place).select(F.col("change_to").alias("code"), F.lit("retired"), F.col("code"))
    parents = registries.macrolanguages(spark, place).select("code", F.lit("parent"), "parent")
    more = registries.details(spark, f"{place}/reference.csv").select("code", F.lit("dialects"), F.array_join("dialects", "|"))
    return named.union(gone).union(parents).union(more)


@R.query("SELECT event_id, event_type AS level, value FROM events")
def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, written in two goes and read back."""
    place = f"{shared_folder(spark)}/verbena-log-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), "value")
    for part in (0, 1):
        sinks.append_log(e.where(F.col("event_id") % 2 == part), place)
    return spark.read.schema("event_id long, level string, value double").json(place)


@R.query("""SELECT conv_id, turn, '{"n": ' || (conv_id * 100 + turn) || ', "role": "' || role || '"}' AS answer FROM conversations""")
def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a command-line tool answers to prompts, asked on the executors; the tool here repeats what it is told."""
    c = table(spark, sf_dir, "conversations")
    prompt = F.concat(F.lit('Say {this}: {"n": '), (F.col("conv_id") * 100 + F.col("turn")).cast("string"), F.lit(', "role": "'), "role", F.lit('"} now'))
    cores = spark.sparkContext.defaultParallelism  # a tool of one's own, so as many at a time as the cluster has cores
    return agents.answers(c.select(F.struct("conv_id", "turn").alias("key"), prompt.alias("prompt")), "cat", parallel=cores).select("key.conv_id", "key.turn", "answer")


@R.query(rf"""WITH e AS (SELECT lower(n_name) || CASE WHEN n_nationkey % 6 = 5 THEN '!' ELSE '' END AS name, {_sql_pick('n_nationkey', 'json', 'rss', 'soap', 'html')} AS kind, n_nationkey % 5 > 0 AS url, n_nationkey FROM nation)
SELECT name, kind, n_nationkey % 7 < 3 AS enabled, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 THEN 'needs a key' ELSE '' END AS why, row_number() OVER (ORDER BY n_nationkey % 7 >= 3, CASE WHEN n_nationkey % 7 < 3 THEN n_nationkey END, name) AS place FROM e WHERE kind <> 'soap' AND url AND NOT contains(name, '!')""")
def engine_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search engines from a registry: those that can be used, those in use first."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a registry's entries are on the driver: files of a user
    kinds = ("json", "rss", "soap", "html")
    entries = [{"name": r.n_name.lower() + "!" * (r.n_nationkey % 6 == 5), "kind": kinds[r.n_nationkey % 4], "needs_key": r.n_nationkey % 3 == 0} | ({"url": "u"} if r.n_nationkey % 5 else {}) for r in rows]
    good, _ = config.registry("engine", entries)
    shown = config.listing(good, [r.n_name.lower() for r in rows if r.n_nationkey % 7 < 3], {r.n_name.lower(): "k" for r in rows if r.n_nationkey % 2 == 0}, {})
    return spark.createDataFrame([(e["name"], e["kind"], e["enabled"], e["why"], i + 1) for i, e in enumerate(shown)], "name string, kind string, enabled boolean, why string, place long")


@R.query("""WITH d AS (SELECT text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL)
SELECT 'duplicate_linked' AS status, count(*) AS n FROM d WHERE k > 1 HAVING count(*) > 0 UNION ALL SELECT 'stored', count(*) FROM d WHERE k = 1 UNION ALL SELECT 'session finished', 1 UNION ALL SELECT 'finds', count(*) FROM d""")
def collected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken in by a collection of their own, as a user's import: outcomes, finds and the session's state."""
    from verbena.service import Collection

    c = Collection(spark, f"{shared_folder(spark)}/verbena-collection-{uuid.uuid4().hex}")
    language = c.open_language("Thonin", "tho")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    c.take_in(d.select(F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.lit("import").alias("method"), F.lit(True).alias("user_asserted")), language, "import")
    statuses = c.table("outcome").groupBy("status").agg(F.count("*").alias("n"))
    sessions = c.sessions().groupBy(F.concat(F.lit("session "), "status").alias("status")).agg(F.count("*").alias("n"))
    return statuses.union(sessions).union(c.table("find").agg(F.lit("finds").alias("status"), F.count("*").alias("n")).select("status", "n"))


@R.query("""WITH e AS (SELECT user_id AS a, user_id % 7 AS b, max(value) AS similarity FROM events WHERE user_id <> user_id % 7 GROUP BY ALL)
SELECT a AS resource_id, b AS other_id, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS place FROM (SELECT a, b, similarity FROM e UNION SELECT b, a, similarity FROM e)""")
def near_duplicate_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource's near duplicates, the nearest first."""
    e = table(spark, sf_dir, "events").where("user_id <> user_id % 7").groupBy(F.col("user_id").alias("resource_id"), (F.col("user_id") % 7).alias("other_id")).agg(F.max("value").alias("similarity"))
    both = state.near_duplicates(e.withColumn("seq", F.col("similarity")))
    return state.ranked(both, "resource_id", F.desc("similarity"), "other_id").withColumn("place", F.col("place").cast("long"))


@R.query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'image signatures need an image decoder' WHEN doc_id % 5 = 1 THEN 'audio signatures need a decoder' WHEN coalesce(text, '') = '' THEN 'no text'
WHEN len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) < 20 THEN 'too little text for a signature' ELSE '' END AS note FROM documents""".replace("\\\\", "\\"))
def signature_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a resource has no signature."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), _pick(F.col("doc_id"), "images", "audio", "text", "documents", "text").alias("category"), "text")
    return neardup.sketch_notes(rows).select(F.col("id").alias("doc_id"), "note")


@R.query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'offline' WHEN 1 THEN 'import' WHEN 2 THEN 'catalogue' ELSE 'agent' END AS method FROM documents")
def candidate_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose method is one of the four; any other fails the job (see tests)."""
    return ingest.checked(table(spark, sf_dir, "documents").select("doc_id", _pick(F.col("doc_id"), *ingest.METHODS).alias("method")))


@R.query("""SELECT source AS language_id, coalesce(lang, 'other') AS category, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def stored_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents written by language and category, and what then lies there."""
    place = f"{shared_folder(spark)}/verbena-resources-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    sinks.write_resources(d.select(F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"), F.col("source").alias("language_id"), F.coalesce("lang", F.lit("other")).alias("category")), place)
    held = spark.read.schema("sha256 string, content binary, language_id string, category string").parquet(place)
    return sinks.verified(held).where("intact").groupBy("language_id", "category").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
