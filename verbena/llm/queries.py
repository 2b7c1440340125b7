"""The corpus operators' queries over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import predict_languages, train_languages
from .leaks import find_leaks
from .licenses import TEMPLATES, _template_words, block_size, scan_licenses
from .linededup import dedup_lines
from .maintext import main_texts
from .mixing import mix_report
from .ngramjoin import near_classes
from .pii import KINDS, find_personal, span_text
from .quality import quality_measures
from .sessions import session_versions
from .tokencount import token_counts
from .tokenfile import read_token_blocks, write_token_blocks
from .yinyang import cluster_inertia, yinyang


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    return predict_languages(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["word"])
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.sort_array(F.array_union(base, F.transform("found", lambda f: f["label"])))
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = write_token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_blocks(blocks, order)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    both = F.concat("base", F.transform("added", lambda c: c.dropFields("score")))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(both).alias("spans"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found, centroids = yinyang(vectors, "vec_id", "embedding", dim=64, scale=64, k=16, rounds=3, first=first)
    return cluster_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("turn IS NOT NULL").select("conv_id", "turn")
    crc = lambda c: F.crc32(c.cast("binary"))
    hashed = turns.select("conv_id", "turn", crc(F.col("conv_id").cast("string")).alias("c"), crc(F.concat_ws(":", "conv_id", "turn")).alias("h"))
    timed = hashed.selectExpr("2 * floor(conv_id / 8) + c % 2 AS user", "(c div 2) % 7200 + 300 * turn + h % 600 AS second", "h div 600 AS g", "h AS value")
    events = timed.selectExpr("user", "second", "value", "floor(second / 900) + if(g % 5 = 0, g % 4, 0) AS batch")
    return session_versions(events, gap=600)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_texts(pages, out="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_ngram_join": op3_ngram_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_licenses": op5_licenses,
    "op6_leaks": op6_leaks,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_token_file": op9_token_file,
    "op10_pii": op10_pii,
    "op11_clusters": op11_clusters,
    "op12_sessions": op12_sessions,
    "op13_main_text": op13_main_text,
}

#: CRC-32 of a string of digits and colons in DuckDB's SQL.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce(range(0, 8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, x)), 4294967295::BIGINT))"""



def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of op11_clusters one after another."""
    nearest = """a{0} AS MATERIALIZED (SELECT r, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT k.r, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, m{0} m) GROUP BY r, v),
"""
    means = """m{1} AS MATERIALIZED (SELECT m.c, coalesce(n.m, m.m) AS m FROM m{0} m LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT c, unnest(v) AS x, unnest(range(0, 64)) AS i FROM a{0}) GROUP BY c, i) GROUP BY c) n USING (c)),
"""
    return (
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
"""
        + "".join(nearest.format(i) + means.format(i, i + 1) for i in range(rounds))
        + nearest.format(rounds)
        + f"""own AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, own.cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia,
       sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN own ON own.c = a.c JOIN m{rounds} m ON m.c = a.c"""
    )


#: DuckDB SQL for the queries that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op6_leaks": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
         FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM iwin),
dwin AS (SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS win
         FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw CROSS JOIN lens WHERE len(w) >= l)),
hits AS (SELECT doc_id, item, dwin.l AS l, p FROM dwin JOIN iwin USING (l, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_line_dedup": r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM lines WHERE text IS NOT NULL),
solid AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p
          FROM (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM numbered) WHERE t <> ''),
win AS (SELECT doc_id, p, least(n, 3) AS lines, CASE n WHEN 1 THEN t WHEN 2 THEN t || chr(10) || b ELSE t || chr(10) || b || chr(10) || c END AS w
        FROM (SELECT doc_id, p, t, lead(t, 1) OVER o AS b, lead(t, 2) OVER o AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM solid WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE p <= greatest(n, 3) - 3),
later AS (SELECT doc_id, p, lines FROM (SELECT doc_id, p, lines, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + lines)) AS q FROM later)),
dropped AS (SELECT solid.doc_id, solid.i FROM solid JOIN gone ON solid.doc_id = gone.doc_id AND solid.p = gone.q),
kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) AS body FROM numbered n ANTI JOIN dropped d ON n.doc_id = d.doc_id AND n.i = d.i GROUP BY n.doc_id),
ns AS (SELECT doc_id, count(*) AS n FROM solid GROUP BY doc_id),
ng AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(ns.n, 0) AS n_lines, coalesce(ng.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.body, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN ns ON ns.doc_id = d.doc_id LEFT JOIN ng ON ng.doc_id = d.doc_id""",
    "op12_sessions": f"""
WITH turns AS (SELECT conv_id, turn, {_CRC.format("CAST(conv_id AS VARCHAR)")} AS c, {_CRC.format("conv_id || ':' || turn")} AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
timed AS (SELECT 2 * CAST(floor(conv_id / 8) AS BIGINT) + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h // 600 AS g, h FROM turns),
ev AS (SELECT row_number() OVER () AS id, u, s, h, CAST(floor(s / 900) AS BIGINT) + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM timed),
upto AS (SELECT x.u, x.b, e.s, e.h, e.id, e.b = x.b AS fresh FROM (SELECT DISTINCT u, b FROM ev) x JOIN ev e ON e.u = x.u AND e.b <= x.b),
cut AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY u, b ORDER BY s, id) > 600, true) AS opens FROM upto),
islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY u, b ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS k FROM cut),
v AS (SELECT u, b, min(s) AS s, max(s) AS e, count(*) AS n, sum(fresh::INT) AS fresh, sum(h) AS h FROM islands GROUP BY u, b, k HAVING bool_or(fresh)),
after AS (SELECT v.u, v.b, v.s, min(w.b) AS rb, arg_min(w.s, w.b) AS rs FROM v JOIN v w ON w.u = v.u AND w.b > v.b AND w.s <= v.s AND v.e <= w.e GROUP BY v.u, v.b, v.s),
gone AS (SELECT u, rb, rs, count(*) AS n FROM after GROUP BY u, rb, rs)
SELECT v.u AS user, v.b AS batch, v.s AS start_s, v.e AS end_s, v.n AS n_events, CAST(v.fresh AS BIGINT) AS n_new, coalesce(gone.n, 0) AS n_retracted,
       CAST(v.h AS BIGINT) AS h_sum, after.rb AS retracted_batch, after.rs AS retracted_start_s
FROM v LEFT JOIN after USING (u, b, s) LEFT JOIN gone ON gone.u = v.u AND gone.rb = v.b AND gone.rs = v.s""",
    "op11_clusters": _clusters_sql(),
    "op5_licenses": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(p, label)),
places AS (SELECT doc_id, label, i - 1 AS spot FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) + 1)) AS i FROM w, phrases WHERE list_contains(w, p[1])) WHERE w[i : i + len(p) - 1] = p),
templates AS (SELECT * FROM (VALUES TEMPLATE_ROWS) t(s, label, wide)),
sizes AS (SELECT DISTINCT wide, wide // 2 AS half FROM templates),
blocks AS (SELECT doc_id, wide, w[b * half + 1 : b * half + wide] AS own FROM (SELECT doc_id, w, wide, half, unnest(range(0, greatest(0, CAST(floor((len(w) - half - 1) / half) AS BIGINT)) + 1)) AS b FROM w, sizes)),
met AS (SELECT doc_id, label, len(list_intersect(own, s)) / len(s) AS score FROM blocks JOIN templates USING (wide) WHERE list_has_any(own, s) AND len(list_intersect(own, s)) >= ceil(0.8 * len(s) - 1e-9)),
a AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
s AS (SELECT doc_id, max(score) AS score FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(score, 0.0::DOUBLE)) AS score
FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id""".replace("TEMPLATE_ROWS", ", ".join(f"({_template_words(t)}, '{label}', {block_size(t)})" for t, label in TEMPLATES)),
}
