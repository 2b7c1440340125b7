"""Catalogue records on their way to candidates, and what they say about a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.functions import match, web
from verbena.functions.text import fold
from verbena.operators.relevance import scanned
from verbena.sources.files import EXCLUDED


def relevance_text(results: DataFrame) -> DataFrame:
    """results (title, description, language, types, metadata) with text: all that tells what a record is about."""
    said = F.transform(F.filter(F.map_values(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda v: F.length(v) <= 500), lambda v: v)
    return results.withColumn("text", F.concat_ws(" ", "title", "description", "language", F.array_join("types", " "), F.array_join(F.slice(said, 1, 20), " ")))


def candidates(results: DataFrame) -> DataFrame:
    """Records that are to be downloaded or kept as metadata, as candidates: method, url, title, metadata and types; the file, once there, is moved."""
    wanted = results.where(F.col("action").isin("download", "metadata"))
    extra = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("catalogue", "licence", "query", "landing_url"))), F.array("provider", "licence", "query", "url")), lambda k, v: v.isNotNull())
    return wanted.select("seq", F.lit("catalogue").alias("method"), "url", "title", extra.alias("metadata"), "types", F.lit("move").alias("import_method"), (F.col("action") == "metadata").alias("synthetic"))


def display(candidates_: DataFrame) -> DataFrame:
    """candidates (title, path, url) with shown: the title, else the file's name, else the address, else a question mark."""
    some = lambda c: F.nullif(c, F.lit(""))
    return candidates_.withColumn("shown", F.coalesce(some(F.col("title")), some(F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/\\]+)$", 1)), some(F.col("url")), F.lit("?")))


def unwrapped(url: Column, parameter: str) -> Column:
    """The address inside a redirecting link, if it has one."""
    inner = F.regexp_extract(web.url_parts(url)["query"], rf"(?:^|&){parameter}=([^&]*)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(url)


def classification(path: Column) -> Column:
    """family and parent from a path of names, the family first, the language itself last."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), r"\s*[,/>]\s*"), lambda x: x != "")
    return F.struct(F.get(parts, F.lit(0)).alias("family"), F.when(F.size(parts) > 2, F.get(parts, F.size(parts) - 2)).alias("parent"))


def newick_names(tree: Column) -> Column:
    """Names in a Newick tree such as ('Hakhun [hakh1234]-d-':1,...)'Nocte [noct1238]':1, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(tree, F.lit("")), F.lit(r"'([^'\[]+?)\s*\[[a-z0-9]{8}\][^']*'"), F.lit(1)), lambda x: F.btrim(x))


def bundle_files(items: DataFrame) -> DataFrame:
    """item_id, name, url, size of the originals among the bundles of repository items (item_id, body: JSON)."""
    bundles = "array<struct<name:string,bitstreams:array<struct<name:string,url:string,sizeBytes:bigint>>>>"
    b = items.select("item_id", F.explode(F.from_json(F.get_json_object("body", "$.bundles"), bundles)).alias("b")).where("b.name = 'ORIGINAL'")
    return b.select("item_id", F.explode("b.bitstreams").alias("f")).select("item_id", "f.name", "f.url", F.col("f.sizeBytes").alias("size"))


def about_us(pages: DataFrame, names: list[str], start: int = 600) -> DataFrame:
    """pages (title, text) with about: whether title or the first characters have the name or one of the first six others."""
    blob = fold(F.concat_ws(" ", "title", F.substring("text", 1, start)))
    said = F.lit(False)
    for n in names[:7]:
        said = said | match.has_term(blob, fold(F.lit(n)))
    return pages.withColumn("about", said)


def other_languages(names: DataFrame, index: DataFrame, own: str) -> DataFrame:
    """names (value) that are another language's own name."""
    keys = index.where((F.col("kind") == "name") & (F.col("code") != own)).select("key").distinct()
    return names.withColumn("key", fold(F.col("value"))).join(keys, "key", "left_semi").drop("key")


def content_detection(texts: DataFrame, terms: DataFrame, most: int | None = 400_000) -> DataFrame:
    """file_id, detection_confidence, matched_terms of files whose contents have a name, alternate, exonym, variety or title (never a code alone).

    texts: file_id, text of files whose names said nothing; terms: seq, term, kind, weight. most: characters looked at; None: all.
    """
    blob = fold(F.col("text") if most is None else F.substring("text", 1, most))
    g = scanned(texts, "file_id", {"held": blob}, terms.where("kind <> 'iso_code'"), lambda whole, anywhere, n, kind: whole | ((n >= 8) & anywhere))
    strong = F.filter("h", lambda t: t["kind"].isin("name", "alternate_name", "exonym", "variety", "title"))
    g = g.select("file_id", F.array_max(F.transform(strong, lambda t: t["weight"])).alias("most"), F.transform("h", lambda t: t["term"]).alias("matched_terms"))
    return g.where("most IS NOT NULL").select("file_id", F.bround(F.least(F.lit(0.9), F.col("most") * 0.75), 2).alias("detection_confidence"), "matched_terms")


def skipped_folders(files: DataFrame, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """folder: the folders that a scan of files (folder) under root leaves out, each once; what lies below one that is left out is not entered."""
    below = F.split(F.substring(F.concat(F.rtrim(F.col("folder"), F.lit("/")), F.lit("/")), len(root.rstrip("/")) + 2, 1 << 30), "/")
    bad = F.transform(below, lambda d: F.lower(d).isin(*excluded) | d.startswith("."))
    at = F.array_position(bad, True).cast("int")
    return files.select(F.when(at > 0, F.array_join(F.slice(below, 1, at), "/")).alias("folder")).where("folder IS NOT NULL").distinct()


def scan_report(files: DataFrame, hits: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """files_seen, hits of a scan, and dirs_skipped if skipped has the folders that were left out."""
    if skipped is not None:
        return scan_report(files, hits).join(skipped.agg(F.count("*").alias("dirs_skipped")))
    return files.select("file_id").join(hits.select("file_id", F.lit(True).alias("hit")), "file_id", "left").agg(F.count("*").alias("files_seen"), F.count_if("hit").alias("hits"))


def archive_totals(members: DataFrame, key: str) -> DataFrame:
    """key, members, bytes, listing (of the first 500 names) of archives."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("member"))
    m = members.withColumn("k", place)
    return m.groupBy(key).agg(F.count("*").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sort_array(F.collect_list(F.when(F.col("k") <= 500, F.col("member")))).alias("listing"))


def transfer_rates(progress: DataFrame, seconds: int = 5) -> DataFrame:
    """progress (transfer, at: seconds, bytes so far) with rate: bytes a second over the last seconds."""
    back = Window.partitionBy("transfer").orderBy("at").rangeBetween(-seconds, 0)
    span = F.col("at") - F.min("at").over(back)
    return progress.withColumn("rate", F.when(span > 0, (F.col("bytes") - F.min("bytes").over(back)) / span))


def model_scores(scored: DataFrame, most: int = 25) -> DataFrame:
    """scored (score by rules, model_score, may be null) with final: a model moves the rules' score by so much at most."""
    moved = F.greatest(F.col("score") - most, F.least(F.col("score") + most, F.col("model_score")))
    # least() and greatest() pass over nulls, so a missing model is a case of its own
    return scored.withColumn("final", F.greatest(F.lit(0), F.least(F.lit(100), F.when(F.col("model_score").isNull(), F.col("score")).otherwise(moved))))
