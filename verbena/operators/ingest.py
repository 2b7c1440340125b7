"""Candidates to outcomes, a whole set at once: relevance, validation, formats, exact duplicates, types, provenance, review.

"First" always means the least seq, so any order of rows gives the same outcomes, and taking in the same candidates again only
adds provenance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.operators import classify, relevance
from verbena.session import written

#: Metadata that tells of a find's surroundings, not of the resource.
CONTEXT_KEYS = ("query", "found_on", "page_title", "agent", "snippet")


#: The ways in which a candidate may be found.
METHODS = ("offline", "import", "catalogue", "agent")  # members of archives have the method of their archive


def checked(candidates: DataFrame) -> DataFrame:
    """candidates; one whose method is none of METHODS fails the job that reads it."""
    bad = F.raise_error(F.concat(F.lit("unknown method "), F.coalesce("method", F.lit("null"))))
    return candidates.withColumn("method", F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise(bad))


def file_state(size: Column, most_bytes: int) -> Column:
    """missing, too large, empty or fine: what validation says of a file by its size (null: there is none)."""
    return F.when(size.isNull(), "missing").when(size > most_bytes, "too large").when(size == 0, "empty").otherwise("fine")


@dataclass(frozen=True)
class Limits:
    review_at: int = 30
    confirmed_at: int = 70
    most_bytes: int = 4096 * 1024 * 1024


def described(candidates: DataFrame) -> DataFrame:
    """candidates with text: path, title, matched terms and metadata that count as evidence."""
    texts = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*CONTEXT_KEYS) & v.isNotNull())
    parts = F.transform(F.array_sort(F.map_entries(texts)), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))
    return candidates.withColumn("text", F.concat_ws(" ", "path", "title", *(F.nullif(F.array_join(x, " "), F.lit("")) for x in ("matched_terms", parts))))


def outcomes(candidates: DataFrame, languages: DataFrame, terms: DataFrame, stored: DataFrame | None = None, limits: Limits | None = None, word_names: list[str] | None = None) -> DataFrame:
    """candidate_id, session_id, language_id, seq, sha256, size, status, score, band, format, category, duplicate_of (the first candidate with these bytes), message.

    candidates: candidate_id, session_id, language_id, seq, path, content (binary, null: no file), and where known title, matched_terms, metadata,
    types, user_asserted, discovery_confidence. stored: sha256 of resources held already.
    """
    limits = limits or Limits()
    optional = {"title": "string", "matched_terms": "array<string>", "metadata": "map<string,string>", "types": "array<string>", "user_asserted": "boolean", "discovery_confidence": "double"}
    c = candidates
    for k, v in optional.items():
        if k not in c.columns:
            c = c.withColumn(k, F.lit(None).cast(v))
    c = described(c).withColumns({"metadata_language": F.col("metadata")["language"], "size": F.length("content"), "sha256": F.sha2("content", 256), "head": F.substring("content", 1, 16), "name": F.regexp_extract("path", r"([^/\\]+)$", 1)})
    wanted = ("candidate_id", "session_id", "language_id", "seq", "path", "title", "size", "sha256", "head", "name")
    scored = relevance.score(c.select(*wanted, "text", "metadata_language", "types", "user_asserted", "discovery_confidence"), languages, terms, word_names)
    c = scored.drop("matched_terms")
    c = classify.detect_format(c)
    fine = (F.col("score") >= limits.review_at) & F.col("size").isNotNull() & (F.col("size") <= limits.most_bytes)
    # bytes belong to the first candidate that may be stored; a minimum for each hash, so neither copies nor candidates without bytes meet in one task
    c = written(c.withColumn("fine", fine), "scored")
    owner = c.where("fine").groupBy("sha256").agg(F.min(F.struct("seq", "candidate_id")).alias("owner"))
    c = c.join(owner, "sha256", "left")
    if stored is not None:
        c = c.join(stored.select("sha256", F.lit(True).alias("held")).distinct(), "sha256", "left")
    else:
        c = c.withColumn("held", F.lit(None).cast("boolean"))
    again = F.coalesce("held", F.lit(False)) | (F.col("owner.candidate_id") != F.col("candidate_id"))
    status = (
        F.when(F.col("size").isNull(), "failed").when(F.col("score") < limits.review_at, "rejected").when(F.col("size") > limits.most_bytes, "failed")
        .when(again, "duplicate_linked").when(F.col("score") < limits.confirmed_at, "uncertain_review").otherwise("stored")
    )
    message = F.when(F.col("size").isNull(), "no local file").when(F.col("score") < limits.review_at, "below relevance threshold").when(F.col("size") > limits.most_bytes, "exceeds the size limit")
    first = F.when(status == "duplicate_linked", F.col("owner.candidate_id"))
    return c.select("candidate_id", "session_id", "language_id", "seq", "path", "title", "sha256", "size", status.alias("status"), "score", "band", "reasons", "format", "category", first.alias("duplicate_of"), message.alias("message"), (file_state(F.col("size"), limits.most_bytes) == "empty").alias("empty_file"))


def resources(outcomes_: DataFrame) -> DataFrame:
    """The resources that outcomes store: sha256, size, name, format, category, seq."""
    kept = outcomes_.where(F.col("status").isin("stored", "uncertain_review"))
    return kept.select("sha256", "size", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), "format", "category", "seq")


def provenance(outcomes_: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each find of a resource: sha256, language_id, session_id, method, url, original_path (of local methods, else what is given)."""
    kept = outcomes_.where(F.col("status").isin("stored", "uncertain_review", "duplicate_linked")).select("candidate_id", "sha256")
    local = F.coalesce("original_path", F.when(F.col("method").isin("offline", "import"), F.col("path")))
    return candidates.join(kept, "candidate_id").select("sha256", "language_id", "session_id", "method", "url", local.alias("original_path"))


def review_items(outcomes_: DataFrame) -> DataFrame:
    """What a person has to decide: uncertain candidates, duplicates included, with confidence and payload."""
    unsure = outcomes_.where((F.col("status") == "uncertain_review") | ((F.col("status") == "duplicate_linked") & (F.col("score") < 70)))
    payload = F.to_json(F.struct("sha256", "path", "title", "score", "reasons"))
    return unsure.select(F.col("candidate_id").alias("item_id"), "language_id", "session_id", F.lit("resource").alias("kind"), payload.alias("payload"), (F.col("score") / 100.0).alias("confidence"))


def sidecars(outcomes_: DataFrame) -> DataFrame:
    """A JSON text for each stored resource, to lie beside it."""
    kept = outcomes_.where(F.col("status").isin("stored", "uncertain_review"))
    name = F.concat(F.substring("sha256", 1, 12), F.lit("-"), F.regexp_extract("path", r"([^/\\]+)$", 1))
    return kept.select(name.alias("name"), F.to_json(F.struct("sha256", "size", "format", "category", "language_id", "score", "band", "status", "reasons", "path", "title")).alias("json"))
