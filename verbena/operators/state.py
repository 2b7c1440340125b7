"""Tables that change, as append-only facts with a number (seq) and views that reduce them: nothing is updated in place, so writes
are idempotent and any order of arrival gives the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.operators.profile import value_key


def latest(facts: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return facts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def languages(facts: DataFrame) -> DataFrame:
    """The last name of each id with its first created_at."""
    rest = [c for c in facts.columns if c not in ("id", "created_at", "seq")]
    return facts.groupBy("id").agg(*(F.max_by(c, "seq").alias(c) for c in rest), F.min("created_at").alias("created_at"))


def resource_languages(facts: DataFrame) -> DataFrame:
    """resource_id, language_id: the greatest score, with the band and status of the first row that reached it, and the last reasons."""
    return facts.groupBy("resource_id", "language_id").agg(
        F.max("score").alias("score"), F.max_by(F.struct("band", "status"), F.struct("score", -F.col("seq"))).alias("b"), F.max_by("reasons", "seq").alias("reasons"),
    ).select("resource_id", "language_id", "score", "b.band", "b.status", "reasons")


def resource_types(facts: DataFrame) -> DataFrame:
    return facts.groupBy("resource_id", "type", "source").agg(F.max("confidence").alias("confidence"))


def metadata(facts: DataFrame) -> DataFrame:
    """The last value that is not null of each resource_id, key, extracted_by."""
    return facts.where("value IS NOT NULL").groupBy("resource_id", "key", "extracted_by").agg(F.max_by("value", "seq").alias("value"))


def new_resources(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found (sha256, seq and more) that are not stored yet, each hash once, the first."""
    fresh = found.join(stored.select("sha256"), "sha256", "left_anti")
    w = Window.partitionBy("sha256").orderBy("seq")
    return fresh.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def near_duplicates(pairs: DataFrame) -> DataFrame:
    """resource_id, other_id, similarity both ways round, the last similarity of each."""
    both = pairs.union(pairs.select(F.col("other_id").alias("resource_id"), F.col("resource_id").alias("other_id"), "similarity", "seq"))
    return both.groupBy("resource_id", "other_id").agg(F.max_by("similarity", "seq").alias("similarity"))


def session_ids(sessions: DataFrame) -> DataFrame:
    """sessions with id COL-YYYYMMDD-NNN, numbered by start within a day, with more digits after the 999th."""
    day = F.date_format("started_at", "yyyyMMdd")
    number = F.row_number().over(Window.partitionBy(day).orderBy("started_at", "seq"))
    return sessions.withColumn("session_id", F.concat(F.lit("COL-"), day, F.lit("-"), F.format_string("%03d", number)))


def sessions(facts: DataFrame) -> DataFrame:
    """session_id, language_id, mode, started_at and the last status of each session."""
    given = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("language_id", "mode", "started_at")]
    return facts.groupBy("session_id").agg(*given, F.max_by("status", "seq").alias("status"))


#: What each outcome adds to its session's counters.
COUNTERS = {
    "relevant": ("stored", "duplicate_linked", "uncertain_review"), "downloaded": ("stored", "uncertain_review"), "duplicates": ("duplicate_linked",),
    "failed": ("failed",), "pending_review": ("uncertain_review",),
}


def session_counters(outcomes: DataFrame) -> DataFrame:
    """session_id, discovered and COUNTERS from session_id, status."""
    return outcomes.groupBy("session_id").agg(F.count("*").alias("discovered"), *(F.count_if(F.col("status").isin(*s)).alias(n) for n, s in COUNTERS.items()))


def review_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (item_id and more) with status: the last decision on each (item_id, decision, seq), else pending."""
    last = decisions.groupBy("item_id").agg(F.max_by("decision", "seq").alias("decision"))
    return items.join(last, "item_id", "left").withColumn("status", F.coalesce("decision", F.lit("pending"))).drop("decision")


def decided_values(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """values (language_id, grp, field, value_json, status, seq and more) with the status that decisions give them.

    decisions: language_id, grp, field, value_json, decision, seq. The last accepted or rejected among those made after a value was
    written counts for it; skipped changes nothing, and a value written later stands on its own. A value that is rejected is no longer preferred.
    seq tells value rows apart.
    """
    slot = ["language_id", "grp", "field"]
    d = decisions.where(F.col("decision").isin("accepted", "rejected")).select(*slot, value_key(F.col("value_json")).alias("key"), "decision", F.col("seq").alias("at"))
    # the last decision on a slot's value, if made after a value was written, is the last of those made after it: a row for each key, never one for each pair
    last = d.groupBy(*slot, "key").agg(F.max("at").alias("at"), F.max_by("decision", "at").alias("said"))
    met = values.withColumn("key", value_key(F.col("value_json"))).join(last, [*slot, "key"], "left")
    out = met.withColumn("decided", F.when(F.col("at") > F.col("seq"), F.col("said"))).withColumn("status", F.coalesce("decided", "status"))
    if "preferred" in values.columns:
        out = out.withColumn("preferred", F.col("preferred") & ~F.col("decided").eqNullSafe(F.lit("rejected")))
    return out.select(*values.columns)


def decided_resources(resources: DataFrame, decisions: DataFrame, confirmed_at: int = 70) -> DataFrame:
    """resources (sha256, language_id, score and more) with status: confirmed or uncertain by their score, or what the last decision
    (sha256, language_id, decision, seq) but skipped says: confirmed or rejected."""
    last = decisions.where(F.col("decision").isin("accepted", "rejected")).groupBy("sha256", "language_id").agg(F.max_by("decision", "seq").alias("decided"))
    status = F.when(F.col("decided") == "accepted", "confirmed").when(F.col("decided") == "rejected", "rejected").when(F.col("score") < confirmed_at, "uncertain").otherwise("confirmed")
    return resources.join(last, ["sha256", "language_id"], "left").withColumn("status", status).drop("decided")


def review_summary(items: DataFrame, languages_: DataFrame) -> DataFrame:
    """language_id, name, resources, facts, total of what is pending."""
    g = items.where("status = 'pending'").groupBy("language_id").agg(F.count_if(F.col("kind") == "resource").alias("resources"), F.count_if(F.col("kind") != "resource").alias("facts"), F.count("*").alias("total"))
    return g.join(languages_.select(F.col("id").alias("language_id"), "name"), "language_id")


def resource_listing(resources: DataFrame, languages_: DataFrame, types: DataFrame, sources: DataFrame) -> DataFrame:
    """Resources of each language with their types, joined, and the number of times they were found."""
    t = types.groupBy("resource_id").agg(F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("types"))
    s = sources.groupBy("resource_id").agg(F.count("*").alias("n_sources"))
    return resources.join(languages_, "resource_id").join(t, "resource_id", "left").join(s, "resource_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def session_bytes(resources: DataFrame, sources: DataFrame) -> DataFrame:
    """session_id, n, bytes: the distinct resources that a session found."""
    found = sources.select("session_id", "resource_id").distinct()
    return found.join(resources.select("resource_id", "size"), "resource_id").groupBy("session_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def review_sources(items: DataFrame, resources: DataFrame, texts: DataFrame, start: int = 400) -> DataFrame:
    """Items about a resource (item_id, sha256) with its name, size and the start of its text, if it has one; of several texts the longest."""
    best = texts.groupBy("sha256").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    held = resources.select("sha256", "name", "size")
    return items.join(held, "sha256").join(best, "sha256", "left").select("item_id", "sha256", "name", "size", F.substring("text", 1, start).alias("sample"))


def home(resources: DataFrame, items: DataFrame, languages_: DataFrame) -> DataFrame:
    """One row: languages, resources, bytes, pending resources and pending facts (items with status)."""
    held = resources.agg(F.count("*").alias("resources"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    pending = items.where("status = 'pending'").agg(F.count_if(F.col("kind") == "resource").alias("pending_resources"), F.count_if(F.col("kind") != "resource").alias("pending_facts"))
    return languages_.agg(F.count("*").alias("languages")).join(held).join(pending)


def catalogue_totals(results: DataFrame) -> DataFrame:
    """session_id and what its catalogues gave: discovered (lookups counted, too), lookups, relevant, metadata, files to load, failed.

    results: session_id, action, n_files, error (null: none).
    """
    is_ = lambda *a: F.count_if(F.col("action").isin(*a))
    return results.groupBy("session_id").agg(
        F.count("*").alias("discovered"), is_("lookup").alias("lookups"), is_("metadata", "download").alias("relevant"), is_("metadata").alias("metadata"),
        F.coalesce(F.sum(F.when(F.col("action") == "download", F.col("n_files"))), F.lit(0)).cast("long").alias("files"), F.count("error").alias("failed"),
    )


def ranked(rows: DataFrame, key: str, *order) -> DataFrame:  # noqa: ANN002
    """rows with place: from 1 within each key, in that order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
