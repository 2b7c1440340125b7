"""Languages by code and name: an index of folded names, lookups for many queries at once, and resolving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.functions.text import fold

#: Score of a match by the kind of name, of a retired code, and what variants cost.
NAME_SCORES = {"name": 0.98, "alternate_name": 0.9, "dialect": 0.8}
CODE, RETIRED, SPELLED_OUT, PART = 1.0, 0.9, 0.02, 0.35
#: Words dropped from "the X language".
LANGUAGE_WORDS = ("language", "jezik", "langue")
#: Checks of stored profiles in order, with their scores.
LOCAL_SCORES = {"name": 1.0, "iso": 1.0, "id": 0.99, "alternate_name": 0.92, "exonym": 0.9, "variety": 0.85}


def name_index(names: DataFrame) -> DataFrame:
    """key, code, kind, text from code, kind, text, seq: folded names, each (key, code, kind) once, the first text."""
    keyed = names.withColumn("key", fold(F.col("text"))).where("key <> ''")
    return keyed.groupBy("key", "code", "kind").agg(F.min_by("text", "seq").alias("text"))


def ambiguous(index: DataFrame, threshold: int = 3) -> DataFrame:
    """key, n_codes of names that so many languages or more have."""
    return index.groupBy("key").agg(F.count_distinct("code").alias("n_codes")).where(F.col("n_codes") >= threshold)


def find(queries: DataFrame, index: DataFrame, languages: DataFrame, retired: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """query_id, code, name, matched_on, matched_text, score, rank: the best candidates of each query.

    queries: query_id, query; languages: code, name; retired: code, change_to. A code counts once for a query, with its best match.
    Whole names are an equi-join. So are parts: names that start with a query share its first three characters, names that hold one, from
    five characters on, have its first five somewhere.
    """
    q = queries.select("query_id", F.lower(F.btrim("query")).alias("q"), fold(F.col("query")).alias("fq"))
    stripped = F.array_join(F.filter(F.split("fq", " "), lambda w: ~w.isin(*LANGUAGE_WORDS)), " ")
    q = q.withColumn("stripped", stripped)
    base = F.create_map(*(F.lit(x) for k, v in NAME_SCORES.items() for x in (k, v)))
    code_like = q.where(F.col("q").rlike(r"^\p{L}{3}$"))
    codes = code_like.join(languages, F.col("q") == F.col("code")).select("query_id", "code", F.lit("code").alias("matched_on"), F.col("q").alias("matched_text"), F.lit(CODE).alias("score"))
    hits = [codes]
    if retired is not None:
        r = code_like.join(retired.select(F.col("code").alias("old"), "change_to"), F.col("q") == F.col("old")).where("change_to <> ''")
        hits.append(r.join(languages.select("code"), F.col("change_to") == F.col("code")).select("query_id", "code", F.lit("retired_code"), F.concat("old", F.lit(" → "), "code"), F.lit(RETIRED)))
    named = lambda on, off: q.where(on != "").join(index, on == F.col("key")).select("query_id", "code", "kind", "text", (base[F.col("kind")] - off).alias("score"))
    hits.append(named(F.col("fq"), 0.0))
    hits.append(q.where("stripped <> '' AND stripped <> fq").join(index, F.col("stripped") == F.col("key")).select("query_id", "code", "kind", "text", (base[F.col("kind")] - SPELLED_OUT).alias("score")))
    parts = q.where(F.length("fq") >= 3)
    heads = parts.join(index, (F.substring("fq", 1, 3) == F.substring("key", 1, 3)) & F.startswith("key", "fq"))
    runs = F.transform(F.sequence(F.lit(1), F.length("key") - 4), lambda i: F.substr("key", i, F.lit(5)))
    inside = index.where(F.length("key") >= 5).select("*", F.explode(F.array_distinct(runs)).alias("run"))
    inside = parts.where(F.length("fq") >= 5).join(inside, (F.substring("fq", 1, 5) == F.col("run")) & F.contains("key", "fq"))
    for met in (heads, inside):
        hits.append(met.select("query_id", "code", "kind", "text", (base[F.col("kind")] - PART).alias("score")))
    every = hits[0]
    for h in hits[1:]:
        every = every.union(h)
    best = every.groupBy("query_id", "code").agg(F.max_by(F.struct("matched_on", "matched_text"), F.struct("score", "matched_on", "matched_text")).alias("m"), F.max("score").alias("score"))
    ranked = best.join(languages.select("code", "name"), "code")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "code")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "code", "name", "m.matched_on", "m.matched_text", "score", "rank")


def find_local(queries: DataFrame, profile_names: DataFrame) -> DataFrame:
    """query_id, language_id, matched_on, matched_text, score: stored profiles that a query names, the first check that fits.

    profile_names: language_id, check (a key of LOCAL_SCORES), text.
    """
    order = F.create_map(*(F.lit(x) for i, k in enumerate(LOCAL_SCORES) for x in (k, i)))
    scores = F.create_map(*(F.lit(x) for k, v in LOCAL_SCORES.items() for x in (k, v)))
    q = queries.select("query_id", fold(F.col("query")).alias("key")).where("key <> ''")
    met = q.join(profile_names.withColumn("key", fold(F.col("text"))), "key")
    first = met.groupBy("query_id", "language_id").agg(F.min_by(F.struct("check", "text"), F.struct(order[F.col("check")], "text")).alias("m"))
    return first.select("query_id", "language_id", F.col("m.check").alias("matched_on"), F.col("m.text").alias("matched_text"), scores[F.col("m.check")].alias("score"))


def resolve(queries: DataFrame, local: DataFrame, bundled: DataFrame, identity: DataFrame) -> DataFrame:
    """query_id, status (exact, ambiguous, none), n, best_code, best_score: stored profiles first, then codes that none of them has.

    local and bundled as from find_local() and find(); identity: language_id, code of stored profiles.
    """
    mine = local.join(identity, "language_id", "left").select("query_id", F.coalesce("code", F.col("language_id").cast("string")).alias("code"), "matched_on", "score", F.lit(0).alias("source"))
    rest = bundled.select("query_id", "code", "matched_on", "score", F.lit(1).alias("source")).join(mine.select("query_id", "code"), ["query_id", "code"], "left_anti")
    every = mine.union(rest)
    g = every.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("source") == 0, F.col("score"))).alias("stored"), F.max("score").alias("best"), F.count_if(F.col("score") >= 0.9).alias("strong"),
        F.max_by("code", F.struct("score", -F.col("source"), "code")).alias("best_code"), F.max_by("matched_on", F.struct("score", -F.col("source"), "code")).alias("best_on"),
    )
    exact = (F.col("stored") >= 0.85) | ((F.col("best") >= 0.98) & (F.col("strong") == 1)) | ((F.col("strong") == 1) & F.col("best_on").isin("alternate_name", "code", "name"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "none").when(F.coalesce(exact, F.lit(False)), "exact").otherwise("ambiguous")
    return queries.select("query_id").join(g, "query_id", "left").select("query_id", state.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "best_code", F.col("best").alias("best_score"))


def by_code(codes: DataFrame, languages: DataFrame) -> DataFrame:
    return codes.join(languages, F.lower(F.btrim(codes["query"])) == languages["code"])


def country_names(languages: DataFrame, countries: DataFrame) -> DataFrame:
    """code, region: the names of a language's countries in order, joined by " / "; unknown codes stay."""
    spread = languages.select("code", F.posexplode("countries").alias("i", "alpha_2"))
    named = spread.join(countries, F.upper(spread["alpha_2"]) == countries["alpha_2"], "left").select("code", "i", F.coalesce(countries["name"], spread["alpha_2"]).alias("name"))
    return named.groupBy("code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), " / ").alias("region"))


def scripts(queries: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, code, name of the script a text means: its code, else its whole name, else the first that holds it (known: code, name, seq)."""
    q = queries.select("query_id", F.btrim("query").alias("q"), fold(F.col("query")).alias("fq")).where("q <> ''")
    k = known.withColumn("fn", fold(F.col("name")))
    way = F.when((F.length("q") == 4) & (F.initcap("q") == F.col("code")), 0).when(F.col("fq") == F.col("fn"), 1).when((F.col("fq") != "") & F.contains("fn", F.col("fq")), 2)
    met = q.join(k, (F.initcap("q") == F.col("code")) | F.contains("fn", F.col("fq"))).withColumn("way", way).where("way IS NOT NULL")
    return met.groupBy("query_id").agg(F.min_by(F.struct("code", "name"), F.struct("way", "seq")).alias("s")).select("query_id", "s.code", "s.name")


def transmission(status: Column) -> Column:
    """A suggestion from an endangerment status."""
    return F.when(status == "not endangered", "strong").when(status.isin("threatened", "shifting"), "declining").when(status == "moribund", "limited").when(status.isin("nearly extinct", "extinct"), "not_transmitted")


def enrich(languages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Values for profiles from what is known of a language: language_id, grp, field, value_json, source_type, confidence, note.

    languages: language_id, family, classification, parent (code), parent_name, script, script_name, dialects, region, macroarea, documentation, endangerment.
    """
    c = F.col
    value = lambda grp, field, json, sure, note=None, known=None: F.when(known if known is not None else json.isNotNull(), F.struct(F.lit(grp).alias("grp"), F.lit(field).alias("field"), json.alias("value_json"), F.lit(sure).alias("confidence"), (note if note is not None else F.lit(None)).cast("string").alias("note")))
    text = lambda x: F.when(x != "", F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))
    level = transmission(c("endangerment"))
    values = F.array_compact(F.array(
        value("identity", "family", text(c("family")), 0.85, F.nullif(c("classification"), F.lit(""))),
        value("identity", "parent", F.to_json(F.struct(F.coalesce("parent_name", "parent").alias("value"), F.lit("macrolanguage").alias("type"), c("parent").alias("code"))), 0.9, known=c("parent") != ""),
        value("identity", "scripts", F.to_json(F.array(F.struct(c("script").alias("code"), F.coalesce("script_name", "script").alias("name"), c("script").alias("as_entered")))), 0.7, F.lit("likely script; not a claim that the language is written in it"), known=c("script") != ""),
        value("orthography_location", "varieties", F.to_json("dialects"), 0.75, known=F.size("dialects") > 0),
        value("orthography_location", "region", text(c("region")), 0.8, F.when(c("macroarea") != "", F.concat(F.lit("macroarea: "), "macroarea"))),
        value("resources", "studies", F.to_json(F.struct(F.lit("reported").alias("state"), F.concat(F.lit("most extensive description: "), "documentation").alias("detail"))), 0.6, known=c("documentation") != ""),
        value("community_status", "transmission", F.to_json(F.struct(level.alias("value"), F.concat(F.lit("Glottolog AES: "), "endangerment").alias("detail"))), 0.5, known=level.isNotNull()),
    ))
    return languages.select("language_id", F.explode(values).alias("v")).select("language_id", "v.grp", "v.field", "v.value_json", F.lit("local_database").alias("source_type"), "v.confidence", "v.note")


def display_records(found: DataFrame, names: DataFrame, regions: DataFrame, most: int = 8) -> DataFrame:
    """query_id, code, name, others (alternate names, so many at most), region of what find() gave, as it is shown.

    A language found by an alternate name is led by that name, and its own comes first among the others. names: code, kind, text, seq; regions:
    code, region.
    """
    alternates = names.where("kind = 'alternate_name'").groupBy("code").agg(F.transform(F.sort_array(F.collect_set(F.struct("seq", "text"))), lambda x: x["text"]).alias("alternates"))
    met = found.join(alternates, "code", "left").join(regions, "code", "left")
    listed = F.coalesce("alternates", F.array().cast("array<string>"))
    by_alternate = F.col("matched_on") == "alternate_name"
    rest = F.filter(listed, lambda a: F.lower(a) != F.lower("matched_text"))
    others = F.when(by_alternate, F.concat(F.array("name"), rest)).otherwise(listed)
    return met.select("query_id", "code", F.when(by_alternate, F.col("matched_text")).otherwise(F.col("name")).alias("name"), F.slice(others, 1, most).alias("others"), F.coalesce("region", F.lit("")).alias("region"))
