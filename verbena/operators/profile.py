"""Language profiles as rows: one for each value that some source gives for a field, and what follows from them.

A value row has language_id, grp, field, value_json, source_type, confidence, recorded_at, preferred, status, seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    grp: str
    name: str
    kind: str
    multi: bool = False
    feeds: tuple[str, ...] = ()


#: Group, field, kind, whether several values add up, the signals that it feeds.
SCHEMA = (
    ("identity", "family", "text", False, ("query", "relevance")),
    ("identity", "alternate_names", "list", True, ("query", "relevance", "offline")),
    ("identity", "exonyms", "list", True, ("query", "relevance", "offline")),
    ("identity", "parent", "parent", False, ("query", "relevance")),
    ("identity", "scripts", "scripts", True, ("query", "relevance", "classify")),
    ("identity", "notes", "text", False, ()),
    ("orthography_location", "orthography_status", "choice", False, ("classify",)),
    ("orthography_location", "literacy", "text", False, ()),
    ("orthography_location", "varieties", "list", True, ("query", "relevance", "offline")),
    ("orthography_location", "region", "text", False, ("query", "relevance")),
    ("orthography_location", "places", "places", True, ("query", "relevance", "offline")),
    ("orthography_location", "other_languages", "tagged_list", True, ("relevance",)),
    ("resources", "summary", "text", False, ("query",)),
    ("resources", "written", "state", False, ("query",)),
    ("resources", "recordings", "state", False, ("query",)),
    ("resources", "studies", "state", False, ("query",)),
    ("resources", "digital", "state", False, ("query",)),
    ("resources", "speakers", "speakers", False, ()),
    ("community_status", "speakers_basis", "basis", False, ()),
    ("community_status", "transmission", "choice", False, ()),
    ("community_status", "age_spread", "age_spread", False, ()),
    ("community_status", "used", "list", True, ("query",)),
    ("community_status", "displaced", "choice", False, ("query",)),
    ("community_status", "community", "community", True, ("query", "relevance", "offline")),
    ("translation_publication", "translation", "entries", True, ("query", "relevance", "offline")),
    ("translation_publication", "publication", "entries", True, ("query", "relevance", "offline")),
)


def fields() -> list[Field]:
    return [Field(*row) for row in SCHEMA]


def fields_feeding(signal: str) -> list[tuple[str, str]]:
    return [(f.grp, f.name) for f in fields() if signal in f.feeds]


def field_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.grp, f.name, f.kind, f.multi, list(f.feeds), i) for i, f in enumerate(fields())], "grp string, field string, kind string, multi boolean, feeds array<string>, ord int")


def value_key(value_json: Column) -> Column:
    """Equal for values that differ in letter case or outer blanks only."""
    return F.lower(F.btrim(F.regexp_replace(value_json, r'"\s+|\s+"', '"')))


_SLOT = ["language_id", "grp", "field"]


def merge_values(values: DataFrame) -> DataFrame:
    """Values of one kind of source that say the same become one: the greatest confidence, accepted if any is."""
    return values.withColumn("key", value_key(F.col("value_json"))).groupBy(*_SLOT, "source_type", "key").agg(
        F.min_by("value_json", "seq").alias("value_json"), F.max("confidence").alias("confidence"), F.min_by("recorded_at", "seq").alias("recorded_at"), F.bool_or("preferred").alias("preferred"),
        F.when(F.bool_or(F.col("status") == "accepted"), "accepted").otherwise(F.min_by("status", "seq")).alias("status"), F.min("seq").alias("seq"),
    )


def preferred_values(values: DataFrame) -> DataFrame:
    """The accepted value that counts for each field: the preferred one, else the surest, the latest, the first."""
    order = Window.partitionBy(*_SLOT).orderBy(F.desc("preferred"), F.when(F.col("preferred"), F.col("seq")), F.desc("confidence"), F.desc("recorded_at"), "seq")
    return values.where("status = 'accepted'").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def merged_lists(values: DataFrame) -> DataFrame:
    """language_id, grp, field, items (JSON, in order): all accepted values of fields that add up, each once.

    Preferred ones come first, then the user's, then by confidence.
    """
    accepted = values.where("status = 'accepted'")
    items = F.when(F.col("value_json").startswith("["), F.from_json("value_json", "array<string>")).otherwise(F.array("value_json"))
    spread = accepted.select(*_SLOT, F.struct((~F.col("preferred")).alias("a"), (F.col("source_type") != "user").alias("b"), (-F.col("confidence")).alias("c"), "seq").alias("o"), F.posexplode(items).alias("i", "item"))
    spread = spread.withColumn("key", value_key(F.col("item")))
    first = spread.groupBy(*_SLOT, "key").agg(F.min(F.struct("o", "i", "item")).alias("m"))
    return first.groupBy(*_SLOT).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["item"]).alias("items"))


def field_states(values: DataFrame, languages: DataFrame, doubt: float = 0.6) -> DataFrame:
    """language_id, grp, field, state for every field: missing, contradictory, uncertain or known."""
    spec = F.broadcast(field_table(values.sparkSession))  # as many rows as the schema has fields
    accepted = values.where("status = 'accepted'").groupBy(*_SLOT).agg(F.count_distinct(value_key(F.col("value_json"))).alias("n"), F.bool_or("preferred").alias("settled"))
    best = preferred_values(values).select(*_SLOT, "confidence")
    every = languages.select("language_id").distinct().crossJoin(spec)
    met = every.join(accepted, _SLOT, "left").join(best, _SLOT, "left")
    contrary = (F.col("n") > 1) & ~F.col("settled") & ~F.col("multi")
    state = F.when(F.col("n").isNull(), "missing").when(contrary, "contradictory").when(F.col("confidence") < doubt, "uncertain").otherwise("known")
    return met.select(*_SLOT, "ord", state.alias("state"))


def questions(states: DataFrame) -> DataFrame:
    """language_id, ord, grp, field, state of the fields to ask for, in the order of the schema: missing, uncertain or contradictory ones."""
    return states.where("state <> 'known'").select("language_id", "ord", "grp", "field", "state")


def group_states(states: DataFrame) -> DataFrame:
    """language_id, grp, known (fields with a value), total, state: done if there is nothing to ask for (see questions), empty if all is, else partial."""
    asked = F.count_if(F.col("state") != "known")
    g = states.groupBy("language_id", "grp").agg(F.count_if(F.col("state") != "missing").alias("known"), F.count("*").alias("total"), asked.alias("asked"))
    return g.withColumn("state", F.when(F.col("asked") == 0, "done").when(F.col("asked") == F.col("total"), "empty").otherwise("partial")).drop("asked")


def set_user_values(values: DataFrame, entered: DataFrame) -> DataFrame:
    """values with what users entered (language_id, grp, field, value_json, recorded_at, seq): preferred, others no longer."""
    new = entered.select(*_SLOT, "value_json", F.lit("user").alias("source_type"), F.lit(1.0).alias("confidence"), "recorded_at", F.lit(True).alias("preferred"), F.lit("accepted").alias("status"), "seq")
    touched = entered.select(*_SLOT).distinct().withColumn("touched", F.lit(True))
    old = values.join(touched, _SLOT, "left").withColumn("preferred", F.col("preferred") & F.col("touched").isNull()).select(*new.columns)
    return merge_values(old.unionByName(new)).select(*new.columns)


def unknown_proposals(proposals: DataFrame, values: DataFrame) -> DataFrame:
    """Proposals (language_id, grp, field, value_json, confidence) that say something new."""
    known = values.where("status = 'accepted'").select(*_SLOT, value_key(F.col("value_json")).alias("key")).distinct()
    keyed = proposals.withColumn("key", value_key(F.col("value_json")))
    return keyed.join(known, [*_SLOT, "key"], "left_anti").dropDuplicates([*_SLOT, "key"]).drop("key")


def _quoted(text: Column) -> Column:
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def to_json(values: DataFrame) -> DataFrame:
    """language_id, profile: the value that counts of each field, lists merged, as one JSON text, and every row behind it under provenance."""
    several = [f.name for f in fields() if f.multi]
    item = lambda x: F.when(x.startswith("{"), x).otherwise(_quoted(x))
    lists = merged_lists(values.where(F.col("field").isin(several))).select(*_SLOT, F.concat(F.lit("["), F.array_join(F.transform("items", item), ","), F.lit("]")).alias("json"))
    single = preferred_values(values.where(~F.col("field").isin(several))).select(*_SLOT, F.col("value_json").alias("json"))
    rows = values.groupBy(*_SLOT).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.to_json(F.struct("source_type", "confidence", "recorded_at", "preferred", "status", "value_json")).alias("json")))), lambda x: x["json"]).alias("p"))
    rows = rows.select(*_SLOT, F.concat(F.lit("["), F.array_join("p", ","), F.lit("]")).alias("json"))

    def nested(parts: DataFrame, name: str) -> DataFrame:
        pair = lambda k, v: F.struct(F.col(k).alias("k"), F.concat(_quoted(F.col(k)), F.lit(":"), v).alias("t"))
        whole = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), ","), F.lit("}"))
        by_group = parts.groupBy("language_id", "grp").agg(whole(pair("field", F.col("json"))).alias("json"))
        return by_group.groupBy("language_id").agg(whole(pair("grp", F.col("json"))).alias(name))

    both = nested(lists.union(single), "profile").join(nested(rows, "provenance"), "language_id", "right")
    body = F.coalesce("profile", F.lit("{}"))
    gap = F.when(body == "{}", "").otherwise(",")
    return both.select("language_id", F.concat(F.substring(body, F.lit(1), F.length(body) - 1), gap, F.lit('"provenance":'), "provenance", F.lit("}")).alias("profile"))


#: Weights of terms by what they name, as file scans use them.
SCAN_WEIGHTS = {"name": 0.9, "iso_code": 0.85, "alternate_name": 0.8, "exonym": 0.75, "variety": 0.75, "community": 0.6, "place": 0.45, "title": 0.7, "author": 0.5, "organisation": 0.4}
#: The field behind each signal of relevance.
SIGNAL_FIELDS = {
    "alternate_name": "identity.alternate_names", "exonym": "identity.exonyms", "variety": "orthography_location.varieties", "geographic": "orthography_location.places",
    "region": "orthography_location.region", "community": "community_status.community", "family": "identity.family", "parent": "identity.parent", "script": "identity.scripts",
    "known_publication": "translation_publication.publication", "known_translation": "translation_publication.translation",
}


def terms(values: DataFrame) -> DataFrame:
    """language_id, signal, seq, term: the words by which a language's resources are known."""
    slots = F.create_map(*(F.lit(x) for s, f in SIGNAL_FIELDS.items() for x in (f, s)))
    lists = merged_lists(values).withColumn("signal", slots[F.concat("grp", F.lit("."), "field")]).where("signal IS NOT NULL")
    item = lists.select("language_id", "signal", F.posexplode("items").alias("seq", "item"))
    named = F.coalesce(F.get_json_object("item", "$.name"), F.get_json_object("item", "$.title"), F.get_json_object("item", "$.value"))
    plain = F.btrim("item", F.lit('"'))
    term = F.when(F.col("item").startswith("{"), named).otherwise(plain)
    split_ = F.when(F.col("signal") == "region", F.split(term, r"\s*[,/]\s*")).otherwise(F.array(term))
    return item.select("language_id", "signal", "seq", F.explode(split_).alias("term")).where("term <> ''")


def scan_terms(values: DataFrame, languages: DataFrame) -> DataFrame:
    """language_id, seq, term, kind, weight for scans of file names."""
    weight = F.create_map(*(F.lit(x) for k, v in SCAN_WEIGHTS.items() for x in (k, v)))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(SCAN_WEIGHTS) for x in (k, i)))
    kinds = F.create_map(*(F.lit(x) for a, b in {"alternate_name": "alternate_name", "exonym": "exonym", "variety": "variety", "community": "community", "geographic": "place", "known_publication": "title", "known_translation": "title"}.items() for x in (a, b)))
    own = languages.select("language_id", F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("term")), F.struct(F.lit("iso_code").alias("kind"), F.col("iso").alias("term")))).alias("t")).select("language_id", "t.kind", "t.term", F.lit(0).alias("seq"))
    rest = terms(values).select("language_id", kinds[F.col("signal")].alias("kind"), "term", "seq")
    every = own.unionByName(rest).where("kind IS NOT NULL AND term IS NOT NULL")
    return every.select("language_id", (order[F.col("kind")] * 1000 + F.col("seq")).alias("seq"), "term", "kind", weight[F.col("kind")].alias("weight"))
