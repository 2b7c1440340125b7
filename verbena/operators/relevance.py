"""Scoring candidates against the terms of a language profile, all candidates at once.

Terms are rows (language_id, signal, ord, seq, term, folded, weak); a candidate meets those of its language. A folded term counts once,
for the first signal that lists it; each signal adds its weight times its strongest hit, and a quarter more for several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.functions import match
from verbena.functions.text import fold, let
from verbena.operators.termscan import term_hits
from verbena.session import written

#: Signals in their order, with their weights.
WEIGHTS = {
    "exact_name": 70, "alternate_name": 55, "exonym": 50, "variety": 50, "geographic": 15, "region": 5, "community": 25,
    "family": 8, "parent": 15, "script": 8, "known_publication": 45, "known_translation": 40,
}
ISO, LANGUAGE_FIELD, CONTENTS, LINGUISTIC, ASSERTED = 70, 50, 30, 10, 100
#: Least score, key and label of each band.
BANDS = ((90, "very_high", "Very high confidence"), (70, "high", "High confidence"), (50, "possible", "Possible match"), (30, "weak", "Weak match"), (0, "unrelated", "Unrelated"))
CONTENTS_READ = 200_000
#: Types of resources that say nothing of language, the others, and parts of words that do.
OTHER_TYPES = ("image", "audio", "video", "software", "archive", "metadata", "research", "unknown")
LANGUAGE_TYPES = (
    "dictionary", "lexicon", "wordlist", "corpus", "grammar", "phonology", "morphology", "syntax", "orthography", "translation",
    "parallel_text", "transcription", "interlinear_text", "field_notes",
)
LANGUAGE_PARTS = "dictionar|grammar|lexic|wordlist|corpus|phonolog|orthograph|transcript|interlinear|translation|field note|language|linguist"


def band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for floor, key, _ in BANDS[1:]:
        out = out.when(score >= floor, key)
    return out.otherwise("unrelated")


def status(score: Column, review_at: int = 30, confirmed_at: int = 70) -> Column:
    return F.when(score < review_at, "rejected").when(score < confirmed_at, "uncertain").otherwise("confirmed")


def strength(folded: Column) -> Column:
    n = F.length(F.replace(folded, F.lit(" "), F.lit("")))
    return F.when(n <= 4, 0.6).when(n == 5, 0.8).otherwise(1.0)


def linguistic_type(kind: Column) -> Column:
    f = F.replace(fold(kind), F.lit(" "), F.lit("_"))
    return F.when(f.isin(*LANGUAGE_TYPES), True).when(f.isin(*OTHER_TYPES), False).otherwise(fold(kind).rlike(LANGUAGE_PARTS))


_HIT = "array<struct<ord:int,folded:string,term:string,weak:boolean,force:double,hit:boolean,read:boolean>>"


def _hits(texts: Column, terms: Column, word_names: list[str], authors: bool) -> Column:
    """Of the terms of a row, those that its texts (text, blob, inside) hit or whose contents tell of them. Costly tests run on hits alone."""

    def one(t: Column) -> Column:
        is_name = t["signal"] == "exact_name"
        context = match.language_context(texts["text"], t["term"])
        plain = match.has_term(texts["blob"], t["folded"])
        named = plain | F.when(F.length(t["folded"]) < 3, context).otherwise(False)
        by_author = F.when(t["signal"].isin("alternate_name", "exonym", "variety", "parent"), match.only_author(texts["text"], t["term"])).otherwise(False) if authors else F.lit(False)
        by_words = F.when(match.common_words_only(t["folded"]), ~match.proper_noun(texts["text"], t["term"])).otherwise(False)
        hit = F.coalesce(F.when(is_name, named).when(plain, ~by_author & ~by_words), F.lit(False))
        read = F.coalesce(F.when(t["signal"].isin("exact_name", "alternate_name", "variety"), match.has_term(texts["inside"], t["folded"])), F.lit(False))

        def told(h: Column) -> Column:
            unclear = F.when(h & match.ambiguous_name(t["folded"], word_names), ~context).otherwise(False)
            base = F.when(is_name, 1.0).otherwise(strength(t["folded"]) * F.when(t["weak"], 0.5).otherwise(1.0))
            return F.struct(t["ord"].alias("ord"), t["folded"].alias("folded"), t["term"].alias("term"), t["weak"].alias("weak"), (base * F.when(unclear, 0.3).otherwise(1.0)).alias("force"), h.alias("hit"), read.alias("read"))

        return let(hit, told)

    return F.filter(F.transform(terms, one), lambda h: h["hit"] | h["read"]).cast(_HIT)


def _summed(hits: Column) -> Column:
    """gain, read, signals (the reason each gives) and terms of a row's hits. A folded term counts for the first signal that it hits; within
    one signal equal folded terms all count."""
    names, weights = F.array(*map(F.lit, WEIGHTS)), F.array(*(F.lit(float(w)) for w in WEIGHTS.values()))
    counts = lambda h: h["hit"] & ~F.exists(hits, lambda g: g["hit"] & (g["folded"] == h["folded"]) & (g["ord"] < h["ord"]))

    def of(counted: Column) -> Column:
        def signal(i: Column) -> Column:
            return let(F.filter(counted, lambda h: h["ord"] == i), lambda own: F.struct(i.alias("ord"), F.size(own).alias("n"), F.array_max(F.transform(own, lambda h: h["force"])).alias("force"), F.forall(own, lambda h: h["weak"]).alias("all_weak")))

        def total(signals: Column) -> Column:
            gain = F.aggregate(signals, F.lit(0.0), lambda a, x: a + F.get(weights, x["ord"]) * (x["force"] + F.when(x["n"] > 1, 0.25).otherwise(0.0)))
            said = F.transform(signals, lambda x: F.concat(F.replace(F.get(names, x["ord"]), F.lit("_"), F.lit(" ")), F.when(x["all_weak"], " (shared name, weak)").otherwise("")))
            terms = F.concat(F.transform(counted, lambda h: h["term"]), F.transform(F.filter(hits, lambda h: h["read"]), lambda h: h["term"]))
            return F.struct(gain.alias("gain"), F.exists(hits, lambda h: h["read"]).alias("read"), said.alias("signals"), F.array_distinct(terms).alias("terms"))

        return let(F.filter(F.transform(F.array(*map(F.lit, range(len(WEIGHTS)))), signal), lambda x: x["n"] > 0), total)

    return let(F.filter(hits, counts), of)


def score(candidates: DataFrame, languages: DataFrame, terms: DataFrame, word_names: list[str] | None = None, contents_read: int | None = CONTENTS_READ, authors: bool = True) -> DataFrame:
    """candidates' candidate_id, language_id, then score, band, reasons (signals in order), matched_terms; extra columns of candidates stay in front.

    candidates: candidate_id, language_id, text and, where known, metadata_language, types, user_asserted, discovery_confidence,
    contents. languages: language_id, iso, name. word_names: folded names that are ordinary words as well (match.WORD_NAMES).
    contents_read: how many characters of the contents are looked at; None: all. authors: whether a name that stands in the text only as an
    author's is no hit (match.only_author).

    A language's name and terms are one row, with the terms as an array, and each candidate is matched in its own row: texts never
    meet terms in a join. The table of languages is written first, so that Spark knows its size and sends it to the candidates if small.
    """
    word_names = list(match.WORD_NAMES) if word_names is None else word_names
    optional = {"metadata_language": "string", "types": "array<string>", "user_asserted": "boolean", "discovery_confidence": "double", "contents": "string"}
    own = [c for c in candidates.columns if c not in ("text", *optional)]
    c = candidates.select(*own, "text", *(F.col(k).cast(v) if k in candidates.columns else F.lit(None).cast(v).alias(k) for k, v in optional.items()))
    lang = languages.select("language_id", F.lower("iso").alias("iso"), F.col("name").alias("language"))
    order = F.create_map(*(F.lit(x) for i, s in enumerate(WEIGHTS) for x in (s, i)))
    names = lang.select("language_id", F.lit("exact_name").alias("signal"), F.lit(0).alias("seq"), F.col("language").alias("term"), F.lit(False).alias("weak"))
    every = names.unionByName(terms.select("language_id", "signal", "seq", "term", "weak")).where(F.col("term").isNotNull())
    every = every.select("language_id", F.struct(order[F.col("signal")].alias("ord"), "seq", "signal", "term", F.coalesce("weak", F.lit(False)).alias("weak"), fold(F.col("term")).alias("folded")).alias("t"))
    every = every.groupBy("language_id").agg(F.sort_array(F.collect_list("t")).alias("terms"))
    known = written(lang.join(every, "language_id", "left"), "terms")

    none = F.array().cast(known.schema["terms"].dataType)
    texts = F.struct("text", fold(F.col("text")).alias("blob"), fold(F.col("contents") if contents_read is None else F.substring("contents", 1, contents_read)).alias("inside"))
    met = c.join(known, "language_id", "left")
    iso_hit = lambda blob: F.coalesce(F.array_contains(F.split(blob, " "), F.col("iso")) | F.contains(blob, F.concat(F.lit("iso "), "iso")), F.lit(False))
    found = let(texts, lambda v: F.struct(let(_hits(v, F.coalesce("terms", none), word_names, authors), _summed).alias("sums"), iso_hit(v["blob"]).alias("iso")))
    met = met.withColumn("found", found).drop("text", "contents")

    ml = fold(F.col("metadata_language"))
    alternates = F.transform(F.filter(F.coalesce("terms", none), lambda t: t["signal"] == "alternate_name"), lambda t: t["folded"])
    field_hit = F.coalesce((F.col("metadata_language") != "") & ((ml == F.col("iso")) | (ml == fold(F.col("language"))) | F.array_contains(alternates, ml)), F.lit(False))
    typed = F.coalesce(F.exists("types", linguistic_type), F.lit(False))
    met = met.select(*own, "discovery_confidence", F.col("found.sums").alias("sums"), F.col("found.iso").alias("iso_hit"), field_hit.alias("field_hit"), typed.alias("typed"), F.coalesce("user_asserted", F.lit(False)).alias("asserted"))
    total = F.col("sums.gain")
    for flag, points in (("asserted", ASSERTED), ("iso_hit", ISO), ("field_hit", LANGUAGE_FIELD), ("sums.read", CONTENTS), ("typed", LINGUISTIC)):
        total = total + F.when(F.col(flag), float(points)).otherwise(0.0)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("discovery_confidence")))
    total = F.when(F.col("discovery_confidence").isNotNull() & (total > 0), total * F.least(F.lit(1.0), 0.5 + 0.75 * sure)).otherwise(total)
    out = met.withColumn("score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).cast("int"))
    note = lambda flag, text: F.when(F.col(flag), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(note("asserted", "user assigned"), note("iso_hit", "iso code"), "sums.signals", note("field_hit", "metadata language"), note("sums.read", "document contents"), note("typed", "catalogue classification"))
    matched = F.array_distinct(F.concat(note("iso_hit", "iso"), "sums.terms"))
    matched = F.transform(F.array_sort(F.transform(matched, lambda x: F.struct(F.lower(x).alias("k"), x.alias("t")))), lambda x: x["t"])
    return out.select(*own, "score", band(F.col("score")).alias("band"), reasons.alias("reasons"), matched.alias("matched_terms"))


#: So many terms stand in the plan as constants and are looked for one by one; more are looked for by an automaton (termscan).
FEW_TERMS = 200
_SCANNED = "array<struct<seq:bigint,term:string,kind:string,weight:double,folded:string>>"


def scan_terms(terms: DataFrame) -> DataFrame:
    """The terms (seq, term, kind, weight) with their folded forms: those of three letters or more, each form once, the first."""
    t = terms.select("seq", "term", "kind", F.col("weight").cast("double").alias("weight"), fold(F.col("term")).alias("folded")).where("length(folded) >= 3")
    first = t.groupBy("folded").agg(F.min_by(F.struct("seq", "term", "kind", "weight"), F.struct("seq", "term")).alias("t"))
    return first.select("t.*", "folded")


def _constants(rows: list) -> Column:
    rows = sorted(rows, key=lambda r: r.seq)
    return F.array(*(F.struct(F.lit(r.seq).cast("long").alias("seq"), F.lit(r.term).alias("term"), F.lit(r.kind).alias("kind"), F.lit(r.weight).alias("weight"), F.lit(r.folded).alias("folded")) for r in rows)).cast(_SCANNED)


def scanned(texts: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame, test) -> DataFrame:  # noqa: ANN001
    """key and h: of each text the terms in it, as structs of seq, term, weight, kind and a flag for each of fields (folded texts).

    test(whole, anywhere, length of the folded term, kind) says whether a term that stands in a field as a whole word, or anywhere, counts. Texts without
    a term have no row. Keys tell texts apart.
    """
    t = written(scan_terms(terms), "scan-terms")
    rows = t.limit(FEW_TERMS + 1).collect()
    if len(rows) <= FEW_TERMS:
        blobs = F.struct(*(v.alias(k) for k, v in fields.items()), *(F.concat(F.lit(" "), v, F.lit(" ")).alias(f"{k}_padded") for k, v in fields.items()))

        def of(v: Column) -> Column:
            def one(x: Column) -> Column:
                word = F.concat(F.lit(" "), x["folded"], F.lit(" "))
                hit = lambda k: F.coalesce(test(F.contains(v[f"{k}_padded"], word), F.contains(v[k], x["folded"]), F.length(x["folded"]), x["kind"]), F.lit(False))
                return F.struct(x["seq"].alias("seq"), x["term"].alias("term"), x["weight"].alias("weight"), x["kind"].alias("kind"), *(hit(k).alias(k) for k in fields))

            return F.filter(F.transform(_constants(rows), one), lambda h: F.array_contains(F.array(*(h[k] for k in fields)), True))

        return texts.select(key, let(blobs, of).alias("h")).where(F.size("h") > 0)
    met = term_hits(texts.select(key, *(v.alias(k) for k, v in fields.items())), key, list(fields), t).join(t, "folded")
    met = met.withColumn("counts", F.coalesce(test(F.col("whole"), F.lit(True), F.length("folded"), F.col("kind")), F.lit(False)))
    flags = met.groupBy(key, "folded").agg(F.first(F.struct("seq", "term", "weight", "kind")).alias("t"), *(F.bool_or(F.col("counts") & (F.col("field") == k)).alias(k) for k in fields))
    some = flags.where(" OR ".join(fields))
    return some.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t.seq", "t.term", "t.weight", "t.kind", *fields))).alias("h"))


def detection(paths: DataFrame, terms: DataFrame) -> DataFrame:
    """Files whose name or folder names a term: file_id, detection_method, detection_confidence, matched_terms.

    paths: file_id, name, folder. terms: seq, term, kind, weight. A hit in the folder counts 0.8 of its weight, both together 0.05 more.
    """
    counts = lambda whole, anywhere, n, kind: whole | ((kind != "iso_code") & (n >= 8) & anywhere)
    g = scanned(paths, "file_id", {"named": fold(F.col("name")), "placed": fold(F.col("folder"))}, terms, counts)
    most = F.array_max(F.transform("h", lambda h: F.when(h["named"], h["weight"]).otherwise(h["weight"] * 0.8)))
    named, placed = F.exists("h", lambda h: h["named"]), F.exists("h", lambda h: ~h["named"])
    ordered = F.array_sort(F.transform("h", lambda h: F.struct((~h["named"]).alias("later"), h["seq"].alias("seq"), h["term"].alias("term"))))
    g = g.select("file_id", most.alias("most"), named.alias("named"), placed.alias("placed"), F.transform(ordered, lambda x: x["term"]).alias("matched_terms"))
    sure = F.when(F.col("named") & F.col("placed"), F.least(F.lit(1.0), F.col("most") + 0.05)).otherwise(F.col("most"))
    how = F.when(F.col("named") & F.col("placed"), "filename+path").when(F.col("named"), "filename").otherwise("path")
    return g.select("file_id", how.alias("detection_method"), F.bround(sure, 2).alias("detection_confidence"), "matched_terms")
