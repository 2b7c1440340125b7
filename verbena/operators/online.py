"""Online catalogues from request to candidates: requests for each catalogue, query and page of results, records, scores, actions, files.

A request is a row, and so is each result, file and answer: Spark fetches requests and files side by side, a site's own one after another (see
sources/http.py, which minds robots.txt). Entries of the registry say where a catalogue is and where its answers hold what.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.functions import web
from verbena.operators import catalogues, discover, relevance
from verbena.session import written
from verbena.sources import http

#: Fields of a result that an entry may place (`fields`); files is a list of objects with url, size and name, or what file_url, file_size, file_name call these.
FIELDS = ("title", "description", "language", "url", "licence")
#: Results of one entry are numbered from a multiple of this on, in the order of entries.
APART = 1_000_000_000


def requests(entries: list[dict], queries: DataFrame, name: str, code: str | None) -> DataFrame:
    """provider, place, query, page, url: a request for each entry, query and page; entries that need a code go without one unasked."""
    out = None
    for place, e in enumerate(entries):
        if e.get("needs_code") and not code:
            continue
        q = queries.select("query", F.explode(F.sequence(F.lit(1), F.lit(int(e.get("pages", 1))))).alias("page"))
        url = F.replace(discover.render_url(e["url"], F.col("query"), F.lit(name), F.lit(code)), F.lit("{page}"), F.col("page").cast("string"))
        url = F.replace(url, F.lit("{start}"), ((F.col("page") - 1) * int(e.get("page_size", 25))).cast("string"))
        rows = q.select(F.lit(e["name"]).alias("provider"), F.lit(place).alias("place"), F.lit(e.get("mode", "lookup")).alias("mode"), "query", "page", url.alias("request"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no catalogue can be asked")
    # one request for several queries is asked once
    return out.groupBy("provider", "place", "mode", "request").agg(F.min("query").alias("query"), F.min("page").alias("page"))


def results(entries: list[dict], asked: DataFrame, fetched: Callable[[DataFrame], DataFrame] = http.fetch) -> tuple[DataFrame, DataFrame]:
    """Results (seq, provider, kind, query, title, description, language, types, metadata, url, licence, files) and failures (provider, request, error)."""
    open_ = asked.where("mode <> 'lookup'")
    answers = written(open_.join(fetched(open_.select(F.col("request").alias("url"))).withColumnRenamed("url", "request"), "request"), "answers")
    failed = answers.where("error IS NOT NULL OR coalesce(status, 200) >= 400").select("provider", "request", F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string"))).alias("error"))
    good = answers.where("error IS NULL AND coalesce(status, 200) < 400").select("place", "provider", "query", "page", "request", F.decode("body", "UTF-8").alias("body"))
    empty_files = F.array().cast("array<struct<url:string,size:bigint,name:string>>")
    number = lambda place, page, n: (place.cast("long") * APART + page * 100_000 + n).alias("seq")
    shape = lambda d, files: d.select("seq", "provider", "kind", "query", "title", "description", "language", "types", "metadata", "url", "licence", files.alias("files"))
    none = {"description": "string", "language": "string", "types": "array<string>", "metadata": "map<string,string>", "licence": "string"}
    looked = asked.where("mode = 'lookup'").select(number(F.col("place"), F.col("page"), F.lit(0)), "provider", F.lit("lookup").alias("kind"), "query", F.concat("provider", F.lit(": "), "query").alias("title"), F.col("request").alias("url"), *(F.lit(None).cast(v).alias(k) for k, v in none.items()))
    out = shape(looked, empty_files)
    for e in entries:
        mine = good.where(F.col("provider") == e["name"]).withColumn("query_id", F.struct("place", "provider", "query", "page"))
        if e.get("mode") == "api_json":
            given = e.get("fields", {})
            places = {k: given.get(k, k) for k in FIELDS} | {"types_json": given.get("types", "types").removesuffix("[]") + "[]", "files_json": given.get("files", "files").removesuffix("[]") + "[]"}
            found = discover.json_results(mine.select("query_id", "body"), e.get("items", "results[]"), places)
            one = lambda x, key: F.get_json_object(x, f"$.{key}")
            files = F.transform(F.from_json("files_json", "array<string>"), lambda x: F.struct(one(x, given.get("file_url", "url")).alias("url"), one(x, given.get("file_size", "size")).try_cast("long").alias("size"), one(x, given.get("file_name", "name")).alias("name")))  # noqa: B023
            files = F.filter(files, lambda f: f["url"].isNotNull())
            types = F.coalesce(F.from_json("types_json", "array<string>"), F.when(F.col("types_json").isNotNull(), F.array("types_json")))
            rows = found.select(number(F.col("query_id.place"), F.col("query_id.page"), F.col("n")), "query_id.provider", F.lit("record").alias("kind"), "query_id.query", "title", "description", "language", types.alias("types"), F.lit(None).cast("map<string,string>").alias("metadata"), "url", "licence", files.alias("f"))
            out = out.unionByName(shape(rows, F.coalesce("f", empty_files)))
        elif e.get("mode") == "html_links":
            found = discover.page_results(mine.select("query_id", F.col("request").alias("url"), "body"), e.get("link_pattern", "^https?://"))
            rows = found.select(number(F.col("query_id.place"), F.col("query_id.page"), F.col("n")), "query_id.provider", F.lit("record").alias("kind"), "query_id.query", "title", "url", *(F.lit(None).cast(v).alias(k) for k, v in none.items()))
            file = F.regexp_like("url", F.lit(e["download_pattern"])) if e.get("download_pattern") else web.looks_like_file(F.col("url"))
            out = out.unionByName(shape(rows, F.when(file, F.array(F.struct("url", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("name")))).otherwise(empty_files)))
    return out, failed


def decided(found: DataFrame, languages: DataFrame, terms: DataFrame, review_at: int = 30, download_at: int | None = 50) -> DataFrame:
    """Results with score, n_files, action and rank (see discover.catalogue_actions), before anything of them is loaded."""
    told = catalogues.relevance_text(found)
    one = F.broadcast(languages.select("language_id").limit(1))
    c = told.crossJoin(one).select(F.col("seq").alias("candidate_id"), "language_id", "text", F.col("language").alias("metadata_language"), "types")
    scored = relevance.score(c, languages, terms).select(F.col("candidate_id").alias("seq"), "score")
    return discover.catalogue_actions(found.join(scored, "seq").withColumn("n_files", F.size("files")), review_at, download_at)


def loads(rows: DataFrame, most_bytes: int = 500_000_000, most_files: int = 25) -> DataFrame:
    """seq, n, url, size, name: the files to load of results whose action is download."""
    files = rows.where("action = 'download'").select(F.col("seq").alias("record_id"), F.posexplode("files").alias("n", "f")).select("record_id", "n", "f.url", "f.size", "f.name")
    return discover.wanted_files(files, most_bytes, most_files).withColumnRenamed("record_id", "seq")


def candidates(rows: DataFrame, fetched: Callable[[DataFrame], DataFrame] = http.fetch, most_bytes: int = 500_000_000, most_files: int = 25) -> DataFrame:
    """path, content (null: not loaded), url, title, types, metadata, method: loaded files, and a JSON record for each result that is kept as metadata."""
    told = F.map_filter(F.create_map(*(F.lit(x) if i % 2 == 0 else x for i, x in enumerate(("language", F.col("language"), "description", F.col("description"), "licence", F.col("licence"), "query", F.col("query"))))), lambda k, v: v.isNotNull())
    about = rows.select("seq", "title", "types", told.alias("metadata"))
    files = written(loads(rows, most_bytes, most_files), "loads")
    bodies = fetched(files.select("url"))
    name = F.coalesce("name", web.response_filename(F.col("url"), F.col("disposition")))
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    got = files.join(bodies, "url", "left").select("seq", F.concat(short(F.concat_ws("#", "seq", "url")), F.lit("/"), name).alias("path"), F.when(F.col("error").isNull() & (F.coalesce("status", F.lit(200)) < 400), F.col("body")).alias("content"), "url")
    record = F.to_json(F.struct(F.lit(True).alias("synthetic"), "provider", "title", "description", "language", "url", "licence"))
    slug = F.concat(short(F.col("seq").cast("string")), F.lit("/"), F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit("record"))), "[^a-z0-9]+", "-"), 1, 80), F.lit(".metadata.json"))
    kept = rows.where("action = 'metadata'").select("seq", slug.alias("path"), F.encode(record, "UTF-8").alias("content"), "url")
    return got.unionByName(kept).join(about, "seq").withColumn("method", F.lit("catalogue"))


__all__ = ["candidates", "decided", "loads", "requests", "results"]
