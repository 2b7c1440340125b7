"""Finding candidates: queries for a language, results of catalogues and search engines, links of pages, and what to do with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.functions import web
from verbena.functions.text import fold, html_links, strip_tags

#: Query templates by what they build on, in order; {x} is the term, {name} the language.
TEMPLATES = {
    "name": ('"{name}" language', '"{name}" dictionary', '"{name}" grammar', '"{name}" language documentation', '"{name}" wordlist', '"{name}" texts stories'),
    "code": ('{x} language "{name}"', "ISO 639-3 {x}"),
    "recordings": ('"{name}" recordings', '"{name}" audio archive', '"{name}" documentation audio', '"{name}" ELAR', '"{name}" PARADISEC'),
    "written": ('"{name}" dictionary', '"{name}" primer', '"{name}" grammar', '"{name}" wordlist'),
    "studies": ('"{name}" grammar', '"{name}" phonology', '"{name}" thesis', '"{name}" linguistic description'),
    "digital": ('"{name}" corpus', '"{name}" dataset', '"{name}" keyboard font', '"{name}" software'),
    "alternate_name": ('"{x}" language', '"{x}" dictionary'),
    "exonym": ('"{x}" language',),
    "variety": ('"{x}" dictionary', '"{x}" language documentation', '"{x}" "{name}" corpus'),
    "place": ('"{name}" "{x}" language',),
    "community": ('"{x}" "{name}"',),
    "publication": ('"{x}"',),
    "translation": ('"{name}" Bible translation', '"{name}" New Testament'),
}
#: How many terms of a kind are asked for.
TERM_CAPS = {"alternate_name": 4, "exonym": 2, "variety": 6, "place": 3, "community": 3, "publication": 3, "translation": 1}
#: States of a field of resources that switch its queries on.
ON_STATES = ("yes", "limited", "reported", "historical")


def search_queries(terms: DataFrame, most: int = 24) -> DataFrame:
    """language_id, query, basis, rank: the first queries of each language, none twice in folded form.

    terms: language_id, name, kind (a key of TEMPLATES), term, seq. Inverted forms ("Zhuang, Yongnan") and alternates of under 5
    letters are not asked for.
    """
    order = F.create_map(*(F.lit(x) for i, k in enumerate(TEMPLATES) for x in (k, i)))
    cap = F.create_map(*(F.lit(x) for k, v in TERM_CAPS.items() for x in (k, v)))
    forms = F.create_map(*(x for k, v in TEMPLATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    usable = F.when(F.col("kind") == "alternate_name", ~F.contains("term", F.lit(", "))).otherwise(True)
    t = terms.where(usable).withColumn("k", F.row_number().over(Window.partitionBy("language_id", "kind").orderBy("seq")))
    t = t.where(F.col("k") <= F.coalesce(cap[F.col("kind")], F.lit(1000))).where((F.col("kind") != "alternate_name") | (F.length(fold(F.col("term"))) >= 5))
    q = t.select("language_id", "name", "term", "kind", "k", F.posexplode(forms[F.col("kind")]).alias("i", "form"))
    q = q.withColumn("query", F.replace(F.replace("form", F.lit("{name}"), F.col("name")), F.lit("{x}"), F.coalesce("term", F.lit(""))))
    place = F.struct(order[F.col("kind")], "k", "i")
    first = q.groupBy("language_id", fold(F.col("query")).alias("key")).agg(F.min(F.struct(place.alias("place"), "query", "kind")).alias("f")).where("key <> ''")
    rank = F.row_number().over(Window.partitionBy("language_id").orderBy("f.place"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("language_id", "f.query", F.col("f.kind").alias("basis"), "rank")


def render_url(template: str, query: Column, name: Column, code: Column) -> Column:
    """A request URL from a template with {query} or {q}, {raw_name}, {name}, {code}."""
    out = F.lit(template)
    for mark, value in (("{query}", F.url_encode(query)), ("{q}", F.url_encode(query)), ("{raw_name}", name), ("{name}", F.url_encode(name)), ("{code}", F.coalesce(code, F.lit("")))):
        out = F.replace(out, F.lit(mark), value)
    return out


def json_results(responses: DataFrame, items: str, fields: dict[str, str]) -> DataFrame:
    """query_id, n and a column for each of fields: the items of JSON responses (query_id, body), fields by path within an item.

    A list gives its first text; the path of a field may end in [] to keep the list, as JSON.
    """
    # a list is taken whole: [*] at the end would give a list of one as its element
    list_ = F.from_json(F.get_json_object("body", "$." + items.removesuffix("[]").replace("[]", "[*]")), "array<string>")
    spread = responses.select("query_id", F.posexplode(list_).alias("n", "item"))

    def first(path: str) -> Column:
        found = F.get_json_object("item", "$." + path.removesuffix("[]").replace("[]", "[*]"))
        if path.endswith("[]"):
            return found
        return F.when(found.startswith("["), F.get_json_object(found, "$[0]")).otherwise(found)

    return spread.select("query_id", "n", *(first(p).alias(c) for c, p in fields.items()))


def feed_results(responses: DataFrame) -> DataFrame:
    """query_id, n, url, title, snippet of the entries of RSS or Atom responses (query_id, body)."""
    item = r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"
    spread = responses.select("query_id", F.posexplode(F.regexp_extract_all("body", F.lit(item), F.lit(1))).alias("n", "x"))
    link = F.coalesce(F.nullif(F.regexp_extract("x", r'(?is)<link[^>]*?href="([^"]+)"', 1), F.lit("")), F.regexp_extract("x", r"(?is)<link[^>]*>(.*?)</link>", 1))
    part = lambda tags: strip_tags(F.regexp_extract("x", rf"(?is)<(?:{tags})[^>]*>(.*?)</(?:{tags})>", 1))
    return spread.select("query_id", "n", strip_tags(link).alias("url"), part("title").alias("title"), part("description|summary|content").alias("snippet"))


def page_results(responses: DataFrame, pattern: str = ".") -> DataFrame:
    """query_id, n, url, title: links of HTML responses (query_id, url, body) that fit the pattern, each once, absolute."""
    spread = responses.select("query_id", "url", F.posexplode(html_links(F.col("body"))).alias("n", "l")).where(~F.col("l.url").startswith("#"))
    found = spread.select("query_id", "n", web.resolve_url(F.col("url"), F.col("l.url")).alias("url"), F.col("l.anchor").alias("title")).where(F.col("url").rlike(pattern))
    first = found.groupBy("query_id", "url").agg(F.min(F.struct("n", "title")).alias("f"))
    return first.select("query_id", "f.n", "url", "f.title")


def blocked(body: Column, block_pattern: str, link_pattern: str) -> Column:
    """A page that checks for robots instead of giving results."""
    return body.rlike(f"(?i){block_pattern}") & ~body.rlike(f"(?is){link_pattern}")


def distinct_hits(hits: DataFrame, most: int = 8) -> DataFrame:
    """The first hits of each query over all engines, one for each normalised URL, without hosts that are never visited."""
    h = hits.where(F.col("url").rlike("^https?://") & ~web.skip_host(F.col("url"))).withColumn("key", web.normalise_url(F.col("url")))
    first = h.groupBy("query_id", "key").agg(F.min(F.struct("n", "url", "title")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("f.n", "key"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "f.url", "f.title", "key", "rank")


#: Results that are ranked in one window; what lies before them is counted.
RANKED = 4096


def catalogue_actions(results: DataFrame, review_at: int = 30, download_at: int | None = None) -> DataFrame:
    """results (seq, provider, title, url, kind, score, n_files) with action, each result once over all providers, and rank by falling score, then seq.

    Links to look up stay lookups; the rest is skipped, taken as metadata only, or downloaded. download_at: files of records under this score, which
    nobody chose, are left where they are and their metadata taken. seq is a whole number, another for each result.
    """
    key = F.coalesce("url", F.concat("provider", F.lit(":"), "title"))
    # a window, not a struct of all columns: those that nobody asks for (long descriptions, metadata) are then never shuffled or sorted
    first = results.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("seq")))).where("_first = 1").drop("_first")
    gate = F.lit(False) if download_at is None else F.col("score") < download_at
    action = F.when(F.col("kind") == "lookup", "lookup").when(F.col("score") < review_at, "skip").when((F.col("n_files") == 0) | gate, "metadata").otherwise("download")
    # rank: those of greater score or in earlier blocks of seq are counted, only a block is sorted
    placed = first.withColumns({"action": action, "_s": F.coalesce(-F.col("score"), F.lit(1)), "_b": F.floor(F.col("seq") / RANKED)})
    sizes = placed.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_s", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("seq"))
    ranked = placed.withColumn("_k", own).join(sizes.select("_s", "_b", before.alias("_before")), ["_s", "_b"])
    return ranked.withColumn("rank", (F.col("_before") + F.col("_k")).cast("int")).drop("_s", "_b", "_k", "_before")


def wanted_files(files: DataFrame, most_bytes: int = 500_000_000, most_files: int = 25) -> DataFrame:
    """files (record_id, n, url, size) of each record up to so many, without those known to be too large."""
    return files.where(F.col("n") < most_files).where(F.col("size").isNull() | (F.col("size") <= most_bytes))


def smallest_files(files: DataFrame, most: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy("size", "url"))
    return files.withColumn("rank", rank).where(F.col("rank") <= most)


def relevant_links(links: DataFrame, names: list[str], most: int = 6) -> DataFrame:
    """The first links (page_id, n, url, anchor) of each page whose anchor or URL has one of the folded names."""
    both = fold(F.concat_ws(" ", "anchor", "url"))
    said = F.lit(False)
    for name in names:
        said = said | F.contains(both, F.lit(name))
    kept = links.where(said)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("n"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most)


def file_actions(links: DataFrame, scores: DataFrame, review_at: int = 30, page_loss: int = 20, most: int = 40) -> DataFrame:
    """url, key, kind, score, action, rank for the files that pages link to: each once, however written, in the order in which they were found.

    links: seq, url, page_score (may be null); scores: url, score, what address and anchor say. A file is worth what it says itself, or
    its page less page_loss. Repositories' records are expanded (see record_requests), files of code hosts are asked for as
    they are; action is record, download, or skip under review_at. No more than `most` are downloaded in all.
    """
    l = links.where(web.looks_like_file(F.col("url")) | web.repository_kind(F.col("url")).isNotNull()).withColumn("key", web.normalise_url(F.col("url")))
    first = l.groupBy("key").agg(F.min(F.struct("seq", "url")).alias("f"), F.max("page_score").alias("page_score")).select("key", "f.seq", "f.url", "page_score")
    met = first.join(scores.groupBy("url").agg(F.max("score").alias("own")), "url", "left").withColumn("kind", web.repository_kind(F.col("url")))
    score = F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("page_score", F.lit(0)) - page_loss)
    raw = F.regexp_replace("url", r"github\.com/([^/]+/[^/]+)/blob/", "raw.githubusercontent.com/$1/")
    met = met.withColumn("score", score).withColumn("action", F.when(F.col("kind").isin("zenodo", "internet_archive"), "record").when(score < review_at, "skip").otherwise("download"))
    rank = F.row_number().over(Window.partitionBy("action").orderBy("seq", "key"))
    out = met.select(F.when(F.col("kind") == "github_blob", raw).otherwise(F.col("url")).alias("url"), "key", "kind", "score", "action", rank.alias("rank"))
    return out.where((F.col("action") != "download") | (F.col("rank") <= most))


def record_requests(urls: DataFrame) -> DataFrame:
    """url, kind, request: where a repository's record (url) lists its files."""
    zenodo, archive = F.regexp_extract("url", r"/records?/(\d+)", 1), F.regexp_extract("url", r"archive\.org/(?:details|download)/([^/?#]+)", 1)
    kind = web.repository_kind(F.col("url"))
    request = F.when(kind == "zenodo", F.concat(F.lit("https://zenodo.org/api/records/"), zenodo)).when(kind == "internet_archive", F.concat(F.lit("https://archive.org/metadata/"), archive))
    return urls.select("url", kind.alias("kind"), request.alias("request")).where("request IS NOT NULL")


def record_files(responses: DataFrame, most: int = 10) -> DataFrame:
    """url, title, licence, file, size: the first files of records (url, kind, body as JSON)."""
    links = F.from_json(F.get_json_object("body", "$.files"), "array<struct<size:string,links:struct<self:string>>>")
    names = F.from_json(F.get_json_object("body", "$.files"), "array<struct<name:string,size:string>>")
    ident = F.regexp_extract("url", r"archive\.org/(?:details|download)/([^/?#]+)", 1)
    files = F.when(F.col("kind") == "zenodo", F.transform(links, lambda f: F.struct(f["links"]["self"].alias("file"), f["size"].try_cast("long").alias("size")))).otherwise(
        F.transform(names, lambda f: F.struct(F.concat(F.lit("https://archive.org/download/"), ident, F.lit("/"), F.replace(f["name"], F.lit(" "), F.lit("%20"))).alias("file"), f["size"].try_cast("long").alias("size")))
    )
    title = F.coalesce(F.get_json_object("body", "$.metadata.title"), F.get_json_object("body", "$.title"))
    listed = F.slice(F.filter(files, lambda f: f["file"].isNotNull()), 1, most)
    return responses.select("url", title.alias("title"), F.get_json_object("body", "$.metadata.license.id").alias("licence"), F.explode(listed).alias("f")).select("url", "title", "licence", "f.file", "f.size")
