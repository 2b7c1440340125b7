"""Searching in rounds that learn: queries to hits, hits to pages, pages to names, names to better scores and to new queries.

A round asks what no round has asked, visits what none has visited, and scores every page visited so far with the terms known by then, so that a name
learned in one round lifts pages of the rounds before it. Only pages about the language teach; what they teach are facts, and of these
the names of varieties, alternates and exonyms become terms. All steps are joins and aggregations over tables of queries, pages and
terms; the number of rounds, pages and names is bounded, as people and sites are asked, not data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from verbena.functions.text import clean_name, fold, html_links, html_title, page_text
from verbena.operators import catalogues, crawl, discover, facts, relevance
from verbena.session import written
from verbena.sources import http


@dataclass(frozen=True)
class SearchLimits:
    """How much one search asks of others, and what scores count."""

    rounds: int = 2
    queries: int = 16
    hits: int = 8
    pages: int = 40
    depth: int = 2
    per_host: int = 6
    files: int = 40
    names: int = 12
    names_per_page: int = 5
    review_at: int = 30
    confirmed_at: int = 70


#: A short pass that only learns.
ENRICH = SearchLimits(rounds=1, queries=4, hits=4, pages=6, depth=1, per_host=3, files=0)
#: The signal that each field of names becomes.
LEARNED = {"varieties": "variety", "alternate_names": "alternate_name", "exonyms": "exonym"}


@dataclass(frozen=True)
class Found:
    """What a search found, as tables.

    queries: query, basis, round. pages: key, url, round, depth, host, title, text, links. scores: round, key, score, of all pages visited by then.
    learned: value, signal, field, key (the page), round. terms: the terms given and those learned. facts: key, grp, field, value, confidence, quote.
    """

    queries: DataFrame
    pages: DataFrame
    scores: DataFrame
    learned: DataFrame
    terms: DataFrame
    facts: DataFrame

    def last_scores(self) -> DataFrame:
        """key, score with all that was learned."""
        return self.scores.groupBy("key").agg(F.max_by("score", "round").alias("score"))

    def files(self, languages: DataFrame, limits: SearchLimits | None = None) -> DataFrame:
        """url, key, kind, score, action, rank of the files that relevant pages link to."""
        limits = limits or SearchLimits()
        relevant = self.pages.join(self.last_scores().where(F.col("score") >= limits.review_at), "key")
        links = crawl.found_files(relevant).join(relevant.select(F.col("key").alias("page_key"), F.col("score").alias("page_score")), "page_key")
        told = links.groupBy("url").agg(F.min("anchor").alias("anchor"))
        one = languages.select("language_id").limit(1)
        c = told.crossJoin(F.broadcast(one)).select(F.col("url").alias("candidate_id"), "language_id", F.concat_ws(" ", "url", "anchor").alias("text"))
        own = relevance.score(c, languages, self.terms).select(F.col("candidate_id").alias("url"), "score")
        return discover.file_actions(links, own, limits.review_at, most=limits.files)


def search_rounds(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame], languages: DataFrame, terms: DataFrame,
    learn: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None, limits: SearchLimits | None = None,
) -> Found:
    """A search for the one language of languages (language_id, iso, name).

    queries: query, basis, rank. search takes query_id, query and returns query_id, n, url, title of hits; fetch is that of crawl(). terms:
    language_id, signal, seq, term, weak. learn takes key, text and returns key, grp, field, value, confidence, quote (facts.extract_facts by
    default). index: registry.name_index(), to leave out names of other languages.
    """
    limits = limits or SearchLimits()
    spark = queries.sparkSession
    language = languages.first()
    terms = written(terms.select("language_id", "signal", "seq", "term", "weak"), "search-terms")
    own = spark.createDataFrame([(language.name,)], "term string")
    pending = queries.select("query", "basis", "rank")
    asked = pages = scores = taught = None
    learned = spark.createDataFrame([], "value string, field string, signal string, key string, round int, place int")
    for n in range(1, limits.rounds + 1):
        keyed = pending.withColumn("key", fold(F.col("query"))).where("key <> ''")
        first = keyed.groupBy("key").agg(F.min(F.struct("rank", "query", "basis")).alias("q"))
        if asked is not None:
            first = first.join(asked.select("key"), "key", "left_anti")
        new = first.orderBy("q.rank", "key").limit(limits.queries).select("key", "q.query", "q.basis", F.lit(n).alias("round"))
        new = written(new, "search-queries")
        asked = new if asked is None else asked.unionByName(new)
        hits = discover.distinct_hits(search(new.select(F.col("key").alias("query_id"), "query")), limits.hits)
        known = names_of(own, terms)
        fresh = crawl.crawl(hits.select("url"), fetch, known, limits.depth, limits.per_host, limits.pages, before=pages)
        fresh = written(fresh.withColumn("round", F.lit(n)), "search-pages")
        pages = fresh if pages is None else pages.unionByName(fresh)
        scored = page_scores(pages, languages, terms)
        scored = written(scored.withColumn("round", F.lit(n)), "search-scores")
        scores = scored if scores is None else scores.unionByName(scored)
        sure = pages.join(scored.where(F.col("score") >= limits.confirmed_at).select("key"), "key", "left_semi")
        about = catalogues.about_us(sure, known).where("about").select("key", "text")
        said = learn(about) if learn else facts.extract_facts(about, "key", name=language.name, known=tuple(x for x in known if len(x) >= 5), most=None)
        taught = written(said, "search-facts")  # pages that taught before teach again: the last round's facts are all facts
        names = new_names(taught, known, learned, index, language.iso, limits)
        learned = written(learned.unionByName(names.withColumn("round", F.lit(n))), "search-names")
        terms = written(terms.unionByName(learned.where(F.col("round") == n).select(F.lit(language.language_id).alias("language_id"), "signal", (F.lit(10_000) + F.col("place")).cast(terms.schema["seq"].dataType).alias("seq"), F.col("value").alias("term"), F.lit(False).alias("weak"))), "search-terms")
        if n < limits.rounds:
            # every round asks for all names so far; what was asked before is left out above
            pending = crawl.learned_queries(learned, asked, language.name, limits.queries).withColumn("rank", F.lit(0))
    if learned.where(F.col("round") == limits.rounds).limit(1).count():
        last = page_scores(pages, languages, terms).withColumn("round", F.lit(limits.rounds + 1))  # what the last round taught counts, too
        scores = scores.unionByName(written(last, "search-scores"))
    return Found(asked.select("query", "basis", "round"), pages, scores, learned.select("value", "signal", "field", "key", "round"), terms, taught)


#: So many names are looked for in links and openings of pages.
MOST_NAMES = 200


def names_of(own: DataFrame, terms: DataFrame) -> list[str]:
    """Folded names of the language, its own first: entered by people or learned, so they are few."""
    t = own.select(F.lit(0).alias("o"), "term").union(terms.where(F.col("signal").isin(*LEARNED.values())).select(F.lit(1).alias("o"), "term"))
    rows = t.select("o", fold(F.col("term")).alias("f")).where("f <> ''").groupBy("f").agg(F.min("o").alias("o")).orderBy("o", "f").limit(MOST_NAMES).collect()
    return [r.f for r in rows]


def page_scores(pages: DataFrame, languages: DataFrame, terms: DataFrame) -> DataFrame:
    """key, score: what address and title say of the language, and whether the text names it."""
    one = F.broadcast(languages.select("language_id").limit(1))
    c = pages.crossJoin(one).select(F.col("key").alias("candidate_id"), "language_id", F.concat_ws(" ", "url", "title").alias("text"), F.col("text").alias("contents"))
    return relevance.score(c, languages, terms, contents_read=None).select(F.col("candidate_id").alias("key"), "score")


def new_names(said: DataFrame, known: list[str], learned: DataFrame, index: DataFrame | None, iso: str | None, limits: SearchLimits) -> DataFrame:
    """value, field, signal, key, place: names in facts that are not known yet, so many of a page and so many in all.

    A name that several pages tell counts for the least key; of several fields for the first of LEARNED.
    """
    signal = F.create_map(*(F.lit(x) for k, v in LEARNED.items() for x in (k, v)))
    t = said.where(F.col("field").isin(*LEARNED)).select("key", "field", signal[F.col("field")].alias("signal"), clean_name(F.col("value")).alias("value"))
    t = t.withColumn("folded", fold(F.col("value"))).where((F.col("folded") != "") & ~F.col("folded").isin(*known))
    if index is not None:
        other = catalogues.other_languages(t.select("value").distinct(), index, iso or "")
        t = t.join(other, "value", "left_anti")
    order = F.create_map(*(F.lit(x) for i, k in enumerate(LEARNED) for x in (k, i)))
    first = t.groupBy("folded").agg(F.min(F.struct("key", order[F.col("field")].alias("o"), "value", "field", "signal")).alias("f")).select("folded", "f.*")
    k = F.row_number().over(Window.partitionBy("key").orderBy("o", "folded"))
    some = first.withColumn("k", k).where(F.col("k") <= limits.names_per_page)
    left = limits.names - learned.count()
    few = some.orderBy("key", "k").limit(max(0, left))  # at most SearchLimits.names rows from here on
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key", "k"))
    return few.select("value", "field", "signal", "key", place.alias("place"))


def proposals(said: DataFrame, values: DataFrame, language: str) -> DataFrame:
    """Facts as proposals (language_id, grp, field, value_json, confidence, source_ref, quote) that say something new; of equal ones the surest."""
    from verbena.operators import profile

    p = said.select(F.lit(language).alias("language_id"), "grp", "field", F.substring(F.to_json(F.array("value")), F.lit(2), F.length(F.to_json(F.array("value"))) - 2).alias("value_json"), "confidence", F.col("key").alias("source_ref"), "quote")
    best = p.groupBy("language_id", "grp", "field", profile.value_key(F.col("value_json")).alias("k")).agg(F.min(F.struct(-F.col("confidence"), "source_ref", "value_json", "confidence", "quote")).alias("b"))
    return profile.unknown_proposals(best.select("language_id", "grp", "field", "b.value_json", "b.confidence", "b.source_ref", "b.quote"), values)


# ------------------------------------------------------------ the web
def engines(entries: list[dict], name: str, code: str | None, fetched: Callable[[DataFrame], DataFrame] = http.fetch) -> Callable[[DataFrame], DataFrame]:
    """search of search_rounds() over engines: entries with name, kind (json, rss, html), url with {query}, and for json items, link, title, for html
    link_pattern and blocked_pattern; unwrap names the parameter that holds the address in redirecting links. Hits of several engines follow each other in the order of entries; one that fails gives none."""

    def search(asked: DataFrame) -> DataFrame:
        hits = None
        for place, e in enumerate(entries):
            request = asked.select("query_id", discover.render_url(e["url"], F.col("query"), F.lit(name), F.lit(code)).alias("url"))
            got = fetched(request).where("error IS NULL").select("url", F.decode(F.coalesce("body", F.lit(b"")), "UTF-8").alias("body"))
            answers = request.join(got, "url")
            if e.get("kind", "html") == "json":
                found = discover.json_results(answers.select("query_id", "body"), e.get("items", "results[]"), {"url": e.get("link", "url"), "title": e.get("title", "title")})
            elif e.get("kind") == "rss":
                found = discover.feed_results(answers.select("query_id", "body"))
            else:
                pattern = e.get("link_pattern", "^https?://")
                open_ = answers.where(~discover.blocked(F.col("body"), e["blocked_pattern"], pattern)) if e.get("blocked_pattern") else answers
                found = discover.page_results(open_, pattern)
            rows = found.select("query_id", (F.col("n") + place * 1_000_000).alias("n"), (catalogues.unwrapped(F.col("url"), e["unwrap"]) if e.get("unwrap") else F.col("url")).alias("url"), "title")
            hits = rows if hits is None else hits.unionByName(rows)
        return hits

    return search


def pages_of(fetched: Callable[[DataFrame], DataFrame] = http.fetch) -> Callable[[DataFrame], DataFrame]:
    """fetch of crawl() over HTTP: what is HTML, with title, text and links; robots.txt and hosts are minded by the reader."""

    def fetch(asked: DataFrame) -> DataFrame:
        got = fetched(asked.select("url")).where("error IS NULL AND body IS NOT NULL AND coalesce(content_type, 'text/html') ILIKE '%html%'")
        html = F.decode("body", "UTF-8")
        return asked.join(got.select("url", html_title(html).alias("title"), page_text(html, most=None).alias("text"), html_links(html).alias("links")), "url")

    return fetch


__all__ = ["ENRICH", "Found", "SearchLimits", "engines", "pages_of", "proposals", "search_rounds"]
