"""Visiting pages in bounded rounds: what is new, who may be asked, and what was learned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbena.functions import web
from verbena.functions.text import fold
from verbena.operators.discover import relevant_links
from verbena.session import written


def crawl(seeds: DataFrame, fetch, names: list[str], depth: int = 2, per_host: int = 6, most_pages: int = 40, before: DataFrame | None = None) -> DataFrame:
    """url, key, depth, host, page columns of what is visited from seeds (url).

    fetch takes a DataFrame (url, key, depth, host) and returns it with title, text and links (array of url, anchor): a table of pages in
    tests, a source over HTTP elsewhere. Each depth is one round; a page is visited once, a host at most per_host times. before: pages (key, host)
    of earlier crawls, which are not visited again and count for their hosts.
    """
    frontier = seeds.select("url").withColumn("depth", F.lit(1))
    visited: DataFrame | None = None
    for level in range(1, depth + 1):
        new = frontier.where(F.col("url").rlike("^https?://") & ~web.skip_host(F.col("url"))).withColumn("key", web.normalise_url(F.col("url"))).withColumn("host", web.host(F.col("url")))
        new = new.groupBy("key").agg(F.min("url").alias("url"), F.min("host").alias("host"), F.lit(level).alias("depth"))
        seen = [v.select("key", "host") for v in (before, visited) if v is not None]
        if seen:
            been = seen[0] if len(seen) == 1 else seen[0].union(seen[1])
            new = new.join(been.select("key"), "key", "left_anti").join(been.groupBy("host").agg(F.count("*").alias("been")), "host", "left")
        else:
            new = new.withColumn("been", F.lit(0))
        rank = F.row_number().over(Window.partitionBy("host").orderBy("key"))
        new = new.where(~web.looks_like_file(F.col("url"))).withColumn("k", rank).where(F.col("k") + F.coalesce("been", F.lit(0)) <= per_host)
        new = new.orderBy("k", "key").limit(most_pages).select("url", "key", "depth", "host")
        pages = written(fetch(new), "pages")  # a round's pages are fetched once
        visited = pages if visited is None else visited.unionByName(pages)
        if level == depth:
            break
        links = pages.select(F.col("key").alias("page_id"), F.col("url").alias("base"), F.posexplode("links").alias("n", "l"))
        links = links.select("page_id", "n", web.resolve_url(F.col("base"), F.col("l.url")).alias("url"), F.col("l.anchor").alias("anchor"))
        frontier = relevant_links(links, names).select("url").withColumn("depth", F.lit(level + 1))
    return visited.limit(most_pages * depth)


def found_files(visited: DataFrame) -> DataFrame:
    """seq, url, anchor, page_key of the links of visited pages, in the order in which they were found, as discover.file_actions() takes them."""
    links = visited.select("depth", "key", F.col("url").alias("base"), F.posexplode("links").alias("n", "l"))
    order = F.struct("depth", "key", "n")
    return links.select(order.alias("seq"), web.resolve_url(F.col("base"), F.col("l.url")).alias("url"), F.col("l.anchor").alias("anchor"), F.col("key").alias("page_key"))


def learned_queries(facts: DataFrame, asked: DataFrame, name: str, most: int = 16) -> DataFrame:
    """query, basis for names learned (field, value), without queries asked already (query); of several spellings of a query the least."""
    forms = F.when(F.col("field") == "varieties", F.array(F.lit('"{x}" dictionary'), F.lit('"{x}" language documentation'), F.lit(f'"{{x}}" "{name}" corpus'))).when(F.col("field").isin("alternate_names", "exonyms"), F.array(F.lit('"{x}" language'))).when(F.col("field") == "places", F.array(F.lit(f'"{name}" "{{x}}"')))
    q = facts.select("value", F.explode(forms).alias("form")).select(F.replace("form", F.lit("{x}"), F.col("value")).alias("query"), F.lit("learned").alias("basis"))
    known = asked.select(fold(F.col("query")).alias("key")).distinct()
    return q.withColumn("key", fold(F.col("query"))).join(known, "key", "left_anti").groupBy("key").agg(F.min("query").alias("query"), F.min("basis").alias("basis")).orderBy("key").limit(most).select("query", "basis")
