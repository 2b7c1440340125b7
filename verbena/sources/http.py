"""Web resources as a table: a row for each URL asked for, failures included. Nothing here is fetched unless a plan reads it."""

from __future__ import annotations

import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.functions.web import iri_to_uri
from verbena.session import ship

AGENT = "verbena/1"
SCHEMA = "url string, status int, content_type string, disposition string, body binary, error string"


def get(url: str, accept: str = "*/*", timeout: int = 30, most: int = 500_000_000, method: str = "GET") -> tuple[int | None, str | None, str | None, bytes | None, str | None]:
    """status, content type, disposition, body (null if over most bytes), error."""
    try:
        request = urllib.request.Request(iri_to_uri(url), headers={"User-Agent": AGENT, "Accept": accept}, method=method)
        with urllib.request.urlopen(request, timeout=timeout) as r:
            body = r.read(most + 1)
            if len(body) > most:
                return getattr(r, "status", None), r.headers.get("Content-Type"), r.headers.get("Content-Disposition"), None, "too large"
            return getattr(r, "status", None), r.headers.get("Content-Type"), r.headers.get("Content-Disposition"), body, None
    except urllib.error.HTTPError as e:
        return e.code, None, None, None, str(e)
    except Exception as e:
        return None, None, None, None, f"{type(e).__name__}: {e}"


@lru_cache(maxsize=10_000)
def _robots(site: str) -> urllib.robotparser.RobotFileParser | None:
    status, _, _, body, _ = get(f"{site}/robots.txt", "text/plain", 10, 1_000_000)
    if body is None or (status or 0) >= 400:
        return None
    rules = urllib.robotparser.RobotFileParser()
    rules.parse(body.decode("utf-8", "replace").splitlines())
    return rules


def allowed(url: str) -> bool:
    """What a site's robots.txt says; without one, yes."""
    p = urlsplit(url)
    if p.scheme not in ("http", "https"):
        return True
    rules = _robots(f"{p.scheme}://{p.netloc}")
    return rules is None or rules.can_fetch(AGENT, url)


def fetch(urls: DataFrame, accept: str = "*/*", timeout: int = 30, most: int = 500_000_000, robots: bool = True, parallel: int = 3) -> DataFrame:
    """SCHEMA for each distinct url of urls; a site's URLs go to one task, so that it is asked one at a time."""
    ship(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                row = get(u, accept, timeout, most) if not robots or allowed(u) else (None, None, None, None, "disallowed by robots.txt")
                yield pa.RecordBatch.from_arrays([pa.array([u]), *(pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()), strict=True))], names=["url", "status", "content_type", "disposition", "body", "error"])

    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return urls.select("url").distinct().repartition(parallel, host).mapInArrow(run, SCHEMA)


def cached(urls: DataFrame, cache: DataFrame, now, hours: float = 6.0, **options) -> DataFrame:
    """SCHEMA and fetched_at: what the cache (the same columns) has that is young enough, the rest fetched."""
    fresh = cache.join(urls.select("url").distinct(), "url", "left_semi").where(F.col("fetched_at") >= now - F.make_dt_interval(hours=F.lit(int(hours))))
    rest = fetch(urls.join(fresh.select("url"), "url", "left_anti"), **options).withColumn("fetched_at", now)
    return fresh.unionByName(rest.select(*fresh.columns))
