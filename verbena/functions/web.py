"""URL functions as column expressions."""

from __future__ import annotations

from urllib.parse import quote, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verbena.functions.text import let

#: Extensions of files worth downloading.
FILE_EXTENSIONS = (
    "pdf|docx?|odt|rtf|txt|csv|tsv|json|xml|zip|tar|tgz|gz|7z|rar|wav|mp3|flac|ogg|m4a|mp4|mkv|webm|mov|"
    "eaf|textgrid|flextext|lift|xlsx?|epub|djvu|png|jpe?g|tiff?|ttf|otf|kmp|kmn|sqlite|parquet"
)
#: Parts of hosts that are never visited.
SKIPPED_HOSTS = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com",
    "google.com", "accounts.", "login.", "amazon.", "pinterest.", "tiktok.com",
)

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_parts(url: Column) -> Column:
    """scheme, host (with port, as written), path, query of a URL; empty where missing."""
    u = F.btrim(url)
    return F.struct(*(F.regexp_extract(u, _URL, i).alias(n) for i, n in enumerate(("scheme", "host", "path", "query"), 1)))


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, no tracking parameters, no slash at the end, no fragment. Parameters without a value go."""

    def of(p: Column) -> Column:
        kept = F.filter(F.split(p["query"], "&"), lambda x: x.rlike(r"^[^=]+=.") & ~x.rlike(r"^(?:utm_|fbclid|ref)"))
        path = F.regexp_replace(p["path"], r"/+$", "")
        query = F.array_join(kept, "&")
        return F.concat(F.lower(p["scheme"]), F.when(p["scheme"] == "", "").otherwise("://"), F.lower(p["host"]), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    return let(url, lambda u: let(url_parts(u), of))


def host(url: Column) -> Column:
    return F.lower(url_parts(url)["host"])


def looks_like_file(url: Column) -> Column:
    whole = lambda p: F.concat(p["path"], F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])))
    return let(url, lambda u: let(url_parts(u), lambda p: whole(p).rlike(rf"(?i)\.(?:{FILE_EXTENSIONS})(?:$|\?)")))


def skip_host(url: Column) -> Column:
    return let(host(url), lambda h: F.exists(F.array(*map(F.lit, SKIPPED_HOSTS)), lambda s: F.contains(h, s)))


def repository_kind(url: Column) -> Column:
    return F.when(url.rlike(r"zenodo\.org/(?:records?|api/records)/\d+"), "zenodo").when(url.rlike(r"archive\.org/(?:details|download)/[^/?#]+"), "internet_archive").when(url.rlike(r"github\.com/[^/]+/[^/]+/blob/"), "github_blob")


def resolve_url(base: Column, link: Column) -> Column:
    """An absolute URL for a link on a page: absolute links, //host, /path and plain relative ones."""

    def of(p: Column) -> Column:
        site = F.concat(p["scheme"], F.lit("://"), p["host"])
        folder = F.regexp_replace(p["path"], r"[^/]*$", "")
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(p["scheme"], F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("#") | (link == ""), F.concat(site, p["path"], link))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
        )

    return let(base, lambda u: let(url_parts(u), of))


def response_filename(url: Column, disposition: Column) -> Column:
    """The file's name: from Content-Disposition, its encoded form first, or the last part of the path that says something."""
    encoded = F.try_url_decode(F.regexp_extract(F.coalesce(disposition, F.lit("")), r"(?i)filename\*=(?:UTF-8'')?([^;]+)", 1))
    plain = F.regexp_extract(F.coalesce(disposition, F.lit("")), r'(?i)filename="?([^";]+)"?', 1)
    path = F.regexp_replace(url_parts(url)["path"], r"/content$", "")
    last = F.try_url_decode(F.regexp_extract(path, r"([^/]+)/*$", 1))
    first = lambda *c: F.coalesce(*(F.nullif(F.btrim(x), F.lit("")) for x in c), F.lit("download"))
    return first(encoded, plain, last)


def cache_key(accept: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(accept, url), 256), 1, 32)


def iri_to_uri(iri: str) -> str:
    """An ASCII form of an address with any letters: host by IDNA, the rest percent-encoded."""
    p = urlsplit(iri)
    name, _, port = p.netloc.partition(":")
    try:
        name = name.encode("idna").decode()
    except UnicodeError:
        name = quote(name)
    return urlunsplit((p.scheme, name + (":" + port if port else ""), quote(p.path, safe="/%:@!$&'()*+,;=~-._"), quote(p.query, safe="=&%/:?@!$'()*+,;~-._"), quote(p.fragment, safe="%")))


@F.pandas_udf(StringType())
def iri_to_uri_column(iri):  # noqa: ANN001, ANN201
    return iri.map(lambda x: None if x is None else iri_to_uri(x))
