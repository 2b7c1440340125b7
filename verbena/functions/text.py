"""Text functions as column expressions: folding, words, shingles, sketches, plain text from markup, names for files."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that folding turns into spaces.
FOLD_SPACES = "'’`´-_/(),."


@functools.cache
def _unaccented() -> tuple[str, str]:
    """Characters of Latin, Greek and Cyrillic blocks whose decomposition is one base character and marks, and these characters."""
    source, target = [], []
    for cp in [*range(0xA0, 0x530), *range(0x1E00, 0x2000)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(cp):
            source.append(chr(cp))
            target.append(base[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without diacritics, with FOLD_SPACES and runs of white space as single spaces; null becomes empty.

    Exact for letters that decompose to one base letter (see _unaccented) and for decomposed text; fold_exact() also takes apart
    ligatures and the like.
    """
    source, target = _unaccented()
    plain = F.translate(F.coalesce(text, F.lit("")), source + FOLD_SPACES, target + " " * len(FOLD_SPACES))
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(plain, r"\p{Mn}+", "")), r"[\s\x1c-\x1f\x{85}\x{a0}]+", " "))


def fold_string(text: str | None) -> str:
    """fold_exact() of one string, for values on the driver."""
    kept = []
    for c in unicodedata.normalize("NFKD", text or ""):
        if not unicodedata.combining(c):
            kept.append(" " if c in FOLD_SPACES else c.lower())
    return " ".join("".join(kept).split())


@F.pandas_udf(StringType())
def fold_exact(text):  # noqa: ANN001, ANN201
    return text.map(fold_string)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value worked out once for the row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """A 64-bit hash, as 16 hexadecimal digits, of each run of size words; empty where there are fewer."""

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, size), " ").cast("binary")), 1, 16))

    return let(words, hashes)


def signature(words: Column, k: int = 128, size: int = 5) -> Column:
    """The k smallest distinct shingle hashes in order; null for texts of fewer than 4 * size words."""
    return let(words, lambda w: F.when(F.size(w) >= 4 * size, F.slice(F.sort_array(F.array_distinct(shingle_hashes(w, size))), 1, k)))


def sketch_union(a: Column, b: Column, k: int = 128) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def sketch_shared(a: Column, b: Column, k: int = 128) -> Column:
    """How many of the k smallest hashes of both sketches together are in both; over the size of sketch_union() it estimates Jaccard."""
    return F.size(F.array_intersect(F.array_intersect(sketch_union(a, b, k), a), b))


def clean(text: Column) -> Column:
    """Unix line ends, single blanks, no empty lines, no white space around."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n\s*\n+", "\n")
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


#: Named entities that text() resolves, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def strip_tags(text: Column) -> Column:
    """Titles and snippets: tags and no-break spaces as spaces, entities resolved, no white space around."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    return F.btrim(F.replace(unescape(text), F.lit(" "), F.lit(" ")), F.lit(" \t\n\r\x0b\x0c"))


#: Elements whose contents are no text, in files and in pages from the web.
HIDDEN = ("script", "style", "nav", "footer")
PAGE_HIDDEN = (*HIDDEN, "noscript", "svg")


def html_text(html: Column) -> Column:
    """The text of an HTML file: no head, no hidden elements, a line for each block."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<head\b.*?</head>", " ")
    for tag in HIDDEN:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|p|div|li|h[1-6]|tr)\b[^>]*>", "\n")
    return clean(unescape(F.regexp_replace(text, r"(?s)<[^>]+>", " ")))


def page_text(html: Column, most: int | None = 200_000) -> Column:
    """The text of a page from the web, its title included, up to so many characters; None reads all."""
    text = F.coalesce(html, F.lit(""))
    for tag in PAGE_HIDDEN:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", "")
    text = F.regexp_replace(text, r"(?i)<(?:p|br|li|h[1-4]|tr|div|td)\b[^>]*>", "\n")
    whole = clean(unescape(F.regexp_replace(text, r"(?s)<[^>]*>", "")))
    return whole if most is None else F.substring(whole, 1, most)


def html_title(html: Column) -> Column:
    return F.substring(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, 300)


def html_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']([^\"']+)[\"']", 1)), F.lit(""))


def html_links(html: Column) -> Column:
    """url and anchor of each link, in order, as written."""
    pattern = r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    urls, anchors = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(urls, anchors, lambda u, a: F.struct(F.btrim(u).alias("url"), F.substring(strip_tags(a), 1, 200).alias("anchor")))


def html_meta(html: Column) -> Column:
    """Contents of meta elements by name or property, lower case; the last of a name counts."""
    pattern = r"(?is)<meta\b[^>]*?\b(?:name|property)=[\"']([^\"']+)[\"'][^>]*?\bcontent=[\"']([^\"']*)[\"']"
    names, values = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    pairs = F.filter(F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("key"), F.substring(unescape(v), 1, 500).alias("value"))), lambda p: p["value"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def xml_text(xml: Column, element: str | None = None) -> Column:
    """All text of an XML document, or that of the named elements, one a line."""
    if element is None:
        return clean(unescape(F.regexp_replace(xml, r"(?s)<[^>]+>", "\n")))
    parts = F.regexp_extract_all(xml, F.lit(rf"(?s)<{element}\b[^>]*>(.*?)</{element}>"), F.lit(1))
    return clean(F.array_join(F.filter(F.transform(parts, strip_tags), lambda x: x != ""), "\n"))


def text_quality(text: Column, sample: int | None = 20_000) -> Column:
    """empty, low or ok, by the share of letters, by gaps and by words of three letters in the first characters; None looks at all."""
    whole = F.coalesce(text, F.lit(""))
    s = whole if sample is None else F.substring(whole, 1, sample)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", "")) / F.greatest(F.length(s), F.lit(1))
    words = F.regexp_count(s, F.lit(r"[A-Za-z]{3,}"))
    return F.when(F.btrim(whole, F.lit(" \t\n\r\x0b\x0c")) == "", "empty").when((letters < 0.4) | ~s.rlike("[ \n]") | (words <= 20), "low").otherwise("ok")


def safe_name(name: Column, most: int = 120) -> Column:
    """A file name with no path and only plain characters; too long ones keep their extension."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_.\- ]+", "_"), r"\s+", "_")
    base = F.btrim(base, F.lit("._"))
    base = F.when(base == "", "file").otherwise(base)
    suffix = F.regexp_extract(base, r"(\.[^.]{1,12})$", 1)
    return F.when(F.length(base) <= most, base).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(most) - F.length(suffix)), suffix))


def safe_id(name: Column) -> Column:
    """Lower-case letters, digits and single hyphens."""
    slug = F.btrim(F.regexp_replace(fold(name), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "language").otherwise(slug)


def path_get(json: Column, path: str) -> Column:
    """What a dotted path such as a.b[].c names in a JSON text, as JSON; [] goes over a list."""
    return F.get_json_object(json, "$." + path.replace("[]", "[*]"))


def safe_text(data: Column) -> Column:
    """Bytes as text that any encoder takes: what is no UTF-8, a lone surrogate for one, becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def display_value(value_json: Column) -> Column:
    """A value of a profile for people: a dash for nothing, lists with commas, objects by what they hold, true and false as words."""

    def item(x: Column) -> Column:
        one = lambda k: F.nullif(F.get_json_object(x, f"$.{k}"), F.lit(""))
        extra = lambda *keys: F.concat_ws(", ", *map(one, keys))
        noted = lambda main, note: F.when(note == "", main).otherwise(F.concat(main, F.lit(" ("), note, F.lit(")")))
        approximate = F.when(one("approximate") == "true", " (approx.)").otherwise("")
        shown = (
            F.when(one("state").isNotNull(), noted(one("state"), extra("detail")))
            .when(one("name").isNotNull(), noted(one("name"), extra("type", "region", "country", "role")))
            .when(one("value").isNotNull(), noted(F.concat(one("value"), approximate), extra("type", "detail", "code")))
            .when(one("min").isNotNull() & one("max").isNotNull(), F.concat(one("min"), F.lit("–"), one("max")))
            .when(one("title").isNotNull() | one("kind").isNotNull(), F.concat_ws(" · ", *map(one, ("kind", "title", "date", "organisation", "url"))))
        )
        entries = F.filter(F.map_entries(F.from_json(x, "map<string,string>")), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]", "{}"))
        rest = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
        plain = F.when(x == "true", "yes").when(x == "false", "no").otherwise(F.btrim(x, F.lit('"')))
        return F.when(x.startswith("{"), F.coalesce(shown, rest)).otherwise(plain)

    listed = F.when(value_json.startswith("["), F.from_json(value_json, "array<string>")).otherwise(F.array(value_json))
    nothing = value_json.isNull() | F.btrim(value_json).isin("null", "[]", "{}")
    return F.when(nothing, "—").otherwise(F.array_join(F.transform(listed, item), ", "))


def clean_name(name: Column) -> Column:
    """A name without footnote marks, a gloss in brackets at its end, and marks around."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\[\d+\]", ""), r"\s*\([^)]*\)\s*$", "")
    return F.btrim(bare, F.lit(" .,;:"))


def human_bytes(n: Column) -> Column:
    """Sizes for people. Shares of powers of two are exact, so a half goes to the even digit, as printf does elsewhere; Java's takes it up."""
    tenth = lambda unit, power: F.format_string(f"%.1f {unit}", F.bround(n / float(power), 1))
    out = None
    for power, unit in ((1, "B"), (1024, "KB"), (1024**2, "MB"), (1024**3, "GB"), (1024**4, "TB")):
        shown = F.format_string("%d B", n.cast("long")) if power == 1 else tenth(unit, power)
        out = F.when(n < power * 1024, shown) if out is None else out.when(n < power * 1024, shown)
    return out.otherwise(tenth("PB", 1024**5))


def human_rate(bytes_a_second: Column) -> Column:
    """Bytes a second for people; a dash if nothing is known or nothing moves."""
    return F.when(F.coalesce(bytes_a_second, F.lit(0.0)) == 0, "—").otherwise(F.concat(human_bytes(bytes_a_second), F.lit("/s")))


def human_time(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
