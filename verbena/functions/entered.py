"""What people type into a profile's fields, as JSON values, by kind of field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that mean yes, no and unknown, and states.
YES = ("y", "yes", "true", "available", "exist", "exists")
NO = ("n", "no", "none", "false", "not available")
UNKNOWN = ("unknown", "?", "unsure", "dont know", "don't know", "not sure")
STATES = ("yes", "no", "unknown", "limited", "reported", "historical")


def entries(text: Column) -> Column:
    """Parts between commas, semicolons or line ends, without blanks around; empty ones go."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,\n]"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def speakers(text: Column) -> Column:
    """8500 as a number, ~8500 as an approximate one, 8000-9000 as a range, anything else as text."""
    t = F.btrim(F.replace(text, F.lit(","), F.lit("")))
    near, low, high = F.regexp_extract(t, r"^~\s*(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\s*[-–]\s*(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\s*[-–]\s*(\d+)$", 2)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
        .when(near != "", F.to_json(F.struct(near.try_cast("long").alias("value"), F.lit(True).alias("approximate"))))
        .when(low != "", F.to_json(F.struct(low.try_cast("long").alias("min"), high.try_cast("long").alias("max"))))
        .when(t.rlike(r"^\d+$"), t.try_cast("long").cast("string"))
        .otherwise(F.to_json(F.struct(text.alias("text"))))
    )


def state(text: Column) -> Column:
    """A state, with what is said after it; other answers are reports."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    word = F.btrim(F.lower(F.regexp_extract(t, r"^(\S*)", 1)), F.lit(":,-"))
    rest = F.nullif(F.btrim(F.regexp_extract(t, r"^\S*\s(.*)$", 1), F.lit(" :-")), F.lit(""))
    made = lambda s, d: F.to_json(F.struct(s.alias("state"), d.alias("detail")))
    low, nothing = F.lower(t), F.lit(None).cast("string")
    return (
        F.when(t == "", nothing).when(word.isin(*STATES), made(word, rest)).when(low.isin(*YES), made(F.lit("yes"), nothing)).when(low.isin(*NO), made(F.lit("no"), nothing))
        .when(low.isin(*UNKNOWN), made(F.lit("unknown"), nothing)).otherwise(made(F.lit("reported"), t))
    )


def choice(text: Column, suggested: tuple[str, ...]) -> Column:
    """One of the suggestions by number or name, else the text."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    options = F.array(*map(F.lit, suggested))
    number = F.try_element_at(options, F.when(t.rlike(r"^[0-9]{1,4}$") & (t != "0"), t.cast("int")).otherwise(F.lit(len(suggested) + 1)))
    named = F.get(F.filter(options, lambda o: F.lower(o) == F.replace(F.lower(t), F.lit(" "), F.lit("_"))), F.lit(0))
    return F.when(t != "", F.coalesce(number, named, t))


def tagged(text: Column) -> Column:
    """Names with a role in parentheses or after a colon, as a JSON list."""
    pattern = r"^(.*?)\s*(?:\((.*?)\)|:\s*(.*))$"

    def one(x: Column) -> Column:
        role = F.concat(F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 3))
        has = role != ""
        return F.struct(F.when(has, F.btrim(F.regexp_extract(x, pattern, 1))).otherwise(x).alias("name"), F.when(has, F.btrim(role)).alias("role"))

    items = F.transform(entries(text), one)
    return F.when(F.size(items) > 0, F.to_json(items))


def places(text: Column) -> Column:
    """A place a line: name, type, region, country, as a JSON list."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.btrim(x) != "")
    part = lambda x, i: F.nullif(F.btrim(F.get(F.split(x, ","), F.lit(i))), F.lit(""))
    items = F.transform(lines, lambda x: F.struct(F.btrim(F.get(F.split(x, ","), F.lit(0))).alias("name"), part(x, 1).alias("type"), part(x, 2).alias("region"), part(x, 3).alias("country")))
    return F.when(F.size(items) > 0, F.to_json(items))
