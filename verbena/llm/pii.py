"""Personal data: patterns that always count, and candidates that boosted trees choose from.

Base spans come from four patterns and their checks. Generators of high recall propose more spans, overlapping each other and the
base ones: obscured addresses, numbers written without a country code, with dots, or failing a check, account and identity numbers,
keys, tokens and passwords. Boosted trees score each by its format and by the words around it; a logistic curve for each kind turns the
score into a probability, and those above their kind's threshold count. Of these, those that overlap become one span from the least start to the greatest
end, so that no part of a value stays; it is added where it overlaps no base span, and a secret also where it holds base spans whole.
No candidate has an upper length: a value ends where its run, its quotes or its line end.

No table labels personal data, so the trees are fitted on invented sentences (EXAMPLES of them, drawn with a fixed seed), whose
features the same expressions work out that score the corpus: half of them fit the trees, half the curves and thresholds. Half of all are
no personal data but look like it: hashes, runs of base64, versions, dates, ISBNs, order numbers.

Style: native. Each row is worked on alone by column expressions; nothing is shuffled. Possessive quantifiers and a look-behind keep
the patterns linear in the text and without recursion; they match what the plain ones match.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit, least_threshold, platt
from .common import let

#: Kinds with base patterns, and all kinds: an account number, an identity number, and a key, token or password.
KINDS = ("email", "ip", "card", "phone")
EVERY_KIND = (*KINDS, "iban", "id", "secret")
#: The base patterns, possessive; a match starts where a run of its first characters does, or where the last one ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAMED = r"(?i)(?<=(?:password|passwd|pwd|secret|token|key)[\"']{0,1}\s{0,2}[:=]\s{0,2}"
#: Candidates: kind, what a text must have to be searched, pattern. Each ends where its value ends, never at a length: a run of
#: unbounded length starts where its first character does, so that patterns stay linear.
GENERATORS = (
    ("email", r"@|[(\[{] ?at ?[)\]}]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[{] ?at ?[)\]}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]{2,}+)++"),
    ("email", r" at [^ ]+ dot ", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]{2,}+)++"),
    ("ip", r"[0-9]", r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:[\[(]?\.[\])]?[0-9]{1,3}+){3}+(?![0-9A-Za-z])"),
    ("ip", r":", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+|(?=[0-9A-Fa-f:]{0,38}::)[0-9A-Fa-f]{0,4}+(?:::?[0-9A-Fa-f]{1,4}+){1,7}+)(?![0-9A-Za-z:])"),
    ("card", r"[0-9]", r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}+(?![0-9])"),
    ("phone", r"[0-9]", r"(?<![0-9A-Za-z.,+-])\(?[0-9][0-9 ()./-]{5,20}[0-9](?![0-9A-Za-z])"),
    ("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("id", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("secret", r"[A-Za-z0-9+/_-]{16}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    ("secret", r"eyJ", r"(?<![A-Za-z0-9+/_=-])eyJ[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)++"),
    ("secret", r"(?i)(?:passw|pwd|secret|token|key)[a-z]{0,4}[\"']? ?[:=]", _NAMED + r")[^\s\"',;]{5,}[^\s\"',;.)\]}>]"),
    ("secret", r"(?i)(?:passw|pwd|secret|token|key)[a-z]{0,4}[\"']? ?[:=]\s{0,2}\"", _NAMED + r"\")[^\"\n]{6,}+(?=\")"),
    ("secret", r"(?i)(?:passw|pwd|secret|token|key)[a-z]{0,4}[\"']? ?[:=]\s{0,2}'", _NAMED + r"')[^'\n]{6,}+(?=')"),
    ("secret", r"://[^/\s]*@", r"(?<=://)[^\s/@:]++:[^\s/@]++(?=@)"),
    ("secret", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-----BEGIN (?:[A-Z0-9]+ )*+PRIVATE KEY-----(?:[^-]++|-(?!----))*+-----END (?:[A-Z0-9]+ )*+PRIVATE KEY-----"),
)
EXAMPLES = 8000
PRECISION = 0.97
CONTEXT = 40

_CANDIDATE = "array<struct<kind:int,start:bigint,end:bigint,match:string,before:string,after:string>>"


def _running(steps: Column) -> Column:
    """The sum before each element; in pieces, so that a text with very many matches takes no quadratic time."""
    piece = 256

    def sums(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]

    def over(pieces: Column) -> Column:
        offsets = sums(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)))
        return F.flatten(F.zip_with(pieces, offsets, lambda p, o: F.transform(sums(p), lambda x: x + o)))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / piece).cast("int")), lambda c: F.slice(steps, c * piece + 1, piece))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(cut, over))


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches, leftmost first, not overlapping: kind, start and end in code points, the match, and what is around it."""
    number = EVERY_KIND.index(kind)

    def build(v: Column) -> Column:
        return F.zip_with(
            v["m"], F.zip_with(F.slice(v["g"], 1, F.size(v["m"])), F.slice(v["g"], 2, F.size(v["m"])), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda m, g: F.struct(m.alias("m"), g["a"].alias("a"), g["b"].alias("b")),
        )

    def place(v: Column) -> Column:
        steps = F.transform(v, lambda x: (F.length(x["m"]) + F.length(x["a"])).cast("long"))

        def one(x: Column, at: Column) -> Column:
            start = at + F.length(x["a"])
            return F.struct(
                F.lit(number).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("match"),
                F.substring(x["a"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["b"], 1, CONTEXT).alias("after"),
            )

        return F.zip_with(v, let(steps, _running), one)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(let(found, build), place).cast(_CANDIDATE)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def total(r: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            d = F.substring(r, i, F.lit(1)).cast("int")
            double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return a + F.when(i % 2 == 0, double).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), step)

    return let(F.reverse(digits), total) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~c["match"].rlike(r"(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,})(?:\.|$)")
    if kind == "card":
        return let(_digits(c["match"]), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.length(_digits(c["match"])).between(9, 15)


def base_spans(text: Column) -> Column:
    """The base spans, by kind, then start."""
    none = F.array().cast(_CANDIDATE)
    need = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -][0-9]")}
    return F.concat(*(_kept(k, text, need[k], none) for k in KINDS))


def _kept(kind: str, text: Column, needed: Column, none: Column) -> Column:
    return F.when(needed, F.filter(matches(text, kind, BASE[kind]), lambda c: _valid(kind, c))).otherwise(none)


def candidates(text: Column) -> Column:
    none = F.array().cast(_CANDIDATE)
    return F.concat(*(F.when(text.rlike(need), matches(text, kind, pattern)).otherwise(none) for kind, need, pattern in GENERATORS))


#: Words that hint at each kind before a candidate, and words that hint at none.
HINTS = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write|address)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
    "ip": r"(?i)(?:\bip|host|server|address|login|from|ping|gateway)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|(?:my|his|her|our|their) number|reach (?:me|us)|ring|t[eé]l[eé]fono?|whatsapp|sms)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bank|transfer|wire)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
    "id": r"(?i)(?:ssn|social|security|identity|passport|national|tax|insurance)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|key|auth|bearer|credentials?)[^A-Za-z0-9]*(?:is[^A-Za-z0-9]*)?$",
    "digest": r"(?i)(?:sha-?[0-9]*|md5|hash|commit|checksum|digest|etag|uuid|revision|blob|data)[^A-Za-z0-9]*(?:is[^A-Za-z0-9]*)?$",
    "other": r"(?i)(?:order|invoice|isbn|version|build|page|total|id|serial|ref|section|chapter|model|sku|ticket)[^A-Za-z0-9]*(?:[a-z]+[^A-Za-z0-9]*)?$",
}


def mod_97(m: Column) -> Column:
    """Whether an account number passes the check of ISO 7064."""

    def rest(s: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            return F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97

        return F.aggregate(F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)).cast("int"))

    return let(F.regexp_replace(m, "[^0-9A-Z]", ""), rest) == 1


def features(c: Column) -> list[Column]:
    """Format and context of a candidate as numbers."""
    m, before, after = c["match"], c["before"], c["after"]
    digits = _digits(m)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    count = lambda unlike: F.length(F.regexp_replace(m, unlike, "")).cast("double")
    return [
        c["kind"].cast("double"),
        F.length(digits).cast("double"),
        F.length(m).cast("double"),
        count(r"[^ ()./-]"),
        F.size(F.split(m, "[^0-9]+")).cast("double"),
        flag(F.length(digits).between(13, 19) & luhn(digits)),
        flag(m.startswith("(")),
        count("[^:]"),
        flag(m.rlike(r"(?i)[(\[{] ?at")),
        flag(m.rlike(r"(?i)[(\[{] ?dot|[\[(]\.")),
        flag(m.rlike(r"^(?:19|20)[0-9]{2}\b")),
        flag(m.rlike(r"(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?:\.|$)")),
        *(flag(before.rlike(h)) for h in HINTS.values()),
        flag(before.rlike(r"[A-Za-z0-9]$")),
        flag(after.rlike(r"^[A-Za-z0-9%]")),
        flag(m.rlike(r" @|@ ")),
        flag((c["kind"] == EVERY_KIND.index("iban")) & mod_97(m)),
        count("[^A-Z]"),
        count("[^a-z]"),
        F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        flag(m.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(m.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        flag(m.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk[-_]|pk_live|AIza|eyJ|-----BEGIN)")),
        flag(before.rlike(r"[:=] ?[\"']?$")),
        flag(before.rlike("://$")),
        flag(m.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")),
        flag(F.contains(m, F.lit("::"))),
        flag(before.rlike(r"(?i)(?:passw(?:or)?d|pwd|secret)[\"']?\s*[:=]\s*[\"']?$")),
        flag(m.rlike("[G-Zg-z]")),
        count("[^ ]"),
        flag(m.rlike(r"^[^ ]+ at ")),
        flag(m.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|ch|at|eu)$")),
        count(r"[A-Za-z0-9 +/_=.-]"),
    ]


_HEX, _LOW, _UP, _BASE64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _example(r: random.Random) -> tuple[str, int, str]:
    """A sentence with one thing in it that a generator finds: its text, whether it is personal, and the kind."""
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    digits = lambda n: some("0123456789", n)
    word = lambda: r.choice("the of and with from on we they he she said then after before house river green order under".split())
    name = lambda: r.choice("anna li omar jean kim paul eva".split()) + r.choice(["", ".", "_"]) + r.choice("smith wu roy diaz kurz".split()) + r.choice(["", digits(2)])
    host = lambda: r.choice("mail example uni-town corp shop".split()) + r.choice(["", digits(1)])
    tld = r.choice("com org net de fr es edu".split())
    kind, good = r.choice(EVERY_KIND), r.random() < 0.5
    hint = {
        "email": "email mail contact write to", "ip": "ip host server address", "card": "card visa credit card", "phone": "phone,tel,call,mobile,fax,my number,reach me at,ring",
        "iban": "iban account konto bank transfer", "id": "ssn social security identity passport", "secret": "token secret password pwd api_key auth bearer",
    }[kind]
    hint = r.choice(hint.split("," if "," in hint else None)) + r.choice([": ", " ", " is ", " number "])
    other = r.choice("order invoice isbn version page total id serial ref section model ticket".split()) + r.choice([" ", ": ", " number ", " no. "])
    plain = word() + " "
    if kind == "email":
        thing = f"{name()}{r.choice([' (at) ', '(at)', ' [at] ', '[at]', '{at}'])}{host()}{r.choice(['.', ' (dot) ', '[dot]', ' [dot] '])}{tld}" if good else f"{word()}{r.choice([' @ ', '@ ', ' @'])}{word()}{r.choice(['. ', '.'])}{word()}"
        lead = r.choice([hint, plain]) if good else plain
        if r.random() < 0.25:
            lead = hint if good else plain
            thing = f"{name()} at {host()} dot {tld}" if good else f"{r.choice([word(), 'look', 'arrive'])} at {r.choice([word(), 'this'])} dot {r.choice([word(), 'com', 'net'])}"
    elif kind == "ip":
        octets = lambda most: [str(r.randrange(r.choice([10, 100, most]))) for _ in range(4)]
        if good:
            groups = [f"{r.randrange(r.choice([2, 16, 65536])):x}" for _ in range(8)]
            groups[0] = r.choice(["fe80", "2001", "fd00", groups[0]])
            at = r.randrange(1, 6)
            thing = r.choice(["[.]".join(octets(256)), "(.)".join(octets(256)), ":".join(groups), ":".join(groups[:at]) + "::" + ":".join(groups[at + 1 + r.randrange(0, 6 - at) :])])
            lead = r.choice([hint, plain])
        else:
            code = f"{r.choice(['std', 'map', 'fade', 'abc', 'face'])}::{r.choice(['add', 'abc', 'be', 'dead'])}"
            thing = r.choice([".".join([str(r.randrange(256, 999)), *octets(256)[1:]]), ":".join(f"{r.randrange(10, 60)}" for _ in range(r.randrange(4, 6))), code])
            lead = r.choice([other, plain])
    elif kind == "card":
        d = digits(r.choice([13, 15, 16, 16, 16]))
        passes = sum(2 * int(x) - 9 * (int(x) > 4) if i % 2 else int(x) for i, x in enumerate(d[::-1])) % 10 == 0
        thing = r.choice([d, ".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4))])
        lead = hint if good else r.choice([other, plain, plain])
        good = lead == hint or (passes and lead == plain)
    elif kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        if good:
            thing, lead = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a}/{b}{c}", f"0{a[:2]}/{b}{c}", f"{a}.{b}.{c}", f"0{a[:2]} {b[:2]} {c[:2]} {c[2:]} {b[1:]}"]), hint
        else:
            thing = r.choice([f"20{a[:2]}-0{b[0]}-{c[:2]} {c[2:]}", f"{a} {b} {c}", f"{a}.{b}{c}", digits(r.randrange(7, 13)), f"{a}-{c}-{b}", f"19{a[:2]}-20{b[:2]}", f"978-{a}-{c}-{b[0]}"])
            lead = r.choice([other, plain, plain])
    elif kind == "iban":
        country, bban = r.choice("DE FR ES GB NL CH IT".split()), r.choice([digits(18), some(_UP, 4) + digits(14), digits(20)])
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        check = 98 - value(bban + country + "00") % 97
        if not good:
            country, check, bban = r.choice([(some(_UP, 2), check + 1 if check < 98 else 2, bban), (some(_UP, 2), int(digits(2)) or 7, some(_UP + "0123456789", 16))])
        thing = f"{country}{check:02d}{bban}"
        good = value(bban + country + f"{check:02d}") % 97 == 1
        thing = r.choice([thing, " ".join(thing[i : i + 4] for i in range(0, len(thing), 4))])
        lead = r.choice([hint, plain]) if good else r.choice([other, plain])
    elif kind == "id":
        thing = f"{r.randrange(1, 899):03d}-{r.randrange(1, 99):02d}-{r.randrange(1, 9999):04d}" if good or r.random() < 0.5 else f"{r.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"
        lead = hint if good else r.choice([other, other, "part ", "code "])
    else:
        opened = r.choice([' = "', "=", ": ", ' "', " ", " = ", ":'"])
        key = r.choice([some(_HEX, r.choice([32, 40, 64])), some(_LOW + _UP + "0123456789", r.randrange(18, 50)), "AKIA" + some(_UP + "0123456789", 16), "ghp_" + some(_LOW + _UP + "0123456789", 36), "sk-" + some(_LOW + _UP + "0123456789", 40), some(_BASE64 if r.random() < 0.5 else _LOW + _UP + "0123456789", r.choice([70, 120, 300, 600])) + r.choice(["", "=", "=="])])
        if good:
            url = r.random() < 0.1
            famous = key.startswith(("AKIA", "ghp_", "sk-"))
            thing = f"{name()}:{some(_LOW + '0123456789', 9)}" if url else r.choice([key, key, some(_LOW + "0123456789!#", r.randrange(8, 14)), some(_LOW + _UP + "0123456789!#$%&()*+-./<>?@[]^_{|}~", r.choice([9, 20, 60, 130, 300]))])
            lead = "https://" if url else r.choice("token secret password pwd api_key access_key auth_token".split()) + (opened if thing == key else r.choice([": ", "=", ' = "']))
            if famous and thing == key and r.random() < 0.6:
                lead = plain
            if r.random() < 0.1 and not url:
                part = lambda n: some(_LOW + _UP + "0123456789_-", n)
                thing, lead = f"eyJ{part(r.choice([20, 100, 400]))}.{part(r.choice([30, 200, 600]))}.{part(43)}", r.choice(["bearer ", "token: ", plain])
            elif r.random() < 0.1 and not url:
                thing, lead = "eyJ" + some(_LOW + _UP + "0123456789_-", r.choice([40, 150, 500])), "bearer "
            elif r.random() < 0.1 and not url:
                quote = r.choice(["'", '"'])
                thing = " ".join(some(_LOW, r.randrange(4, 9)) for _ in range(r.randrange(3, 6)))
                lead = r.choice(["password", "passwd", "pwd", "secret"]) + r.choice([" = ", ": ", "="]) + quote
                return " ".join(word() for _ in range(5)) + " " + lead + thing + quote + " " + word(), 1, kind
            if url:
                thing, tail = thing, "@host.example/path"
                return " ".join(word() for _ in range(5)) + " " + lead + thing + tail, 1, kind
        else:
            thing = r.choice([some(_HEX, r.choice([32, 40, 64])), "-".join(some(_HEX, n) for n in (8, 4, 4, 4, 12)), some(_BASE64, 40) + " " + some(_BASE64, 40), some(_BASE64, r.choice([80, 200, 500])), f"{word()}-{word()}-{digits(4)}-{word()}-{word()}", f"{word()}/{word()}/{digits(4)}/{digits(2)}/{word()}", f"{word()}_{word()}_{word()}_{digits(3)}"])
            if r.random() < 0.15:
                return " ".join(word() for _ in range(5)) + r.choice([" key: ", " the key = ", " token: "]) + '"' + " ".join(word() for _ in range(r.randrange(4, 12))) + '" ' + word(), 0, kind
            lead = r.choice([r.choice("commit sha256 md5 hash checksum uuid etag data".split()) + opened, plain, other])
    text = " ".join(word() for _ in range(r.randrange(3, 9))) + " " + lead + thing + r.choice([" ", ". ", ", ", '" ']) + " ".join(word() for _ in range(r.randrange(3, 9)))
    return text, int(good), kind


class Detector:
    """Trees, and for each kind a curve and the least probability that counts."""

    def __init__(self, model: Boosted, curves: list[tuple[float, float]], limits: list[float], accuracy: float):
        self.model, self.curves, self.limits, self.accuracy = model, curves, limits, accuracy

    def chance(self, c: Column) -> Column:
        """The probability that a candidate is personal, from an array of its features; the first of them is its kind."""

        def curve(f: Column) -> Column:
            a, b = (F.get(F.array(*(F.lit(float(x[i])) for x in self.curves)), f[0].cast("int")) for i in (0, 1))
            return 1.0 / (1.0 + F.exp(-(a * self.model.column(f) + b)))

        return let(F.array(*features(c)), curve)


def trained(spark: SparkSession, examples: int = EXAMPLES, seed: int = 11) -> Detector:
    """The detector; its accuracy is that of the trees on the half of the examples that set the curves and thresholds."""
    r = random.Random(seed)
    made = [_example(r) for _ in range(examples)]
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(made)], "i int, text string").repartition(2)
    found = d.select("i", F.explode(candidates(F.col("text"))).alias("c"))
    rows = found.select("i", "c.kind", F.array(*features(F.col("c"))).alias("x")).collect()
    rows = [(q.x, made[q.i][1] and made[q.i][2] == EVERY_KIND[q.kind], q.i, q.kind) for q in sorted(rows, key=lambda q: (q.i, q.kind, q.x))]
    x, y = np.array([q[0] for q in rows]), np.array([float(q[1]) for q in rows])
    half, kind = np.array([q[2] % 2 for q in rows]) == 0, np.array([q[3] for q in rows])
    model = fit(x[half], y[half])
    margin = model.margin(x)
    curves, limits = [], []
    for k in range(len(EVERY_KIND)):
        some = ~half & (kind == k)
        a, b = platt(margin[some], y[some])
        curves.append((a, b))
        limits.append(least_threshold(1 / (1 + np.exp(-(a * margin[some] + b))), y[some], PRECISION))
    return Detector(model, curves, limits, float(((margin[~half] >= 0) == y[~half]).mean()))


_detectors: dict[str, Detector] = {}


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and added for each row of docs: arrays of kind, start, end (code points, end exclusive) and match; added has a score.

    Null counts as empty: no spans. Rows are judged each alone, whatever their key, so repeated ones are alike; an empty table stays empty; texts may be of
    any length. Likely candidates that overlap are one span, with the kind and score of the likeliest (of equally likely ones the first). Other columns are left
    out, whatever their names.
    """
    app = docs.sparkSession.sparkContext.applicationId
    detector = _detectors[app] = _detectors.get(app) or trained(docs.sparkSession)
    limit = F.create_map(*(F.lit(v) for i, x in enumerate(detector.limits) for v in (i, x)))
    names = F.array(*map(F.lit, EVERY_KIND))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("k", "t", base_spans(F.col("t")).alias("base"), candidates(F.col("t")).alias("c"))
    secret = EVERY_KIND.index("secret")
    meets = lambda c, b: (c["start"] < b["end"]) & (b["start"] < c["end"])
    holds = lambda c, b: (c["kind"] == secret) & (c["start"] <= b["start"]) & (b["end"] <= c["end"]) & (c["end"] - c["start"] > b["end"] - b["start"])
    apart = F.filter("c", lambda c: ~F.exists("base", lambda b: meets(c, b) & ~holds(c, b)))
    scored = F.transform(apart, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), (-detector.chance(c)).alias("minus"), c["kind"].alias("kind")))
    rows = rows.select("k", "t", "base", F.when(F.size("c") > 0, scored).alias("scored"))
    chosen = F.array_sort(F.filter("scored", lambda c: -c["minus"] >= limit[c["kind"]]))
    shape = "struct<start:bigint,end:bigint,minus:double,kind:int>"
    none = F.lit(None).cast(shape)
    start = F.struct(none.alias("last"), F.array().cast(f"array<{shape}>").alias("out"))

    def union(s: Column, c: Column) -> Column:
        last = s["last"]
        likelier = c["minus"] < last["minus"]
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], c["end"]).alias("end"), F.least(last["minus"], c["minus"]).alias("minus"), F.when(likelier, c["kind"]).otherwise(last["kind"]).alias("kind"))
        begun = F.struct(c.alias("last"), F.when(last.isNull(), s["out"]).otherwise(F.array_append(s["out"], last)).alias("out"))
        return F.when(c["start"] < last["end"], F.struct(wider.alias("last"), s["out"].alias("out"))).otherwise(begun)

    joined = F.aggregate(chosen, start, union, lambda s: F.when(s["last"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["last"])))
    kind = lambda c: F.get(names, c["kind"]).alias("kind")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>")
    match = lambda c: F.substring(F.col("t"), (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int"))
    added = F.transform(joined, lambda c: F.struct(kind(c), c["start"].alias("start"), c["end"].alias("end"), match(c).alias("match"), (-c["minus"]).alias("score")))
    base = F.transform("base", lambda c: F.struct(kind(c), c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match")))
    return rows.select(F.col("k").alias(key), base.alias("base"), F.coalesce(added, empty).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end by kind as in EVERY_KIND, then start, comma-joined."""
    shown = lambda k: F.transform(F.array_sort(F.transform(F.filter(spans, lambda c: c["kind"] == k), lambda c: F.struct(c["start"], c["end"]))), lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(F.concat(*map(shown, EVERY_KIND)), ",")
