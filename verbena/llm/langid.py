"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed letter n-grams (one to three letters, borders of words included). Linear support vector machines,
one against the rest, choose its language family; within the family, one for each pair of languages, they vote for the language.

The model learns from a bounded sample: about `per_lang` labelled rows of each language, chosen by a hash of their key, and about `most_rows`
in all, so with many languages each gives fewer. What is not zero of these rows' vectors alone comes to the driver, where they
take 4 * DIMENSIONS bytes each; labels are counted first, and more than MOST_LANGS of them are refused. Prediction streams over all rows.

Style: free (mapInArrow; no shuffle but for counts of labels).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ship

DIMENSIONS = 4096
#: Labelled rows of each language to learn from, about, and of all languages; languages that a model may know.
PER_LANG, MOST_ROWS, MOST_LANGS = 400, 24_000, 2000
#: Rows whose margins are worked out at once.
TOGETHER = 256
SEGMENT = 1 << 20
UNKNOWN = "und"

#: Families of languages by code, of two letters and of three. A language whose code is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi afr dan deu dut eng fry ger gsw ice isl ltz nds nld nno nob nor swe yid",
    "romance": "ca es fr gl it la oc pt ro ast cat fra fre glg ita lat oci por ron rum scn spa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk bel bos bul ces cze hrv mac mkd pol rus slk slo slv srp ukr",
    "baltic": "lt lv lav lit",
    "celtic": "br cy ga gd bre cym gla gle wel",
    "indo-aryan": "bn gu hi mr ne pa sd si ur asm ben bho guj hin mai mar nep npi ori ory pan sin snd urd",
    "iranian": "fa ku ps tg ckb fas kmr kur per pes prs pus tgk",
    "dravidian": "kn ml ta te kan mal tam tel",
    "turkic": "az kk ky tk tr tt ug uz aze kaz kir tat tuk tur uig uzb",
    "uralic": "et fi hu se est fin hun sme",
    "semitic": "am ar he mt amh ara arb arz heb mlt tir",
    "malayo-polynesian": "id jv mg ms su tl ceb ilo ind jav mlg may msa sun tgl zsm",
    "sinitic": "zh chi cmn hak nan wuu yue zho",
    "bantu": "rw sn sw xh zu kin lin nya run sna swa swh xho zul",
}


def family(lang: str) -> str:
    """The family of a code or of a tag that starts with one, such as en-US or zh_Hans."""
    base = re.split("[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), base)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def vector(text: str) -> np.ndarray | None:
    """The text's n-grams as counts, hashed to DIMENSIONS; None if it has no letter. Long texts are worked on in segments."""
    table, total, some = _letters(), np.zeros(DIMENSIONS), False
    for at in range(0, max(1, len(text)), SEGMENT):
        piece = text[max(0, at - 1) : at + SEGMENT].lower()
        codes = np.frombuffer(f" {piece} ".encode("utf-32-le", "replace"), "<u4")
        letter = table[codes]
        if not letter.any():
            continue
        some = True
        c = np.where(letter, codes, np.uint32(32)) * np.uint32(0x9E3779B1)
        one, two = c[letter], (c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:])[letter[:-1] | letter[1:]]
        three = (c[:-2] * np.uint32(0xC2B2AE35) ^ c[1:-1] * np.uint32(0x27D4EB2F) ^ c[2:])[letter[1:-1]]
        for k, g in enumerate((one, two, three)):
            mixed = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            total += np.bincount(mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return total if some else None


def scaled(counts: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts)
    return v / np.sqrt(v @ v)


def with_offset(x: np.ndarray) -> np.ndarray:
    """Vectors with a one behind each."""
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights, the offset last, of a linear support vector machine with squared hinge loss over with_offset() vectors; both classes weigh the same."""
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - (ridge * ahead - 2 * x.T @ (share * y * slack)) / (4 + ridge)
        ahead = after + k / (k + 3) * (after - w)
        w = after
    return w


@dataclass
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    by_family: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """The language of each of some scaled vectors, and how sure the machines are, from 0 to 1. Of equal margins the first family, of equal votes
        and trust the first language by name counts."""
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(x)
        x = with_offset(x)
        margins = x @ self.by_family.T if len(self.families) > 1 else np.full((len(x), 1), np.inf)
        best = margins.argmax(axis=1)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(x)
        for f in np.unique(best).tolist():
            langs, rows = self.members[self.families[f]], np.flatnonzero(best == f)
            sure = _chance(margins[rows, f])
            votes, trust = np.zeros((2, len(rows), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                m = x[rows] @ self.pairs[a, b]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                trust[:, i] += _chance(m)
                trust[:, j] += _chance(-m)
            for k, row in enumerate(rows.tolist()):
                i = max(range(len(langs)), key=lambda c: (votes[k, c], trust[k, c], -c))
                out[row] = langs[i], float(sure[k] * (trust[k, i] / (len(langs) - 1) if len(langs) > 1 else 1.0))
        return out


def _chance(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(margins, -30, 30).astype(float)))


def fit_languages(x: np.ndarray, langs: list[str]) -> LanguageModel:
    x, labels = with_offset(x), np.array(langs, dtype=object)
    known = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for k in known:
        members.setdefault(family(k), []).append(k)
    families = sorted(members)
    of = np.array([family(k) for k in langs], dtype=object)
    by_family = np.array([svm(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((1, DIMENSIONS + 1))
    pairs = {}
    for group in members.values():
        for a, b in combinations(group, 2):
            some = (labels == a) | (labels == b)
            pairs[a, b] = svm(x[some], np.where(labels[some] == a, 1.0, -1.0))
    return LanguageModel(families, members, by_family, pairs)


def train_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, most_rows: int = MOST_ROWS) -> LanguageModel:
    """Learn from the rows of docs with a text and a label. Rows without a letter teach nothing; no rows give a model that knows no language. Null keys
    and repeated rows are rows like others; columns may have any names."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.length(text)).alias("h"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"at most {MOST_LANGS} languages")
    per_lang = min(per_lang, most_rows // max(1, len(counts)))
    if not counts:
        return LanguageModel([], {}, np.zeros((1, DIMENSIONS + 1)), {})
    share = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_lang / n))))
    some = labelled.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [vector(x.as_py()) for x in b.column(1)]
            good = [i for i, v in enumerate(vectors) if v is not None]
            places = [np.flatnonzero(vectors[i]).astype("<u2") for i in good]
            values = [scaled(vectors[i])[at].astype("<f4") for i, at in zip(good, places, strict=True)]
            kept = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(2).take(kept), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], names=["lang", "h", "p", "v"])

    rows = some.mapInArrow(run, "lang string, h long, p binary, v binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["h"], bytes(r["p"]), bytes(r["v"])))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["p"], "<u2")] = np.frombuffer(r["v"], "<f4")
    return fit_languages(x, [r["lang"] for r in rows])


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for each row of docs, from its text alone: "und" and 0 where it is null or has no letter.

    Rows alike get alike predictions, null keys and repeated rows included. Texts may be of any length; an empty table gives an empty result. Other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * b.num_rows
            for at in range(0, b.num_rows, TOGETHER):
                vectors = {at + i: vector(x.as_py() or "") for i, x in enumerate(b.column(1).slice(at, TOGETHER))}
                known = [i for i, v in vectors.items() if v is not None]
                if known:
                    for i, found in zip(known, model.predict(np.array([scaled(vectors[i]) for i in known], np.float32)), strict=True):
                        out[i] = found
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[key, "lang_pred", "score"])

    narrow = docs.select(F.col(key), F.col(text).alias(free_name(docs.select(key), "body")))
    return narrow.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
