"""Language identification: held-out accuracy, the hierarchy, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from verbena.llm import langid
from verbena.llm.langid import UNKNOWN, family, predict_languages, scaled, train_languages, vector

WORDS = {
    "en": "the and of that with house water through strong night which would they thing",
    "de": "der und die mit haus wasser durch stark nacht welche würde straße schön nicht",
    "fr": "le et de que avec maison eau à travers fort nuit quelle était château où",
    "es": "el y de que con casa agua por fuerte noche cual sería niño corazón ción",
    "xx": "qaq zuz vov kik jyj",
}


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randrange(4, 40))), lang))
    return out


def test_held_out_accuracy_and_families(spark):
    data = rows(600)
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    held = {k for k, _, _ in data if zlib.crc32(str(k).encode()) % 3 == 1}
    model = train_languages(d.where(~d.doc_id.isin(list(held))))
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    got = {x.doc_id: x for x in predict_languages(d, model).collect()}
    right = [got[k].lang_pred == lang for k, _, lang in data if k in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())
    assert family("pt") == "romance" and family("zz") == "zz"


def test_odd_rows(spark):
    d = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    model = train_languages(d)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (None, "der und die"), (5, "x"), (5, "x"), (6, "日本語"), (7, "the night " * 200_000)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.lang_pred) for x in predict_languages(odd, model).collect())
    assert got[:3] == [("1", UNKNOWN), ("2", UNKNOWN), ("3", UNKNOWN)] and ("7", "en") in got and ("None", "de") in got
    assert len({x for x in got if x[0] == "5"}) == 1 and UNKNOWN not in {x[1] for x in got[3:]}
    none = train_languages(d.limit(0))
    assert {x.lang_pred for x in predict_languages(odd, none).collect()} == {UNKNOWN}
    assert predict_languages(d.limit(0), model).count() == 0
    one = train_languages(d.where("lang = 'fr'"))
    assert {x.lang_pred for x in predict_languages(d, one).collect()} == {"fr"}


def test_vectors_of_long_texts_are_whole(monkeypatch):
    text = "abc défg hij " * 50
    whole = vector(text)
    monkeypatch.setattr("verbena.llm.langid.SEGMENT", 64)
    assert abs(vector(text).sum() - whole.sum()) < 0.1 * whole.sum()
    assert vector("1 2") is None


def plain_svm(x, y):
    """Squared hinge loss and ridge by plain descent, without momentum, until it rests."""
    share = [0.5 / (y > 0).sum() if v > 0 else 0.5 / (y < 0).sum() for v in y]
    w = np.zeros(x.shape[1])
    for _ in range(6000):
        step = 1e-3 * w
        for v, label, part in zip(x, y, share, strict=True):
            slack = 1 - label * (v @ w)
            if slack > 0:
                step = step - 2 * part * label * slack * v
        w = w - 0.25 * step
    return w


def test_model_and_predictions_equal_plain_ones(spark):
    data = [(i, t, lang) for i, t, lang in rows(36, seed=3)]
    d = spark.createDataFrame([(k, t, lang, "clash", 0) for k, t, lang in data], "doc_id long, text string, lang string, body string, score int")
    model = train_languages(d, per_lang=1000)
    x = np.array([[*scaled(vector(t)), 1.0] for _, t, _ in data])
    langs = np.array([lang for *_, lang in data])
    fam = np.array([family(k) for k in langs])
    by_family = {f: plain_svm(x, np.where(fam == f, 1.0, -1.0)) for f in model.families}
    pairs = {(a, b): plain_svm(x[(langs == a) | (langs == b)], np.where(langs[(langs == a) | (langs == b)] == a, 1.0, -1.0)) for a, b in model.pairs}
    for f, w in zip(model.families, model.by_family, strict=True):
        assert np.allclose(x @ w, x @ by_family[f], atol=0.05)
    asked = [(100 + i, t) for i, (_, t, _) in enumerate(rows(40, seed=4))] + [(7, data[0][1]), (7, data[0][1])]
    got = [(r.doc_id, r.lang_pred) for r in predict_languages(spark.createDataFrame([(k, t, "x") for k, t in asked], "doc_id long, text string, lang_pred string"), model).collect()]
    want = []
    for k, t in asked:
        v = np.array([*scaled(vector(t)), 1.0])
        f = max(model.families, key=lambda f: v @ by_family[f])
        members = model.members[f]
        votes = {m: sum((v @ pairs[a, b] > 0) == (m == a) for a, b in pairs if m in (a, b)) for m in members}
        want.append((k, max(members, key=lambda m: votes[m])))
    assert sorted(got) == sorted(want)


def test_bounds_of_what_is_learned(spark, monkeypatch):
    d = spark.createDataFrame(rows(300), "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit_languages
    monkeypatch.setattr(langid, "fit_languages", lambda x, langs: seen.append(x.shape) or fit(x, langs))
    train_languages(d, most_rows=50)
    assert seen[0][0] < 100
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        train_languages(d)


def test_ties_go_to_the_first():
    model = langid.LanguageModel(["a", "b"], {"a": ["a1", "a2"], "b": ["b1"]}, np.zeros((2, 3), np.float32), {("a1", "a2"): np.zeros(3, np.float32)})
    assert model.predict(np.ones((2, 2), np.float32)) == [("a2", 0.25), ("a2", 0.25)]


def test_codes_of_three_letters_and_tags_share_families(spark):
    assert [family(x) for x in ("eng", "deu", "en-US", "zh_Hans", "cmn", "pt-BR", "FRA", "spa", "qqx")] == ["germanic", "germanic", "germanic", "sinitic", "sinitic", "romance", "romance", "romance", "qqx"]
    tags = {"en": "eng", "de": "de-AT", "fr": "fra", "es": "spa", "xx": "qqx"}
    data = [(k, t, tags[lang]) for k, t, lang in rows(500, seed=6)]
    model = train_languages(spark.createDataFrame(data[:300], "doc_id long, text string, lang string"))
    assert model.members == {"germanic": ["de-AT", "eng"], "romance": ["fra", "spa"], "qqx": ["qqx"]} and set(model.pairs) == {("de-AT", "eng"), ("fra", "spa")}
    got = {r.doc_id: r.lang_pred for r in predict_languages(spark.createDataFrame(data[300:], "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[k] == lang for k, _, lang in data[300:]) > 190
