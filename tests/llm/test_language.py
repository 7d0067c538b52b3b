"""Language identification: held-out accuracy, the best path against brute force, spans, awkward rows."""

import itertools

import numpy as np
import pytest
from conftest import SF

from foliarc.llm import language

COLUMNS = "doc_id long, text string, lang string, spans string, held_out string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, k, "x", "y") for i, t, k in rows], COLUMNS)


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def value(s, p, penalty):
    return s[np.arange(len(s)), p].sum() - penalty * (np.diff(p) != 0).sum()


@pytest.mark.parametrize("k", [1, 2, 3])
def test_path_is_best(k):
    rng = np.random.default_rng(k)
    for n in range(1, 8):
        for spread in (0.5, 2, 6):
            s = rng.normal(0, spread, (n, k)).round(1)
            most = max(value(s, np.array(p), 3.0) for p in itertools.product(range(k), repeat=n))
            assert abs(value(s, language.path(s, 3.0), 3.0) - most) < 1e-9
            assert abs(value(s, language._path_wide(s, 3.0), 3.0) - most) < 1e-9


def test_path_of_long_texts_equals_plain_search():
    rng = np.random.default_rng(9)
    for k in (2, 5, 20):
        s = rng.normal(0, 2, (3000, k))
        s[:, 0] += 1
        s[800:860, 1] += 4
        assert abs(value(s, language.path(s, 12.0), 12.0) - value(s, language._path_wide(s, 12.0), 12.0)) < 1e-6


def test_held_out_accuracy(spark):
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_words_are_runs_of_letters_and_marks():
    text = "Ünd, l'été été naïve42x हिन्दी ́ ABC"
    w = language.words_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert [text[a:b] for a, b in zip(w.start, w.end)] == ["Ünd", "l", "été", "été", "naïve", "x", "हिन्दी", "ABC"]
    assert w.letters.tolist() == [3, 1, 3, 3, 5, 1, sum(c.isalpha() for c in "हिन्दी"), 3]
    alone = [language.words_of(np.frombuffer(t.encode("utf-32-le"), np.uint32)).grams.tolist() for t in ("abc", "ABC")]
    assert alone[0] == alone[1]


def test_spans_of_mixed_text(model, spark):
    rows = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 400 and 3000").select("lang", "text").collect()}
    parts = [rows["en"][:400], rows["fr"][:300], rows["en"][100:250]]
    ((name,), (score,), (spans,)) = language.label(["\n".join(parts)], model)
    assert name == "en" and 0 < score < 1
    assert [s[2] for s in spans] == ["en", "fr", "en"]
    assert abs(spans[1][0] - 400) < 25 and abs(spans[1][1] - 701) < 25
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_scripts_narrow_candidates(spark):
    rows = [(4 * i + j, t, k) for i in range(40) for j, (t, k) in enumerate([("привет мир как дела", "ru"), ("hello world how is it", "en"), ("hallo welt wie geht es", "de")])]
    m = language.learn(docs(spark, rows))
    names, score, spans = language.label(["zzz qqq привет", "мир", "日本語", "hello", "αβγ hello how αβγ"], m)
    assert names[1] == "ru" and names[3] == "en" and names[4] == "en" and spans[0][-1][2] == "ru"
    assert names[2] in m.names and score[2] < 0.5
    assert all(m.used[3][m.names.index(k)] == (k == "ru") for k in m.names)


def test_awkward_rows(spark):
    some = [(i, "the cat and the dog are here", "en") for i in range(20)] + [(100 + i, "der hund und die katze sind da", "de") for i in range(20)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 !? 34", "de"), (903, "a", None), (None, "the dog", "en"), (None, "the dog", "en"), ((1 << 62) + 1, "der Hund " * 60_000, None), (904, "x" * 200_000, "en")]
    got = language.identify(docs(spark, some + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(some + odd)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(by[i].score == 0 and not by[i].spans for i in (900, 901, 902))
    assert by[(1 << 62) + 1].lang_pred == "de" and len(by[(1 << 62) + 1].spans) == 1
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and nulls[0] == nulls[1] and not nulls[0].held_out and nulls[0].lang_pred == "en"
    assert language.identify(docs(spark, some).limit(0)).count() == 0
    none = language.identify(docs(spark, [(1, "a b", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_more_languages_than_are_learned(spark):
    rows = [(i, "one two three", f"l{i % 5}") for i in range(50)] + [(60 + i, "four five", "l4") for i in range(3)]
    assert language.learn(docs(spark, rows), most=2).names == ["l0", "l4"]


def test_long_texts_equal_short_pieces(model, monkeypatch):
    text = "The the of and that with for. " * 50 + "Le les des une dans pour. " * 50
    whole = language.label([text, text[:700]], model)
    monkeypatch.setattr(language, "PIECE", 257)
    cut = language.label([text, text[:700]], model)
    assert cut[0] == whole[0] and [s[2] for s in cut[2][0]] == [s[2] for s in whole[2][0]]
