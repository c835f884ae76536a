import math

import pytest
from pyspark.sql import functions as F

from parasol.llm import language_id


def brute(model, text):
    """Score a text word by word, straight from the tables."""
    total, letters = [0.0] * len(model.langs), False
    for token in (text or "").split():
        for w in language_id.letter_words(token):
            letters = True
            rows = [model.rows[0][w]] if w in model.rows[0] else None
            n = language_id.LONGEST
            while rows is None and n:
                marked = w if n == 1 else f"^{w}$"
                rows = [model.rows[n][marked[i:i + n]] for i in range(len(marked) - n + 1)
                        if marked[i:i + n] in model.rows[n]] or None
                n -= 1
            for k in range(len(total)):
                total[k] += sum(model.logs[r][k] for r in rows or ()) / len(rows or [1])
    if not letters:
        return "und", 0.0
    best = max(range(len(total)), key=lambda k: total[k])
    return model.langs[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0, max_words=500, max_grams=2000)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in docs.collect():
        lang, share = brute(model, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(share, abs=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_edges(docs_of):
    en = [(i, "the cat and the dog are here", "en", "s", 1) for i in range(20)]
    de = [(i, "der Hund und die Katze sind da", "de", "s", 1) for i in range(20, 40)]
    odd = [(50, None, None, None, None), (51, "", "en", None, 0), (52, "123 !!", None, None, 0), (53, "Hund", None, None, 0),
           (54, "the " * 40000, None, None, 0), (54, "the " * 40000, None, None, 0), (55, "кот", None, None, 0),
           (None, "und die", None, None, 0)]
    got = {r.doc_id: r for r in language_id.languages(docs_of(en + de + odd)).collect()}
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and got[50].score == 0
    assert got[53].lang_pred == "de" and got[54].lang_pred == "en" and got[None].lang_pred == "de"
    assert got[55].lang_pred == "de" and got[55].score == pytest.approx(0.5)  # a tie
    kept = language_id.accepted(docs_of(en + de + odd))
    assert kept.count() == 40 + 5 and kept.columns == docs_of([]).columns
    assert language_id.languages(docs_of([])).count() == 0
    unknown = language_id.languages(docs_of(odd[:1] + odd[3:4])).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_texts_without_letters_are_unknown(spark, docs_of):
    docs = docs_of([(1, "the cat sat", "en", None, 0), (2, "½ ² ① 42 %", "en", None, 0), (3, "१२३", "en", None, 0), (4, "x", "en", None, 0)])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "en"}


def test_marks_belong_to_their_letters():
    assert language_id.letter_words("हिन्दी") == ["हिन्दी"]
    assert language_id.letter_words("a1b½C") == ["a", "b", "c"]
