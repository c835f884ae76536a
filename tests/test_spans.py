"""Tokens with positions, and rewrites that leave all else as it is."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parasol.functions import spans as SPN
from parasol.operators import rewrite as RE
from parasol.plans import derived as D

TEXTS = ["You IDIOT, you are  an idiot!\n\tIdiot3 x-ray", "", None, " ", "हिन्दी में idiot लिखा", "日本語のidiotテスト", "éà idiot",
         "½ ² ① 42idiot 4.2", "\x1c ́idiot", "😀idiot😀", "straße STRASSE Straße", "a" * 30000 + " idiot " + "b " * 9000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_spans_cover_the_text(spark):
    df = frame(spark, TEXTS).repartition(2).select("doc_id", "text", SPN.spans(SPN.pieces("text")).alias("s"))
    for r in df.collect():
        if r.text is None:
            assert r.s is None
            continue
        assert "".join(x.text for x in r.s) == r.text
        at = 0
        for x in r.s:
            assert (x.start, x.end) == (at, at + len(x.text)) and r.text[x.start:x.end] == x.text
            at = x.end
            assert x.kind == SPN.SPACE or not re.search(r"[\x09-\x0D ]", x.text)
    got = {r.text: [x.text for x in r.s if x.kind == SPN.WORD] for r in df.where("text IS NOT NULL").collect()}
    assert got[TEXTS[4]] == ["हिन्दी", "में", "idiot", "लिखा"] and got[TEXTS[6]] == ["éà", "idiot"]
    kinds = {x.text: x.kind for r in df.where("doc_id = 7").collect() for x in r.s}
    assert kinds["½"] == kinds["²"] == kinds["①"] == kinds["42"] == SPN.NUMBER and kinds["."] == SPN.SIGN


def cased(target, word):
    if len(word) > 1 and word == word.upper() != word.lower():
        return target.upper()
    return target[:1].upper() + target[1:] if word[:1] != word[:1].lower() else target


def brute(text, mapping, mode):
    if text is None:
        return None
    import regex
    return regex.sub(r"(?:\p{L}\p{M}*)+", lambda m: m.group() if m.group().lower() not in mapping else (
        "" if mode == "delete" else cased(mapping[m.group().lower()], m.group())), text)


@pytest.mark.parametrize("mode", ["delete", "replace"])
@pytest.mark.parametrize("inline", [True, False])
def test_only_listed_words_change(spark, monkeypatch, mode, inline):
    monkeypatch.setattr(RE, "INLINE_MAX", 1024 if inline else 0)
    rng = random.Random(1)
    words = ["idiot", "Idiot", "IDIOT", "x", "X", "straße", "fool", "Zed", "42", "...", "  ", "\n", "é", "ÉÉ"]
    texts = TEXTS + [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(200)]
    lex = spark.createDataFrame([("idiot", "person"), ("idiot", "poor"), (None, "q"), ("x", None), ("x", "why"), ("straße", "weg"),
                                 ("idiot", "person"), ("éé", "a b")], "token string, tgt string")
    mapping = {"idiot": "person", "x": "why", "straße": "weg", "éé": "a b"}
    got = {r.doc_id: r.rewritten for r in RE.rewrite_text(frame(spark, texts), "doc_id", "text", lex, mode).collect()}
    assert got == {i: brute(t, mapping, mode) for i, t in enumerate(texts)}


def test_nothing_to_delete_returns_the_text(spark, sf, monkeypatch):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    none = spark.createDataFrame([(None,)], "token string")
    for limit in (1024, -1):
        monkeypatch.setattr(RE, "INLINE_MAX", limit)
        assert RE.rewrite_text(docs, "doc_id", "text", none).where("NOT text <=> rewritten").count() == 0


@pytest.mark.parametrize("mode", ["delete", "replace"])
def test_lexicon_size_never_changes_a_result(spark, monkeypatch, mode):
    """Repeated words, null words and null targets, inlined and by a join."""
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["b"]), (None, ["a", None]), (2, None), (3, [])], "k long, toks array<string>")
    lex = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", None)], "token string, tgt string")

    def run():
        return sorted(((r.k, r.toks, r.text) for r in RE.rewrite(df, "k", "toks", lex, mode).collect()), key=repr)
    inline = run()
    monkeypatch.setattr(RE, "INLINE_MAX", 0)
    assert run() == inline
    assert (1, ["a", "b", "c"], {"delete": "c", "replace": "x b c"}[mode]) in inline


def test_stream_equals_batch(spark, sf, tmp_path, monkeypatch):
    from parasol.streaming import streams as ST
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "src"))
    lex = RE.detox_lexicon(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"))
    words = [r.token for r in lex.collect()]
    batch = {r.doc_id: r.rewritten for r in RE.rewrite_text(docs, "doc_id", "text", lex).collect()}
    mapping = dict.fromkeys(words, "person")
    table = lex.select("token", F.lit("person").alias("tgt"))
    replaced = {r.doc_id: r.rewritten for r in RE.rewrite_text(docs, "doc_id", "text", table, "replace").collect()}
    for i, limit in enumerate((1024, 0)):
        monkeypatch.setattr(ST, "INLINE_MAX", limit)
        for name, kw, want in (("d", {"words": words}, batch), ("r", {"mapping": mapping}, replaced)):
            sink = str(tmp_path / f"{name}{i}")
            ST.rewrite_text_stream(spark, str(tmp_path / "src"), sink, sink + "-ck", **kw)
            assert {r.doc_id: r.rewritten for r in spark.read.parquet(sink).collect()} == want


def test_documents_of_very_many_sentences(spark, tmp_path):
    spark.createDataFrame([(7, "a. " * 100_001, "en"), (8, "b", "en")], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    s = D.sentences(spark, str(tmp_path))
    assert s.count() == 100_002 and s.select("pair_id").distinct().count() == 100_002
