"""Sub-word ids of a public vocabulary, against the library called directly."""

import os

import pytest

from parasol.functions import subwords as SW

pytestmark = pytest.mark.skipif(not os.path.exists(SW.VOCABULARY), reason="no vocabulary file")
TEXTS = ["You idiot!", "", None, " ", "हिन्दी \n\t日本語", "<|endoftext|> is text here", "😀" * 2000, "a" * 50000, "\x00\x85é"]


@pytest.mark.parametrize("piece", [1, SW.PIECE])
def test_ids_equal_the_library_and_give_the_text_back(spark, monkeypatch, piece):
    from tokenizers import Tokenizer
    monkeypatch.setattr(SW, "PIECE", piece)
    t = Tokenizer.from_file(SW.VOCABULARY)
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").repartition(2)
    rows = df.withColumn("ids", SW.encode_text()("text")).withColumn("back", SW.decode_ids()("ids")).collect()
    for r in rows:
        assert r.back == r.text
        assert r.ids == (None if r.text is None else t.encode(r.text, add_special_tokens=False).ids)


def test_a_batch_is_encoded_and_decoded_in_pieces(monkeypatch):
    """what is held of a batch at once is a piece, however many rows a batch has."""
    import pyarrow as pa

    class Counted:
        def __init__(self, inner):
            self.inner, self.most = inner, 0

        def __getattr__(self, name):
            def call(values, **options):
                self.most = max(self.most, sum(map(len, values)))
                return getattr(self.inner, name)(values, **options)
            return call
    held = Counted(SW._loaded(SW.VOCABULARY))
    monkeypatch.setattr(SW, "_loaded", lambda path: held)
    texts = pa.array([None, ""] + ["one text of some words " * 50] * 2000 + [None])
    ids, = SW.encode_text().func(iter([texts]))
    back, = SW.decode_ids().func(iter([ids]))
    assert back.to_pylist() == texts.to_pylist()
    assert 0 < held.most <= SW.PIECE <= 1 << 20
    assert next(SW.encode_text().func(iter([texts.slice(0, 0)]))).type == ids.type
    assert next(SW.decode_ids().func(iter([ids.slice(1, 3)]))).to_pylist() == texts.slice(1, 3).to_pylist()
