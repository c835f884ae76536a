from collections import Counter

import pytest

from parasol.llm import token_counts as tc


@pytest.fixture(scope="module")
def histogram(spark, sf):
    return tc.length_histogram(tc.token_lengths(spark.read.parquet(f"{sf}/documents.parquet"))).cache()


def test_whole_table_against_another_encoder(spark, sf, histogram):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    sizes = [len(own.encode(r.text or "", add_special_tokens=False).ids)
             for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = Counter(sizes)
    rows = {r.length: r for r in histogram.collect()}
    assert {n: r.docs for n, r in rows.items()} == counts
    for n, r in rows.items():
        assert r.tokens == n * counts[n]
        assert (r.docs_from, r.tokens_from) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert (r.docs_to, r.tokens_to) == (sum(s <= n for s in sizes), sum(s for s in sizes if s <= n))
        assert r.truncated_tokens == sum(min(s, n) for s in sizes)
    for limit in (0, 1, 100, 1000, 10**6):
        assert tc.truncated_total(histogram, limit) == sum(min(s, limit) for s in sizes)
    ranked = sorted(sizes)
    for share in (0.01, 0.5, 0.9, 1.0):
        at = next(i for i in range(len(ranked)) if i + 1 >= share * len(ranked))
        assert tc.quantile(histogram, share) == ranked[at]


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "ab" * 100000), (4, "ab" * 100000), (None, "hello world")]
    sizes = {(r.doc_id, r.length) for r in tc.token_lengths(docs_of(rows)).collect()}
    assert {(1, 0), (2, 0), (None, 2)} <= sizes and dict(sizes)[3] > 1
    got = tc.length_histogram(tc.token_lengths(docs_of(rows)))
    assert {r.length: r.docs for r in got.collect()}[0] == 2
    none = tc.length_histogram(tc.token_lengths(docs_of([])))
    assert none.count() == 0 and tc.truncated_total(none, 5) == 0 and tc.quantile(none, 0.5) is None
