"""A few registered queries against their DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_check import duck, rows_of

NAMES = ["random_split", "detox_lexicon", "char_bleu", "sampled_decode", "judge_distribution", "reward_total"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want
