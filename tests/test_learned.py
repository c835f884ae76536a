"""Back-off model, phrases, intervals and calibration against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parasol.operators import calibration as CA
from parasol.operators import decode as DEC
from parasol.operators import intervals as IV
from parasol.operators import judges as JU
from parasol.operators import kneser_ney as KN
from parasol.operators import phrases as PH
from parasol.plans import derived as D

SEQS = "seq_id long, tokens array<string>"


# ------------------------------------------------------------------ Kneser-Ney

def brute_kneser_ney(seqs, d=0.75):
    three = Counter()
    for t in seqs:
        t = ["<s>", "<s>", *[x for x in t if x is not None], "</s>"]
        three.update(zip(t, t[1:], t[2:]))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    total, vocabulary = sum(one.values()), len(one)

    def order(counts, context, w, lower):
        mine = {k[-1]: c for k, c in counts.items() if k[:-1] == context}
        if not mine:
            return lower
        return (max(mine.get(w, 0) - d, 0) + d * len(mine) * lower) / sum(mine.values())

    def p(u, v, w):
        p1 = (max(one[w] - d, 0) if w in one else 0) / total + d * vocabulary / total / (vocabulary + 1)
        return order(three, (u, v), w, order(two, (v,), w, p1))
    return p, [*one, "<unknown>"]


def test_kneser_ney_equals_brute_force_and_sums_to_one(spark):
    rng = random.Random(2)
    seqs = [[rng.choice("aabbcdefg") for _ in range(rng.randrange(8))] for _ in range(40)] + [["a", None, "b"], []]
    model = KN.fit_kneser_ney(spark.createDataFrame(list(enumerate(seqs)) + [(99, None)], SEQS))
    p, words = brute_kneser_ney(seqs)
    contexts = [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("g", "zz"), ("zz", "a"), ("zz", "yy"), ("a", "a")]
    grams = spark.createDataFrame([(u, v, w) for u, v in contexts for w in words], "u string, v string, w string")
    got = {(r.u, r.v, r.w): r.p for r in KN.probabilities(grams, model).collect()}
    assert all(got[g] == pytest.approx(p(*g), rel=1e-9) for g in got) and len(got) == len(contexts) * len(words)
    for u, v in contexts:
        assert sum(got[u, v, w] for w in words) == pytest.approx(1, abs=1e-9)
    held = [["a", "b", "zz"], [], ["a", "a", "a", "a"]]
    lp = {r.seq_id: (r.n_pos, r.logp) for r in KN.log_probability(spark.createDataFrame(list(enumerate(held)), SEQS), model).collect()}
    for i, t in enumerate(held):
        t = ["<s>", "<s>", *t, "</s>"]
        assert lp[i][0] == len(t) - 2 and lp[i][1] == pytest.approx(sum(math.log(p(*g)) for g in zip(t, t[1:], t[2:])), rel=1e-9)


def test_kneser_ney_without_sequences(spark):
    model = KN.fit_kneser_ney(spark.createDataFrame([], SEQS))
    lp = KN.log_probability(spark.createDataFrame([(1, ["a"])], SEQS), model).first()
    assert lp.n_pos == 2 and lp.logp == 0      # only one unknown word is known
    with pytest.raises(ValueError):
        KN.fit_kneser_ney(spark.createDataFrame([], SEQS), discount=1.5)


def test_kneser_ney_beats_the_bigram_on_held_out_text(spark, sf):
    seqs = D.turn_token_arrays(spark, sf).withColumn("held", F.col("seq_id") / F.lit(D.SEQ_ID_STRIDE) % 5 < 1)
    train, held = seqs.where("NOT held"), seqs.where("held").where(F.size("tokens") > 1)
    mine = KN.log_probability(held, KN.fit_kneser_ney(train)).agg((-F.sum("logp") / F.sum("n_pos")).alias("loss")).first().loss
    counts = DEC.bigram_counts(train)
    lp = DEC.smoothed_logprob(held, counts, DEC.vocab_size(train) + 1, "seq_id", "tokens")
    assert mine < lp.agg((-F.avg("logp")).alias("loss")).first().loss


# ------------------------------------------------------------------ phrases

def leftmost_longest(tokens, phrases):
    split = {tuple(p.split()): p for p in phrases}
    out, at = [], 0
    while at < len(tokens):
        n = max((len(p) for p in split if tuple(tokens[at:at + len(p)]) == p), default=0)
        if n:
            out.append((at, n, split[tuple(tokens[at:at + n])]))
        at += n or 1
    return out


def test_matches_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        phrases = {" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8))}
        matcher = PH.PhraseMatcher(phrases)
        tokens = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        assert matcher.matches(tokens) == leftmost_longest(tokens, phrases)
    assert PH.PhraseMatcher(["ab"]).matches(["xab", "ab"]) == [(1, 1, "ab")]     # whole words only


def test_phrases_are_rewritten_alike_in_batch_and_stream(spark, tmp_path):
    table = spark.createDataFrame([("a b", "X"), ("a b", "Y"), ("b c d", None), ("e", "two words"), (None, "z"), (" ", "z")], "phrase string, tgt string")
    targets = PH.collect_phrases(table, target_col="tgt")
    assert targets == {"a b": "X", "b c d": "", "e": "two words"}
    rewriter = PH.phrase_rewriter(spark, targets)
    rows = [(0, ["a", "b", "c", "d"]), (1, ["b", "c", "d", "e"]), (2, []), (3, None), (4, ["b", None, "c"]), (5, ["a"] * 5000 + ["b"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r.id: r.text for r in df.select("id", rewriter("tokens").alias("text")).collect()}
    assert got == {0: "X c d", 1: "two words", 2: "", 3: None, 4: "b c", 5: "a " * 4999 + "X"}
    df.write.parquet(str(tmp_path / "src"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src")).select("id", rewriter("tokens").alias("text"))
    s.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "ck")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.text for r in spark.read.parquet(str(tmp_path / "sink")).collect()} == got


def test_phrases_tell_more_than_their_parts(spark):
    bad, good = "you are full of it", "you are full and it is of use"
    docs = [(i, bad if i % 2 else good) for i in range(60)] + [(100, None), (101, "")]
    labels = [(i, i % 2) for i in range(60)] + [(100, 1), (101, 0), (102, 1)]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.phrase for r in PH.detox_phrases(*frames, max_words=2).collect()}
    assert got == {"full of", "of it"}           # no word alone tells, and "you are" is everywhere
    assert PH.detox_phrases(frames[0], frames[1].where("toxic = 0")).collect() == []


def test_only_runs_of_frequent_words_are_counted(spark, monkeypatch):
    """rare words' runs are never made, with the same phrases as without the cut."""
    docs = [(i, f"rare{'abcdefgh'[i % 8]}x you are full of it" if i % 2 else "you are full and it is of use") for i in range(64)]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(64)], "doc_id long, toxic int"))
    made = []
    monkeypatch.setattr(PH, "cut_lineage", lambda df, name="t", f=PH.cut_lineage: made.append((name, f(df, name=name))) or made[-1][1])
    got = sorted(map(tuple, PH.detox_phrases(*frames, min_share=0.3).collect()))
    runs = {r.phrase for r in dict(made)["candidates"].collect()}
    assert "are full of" in runs and not any("rare" in r for r in runs)
    row = frames[0].select(F.array(F.lit("x"), F.lit("you"), F.lit("are")).alias("t")).limit(1)
    assert row.select(PH._runs("t", 3, ["you", "are"]).alias("r")).first().r == [None, "you", "are", "you are"]
    assert set(row.select(PH._runs("t", 3).alias("r")).first().r) == {None, "x", "you", "are", "x you", "you are", "x you are"}
    monkeypatch.setattr(PH, "INLINE_MAX", 1)      # too many frequent words to be told apart in the plan
    monkeypatch.setattr(PH, "SENT_PHRASES", 1)
    assert sorted(map(tuple, PH.detox_phrases(*frames, min_share=0.3).collect())) == got and got


def test_too_many_phrases_are_refused(spark, monkeypatch):
    monkeypatch.setattr(PH, "MAX_PHRASES", 1)
    with pytest.raises(ValueError):
        PH.collect_phrases(spark.createDataFrame([("a",), ("b",)], "phrase string"))


# ------------------------------------------------------------------ intervals

def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("rs"), rng.random(), None if i % 7 == 0 else float(i % 2)) for i in range(200)] + [(None, "r", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "id long, run string, x double, y double").repartition(3)
    bounds = IV.poisson_bounds()
    want = {}
    for run in "rs":
        for metric, at in (("x", 2), ("y", 3)):
            mine = [(r[0], r[at]) for r in rows if r[1] == run]
            means = []
            for k in range(50):
                w = [sum(int(hashlib.md5(f"42:{k}:{'' if i is None else i}".encode()).hexdigest()[:15], 16) >= b for b in bounds) for i, _ in mine]
                means.append(sum(a * v for a, (_, v) in zip(w, mine) if v is not None) / sum(a for a, (_, v) in zip(w, mine) if v is not None))
            values = [v for _, v in mine if v is not None]
            want[run, metric] = (sum(values) / len(values), *np.quantile(means, [0.05, 0.95]))
    got = {(r.run, r.metric): (r["mean"], r.low, r.high) for r in IV.bootstrap_intervals(df, "id", ["x", "y"], ("run",), replicates=50).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert all(low < mean < high for mean, low, high in got.values())


def test_weights_follow_a_poisson_law(spark):
    w = spark.range(0, 40000).select(IV.poisson_weight(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("w"))
    counts = Counter(r.w for r in w.collect())
    for k in range(5):
        assert counts[k] / 40000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([], "id long, run string, x double")
    assert IV.bootstrap_intervals(df, "id", ["x"], ("run",)).collect() == []
    one = spark.createDataFrame([(1, "r", None)], "id long, run string, x double")
    assert [tuple(r) for r in IV.bootstrap_intervals(one, "id", ["x"], ("run",)).collect()] == [("r", "x", None, None, None)]


# ------------------------------------------------------------------ calibration

def pooled(points):
    """Pool adjacent violators: (score, label) -> {score: value}."""
    by = defaultdict(list)
    for s, y in points:
        by[s].append(y)
    blocks = []
    for s in sorted(by):
        blocks.append([sum(by[s]), len(by[s]), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {s: y / n for y, n, scores in blocks for s in scores}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_calibration_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    points = [(round(rng.gauss(0, 3), 1), 0) for _ in range(150)]
    points = [(s, int(rng.random() < 1 / (1 + math.exp(-s)))) for s, _ in points]
    df = spark.createDataFrame(points + [(None, 1), (0.5, None)], "score double, y int").repartition(4)
    model = CA.fit_calibration(df, "score", "y")
    want = pooled(points)
    rows = CA.calibrated(df.select("score").distinct(), "score", model).collect()
    assert all(r.p is None if r.score is None else r.p == pytest.approx(want.get(r.score, r.p), abs=1e-9) for r in rows)
    ends = spark.createDataFrame([(-1e9,), (1e9,)], "score double")
    assert [r.p for r in CA.calibrated(ends, "score", model).orderBy("score").collect()] == pytest.approx([want[min(want)], want[max(want)]])


def test_calibration_lowers_the_brier_score(spark, sf):
    docs, labels = D.table(spark, "/root/testdata/sf0.01", "documents"), D.table(spark, "/root/testdata/sf0.01", "labels")
    fold = F.pmod("doc_id", F.lit(5))
    model = JU.fit_nb(docs, labels.where(fold > 1), "toxic")

    def scored(where):
        return JU.score_tokens(JU.labelled_tokens(docs, labels.where(where), "toxic"), ["doc_id", "y"], {"s": "tokens"}, model, output="logit")
    fit = CA.fit_calibration(scored(fold == 1), "s", "y")
    held = CA.calibrated(scored(fold == 0), "s", fit).withColumn("raw", 1 / (1 + F.exp(-F.col("s"))))
    assert CA.brier_score(held, "p", "y").first().brier < CA.brier_score(held, "raw", "y").first().brier


def test_calibration_without_rows(spark):
    df = spark.createDataFrame([], "score double, y int")
    assert CA.fit_calibration(df, "score", "y") is None
    assert CA.calibrated(spark.createDataFrame([(0.25,)], "score double"), "score", None).first().p == 0.25
