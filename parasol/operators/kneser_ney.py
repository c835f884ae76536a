"""A back-off language model: interpolated Kneser-Ney of order three.

Every order is a count table, and a probability is put together by joins that
fall back from one to the next:

* order 3 counts how often a word follows two others;
* order 2 counts after how many different words a pair of words occurs;
* order 1 counts after how many different words a word occurs.

From each count ``DISCOUNT`` is taken, and what that frees goes to the next
lower order in proportion to its own probabilities; below order 1 it is spread
evenly over the vocabulary and one unknown word. So the probabilities of all
words and the unknown word sum to one in every context, seen or not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.session import cut_lineage

DISCOUNT = 0.75
# The words before a sequence and behind it.
START, END = "<s>", "</s>"


@dataclass
class KneserNey:
    """Model tables: ``three`` (u, v, w, c), ``after_two`` (u, v, c, k), ``two``
    (v, w, c), ``after_one`` (v, c, k), ``one`` (w, p), and ``unknown``, the
    unknown word's probability in an unseen context."""
    three: DataFrame
    after_two: DataFrame
    two: DataFrame
    after_one: DataFrame
    one: DataFrame
    unknown: float
    discount: float


def trigrams(seqs: DataFrame, key: str = "seq_id", tokens_col: str = "tokens") -> DataFrame:
    """(key, pos, u, v, w): every word of a sequence, and its end, with the two
    words before it. Null words are left out; null sequences have none. Row-local."""
    t = F.concat(F.array(F.lit(START), F.lit(START)), F.filter(F.col(tokens_col), lambda x: x.isNotNull()), F.array(F.lit(END)))
    s = seqs.where(F.col(tokens_col).isNotNull()).select(key, t.alias("t")).select(key, "t", F.size("t").alias("n"))
    z = F.arrays_zip(F.slice("t", 1, F.col("n") - 2).alias("u"), F.slice("t", 2, F.col("n") - 2).alias("v"),
                     F.slice("t", 3, F.col("n") - 2).alias("w"))
    return s.select(key, F.posexplode(z).alias("pos", "z")).select(key, "pos", "z.u", "z.v", "z.w")


def fit_kneser_ney(seqs: DataFrame, key: str = "seq_id", tokens_col: str = "tokens", discount: float = DISCOUNT) -> KneserNey:
    """Count tables of the sequences, each written once; an empty table gives a
    model that knows the unknown word only."""
    if not 0 < discount < 1:
        raise ValueError("the discount lies between 0 and 1")
    three = cut_lineage(trigrams(seqs, key, tokens_col).groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c")), name="three")
    after_two = three.groupBy("u", "v").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"))
    two = cut_lineage(three.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c")), name="two")
    after_one = two.groupBy("v").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"))
    ones = cut_lineage(two.groupBy("w").agg(F.count(F.lit(1)).alias("c")), name="one")
    total, vocabulary = ones.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # of the unknown word, and what every word gets from below order 1
    floor = discount * vocabulary / total / (vocabulary + 1) if total else 1.0
    one = ones.select("w", ((F.col("c") - F.lit(discount)) / F.lit(float(total or 1)) + F.lit(floor)).alias("p"))
    return KneserNey(three, cut_lineage(after_two, name="after-two"), two, cut_lineage(after_one, name="after-one"), one, floor, discount)


def probabilities(grams: DataFrame, model: KneserNey) -> DataFrame:
    """The given (u, v, w) rows with ``p``, the probability of w after u, v."""
    d = F.lit(model.discount)
    j = grams.join(model.three.withColumnRenamed("c", "c3"), ["u", "v", "w"], "left") \
        .join(model.after_two.select("u", "v", F.col("c").alias("t3"), F.col("k").alias("k3")), ["u", "v"], "left") \
        .join(model.two.withColumnRenamed("c", "c2"), ["v", "w"], "left") \
        .join(model.after_one.select("v", F.col("c").alias("t2"), F.col("k").alias("k2")), "v", "left") \
        .join(model.one.withColumnRenamed("p", "p1"), "w", "left")
    p1 = F.coalesce("p1", F.lit(model.unknown))

    def order(count, total, different, lower):
        kept = F.greatest(F.coalesce(F.col(count), F.lit(0)) - d, F.lit(0.0))
        return F.when(F.col(total).isNull(), lower).otherwise((kept + d * F.col(different) * lower) / F.col(total))
    p2 = order("c2", "t2", "k2", p1)
    return j.withColumn("p", order("c3", "t3", "k3", p2)).select(*grams.columns, "p")


def log_probability(seqs: DataFrame, model: KneserNey, key: str = "seq_id", tokens_col: str = "tokens") -> DataFrame:
    """(key, n_pos, logp, ppl): the log probability of each sequence and its end,
    and the perplexity per position. Equal trigrams are looked up once; a null sequence has no row."""
    grams = trigrams(seqs, key, tokens_col).groupBy(key, "u", "v", "w").agg(F.count(F.lit(1)).alias("n"))
    known = probabilities(grams.select("u", "v", "w").distinct(), model)
    g = grams.join(known, ["u", "v", "w"]).groupBy(key).agg(F.sum("n").alias("n_pos"), F.sum(F.col("n") * F.ln("p")).alias("logp"))
    return g.select(key, "n_pos", "logp", F.exp(-F.col("logp") / F.col("n_pos")).alias("ppl"))
