"""Operator 13, filter interaction audit by count-weighted decision diagrams.

Each document fails some of five filters; its failures are a mask of five
bits. Documents are counted by part and mask in one aggregation, with those
that the labels call good or toxic. A part's at most 32 counts become a
decision diagram: a level for each filter, a pass and a fail edge below each
node, equal nodes shared, and at each node the counts of all masks below it.
Exchanging two adjacent levels changes only the nodes of these two, so plain
changes (each order differs from the one before by one exchange) visit all 120
orders. In each order the path of pass edges gives the steps: below its node
of a level, the pass edge weighs what is kept and the fail edge what is removed.

The other figures come from the same paths: a filter fails in the part as many
documents as it removes when it comes first, and it alone fails as many as it
removes when it comes last; its removals summed over all orders are its
Shapley value times 120.

Edge cases: a null text is empty and has no words; a null ``lang`` is the part
of the empty string; a document whose doc_id is null has no smaller id before
it, and none after; rows that repeat doc_id and text are not copies of each
other, since neither id is smaller; repeated rows of ``labels`` mark a document if any
of them does, null labels mark nothing; texts of any length are read whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80      # per cent of the words
MOST_CAPITALS = 10       # per cent of the code points
SIGNS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
                "unique_fails long, good_lost long, toxic_lost long, shapley long")


def own_failures(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text and ``mask``: the failures
    that a text shows by itself (bits of A to D)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"))
    n = F.size("words")
    capitals = F.char_length("text") - F.char_length(F.translate("text", CAPITALS, ""))
    fails = [n < LEAST_WORDS,
             F.lit(100) * F.size(F.array_distinct("words")) < F.lit(LEAST_DISTINCT) * n,
             F.lit(100) * capitals.cast("long") > F.lit(MOST_CAPITALS) * F.char_length("text").cast("long"),
             F.col("text").rlike(SIGNS)]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` and the numbers of documents ``n``, ``good`` and ``toxic``."""
    rows = stored(own_failures(documents), "failures")
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # a third of all rows may be one text: the many rows are on one side only, which Spark splits
    rows = rows.join(first.select(F.col("digest").alias("copied"), "first_id"), F.col("digest") == F.col("copied"), "left")
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    rows = rows.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))
    rows = rows.join(known, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


class Diagram:
    """An ordered decision diagram over masks of failures. ``weights`` maps a
    mask (bit i: the i-th of ``order`` fails) to a tuple of counts."""

    def __init__(self, order: str, weights: dict[int, tuple]):
        self.order = list(order)
        self.zero = (0,) * len(next(iter(weights.values()), ()))
        self.below: list = []       # (pass, fail) of each node
        self.weight: list = []
        self.levels: list[dict] = [{} for _ in order]
        self.leaves: dict[tuple, int] = {}
        self.root = self._built(0, 0, weights)

    def _add(self, below, weight) -> int:
        self.below.append(below)
        self.weight.append(weight)
        return len(self.below) - 1

    def _built(self, level: int, mask: int, weights: dict) -> int:
        if level == len(self.order):
            weight = weights.get(mask, self.zero)
            if weight not in self.leaves:
                self.leaves[weight] = self._add(None, weight)
            return self.leaves[weight]
        return self._node(self.levels[level], self._built(level + 1, mask, weights),
                          self._built(level + 1, mask | 1 << level, weights))

    def _node(self, table: dict, passed: int, failed: int) -> int:
        """The node with these two edges: a known one, or a new one that weighs what is below."""
        key = passed, failed
        if key not in table:
            table[key] = self._add(key, tuple(x + y for x, y in zip(self.weight[passed], self.weight[failed])))
        return table[key]

    def swap(self, level: int) -> None:
        """Exchange a level with the one below it. Its nodes stay, so that what
        points to them from above holds, and get other nodes below."""
        upper, lower = {}, {}
        for (passed, failed), node in self.levels[level].items():
            (a, b), (c, d) = self.below[passed], self.below[failed]
            self.below[node] = self._node(lower, a, c), self._node(lower, b, d)
            upper[self.below[node]] = node
        self.levels[level:level + 2] = [upper, lower]
        self.order[level:level + 2] = self.order[level:level + 2][::-1]

    def steps(self) -> Iterator[tuple[str, tuple, tuple]]:
        """Along the all-pass path: the filter, what it keeps, what it removes."""
        node = self.root
        for name in self.order:
            passed, failed = self.below[node]
            yield name, self.weight[passed], self.weight[failed]
            node = passed


def plain_changes(n: int) -> Iterator[int]:
    """Places whose exchange with the next one leads through all n! orders."""
    if n < 2:
        return
    inner, forward = plain_changes(n - 1), False
    while True:
        yield from range(n - 1) if forward else range(n - 2, -1, -1)
        place = next(inner, None)
        if place is None:
            return
        # the last element stands before the others or behind them
        yield place if forward else place + 1
        forward = not forward


def all_orders(weights: dict[int, tuple], filters: str = FILTERS) -> list[tuple[str, list]]:
    """Every order with its steps."""
    diagram = Diagram(filters, weights)
    orders = [("".join(diagram.order), list(diagram.steps()))]
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        orders.append(("".join(diagram.order), list(diagram.steps())))
    return orders


def _audited(group: pd.DataFrame) -> pd.DataFrame:
    """The audit of one part, from its counts by mask."""
    weights = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(group["mask"], group["n"], group["good"], group["toxic"])}
    orders = all_orders(weights)
    fails, alone, removals = {}, {}, dict.fromkeys(FILTERS, 0)
    for _, steps in orders:
        for i, (name, _, removed) in enumerate(steps):
            removals[name] += removed[0]
            if i == 0:
                fails[name] = removed[0]
            if i == len(steps) - 1:
                alone[name] = removed[0]
    part = group["part"].iloc[0]
    return pd.DataFrame(
        [(part, order, i + 1, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], removals[name])
         for order, steps in orders for i, (name, kept, removed) in enumerate(steps)],
        columns=[c.split()[0] for c in AUDIT_SCHEMA.split(", ")])


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return mask_counts(documents, labels).groupBy("part").applyInPandas(_audited, AUDIT_SCHEMA)


ORACLE = r"""
WITH letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM letters a JOIN letters b ON b.name <> a.name JOIN letters c ON c.name NOT IN (a.name, b.name)
  JOIN letters d ON d.name NOT IN (a.name, b.name, c.name) JOIN letters e ON e.name NOT IN (a.name, b.name, c.name, d.name)),
steps AS (
  SELECT o.filter_order, s.step, l.name, l.bit,
         coalesce((SELECT sum(x.bit) FROM letters x WHERE strpos(o.filter_order, x.name) < s.step), 0)::INT AS before
  FROM orders o, (SELECT unnest(range(1, 6)) AS step) s, letters l WHERE substr(o.filter_order, s.step, 1) = l.name),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask
  FROM texts LEFT JOIN known USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
found AS (
  SELECT c.part, s.filter_order, s.step, s.name,
         coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM counts c, steps s GROUP BY c.part, s.filter_order, s.step, s.name)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM found"""
