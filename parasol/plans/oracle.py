"""DuckDB SQL for every registered query, written independently of the Spark
plans. Doubles are rounded to 6 decimals, integers are BIGINT, arrays text.
"""

from __future__ import annotations

import math

from parasol.plans.oracle_views import _NOUNS, register, with_views

SEED = 42
TOKEN_RE = "[a-zß-ÿ]+"


def _tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_RE}')"


def _draw(expr: str) -> str:
    """The first 60 bits of an md5 as an integer."""
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def _hkey(*parts: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{SEED}'"] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"


# ------------------------------------------------------------------ shared views

register("vocab", ("sentences", "pairs"), """
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS BIGINT) AS id, n
  FROM (SELECT token, count(*) AS n FROM (
          SELECT unnest(tokens) AS token FROM sentences
          UNION ALL SELECT unnest(string_split(neutral1, ' ')) AS token FROM pairs) GROUP BY token)""")

register("enc_ids", ("pairs", "vocab"), """
  SELECT pair_id, side, [0] || list(coalesce(v.id, 2) ORDER BY pos) || [1] AS ids
  FROM (SELECT pair_id, 'x' AS side, unnest(string_split(toxic, ' ')) AS token,
               unnest(range(len(string_split(toxic, ' ')))) AS pos FROM pairs
        UNION ALL
        SELECT pair_id, 'y' AS side, unnest(string_split(neutral1, ' ')) AS token,
               unnest(range(len(string_split(neutral1, ' ')))) AS pos FROM pairs) t
  LEFT JOIN vocab v USING (token)
  GROUP BY pair_id, side""")

register("encoded", ("enc_ids",), """
  SELECT x.pair_id,
         x.ids || list_transform(range(38 - len(x.ids)), lambda i: 1) AS input_ids,
         y.ids || list_transform(range(38 - len(y.ids)), lambda i: 1) AS detoxified_ids
  FROM enc_ids x JOIN enc_ids y ON x.pair_id = y.pair_id AND x.side = 'x' AND y.side = 'y'
  WHERE len(x.ids) <= 38 AND len(y.ids) <= 38""")

for _rank, _split, _src in (("pair_rank", "split_def", "pairs"), ("all_rank", "all_split", "all_pairs")):
    register(_rank, (_src,), f"""
  SELECT pair_id, row_number() OVER (ORDER BY {_hkey('pair_id')}, pair_id) AS r, count(*) OVER () AS n FROM {_src}""")
    register(_split, (_rank,), f"""
  SELECT pair_id,
         CASE WHEN r <= la THEN 'train' WHEN r <= la + lb THEN 'val' ELSE 'test' END AS split,
         r - CASE WHEN r <= la THEN 0 WHEN r <= la + lb THEN la ELSE la + lb END AS split_rank
  FROM (SELECT *, fa + CASE WHEN rem >= 1 THEN 1 ELSE 0 END AS la, fb + CASE WHEN rem >= 2 THEN 1 ELSE 0 END AS lb
        FROM (SELECT *, n - fa - fb - fc AS rem
              FROM (SELECT pair_id, r, n, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS fa,
                           CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS fb,
                           CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS fc FROM {_rank})))""")

register("pair_batches", ("all_rank",), """
  SELECT pair_id, CAST((r - 1) // 16 AS BIGINT) AS batch_id FROM all_rank""")


def _nb(label: str, p: str) -> None:
    register(f"lab_{p}", (), f"""
  SELECT l.doc_id, CAST(l.{label} AS INTEGER) AS y, {_tok('d.text')} AS toks
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.{label} IS NOT NULL""")
    register(f"w_{p}", (f"lab_{p}",), f"""
  SELECT token, ln((a + 1) / (t.na + t.k)) - ln((b + 1) / (t.nb + t.k)) AS w
  FROM (SELECT token, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS a,
               CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b
        FROM (SELECT y, unnest(toks) AS token FROM lab_{p}) GROUP BY token) c,
       (SELECT sum(a) AS na, sum(b) AS nb, CAST(count(*) AS DOUBLE) AS k
        FROM (SELECT token, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS a,
                     CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b
              FROM (SELECT y, unnest(toks) AS token FROM lab_{p}) GROUP BY token)) t""")
    register(f"prior_{p}", (f"lab_{p}",), f"""
  SELECT ln(avg(y)) - ln(1 - avg(y)) AS prior FROM lab_{p}""")


_nb("toxic", "tox")
_nb("quality", "flu")


def _score(p: str, src: str, keys: str, text: str) -> str:
    """Class-1 probability of ``text`` for each row of ``src`` (as a subquery)."""
    kk = ", ".join(k.strip() for k in keys.split(","))
    on = " AND ".join(f"k.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT {', '.join('k.' + k.strip() for k in keys.split(','))},
           1 / (1 + exp(-((SELECT prior FROM prior_{p}) + coalesce(s.sw, 0)))) AS p
    FROM (SELECT {kk} FROM {src}) k LEFT JOIN
         (SELECT {kk}, sum(coalesce(w.w, 0)) AS sw
          FROM (SELECT {kk}, unnest({_tok(text)}) AS token FROM {src}) o LEFT JOIN w_{p} w USING (token)
          GROUP BY {kk}) s ON {on})"""


register("tv", (), """
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings""")


def _emb(src: str, key: str, text: str) -> str:
    """Mean token vector per row (long form: key, dim, v)."""
    return f"""(SELECT {key}, dim, avg(val) AS v FROM (
      SELECT o.{key}, unnest(tv.vector) AS val, unnest(range(len(tv.vector))) AS dim
      FROM (SELECT {key}, unnest({_tok(text)}) AS token FROM {src}) o
      JOIN tv ON tv.vec_id = (('0x' || substr(md5(o.token), 1, 8))::BIGINT) % (SELECT count(*) FROM embeddings)
    ) GROUP BY {key}, dim)"""


register("lexicon", ("lab_tox",), f"""
  SELECT token, a, b, ln((a + 0.5::DOUBLE) / (na - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (nb - b + 0.5::DOUBLE)) AS lo
  FROM (SELECT token, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS a,
               CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b
        FROM (SELECT y, unnest(list_distinct(toks)) AS token FROM lab_tox) GROUP BY token) c,
       (SELECT CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS na,
               CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS nb FROM lab_tox) t
  WHERE ln((a + 0.5::DOUBLE) / (na - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (nb - b + 0.5::DOUBLE)) >= 4
    AND a >= 0.2::DOUBLE * na""")

register("repl", ("pairs",), """
  SELECT src, tgt, n, n_src FROM (
    SELECT src, tgt, n, CAST(sum(n) OVER (PARTITION BY src) AS BIGINT) AS n_src,
           row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt DESC) AS rk
    FROM (SELECT src, tgt, count(*) AS n FROM (
            SELECT unnest(string_split(toxic, ' ')) AS src, unnest(string_split(neutral1, ' ')) AS tgt FROM pairs
            WHERE len(string_split(toxic, ' ')) = len(string_split(neutral1, ' '))) GROUP BY src, tgt))
  WHERE rk = 1 AND src <> tgt""")

register("sent_pos", ("sentences",), """
  SELECT pair_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM sentences""")

# a text as the pieces that cover it, and which of them are words of the lexicon or have a replacement
_PIECES = r"regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*|\p{N}+|[\x09-\x0D\x20]+|[^\p{L}\p{N}\x09-\x0D\x20]')"
register("doc_pieces", (), f"""
  SELECT doc_id, p AS ps, unnest(p) AS piece, unnest(range(len(p))) AS ix FROM (SELECT doc_id, {_PIECES} AS p FROM documents)""")
register("texts_deleted", ("doc_pieces", "lexicon"), """
  SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.rewritten, '') END AS rewritten
  FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(CASE WHEN token IS NULL THEN piece ELSE '' END, '' ORDER BY ix) AS rewritten
    FROM doc_pieces LEFT JOIN lexicon ON token = lower(piece) GROUP BY doc_id) k USING (doc_id)""")

def _alignment(name: str, src: str, given: str, made: str, rounds: int = 3) -> None:
    """Rounds of expectation maximisation of word alignment, pair by pair."""
    register(f"{name}_co", (src,), f"""
  SELECT g.pair_id, g.word AS given, g.n AS n_given, m.word AS made, m.n AS n_made
  FROM (SELECT pair_id, word, count(*) AS n FROM (SELECT pair_id, unnest(string_split({given}, ' ')) AS word FROM {src})
        WHERE word <> '' GROUP BY ALL UNION ALL SELECT pair_id, '', 1 FROM {src}) g
  JOIN (SELECT pair_id, word, count(*) AS n FROM (SELECT pair_id, unnest(string_split({made}, ' ')) AS word FROM {src})
        WHERE word <> '' GROUP BY ALL) m USING (pair_id)""")
    for i in range(1, rounds + 1):
        weight, join = "c.n_given", ""
        if i > 1:
            weight, join = "c.n_given * t.p", f"JOIN {name}_{i - 1} t ON t.given = c.given AND t.made = c.made"
        register(f"{name}_{i}", (f"{name}_co", *([f"{name}_{i - 1}"] if i > 1 else [])), f"""
  SELECT given, made, s / sum(s) OVER (PARTITION BY given) AS p FROM (
    SELECT given, made, sum(share) AS s FROM (
      SELECT c.given, c.made, c.n_made * {weight} / sum({weight}) OVER (PARTITION BY c.pair_id, c.made) AS share
      FROM {name}_co c {join}) GROUP BY given, made)""")


_alignment("al_made", "pairs", "toxic", "hyp")
_alignment("al_pairs", "pairs", "hyp", "toxic")

register("bcounts", ("turn_tokens",), """
  SELECT a.token AS ctx, b.token AS token, count(*) AS n
  FROM turn_tokens a JOIN turn_tokens b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1
  GROUP BY a.token, b.token""")

register("ctot", ("bcounts",), """
  SELECT ctx, sum(n) AS total, count(*) AS k FROM bcounts GROUP BY ctx""")

register("vsz", ("turn_tokens",), """
  SELECT CAST(count(DISTINCT token) AS DOUBLE) AS v FROM turn_tokens""")

def _sample(tokens: str, counts: str, totals: str) -> str:
    key = "'42:' || CAST(t.seq_id AS VARCHAR) || ':' || CAST(t.pos AS VARCHAR)"
    return f"""
  SELECT d.seq_id, d.pos, s.token, s.n / d.total AS prob
  FROM (SELECT t.seq_id, t.pos, t.token AS ctx, c.total, {_draw(key)} % CAST(c.total AS BIGINT) AS tt
        FROM {tokens} t JOIN {totals} c ON c.ctx = t.token) d
  JOIN (SELECT ctx, token, n, sum(n) OVER (PARTITION BY ctx ORDER BY token
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hi FROM {counts}) s
    ON s.ctx = d.ctx AND d.tt >= s.cum_hi - s.n AND d.tt < s.cum_hi"""


register("sdraw", ("bcounts", "ctot", "turn_tokens"), _sample("turn_tokens", "bcounts", "ctot"))

# greedy and sampled choices at the positions of the training pairs' gold texts
register("gtok", ("pairs",), """
  SELECT pair_id AS seq_id, unnest(string_split(neutral1, ' ')) AS token,
         unnest(range(len(string_split(neutral1, ' ')))) AS pos FROM pairs""")
register("gcounts", ("gtok",), """
  SELECT a.token AS ctx, b.token AS token, count(*) AS n
  FROM gtok a JOIN gtok b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1 GROUP BY a.token, b.token""")
register("gtot", ("gcounts",), "SELECT ctx, sum(n) AS total FROM gcounts GROUP BY ctx")
register("gtrain", ("gtok", "split_def"), """
  SELECT g.* FROM gtok g JOIN split_def s ON s.pair_id = g.seq_id WHERE s.split = 'train'""")
register("gsampled", ("gtrain", "gcounts", "gtot"), _sample("gtrain", "gcounts", "gtot"))
register("ggreedy", ("gtrain", "gcounts"), """
  SELECT t.seq_id, t.pos, g.token
  FROM gtrain t JOIN (SELECT ctx, token, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS rk FROM gcounts) g
    ON g.ctx = t.token AND g.rk = 1""")
register("drawn", ("gtrain", "ggreedy", "gsampled", "pairs"), """
  SELECT k.seq_id, k.kind, coalesce(c.text, '') AS text, p.neutral1 AS gold
  FROM (SELECT DISTINCT seq_id, kind FROM gtrain, (VALUES ('greedy'), ('sampled')) v(kind)) k
  JOIN pairs p ON p.pair_id = k.seq_id
  LEFT JOIN (SELECT seq_id, 'greedy' AS kind, string_agg(token, ' ' ORDER BY pos) AS text FROM ggreedy GROUP BY seq_id
             UNION ALL
             SELECT seq_id, 'sampled' AS kind, string_agg(token, ' ' ORDER BY pos) AS text FROM gsampled GROUP BY seq_id) c
    ON c.seq_id = k.seq_id AND c.kind = k.kind""")
register("drawn_lp", ("gtrain", "gsampled"), """
  SELECT k.seq_id, coalesce(s.sum_log, 0.0) AS sum_log FROM (SELECT DISTINCT seq_id FROM gtrain) k
  LEFT JOIN (SELECT seq_id, sum(ln(prob)) AS sum_log FROM gsampled GROUP BY seq_id) s USING (seq_id)""")


def _smoothed(src: str, key: str, text_tokens: str) -> str:
    """(key, lp) smoothed add-1 bigram log-probabilities of consecutive tokens."""
    return f"""(SELECT g.{key}, ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (coalesce(t.total, 0) + (SELECT v FROM vsz))) AS lp
    FROM (SELECT a.{key}, a.tok AS ctx, b.tok AS token
          FROM (SELECT {key}, unnest({text_tokens}) AS tok, unnest(range(len({text_tokens}))) AS pos FROM {src}) a
          JOIN (SELECT {key}, unnest({text_tokens}) AS tok, unnest(range(len({text_tokens}))) AS pos FROM {src}) b
            ON a.{key} = b.{key} AND b.pos = a.pos + 1) g
    LEFT JOIN bcounts c ON c.ctx = g.ctx AND c.token = g.token
    LEFT JOIN ctot t ON t.ctx = g.ctx)"""


register("gold_ce", ("pairs", "bcounts", "ctot", "vsz"), f"""
  SELECT p.pair_id, count(l.lp) AS n_pos,
         CASE WHEN count(l.lp) > 0 THEN -sum(l.lp) / count(l.lp) END AS ce
  FROM pairs p LEFT JOIN {_smoothed('pairs', 'pair_id', "string_split(neutral1, ' ')")} l USING (pair_id)
  GROUP BY p.pair_id""")

def _bert(name: str, src: str) -> None:
    """BERTScore of a candidates view: unit token vectors, best matches, means."""
    register(f"{name}_vec", (src, "tv"), f"""
  SELECT seq_id, kind, side, pos, vec_id, list_transform(vector, lambda x: x / greatest(sqrt(list_sum(list_transform(vector, lambda y: y * y))), 1e-8)) AS u
  FROM (SELECT o.*, tv.vec_id, tv.vector FROM (
          SELECT seq_id, kind, 'c' AS side, unnest({_tok('text')}) AS token, unnest(range(len({_tok('text')}))) AS pos FROM {src}
          UNION ALL
          SELECT seq_id, kind, 'g' AS side, unnest({_tok('gold')}) AS token, unnest(range(len({_tok('gold')}))) AS pos FROM {src}) o
        JOIN tv ON tv.vec_id = (('0x' || substr(md5(o.token), 1, 8))::BIGINT) % (SELECT count(*) FROM embeddings))""")
    register(f"{name}_one", (f"{name}_vec",), f"""
  SELECT seq_id, kind, side, vec_id, any_value(u) AS u, count(*) AS n FROM {name}_vec GROUP BY seq_id, kind, side, vec_id""")
    register(name, (f"{name}_one", src), f"""
  SELECT k.seq_id, k.kind, coalesce(pp.p, 0.0) AS p, coalesce(rr.r, 0.0) AS r,
         CASE WHEN coalesce(pp.p, 0.0) + coalesce(rr.r, 0.0) > 0
              THEN 2 * pp.p * rr.r / (pp.p + rr.r) ELSE 0.0 END AS f1
  FROM (SELECT seq_id, kind FROM {src}) k
  LEFT JOIN (SELECT seq_id, kind, sum(n * best) / sum(n) AS p FROM (
        SELECT c.seq_id, c.kind, c.vec_id, any_value(c.n) AS n, max(list_dot_product(c.u, g.u)) AS best
        FROM {name}_one c JOIN {name}_one g ON c.seq_id = g.seq_id AND c.kind = g.kind AND c.side = 'c' AND g.side = 'g'
        GROUP BY c.seq_id, c.kind, c.vec_id) GROUP BY seq_id, kind) pp ON pp.seq_id = k.seq_id AND pp.kind = k.kind
  LEFT JOIN (SELECT seq_id, kind, sum(n * best) / sum(n) AS r FROM (
        SELECT g.seq_id, g.kind, g.vec_id, any_value(g.n) AS n, max(list_dot_product(g.u, c.u)) AS best
        FROM {name}_one c JOIN {name}_one g ON c.seq_id = g.seq_id AND c.kind = g.kind AND c.side = 'c' AND g.side = 'g'
        GROUP BY g.seq_id, g.kind, g.vec_id) GROUP BY seq_id, kind) rr ON rr.seq_id = k.seq_id AND rr.kind = k.kind""")


_bert("bert", "candidates")
_bert("drawn_bert", "drawn")

register("cand_tox", ("candidates", "w_tox", "prior_tox"), f"""
  SELECT seq_id, kind, CASE WHEN 1 - p >= p THEN (1 + (1 - p)) / 2 ELSE (1 - p) / 2 END AS tox
  FROM {_score('tox', 'candidates', 'seq_id, kind', 'text')}""")

register("drawn_tox", ("drawn", "w_tox", "prior_tox"), f"""
  SELECT seq_id, kind, CASE WHEN 1 - p >= p THEN (1 + (1 - p)) / 2 ELSE (1 - p) / 2 END AS tox
  FROM {_score('tox', 'drawn', 'seq_id, kind', 'text')}""")

register("rewards", ("drawn_tox", "drawn_bert"), """
  SELECT seq_id, tox_s - tox_g AS dtox, f1_s - f1_g AS dbert,
         0.2::DOUBLE * (tox_s - tox_g) + 0.8::DOUBLE * (f1_s - f1_g) AS total_reward
  FROM (SELECT t.seq_id,
               max(CASE WHEN t.kind = 'sampled' THEN t.tox END) AS tox_s,
               max(CASE WHEN t.kind = 'greedy' THEN t.tox END) AS tox_g,
               max(CASE WHEN b.kind = 'sampled' THEN b.f1 END) AS f1_s,
               max(CASE WHEN b.kind = 'greedy' THEN b.f1 END) AS f1_g
        FROM drawn_tox t JOIN drawn_bert b ON b.seq_id = t.seq_id AND b.kind = t.kind
        GROUP BY t.seq_id)
  WHERE tox_s IS NOT NULL AND tox_g IS NOT NULL""")

register("train_batches", ("split_def",), f"""
  SELECT pair_id, e.epoch,
         CAST((row_number() OVER (PARTITION BY e.epoch ORDER BY {_hkey('e.epoch', 'pair_id')}, pair_id) - 1) // 16 AS BIGINT) AS batch_id
  FROM split_def, (VALUES (99), (100)) e(epoch) WHERE split = 'train'""")

register("rl", ("rewards", "drawn_lp", "train_batches"), """
  SELECT b.epoch, b.batch_id, 1.0 * avg(r.total_reward * l.sum_log) AS rl_loss
  FROM rewards r JOIN drawn_lp l USING (seq_id) JOIN train_batches b ON b.pair_id = r.seq_id
  GROUP BY b.epoch, b.batch_id""")

register("gold_ce_pad", ("gold_ce", "vsz"), """
  SELECT pair_id, n_pos + pads AS n_pos,
         CASE WHEN n_pos + pads > 0 THEN (ce * n_pos + pads * ln((SELECT v FROM vsz))) / (n_pos + pads) END AS ce
  FROM (SELECT pair_id, n_pos, greatest(37 - n_pos, 0) AS pads, coalesce(ce, 0.0) AS ce FROM gold_ce)""")

# pair-level metric inputs (x = toxic, y_pred = hyp, y_real = neutral1)
register("pair_scores", ("all_pairs", "w_tox", "prior_tox", "w_flu", "prior_flu"), f"""
  SELECT t.pair_id, t.p AS p_toxic, f.p AS p_fluent
  FROM {_score('tox', 'all_pairs', 'pair_id', 'hyp')} t JOIN {_score('flu', 'all_pairs', 'pair_id', 'hyp')} f USING (pair_id)""")

register("pair_emb", ("all_pairs", "tv"), f"""
  SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.dim, y.dim) AS dim, x.v AS xv, y.v AS yv
  FROM {_emb('all_pairs', 'pair_id', 'toxic')} x FULL JOIN {_emb('all_pairs', 'pair_id', 'hyp')} y
    ON x.pair_id = y.pair_id AND x.dim = y.dim""")


def _bleu(src: str, key: str, hyp: str, ref: str, unit: str) -> str:
    """Sentence BLEU per row of ``src`` (subquery with columns k, bleu)."""
    if unit == "word":
        def toks(c):
            return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"

        def grams(c, n):
            return f"list_transform(range(1, len({toks(c)}) - {n} + 2), lambda i: array_to_string({toks(c)}[i:i + {n} - 1], ' '))"

        def ln_(c):
            return f"len({toks(c)})"
    else:
        def grams(c, n):
            return f"list_transform(range(1, length({c}) - {n} + 2), lambda i: substr({c}, i, {n}))"

        def ln_(c):
            return f"length({c})"
    parts = []
    for n in range(1, 5):
        parts.append(f"SELECT {key} AS k, {n} AS n, unnest({grams(hyp, n)}) AS gram, 1 AS h, 0 AS r FROM {src}")
        parts.append(f"SELECT {key} AS k, {n} AS n, unnest({grams(ref, n)}) AS gram, 0 AS h, 1 AS r FROM {src}")
    g = "\n      UNION ALL ".join(parts)
    terms = " + ".join(
        f"ln(CASE WHEN coalesce(n{n}, 0) > 0 THEN n{n} / greatest(1.0::DOUBLE, c - {n} + 1) "
        f"ELSE 2.2250738585072014e-308::DOUBLE END) / 4" for n in range(1, 5))
    return f"""(SELECT s.k, CASE WHEN coalesce(n1, 0) = 0 THEN 0.0::DOUBLE ELSE
        (CASE WHEN c > rl THEN 1.0::DOUBLE WHEN c = 0 THEN 0.0::DOUBLE ELSE exp(1 - rl / c) END) * exp({terms}) END AS bleu
    FROM (SELECT {key} AS k, CAST({ln_(hyp)} AS DOUBLE) AS c, CAST({ln_(ref)} AS DOUBLE) AS rl FROM {src}) s
    LEFT JOIN (SELECT k, {', '.join(f'CAST(max(CASE WHEN n = {n} THEN num END) AS DOUBLE) AS n{n}' for n in range(1, 5))}
               FROM (SELECT k, n, sum(least(ch, cr)) AS num
                     FROM (SELECT k, n, gram, sum(h) AS ch, sum(r) AS cr FROM (
      {g}
                           ) GROUP BY k, n, gram) GROUP BY k, n)
               GROUP BY k) p ON p.k = s.k)"""


register("pair_bleu", ("all_pairs",), f"SELECT k AS pair_id, bleu FROM {_bleu('all_pairs', 'pair_id', 'hyp', 'neutral1', 'char')}")

register("pair_rows", ("pair_bleu", "pair_scores", "pair_batches"), """
  SELECT b.pair_id, pb.batch_id, b.bleu, s.p_toxic, s.p_fluent
  FROM pair_bleu b JOIN pair_scores s USING (pair_id) JOIN pair_batches pb USING (pair_id)""")

register("pair_batch_sim", ("pair_emb", "pair_batches"), """
  SELECT batch_id, sum(mx * my) / (greatest(sqrt(sum(mx * mx)), 1e-8) * greatest(sqrt(sum(my * my)), 1e-8)) AS sim
  FROM (SELECT b.batch_id, e.dim, avg(e.xv) AS mx, avg(e.yv) AS my
        FROM pair_emb e JOIN pair_batches b USING (pair_id) GROUP BY b.batch_id, e.dim)
  GROUP BY batch_id""")

register("pair_batch_metrics", ("pair_rows", "pair_batch_sim"), """
  SELECT r.batch_id, count(*) AS n_rows, avg(r.bleu) AS bleu,
         avg(CASE WHEN r.p_toxic < 0.8::DOUBLE THEN 1.0 ELSE 0.0 END) AS sta,
         avg(CASE WHEN r.p_fluent >= 0.5::DOUBLE THEN 1.0 ELSE 0.0 END) AS fl,
         any_value(s.sim) AS sim
  FROM pair_rows r JOIN pair_batch_sim s USING (batch_id)
  GROUP BY r.batch_id""")

# evaluation of two runs' three epochs on the validation split
def _lexicon(labels: str) -> str:
    """The lexicon's words learned from some of the labels."""
    return f"""
  SELECT token FROM (
    SELECT token, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b
    FROM (SELECT doc_id, y, unnest(list_distinct(toks)) AS token FROM lab_tox) WHERE {labels} GROUP BY token),
    (SELECT CAST(count(*) FILTER (y = 1) AS DOUBLE) AS na, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS nb FROM lab_tox WHERE {labels})
  WHERE ln((a + 0.5::DOUBLE) / (na - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (nb - b + 0.5::DOUBLE)) >= 4 AND a >= 0.2::DOUBLE * na"""


for _e, _some in ((1, "{} % 2 = 0"), (2, "true")):
    register(f"learned_words_{_e}", ("lab_tox",), _lexicon(_some.format("doc_id")))
    register(f"learned_targets_{_e}", ("pairs", "all_split"), f"""
  SELECT src, tgt FROM (
    SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt DESC) AS rk
    FROM (SELECT src, tgt, count(*) AS n FROM (
            SELECT unnest(string_split(toxic, ' ')) AS src, unnest(string_split(neutral1, ' ')) AS tgt
            FROM pairs JOIN all_split USING (pair_id)
            WHERE split = 'train' AND {_some.format('pair_id')} AND len(string_split(toxic, ' ')) = len(string_split(neutral1, ' ')))
          GROUP BY src, tgt))
  WHERE rk = 1 AND src <> tgt""")

register("val_pairs", ("all_pairs", "all_split"), """
  SELECT p.*, s.split_rank FROM all_pairs p JOIN all_split s USING (pair_id) WHERE s.split = 'val'""")
register("val_tokens", ("val_pairs",), """
  SELECT pair_id, unnest(string_split(toxic, ' ')) AS token, unnest(range(len(string_split(toxic, ' ')))) AS pos FROM val_pairs""")


def _epoch(e: int) -> str:
    return f"""
  SELECT p.pair_id, 'delete' AS run_id, {e} AS epoch, p.toxic AS x, p.neutral1 AS y_real, coalesce(k.text, '') AS y_pred
  FROM val_pairs p LEFT JOIN (SELECT pair_id, string_agg(token, ' ' ORDER BY pos) AS text FROM val_tokens
                              WHERE token NOT IN (SELECT token FROM learned_words_{e}) GROUP BY pair_id) k USING (pair_id)
  UNION ALL
  SELECT p.pair_id, 'replace', {e}, p.toxic, p.neutral1, k.text
  FROM val_pairs p JOIN (SELECT pair_id, string_agg(coalesce(tgt, token), ' ' ORDER BY pos) AS text FROM val_tokens
                         LEFT JOIN learned_targets_{e} ON src = token GROUP BY pair_id) k USING (pair_id)"""


register("ev", ("val_pairs", "val_tokens", *[f"learned_{x}_{e}" for x in ("words", "targets") for e in (1, 2)]), f"""
  SELECT *, run_id || ':' || CAST(epoch AS VARCHAR) || ':' || CAST(pair_id AS VARCHAR) AS rk FROM (
  SELECT pair_id, r.run_id, 0 AS epoch, toxic AS x, neutral1 AS y_real, toxic AS y_pred
  FROM val_pairs, (VALUES ('delete'), ('replace')) r(run_id) UNION ALL {_epoch(1)} UNION ALL {_epoch(2)})""")

register("ev_batches", ("ev", "val_pairs"), """
  SELECT e.rk, e.run_id, e.epoch, CAST((s.split_rank - 1) // 16 AS BIGINT) AS batch_id
  FROM ev e JOIN val_pairs s ON s.pair_id = e.pair_id""")

register("val_ce", ("val_pairs", "bcounts", "ctot", "vsz"), f"""
  SELECT pair_id, CASE WHEN n + pads > 0 THEN (pads * ln((SELECT v FROM vsz)) - s) / (n + pads) END AS ce
  FROM (SELECT p.pair_id, count(l.lp) AS n, coalesce(sum(l.lp), 0) AS s, greatest(37 - count(l.lp), 0) AS pads
        FROM val_pairs p LEFT JOIN {_smoothed('val_pairs', 'pair_id', "string_split(neutral1, ' ')")} l USING (pair_id) GROUP BY p.pair_id)""")

register("ev_ce", ("ev", "val_ce"), """
  SELECT e.rk, g.ce FROM ev e JOIN val_ce g ON g.pair_id = e.pair_id""")

register("ev_rows", ("ev", "w_tox", "prior_tox", "w_flu", "prior_flu", "ev_ce"), f"""
  SELECT b.rk, b.bleu, t.p AS p_toxic, f.p AS p_fluent, c.ce
  FROM {_bleu('ev', 'rk', 'y_pred', 'y_real', 'char')} b
  JOIN {_score('tox', 'ev', 'rk', 'y_pred')} t ON t.rk = b.k
  JOIN {_score('flu', 'ev', 'rk', 'y_pred')} f ON f.rk = b.k
  JOIN ev_ce c ON c.rk = b.k""".replace("SELECT b.rk,", "SELECT b.k AS rk,"))

register("ev_emb", ("ev", "tv"), f"""
  SELECT coalesce(x.rk, y.rk) AS rk, coalesce(x.dim, y.dim) AS dim, x.v AS xv, y.v AS yv
  FROM {_emb('ev', 'rk', 'x')} x FULL JOIN {_emb('ev', 'rk', 'y_pred')} y ON x.rk = y.rk AND x.dim = y.dim""")

register("ev_batch", ("ev_rows", "ev_batches", "ev_emb"), """
  SELECT m.run_id, m.epoch, m.batch_id, m.loss, m.bleu, m.sta, m.fl, s.sim, m.sta * s.sim * m.fl AS j
  FROM (SELECT b.run_id, b.epoch, b.batch_id, avg(r.ce) AS loss, avg(r.bleu) AS bleu,
               avg(CASE WHEN r.p_toxic < 0.8::DOUBLE THEN 1.0 ELSE 0.0 END) AS sta,
               avg(CASE WHEN r.p_fluent >= 0.5::DOUBLE THEN 1.0 ELSE 0.0 END) AS fl
        FROM ev_rows r JOIN ev_batches b USING (rk) GROUP BY b.run_id, b.epoch, b.batch_id) m
  JOIN (SELECT run_id, epoch, batch_id,
               sum(mx * my) / (greatest(sqrt(sum(mx * mx)), 1e-8) * greatest(sqrt(sum(my * my)), 1e-8)) AS sim
        FROM (SELECT b.run_id, b.epoch, b.batch_id, e.dim, avg(e.xv) AS mx, avg(e.yv) AS my
              FROM ev_emb e JOIN ev_batches b USING (rk) GROUP BY b.run_id, b.epoch, b.batch_id, e.dim)
        GROUP BY run_id, epoch, batch_id) s
    ON s.run_id = m.run_id AND s.epoch = m.epoch AND s.batch_id = m.batch_id""")

register("evaluation", ("ev_batch",), """
  SELECT run_id, CAST(epoch AS BIGINT) AS epoch, count(*) AS n_batches, avg(loss) AS loss, avg(bleu) AS bleu,
         avg(sta) AS sta, avg(sim) AS sim, avg(fl) AS fl, avg(j) AS j
  FROM ev_batch GROUP BY run_id, epoch""")

register("loss_means", ("losses",), """
  SELECT run_id, epoch, avg(loss) AS mean_loss, count(*) AS n_batches FROM losses GROUP BY run_id, epoch""")

METRICS = ("bleu", "sta", "sim", "fl", "j")

# a Poisson bootstrap: the distribution function of mean one, in 60 bits
_POISSON, _p, _sum = [], math.exp(-1), 0.0
for _k in range(18):
    _sum += _p
    _bound = int(_sum * 2 ** 60)
    if _bound >= 2 ** 60 - 1 or _POISSON and _bound <= _POISSON[-1]:
        break
    _POISSON.append(_bound)
    _p /= _k + 1
register("boot_rows", ("ev", "ev_rows"), """
  SELECT e.pair_id, e.run_id, e.epoch, r.bleu, CASE WHEN r.p_toxic < 0.8::DOUBLE THEN 1.0 ELSE 0.0 END AS sta,
         CASE WHEN r.p_fluent >= 0.5::DOUBLE THEN 1.0 ELSE 0.0 END AS fl
  FROM ev e JOIN ev_rows r USING (rk)""")
register("boot_means", ("boot_rows",), f"""
  SELECT run_id, epoch, i, sum(w * bleu) / sum(w) AS bleu, sum(w * sta) / sum(w) AS sta, sum(w * fl) / sum(w) AS fl
  FROM (SELECT *, {" + ".join(f"(d >= {b})::INT" for b in _POISSON)} AS w
        FROM (SELECT *, {_draw("'42:' || CAST(i AS VARCHAR) || ':' || CAST(pair_id AS VARCHAR)")} AS d
              FROM boot_rows, (SELECT unnest(range(100)) AS i))) GROUP BY run_id, epoch, i""")

# the judge of three fifths, its scores of the others, and the best rising function of those of one fifth
for _f, _where in (("cal_fit", "l.doc_id % 5 > 1"), ("cal_one", "l.doc_id % 5 = 1"), ("cal_held", "l.doc_id % 5 = 0")):
    register(f"{_f}_docs", (), f"""
  SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS y, {_tok('d.text')} AS toks
  FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND {_where}""")
register("cal_w", ("cal_fit_docs",), """
  SELECT token, ln((a + 1) / (na + k)) - ln((b + 1) / (nb + k)) AS w
  FROM (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb, CAST(count(*) OVER () AS DOUBLE) AS k
        FROM (SELECT token, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS b
              FROM (SELECT y, unnest(toks) AS token FROM cal_fit_docs) GROUP BY token))""")
for _f in ("cal_one", "cal_held"):
    register(f"{_f}_s", (f"{_f}_docs", "cal_fit_docs", "cal_w"), f"""
  SELECT d.doc_id, d.y, round((SELECT ln(avg(y)) - ln(1 - avg(y)) FROM cal_fit_docs) + coalesce(s.sw, 0), 9) AS score
  FROM {_f}_docs d LEFT JOIN (SELECT doc_id, sum(w) AS sw FROM (SELECT doc_id, unnest(toks) AS token FROM {_f}_docs)
                              JOIN cal_w USING (token) GROUP BY doc_id) s USING (doc_id)""")
register("cal_points", ("cal_one_s",), """
  SELECT score, row_number() OVER (ORDER BY score) AS i, sum(sum(y)) OVER (ORDER BY score) AS ys, sum(count(*)) OVER (ORDER BY score) AS ns
  FROM cal_one_s GROUP BY score""")
register("cal_f", ("cal_points",), """
  SELECT score, i, max(least_mean) AS f FROM (
    SELECT p.score, p.i, a.i AS first, min((b.ys - coalesce(z.ys, 0)) / CAST(b.ns - coalesce(z.ns, 0) AS DOUBLE)) AS least_mean
    FROM cal_points p JOIN cal_points a ON a.i <= p.i JOIN cal_points b ON b.i >= p.i LEFT JOIN cal_points z ON z.i = a.i - 1
    GROUP BY p.score, p.i, a.i) GROUP BY score, i""")

# words that stand at most two places apart, and their positive mutual information
register("near", ("turn_tokens",), """
  SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT x.token AS a, y.token AS b, count(*) AS n FROM turn_tokens x
    JOIN turn_tokens y ON y.seq_id = x.seq_id AND abs(y.pos - x.pos) BETWEEN 1 AND 2 GROUP BY ALL) GROUP BY a, b""")
register("pmi", ("near",), """
  SELECT a, b, n, x FROM (
    SELECT n.a, n.b, n.n, ln(CAST(n.n AS DOUBLE) * (SELECT sum(n) FROM near) / (CAST(s.s AS DOUBLE) * t.s)) AS x
    FROM near n JOIN (SELECT a, CAST(sum(n) AS DOUBLE) AS s FROM near GROUP BY a) s ON s.a = n.a
    JOIN (SELECT a, CAST(sum(n) AS DOUBLE) AS s FROM near GROUP BY a) t ON t.a = n.b) WHERE round(x, 12) > 0""")

# interpolated Kneser-Ney of order three
register("kn_grams", (), """
  SELECT conv_id, seq_id, t[i] AS u, t[i + 1] AS v, t[i + 2] AS w
  FROM (SELECT conv_id, seq_id, t, unnest(range(1, len(t) - 1)) AS i
        FROM (SELECT conv_id, conv_id * 16777216 + turn AS seq_id,
                     ['<s>', '<s>'] || regexp_extract_all(lower(text), '[a-zß-ÿ]+') || ['</s>'] AS t
              FROM conversations WHERE text IS NOT NULL))""")
register("kn3", ("kn_grams",), "SELECT u, v, w, count(*) AS c FROM kn_grams WHERE conv_id % 5 <> 0 GROUP BY u, v, w")
register("kn3t", ("kn3",), "SELECT u, v, sum(c) AS c, count(*) AS k FROM kn3 GROUP BY u, v")
register("kn2", ("kn3",), "SELECT v, w, count(*) AS c FROM kn3 GROUP BY v, w")
register("kn2t", ("kn2",), "SELECT v, sum(c) AS c, count(*) AS k FROM kn2 GROUP BY v")
register("kn1", ("kn2",), """
  SELECT w, (c - 0.75::DOUBLE) / t + 0.75::DOUBLE * k / t / (k + 1) AS p
  FROM (SELECT w, c, sum(c) OVER () AS t, count(*) OVER () AS k FROM (SELECT w, count(*) AS c FROM kn2 GROUP BY w))""")
register("kn_floor", ("kn2",), """
  SELECT 0.75::DOUBLE * count(DISTINCT w) / count(*) / (count(DISTINCT w) + 1) AS p FROM kn2""")
register("kn_p", ("kn_grams", "kn3", "kn3t", "kn2", "kn2t", "kn1", "kn_floor"), """
  SELECT seq_id, CASE WHEN t3.c IS NULL THEN p2 ELSE (greatest(coalesce(c3.c, 0) - 0.75::DOUBLE, 0) + 0.75::DOUBLE * t3.k * p2) / t3.c END AS p
  FROM (SELECT g.*, CASE WHEN t2.c IS NULL THEN p1
                         ELSE (greatest(coalesce(c2.c, 0) - 0.75::DOUBLE, 0) + 0.75::DOUBLE * t2.k * p1) / t2.c END AS p2
        FROM (SELECT g.*, coalesce(o.p, (SELECT p FROM kn_floor)) AS p1 FROM kn_grams g LEFT JOIN kn1 o USING (w) WHERE conv_id % 5 = 0) g
        LEFT JOIN kn2 c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN kn2t t2 ON t2.v = g.v) g
  LEFT JOIN kn3 c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN kn3t t3 ON t3.u = g.u AND t3.v = g.v""")

# phrases of up to three words by log-odds, without those that tell no more than one inside them
_GRAMS = " || ".join(f"list_transform(range(1, len(toks) - {n} + 2), lambda i: array_to_string(toks[i:i + {n - 1}], ' '))" for n in (1, 2, 3))
register("phrase_lo", ("lab_tox",), f"""
  SELECT phrase, a, b, ln((a + 0.5::DOUBLE) / (na - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (nb - b + 0.5::DOUBLE)) AS lo, na
  FROM (SELECT phrase, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b
        FROM (SELECT y, unnest(list_distinct({_GRAMS})) AS phrase FROM lab_tox) GROUP BY phrase),
       (SELECT CAST(count(*) FILTER (y = 1) AS DOUBLE) AS na, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS nb FROM lab_tox)""")
register("phrase_kept", ("phrase_lo",), """
  SELECT phrase, string_split(phrase, ' ') AS ws, a, b, lo FROM phrase_lo WHERE a > 0 AND lo >= 4 AND a >= 0.2::DOUBLE * na""")
register("phrases", ("phrase_kept",), """
  SELECT k.phrase, CAST(len(k.ws) AS BIGINT) AS words, k.a, k.b, k.lo FROM phrase_kept k
  WHERE NOT EXISTS (SELECT 1 FROM phrase_kept p WHERE p.phrase <> k.phrase AND round(p.lo, 9) >= round(k.lo, 9)
                    AND contains(' ' || k.phrase || ' ', ' ' || p.phrase || ' '))""")
register("phrase_hits", ("sentences", "phrases"), """
  SELECT pair_id, start, max(n) AS n FROM (
    SELECT s.pair_id, s.start, s.n FROM (
      SELECT pair_id, start, n, array_to_string(tokens[start:start + n - 1], ' ') AS phrase
      FROM (SELECT pair_id, tokens, unnest(range(1, len(tokens) + 1)) AS start FROM sentences), (VALUES (1), (2), (3)) v(n)
      WHERE start + n - 1 <= len(tokens)) s JOIN phrases USING (phrase))
  GROUP BY pair_id, start""")
register("taken_recursive", ("phrase_hits",), """
  SELECT pair_id, start, n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY start) AS r FROM phrase_hits) WHERE r = 1
  UNION ALL
  SELECT pair_id, start, n FROM (
    SELECT h.pair_id, h.start, h.n, row_number() OVER (PARTITION BY h.pair_id ORDER BY h.start) AS r
    FROM taken_recursive t JOIN phrase_hits h ON h.pair_id = t.pair_id AND h.start >= t.start + t.n) WHERE r = 1""")


def _held_out() -> str:
    """The naive Bayes judge fitted on four fifths of the labels, on the rest."""
    def occ(where: str) -> str:
        return f"""SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS y, unnest({_tok('d.text')}) AS token
          FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND {where}"""
    return f"""
  WITH c AS (SELECT token, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS b
             FROM ({occ('l.doc_id % 5 <> 0')}) GROUP BY token),
       t AS (SELECT sum(a) AS na, sum(b) AS nb, CAST(count(*) AS DOUBLE) AS k FROM c),
       w AS (SELECT token, ln((a + 1) / (na + k)) - ln((b + 1) / (nb + k)) AS w FROM c, t),
       m AS (SELECT ln(avg(toxic)) - ln(1 - avg(toxic)) AS prior FROM labels JOIN documents USING (doc_id)
             WHERE toxic IS NOT NULL AND doc_id % 5 <> 0),
       s AS (SELECT o.doc_id, sum(coalesce(w.w, 0)) AS sw FROM ({occ('l.doc_id % 5 = 0')}) o LEFT JOIN w USING (token) GROUP BY o.doc_id)
  SELECT CAST(l.toxic AS BIGINT) AS y, 1 / (1 + exp(-((SELECT prior FROM m) + coalesce(s.sw, 0)))) >= 0.5::DOUBLE AS predicted, count(*) AS n
  FROM labels l JOIN documents d USING (doc_id) LEFT JOIN s USING (doc_id)
  WHERE l.toxic IS NOT NULL AND l.doc_id % 5 = 0 GROUP BY ALL"""


def _q() -> dict[str, tuple[str, tuple[str, ...]]]:
    """name -> (body, views)."""
    lexdel = """
  SELECT s.pair_id, coalesce(k.text, '') AS text
  FROM sentences s LEFT JOIN (
      SELECT pair_id, string_agg(token, ' ' ORDER BY pos) AS text
      FROM sent_pos WHERE token NOT IN (SELECT token FROM lexicon) GROUP BY pair_id) k USING (pair_id)"""
    return {
        "read_pairs": ("SELECT pair_id, toxic, neutral1 FROM pairs", ("pairs",)),
        "prediction_sink": (f"SELECT '2025-02-03,04-05-06' AS run_id, pair_id, text FROM ({lexdel})",
                            ("sentences", "sent_pos", "lexicon")),
        "snapshot_roundtrip": ("SELECT token, a, b, round(lo, 6) AS lo FROM lexicon", ("lexicon",)),
        "build_vocab": ("SELECT token, id, n FROM vocab", ("vocab",)),
        "encode_pad": ("""SELECT pair_id, array_to_string(input_ids, ',') AS input_ids,
                                 array_to_string(detoxified_ids, ',') AS detoxified_ids FROM encoded""", ("encoded",)),
        "attention_mask": ("""SELECT pair_id,
                array_to_string(list_transform(input_ids, lambda t: CASE WHEN t <> 1 THEN 1 ELSE 0 END), ',') AS input_mask,
                CAST(len(list_filter(input_ids, lambda t: t <> 1)) AS BIGINT) AS n_attended FROM encoded""", ("encoded",)),
        "strip_special": ("""SELECT pair_id, array_to_string(list_filter(input_ids, lambda t: t NOT IN (0, 1, 2)), ',') AS word_ids
                             FROM encoded""", ("encoded",)),
        "length_gate": ("""SELECT pair_id, CASE WHEN len(tokens) + 2 <= 38 THEN 'ok' ELSE 'too_long' END AS status
                           FROM sentences""", ("sentences",)),
        "encode_rejects": ("""SELECT pair_id, 'too_long' AS reason FROM pairs
                              WHERE len(string_split(toxic, ' ')) > 36 OR len(string_split(neutral1, ' ')) > 36""", ("pairs",)),
        "decode_text": ("""SELECT pair_id, toxic AS text FROM pairs WHERE len(string_split(toxic, ' ')) <= 36""", ("pairs",)),
        "stack_rows": ("""SELECT pair_id, CAST(len(input_ids) AS BIGINT) AS n_input, CAST(len(detoxified_ids) AS BIGINT) AS n_target,
                          CAST(len(input_ids) AS BIGINT) AS n_mask FROM encoded""", ("encoded",)),
        "global_rank": ("SELECT pair_id, r AS rank FROM pair_rank", ("pair_rank",)),
        "random_split": ("SELECT pair_id, split, split_rank FROM split_def", ("split_def",)),
        "epoch_shuffle": (f"""SELECT pair_id, CAST(e.epoch AS BIGINT) AS epoch,
                row_number() OVER (PARTITION BY e.epoch ORDER BY {_hkey('e.epoch', 'pair_id')}, pair_id) AS epoch_rank
                FROM split_def, (VALUES (0), (1), (2)) e(epoch) WHERE split = 'train'""", ("split_def",)),
        "batch_assign": (f"""
                SELECT *, batch_id + 1 AS step FROM (
                SELECT pair_id, split, CAST(e.epoch AS BIGINT) AS epoch,
                       CAST((row_number() OVER (PARTITION BY e.epoch ORDER BY {_hkey('e.epoch', 'pair_id')}, pair_id) - 1) // 16 AS BIGINT) AS batch_id
                FROM split_def, (VALUES (0), (1)) e(epoch) WHERE split = 'train'
                UNION ALL
                SELECT pair_id, split, CAST(e.epoch AS BIGINT) AS epoch, CAST((split_rank - 1) // 16 AS BIGINT) AS batch_id
                FROM split_def, (VALUES (0), (1)) e(epoch) WHERE split <> 'train')""", ("split_def",)),
        "split_sizes": ("""SELECT split, count(*) AS n, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_batches
                           FROM split_def GROUP BY split""", ("split_def",)),
        "char_bleu": (f"SELECT k AS pair_id, round(bleu, 6) AS bleu FROM {_bleu('all_pairs', 'pair_id', 'hyp', 'neutral1', 'char')}",
                      ("all_pairs",)),
        "char_bleu_relational": (f"SELECT k AS pair_id, round(bleu, 6) AS bleu FROM {_bleu('pairs', 'pair_id', 'hyp', 'neutral1', 'char')}",
                                 ("pairs",)),
        "word_bleu": (f"SELECT k AS pair_id, round(bleu, 6) AS bleu FROM {_bleu('all_pairs', 'pair_id', 'hyp', 'neutral1', 'word')}",
                      ("all_pairs",)),
        "style_accuracy": ("SELECT batch_id, round(sta, 6) AS sta FROM pair_batch_metrics", ("pair_batch_metrics",)),
        "similarity_batch": ("SELECT batch_id, round(sim, 6) AS sim FROM pair_batch_sim", ("pair_batch_sim",)),
        "similarity_pair": ("""
            SELECT b.batch_id, round(avg(c.cos), 6) AS sim
            FROM (SELECT pair_id, sum(xv * yv) / (greatest(sqrt(sum(xv * xv)), 1e-8) * greatest(sqrt(sum(yv * yv)), 1e-8)) AS cos
                  FROM pair_emb GROUP BY pair_id) c JOIN pair_batches b USING (pair_id)
            GROUP BY b.batch_id""", ("pair_emb", "pair_batches")),
        "fluency": ("SELECT batch_id, round(fl, 6) AS fl FROM pair_batch_metrics", ("pair_batch_metrics",)),
        "batch_metrics": ("""SELECT batch_id, n_rows, round(bleu, 6) AS bleu, round(sta, 6) AS sta, round(sim, 6) AS sim,
                                    round(fl, 6) AS fl, round(round(sta * sim * fl, 9), 6) AS j FROM pair_batch_metrics""",
                          ("pair_batch_metrics",)),
        "evaluate": ("""SELECT run_id, epoch, n_batches, round(loss, 6) AS loss, round(bleu, 6) AS bleu, round(sta, 6) AS sta,
                               round(sim, 6) AS sim, round(fl, 6) AS fl, round(j, 6) AS j FROM evaluation""", ("evaluation",)),
        "metrics_log_lines": ("""SELECT run_id, epoch,
                printf('Epoch %d: Loss %.4f, BLEU %.4f, STA %.4f, SIM %.4f, FL %.4f, J %.4f', epoch + 1, loss, bleu, sta, sim, fl, j) AS line
                FROM evaluation""", ("evaluation",)),
        "read_metrics_log": ("SELECT run_id, epoch + 1 AS epoch, " + ", ".join(
            f"CAST(printf('%.4f', {c}) AS DOUBLE) AS {c}" for c in ("loss", *METRICS)) + " FROM evaluation", ("evaluation",)),
        "metrics_long": (" UNION ALL ".join(
            f"SELECT run_id, epoch, '{c}' AS metric, round({c}, 6) AS value FROM evaluation" for c in ("loss", *METRICS)),
            ("evaluation",)),
        "run_summary": ("""
            SELECT run_id, count(*) AS n_epochs, max(epoch) AS last_epoch,
                   max(CASE WHEN jr = 1 THEN epoch END) AS best_j_epoch, round(max(j), 6) AS best_j,
                   round(min(loss), 6) AS min_loss, max(CASE WHEN lr = 1 THEN epoch END) AS min_loss_epoch,
                   round(max(CASE WHEN er = 1 THEN bleu END), 6) AS last_bleu, round(max(CASE WHEN er = 1 THEN sta END), 6) AS last_sta,
                   round(max(CASE WHEN er = 1 THEN sim END), 6) AS last_sim, round(max(CASE WHEN er = 1 THEN fl END), 6) AS last_fl,
                   round(max(CASE WHEN er = 1 THEN j END), 6) AS last_j
            FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(j, 9) DESC, epoch) AS jr,
                         row_number() OVER (PARTITION BY run_id ORDER BY round(loss, 9), epoch) AS lr,
                         row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS er FROM evaluation)
            GROUP BY run_id""", ("evaluation",)),
        "epoch_axis": ("""
            SELECT run_id, epoch, 1 + (row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1) * 2 AS axis,
                   round(mean_loss, 6) AS mean_loss
            FROM loss_means WHERE epoch % 2 = 0""", ("loss_means",)),
        "mean_loss": ("SELECT run_id, epoch, round(mean_loss, 6) AS mean_loss, n_batches FROM loss_means", ("loss_means",)),
        "toxicity_judge": (f"""
            SELECT x.pair_id, round(x.p, 6) AS p_toxic_x, round(y.p, 6) AS p_toxic_hyp
            FROM {_score('tox', 'all_pairs', 'pair_id', 'toxic')} x JOIN {_score('tox', 'all_pairs', 'pair_id', 'hyp')} y USING (pair_id)""",
                           ("all_pairs", "w_tox", "prior_tox")),
        "judge_distribution": (f"""
            SELECT seq_id, kind, round(p0, 6) AS p0, round(p1, 6) AS p1, CAST(CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS BIGINT) AS argmax,
                   round(greatest(p0, p1), 6) AS p_argmax,
                   round(CASE WHEN p0 >= p1 THEN (1 + p0) / 2 ELSE (1 - p1) / 2 END, 6) AS tox
            FROM (SELECT seq_id, kind, 1 - p AS p0, p AS p1 FROM {_score('tox', 'candidates', 'seq_id, kind', 'text')})""",
                               ("candidates", "w_tox", "prior_tox")),
        "toxicity_score": ("SELECT seq_id, kind, round(tox, 6) AS tox FROM cand_tox", ("cand_tox",)),
        "fluency_judge": (f"""
            SELECT pair_id, round(p, 6) AS p_fluent, CASE WHEN p >= 0.5::DOUBLE THEN 'LABEL_1' ELSE 'LABEL_0' END AS label
            FROM {_score('flu', 'all_pairs', 'pair_id', 'hyp')}""", ("all_pairs", "w_flu", "prior_flu")),
        "sentence_embedding": (f"""
            SELECT pair_id, max(dim) + 1 AS dim, round(sum(v), 6) + 0.0 AS total, round(sqrt(sum(v * v)), 6) AS norm
            FROM {_emb('all_pairs', 'pair_id', 'toxic')} GROUP BY pair_id""", ("all_pairs", "tv")),
        "detox_lexicon": ("SELECT token, a, b, round(lo, 6) AS lo FROM lexicon", ("lexicon",)),
        "replacement_table": ("SELECT src, tgt, n, n_src FROM repl", ("repl",)),
        "rewrite_delete": (lexdel, ("sentences", "sent_pos", "lexicon")),
        "rewrite_replace": ("""
            SELECT s.pair_id, coalesce(k.text, '') AS text
            FROM sentences s LEFT JOIN (
                SELECT p.pair_id, string_agg(coalesce(r.tgt, p.token), ' ' ORDER BY p.pos) AS text
                FROM sent_pos p LEFT JOIN repl r ON r.src = p.token GROUP BY p.pair_id) k USING (pair_id)""",
                            ("sentences", "sent_pos", "repl")),
        "numpy_scorer": (f"""
            SELECT p.pair_id, round(1 / (1 + exp(-(-4.0::DOUBLE + coalesce(s.sl, 0.0)))), 6) AS p_lexicon
            FROM all_pairs p LEFT JOIN (
                SELECT pair_id, sum(lo) AS sl
                FROM (SELECT pair_id, unnest({_tok('toxic')}) AS token FROM all_pairs) JOIN lexicon USING (token)
                GROUP BY pair_id) s USING (pair_id)""", ("all_pairs", "lexicon")),
        "bootstrap_intervals": (" UNION ALL ".join(f"""
            SELECT run_id, CAST(epoch AS BIGINT) AS epoch, '{c}' AS metric, round(m, 6) AS mean,
                   round(quantile_cont({c}, 0.05::DOUBLE), 6) AS low, round(quantile_cont({c}, 0.95::DOUBLE), 6) AS high
            FROM boot_means JOIN (SELECT run_id, epoch, avg({c}) AS m FROM boot_rows GROUP BY run_id, epoch) USING (run_id, epoch)
            GROUP BY run_id, epoch, m""" for c in ("bleu", "sta", "fl")), ("boot_means", "boot_rows")),
        "calibrated_judge": ("""
            SELECT doc_id, CAST(y AS BIGINT) AS y, round(score, 6) AS score,
                   round(CASE WHEN lo.i IS NULL THEN hi.f WHEN hi.i IS NULL OR hi.score = lo.score THEN lo.f
                              ELSE lo.f + (hi.f - lo.f) * (s.score - lo.score) / (hi.score - lo.score) END, 6) AS p
            FROM (SELECT h.*, (SELECT max(i) FROM cal_f WHERE score <= h.score) AS below, (SELECT min(i) FROM cal_f WHERE score >= h.score) AS above
                  FROM cal_held_s h) s
            LEFT JOIN (SELECT i, score, f FROM cal_f) lo ON lo.i = s.below LEFT JOIN (SELECT i, score, f FROM cal_f) hi ON hi.i = s.above"""
                             .replace("round(score, 6)", "round(s.score, 6)"), ("cal_f", "cal_held_s")),
        "kneser_ney_logprob": ("""
            SELECT seq_id, count(*) AS n_pos, round(sum(ln(p)), 6) AS logp, round(exp(-sum(ln(p)) / count(*)), 6) AS ppl
            FROM kn_p GROUP BY seq_id""", ("kn_p",)),
        "detox_phrases": ("SELECT phrase, words, a, b, round(lo, 6) AS lo FROM phrases", ("phrases",)),
        "rewrite_phrases": ("""
            SELECT s.pair_id, coalesce(k.text, '') AS text FROM sentences s LEFT JOIN (
              SELECT p.pair_id, string_agg(p.token, ' ' ORDER BY p.pos) AS text FROM sent_pos p
              LEFT JOIN taken_recursive t ON t.pair_id = p.pair_id AND p.pos + 1 >= t.start AND p.pos + 1 < t.start + t.n
              WHERE t.start IS NULL GROUP BY p.pair_id) k USING (pair_id)""", ("sentences", "sent_pos", "taken_recursive")),
        "stream_newest_lexicon": ("""
            SELECT d.doc_id, d.doc_id % 2 AS epoch, CASE WHEN d.text IS NOT NULL THEN coalesce(k.rewritten, '') END AS rewritten
            FROM documents d LEFT JOIN (
                SELECT doc_id, string_agg(CASE WHEN token IS NULL OR doc_id % 2 = 0 AND token >= 'm' THEN piece ELSE '' END, '' ORDER BY ix) AS rewritten
                FROM doc_pieces LEFT JOIN lexicon ON token = lower(piece) GROUP BY doc_id) k USING (doc_id)""", ("doc_pieces", "lexicon")),
        "stream_batch_metrics": ("""SELECT batch_id, n_rows, round(bleu, 6) AS bleu, round(sta, 6) AS sta, round(sim, 6) AS sim,
                                           round(fl, 6) AS fl, round(round(sta * sim * fl, 9), 6) AS j FROM pair_batch_metrics""",
                                 ("pair_batch_metrics",)),
        "resumed_judge": ("SELECT token, round(w, 6) AS w FROM w_tox", ("w_tox",)),
        "subword_roundtrip": ("SELECT doc_id, text FROM documents", ()),
        "token_pmi": ("SELECT a, b, n, round(x, 6) AS x FROM pmi", ("pmi",)),
        "learned_vectors": ("SELECT count(DISTINCT a) AS n_words, CAST(16 AS BIGINT) AS n_dims, true AS falling FROM pmi", ("pmi",)),
        "alignment_model": ("""
            SELECT given AS src, made AS tgt, round(p, 6) AS p FROM (
              SELECT *, row_number() OVER (PARTITION BY given ORDER BY round(p, 9) DESC, made) AS r FROM al_made_3 WHERE given <> '')
            WHERE r = 1""", ("al_made_3",)),
        "word_alignment": ("""
            SELECT pair_id, pos, word, source, round(p, 6) AS p FROM (
              SELECT w.pair_id, w.pos, w.word, w.source, coalesce(m.p, 0) AS p,
                     row_number() OVER (PARTITION BY w.pair_id, w.pos ORDER BY round(coalesce(m.p, 0), 9) DESC, w.source) AS r
              FROM (SELECT pair_id, pos, word, unnest(g) AS source FROM (
                      SELECT pair_id, unnest(string_split(toxic, ' ')) AS word, unnest(range(len(string_split(toxic, ' ')))) AS pos,
                             list_distinct([''] || list_filter(string_split(hyp, ' '), lambda t: t <> '')) AS g FROM pairs)) w
              LEFT JOIN al_pairs_3 m ON m.given = w.source AND m.made = w.word)
            WHERE r = 1""", ("pairs", "al_pairs_3")),
        "token_spans": (r"""
            SELECT doc_id, ix, CAST(before AS BIGINT) AS start, CAST(before + length(piece) AS BIGINT) AS "end",
                   CASE WHEN regexp_matches(piece, '^\p{L}') THEN 'word' WHEN regexp_matches(piece, '^\p{N}') THEN 'number'
                        ELSE 'sign' END AS kind, piece AS text
            FROM (SELECT doc_id, ix, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ix
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM doc_pieces)
            WHERE NOT regexp_matches(piece, '^[\x09-\x0D\x20]')""", ("doc_pieces",)),
        "rewrite_text_delete": ("SELECT doc_id, rewritten FROM texts_deleted", ("texts_deleted",)),
        "rewrite_text_replace": ("""
            SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.rewritten, '') END AS rewritten
            FROM documents d LEFT JOIN (
                SELECT doc_id, string_agg(CASE WHEN tgt IS NULL THEN piece
                         WHEN length(piece) > 1 AND piece = upper(piece) AND piece <> lower(piece) THEN upper(tgt)
                         WHEN piece[1] <> lower(piece[1]) THEN upper(tgt[1]) || tgt[2:] ELSE tgt END, '' ORDER BY ix) AS rewritten
                FROM doc_pieces LEFT JOIN repl ON src = lower(piece) GROUP BY doc_id) k USING (doc_id)""", ("doc_pieces", "repl")),
        "stream_rewrite_text": ("SELECT doc_id, rewritten FROM texts_deleted", ("texts_deleted",)),
        "bigram_probs": ("""
            SELECT ctx, token, n, round(n / sum(n) OVER (PARTITION BY ctx), 6) AS prob,
                   row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS rank FROM bcounts""", ("bcounts",)),
        "bigram_topk": ("""
            SELECT ctx, token, n, prob, rank FROM (
                SELECT ctx, token, n, round(n / sum(n) OVER (PARTITION BY ctx), 6) AS prob,
                       row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS rank FROM bcounts)
            WHERE rank <= 3""", ("bcounts",)),
        "bigram_softmax": ("""
            SELECT ctx, token, round(e / sum(e) OVER (PARTITION BY ctx), 6) AS prob
            FROM (SELECT ctx, token, exp(ln(n) - max(ln(n)) OVER (PARTITION BY ctx)) AS e FROM bcounts)""", ("bcounts",)),
        "greedy_decode": ("""
            SELECT t.seq_id, t.pos, g.token, round(g.prob, 6) AS prob
            FROM turn_tokens t JOIN (
                SELECT ctx, token, prob FROM (
                    SELECT ctx, token, n / sum(n) OVER (PARTITION BY ctx) AS prob,
                           row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS rk FROM bcounts) WHERE rk = 1) g
              ON g.ctx = t.token""", ("turn_tokens", "bcounts")),
        "sampled_decode": ("SELECT seq_id, pos, token, round(prob, 6) AS prob FROM sdraw", ("sdraw",)),
        "sequence_logprob": ("SELECT seq_id, round(sum(ln(prob)), 6) AS sum_log FROM sdraw GROUP BY seq_id", ("sdraw",)),
        "token_cross_entropy": ("SELECT pair_id, n_pos, round(ce, 6) AS ce, round(exp(ce), 6) AS ppl FROM gold_ce",
                                ("gold_ce",)),
        "token_cross_entropy_pad": ("SELECT pair_id, n_pos, round(ce, 6) AS ce, round(exp(ce), 6) AS ppl FROM gold_ce_pad",
                                    ("gold_ce_pad",)),
        "align_unmatched": ("""SELECT pair_id, true AS in_x, true AS in_y_pred, false AS in_y_real FROM sentences
                               WHERE pair_id NOT IN (SELECT pair_id FROM pairs)""", ("sentences", "pairs")),
        "decoded_candidates": ("SELECT seq_id, kind, text FROM drawn", ("drawn",)),
        "toxicity_judge_ml": ("""SELECT count(*) AS n_held_out, true AS accurate FROM labels JOIN documents USING (doc_id)
                                 WHERE doc_id % 5 = 0 AND toxic IS NOT NULL""", ()),
        "judge_held_out": (_held_out(), ()),
        "align_predictions": (f"""
            SELECT p.pair_id, p.toxic AS x, r.text AS y_pred, p.neutral1 AS y_real
            FROM pairs p JOIN ({lexdel}) r USING (pair_id)""", ("pairs", "sentences", "sent_pos", "lexicon")),
        "bert_score": ("SELECT seq_id, kind, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM bert", ("bert",)),
        "reward_total": ("""SELECT seq_id, round(dtox, 6) + 0.0 AS dtox, round(dbert, 6) + 0.0 AS dbert,
                                   round(total_reward, 6) + 0.0 AS total_reward FROM rewards""", ("rewards",)),
        "rl_loss": ("SELECT CAST(epoch AS BIGINT) AS epoch, batch_id, round(rl_loss, 6) AS rl_loss FROM rl", ("rl",)),
        "full_loss": ("""
            SELECT m.batch_id, CAST(m.epoch AS BIGINT) AS epoch, round(m.ml_loss, 6) AS ml_loss,
                   round(coalesce(r.rl_loss, 0.0), 6) AS rl_loss,
                   round(m.ml_loss + CASE WHEN m.epoch >= 100 THEN 0.5 * coalesce(r.rl_loss, 0.0) ELSE 0.0 END, 6) AS full_loss
            FROM (SELECT b.epoch, b.batch_id, avg(g.ce) AS ml_loss FROM gold_ce_pad g JOIN train_batches b USING (pair_id)
                  GROUP BY b.epoch, b.batch_id) m
            LEFT JOIN rl r ON r.batch_id = m.batch_id AND r.epoch = m.epoch""", ("gold_ce_pad", "train_batches", "rl")),
        "stream_rewrite": (lexdel, ("sentences", "sent_pos", "lexicon")),
        "stream_running_loss": ("SELECT run_id, epoch, round(mean_loss, 6) AS mean_loss, n_batches FROM loss_means",
                                ("loss_means",)),
    }


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body, *views) for name, (body, views) in _q().items()}
