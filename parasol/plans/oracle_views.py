"""The derived inputs written a second time, independently, as DuckDB SQL.

``with_views(body, *names)`` prefixes a query with the CTEs it needs (and
their dependencies, in definition order).
"""

from __future__ import annotations

from parasol.plans.derived import ADJECTIVES, NOUNS

_NOUNS = ", ".join(f"'{w}'" for w in NOUNS)
_ADJS = ", ".join(f"'{w}'" for w in ADJECTIVES)

# (name, dependencies, body) in definition order.
VIEWS: list[tuple[str, tuple[str, ...], str]] = [
    ("sentences", (), r"""
  SELECT doc_id * 16777216 + sent_ix AS pair_id, doc_id, lang,
         regexp_extract_all(lower(sentence), '[a-zß-ÿ]+') AS tokens
  FROM (
    SELECT doc_id, lang, unnest(parts) AS sentence, unnest(range(len(parts))) AS sent_ix
    FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[.!?\n]+\s*') AS parts FROM documents)
  )
  WHERE len(regexp_extract_all(lower(sentence), '[a-zß-ÿ]+')) >= 1"""),
    ("pairs", ("sentences",), f"""
  SELECT pair_id, lang,
         array_to_string(tokens, ' ') AS toxic,
         array_to_string(list_transform(tokens, lambda t: CASE WHEN t IN ({_NOUNS}) THEN 'person'
                                                               WHEN t IN ({_ADJS}) THEN 'poor' ELSE t END), ' ') AS neutral1,
         array_to_string(list_filter(tokens, lambda t: t NOT IN ({_NOUNS}, {_ADJS})), ' ') AS hyp
  FROM sentences
  WHERE list_has_any(tokens, [{_NOUNS}, {_ADJS}])"""),
    ("all_pairs", ("sentences",), f"""
  SELECT pair_id, array_to_string(tokens, ' ') AS toxic,
         array_to_string(list_transform(tokens, lambda t: CASE WHEN t IN ({_NOUNS}) THEN 'person'
                                                               WHEN t IN ({_ADJS}) THEN 'poor' ELSE t END), ' ') AS neutral1,
         array_to_string(list_filter(tokens, lambda t: t NOT IN ({_NOUNS}, {_ADJS})), ' ') AS hyp
  FROM sentences"""),
    ("candidates", ("all_pairs",), f"""
  SELECT pair_id AS seq_id, 'greedy' AS kind, hyp AS text, neutral1 AS gold FROM all_pairs
  UNION ALL
  SELECT pair_id AS seq_id, 'sampled' AS kind,
         array_to_string(list_filter(string_split(toxic, ' '), lambda t: t NOT IN ({_NOUNS})), ' ') AS text,
         neutral1 AS gold
  FROM all_pairs"""),
    ("turn_tokens", (), r"""
  SELECT conv_id * 16777216 + turn AS seq_id, conv_id, turn, unnest(toks) AS token, unnest(range(len(toks))) AS pos
  FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zß-ÿ]+') AS toks FROM conversations)"""),
    ("losses", (), r"""
  SELECT user_id AS run_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch,
         event_id AS batch_id, value AS loss
  FROM events"""),
]

_BY_NAME = {name: (deps, body) for name, deps, body in VIEWS}


def register(name: str, deps: tuple[str, ...], body: str) -> None:
    """Add a view usable by later ``with_views`` calls."""
    if name not in _BY_NAME:
        VIEWS.append((name, deps, body))
        _BY_NAME[name] = (deps, body)


def _closure(names) -> set[str]:
    out: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in out:
            continue
        out.add(n)
        stack.extend(_BY_NAME[n][0])
    return out


def with_views(body: str, *names: str) -> str:
    need = _closure(names)
    ctes = [f"{n} AS ({b}\n)" for n, _, b in VIEWS if n in need]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if any(n.endswith("_recursive") for n in need) else "WITH ") + ",\n".join(ctes) + "\n" + body
