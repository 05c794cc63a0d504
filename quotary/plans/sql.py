"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

from quotary.functions.lang import LATIN

WS = r"[\x20\x09-\x0D]+"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}'), lambda w: w <> '')"


def key(word: str) -> str:
    return f"regexp_replace(lower({word}), '[^a-z0-9à-ÿ]', '', 'g')"


def keyed(text: str) -> str:
    return f"list_transform({words(text)}, lambda w: {key('w')})"


def one_byte(word: str) -> str:
    """A key with a byte for each of its letters: DuckDB counts edits in bytes."""
    return f"translate({word}, '{''.join(map(chr, range(0xE0, 0x100)))}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"


def grams(table: str, id_: str, text: str, n: int, name: str) -> str:
    """CTEs: name(id, pos, gram)."""
    return f"""{name}_w AS (SELECT {id_}, {keyed(text)} AS w FROM {table}),
{name} AS (SELECT {id_}, (i - 1)::BIGINT AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT {id_}, w, unnest(range(1, greatest(len(w) - {n - 2}, 1))) AS i FROM {name}_w WHERE len(w) >= {n}))"""


HITS = f"""{grams('documents', 'doc_id', 'text', 4, 'dg')},
{grams('benchmark', 'item_id', 'text', 4, 'bg')},
common AS (SELECT gram FROM bg GROUP BY gram HAVING count(DISTINCT item_id) <= 150),
hits AS (SELECT doc_id, item_id, dg.pos AS p, bg.pos AS q FROM dg JOIN bg USING (gram) JOIN common USING (gram))"""

CHAIN = f"""{HITS},
brk AS (SELECT *, CASE WHEN lag(p) OVER o IS NULL OR p - lag(p) OVER o > 6 OR abs((p - q) - (lag(p) OVER o - lag(q) OVER o)) > 2 OR q < lag(q) OVER o THEN 1 ELSE 0 END AS b, p - lag(p) OVER o AS step
  FROM hits WINDOW o AS (PARTITION BY doc_id, item_id ORDER BY p, q)),
run AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, item_id ORDER BY p, q ROWS UNBOUNDED PRECEDING) AS run FROM brk),
spans AS (SELECT doc_id, item_id, min(p) AS w_start, max(p) + 4 AS w_end, sum(CASE WHEN b = 1 THEN 4 ELSE least(4, step) END)::BIGINT AS matched, count(*)::BIGINT AS hits FROM run GROUP BY doc_id, item_id, run HAVING sum(CASE WHEN b = 1 THEN 4 ELSE least(4, step) END) >= 8)"""

#: `good(doc_id, i, j, n)`, to stand after WITH RECURSIVE. Reading goes on past each run.
REPEATS = f"""rw AS (SELECT doc_id, {keyed('text')} AS w FROM documents WHERE len({words('text')}) >= 10),
rg AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS gram, list_contains(w[i + 1:i + 5], '') AS empty FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM rw)),
rh AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM rg a JOIN rg b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i BETWEEN a.i + 5 AND a.i + 35 WHERE NOT a.empty GROUP BY a.doc_id, a.i),
rn AS (SELECT doc_id, i, j, 5 + coalesce(list_min(list_filter(range(0, j - i - 5), lambda k: j + 6 + k > len(w) OR w[i + 6 + k] <> w[j + 6 + k] OR w[i + 6 + k] = '')), j - i - 5) AS n, w FROM rh JOIN rw USING (doc_id)),
rt AS (SELECT doc_id, min(i) AS i FROM rn GROUP BY doc_id
  UNION ALL SELECT rt.doc_id, (SELECT min(c.i) FROM rn c WHERE c.doc_id = rt.doc_id AND c.i >= rt.i + (SELECT n FROM rn e WHERE e.doc_id = rt.doc_id AND e.i = rt.i)) FROM rt WHERE rt.i IS NOT NULL),
good AS (SELECT rn.doc_id, rn.i::BIGINT AS i, rn.j::BIGINT AS j, rn.n::BIGINT AS n FROM rt JOIN rn ON rt.doc_id = rn.doc_id AND rt.i = rn.i
  WHERE (n >= 8 OR rn.j - rn.i - n <= 1) AND len(list_filter(w[rn.j + 1:rn.j + n], lambda x: x NOT IN {LATIN.formula})) >= 3)"""
