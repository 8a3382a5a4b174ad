"""Oracle SQL for the molecule tables, written relationally for DuckDB."""
from __future__ import annotations

from ..bridge import with_views
from ..dims import ELEMENTS
from ..operators.graph import BRACKET, TOKEN

_VALENCE = "CASE el " + " ".join(f"WHEN '{e}' THEN {v}" for e, (v, _, _) in ELEMENTS.items()) + " END"
_ORD = "CASE {0} WHEN '=' THEN 2 WHEN '#' THEN 3 WHEN '$' THEN 4 ELSE 1 END"
_SYM = "('-','=','#','$',':','/','\\','~')"


def graph_ctes(source: str = "molecules") -> str:
    """CTEs g_tok, g_atom(mol_id, idx, el, arom, charge, h, comp), g_adj(mol_id, a, b, ord),
    g_valid(mol_id, valid) over ``source(mol_id, smiles)``.  Atoms cover every text; join
    g_valid to keep valid molecules."""
    return f"""
g_list AS (SELECT mol_id, smiles, regexp_extract_all(smiles, '{TOKEN}', 1) AS toks FROM {source}),
g_raw AS (SELECT mol_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM g_list),
g_t1 AS (SELECT *, regexp_matches(tok, '^[\\[A-Za-z]') AS is_atom, regexp_matches(tok, '^[0-9%]') AS is_digit,
  tok IN {_SYM} AS is_bond FROM g_raw),
g_tok AS (SELECT *,
  sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth,
  CAST(sum(is_atom::INT) OVER w AS INT) - 1 AS idx,
  CAST(sum((tok = '.')::INT) OVER w AS INT) AS comp,
  lag(tok) OVER (PARTITION BY mol_id ORDER BY pos) AS prv,
  lead(tok) OVER (PARTITION BY mol_id ORDER BY pos) AS nxt
  FROM g_t1 WINDOW w AS (PARTITION BY mol_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g_anchor AS (SELECT t.mol_id, t.pos, max_by(b.tok, b.pos) AS anchor FROM g_tok t JOIN g_tok b
  ON t.mol_id = b.mol_id AND b.pos < t.pos AND NOT b.is_bond WHERE t.is_atom GROUP BY 1, 2),
g_child AS (SELECT t.mol_id, t.idx, t.prv, CASE WHEN anchor = '(' THEN depth - 1 ELSE depth END AS k
  FROM g_tok t JOIN g_anchor USING (mol_id, pos) WHERE anchor <> '.'),
g_chain AS (SELECT c.mol_id, max(p.idx) AS a, c.idx AS b, {_ORD.format('any_value(c.prv)')} AS ord
  FROM g_child c JOIN g_tok p ON p.mol_id = c.mol_id AND p.is_atom AND p.depth = c.k AND p.idx < c.idx
  GROUP BY c.mol_id, c.idx),
g_dig AS (SELECT mol_id, pos, idx, prv, CAST(replace(tok, '%', '') AS INT) AS lab,
  row_number() OVER (PARTITION BY mol_id, CAST(replace(tok, '%', '') AS INT) ORDER BY pos) AS rn
  FROM g_tok WHERE is_digit),
g_close AS (SELECT mol_id, lab, (rn + 1) // 2 AS pair, min(idx) AS a, max(idx) AS b, count(*) AS n,
  max({_ORD.format('prv')}) AS ord FROM g_dig GROUP BY 1, 2, 3),
g_bond0 AS (SELECT mol_id, a, b, ord FROM g_chain UNION ALL
  SELECT mol_id, a, b, ord FROM g_close WHERE n = 2),
g_adj0 AS (SELECT mol_id, a, b, ord FROM g_bond0 UNION ALL SELECT mol_id, b, a, ord FROM g_bond0),
g_sum AS (SELECT mol_id, a AS idx, CAST(sum(ord) AS INT) AS s, count(*) AS deg, count(DISTINCT b) AS nd FROM g_adj0 GROUP BY 1, 2),
g_sym AS (SELECT mol_id, pos, idx, comp, tok, tok LIKE '[%' AS br,
  CASE WHEN tok LIKE '[%' THEN regexp_extract(tok, '{BRACKET}', 1) ELSE tok END AS sym,
  regexp_extract(tok, '{BRACKET}', 3) AS hs, regexp_extract(tok, '{BRACKET}', 4) AS sg
  FROM g_tok WHERE is_atom),
g_at AS (SELECT y.mol_id, y.idx, y.comp, br, upper(sym[1]) || lower(sym[2:]) AS el, sym = lower(sym) AS arom,
  CASE WHEN br THEN (CASE WHEN sg LIKE '-%' THEN -1 ELSE 1 END) *
    coalesce(TRY_CAST(nullif(regexp_extract(sg, '([0-9]+)', 1), '') AS INT), length(sg)) ELSE 0 END AS charge,
  CASE WHEN NOT br THEN NULL WHEN hs = '' THEN 0 WHEN hs = 'H' THEN 1 ELSE TRY_CAST(hs[2:] AS INT) END AS written,
  coalesce(s, 0) AS s, coalesce(deg, 0) AS deg, coalesce(nd, 0) AS nd, tok
  FROM g_sym y LEFT JOIN g_sum USING (mol_id, idx)),
g_atom0 AS (SELECT mol_id, idx, comp, el, arom, CAST(charge AS INT) AS charge, deg, s, nd, br, tok, written,
  CAST(coalesce(written, CASE WHEN arom THEN greatest({_VALENCE} - s - 1, 0)
    ELSE greatest(CASE WHEN el IN ('P','N') AND s > 3 THEN 5 WHEN el = 'S' AND s > 4 THEN 6
      WHEN el = 'S' AND s > 2 THEN 4 ELSE {_VALENCE} END - s, 0) END) AS INT) AS h0 FROM g_at),
g_fold AS (SELECT DISTINCT x.mol_id, x.a AS idx FROM g_adj0 x JOIN g_atom0 m ON m.mol_id = x.mol_id AND m.idx = x.a
  JOIN g_atom0 o ON o.mol_id = x.mol_id AND o.idx = x.b WHERE m.el = 'H' AND o.el <> 'H'),
g_adj AS (SELECT * FROM g_adj0 ANTI JOIN g_fold f ON f.mol_id = g_adj0.mol_id AND f.idx = g_adj0.a
  WHERE NOT EXISTS (SELECT 1 FROM g_fold k WHERE k.mol_id = g_adj0.mol_id AND k.idx = g_adj0.b)),
g_bond AS (SELECT * FROM g_adj WHERE a < b),
g_eh AS (SELECT x.mol_id, x.a AS idx, count(*) AS n FROM g_adj0 x JOIN g_fold f ON f.mol_id = x.mol_id AND f.idx = x.b GROUP BY 1, 2),
g_deg AS (SELECT mol_id, a AS idx, CAST(count(*) AS INT) AS d FROM g_adj GROUP BY 1, 2),
g_atom AS (SELECT t.mol_id, t.idx, comp, el, arom, charge, coalesce(d, 0) AS deg,
  CAST(h0 + coalesce(n, 0) AS INT) AS h FROM g_atom0 t LEFT JOIN g_eh USING (mol_id, idx) LEFT JOIN g_deg USING (mol_id, idx)
  WHERE NOT EXISTS (SELECT 1 FROM g_fold k WHERE k.mol_id = t.mol_id AND k.idx = t.idx)),
g_bad AS (
  SELECT mol_id FROM g_list WHERE smiles IS NULL OR array_to_string(toks, '') <> smiles
  UNION SELECT mol_id FROM g_tok WHERE (is_bond AND (nxt IS NULL OR nxt IN {_SYM} OR nxt IN ('(', ')', '.')))
    OR (pos = 0 AND NOT is_atom)
    OR (tok = '(' AND (nxt IS NULL OR nxt = ')' OR prv IN {_SYM} OR prv IN ('(', '.')))
    OR (tok = '.' AND (nxt IS NULL OR prv = '(')) OR (is_digit AND prv IN ('(', '.'))
    OR depth < 0 OR (nxt IS NULL AND depth <> 0) OR (tok LIKE '[%' AND NOT regexp_matches(tok, '{BRACKET}'))
  UNION SELECT mol_id FROM g_close WHERE n <> 2 OR a = b
  UNION SELECT mol_id FROM g_atom0 WHERE nd < deg OR s + coalesce(written, 0) > CASE
    WHEN el = 'C' THEN 4 - abs(charge) WHEN el = 'N' THEN CASE WHEN charge = 0 THEN 5 ELSE 3 + charge END
    WHEN el = 'O' THEN 2 + charge WHEN el = 'B' THEN 3 - charge
    WHEN el IN ('F','Cl','Br','I','H') THEN 1 + abs(charge) WHEN el = 'P' THEN 5 + abs(charge)
    WHEN el = 'S' THEN 6 ELSE 8 END),
g_valid AS (SELECT mol_id, mol_id NOT IN (SELECT mol_id FROM g_bad) AS valid FROM {source})"""


def ring_ctes() -> str:
    """CTE g_ring(mol_id, ring_id, size, place, idx): simple cycles of valid molecules,
    shortest first, kept while outside the span of the earlier ones (edge sets as bit
    masks)."""
    return f"""
r_adj AS (SELECT mol_id, a, b FROM g_adj JOIN g_valid USING (mol_id) WHERE valid),
r_deg AS (SELECT mol_id, count(*) // 2 AS m FROM r_adj GROUP BY 1),
r_num AS (SELECT mol_id, count(*) AS n, max(comp) + 1 AS c FROM g_atom GROUP BY 1),
r_has AS (SELECT mol_id FROM r_deg JOIN r_num USING (mol_id) WHERE m - n + c > 0),
r_core AS (SELECT mol_id, a, b, 0 AS round FROM r_adj SEMI JOIN r_has USING (mol_id)),
r_path AS (
  SELECT mol_id, a AS start, b AS tip, [a, b] AS path FROM r_core WHERE b > a
  UNION ALL
  SELECT p.mol_id, p.start, e.b, list_append(p.path, e.b) FROM r_path p JOIN r_core e
    ON e.mol_id = p.mol_id AND e.a = p.tip WHERE e.b > p.start AND NOT list_contains(p.path, e.b)),
r_cyc AS (SELECT p.mol_id, t.comp, p.path FROM r_path p JOIN r_core e ON e.mol_id = p.mol_id AND e.a = p.tip
  AND e.b = p.start JOIN g_atom t ON t.mol_id = p.mol_id AND t.idx = p.start
  WHERE len(p.path) > 2 AND p.path[2] < p.path[-1]),
r_step AS (SELECT mol_id, comp, path, least(u, v) AS a, greatest(u, v) AS b FROM (
  SELECT mol_id, comp, path, unnest(path) AS u, unnest(list_append(path[2:], path[1])) AS v FROM r_cyc)),
r_edge AS (SELECT mol_id, a, b, row_number() OVER (PARTITION BY mol_id, comp ORDER BY a, b) - 1 AS bit
  FROM (SELECT DISTINCT mol_id, comp, a, b FROM r_step)),
r_mask AS (SELECT mol_id, comp, path, sum(CAST(1 AS HUGEINT) << bit) AS mask FROM r_step JOIN r_edge
  USING (mol_id, a, b) GROUP BY 1, 2, 3),
r_ord AS (SELECT mol_id, comp, path, CAST(mask AS HUGEINT) AS mask,
  row_number() OVER (PARTITION BY mol_id, comp ORDER BY len(path), list_sort(path)) AS k FROM r_mask),
r_pick AS (
  SELECT mol_id, comp, k, path, true AS keep, [CAST(0 AS HUGEINT), mask] AS span FROM r_ord WHERE k = 1
  UNION ALL
  SELECT o.mol_id, o.comp, o.k, o.path, NOT list_contains(p.span, o.mask),
    CASE WHEN list_contains(p.span, o.mask) THEN p.span
      ELSE list_concat(p.span, list_transform(p.span, lambda x: xor(x, o.mask))) END
  FROM r_pick p JOIN r_ord o ON o.mol_id = p.mol_id AND o.comp = p.comp AND o.k = p.k + 1),
r_kept AS (SELECT mol_id, path, row_number() OVER (PARTITION BY mol_id ORDER BY len(path), list_sort(path)) - 1 AS ring_id
  FROM r_pick WHERE keep),
g_ring AS (SELECT mol_id, CAST(ring_id AS INT) AS ring_id, CAST(len(path) AS INT) AS size,
  CAST(generate_subscripts(path, 1) - 1 AS INT) AS place, unnest(path) AS idx FROM r_kept)"""


def graph_sql(
    select: str, rings: bool = False, extra: str = "", source: str = "molecules", pre: str | None = None
) -> str:
    """A query over the graph CTEs of ``source``; ``pre`` holds the CTEs that define it."""
    parts = [pre or with_views("molecules"), graph_ctes(source)]
    if rings:
        parts.append(ring_ctes())
    if extra:
        parts.append(extra)
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
