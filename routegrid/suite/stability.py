"""Queries for the stability rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..bridge import PART_SMILES, derive
from ..operators import graph as G
from ..operators import stability as E
from .compare import pathways
from .graph import KEKULE
from .molecule import DESC
from .sqlgraph import graph_sql

MOLS = f"SELECT p_partkey AS mol_id, {PART_SMILES} AS smiles, p_size / 4.0 AS logp FROM part"


def _st(s, d):
    m = derive(s, d, MOLS)
    return E.stability(G.structures(m).join(m.select("mol_id", "logp"), "mol_id"))


def _rule(code):
    return lambda s, d: E.issue_rows(_st(s, d)).where(F.col("code") == code).select("mol_id", "text")


QUERIES = {f"e{k}_{name}": _rule(f"E{k}") for k, name in [
    (1, "small_hetero_rings"), (2, "antiaromatic_motifs"), (3, "four_n_rings"), (4, "fused_small_rings"),
    (5, "large_heterocycles"), (6, "strained_bridges"), (7, "carbocations"), (8, "carbenes"), (9, "fused_five_rings")]}
QUERIES |= {
    "e10_score": lambda s, d: _st(s, d).select("mol_id", "score"),
    "e11_assessment": lambda s, d: _st(s, d).select("mol_id", "valid", F.size("issues").alias("n_issues"), "assessment"),
    "e12_stability_filter": lambda s, d: E.stability_filter(pathways(s, d), ("target", "rank")).select("rank", "target"),
}

RULES = """
z_ring AS (SELECT g.mol_id, g.ring_id, any_value(g.size) AS size, bool_and(t.arom) AS arom, bool_and(t.el = 'C') AS allc,
  count(*) FILTER (WHERE t.el NOT IN ('C','H')) AS nh, string_agg(DISTINCT t.el, ', ' ORDER BY t.el) FILTER (WHERE t.el NOT IN ('C','H')) AS hs,
  count(*) FILTER (WHERE t.arom) AS na, bool_and(t.el = 'C' AND t.arom) AS carom, bool_and(t.el = 'C' AND NOT t.arom) AS calip
  FROM g_ring g JOIN k_at t USING (mol_id, idx) GROUP BY 1, 2),
z_rb AS (SELECT r.mol_id, r.ring_id, r.idx, x.b, x.ord, p.arom AND q.arom AS both_arom FROM g_ring r JOIN g_adj x ON x.mol_id = r.mol_id AND x.a = r.idx
  JOIN g_ring o ON o.mol_id = r.mol_id AND o.ring_id = r.ring_id AND o.idx = x.b
  JOIN k_at p ON p.mol_id = r.mol_id AND p.idx = r.idx JOIN k_at q ON q.mol_id = r.mol_id AND q.idx = x.b),
z_rd AS (SELECT mol_id, ring_id, count(*) FILTER (WHERE ord = 2 AND NOT both_arom) AS ends, count(*) FILTER (WHERE ord > 1) AS multi,
  count(*) FILTER (WHERE ord = 2) AS dbl, count(DISTINCT idx) FILTER (WHERE ord = 2) AS dat FROM z_rb GROUP BY 1, 2),
z_share AS (SELECT x.mol_id, x.ring_id AS r1, y.ring_id AS r2, count(*) AS n FROM g_ring x JOIN g_ring y ON y.mol_id = x.mol_id AND y.idx = x.idx
  AND y.ring_id <> x.ring_id GROUP BY 1, 2, 3),
z_pair AS (SELECT s.mol_id, r1, r2, n, a.size AS s1, b.size AS s2, a.allc AS c1, b.nh AS h2, b.hs AS hs2, a.carom AS ar1, b.carom AS ar2 FROM z_share s
  JOIN z_ring a ON a.mol_id = s.mol_id AND a.ring_id = r1 JOIN z_ring b ON b.mol_id = s.mol_id AND b.ring_id = r2),
i1 AS (SELECT mol_id, CASE size WHEN 3 THEN 'Three' ELSE 'Four' END || '-membered heterocycle (potentially unstable)' AS text FROM z_ring WHERE size IN (3, 4) AND NOT allc),
i2 AS (SELECT DISTINCT mol_id, 'Contains cyclobutadiene-like (anti-aromatic) motif' AS text FROM z_ring WHERE size = 4 AND carom
  UNION ALL SELECT DISTINCT mol_id, 'Contains cyclooctatetraene-like (potential anti-aromatic) motif' FROM z_ring JOIN z_rd USING (mol_id, ring_id)
    WHERE size = 8 AND calip AND dbl = 8 AND dat = 8
  UNION ALL SELECT DISTINCT mol_id, 'Contains pentalene-like (potential anti-aromatic) motif' FROM z_pair WHERE s1 = 5 AND s2 = 5 AND ar1 AND ar2 AND n = 2),
i3 AS (SELECT mol_id, size || '-membered ring with ' || (na + coalesce(ends, 0)) || ' π electrons (potential anti-aromatic)' AS text
  FROM z_ring LEFT JOIN z_rd USING (mol_id, ring_id) WHERE size IN (4, 8, 12, 16) AND na + coalesce(ends, 0) > 0 AND (na + coalesce(ends, 0)) % 4 = 0),
i4 AS (SELECT mol_id, 'Fused ' || s1 || ' and ' || s2 || '-membered rings (highly strained system)' AS text FROM z_pair WHERE r1 < r2 AND s1 <= 4 AND s2 <= 4
  UNION ALL SELECT DISTINCT mol_id, 'WARNING: Fused small rings create highly strained and potentially explosive compounds' FROM z_pair WHERE s1 <= 4 AND s2 <= 4),
i5 AS (SELECT mol_id, 'Large (' || size || '-membered) heterocycle with ' || hs || ' (potentially unstable)' AS text FROM z_ring WHERE size >= 7 AND nh > 0
  UNION ALL SELECT mol_id, 'Very large heterocycle with multiple heteroatoms (significant stability concern)' FROM z_ring WHERE size > 10 AND nh >= 3),
i6 AS (SELECT mol_id, 'Strained polycyclic system with bridgehead atoms' AS text FROM d_bh WHERE n_bridgeheads >= 2
  AND mol_id IN (SELECT mol_id FROM z_ring WHERE size <= 4)),
z_c AS (SELECT t.mol_id, t.idx, t.h, t.deg, t.charge,
  coalesce(bool_or(q.arom), false) AS near_arom, coalesce(bool_or(x.ord = 1 AND q.el = 'C' AND NOT q.arom AND EXISTS (SELECT 1 FROM g_adj y JOIN k_at w
    ON w.mol_id = y.mol_id AND w.idx = y.b WHERE y.mol_id = q.mol_id AND y.a = q.idx AND y.ord = 2 AND w.el = 'C' AND NOT w.arom)), false) AS allyl,
  coalesce(bool_or(x.ord = 1 AND q.el = 'C' AND q.arom), false) AS benzyl,
  coalesce(bool_or(x.ord = 1 AND NOT q.arom AND (q.el IN ('F','Cl','Br','I') OR (q.el IN ('N','S','O') AND q.charge = 1))), false) AS pulled,
  count(*) FILTER (WHERE x.ord = 1 AND q.el = 'C') AS nc
  FROM k_at t LEFT JOIN g_adj x ON x.mol_id = t.mol_id AND x.a = t.idx LEFT JOIN k_at q ON q.mol_id = x.mol_id AND q.idx = x.b
  WHERE t.el = 'C' AND NOT t.arom GROUP BY ALL),
z_plus AS (SELECT *, bool_or(allyl OR benzyl) OVER (PARTITION BY mol_id) AS calm FROM z_c WHERE charge = 1),
z_prim AS (SELECT DISTINCT mol_id FROM z_plus WHERE h = 2 AND nc >= 1),
i7 AS (SELECT mol_id, 'Contains non-stabilized sp2 carbocation (highly unstable intermediate)' AS text, -25 AS pt FROM z_plus WHERE deg + h = 3 AND NOT (calm OR near_arom)
  UNION ALL SELECT mol_id, NULL, 10 FROM z_plus WHERE deg + h = 3 AND (calm OR near_arom)
  UNION ALL SELECT DISTINCT mol_id, 'Contains sp carbocation (highly unstable intermediate)', -30 FROM z_plus WHERE deg + h = 2
  UNION ALL SELECT DISTINCT mol_id, 'Contains carbocation adjacent to electron-withdrawing group (extremely unstable)', -35 FROM z_plus WHERE pulled
  UNION ALL SELECT mol_id, 'Contains primary carbocation (highly unstable)', -30 FROM z_prim
  UNION ALL SELECT DISTINCT mol_id, 'Contains secondary carbocation (unstable intermediate)', -25 FROM z_plus WHERE h = 1 AND nc >= 2 AND mol_id NOT IN (SELECT mol_id FROM z_prim)),
z_lone AS (SELECT * FROM z_c WHERE charge = 0 AND h = 0 AND deg = 2),
z_open AS (SELECT g.mol_id, g.ring_id, any_value(g.size) AS size FROM g_ring g JOIN k_at t USING (mol_id, idx) LEFT JOIN z_rd USING (mol_id, ring_id)
  GROUP BY 1, 2 HAVING bool_and(t.el IN ('C','N','O') AND NOT t.arom) AND coalesce(any_value(multi), 0) = 0),
i8 AS (SELECT DISTINCT mol_id, 'Contains carbene (highly reactive intermediate)' AS text, -35 AS pt FROM z_lone
  UNION ALL SELECT DISTINCT mol_id, 'Contains carbene adjacent to electron-withdrawing group (extremely unstable)', -10 FROM z_lone WHERE pulled
  UNION ALL SELECT DISTINCT mol_id, 'Contains carbene in 3-membered ring (extremely unstable)', -15 FROM z_lone JOIN g_ring USING (mol_id, idx)
    JOIN z_open o USING (mol_id, ring_id) WHERE o.size = 3
  UNION ALL SELECT DISTINCT mol_id, 'Contains carbene in 4-membered ring (highly unstable)', -10 FROM z_lone JOIN g_ring USING (mol_id, idx)
    JOIN z_open o USING (mol_id, ring_id) WHERE o.size = 4),
i9 AS (SELECT mol_id, '5-membered carbon ring fused with ' || s2 || '-membered ring containing ' || hs2 || ' (strained system)' AS text FROM z_pair
  WHERE s1 = 5 AND c1 AND s2 IN (3, 4) AND h2 > 0 AND mol_id IN (SELECT mol_id FROM z_ring LEFT JOIN z_rd USING (mol_id, ring_id)
    WHERE size = 5 AND calip AND coalesce(multi, 0) = 0)),
z_pre AS (SELECT mol_id, text FROM i1 UNION ALL FROM i2 UNION ALL FROM i3 UNION ALL FROM i4 UNION ALL FROM i5 UNION ALL FROM i6),
z_pts AS (SELECT mol_id, sum(pt) AS pt FROM (SELECT mol_id, -15 AS pt FROM z_pre UNION ALL SELECT mol_id, pt FROM i7 UNION ALL SELECT mol_id, pt FROM i8
  UNION ALL SELECT mol_id, -40 FROM i9 UNION ALL SELECT DISTINCT mol_id, -30 FROM i4) GROUP BY 1),
z_iss AS (SELECT * FROM z_pre UNION ALL SELECT mol_id, text FROM i7 WHERE text IS NOT NULL UNION ALL SELECT mol_id, text FROM i8 UNION ALL FROM i9),
z_cnt AS (SELECT mol_id, count(*) AS n, count(*) FILTER (WHERE contains(text, 'anti-aromatic')) AS n_anti,
  count(*) FILTER (WHERE contains(text, 'heterocycle') AND contains(lower(text), 'large')) AS n_big FROM z_iss GROUP BY 1),
z_small AS (SELECT mol_id, bool_or(size <= 5) AS small FROM z_ring GROUP BY 1),
z_out AS (SELECT m.mol_id, v.valid, CASE WHEN v.valid THEN coalesce(z_cnt.n, 0) ELSE 1 END AS n_issues,
  CAST(CASE WHEN v.valid THEN least(100, greatest(0, 100 + coalesce(pt, 0) - CASE WHEN abs(logp) > 10 THEN 10 ELSE 0 END
   - CASE WHEN coalesce(rot.n, 0) > 15 THEN 10 ELSE 0 END + least(15, 5 * aromatic_rings)
   - CASE WHEN aliphatic_rings <= 3 THEN 5 * aliphatic_heterocycles ELSE 0 END
   - CASE WHEN coalesce(small, false) THEN 5 * o.n_bridgeheads ELSE 0 END - 25 * coalesce(n_anti, 0) - 10 * coalesce(n_big, 0))) ELSE 0 END AS INT) AS score
  FROM molecules m JOIN g_valid v ON v.mol_id = m.mol_id LEFT JOIN d_out o ON o.mol_id = m.mol_id LEFT JOIN d_rot rot ON rot.mol_id = m.mol_id
  LEFT JOIN z_pts ON z_pts.mol_id = m.mol_id LEFT JOIN z_cnt ON z_cnt.mol_id = m.mol_id LEFT JOIN z_small ON z_small.mol_id = m.mol_id),
z_fin AS (SELECT *, CASE WHEN NOT valid THEN '' WHEN score >= 80 THEN 'Likely stable' WHEN score >= 50 THEN 'Moderately stable'
  ELSE 'Potentially unstable' END AS assessment FROM z_out)"""


def _sql(select: str, mols: str = MOLS) -> str:
    return graph_sql(select, rings=True, extra=f"{KEKULE},{DESC},{RULES}", pre=f"molecules AS ({mols})")


ORACLES = {name: _sql(f"SELECT mol_id, text FROM i{name[1]}" + (" WHERE text IS NOT NULL" if name[1] == "7" else ""))
           for name in QUERIES if name[1:3] not in ("10", "11", "12")}
ORACLES |= {
    "e10_score": _sql("SELECT mol_id, score FROM z_fin"),
    "e11_assessment": _sql("SELECT mol_id, valid, n_issues, assessment FROM z_fin"),
    "e12_stability_filter": _sql(
        "SELECT l_orderkey AS rank, min_by(smiles, (l_partkey, l_linenumber, l_suppkey)) AS target FROM lineitem JOIN molecules m ON m.mol_id = l_partkey "
        "JOIN z_fin USING (mol_id) GROUP BY 1 HAVING bool_and(assessment IN ('Likely stable', 'Moderately stable'))",
        MOLS.replace("p_size / 4.0", "0.0")),
}
