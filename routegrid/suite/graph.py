"""Queries for the graph tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..bridge import view
from ..operators import graph as G
from .sqlgraph import graph_sql


def _g(spark, sf):
    return G.graph(view(spark, sf, "molecules"))


QUERIES = {
    "b1_tokenize": lambda s, d: G.tokenize(view(s, d, "molecules")).select("mol_id", "pos", "tok"),
    "b2_atoms": lambda s, d: G.atom_table(_g(s, d)).select(
        "mol_id", "idx", "el", "arom", "charge", "comp"),
    "b3_chain_bonds": lambda s, d: G.scan_tokens(G.tokenize(view(s, d, "molecules")))
    .where("is_atom AND partner IS NOT NULL")
    .select("mol_id", F.col("partner").alias("a"), F.col("idx").alias("b")),
    "b4_ring_bonds": lambda s, d: G.scan_tokens(G.tokenize(view(s, d, "molecules")))
    .where("is_digit AND partner IS NOT NULL")
    .select("mol_id", F.least("partner", "idx").alias("a"), F.greatest("partner", "idx").alias("b")),
    "b5_bond_order": lambda s, d: G.bonds(_g(s, d)),
    "b6_implicit_h": lambda s, d: G.atom_table(_g(s, d)).select("mol_id", "idx", "h"),
    "b7_components": lambda s, d: G.components(_g(s, d)),
    "b8_rings": lambda s, d: G.ring_table(G.with_rings(_g(s, d))),
    "b8_ring_count": lambda s, d: _g(s, d).where("valid").select(
        "mol_id", G.ring_count().alias("n_rings")),
    "b9_aromatic_from_kekule": lambda s, d: G.atom_table(G.structures(view(s, d, "molecules")))
    .where("arom").select("mol_id", "idx"),
    "b10_adjacency": lambda s, d: G.adjacency(_g(s, d)),
}

_V = "JOIN g_valid USING (mol_id) WHERE valid"

KEKULE = """
k_mem AS (SELECT DISTINCT mol_id, idx FROM g_ring),
k_dbl AS (SELECT a.mol_id, a.a AS idx, a.b FROM g_adj a WHERE a.ord = 2),
k_atom AS (SELECT r.mol_id, r.ring_id, r.size, r.idx, t.arom, t.el,
  (SELECT count(*) FROM k_dbl d WHERE d.mol_id = r.mol_id AND d.idx = r.idx) AS nd,
  EXISTS (SELECT 1 FROM k_dbl d JOIN g_ring q ON q.mol_id = d.mol_id AND q.idx = d.b
    WHERE d.mol_id = r.mol_id AND d.idx = r.idx AND q.ring_id = r.ring_id) AS inr,
  EXISTS (SELECT 1 FROM k_dbl d LEFT JOIN k_mem m ON m.mol_id = d.mol_id AND m.idx = d.b
    WHERE d.mol_id = r.mol_id AND d.idx = r.idx AND m.idx IS NULL)
  OR EXISTS (SELECT 1 FROM g_adj x WHERE x.mol_id = r.mol_id AND x.a = r.idx AND x.ord > 2) AS blocked
  FROM g_ring r JOIN g_atom t USING (mol_id, idx)),
k_ring AS (SELECT mol_id, ring_id FROM k_atom GROUP BY 1, 2, size HAVING NOT bool_or(blocked)
  AND count(*) FILTER (WHERE arom OR inr) >= 4
  AND ((size = 6 AND bool_and(arom OR nd = 1)) OR (size = 5 AND count(*) FILTER (WHERE NOT (arom OR nd = 1)) = 1
    AND bool_and(arom OR nd = 1 OR el IN ('N','O','S'))))),
k_flat AS (SELECT mol_id, idx FROM g_atom WHERE arom UNION
  SELECT mol_id, idx FROM g_ring JOIN k_ring USING (mol_id, ring_id)),
k_at AS (SELECT t.mol_id, t.idx, t.comp, t.el, t.charge, t.deg, t.h, f.idx IS NOT NULL AS arom
  FROM g_atom t JOIN g_valid v ON v.mol_id = t.mol_id AND v.valid
  LEFT JOIN k_flat f ON f.mol_id = t.mol_id AND f.idx = t.idx)"""

ORACLES = {
    "b1_tokenize": graph_sql(
        "SELECT mol_id, CAST(pos AS INT) AS pos, tok FROM g_raw"),
    "b2_atoms": graph_sql(f"SELECT mol_id, idx, el, arom, charge, comp FROM g_atom {_V}"),
    "b3_chain_bonds": graph_sql("SELECT mol_id, a, b FROM g_chain"),
    "b4_ring_bonds": graph_sql("SELECT mol_id, a, b FROM g_close WHERE n = 2"),
    "b5_bond_order": graph_sql(f"SELECT mol_id, a, b, CAST(ord AS INT) AS ord FROM g_bond {_V}"),
    "b6_implicit_h": graph_sql(f"SELECT mol_id, idx, h FROM g_atom {_V}"),
    "b7_components": graph_sql(
        f"SELECT mol_id, max(comp) + 1 AS n_components FROM g_atom {_V} GROUP BY mol_id"),
    "b8_rings": graph_sql("SELECT * FROM g_ring", rings=True),
    "b8_ring_count": graph_sql(
        "SELECT mol_id, CAST(coalesce(m, 0) - n + c AS INT) AS n_rings FROM r_num "
        "JOIN g_valid USING (mol_id) LEFT JOIN r_deg USING (mol_id) WHERE valid", rings=True),
    "b9_aromatic_from_kekule": graph_sql(
        "SELECT mol_id, idx FROM k_at WHERE arom", rings=True, extra=KEKULE),
    "b10_adjacency": graph_sql(
        f"SELECT mol_id, a, b, CAST(ord AS INT) AS ord FROM g_adj {_V}"),
}
