"""Queries that compare reactants with products."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..bridge import PART_SMILES, VIEWS, load, view
from ..dims import GROUP_NAMES, SCORE_MESSAGES
from ..operators import compare as D
from ..operators import graph as G
from .graph import KEKULE
from .molecule import LABELS
from .sqlgraph import graph_sql


def _pairs(s, d):
    return view(s, d, "pairs")


def _table(s, d):
    return D.compare_table(_pairs(s, d))


def _scores(s, d):
    return D.consistency_scores(_table(s, d))


def _subs(s, d):
    return D.substituents(G.structures(view(s, d, "molecules")))


def pathways(s, d):
    """One pathway per order: target = molecule of the order's lowest part, reactants = its
    parts in line order."""
    li = load(s, d, "lineitem")
    parts = view(s, d, "molecules")
    lines = li.join(parts, F.col("l_partkey") == F.col("mol_id"))
    return lines.groupBy(F.col("l_orderkey").alias("rank")).agg(
        F.min_by("smiles", F.struct("l_partkey", "l_linenumber", "l_suppkey")).alias("target"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "smiles"))),
            lambda x: x["smiles"]).alias("reactants"),
    ).select("target", "rank", "reactants")


QUERIES = {
    "d1_atom_count_diff": lambda s, d: _table(s, d).where("both_valid").select(
        "pair_id", F.explode(D.atom_diffs()).alias("x")).select("pair_id", "x.*"),
    "d2_ring_size_diff": lambda s, d: _table(s, d).where("both_valid").select(
        "pair_id", F.explode(D.ring_diffs()).alias("x")).select("pair_id", "x.*"),
    "d3_aromatic_delta": lambda s, d: _table(s, d).where("both_valid").select(
        "pair_id", (F.col("p_n_arom") - F.col("r_n_arom")).alias("delta"),
        (F.abs(F.col("p_n_arom") - F.col("r_n_arom")) > 2).alias("flagged")),
    "d4_bond_delta": lambda s, d: _table(s, d).where("both_valid").select(
        "pair_id", (F.col("p_n_bonds") - F.col("r_n_bonds")).alias("delta"),
        (F.col("p_n_bonds") > F.col("r_n_bonds")).alias("flagged")),
    "d5_ring_systems": lambda s, d: D.ring_systems(G.structures(view(s, d, "molecules"))).select(
        "mol_id", "ring_id", "ring", "size", "is_aromatic"),
    "d6_substituents": lambda s, d: _subs(s, d).select("mol_id", "ring_id", "attach", "first"),
    "d7_connected_atoms": lambda s, d: _subs(s, d).select("mol_id", "ring_id", "first", "members"),
    "d8_ring_position": lambda s, d: _subs(s, d).select("mol_id", "ring_id", "attach", "position"),
    "d9_signature": lambda s, d: _subs(s, d).select("mol_id", "ring_id", "first", "signature"),
    "d10_friendly_name": lambda s, d: _subs(s, d).select(
        "mol_id", "ring_id", "first", D.friendly_name(F.col("signature")).alias("name")),
    "d11_substituent_moves": lambda s, d: _table(s, d).where("both_valid").select(
        "pair_id", F.explode(D.moves()).alias("x")).select("pair_id", "x.*"),
    "d12_consistency_score": lambda s, d: _scores(s, d).select("pair_id", "score"),
    "d13_severity": lambda s, d: _scores(s, d).select("pair_id", "severity", "message"),
    "d14_consistency_filter": lambda s, d: D.consistency_filter(pathways(s, d), ("target", "rank")).select("rank", "target"),
    "d15_ring_position_pairs": lambda s, d: D.position_pairs(_table(s, d)),
    "d16_changed_atoms": lambda s, d: D.changed_atoms(_pairs(s, d)),
    "d17_structure_consistency": lambda s, d: D.structure_consistency(_table(s, d)),
}

SIDES = (f"pairs AS ({VIEWS['pairs']}), sides AS (SELECT pair_id * 2 AS mol_id, reactant AS smiles FROM pairs "
         "UNION ALL SELECT pair_id * 2 + 1, product FROM pairs)")
OK = """
ok AS (SELECT pair_id, r.valid AND p.valid AS valid FROM pairs JOIN g_valid r ON r.mol_id = pair_id * 2
  JOIN g_valid p ON p.mol_id = pair_id * 2 + 1)"""
# D1-D4 and D11-D13 on `sides`
SUBS = """
s_arom AS (SELECT g.mol_id, g.ring_id, any_value(g.size) AS size, bool_and(t.arom) AS arom FROM g_ring g JOIN k_at t USING (mol_id, idx) GROUP BY 1, 2),
s_sub AS (SELECT r.mol_id, r.ring_id, r.size, r.place, r.idx AS attach, x.b AS first FROM g_ring r JOIN g_adj x ON x.mol_id = r.mol_id AND x.a = r.idx
  WHERE NOT EXISTS (SELECT 1 FROM g_ring o WHERE o.mol_id = r.mol_id AND o.ring_id = r.ring_id AND o.idx = x.b)),
s_reach AS (SELECT DISTINCT mol_id, ring_id, first, first AS atom FROM s_sub UNION
  SELECT s.mol_id, s.ring_id, s.first, x.b FROM s_reach s JOIN g_adj x ON x.mol_id = s.mol_id AND x.a = s.atom
  WHERE NOT EXISTS (SELECT 1 FROM g_ring o WHERE o.mol_id = s.mol_id AND o.ring_id = s.ring_id AND o.idx = x.b)),
s_pos AS (SELECT s.mol_id, s.ring_id, s.attach, CASE WHEN any_value(s.size) <> 6 THEN '1' ELSE coalesce(CASE min(least(abs(o.place - s.place), 6 - abs(o.place - s.place)))
    WHEN 1 THEN 'ortho' WHEN 2 THEN 'meta' WHEN 3 THEN 'para' END, '1') END AS position
  FROM s_sub s LEFT JOIN s_sub o ON o.mol_id = s.mol_id AND o.ring_id = s.ring_id AND o.attach <> s.attach GROUP BY 1, 2, 3),
s_sig AS (SELECT mol_id, ring_id, first, string_agg(el || n, '.' ORDER BY el) AS signature FROM (
  SELECT s.mol_id, ring_id, first, el, count(*) AS n FROM s_reach s JOIN k_at t ON t.mol_id = s.mol_id AND t.idx = s.atom GROUP BY ALL) GROUP BY 1, 2, 3)"""
MOVES = """
v_k AS (SELECT mol_id, ring_id, size, row_number() OVER (PARTITION BY mol_id, size ORDER BY ring_id) AS nth FROM s_arom WHERE arom),
v_grp AS (SELECT k.mol_id, k.size, k.nth, signature AS sig, list(CASE position WHEN '1' THEN 'position 1' ELSE position END ORDER BY
    CASE position WHEN '1' THEN 'position 1' ELSE position END) AS pos
  FROM s_sub s JOIN v_k k USING (mol_id, ring_id) JOIN s_pos USING (mol_id, ring_id, attach) JOIN s_sig USING (mol_id, ring_id, first) GROUP BY 1, 2, 3, 4),
v_nr AS (SELECT mol_id, count(DISTINCT ring_id) AS nr FROM g_ring GROUP BY 1),
v_move AS (SELECT pair_id, r.size, r.nth, r.sig, r.pos AS f, p.pos AS t FROM ok JOIN v_grp r ON r.mol_id = pair_id * 2
  JOIN v_grp p ON p.mol_id = pair_id * 2 + 1 AND p.size = r.size AND p.nth = r.nth AND p.sig = r.sig AND p.pos <> r.pos
  LEFT JOIN v_nr x ON x.mol_id = pair_id * 2 LEFT JOIN v_nr y ON y.mol_id = pair_id * 2 + 1 WHERE valid AND coalesce(x.nr, 0) = coalesce(y.nr, 0))"""
DIFFS = """
x_el AS (SELECT mol_id // 2 AS pair_id, mol_id % 2 AS side, el, count(*) AS n FROM g_atom GROUP BY 1, 2, 3),
x_d1 AS (SELECT pair_id, el, CAST(coalesce(sum(n) FILTER (WHERE side = 0), 0) AS INT) AS n_reactant,
  CAST(coalesce(sum(n) FILTER (WHERE side = 1), 0) AS INT) AS n_product FROM x_el JOIN ok USING (pair_id) WHERE valid GROUP BY 1, 2
  HAVING n_reactant <> n_product),
x_rs AS (SELECT mol_id // 2 AS pair_id, size, count(*) FILTER (WHERE mol_id % 2 = 0) AS nr, count(*) FILTER (WHERE mol_id % 2 = 1) AS np
  FROM (SELECT DISTINCT mol_id, ring_id, size FROM g_ring) JOIN ok ON pair_id = mol_id // 2 AND valid GROUP BY 1, 2),
x_d2 AS (SELECT pair_id, size, CASE WHEN nr > np THEN 'removed' ELSE 'added' END AS change, CAST(greatest(nr, np) AS INT) AS entries
  FROM x_rs WHERE nr <> np),
x_ar AS (SELECT pair_id, CAST(count(*) FILTER (WHERE arom AND mol_id % 2 = 1) - count(*) FILTER (WHERE arom AND mol_id % 2 = 0) AS INT) AS delta
  FROM k_at JOIN ok ON pair_id = mol_id // 2 WHERE valid GROUP BY 1),
x_bd AS (SELECT pair_id, CAST(count(b) FILTER (WHERE mol_id % 2 = 1) - count(b) FILTER (WHERE mol_id % 2 = 0) AS INT) AS delta
  FROM ok LEFT JOIN g_bond ON pair_id = mol_id // 2 WHERE valid GROUP BY 1)"""
SCORE = """
x_sc AS (SELECT pair_id, valid, CAST(CASE WHEN valid THEN greatest(0, 100 - coalesce((SELECT max(least(5 * abs(n_reactant - n_product), 100)) FROM x_d1 q WHERE q.pair_id = ok.pair_id), 0)
  - least(50, 25 * coalesce((SELECT sum(entries) FROM x_d2 q WHERE q.pair_id = ok.pair_id), 0))
  - least(100, 60 * (SELECT count(*) FROM v_move q WHERE q.pair_id = ok.pair_id))
  - CASE WHEN (SELECT abs(delta) FROM x_ar q WHERE q.pair_id = ok.pair_id) > 2 THEN 40 ELSE 0 END
  - least(30, greatest(0, 5 * (SELECT delta FROM x_bd q WHERE q.pair_id = ok.pair_id)))) ELSE 0 END AS INT) AS score FROM ok)"""
_ALL = f"{KEKULE},{OK},{SUBS},{MOVES},{DIFFS},{SCORE}"
_SEV = "CASE WHEN NOT valid THEN 'critical' WHEN score >= 80 THEN 'low' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'high' ELSE 'critical' END"
_MSG = "CASE WHEN NOT valid THEN 'Invalid SMILES string detected - cannot assess transformation' " + " ".join(
    f"WHEN score >= {lo} THEN '{t}'" for lo, t in SCORE_MESSAGES) + " END"
_NAME = "CASE signature " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in GROUP_NAMES) + " ELSE 'Group (' || signature || ')' END"


def _sides(select: str, extra: str = _ALL) -> str:
    return graph_sql(select, rings=True, extra=extra, source="sides", pre=SIDES)


def _mols(select: str) -> str:
    return graph_sql(select, rings=True, extra=f"{KEKULE},{SUBS}")


_PATHS = f"""parts AS (SELECT p_partkey, {PART_SMILES} AS smiles FROM part),
pairs AS (SELECT l_orderkey AS pair_id, string_agg(smiles, '.' ORDER BY l_linenumber, l_partkey, smiles) AS reactant,
  min_by(smiles, (l_partkey, l_linenumber, l_suppkey)) AS product FROM lineitem JOIN parts ON p_partkey = l_partkey GROUP BY 1),
sides AS (SELECT pair_id * 2 AS mol_id, reactant AS smiles FROM pairs UNION ALL SELECT pair_id * 2 + 1, product FROM pairs)"""

MARKS = """
n_mark AS (SELECT s.mol_id, s.ring_id, a.size, list_sort(list(s.place)) AS pl FROM s_sub s JOIN s_arom a USING (mol_id, ring_id) WHERE a.arom AND a.size = 6 GROUP BY 1, 2, 3 HAVING count(*) > 1),
n_gap AS (SELECT mol_id, len(pl) AS n, least(abs(pl[1] - pl[2]), size - abs(pl[1] - pl[2])) AS gap FROM n_mark),
n_pair AS (SELECT pair_id, least(r.gap, p.gap) AS lo, greatest(r.gap, p.gap) AS hi FROM ok JOIN n_gap r ON r.mol_id = pair_id * 2
  JOIN n_gap p ON p.mol_id = pair_id * 2 + 1 AND p.n = r.n WHERE valid)"""
ENVS = """
e_row AS (SELECT mol_id // 2 AS pair_id, mol_id % 2 AS side, idx, l, row_number() OVER (PARTITION BY mol_id, l ORDER BY idx) AS nth FROM w1),
e_cnt AS (SELECT pair_id, side, l, count(*) AS n FROM e_row GROUP BY 1, 2, 3),
e_chg AS (SELECT r.pair_id, r.side, r.idx FROM e_row r JOIN ok ON ok.pair_id = r.pair_id AND valid LEFT JOIN e_cnt c
  ON c.pair_id = r.pair_id AND c.side = 1 - r.side AND c.l = r.l WHERE r.nth > coalesce(c.n, 0)),
e_all AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS np FROM e_row GROUP BY 1),
e_shared AS (SELECT a.pair_id, sum(least(a.n, b.n)) AS sh FROM e_cnt a JOIN e_cnt b ON b.pair_id = a.pair_id AND a.side = 0 AND b.side = 1 AND a.l = b.l GROUP BY 1),
e_frag AS (SELECT mol_id, max(comp) + 1 AS nf FROM g_atom GROUP BY 1),
e_nr AS (SELECT mol_id, count(DISTINCT ring_id) AS n FROM g_ring GROUP BY 1)"""

ORACLES = {
    "d1_atom_count_diff": _sides("SELECT * FROM x_d1"),
    "d2_ring_size_diff": _sides("SELECT * FROM x_d2"),
    "d3_aromatic_delta": _sides("SELECT pair_id, delta, abs(delta) > 2 AS flagged FROM x_ar"),
    "d4_bond_delta": _sides("SELECT pair_id, delta, delta > 0 AS flagged FROM x_bd"),
    "d5_ring_systems": _mols(
        "SELECT mol_id, ring_id, list(idx ORDER BY place) AS ring, any_value(size) AS size, "
        "bool_and(arom) AS is_aromatic FROM g_ring JOIN k_at USING (mol_id, idx) GROUP BY 1, 2"),
    "d6_substituents": _mols("SELECT mol_id, ring_id, attach, first FROM s_sub"),
    "d7_connected_atoms": _mols(
        "SELECT s.mol_id, s.ring_id, s.first, members FROM s_sub s JOIN (SELECT mol_id, ring_id, first, "
        "list(atom ORDER BY atom) AS members FROM s_reach GROUP BY 1, 2, 3) USING (mol_id, ring_id, first)"),
    "d8_ring_position": _mols("SELECT mol_id, ring_id, attach, position FROM s_sub JOIN s_pos USING (mol_id, ring_id, attach)"),
    "d9_signature": _mols("SELECT mol_id, ring_id, first, signature FROM s_sub JOIN s_sig USING (mol_id, ring_id, first)"),
    "d10_friendly_name": _mols(
        f"SELECT mol_id, ring_id, first, {_NAME} AS name FROM s_sub JOIN s_sig USING (mol_id, ring_id, first)"),
    "d11_substituent_moves": _sides(
        f"SELECT pair_id, size, CAST(nth AS INT) AS nth, {_NAME.replace('signature', 'sig')} AS substituent, "
        "f AS from_positions, t AS to_positions FROM v_move"),
    "d12_consistency_score": _sides("SELECT pair_id, score FROM x_sc"),
    "d13_severity": _sides(f"SELECT pair_id, {_SEV} AS severity, {_MSG} AS message FROM x_sc"),
    "d14_consistency_filter": graph_sql(
        f"SELECT pair_id AS rank, product AS target FROM pairs JOIN x_sc USING (pair_id) WHERE {_SEV} IN ('low', 'medium')",
        rings=True, extra=_ALL, source="sides", pre=_PATHS),
    "d15_ring_position_pairs": _sides(
        "SELECT pair_id, CASE WHEN lo = 1 AND hi = 2 THEN 'Ortho <-> Meta' WHEN lo = 1 AND hi = 3 THEN 'Ortho <-> Para' "
        "ELSE 'Meta <-> Para' END || ' position change detected' AS change FROM n_pair WHERE lo <> hi", _ALL + "," + MARKS),
    "d16_changed_atoms": _sides(
        "SELECT c.pair_id, CASE c.side WHEN 0 THEN 'reactant' ELSE 'product' END AS side, c.idx, any_value(t.el) AS el, "
        "coalesce(list(x.b ORDER BY x.b) FILTER (WHERE x.b IS NOT NULL AND o.idx IS NULL), []) AS attachments "
        "FROM e_chg c JOIN k_at t ON t.mol_id = c.pair_id * 2 + c.side AND t.idx = c.idx "
        "LEFT JOIN g_adj x ON x.mol_id = t.mol_id AND x.a = c.idx LEFT JOIN e_chg o ON o.pair_id = c.pair_id AND o.side = c.side AND o.idx = x.b "
        "GROUP BY 1, c.side, c.idx", f"{KEKULE},{OK},{LABELS},{ENVS}"),
    "d17_structure_consistency": _sides(
        "SELECT pair_id, issue IS NULL AS consistent, issue FROM (SELECT ok.pair_id, CASE WHEN NOT valid THEN 'Invalid SMILES notation' "
        "WHEN coalesce(x.n, 0) <> coalesce(y.n, 0) THEN 'Ring count changed from ' || coalesce(x.n, 0) || ' to ' || coalesce(y.n, 0) "
        "WHEN coalesce(sh, 0) * 10 < nr * 7 OR coalesce(sh, 0) * 10 < np * 7 THEN 'Significant structural rearrangement detected' "
        "WHEN p.nf <> q.nf THEN 'Fragment count changed from ' || p.nf || ' to ' || q.nf END AS issue FROM ok "
        "LEFT JOIN e_nr x ON x.mol_id = ok.pair_id * 2 LEFT JOIN e_nr y ON y.mol_id = ok.pair_id * 2 + 1 "
        "LEFT JOIN e_all a ON a.pair_id = ok.pair_id LEFT JOIN e_shared h ON h.pair_id = ok.pair_id "
        "LEFT JOIN e_frag p ON p.mol_id = ok.pair_id * 2 LEFT JOIN e_frag q ON q.mol_id = ok.pair_id * 2 + 1)",
        f"{KEKULE},{OK},{LABELS},{ENVS}"),
}
