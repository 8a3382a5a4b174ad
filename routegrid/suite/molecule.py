"""Queries for molecule scalars and predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..bridge import PART_SMILES, VIEWS, derive, load, smiles_of, view
from ..dims import ELEMENTS
from ..functions import text as T
from ..operators import graph as G
from ..operators import molecule as M
from .graph import KEKULE
from .sqlgraph import graph_ctes, graph_sql


def _m(s, d):
    return view(s, d, "molecules")


def _s(s, d):
    return G.structures(_m(s, d))


# mask texts: parts spelled with mask symbols where the key allows it
MASKED = ("SELECT p_partkey AS mol_id, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '$' "
          "WHEN 2 THEN '%' ELSE '&' END) AS smiles FROM part")
UNMASK = ("SELECT p_partkey AS mol_id, concat(" + PART_SMILES + ", CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '$' "
          "WHEN 2 THEN '%' ELSE '&' END) AS smiles FROM part")
# which molecule is looked for in which: a part in the part twice its key
WITHIN = "SELECT p_partkey AS pair_id, p_partkey AS target, cast(floor(p_partkey / 10) AS bigint) AS query FROM part"
SAME = "SELECT p_partkey AS pair_id, p_partkey AS \"left\", p_partkey + p_size % 2 AS \"right\" FROM part"


def _same(s, d):
    pairs = load(s, d, "part").select(
        F.col("p_partkey").alias("pair_id"), F.col("p_partkey").alias("left"),
        (F.col("p_partkey") + F.col("p_size") % 2).alias("right"))
    return M.same_molecule(pairs, M.structure_key(_s(s, d)))


def _contains(s, d):
    return M.contains(derive(s, d, WITHIN), M.match_form(_s(s, d)))


def _search(s, d):
    asked = derive(s, d, f"SELECT n_nationkey AS mol_id, {smiles_of('n_nationkey', 'n_nationkey')} AS smiles FROM nation WHERE n_nationkey > 0")
    return M.search(G.structures(asked), _s(s, d))


def _formulas(s, d):
    return M.formula_and_mass(_m(s, d)).withColumn(
        "formula", F.when(F.col("chemical_formula") != "N/A", F.col("chemical_formula")))


def _step_molecules(s, d):
    """Route = customer, step = order, molecules = its parts, with their formulas."""
    li, o = load(s, d, "lineitem"), load(s, d, "orders")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_formulas(s, d), F.col("l_partkey") == F.col("mol_id"))
        .select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("step"), "formula")
    )


def step_size(step_molecules):
    """Largest radius over the molecules of a step."""
    return step_molecules.groupBy("route_id", "step").agg(
        F.round(F.max(T.formula_radius(F.col("formula"))), 6).alias("size"))


def route_spacing(step_molecules):
    """C20: spacing of a route from its largest step."""
    sized = step_molecules.groupBy("route_id").agg(F.max(T.formula_radius(F.col("formula"))).alias("size"))
    return sized.select(
        "route_id", F.round(F.col("size") * 3, 6).alias("node_spacing"),
        F.round(F.col("size") * 2, 6).alias("molecule_spacing"))


def _described(*cols):
    return lambda s, d: M.describe(_s(s, d)).select("mol_id", *cols)


QUERIES = {
    "c1_is_valid": lambda s, d: M.is_valid(_m(s, d)),
    "c2_chemical_formula": lambda s, d: M.formula_and_mass(_m(s, d)).select("mol_id", "chemical_formula"),
    "c3_exact_mass": lambda s, d: M.formula_and_mass(_m(s, d)).select(
        "mol_id", F.round("mass", 4).alias("mass")),
    "c4_average_weight": lambda s, d: M.describe(_s(s, d)).select(
        "mol_id", F.round("weight", 3).alias("weight")),
    "c5_donors_acceptors": _described("donors", "acceptors"),
    "c6_rotatable_bonds": _described("rotatable"),
    "c7_ring_descriptors": _described(
        "n_rings", "aliphatic_carbocycles", "aliphatic_heterocycles", "aliphatic_rings",
        "aromatic_carbocycles", "aromatic_heterocycles", "aromatic_rings", "n_bridgeheads"),
    "c8_atom_descriptors": _described("n_atoms", "n_bonds", "n_heavy", "n_aromatic", "n_aliphatic"),
    "c9_structure_key": lambda s, d: M.structure_key(_s(s, d)),
    "c9_same_molecule": _same,
    "c10_fingerprint": lambda s, d: M.fingerprint(_s(s, d)),
    "c11_contains": _contains,
    "c11_search": _search,
    "c12_is_basic": lambda s, d: M.is_basic(_s(s, d), _m(s, d), dims.stock(s)),
    "c13_has_seven_ring": lambda s, d: M.has_ring_of_size(_s(s, d), 7),
    "c13_has_eight_ring": lambda s, d: M.has_ring_of_size(_s(s, d), 8),
    "c14_mask_groups": lambda s, d: M.masked(_m(s, d)),
    "c15_unmask_groups": lambda s, d: M.unmasked(derive(s, d, UNMASK)).select("mol_id", "unmasked"),
    "c16_is_masked_text": lambda s, d: derive(s, d, MASKED).select(
        "mol_id", T.is_masked_text(F.col("smiles")).alias("is_masked")),
    "c17_protecting_group_dim": lambda s, d: _m(s, d).select("smiles", F.explode(T.groups()).alias("g"))
    .select("smiles", "g.*").where(F.contains("smiles", "text")).groupBy("symbol", "name").agg(F.count(F.lit(1)).alias("n_molecules")),
    "c18_formula_size": lambda s, d: _formulas(s, d).select(
        "mol_id", F.round(T.formula_radius(F.col("formula")), 6).alias("radius"),
        F.round(T.formula_svg(F.col("formula")), 6).alias("svg_size")),
    "c19_step_size": lambda s, d: step_size(_step_molecules(s, d)),
    "c20_route_spacing": lambda s, d: route_spacing(_step_molecules(s, d)),
    "c21_format_formula": lambda s, d: _formulas(s, d).where("formula IS NOT NULL").select(
        "mol_id", T.format_formula(F.col("formula")).alias("html")),
}

_V = "JOIN g_valid USING (mol_id) WHERE valid"


def _case(slot: int) -> str:
    return "CASE el " + " ".join(f"WHEN '{e}' THEN {v[slot]}" for e, v in ELEMENTS.items()) + " ELSE 0 END"


FORMULA = f"""
f_cnt AS (SELECT mol_id, el, CAST(sum(n) AS INT) AS n FROM (
  SELECT mol_id, el, 1 AS n FROM g_atom UNION ALL SELECT mol_id, 'H', h FROM g_atom WHERE h > 0) GROUP BY 1, 2),
f_c AS (SELECT DISTINCT mol_id FROM f_cnt WHERE el = 'C'),
f_q AS (SELECT mol_id, CAST(sum(charge) AS INT) AS q FROM g_atom GROUP BY 1),
f_txt AS (SELECT mol_id, string_agg(el || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END, '' ORDER BY
  CASE WHEN c IS NULL THEN 2 WHEN el = 'C' THEN 0 WHEN el = 'H' THEN 1 ELSE 2 END, el) AS f
  FROM (SELECT f_cnt.*, f_c.mol_id AS c FROM f_cnt LEFT JOIN f_c USING (mol_id)) GROUP BY mol_id),
f_mass AS (SELECT mol_id, sum(n * {_case(1)}) AS mass, sum(n * {_case(2)}) AS weight FROM f_cnt GROUP BY 1),
f_all AS (SELECT v.mol_id, valid, CASE WHEN valid THEN f || CASE WHEN q = 0 THEN '' ELSE
  CASE WHEN q > 0 THEN '+' ELSE '-' END || CASE WHEN abs(q) = 1 THEN '' ELSE abs(q)::VARCHAR END END ELSE 'N/A' END AS chemical_formula,
  CASE WHEN valid THEN mass ELSE 0.0 END AS mass, weight FROM g_valid v LEFT JOIN f_txt USING (mol_id)
  LEFT JOIN f_q USING (mol_id) LEFT JOIN f_mass USING (mol_id)),
f_rad AS (SELECT mol_id, chemical_formula, CASE WHEN chemical_formula = 'N/A' THEN NULL ELSE chemical_formula END AS formula,
  list_sum(list_transform(regexp_extract_all(chemical_formula, '[A-Z][a-z]?\\d*'),
    lambda p: coalesce(TRY_CAST(regexp_extract(p, '\\d+') AS INT), 1))) AS na FROM f_all),
f_size AS (SELECT mol_id, formula, CASE WHEN formula IS NULL THEN 35.0 ELSE greatest(45.0, 45 + 20 * ln(na)) END AS radius, na FROM f_rad)"""

LABELS = """
w_bond AS (SELECT x.mol_id, x.a, x.b, CASE WHEN p.arom AND q.arom AND EXISTS (SELECT 1 FROM g_ring r JOIN g_ring u
    ON u.mol_id = r.mol_id AND u.ring_id = r.ring_id WHERE r.mol_id = x.mol_id AND r.idx = x.a AND u.idx = x.b)
    THEN 'a' ELSE CAST(x.ord AS INT)::VARCHAR END AS lab
  FROM g_adj x JOIN k_at p ON p.mol_id = x.mol_id AND p.idx = x.a JOIN k_at q ON q.mol_id = x.mol_id AND q.idx = x.b),
w0 AS (SELECT mol_id, idx, md5(concat_ws('|', el, arom::INT, charge, h, deg)) AS l FROM k_at)""" + "".join(
    f""",
w{k} AS (SELECT w.mol_id, w.idx, md5(any_value(w.l) || '|' || coalesce(string_agg(b.lab || ':' || n.l, ',' ORDER BY b.lab || ':' || n.l), '')) AS l
  FROM w{k-1} w LEFT JOIN w_bond b ON b.mol_id = w.mol_id AND b.a = w.idx LEFT JOIN w{k-1} n ON n.mol_id = b.mol_id AND n.idx = b.b
  GROUP BY 1, 2)""" for k in range(1, 7))
def _settling(name: str, base: str, own: str, least: int) -> str:
    """Recursive rounds over ``base(mol_id, <own>, idx, l)`` until a molecule's number of different hashes stops growing."""
    mine, same = f"mol_id, {own}" if own else "mol_id", "".join(f" AND n.{c} = w.{c}" for c in [own] if c)
    w_mine = ", ".join(f"w.{c}" for c in mine.split(", "))
    return f"""
{name} AS (
  SELECT {mine}, idx, 0 AS r, l, count(DISTINCT l) OVER (PARTITION BY {mine}) AS kinds, CAST(0 AS BIGINT) AS before FROM {base}
  UNION ALL
  SELECT {mine}, idx, r + 1, l2, count(DISTINCT l2) OVER (PARTITION BY {mine}), kinds FROM (
    SELECT {w_mine}, w.idx, w.r, w.kinds, md5(w.l || '|' || coalesce(string_agg(b.lab || ':' || n.l, ',' ORDER BY b.lab || ':' || n.l), '')) AS l2
    FROM {name} w LEFT JOIN w_bond b ON b.mol_id = w.mol_id AND b.a = w.idx LEFT JOIN {name} n ON n.mol_id = b.mol_id AND n.idx = b.b{same}
    WHERE w.r < {least} OR w.kinds > w.before GROUP BY {w_mine}, w.idx, w.r, w.kinds, w.l)),
{name}_end AS (SELECT * FROM {name} QUALIFY r = max(r) OVER (PARTITION BY {mine}))"""


KEYS = _settling("ws", "w0", "", 6) + """,
t_mol AS (SELECT mol_id FROM ws_end SEMI JOIN g_ring USING (mol_id) GROUP BY 1 HAVING count(DISTINCT l) < count(*)),
t_cell AS (SELECT mol_id, min({'n': n, 'l': l}) AS c FROM (SELECT mol_id, l, count(*) AS n FROM ws_end SEMI JOIN t_mol USING (mol_id) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
t_start AS (SELECT w.mol_id, p.idx AS v, w.idx, CASE WHEN w.idx = p.idx THEN md5(w.l || '*') ELSE w.l END AS l
  FROM t_cell c JOIN ws_end p ON p.mol_id = c.mol_id AND p.l = c.c.l JOIN ws_end w ON w.mol_id = c.mol_id),""" + _settling("ti", "t_start", "v", 0) + """,
t_out AS (SELECT mol_id, string_agg(o, ',' ORDER BY o) AS o FROM (SELECT mol_id, v, md5(string_agg(l, ',' ORDER BY l)) AS o FROM ti_end GROUP BY 1, 2) GROUP BY 1),
k_key AS (SELECT mol_id, CASE WHEN valid THEN skey END AS skey FROM g_valid LEFT JOIN (
  SELECT mol_id, md5(any_value(a) || coalesce('|' || any_value(o), '')) AS skey FROM (SELECT mol_id, string_agg(l, ',' ORDER BY l) AS a FROM ws_end GROUP BY 1)
  LEFT JOIN t_out USING (mol_id) GROUP BY 1) USING (mol_id))"""

DESC = """
d_ring AS (SELECT g.mol_id, g.ring_id, any_value(g.size) AS size, bool_and(t.arom) AS arom, bool_and(t.el = 'C') AS carbo
  FROM g_ring g JOIN k_at t USING (mol_id, idx) GROUP BY 1, 2),
d_rb AS (SELECT r.mol_id, r.ring_id, least(r.idx, n.idx) AS a, greatest(r.idx, n.idx) AS b FROM g_ring r JOIN g_ring n
  ON n.mol_id = r.mol_id AND n.ring_id = r.ring_id AND n.place = (r.place + 1) % r.size),
d_sh AS (SELECT x.mol_id, x.ring_id AS r1, y.ring_id AS r2, x.a, x.b FROM d_rb x JOIN d_rb y
  ON y.mol_id = x.mol_id AND y.a = x.a AND y.b = x.b AND y.ring_id > x.ring_id),
d_end AS (SELECT mol_id, r1, r2, i FROM (SELECT mol_id, r1, r2, unnest([a, b]) AS i FROM d_sh SEMI JOIN
  (SELECT mol_id, r1, r2 FROM d_sh GROUP BY ALL HAVING count(*) > 1) USING (mol_id, r1, r2)) GROUP BY ALL HAVING count(*) = 1),
d_bh AS (SELECT mol_id, count(DISTINCT i) AS n_bridgeheads FROM d_end GROUP BY 1),
d_out AS (SELECT mol_id, CAST(count(ring_id) AS INT) AS n_rings,
  count(*) FILTER (WHERE NOT arom AND carbo) AS aliphatic_carbocycles,
  count(*) FILTER (WHERE NOT arom AND NOT carbo) AS aliphatic_heterocycles, count(*) FILTER (WHERE NOT arom) AS aliphatic_rings,
  count(*) FILTER (WHERE arom AND carbo) AS aromatic_carbocycles, count(*) FILTER (WHERE arom AND NOT carbo) AS aromatic_heterocycles,
  count(*) FILTER (WHERE arom) AS aromatic_rings, coalesce(any_value(n_bridgeheads), 0) AS n_bridgeheads
  FROM (SELECT mol_id FROM g_valid WHERE valid) LEFT JOIN d_ring USING (mol_id) LEFT JOIN d_bh USING (mol_id) GROUP BY 1),
d_atom AS (SELECT k.*, coalesce(v, 0) AS osum FROM k_at k LEFT JOIN
  (SELECT mol_id, a AS idx, sum(ord) AS v FROM g_adj GROUP BY 1, 2) USING (mol_id, idx)),
d_adj AS (SELECT x.mol_id, x.a, x.b, x.ord, EXISTS (SELECT 1 FROM g_ring r JOIN g_ring u ON u.mol_id = r.mol_id
    AND u.ring_id = r.ring_id WHERE r.mol_id = x.mol_id AND r.idx = x.a AND u.idx = x.b) AS inring,
  p.el AS ael, q.el AS bel, p.arom AS aarom, q.arom AS barom, p.deg AS adeg, q.deg AS bdeg FROM g_adj x
  JOIN k_at p ON p.mol_id = x.mol_id AND p.idx = x.a JOIN k_at q ON q.mol_id = x.mol_id AND q.idx = x.b),
d_pull AS (SELECT mol_id, a AS idx, bool_or(NOT (aarom AND barom)) AS pa, bool_or(NOT inring) AS po FROM d_adj
  WHERE ord = 2 AND bel IN ('O','N','P','S') GROUP BY 1, 2),
d_near AS (SELECT x.mol_id, x.a AS idx, bool_or(x.ord = 1 AND NOT coalesce(pa, false)) AS free1,
  bool_or(x.ord = 1 AND coalesce(po, false)) AS amide FROM d_adj x LEFT JOIN d_pull p ON p.mol_id = x.mol_id AND p.idx = x.b GROUP BY 1, 2),
d_hb AS (SELECT mol_id, count(*) FILTER (WHERE CASE WHEN el = 'N' AND NOT arom THEN h > 0 AND ((charge = 0 AND osum + h = 3)
    OR (charge = 1 AND osum + h = 4)) WHEN el = 'N' THEN h = 1 AND charge = 0
    WHEN el IN ('O','S') AND NOT arom THEN h = 1 AND charge = 0 ELSE false END) AS donors,
  count(*) FILTER (WHERE CASE WHEN el IN ('O','S') AND NOT arom THEN (h = 1 AND osum + h = 2 AND coalesce(free1, false))
    OR (h = 0 AND osum = 2) OR charge = -1 WHEN arom AND el = 'N' THEN h = 0 AND charge = 0
    WHEN arom AND el IN ('O','S') THEN charge = 0 WHEN el = 'N' THEN osum + h = 3 AND NOT coalesce(amide, false) ELSE false END) AS acceptors
  FROM d_atom LEFT JOIN d_near USING (mol_id, idx) GROUP BY 1),
d_acyl AS (SELECT mol_id, a AS idx, bool_or(ord = 3) AS tri,
  any_value(ael) = 'C' AND any_value(adeg) = 3 AND bool_or(ord = 2 AND bel IN ('N','O','S')) AS acyl FROM d_adj GROUP BY 1, 2),
d_rot AS (SELECT x.mol_id, count(*) AS n FROM d_adj x JOIN d_acyl p ON p.mol_id = x.mol_id AND p.idx = x.a
  JOIN d_acyl q ON q.mol_id = x.mol_id AND q.idx = x.b WHERE x.a < x.b AND ord = 1 AND adeg > 1 AND bdeg > 1 AND NOT inring
  AND NOT p.tri AND NOT q.tri AND NOT (p.acyl AND bel IN ('N','O','S')) AND NOT (q.acyl AND ael IN ('N','O','S')) GROUP BY 1)"""

CONTAINS = """
m_atom AS (SELECT mol_id, idx, CASE WHEN arom THEN lower(el) ELSE el END || charge AS kind FROM k_at),
m_cnt AS (SELECT mol_id, kind, count(*) AS n FROM m_atom GROUP BY 1, 2),
m_nb AS (SELECT mol_id, count(*) AS nb FROM w_bond GROUP BY 1),
m_pair AS (SELECT pair_id, target, query FROM within JOIN g_valid tv ON tv.mol_id = target AND tv.valid
  JOIN g_valid qv ON qv.mol_id = query AND qv.valid),
m_short AS (SELECT DISTINCT pair_id FROM m_pair JOIN m_cnt q ON q.mol_id = query LEFT JOIN m_cnt t
  ON t.mol_id = target AND t.kind = q.kind WHERE coalesce(t.n, 0) < q.n),
m_try AS (SELECT p.* FROM m_pair p LEFT JOIN m_nb a ON a.mol_id = query LEFT JOIN m_nb b ON b.mol_id = target
  ANTI JOIN m_short s ON s.pair_id = p.pair_id WHERE coalesce(a.nb, 0) <= coalesce(b.nb, 0)),
m_q AS (SELECT mol_id, idx, kind, row_number() OVER (PARTITION BY mol_id ORDER BY idx) AS k FROM m_atom),
m_last AS (SELECT mol_id, max(k) AS last FROM m_q GROUP BY 1),
m_map AS (
  SELECT pair_id, target, query, 0 AS k, CAST([] AS INT[]) AS m FROM m_try
  UNION ALL
  SELECT p.pair_id, p.target, p.query, q.k, list_append(p.m, t.idx) FROM m_map p JOIN m_q q ON q.mol_id = p.query AND q.k = p.k + 1
    JOIN m_atom t ON t.mol_id = p.target AND t.kind = q.kind WHERE NOT list_contains(p.m, t.idx)
    AND NOT EXISTS (SELECT 1 FROM w_bond e JOIN m_q o ON o.mol_id = e.mol_id AND o.idx = e.b
      WHERE e.mol_id = p.query AND e.a = q.idx AND o.k <= p.k AND NOT EXISTS (SELECT 1 FROM w_bond f
        WHERE f.mol_id = p.target AND f.a = t.idx AND f.b = p.m[o.k] AND f.lab = e.lab)))"""


def _desc(cols: str) -> str:
    return graph_sql(f"SELECT mol_id, {cols} FROM d_out JOIN d_hb USING (mol_id) LEFT JOIN d_rot USING (mol_id)",
                     rings=True, extra=KEKULE + "," + DESC)


_STEPS = ("SELECT o_custkey AS route_id, o_orderkey AS step, radius FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
          "JOIN f_size ON l_partkey = mol_id")
_MASK = "regexp_replace(replace(replace(replace({0}, 'COCc1ccccc1', '%'), 'COC', '&'), 'OC', '$'), '([.$%&])[.$%&]*', '\\1', 'g')"
_STOCK = ", ".join(f"'{x}'" for x in dims.STOCK)

ORACLES = {
    "c1_is_valid": graph_sql("SELECT mol_id, valid FROM g_valid"),
    "c2_chemical_formula": graph_sql("SELECT mol_id, chemical_formula FROM f_all", extra=FORMULA),
    "c3_exact_mass": graph_sql("SELECT mol_id, round(mass, 4) AS mass FROM f_all", extra=FORMULA),
    "c4_average_weight": graph_sql("SELECT mol_id, round(weight, 3) AS weight FROM f_all WHERE valid", extra=FORMULA),
    "c5_donors_acceptors": _desc("donors, acceptors"),
    "c6_rotatable_bonds": _desc("coalesce(n, 0) AS rotatable"),
    "c7_ring_descriptors": _desc(
        "n_rings, aliphatic_carbocycles, aliphatic_heterocycles, aliphatic_rings, aromatic_carbocycles, "
        "aromatic_heterocycles, aromatic_rings, n_bridgeheads"),
    "c8_atom_descriptors": graph_sql(
        "SELECT mol_id, count(*) AS n_atoms, coalesce(any_value(m), 0) AS n_bonds, count(*) FILTER (WHERE el <> 'H') AS n_heavy, "
        "count(*) FILTER (WHERE arom) AS n_aromatic, count(*) FILTER (WHERE el <> 'H') - count(*) FILTER (WHERE arom) AS n_aliphatic "
        "FROM k_at LEFT JOIN r_deg USING (mol_id) GROUP BY mol_id", rings=True, extra=KEKULE),
    "c9_structure_key": graph_sql("SELECT mol_id, skey FROM k_key", rings=True, extra=f"{KEKULE},{LABELS},{KEYS}"),
    "c9_same_molecule": graph_sql(
        "SELECT pair_id, l.skey = r.skey AS same FROM same LEFT JOIN k_key l ON l.mol_id = \"left\" LEFT JOIN k_key r "
        "ON r.mol_id = \"right\"", rings=True, extra=f"{KEKULE},{LABELS},{KEYS}, same AS ({SAME})"),
    "c10_fingerprint": graph_sql(
        "SELECT mol_id, CASE WHEN valid THEN bits END AS bits FROM g_valid LEFT JOIN (SELECT mol_id, list_sort(list_distinct(list("
        "CAST(('0x' || l[1:8])::BIGINT % 2048 AS INT)))) AS bits FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL "
        "SELECT * FROM w2) GROUP BY 1) USING (mol_id)", rings=True, extra=f"{KEKULE},{LABELS}"),
    "c11_contains": graph_sql(
        "SELECT pair_id, CAST(pair_id IN (SELECT pair_id FROM m_map JOIN m_last ON mol_id = query WHERE k = last) AS INT) AS found "
        "FROM within", rings=True, extra=f"{KEKULE},{LABELS}, within AS ({WITHIN}), {CONTAINS}"),
    "c12_is_basic": graph_sql(
        f"SELECT mol_id, smiles IN ({_STOCK}) OR (valid AND (n < 5 OR nc < 5)) AS basic FROM molecules JOIN g_valid USING (mol_id) "
        "LEFT JOIN (SELECT mol_id, count(*) AS n, count(*) FILTER (WHERE el = 'C') AS nc FROM g_atom GROUP BY 1) USING (mol_id)"),
    "c13_has_seven_ring": graph_sql(
        "SELECT mol_id, mol_id IN (SELECT mol_id FROM g_ring WHERE size = 7) AS has_ring FROM molecules", rings=True),
    "c13_has_eight_ring": graph_sql(
        "SELECT mol_id, mol_id IN (SELECT mol_id FROM g_ring WHERE size = 8) AS has_ring FROM molecules", rings=True),
    "c14_mask_groups": graph_sql(
        f"SELECT mol_id, CASE WHEN valid THEN {_MASK.format('smiles')} ELSE 'INVALID_SMILES' END AS masked "
        "FROM molecules JOIN g_valid USING (mol_id)"),
    "c16_is_masked_text": f"WITH t AS ({MASKED}) SELECT mol_id, smiles = '' OR (regexp_matches(smiles, '[$%&]') AND "
                          f"regexp_full_match(smiles, '[A-Za-z0-9()\\[\\]{{}}@+\\-=#$%&*./\\\\]*')) AS is_masked FROM t",
    "c17_protecting_group_dim":
        f"WITH m AS ({VIEWS['molecules']}), p(symbol, name, text) AS (VALUES ('%', 'OBn', 'COCc1ccccc1'), ('&', 'OEt', 'COC'), "
        "('$', 'OMe', 'OC')) SELECT symbol, name, count(*) AS n_molecules FROM m JOIN p ON contains(smiles, text) GROUP BY 1, 2",
    "c18_formula_size": graph_sql(
        "SELECT mol_id, round(radius, 6) AS radius, round(CASE WHEN formula IS NULL THEN 60.0 WHEN na > 50 THEN radius * 2 "
        "ELSE radius * 1.8 END, 6) AS svg_size FROM f_size", extra=FORMULA),
    "c19_step_size": graph_sql(
        f"SELECT route_id, step, round(max(radius), 6) AS size FROM ({_STEPS}) GROUP BY 1, 2", extra=FORMULA),
    "c20_route_spacing": graph_sql(
        f"SELECT route_id, round(max(radius) * 3, 6) AS node_spacing, round(max(radius) * 2, 6) AS molecule_spacing "
        f"FROM ({_STEPS}) GROUP BY 1", extra=FORMULA),
    "c21_format_formula": graph_sql(
        "SELECT mol_id, regexp_replace(formula, '(\\d+)', '<tspan baseline-shift=\"sub\">\\1</tspan>', 'g') AS html "
        "FROM f_size WHERE formula IS NOT NULL", extra=FORMULA),
}

# unmasking is checked on the parsed result of the restored text
ORACLES["c15_unmask_groups"] = (
    "WITH RECURSIVE src AS (" + UNMASK + "), restored AS (SELECT mol_id, replace(replace(replace(smiles, '$', 'OC'), '%', "
    "'COCc1ccccc1'), '&', 'COC') AS smiles FROM src), " + graph_ctes("restored")
    + " SELECT mol_id, CASE WHEN valid THEN smiles END AS unmasked FROM restored JOIN g_valid USING (mol_id)"
)
