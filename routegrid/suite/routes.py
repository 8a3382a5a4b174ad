"""Queries for routes and their editing."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..bridge import PART_SMILES, derive, load, smiles_of, view
from ..operators import edit as H
from ..operators import routes as G
from ..plans.ranking import numbered
from ..plans.staging import stage
from .molecule import FORMULA
from .sqlgraph import graph_sql

CUST = smiles_of("{0}", "{0}")
TARGETS = f"SELECT c_custkey AS route_id, {CUST.format('c_custkey')} AS smiles FROM customer"
STOCK = f"SELECT {PART_SMILES} AS smiles FROM part WHERE p_size <= 35"
CAND = (f"SELECT {CUST.format('o_custkey')} AS target, o_orderkey AS rank, (cast(l_linenumber AS bigint) * 1000000000000 + l_partkey) AS ord, {CUST.format('l_partkey')} AS smiles, "
        "0.1 + (o_orderkey % 8) / 10.0 AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
# the place of a reactant must be unique in its order: line number, then part


def _targets(s, d):
    return derive(s, d, TARGETS)


def _cands(s, d):
    return derive(s, d, CAND).dropDuplicates(["target", "rank", "ord"])


def _stock(s, d):
    return derive(s, d, STOCK)


def _nodes(s, d, strict=False):
    return G.expand_routes(_targets(s, d), _cands(s, d), _stock(s, d), strict=strict)


def _basic(s, d):
    """Reagents: stock parts of the smaller sizes."""
    return derive(s, d, STOCK.replace("<= 35", "<= 18"))


def _flat(s, d):
    return G.flatten_route(_nodes(s, d), _basic(s, d))


def _counted(steps, molecules, deps):
    return steps.join(deps.groupBy("route_id", "step").agg(F.count("dep").alias("n_deps")), ["route_id", "step"])


def _format(s, d):
    return G.format_route(_nodes(s, d), _basic(s, d))


# stored routes: one per customer, steps are its orders in key order; step i hangs under i / 2
def _steps(s, d):
    o = load(s, d, "orders").select(F.col("o_custkey").alias("route_id"), "o_orderkey", "o_orderpriority")
    return numbered(o, ["route_id"], ["o_orderkey"], "step")


def _edges(steps):
    up = steps.where("step > 1").select("route_id", F.floor(F.col("step") / 2).cast("int").alias("step"), F.col("step").alias("dep"))
    far = steps.where("step > 3 AND route_id % 3 = 0").select("route_id", (F.col("step") - 3).cast("int").alias("step"), F.col("step").alias("dep"))
    return up.unionByName(far).distinct()


def _route_tables(s, d):
    steps = stage(_steps(s, d).select("route_id", "step"))
    edges = _edges(steps)
    cust = load(s, d, "customer")
    starts = cust.select(F.col("c_custkey").alias("route_id"), (1 + F.col("c_custkey") % 7).cast("int").alias("step"))
    starts = starts.join(steps, ["route_id", "step"], "left_semi")
    new = cust.select(F.col("c_custkey").alias("route_id"), F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int"))).alias("step")).where("step > 0")
    new_edges = new.where("step > 1").select("route_id", (F.col("step") - 1).alias("step"), F.col("step").alias("dep"))
    return steps, edges, starts, new, new_edges


def _h(fn):
    return lambda s, d: fn(*_route_tables(s, d))


def _splice_status(s, d):
    steps, edges, starts, new, _ = _route_tables(s, d)
    cust = load(s, d, "customer")
    requests = cust.select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("route_id"), (1 + F.col("c_custkey") % 7).cast("int").alias("step"),
        F.when(F.col("c_custkey") % 9 == 0, "other").otherwise(F.col("c_mktsegment")).alias("smiles"))
    results = cust.where("c_acctbal > 0").select(F.col("c_custkey").alias("route_id"), F.col("c_mktsegment").alias("target"))
    priced = steps.withColumn("n_products", F.when(F.col("route_id") % 11 == 0, 0).otherwise(1))
    kept = H.keep_steps(steps, H.downstream(edges, starts)).groupBy("route_id").agg(F.count(F.lit(1)).alias("n_kept"))
    counts = new.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_new"))
    return H.splice_status(requests, results, priced, counts, kept)


def _products(s, d):
    return load(s, d, "lineitem").join(_steps(s, d), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "route_id", "step", (F.col("l_linenumber") - 1).alias("ord"), F.col("l_partkey").cast("string").alias("smiles"))


def _enriched(s, d):
    steps, used = _flat(s, d)
    key = ["route_id", "step"]
    reagents = steps.where("step % 2 = 1").select(*key, F.lit(0).alias("ord"), F.lit("CCO").alias("smiles"))
    conditions = steps.where("step % 3 > 0").select(*key, F.concat(F.col("step").cast("string"), F.lit(" C")).alias("temperature"))
    literature = steps.where("step % 4 > 0").select(*key, F.concat(F.lit("ref "), "product").alias("literature"))
    return G.enrich_steps(steps, used, reagents, conditions, literature)


def _described(s, d):
    """Formatted routes with formulas, masses and scalability; classes follow from the lengths of a pair's texts."""
    steps, used = (stage(t) for t in _flat(s, d))
    types = G.last_pairs(steps, used).select("smiles", "product", ((F.length("smiles") + 2 * F.length("product")) % 40).cast("int").alias("code"))
    full, molecules = G.describe_steps(steps, used, types, dims.reaction_classes(s))
    return full.withColumn("mass", F.round("mass", 4)), molecules.withColumn("mass", F.round("mass", 4))


QUERIES = {
    "g1_short_circuit": lambda s, d: G.short_circuit(_targets(s, d), _stock(s, d)),
    "g2_expand_routes": lambda s, d: _nodes(s, d).select("route_id", "path", "depth", "smiles", "status"),
    "g2_expand_routes_strict": lambda s, d: _nodes(s, d, True).select("route_id", "path", "depth", "smiles", "status"),
    "g3_expand_once": lambda s, d: G.expand_once(_targets(s, d), _cands(s, d)),
    "g4_flatten_steps": lambda s, d: _flat(s, d)[0],
    "g4_flatten_molecules": lambda s, d: _flat(s, d)[1],
    "g5_resolve_dependencies": lambda s, d: _format(s, d)[2],
    "g6_format_route": lambda s, d: _counted(*_format(s, d)),
    "g6_step_metrics": lambda s, d: _described(s, d)[0],
    "g6_molecule_metadata": lambda s, d: _described(s, d)[1],
    "g7_enrich_steps": lambda s, d: _enriched(s, d)[0],
    "g7_enrich_molecules": lambda s, d: _enriched(s, d)[1],
    "g8_confidence_estimate": lambda s, d: load(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        G.confidence_estimate(F.col("l_discount") * 10 + F.lit(0.0)).alias("confidence")),
    "g10_scalability_index": lambda s, d: G.scalability_index(
        load(s, d, "part").select("p_partkey", (F.col("p_size") + 5).alias("code")), dims.reaction_classes(s)),
    "g11_reaction_text": lambda s, d: G.reaction_text(*reversed(_flat(s, d))),
    "g12_in_stock_leaves": lambda s, d: G.solved_flag(_nodes(s, d)),
    "h1_downstream": _h(lambda st, ed, start, new, ne: H.downstream(ed, start)),
    "h2_left_connection": _h(lambda st, ed, start, new, ne: H.left_connection(ed, start, H.downstream(ed, start))),
    "h3_keep_steps": _h(lambda st, ed, start, new, ne: H.keep_steps(st, H.downstream(ed, start))),
    "h3_keep_edges": _h(lambda st, ed, start, new, ne: H.keep_edges(ed, H.downstream(ed, start))),
    "h4_renumber": _h(lambda st, ed, start, new, ne: H.renumber(new, H.keep_steps(st, H.downstream(ed, start)))),
    "h5_splice_steps": _h(lambda *t: H.splice(*t)[0]),
    "h5_splice_edges": _h(lambda *t: H.splice(*t)[1]),
    "h6_splice_status": _splice_status,
    "h7_add_root_step": lambda s, d: H.add_root_step(_products(s, d)),
    "h8_parent_of_step": _h(lambda st, ed, start, new, ne: H.parent_of_step(st, ed)),
    "h9_route_tree": _h(lambda st, ed, start, new, ne: H.route_tree(H.parent_of_step(st, ed)).drop("root")),
    "h9_route_roots": _h(lambda st, ed, start, new, ne: H.route_tree(H.parent_of_step(st, ed), paths=False)),
    "h10_dependency_edges": _h(lambda st, ed, start, new, ne: H.dependency_edges(ed)),
}

BASE = f"""tg AS ({TARGETS}), stk AS (SELECT DISTINCT smiles FROM ({STOCK})), cand AS (SELECT DISTINCT * FROM ({CAND})),
bst AS (SELECT target, min(rank) AS rank FROM cand GROUP BY 1), pick AS (SELECT c.* FROM cand c SEMI JOIN bst USING (target, rank))"""
STRICT = BASE + """,
need AS (SELECT target, rank, count(*) AS need FROM cand GROUP BY 1, 2)""" + "".join(f""",
sv{k} AS (SELECT smiles FROM {'stk' if k == 0 else f'sv{k-1}'}{'' if k == 0 else f' UNION SELECT target FROM ch{k}'}),
ch{k+1} AS (SELECT target, min(rank) AS rank FROM (SELECT target, rank FROM cand SEMI JOIN sv{k} USING (smiles) GROUP BY target, rank
  HAVING count(*) = (SELECT need FROM need n WHERE n.target = cand.target AND n.rank = cand.rank)) WHERE target NOT IN (SELECT smiles FROM sv{k}) GROUP BY 1)""" for k in range(0, 8)) + """,
pick2 AS (SELECT c.* FROM cand c SEMI JOIN (""" + " UNION ALL ".join(f"FROM ch{k}" for k in range(1, 9)) + ") z USING (target, rank))"


def _tree(pick: str = "pick") -> str:
    status = (f"CASE WHEN s.smiles IS NOT NULL THEN 'stock' WHEN list_contains({{line}}, {{sm}}) THEN 'cycle' WHEN h.target IS NULL THEN 'dead_end' "
              "ELSE 'expanded' END")
    joins = "LEFT JOIN stk s ON s.smiles = {sm} LEFT JOIN hd h ON h.target = {sm}"
    return f"""hd AS (SELECT target, max(confidence) AS confidence FROM {pick} GROUP BY 1),
nd AS (SELECT route_id, CAST([] AS BIGINT[]) AS path, CAST(NULL AS BIGINT[]) AS parent, 0 AS depth, CAST([] AS VARCHAR[]) AS line, tg.smiles AS smiles,
  {status.format(line='CAST([] AS VARCHAR[])', sm='tg.smiles', dep='0')} AS status, h.confidence AS confidence FROM tg {joins.format(sm='tg.smiles')}
  UNION ALL SELECT n.route_id, list_append(n.path, p.ord), n.path, n.depth + 1, list_append(n.line, n.smiles), p.smiles,
  {status.format(line='list_append(n.line, n.smiles)', sm='p.smiles', dep='n.depth + 1')}, h.confidence
  FROM nd n JOIN {pick} p ON p.target = n.smiles {joins.format(sm='p.smiles')} WHERE n.status = 'expanded')"""


_CONF = "least(round_even(CASE WHEN {0} < 0.3 THEN 1 - {0} WHEN {0} < 0.45 THEN {0} + 0.5 WHEN {0} < 0.6 THEN {0} + 0.3 ELSE {0} END, 2), 0.99)"
FLAT = f"""kp AS (SELECT * FROM nd WHERE status IN ('stock', 'expanded')),
st AS (SELECT *, CAST(row_number() OVER (PARTITION BY route_id ORDER BY path) AS INT) AS step FROM kp WHERE status = 'expanded'),
steps AS (SELECT route_id, step, smiles AS product, {_CONF.format('confidence')} AS confidence FROM st),
basic AS (SELECT DISTINCT smiles FROM ({STOCK.replace('<= 35', '<= 18')})),
used AS (SELECT k.route_id, s.step, k.path[-1] AS ord, k.smiles, CASE WHEN b.smiles IS NULL THEN 'reactant' ELSE 'reagent' END AS role
  FROM kp k JOIN st s ON s.route_id = k.route_id AND s.path = k.parent LEFT JOIN basic b ON b.smiles = k.smiles),
mk AS (SELECT route_id, product, max(step) AS dep FROM steps GROUP BY 1, 2),
deps AS (SELECT s.route_id, s.step, q.ord, q.dep FROM steps s LEFT JOIN (SELECT u.route_id, u.step, u.ord, m.dep FROM used u JOIN mk m
  ON m.route_id = u.route_id AND m.product = u.smiles WHERE role = 'reactant') q ON q.route_id = s.route_id AND q.step = s.step)"""


def _route(select: str) -> str:
    return f"WITH RECURSIVE {BASE}, {_tree()}, {FLAT} {select}"


def _facts(select: str) -> str:
    """Over the flattened routes and ``f_all``, the formulas and masses of their ``texts``."""
    texts = "texts AS (SELECT row_number() OVER (ORDER BY smiles) AS mol_id, smiles FROM (SELECT product AS smiles FROM steps UNION SELECT smiles FROM used))"
    return graph_sql(select, extra=FORMULA, source="texts", pre=f"{BASE}, {_tree()}, {FLAT}, {texts}")


EDIT = """ord AS (SELECT o_custkey AS route_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS step FROM orders),
ed AS (SELECT route_id, step // 2 AS step, step AS dep FROM ord WHERE step > 1 UNION SELECT route_id, step - 3, step FROM ord WHERE step > 3 AND route_id % 3 = 0),
start AS (SELECT c_custkey AS route_id, CAST(1 + c_custkey % 7 AS INT) AS step FROM customer SEMI JOIN ord ON route_id = c_custkey AND step = 1 + c_custkey % 7),
gone AS (SELECT route_id, step FROM start UNION SELECT g.route_id, e.dep FROM gone g JOIN ed e ON e.route_id = g.route_id AND e.step = g.step),
lft AS (SELECT e.route_id, min(e.step) AS left_step FROM ed e JOIN start s ON s.route_id = e.route_id AND s.step = e.dep
  ANTI JOIN gone g ON g.route_id = e.route_id AND g.step = e.step GROUP BY 1),
kst AS (SELECT route_id, step FROM ord ANTI JOIN gone USING (route_id, step)),
ked AS (SELECT e.* FROM ed e ANTI JOIN gone g ON g.route_id = e.route_id AND g.step = e.step),
ked2 AS (SELECT e.* FROM ked e ANTI JOIN gone g ON g.route_id = e.route_id AND g.step = e.dep),
nw AS (SELECT c_custkey AS route_id, CAST(unnest(range(1, c_custkey % 4 + 1)) AS INT) AS step FROM customer),
mp AS (SELECT n.route_id, n.step, CAST(n.step + coalesce(m, 0) AS INT) AS new_step FROM nw n LEFT JOIN (SELECT route_id, max(step) AS m FROM kst GROUP BY 1) USING (route_id)),
asked AS (SELECT DISTINCT route_id FROM start),
kask AS (SELECT * FROM kst SEMI JOIN asked USING (route_id)),
mpa AS (SELECT n.route_id, n.step, CAST(n.step + coalesce(m, 0) AS INT) AS new_step FROM nw n SEMI JOIN asked USING (route_id) LEFT JOIN (SELECT route_id, max(step) AS m FROM kask GROUP BY 1) USING (route_id)),
par AS (SELECT o.route_id, o.step, CASE WHEN o.step = 1 THEN 0 ELSE p END AS parent FROM ord o LEFT JOIN
  (SELECT route_id, dep AS step, max(step) AS p FROM ed WHERE dep <> 1 GROUP BY 1, 2) USING (route_id, step)),
tree AS (SELECT DISTINCT route_id, 0 AS step, 0 AS depth, [0] AS path FROM par WHERE parent = 0 UNION ALL
  SELECT route_id, step, 0, [step] FROM par WHERE parent IS NULL UNION ALL
  SELECT p.route_id, p.step, t.depth + 1, list_append(t.path, p.step) FROM tree t JOIN par p ON p.route_id = t.route_id AND p.parent = t.step)"""


def _edit(select: str) -> str:
    return f"WITH RECURSIVE {EDIT} {select}"


ORACLES = {
    "g1_short_circuit": f"WITH {BASE} SELECT route_id, smiles, 'stock' AS status FROM tg SEMI JOIN stk USING (smiles)",
    "g2_expand_routes": f"WITH RECURSIVE {BASE}, {_tree()} SELECT route_id, path, depth, smiles, status FROM nd",
    "g2_expand_routes_strict": f"WITH RECURSIVE {STRICT}, {_tree('pick2')} SELECT route_id, path, depth, smiles, status FROM nd",
    "g3_expand_once": f"WITH {BASE} SELECT route_id, smiles, confidence FROM tg LEFT JOIN (SELECT target, max(confidence) AS confidence FROM pick GROUP BY 1) ON target = smiles",
    "g4_flatten_steps": _route("SELECT * FROM steps"),
    "g4_flatten_molecules": _route("SELECT * FROM used"),
    "g5_resolve_dependencies": _route("SELECT * FROM deps"),
    "g6_format_route": _route("SELECT s.*, n_deps FROM steps s JOIN (SELECT route_id, step, count(dep) AS n_deps FROM deps GROUP BY 1, 2) USING (route_id, step)"),
    "g6_step_metrics": _facts(
        "SELECT s.*, f.chemical_formula, round(f.mass, 4) AS mass, coalesce(CASE (length(l.smiles) + 2 * length(product)) % 40 " + " ".join(
            f"WHEN {c} THEN '{v}'" for c, _, _, v in dims.REACTION_CLASSES) + " END, 'N/A') AS scalability FROM steps s JOIN texts t ON t.smiles = s.product "
        "JOIN f_all f USING (mol_id) LEFT JOIN (SELECT route_id, step, max_by(smiles, ord) AS smiles FROM used GROUP BY 1, 2) l USING (route_id, step)"),
    "g6_molecule_metadata": _facts("SELECT u.*, f.chemical_formula, round(f.mass, 4) AS mass FROM used u JOIN texts t ON t.smiles = u.smiles JOIN f_all f USING (mol_id)"),
    "g7_enrich_steps": _route("SELECT *, CASE WHEN step % 3 > 0 THEN step || ' C' END AS temperature, CASE WHEN step % 4 > 0 THEN 'ref ' || product END AS literature FROM steps"),
    "g7_enrich_molecules": _route("SELECT * FROM used UNION ALL SELECT s.route_id, s.step, coalesce(m, -1) + 1, 'CCO', 'reagent' FROM steps s LEFT JOIN "
                                  "(SELECT route_id, step, max(ord) AS m FROM used GROUP BY 1, 2) USING (route_id, step) WHERE s.step % 2 = 1"),
    "g8_confidence_estimate": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CONF.format('(l_discount * 10 + 0.0)')} AS confidence FROM lineitem",
    "g10_scalability_index": "SELECT p_partkey, p_size + 5 AS code, coalesce(CASE p_size + 5 " + " ".join(
        f"WHEN {c} THEN '{v}'" for c, _, _, v in dims.REACTION_CLASSES) + " END, 'N/A') AS scalability FROM part",
    "g11_reaction_text": _route("SELECT s.route_id, s.step, coalesce(l, '') || '>>' || product AS reaction FROM steps s LEFT JOIN (SELECT route_id, step, "
                                "string_agg(smiles, '.' ORDER BY role = 'reagent', ord) AS l FROM used GROUP BY 1, 2) USING (route_id, step)"),
    "g12_in_stock_leaves": _route("SELECT route_id, count(*) FILTER (WHERE status = 'stock') AS in_stock, bool_and(status = 'stock') AS solved FROM nd WHERE status <> 'expanded' GROUP BY 1"),
    "h1_downstream": _edit("SELECT * FROM gone"),
    "h2_left_connection": _edit("SELECT * FROM lft"),
    "h3_keep_steps": _edit("SELECT * FROM kst"),
    "h3_keep_edges": _edit("SELECT * FROM ked2"),
    "h4_renumber": _edit("SELECT * FROM mp"),
    "h5_splice_steps": _edit("SELECT route_id, step, 'kept' AS origin, step AS old_step FROM kask UNION ALL SELECT route_id, new_step, 'new', step FROM mpa"),
    "h5_splice_edges": _edit("SELECT route_id, step, dep FROM ked2 SEMI JOIN asked USING (route_id) UNION ALL SELECT l.route_id, l.left_step, min(new_step) FROM lft l "
                             "JOIN mpa USING (route_id) GROUP BY 1, 2 UNION ALL SELECT a.route_id, a.new_step, b.new_step FROM mpa a JOIN mpa b ON b.route_id = a.route_id AND b.step = a.step + 1"),
    "h6_splice_status": _edit(
        "SELECT c_custkey AS request_id, CASE WHEN c_acctbal <= 0 OR c_custkey % 9 = 0 THEN 400 WHEN o.step IS NULL THEN 404 WHEN c_custkey % 11 = 0 THEN 400 "
        "WHEN coalesce(k, 0) + c_custkey % 4 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN c_acctbal <= 0 THEN 'no previous result' WHEN c_custkey % 9 = 0 THEN 'no result for this molecule' "
        "WHEN o.step IS NULL THEN 'step not found' WHEN c_custkey % 11 = 0 THEN 'step has no products' WHEN coalesce(k, 0) + c_custkey % 4 = 0 THEN 'nothing left' "
        "WHEN c_custkey % 4 = 0 THEN 'no further steps needed' ELSE 'ok' END AS message FROM customer LEFT JOIN ord o ON o.route_id = c_custkey AND o.step = 1 + c_custkey % 7 "
        "LEFT JOIN (SELECT route_id, count(*) AS k FROM kst GROUP BY 1) q ON q.route_id = c_custkey"),
    "h7_add_root_step": _edit("SELECT route_id, CASE WHEN step = 1 AND l_linenumber = 1 THEN 0 ELSE step END AS step, l_linenumber - 1 - CASE WHEN step = 1 AND l_linenumber > 1 THEN 1 ELSE 0 END AS ord, "
                              "l_partkey::VARCHAR AS smiles FROM lineitem JOIN ord ON l_orderkey = o_orderkey"),
    "h8_parent_of_step": _edit("SELECT * FROM par"),
    "h9_route_tree": _edit("SELECT * FROM tree"),
    "h9_route_roots": _edit("SELECT route_id, step, depth, path[1] AS root FROM tree"),
    "h10_dependency_edges": _edit("SELECT route_id, dep AS source, step AS target FROM ed"),
}
