"""Queries for memo tables, evaluation, batch runs, classification and files."""
from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import dims
from ..bridge import PART_SMILES, derive, load, pool_of, smiles_of, text_of, view
from ..functions.text import unmask_groups
from ..operators import batch as L
from ..operators import classify as K
from ..operators import evaluate as J
from ..operators import graph as G
from ..operators import memo as I
from ..operators import molecule as M
from ..operators import routes as R
from ..plans.ranking import numbered
from ..plans.staging import checkpoint_root, stage
from ..sources import readers, writers
from .compare import SIDES
from .graph import KEKULE
from .molecule import FORMULA, KEYS, LABELS
from .routes import _flat, _route
from .sqlgraph import graph_sql


def _path(s) -> str:
    return f"{checkpoint_root(s)}/exchange/{uuid.uuid4().hex}"


# --- memo -----------------------------------------------------------------------------
WORK = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {smiles_of('l_partkey', 'l_partkey')} AS smiles FROM lineitem"
PARTS = f"SELECT p_partkey, {PART_SMILES} AS smiles FROM part"
DONE = f"{PARTS} WHERE p_size > 25"  # what is stored before the missing rest is computed


def _cleared(s, d):
    """Entries before and after."""
    memo = _memo(s, d, PARTS)
    both = memo.select(F.lit(True).alias("old")).unionByName(I.clear_all(memo).select(F.lit(False).alias("old")))
    return both.agg(F.count_if("old").alias("n_before"), F.count_if(~F.col("old")).alias("n_after"))


def _memo(s, d, rows=DONE):
    return derive(s, d, rows).select(
        I.memo_args("smiles").alias("input_args"), F.lit("stored").alias("result")
    ).withColumn("key", I.memo_key("plain", F.col("input_args"))).select("key", "input_args", "result")


def _compute(s, d):
    return I.compute_missing(
        derive(s, d, WORK), _memo(s, d), "plain", ["smiles"],
        lambda m: m.withColumn("result", unmask_groups(F.col("smiles"))))


_KEY = "'plain:' || md5('{\"smiles\":\"' || smiles || '\"}')"

# --- evaluation -----------------------------------------------------------------------
TRUE_PARTS = f"SELECT l_orderkey AS id, l_linenumber AS place, l_partkey AS pk, {smiles_of('l_partkey', 'l_partkey')} AS smiles FROM lineitem"
_SHIFT = "(l_partkey - CASE WHEN l_quantity > 40 AND l_partkey > 0 THEN 1 ELSE 0 END)"
PRED_PARTS = f"SELECT l_orderkey AS id, l_linenumber AS place, {_SHIFT} AS pk, {smiles_of(_SHIFT, _SHIFT)} AS smiles FROM lineitem WHERE l_discount < 0.095"


def _truth(s, d):
    return derive(s, d, TRUE_PARTS)


def _pred(s, d):
    return derive(s, d, PRED_PARTS)


def _scores(s, d):
    return J.score_predictions(_truth(s, d), _pred(s, d))


def accuracy_by_priority(s, d):
    """Flagship: J1-J6 over whole tables, per order priority."""
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return J.accuracy(_scores(s, d).join(o, "id"), "priority")


def _keyed(s, d):
    both = _truth(s, d).withColumn("t", F.lit(True)).unionByName(_pred(s, d).withColumn("t", F.lit(False)))
    keyed = stage(J.with_keys(both))
    return keyed.where("t"), keyed.where("NOT t")


def _extra(swap):
    def run(s, d):
        t, p = _keyed(s, d)
        return (J.not_common(p, t) if swap else J.not_common(t, p)).select("id", "place", "smiles")
    return run


def _routes(s, d):
    o = load(s, d, "orders")
    base = numbered(o.select(F.col("o_custkey").alias("route_id"), "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"),
                    ["route_id"], ["o_orderkey"], "n")
    base = stage(base.withColumn("idx", F.col("n") - 1))
    reactants = F.array("o_orderpriority", "o_orderstatus")
    truth = base.select("route_id", "idx", F.col("o_orderkey").cast("string").alias("product"), reactants.alias("reactants"))
    wrong = F.col("o_totalprice") > 495000
    pred = base.select("route_id", "idx", F.col("o_orderkey").cast("string").alias("product"),
                       F.when(wrong, F.array(F.lit("x"))).otherwise(F.reverse(reactants)).alias("reactants"))
    pred = pred.where("route_id > 50")
    return truth, pred


def _exact(s, d):
    t, p = _routes(s, d)
    return J.route_exact(t, p, J.align_routes(t, p))


def _route_accuracy(s, d):
    c = load(s, d, "customer").select(F.col("c_custkey").alias("truth_id"), F.col("c_mktsegment").alias("folder"), (F.col("c_nationkey") % 3).alias("run"))
    return J.route_accuracy(_exact(s, d).join(c, "truth_id"), "folder", "run")


ROUTE_SQL = """o AS (SELECT o_custkey AS route_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderkey, o_totalprice FROM orders),
al AS (SELECT route_id AS truth_id, o_orderkey::VARCHAR AS product, CASE WHEN route_id > 50 THEN route_id END AS predicted_id FROM o WHERE idx = 0),
ex AS (SELECT route_id AS truth_id, bool_and(route_id > 50 AND o_totalprice <= 495000) AS exact, CAST(min(idx) FILTER (WHERE NOT (route_id > 50 AND o_totalprice <= 495000)) AS INT) AS first_mismatch FROM o GROUP BY 1)"""

PATHS = "SELECT l_orderkey AS route_id, l_linenumber AS idx, l_partkey AS pk, concat(cast(l_partkey AS string), '>', l_returnflag, '>', cast(l_suppkey AS string), '.', l_linestatus) AS text FROM lineitem"

# --- batch ----------------------------------------------------------------------------
FOLDERS = ["base:v1", "base:v2", "large:v1", "unknown:v9"]
MODELS = [("base", "vendor/base-1", True, True, False), ("large", "vendor/large-2", True, False, True), ("tiny", "vendor/tiny", False, True, True)]
DEFAULTS = {"model_type": "base", "model_version": "v1", "advanced_prompt": False, "stability_flag": True, "hallucination_check": True}
VERSIONS = ["v1", "v2"]
REQ = ("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS smiles, CASE user_id % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'large' WHEN 2 THEN 'tiny' "
       "WHEN 3 THEN 'missing' END AS model_type, CASE event_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN 'v7' END AS model_version, "
       "CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END AS advanced_prompt, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'no' END AS stability_flag, "
       "CASE event_id % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'False' END AS hallucination_check FROM events")
_MODEL = ("concat('{\"internal_name\": \"i\", \"display_name\": \"d\", \"supports_advanced_prompt\": true', CASE o_orderkey % 3 WHEN 0 THEN '' ELSE ', \"supports_stability_check\": true' END, "
          "CASE o_orderkey % 4 WHEN 0 THEN '' ELSE ', \"supports_hallucination_check\": false' END, '}')")
CONF = (f"SELECT o_orderkey AS config_id, concat('{{', CASE o_orderkey % 5 WHEN 0 THEN '' ELSE concat('\"llm_models\": {{\"m', cast(o_orderkey % 2 AS string), '\": ', {_MODEL}, '}}, ') END, "
        "CASE o_orderkey % 6 WHEN 0 THEN '' ELSE '\"az_models\": {\"v1\": {\"display_name\": \"V1\"}}, ' END, '\"defaults\": {\"model_type\": \"m0\", \"advanced_prompt\": false', "
        "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ', \"model_version\": \"v2\"' ELSE ', \"model_version\": \"v1\"' END, ', \"stability_flag\": true, \"hallucination_check\": true}}') AS text FROM orders")


def _models(s):
    return s.createDataFrame(MODELS, "model_key string, internal_name string, supports_advanced_prompt boolean, supports_stability_check boolean, supports_hallucination_check boolean")


def _requests(strict):
    return lambda s, d: L.resolve_requests(derive(s, d, REQ), _models(s), DEFAULTS, VERSIONS, strict).select(
        "event_id", "status", "model", "version", "advanced_prompt", "stability_flag", "hallucination_check")


def _isolated(s, d):
    m = view(s, d, "molecules")
    return L.isolate_errors(M.is_valid(m), F.col("valid"), F.lit("unreadable text")).select("mol_id", "status", "error")


# --- classification -------------------------------------------------------------------
RXN = (f"SELECT p_partkey AS id, concat({PART_SMILES}, CASE WHEN p_size = 50 THEN '' ELSE '>>' END, {smiles_of('p_partkey', '(p_partkey + p_size % 5)')}) AS rxn, p_type AS rxn_class, "
       "CASE WHEN p_size > 30 THEN 'test' ELSE 'train' END AS split FROM part")
NAMES = "SELECT p_partkey, CASE WHEN p_size < 40 THEN upper(" + pool_of("p_partkey", [n for _, _, n, _ in dims.REACTION_CLASSES]) + ") ELSE p_name END AS name FROM part"


def _rxn(s, d):
    return derive(s, d, RXN)


def _prints(s, d):
    return K.with_fingerprints(K.split_reaction(K.encode_class(_rxn(s, d))).where("n_parts = 2"))


def _predictions(s, d, split="test"):
    """Predictions for the rows of a split, or for all rows."""
    data = stage(_prints(s, d).select("id", "split", "label", "input_bits", "output_bits"))
    model = K.train(K.features(K.split_rows(data, "train")))
    return K.predict(model, K.features(K.split_rows(data, split) if split else data)).select("id", "label", "prediction")


# A label that the molecules show: the tail of the input tells the class.
TAILS = ["c1ccncc1", "S(=O)(=O)C", "CC#N"]
SHOWN = (f"SELECT p_partkey AS id, concat({text_of('p_partkey')}, {pool_of('p_partkey', TAILS)}, '>>', {PART_SMILES}) AS rxn, "
         "cast(p_partkey % 3 AS int) AS code, CASE WHEN p_size > 30 THEN 'test' ELSE 'train' END AS split FROM part")


def _saved_model(s, d):
    """Fitted on one split, saved, loaded and asked about the rows of the other whose output can be read."""
    p = _path(s)
    rows = K.with_fingerprints(K.split_reaction(derive(s, d, SHOWN))).withColumn("label", F.col("code").cast("double"))
    data = stage(rows.select("id", "split", "label", "input_bits", "output_bits"))
    K.save_model(K.train(K.features(K.split_rows(data, "train"))), p)
    return K.predict(K.load_model(p), K.features(K.split_rows(data, "test"))).select("id", "label", "prediction")


def _saved_model_types(s, d):
    pairs = derive(s, d, SHOWN).where("split = 'test'").select(F.col("id").alias("pair_id"))
    return R.reaction_type(pairs, _saved_model(s, d).select(F.col("id").alias("pair_id"), "prediction"), dims.reaction_classes(s))


def _describe(s, d):
    found = K.describe(load(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_partkey"))
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


def _reaction_type(s, d):
    pairs = _rxn(s, d).select(F.col("id").alias("pair_id"))
    p = _predictions(s, d, None).select(F.col("id").alias("pair_id"), "prediction")
    return R.reaction_type(pairs, p, dims.reaction_classes(s))


def _votes(s, d):
    """Label and guess per line: return flag against a rule on the quantity."""
    return load(s, d, "lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_quantity") > 30, "N").when(F.col("l_quantity") > 15, "A").otherwise("R").alias("prediction"))


def _names(i):
    return lambda s, d: K.class_scalability(derive(s, d, NAMES), dims.reaction_classes(s))[i]


# --- files ----------------------------------------------------------------------------
def _a1(s, d):
    p = _path(s)
    m = view(s, d, "molecules").select(F.col("smiles"), F.col("mol_id").cast("string").alias(" common_name"))
    m.write.csv(p, header=True)
    return readers.read_molecules(s, p)


REACT = f"SELECT p_partkey AS row_id, {PART_SMILES} AS input, concat({PART_SMILES}, '.', 'CCO') AS output, p_size AS reaction_type FROM part"


def _a2(s, d):
    p = _path(s)
    derive(s, d, REACT).withColumnRenamed("row_id", "_c0").write.csv(p, header=True)
    return readers.read_reactions(s, p)


def _a3(s, d):
    p = _path(s)
    _rxn(s, d).withColumn("original_rxn", F.col("rxn")).withColumn("source", F.lit("x")).write.csv(p, header=True, sep="\t")
    return readers.read_labelled_reactions(s, p)


TREE = ("SELECT o_orderkey AS route_id, concat('{\"smiles\": \"', o_orderpriority, '\", \"in_stock\": false, \"children\": [{\"is_reaction\": true, \"metadata\": {\"policy_probability\": 0.', "
        "cast(o_orderkey % 9 AS string), '}, \"children\": [{\"smiles\": \"', o_orderstatus, '\", \"in_stock\": true}, {\"smiles\": \"S', cast(o_custkey AS string), '\", \"in_stock\": false}]}]}') AS text FROM orders")


ROUTE_FILES = ("SELECT s_suppkey AS route_id, CASE WHEN s_suppkey % 7 = 3 THEN concat('{\"name\": \"', s_name) "
               "ELSE concat('{\"name\": \"', s_name, '\", \"steps\": [{\"step\": ', cast(s_nationkey AS string), '}, {\"step\": 2}]}') END AS text FROM supplier")
CONF_FILES = ("SELECT s_suppkey AS config_id, CASE WHEN s_suppkey % 7 = 3 THEN 'no settings' ELSE concat('{\"llm_models\": {\"m', cast(s_nationkey AS string), "
              "'\": {\"internal_name\": \"', s_name, '\", \"supports_advanced_prompt\": true}}, \"defaults\": {\"model_type\": \"m', cast(s_nationkey AS string), '\", \"advanced_prompt\": false}}') END AS text FROM supplier")


def _a4(s, d):
    p = _path(s)
    writers.write_documents(derive(s, d, ROUTE_FILES), p, "route_id", "text")
    found = readers.read_routes(s, p, "name string, steps array<struct<step: bigint>>")
    return found.select("route_id", "name", F.col("steps.step").alias("steps"), F.col("_broken").isNotNull().alias("broken"))


def _a6(s, d):
    p = _path(s)
    writers.write_documents(derive(s, d, CONF_FILES), p, "config_id", "text")
    models, defaults, broken = readers.read_configs(s, p)
    at = F.col("config_id").cast("bigint").alias("config_id")
    return (
        models.select(at, F.lit("model").alias("kind"), F.col("model_key").alias("name"), F.col("internal_name").alias("value"))
        .unionByName(defaults.select(at, F.lit("default").alias("kind"), "name", "value"))
        .unionByName(broken.select(at, F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("name"), "value")))


def _a5(s, d):
    return readers.read_route_trees(derive(s, d, TREE))


def _a7(s, d):
    p = _path(s)
    prop = "struct(array(struct('Mass' AS kind, cast(p_size AS string) AS value), struct(CASE WHEN p_size > 45 THEN 'Other' ELSE 'SMILES' END AS kind, smiles AS value)) AS property)"
    m = derive(s, d, f"SELECT p_partkey, p_size, {PART_SMILES} AS smiles FROM part")
    m.select(F.col("p_partkey").cast("string").alias("name"), F.expr(prop).alias("calculated-properties")).write.format("xml").option(
        "rowTag", "drug").option("rootTag", "drugs").save(p)
    return readers.extract_xml_property(s, p)


def _a8(s, d):
    p = _path(s)
    c = load(s, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("folder"), (F.col("c_nationkey") % 3).alias("run"))
    writers.write_routes(c, p)
    return s.read.schema("c_custkey bigint, c_name string, folder string, run int").json(p)


def _a9(s, d):
    p = _path(s)
    o = load(s, d, "orders").select(F.col("o_custkey").cast("string").alias("target"), F.col("o_orderkey").alias("saved_at"), F.col("o_orderpriority").alias("result"))
    writers.save_result(o, p)
    return readers.load_result(s, p)


def _a10(s, d):
    p = _path(s)
    li = load(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array("l_returnflag", F.col("l_shipdate").cast("date").cast("string")).alias("marks"), "l_quantity")
    writers.write_csv(li, p, ["marks"], keep=F.col("l_quantity") > 25)
    return readers.read_csv_lists(s, p, "l_orderkey bigint, l_linenumber int, l_partkey bigint, marks string, l_quantity double", ["marks"])


def _judged(s, d):
    """Events judged and stored: the report next to what each sink holds."""
    p = _path(s)
    events = L.isolate_errors(load(s, d, "events").select("event_id", "event_type", F.col("value").alias("elapsed")),
                              (F.col("elapsed") < 100) & (F.col("event_type") != "error"), F.concat(F.lit("failed: "), "event_type"))
    report = writers.write_judged(events, p)
    stored = s.read.parquet(p).groupBy("status").agg(F.count("event_id").alias("n_stored"), F.count("error").alias("n_reasons"))
    return report.join(stored, "status")


QUERIES = {
    "i1_memo_key": lambda s, d: _memo(s, d, PARTS).select("key", "input_args"),
    "i2_compute_missing": lambda s, d: _compute(s, d)[0].select("l_orderkey", "l_linenumber", "l_partkey", "key", "result"),
    "i2_memo_additions": lambda s, d: _compute(s, d)[1],
    "i3_clear_all": _cleared,
    "i4_evict": lambda s, d: I.evict(_memo(s, d, PARTS), "c1ccc"),
    "i4_evict_all": lambda s, d: I.evict_all(_memo(s, d, PARTS), derive(s, d, f"SELECT concat('C(F)', {pool_of('n_nationkey')}) AS smiles FROM nation")),
    "j1_first_step": lambda s, d: J.first_step(*reversed(_flat(s, d)))[0],
    "j2_attach_results": lambda s, d: J.attach_results(
        load(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"),
        load(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") > 5, F.col("event_type")).alias("event_type"))),
    "j3_product_mismatch": lambda s, d: J.product_mismatch(view(s, d, "pairs").select("pair_id", F.col("reactant").alias("input"), "product")),
    "j4_correctness": _scores,
    "j5_not_common": _extra(False),
    "j5_missed": _extra(True),
    "j6_accuracy": accuracy_by_priority,
    "j7_needs_review": lambda s, d: J.needs_review(_scores(s, d)).select("id"),
    "j8_parse_truth_path": lambda s, d: J.parse_truth_path(derive(s, d, PATHS)),
    "j9_align_routes": lambda s, d: J.align_routes(*_routes(s, d)),
    "j10_route_exact": _exact,
    "j11_route_accuracy": _route_accuracy,
    "j12_sample_n": lambda s, d: J.sample_n(load(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), 200, 42),
    "j13_restrict_to": lambda s, d: J.restrict_to(
        load(s, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey"), load(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))),
    "k1_split_rows": lambda s, d: K.split_rows(_rxn(s, d), "test"),
    "k2_encode_class": lambda s, d: K.encode_class(_rxn(s, d)).select("id", F.col("label").cast("int").alias("label")),
    "k3_split_reaction": lambda s, d: K.split_reaction(_rxn(s, d)).select("id", "input", "output", "n_parts"),
    "k4_fingerprints": lambda s, d: _prints(s, d).select("id", F.size("input_bits").alias("n_input"), F.size("output_bits").alias("n_output")),
    "k5_features": lambda s, d: K.features(_prints(s, d)).select("id", F.size(F.filter(vector_to_array("features"), lambda x: x > 0)).alias("n_set")),
    "k7_predict": _predictions,
    "k9_saved_model": _saved_model,
    "k8_class_report": lambda s, d: K.class_report(_votes(s, d)),
    "k8_accuracy": lambda s, d: K.accuracy(_votes(s, d)),
    "k10_class_scalability": _names(0),
    "k10_unmatched": _names(1),
    "k11_describe": _describe,
    "g9_reaction_type": _reaction_type,
    "g9_saved_model_types": _saved_model_types,
    "l1_sweep": lambda s, d: L.sweep(view(s, d, "molecules").select("mol_id"), FOLDERS, 2, _models(s).select("model_key", "internal_name")),
    "l2_isolate_errors": _isolated,
    "l3_judged_run": _judged,
    "l3_run_report": lambda s, d: L.run_report(load(s, d, "events").select(F.col("event_type").alias("status"), F.col("value").alias("elapsed"))),
    "l4_resolve_requests": _requests(False),
    "l4_resolve_strict": _requests(True),
    "l5_check_config": lambda s, d: L.check_config(derive(s, d, CONF)),
    "a1_read_molecules": _a1,
    "a2_read_reactions": _a2,
    "a3_read_labelled_reactions": _a3,
    "a4_read_routes": _a4,
    "a6_read_configs": _a6,
    "a5_read_route_trees": lambda s, d: _a5(s, d).select("route_id", "path", "kind", "smiles", "in_stock", "prob"),
    "a7_extract_xml_property": _a7,
    "a8_write_routes": _a8,
    "a9_save_result": _a9,
    "a10_write_csv": _a10,
}

EVAL = f"""{KEKULE},{LABELS},{KEYS},
mk AS (SELECT pk, coalesce(skey, smiles) AS mol FROM molecules JOIN k_key USING (mol_id) JOIN (SELECT p_partkey AS pk, p_partkey AS mol_id FROM part) USING (mol_id)),
tr AS (SELECT t.*, mol FROM ({TRUE_PARTS}) t JOIN mk USING (pk)), pr AS (SELECT t.*, mol FROM ({PRED_PARTS}) t JOIN mk USING (pk)),
sc AS (SELECT id, CAST(nt = coalesce(np, 0) AND coalesce(nc, 0) > 0 AS INT) AS any_correct, CAST(nt = coalesce(np, 0) AND coalesce(nc, 0) = coalesce(np, 0) AS INT) AS all_correct
  FROM (SELECT id, count(*) AS nt FROM tr GROUP BY 1) LEFT JOIN (SELECT id, count(*) AS np, count(*) FILTER (WHERE (id, mol) IN (SELECT (id, mol) FROM tr)) AS nc FROM pr GROUP BY 1) USING (id))"""


PRINTS = f"""{KEKULE},{LABELS}, rxn AS (SELECT p_partkey AS id FROM part WHERE p_size <> 50),
fp AS (SELECT mol_id, count(DISTINCT ('0x' || l[1:8])::BIGINT % 2048) AS n FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)
  JOIN g_valid USING (mol_id) WHERE valid GROUP BY 1)"""


def _eval(select: str) -> str:
    return graph_sql(select, rings=True, extra=EVAL)


def _req(strict: bool) -> str:
    no = "OR (ap AND NOT sa) OR (sf AND NOT ss) OR (hc AND NOT sh)" if strict else ""
    vals = ", ".join(f"('{a}', '{b}', {c}, {e}, {f})" for a, b, c, e, f in MODELS)
    return (f"WITH r AS ({REQ}), m(k, nm, sa, ss, sh) AS (VALUES {vals}), f AS (SELECT event_id, smiles, coalesce(model_version, 'v1') AS v, m.*, "
            "CASE WHEN advanced_prompt IS NULL THEN false ELSE lower(advanced_prompt) = 'true' END AS ap, CASE WHEN stability_flag IS NULL THEN true ELSE lower(stability_flag) = 'true' END AS sf, "
            "CASE WHEN hallucination_check IS NULL THEN true ELSE lower(hallucination_check) = 'true' END AS hc FROM r LEFT JOIN m ON k = coalesce(model_type, 'base')), "
            f"g AS (SELECT *, CASE WHEN smiles IS NULL OR nm IS NULL OR v NOT IN ('v1', 'v2') {no} THEN 400 ELSE 200 END AS status FROM f) "
            "SELECT event_id, status, CASE WHEN status = 200 THEN nm || CASE WHEN ap AND sa THEN ':adv' ELSE '' END END AS model, CASE WHEN status = 200 THEN v END AS version, "
            "CASE WHEN status = 200 THEN ap AND sa END AS advanced_prompt, CASE WHEN status = 200 THEN sf AND ss END AS stability_flag, CASE WHEN status = 200 THEN hc AND sh END AS hallucination_check FROM g")


_CLASSES = ", ".join(f"({c}, '{n}', {v})" for c, _, n, v in dims.REACTION_CLASSES)
_MEMO = f"SELECT {_KEY} AS key, '{{\"smiles\":\"' || smiles || '\"}}' AS input_args, 'stored' AS result FROM ({DONE})"
_MEMO_ALL = _MEMO.replace(DONE, PARTS)
_UNMASK = "replace(replace(replace(smiles, '$', 'OC'), '%', 'COCc1ccccc1'), '&', 'COC')"
_VOTES = "SELECT l_returnflag AS label, CASE WHEN l_quantity > 30 THEN 'N' WHEN l_quantity > 15 THEN 'A' ELSE 'R' END AS prediction FROM lineitem"

ORACLES = {
    "i1_memo_key": f"SELECT key, input_args FROM ({_MEMO_ALL})",
    "i2_compute_missing": f"WITH w AS ({WORK}), m AS ({_MEMO}) SELECT l_orderkey, l_linenumber, l_partkey, {_KEY} AS key, CASE WHEN {_KEY} IN (SELECT key FROM m) THEN 'stored' ELSE {_UNMASK} END AS result FROM w",
    "i2_memo_additions": f"WITH w AS (SELECT DISTINCT smiles FROM ({WORK})), m AS ({_MEMO}) SELECT {_KEY} AS key, '{{\"smiles\":\"' || smiles || '\"}}' AS input_args, {_UNMASK} AS result FROM w WHERE {_KEY} NOT IN (SELECT key FROM m)",
    "i3_clear_all": f"SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM ({_MEMO_ALL})",
    "i4_evict": f"SELECT * FROM ({_MEMO_ALL}) WHERE NOT contains(input_args, 'c1ccc')",
    "i4_evict_all": f"SELECT * FROM ({_MEMO_ALL}) m WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(m.input_args, concat('C(F)', {pool_of('n_nationkey')})))",
    "j1_first_step": _route("SELECT route_id, ord, smiles, role FROM used WHERE step = 1"),
    "j2_attach_results": "SELECT o_orderkey AS id, o_custkey, event_type FROM orders JOIN events ON event_id = o_orderkey WHERE value > 5 AND event_type IS NOT NULL AND o_custkey IS NOT NULL",
    "j3_product_mismatch": f"SELECT * FROM (SELECT p_partkey AS pair_id, {PART_SMILES} AS input, {smiles_of('p_partkey', '(p_partkey + p_size % 5)')} AS product FROM part) WHERE input <> product",
    "j4_correctness": _eval("SELECT * FROM sc"),
    "j5_not_common": _eval("SELECT id, place, smiles FROM pr WHERE (id, mol) NOT IN (SELECT (id, mol) FROM tr)"),
    "j5_missed": _eval("SELECT id, place, smiles FROM tr WHERE (id, mol) NOT IN (SELECT (id, mol) FROM pr)"),
    "j6_accuracy": _eval("SELECT o_orderpriority AS priority, round(100 * avg(any_correct), 6) AS any_pct, round(100 * avg(all_correct), 6) AS all_pct, count(*) AS n FROM sc JOIN orders ON o_orderkey = id GROUP BY 1"),
    "j7_needs_review": _eval("SELECT id FROM sc WHERE any_correct <> 1"),
    "j8_parse_truth_path": "SELECT l_orderkey AS route_id, l_linenumber AS idx, l_partkey::VARCHAR AS product, [l_suppkey::VARCHAR, l_linestatus] AS reactants FROM lineitem",
    "j9_align_routes": f"WITH {ROUTE_SQL} SELECT * FROM al",
    "j10_route_exact": f"WITH {ROUTE_SQL} SELECT * FROM ex",
    "j11_route_accuracy": f"WITH {ROUTE_SQL} SELECT c_mktsegment AS folder, c_nationkey % 3 AS run, round((1 - count(*) FILTER (WHERE NOT exact) / count(*)) * 100, 6) AS accuracy FROM ex JOIN customer ON c_custkey = truth_id GROUP BY 1, 2",
    "j12_sample_n": "SELECT o_orderkey AS id, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 200",
    "j13_restrict_to": "SELECT l_partkey AS id, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)",
    "k1_split_rows": f"SELECT * FROM ({RXN}) WHERE split = 'test'",
    "k2_encode_class": f"SELECT id, CAST(dense_rank() OVER (ORDER BY rxn_class) - 1 AS INT) AS label FROM ({RXN})",
    "k3_split_reaction": f"SELECT id, string_split(rxn, '>>')[1] AS input, string_split(rxn, '>>')[2] AS output, len(string_split(rxn, '>>')) AS n_parts FROM ({RXN})",
    "k4_fingerprints": graph_sql("SELECT id, a.n AS n_input, b.n AS n_output FROM rxn JOIN fp a ON a.mol_id = id * 2 JOIN fp b ON b.mol_id = id * 2 + 1", rings=True, extra=PRINTS, source="sides", pre=SIDES),
    "k5_features": graph_sql("SELECT id, a.n + b.n AS n_set FROM rxn JOIN fp a ON a.mol_id = id * 2 JOIN fp b ON b.mol_id = id * 2 + 1", rings=True, extra=PRINTS, source="sides", pre=SIDES),
    "k8_class_report": f"WITH v AS ({_VOTES}), a AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS hits FROM v GROUP BY 1), g AS (SELECT prediction AS class, count(*) AS guessed FROM v GROUP BY 1), "
                       "q AS (SELECT class, support, coalesce(hits / guessed, 0.0) AS p, hits / support AS r FROM a LEFT JOIN g USING (class)) SELECT class, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM q",
    "k8_accuracy": f"SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM ({_VOTES})",
    "k10_class_scalability": f"WITH n AS ({NAMES}), c(code, nm, scalability) AS (VALUES {_CLASSES}) SELECT p_partkey, name, code, scalability FROM n JOIN c ON lower(nm) = lower(name)",
    "k10_unmatched": f"WITH n AS ({NAMES}), c(code, nm, scalability) AS (VALUES {_CLASSES}) SELECT p_partkey, name FROM n WHERE lower(name) NOT IN (SELECT lower(nm) FROM c)",
    "l1_sweep": "SELECT p_partkey AS mol_id, folder, run, split_part(folder, ':', 1) AS model_key, split_part(folder, ':', 2) AS version, internal_name FROM part, (VALUES ('base:v1'), ('base:v2'), ('large:v1'), ('unknown:v9')) f(folder), "
                "(VALUES (1), (2)) r(run) LEFT JOIN (VALUES ('base', 'vendor/base-1'), ('large', 'vendor/large-2'), ('tiny', 'vendor/tiny')) m(k, internal_name) ON k = split_part(folder, ':', 1)",
    "l2_isolate_errors": graph_sql("SELECT mol_id, CASE WHEN valid THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT valid THEN 'unreadable text' END AS error FROM g_valid"),
    "k11_describe": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS stddev, min(x) AS min, quantile_disc(x, 0.25) AS p25, "
        f"quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.75) AS p75, max(x) AS max FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")),
    "l3_judged_run": "SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(avg(value), 6) AS mean_elapsed, count(*) AS n_stored, "
                     "count(*) FILTER (WHERE status = 'error') AS n_reasons FROM (SELECT *, CASE WHEN value < 100 AND event_type <> 'error' THEN 'ok' ELSE 'error' END AS status FROM events) GROUP BY 1",
    "l3_run_report": "SELECT event_type AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(avg(value), 6) AS mean_elapsed FROM events GROUP BY 1",
    "l4_resolve_requests": _req(False),
    "l4_resolve_strict": _req(True),
    "l5_check_config":
        "WITH k AS (SELECT o_orderkey AS id FROM orders) SELECT id AS config_id, 'missing section llm_models' AS violation FROM k WHERE id % 5 = 0 UNION ALL SELECT id, 'missing section az_models' FROM k WHERE id % 6 = 0 "
        "UNION ALL SELECT id, 'missing default model_version' FROM k WHERE id % 7 = 0 UNION ALL SELECT id, 'unknown default model m0' FROM k WHERE id % 5 <> 0 AND id % 2 = 1 "
        "UNION ALL SELECT id, 'unknown default version v2' FROM k WHERE id % 6 <> 0 AND id % 7 = 1 UNION ALL SELECT id, 'model m' || (id % 2) || ' lacks supports_stability_check' FROM k WHERE id % 5 <> 0 AND id % 3 = 0 "
        "UNION ALL SELECT id, 'model m' || (id % 2) || ' lacks supports_hallucination_check' FROM k WHERE id % 5 <> 0 AND id % 4 = 0",
    "a1_read_molecules": f"SELECT {PART_SMILES} AS smiles, p_partkey::VARCHAR AS common_name FROM part",
    "a2_read_reactions": REACT,
    "a3_read_labelled_reactions": f"SELECT id::VARCHAR AS id, rxn, rxn_class, split FROM ({RXN})",
    "a4_read_routes": "SELECT s_suppkey AS route_id, CASE WHEN s_suppkey % 7 <> 3 THEN s_name END AS name, CASE WHEN s_suppkey % 7 <> 3 THEN [s_nationkey::BIGINT, 2] END AS steps, "
                      "s_suppkey % 7 = 3 AS broken FROM supplier",
    "a6_read_configs": "SELECT s_suppkey AS config_id, 'broken' AS kind, NULL::VARCHAR AS name, 'no settings' AS value FROM supplier WHERE s_suppkey % 7 = 3 "
                       "UNION ALL SELECT s_suppkey, 'model', 'm' || s_nationkey, s_name FROM supplier WHERE s_suppkey % 7 <> 3 UNION ALL SELECT s_suppkey, 'default', 'model_type', 'm' || s_nationkey FROM supplier "
                       "WHERE s_suppkey % 7 <> 3 UNION ALL SELECT s_suppkey, 'default', 'advanced_prompt', 'false' FROM supplier WHERE s_suppkey % 7 <> 3",
    "k9_saved_model": graph_sql("SELECT id, CAST(id % 3 AS DOUBLE) AS label, CAST(id % 3 AS DOUBLE) AS prediction FROM (SELECT p_partkey AS id FROM part WHERE p_size > 30) JOIN g_valid ON mol_id = id WHERE valid"),
    "g9_saved_model_types": graph_sql(f"SELECT id AS pair_id, CASE WHEN valid THEN nm ELSE 'Unknown Reaction' END AS name, CAST(CASE WHEN valid THEN code ELSE -1 END AS INT) AS code "
                                      f"FROM (SELECT p_partkey AS id FROM part WHERE p_size > 30) JOIN g_valid ON mol_id = id JOIN (VALUES {_CLASSES}) c(code, nm, scalability) ON code = id % 3"),
    "a5_read_route_trees":
        "SELECT o_orderkey AS route_id, CAST([] AS INT[]) AS path, 'mol' AS kind, o_orderpriority AS smiles, false AS in_stock, NULL::DOUBLE AS prob FROM orders UNION ALL SELECT o_orderkey, [0], 'reaction', NULL, NULL, (o_orderkey % 9) / 10.0 FROM orders "
        "UNION ALL SELECT o_orderkey, [0, 0], 'mol', o_orderstatus, true, NULL FROM orders UNION ALL SELECT o_orderkey, [0, 1], 'mol', 'S' || o_custkey, false, NULL FROM orders",
    "a7_extract_xml_property": f"SELECT p_partkey::VARCHAR AS name, {PART_SMILES} AS value FROM part WHERE p_size <= 45",
    "a8_write_routes": "SELECT c_custkey, c_name, c_mktsegment AS folder, c_nationkey % 3 AS run FROM customer",
    "a9_save_result": "SELECT o_custkey::VARCHAR AS target, max_by(o_orderpriority, o_orderkey) AS result FROM orders GROUP BY 1",
    "a10_write_csv": "SELECT l_orderkey, l_linenumber, l_partkey, [l_returnflag, l_shipdate::DATE::VARCHAR] AS marks, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem WHERE l_quantity > 25",
}
