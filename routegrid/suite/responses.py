"""Queries for model answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..bridge import derive, pool_of, smiles_of, view
from ..functions import answers as A
from ..functions.text import mask_groups
from ..operators import graph as G
from ..operators import molecule as M
from ..operators import responses as R
from .graph import KEKULE
from .molecule import CONTAINS, FORMULA, LABELS
from .sqlgraph import graph_sql

NL = "chr(10)"
_TAIL = ["CCO", "CC(=O)O", "Cc1ccccc1", "C1CCCCC1", "CCN", "C1CN1", "CC#N", "Cc1cnccn1", "CBr", "Cx", "C(C"]


def _escaped(text: str) -> str:
    """SQL text: ``text`` as the inside of a JSON string."""
    out = f"replace(coalesce({text}, ''), chr(92), concat(chr(92), chr(92)))"
    for code, mark in ((34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        out = f"replace({out}, chr({code}), concat(chr(92), {mark}))"
    return out


def _json(key: str, note: str = "'first'") -> str:
    a, b, c = smiles_of(key, key), smiles_of(key, f"({key} + 7)"), pool_of(key, _TAIL)
    full = (f"concat('{{\"data\": [[\"', {a}, '\", \"', {c}, '\"], [\"', {b}, '\"], \"', {pool_of(f'({key} + 3)', _TAIL)}, '\"], "
            f"\"explanation\": [\"', {note}, '\", \"second\", \"third\"], \"confidence_scores\": [0.', cast({key} % 10 AS string), "
            f"', 0.5, 0.25]}}')")
    return f"CASE WHEN {key} % 17 = 0 THEN replace({full}, '\"explanation\"', '\"notes\"') ELSE {full} END"


def _answer(key: str, text: str) -> str:
    """An answer text around the row's own words; some rows lose a tag."""
    return (f"concat(CASE WHEN {key} % 11 = 0 THEN '' ELSE concat('<cot>', {NL}) END, CASE WHEN {key} % 13 = 0 THEN '' ELSE '<thinking type=\"a\">' END, "
            f"{text}, CASE WHEN {key} % 7 = 0 THEN '' ELSE '</thinking>' END, '<thinking>', cast({key} AS string), '</thinking>', "
            f"CASE WHEN {key} % 5 = 0 THEN '' ELSE '</cot>' END, '<think>', {NL}, 'idea', '</think>', "
            f"CASE WHEN {key} % 19 = 0 THEN '' ELSE concat('<json>', {NL}) END, {_json(key)}, '</json>')")


MODEL = pool_of("{0}", ["gpt-4o", "azure_ai/DeepSeek-R1", "other-model", "gpt-4o:adv"])
RESP = (f"SELECT doc_id AS id, {smiles_of('doc_id', '(doc_id + 1)')} AS target, {MODEL.format('doc_id')} AS model, "
        f"{_answer('doc_id', 'text')} AS text FROM documents")
ATTEMPTS = (f"SELECT {smiles_of('conv_id', '(conv_id + 1)')} AS target, {MODEL.format('conv_id')} AS model, "
            f"cast(floor(turn / 2) AS int) AS attempt, CASE WHEN (conv_id + turn) % 6 = 0 THEN 400 ELSE 200 END AS status_code, "
            f"{_answer('(conv_id + turn)', 'text')} AS text FROM conversations WHERE role = 'assistant'")
CANDS = f"SELECT doc_id AS id, {smiles_of('doc_id', '(doc_id + 1)')} AS target, {_json('doc_id', _escaped('text'))} AS json FROM documents"
META = (f"SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'no json here' WHEN 1 THEN concat('{{\"data\": [\"', {pool_of('doc_id', _TAIL)}, '\"]}}') "
        f"ELSE concat('{{\"data\": [\"', {pool_of('doc_id', _TAIL)}, '\", \"', {smiles_of('doc_id', 'doc_id')}, '\"], \"explanation\": \"', {_escaped('text')}, '\", "
        f"\"temperature\": \"', cast(doc_id AS string), '\", \"pressure\": \"1 atm\", \"solvent\": \"', lang, '\"', CASE doc_id % 3 WHEN 0 THEN '' ELSE ', \"time\": \"2 h\"' END, "
        f"CASE doc_id % 2 WHEN 0 THEN concat(', \"literature_reaction\": \"', source, '\"') ELSE '' END, '}}') END AS text FROM documents")
TEMPLATES = [
    (False, "tagged", "sys tagged", "make {target_smiles}", 4096), (False, "json", "sys json", "json for {target_smiles}", 8192),
    (False, "think", "sys think", "think on {target_smiles}", 16384), (True, "tagged", "sys adv", "adv {target_smiles}", 4096),
]
SEVEN, GROUPS = "\nseven", "\noriginal {original} masked {masked}"


def _split(fn):
    return lambda s, d: derive(s, d, RESP).select("id", fn(F.col("text")).alias("a")).select("id", "a.*")


def _candidates(s, d):
    parsed = R.parse_candidates(derive(s, d, CANDS))
    return R.candidate_rows(parsed, ["id", "target"])


def _answers(s, d):
    return R.split_answers(derive(s, d, RESP), dims.model_families(s))


def _prompts(s, d):
    t = s.createDataFrame(TEMPLATES, "advanced boolean, family string, system string, user string, max_tokens int")
    return R.choose_prompt(derive(s, d, RESP).select("id", "target", "model"), dims.model_families(s), t)


def _messages(s, d):
    mols = derive(s, d, RESP).select(F.col("id").alias("mol_id"), F.col("target").alias("smiles"))
    st = G.structures(mols)
    facts = M.has_ring_of_size(st, 7).join(st.select("mol_id", "valid"), "mol_id")
    rows = _prompts(s, d).join(facts, F.col("id") == F.col("mol_id")).withColumn(
        "masked", mask_groups(F.col("target"), F.col("valid")))
    out = R.build_messages(rows, SEVEN, GROUPS)
    return out.select("id", F.col("messages")[0]["content"].alias("system_text"), F.col("messages")[1]["content"].alias("user_text"))


def _reaction_prompts(s, d):
    t = F.lit("make {product} from {reactants} with {reagents} at {conditions}")
    return _candidates(s, d).select("id", "rank", R.reaction_prompt(
        t, F.col("target"), F.col("reactants"), F.array("explanation"), F.col("explanation")).alias("prompt"))


QUERIES = {
    "f1_split_cot": _split(A.split_cot),
    "f2_split_json_only": _split(A.split_json_only),
    "f3_split_think": _split(A.split_think),
    "f4_split_by_model": lambda s, d: _answers(s, d).select("id", "status", "thinking", "json"),
    "f5_parse_candidates": lambda s, d: _candidates(s, d).drop("target"),
    "f6_validity_filter": lambda s, d: R.validity_filter(_candidates(s, d), ("id", "rank")).select("id", "rank"),
    "f7_first_good_attempt": lambda s, d: R.first_good_attempt(derive(s, d, ATTEMPTS), dims.model_families(s)).select(
        "target", "attempt", "rank", "explanation", "confidence"),
    "f7_checked_attempt": lambda s, d: R.first_good_attempt(
        derive(s, d, ATTEMPTS), dims.model_families(s), True, True).select("target", "attempt", "rank"),
    "f8_explain_status": lambda s, d: R.explain_status(
        R.parse_candidates(_answers(s, d)).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("int")).when(
            F.col("status") == 200, F.col("parse_status")).otherwise(F.col("status")).alias("status")), dims.status_codes(s)),
    "f9_choose_prompt": lambda s, d: _prompts(s, d).select("id", "advanced", "family", "system", "max_tokens"),
    "f10_build_messages": _messages,
    "f11_parse_reagents": lambda s, d: R.parse_reagents(derive(s, d, META)).select(
        "id", "status", F.transform("reagents", lambda r: r["smiles"]).alias("smiles"),
        F.transform("reagents", lambda r: r["chemical_formula"]).alias("formulas")),
    "f12_parse_conditions": lambda s, d: derive(s, d, META).select("id", R.parse_conditions(F.col("text")).alias("c")).select("id", "c.*"),
    "f13_parse_literature": lambda s, d: derive(s, d, META).select("id", R.parse_literature(F.col("text")).alias("c")).select("id", "c.*"),
    "f14_reaction_prompts": _reaction_prompts,
    "f15_response_flags": lambda s, d: derive(s, d, RESP).select("id", A.response_flags(F.col("text")).alias("f")).select("id", "f.*"),
}


def _cut(text: str, start: str, end: str) -> str:
    stop = f"(CASE WHEN {end} < 0 THEN length({text}) + {end} ELSE {end} END)"
    return f"substring({text}, {start} + 1, greatest({stop} - ({start}), 0))"


def _tag(tag: str, offset: int) -> str:
    return _cut("text", f"(position(concat('<{tag}>', chr(10)) IN text) - 1 + {offset})", f"(position('</{tag}>' IN text) - 1)")


_STEP = _cut("x", "0", "(position('</thinking>' IN x) - 1)")
SPLITS = f"""resp AS ({RESP}), cut AS (SELECT *, {_tag('cot', 6)} AS cot, {_tag('json', 7)} AS body, {_tag('think', 6)} AS idea FROM resp),
s1 AS (SELECT id, cot <> '' AND contains(cot, '<thinking') AND body <> '' AS ok,
  list_transform(string_split(cot, '<thinking')[2:], lambda x: {_STEP}) AS th, body FROM cut),
f1 AS (SELECT id, CASE WHEN ok THEN 200 ELSE 501 END AS status, CASE WHEN ok THEN th ELSE [] END AS thinking, CASE WHEN ok THEN body ELSE '' END AS json FROM s1),
f2 AS (SELECT id, CASE WHEN body <> '' THEN 200 ELSE 502 END AS status, CAST([] AS VARCHAR[]) AS thinking, body AS json FROM cut),
f3 AS (SELECT id, CASE WHEN body <> '' AND idea <> '' THEN 200 ELSE 503 END AS status, CASE WHEN body <> '' AND idea <> '' THEN [idea] ELSE [] END AS thinking,
  CASE WHEN body <> '' AND idea <> '' THEN body ELSE '' END AS json FROM cut),
f4 AS (SELECT f1.* FROM f1 JOIN resp USING (id) WHERE model IN ('other-model', 'gpt-4o:adv') UNION ALL SELECT f2.* FROM f2 JOIN resp USING (id) WHERE model = 'gpt-4o'
  UNION ALL SELECT f3.* FROM f3 JOIN resp USING (id) WHERE model = 'azure_ai/DeepSeek-R1')"""


def _cands(src: str, keep: str) -> str:
    return (f"SELECT {keep}, CAST(i - 1 AS INT) AS rank, CASE WHEN json_type(x) = 'ARRAY' THEN CAST(x AS VARCHAR[]) ELSE [x ->> '$'] END AS reactants, "
            f"json_extract_string(json, '$.explanation[' || (i - 1) || ']') AS explanation, CAST(json_extract(json, '$.confidence_scores[' || (i - 1) || ']') AS DOUBLE) AS confidence "
            f"FROM (SELECT {keep}, json, unnest(json_extract(json, '$.data[*]')) AS x, generate_subscripts(json_extract(json, '$.data[*]'), 1) AS i FROM {src} "
            f"WHERE json_valid(json) AND json_exists(json, '$.explanation') AND json_exists(json, '$.confidence_scores'))")


def _judge(key: str) -> str:
    """CTEs that judge `cand(target, {key}, rank, reactants)`."""
    return f"""{KEKULE},{LABELS},
part AS (SELECT DISTINCT target, {key}, rank, unnest(reactants) AS smiles FROM cand),
ids AS (SELECT p.*, a.mol_id AS pm, b.mol_id AS tm FROM part p JOIN texts a ON a.smiles = p.smiles JOIN texts b ON b.smiles = p.target),
within AS (SELECT pm * 1000000 + tm AS pair_id, pm AS target, tm AS query FROM (SELECT DISTINCT pm, tm FROM ids)), {CONTAINS},
bits AS (SELECT mol_id, list_sort(list_distinct(list(CAST(('0x' || l[1:8])::BIGINT % 1024 AS INT)))) AS bits
  FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY 1),
badp AS (SELECT DISTINCT i.target, i.{key}, i.rank FROM ids i JOIN g_valid v ON v.mol_id = pm LEFT JOIN bits x ON x.mol_id = pm LEFT JOIN bits y ON y.mol_id = tm
  WHERE NOT v.valid OR coalesce(x.bits = y.bits, false) OR pm * 1000000 + tm IN (SELECT pair_id FROM m_map JOIN m_last ON mol_id = query WHERE k = last)),
good AS (SELECT c.* FROM cand c ANTI JOIN badp b ON b.target = c.target AND b.{key} = c.{key} AND b.rank = c.rank)"""


_TEXTS = "texts AS (SELECT row_number() OVER (ORDER BY smiles) AS mol_id, smiles FROM (SELECT unnest(reactants) AS smiles FROM cand UNION SELECT target FROM cand))"
_MASKSQL = "regexp_replace(replace(replace(replace(target, 'COCc1ccccc1', '%'), 'COC', '&'), 'OC', '$'), '([.$%&])[.$%&]*', '\\1', 'g')"
_TPL = "tpl(advanced, family, system, usr, max_tokens) AS (VALUES " + ", ".join(
    f"({a}, '{f}', '{s}', '{u}', {m})" for a, f, s, u, m in TEMPLATES) + ")"
_PROMPT = f"""resp AS ({RESP}), {_TPL}, pr AS (SELECT r.id, r.target, t.* FROM (SELECT *, model LIKE '%:adv' AS adv, CASE model WHEN 'gpt-4o' THEN 'json'
  WHEN 'azure_ai/DeepSeek-R1' THEN 'think' ELSE 'tagged' END AS fam FROM resp) r LEFT JOIN tpl t ON t.advanced = r.adv AND t.family = r.fam)"""

ORACLES = {
    "f1_split_cot": f"WITH {SPLITS} SELECT * FROM f1",
    "f2_split_json_only": f"WITH {SPLITS} SELECT * FROM f2",
    "f3_split_think": f"WITH {SPLITS} SELECT * FROM f3",
    "f4_split_by_model": f"WITH {SPLITS} SELECT * FROM f4",
    "f5_parse_candidates": f"WITH src AS ({CANDS}) {_cands('src', 'id')}",
    "f6_validity_filter": graph_sql("SELECT id, rank FROM good", rings=True, extra=_judge("id"), source="texts",
                                    pre=f"src AS ({CANDS}), cand AS ({_cands('src', 'id, target')}), {_TEXTS}"),
    "f7_first_good_attempt": graph_sql(
        "SELECT target, attempt, rank, explanation, confidence FROM good SEMI JOIN (SELECT target, min(attempt) AS attempt FROM good GROUP BY 1) USING (target, attempt)",
        rings=True, extra=_judge("attempt"), source="texts",
        pre=SPLITS.replace(RESP, f"SELECT row_number() OVER () AS id, * FROM ({ATTEMPTS})") +
        f", src AS (SELECT target, attempt, json FROM f4 JOIN resp USING (id) WHERE status = 200 AND status_code = 200), cand AS ({_cands('src', 'target, attempt')}), {_TEXTS}"),
    "f8_explain_status":
        f"WITH {SPLITS}, st AS (SELECT id, CAST(CASE WHEN id % 10 = 0 THEN id WHEN status <> 200 THEN status WHEN json_valid(json) AND json_exists(json, '$.explanation') "
        "THEN 200 ELSE 504 END AS INT) AS status FROM f4) SELECT id, status, CASE status " + " ".join(
            f"WHEN {c} THEN '{t}'" for c, t in dims.STATUS_CODES) + " ELSE 'not recognized' END AS description FROM st",
    "f9_choose_prompt": f"WITH {_PROMPT} SELECT id, advanced, family, system, max_tokens FROM pr",
    "f10_build_messages": graph_sql(
        "SELECT id, system || add_on AS system_text, replace(usr || CASE family WHEN 'think' THEN add_on ELSE '' END, '{target_smiles}', target) || chr(10) || chr(10) || add_on AS user_text "
        "FROM (SELECT *, CASE WHEN id IN (SELECT mol_id FROM g_ring WHERE size = 7) THEN chr(10) || 'seven' ELSE '' END || CASE WHEN valid AND masked <> target "
        "THEN chr(10) || 'original ' || target || ' masked ' || masked ELSE '' END AS add_on FROM (SELECT pr.*, valid, " + _MASKSQL + " AS masked FROM pr JOIN g_valid ON mol_id = id))",
        rings=True, source="mols", pre=f"{_PROMPT}, mols AS (SELECT id AS mol_id, target AS smiles FROM resp)"),
    "f11_parse_reagents": graph_sql(
        "SELECT m.id, CASE WHEN s IS NULL THEN 404 ELSE 200 END AS status, s AS smiles, f AS formulas FROM meta m LEFT JOIN (SELECT id, list(smiles ORDER BY i) AS s, "
        "list(chemical_formula ORDER BY i) AS f FROM lst JOIN texts USING (smiles) JOIN f_all USING (mol_id) WHERE valid GROUP BY 1) q ON q.id = m.id",
        extra=FORMULA, source="texts", pre=f"meta AS ({META}), lst AS (SELECT id, x ->> '$' AS smiles, i FROM (SELECT id, unnest(json_extract(text, '$.data[*]')) AS x, "
        "generate_subscripts(json_extract(text, '$.data[*]'), 1) AS i FROM (SELECT * FROM meta WHERE json_valid(text)) WHERE json_exists(text, '$.explanation'))), "
        "texts AS (SELECT row_number() OVER () AS mol_id, smiles FROM (SELECT DISTINCT smiles FROM lst))"),
    "f12_parse_conditions":
        f"WITH meta AS ({META}), p AS (SELECT id, CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS j FROM meta), q AS (SELECT id, j ->> 'temperature' AS temperature, "
        "j ->> 'pressure' AS pressure, j ->> 'solvent' AS solvent, j ->> 'time' AS time FROM p), r AS (SELECT *, temperature IS NOT NULL AND pressure IS NOT NULL AND solvent IS NOT NULL "
        "AND time IS NOT NULL AS ok FROM q) SELECT id, CASE WHEN ok THEN 200 ELSE 404 END AS status, CASE WHEN ok THEN temperature END AS temperature, CASE WHEN ok THEN pressure END AS pressure, "
        "CASE WHEN ok THEN solvent END AS solvent, CASE WHEN ok THEN time END AS time FROM r",
    "f13_parse_literature":
        f"WITH meta AS ({META}), p AS (SELECT id, CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS j FROM meta) SELECT id, CASE WHEN j ->> 'literature_reaction' IS NULL THEN 404 ELSE 200 END "
        "AS status, j ->> 'literature_reaction' AS reaction FROM p",
    "f14_reaction_prompts":
        f"WITH src AS ({CANDS}), cand AS ({_cands('src', 'id, target')}) SELECT id, rank, 'make ' || target || ' from ' || array_to_string(reactants, ', ') || ' with ' || explanation || ' at ' || explanation AS prompt FROM cand",
    "f15_response_flags":
        f"WITH resp AS ({RESP}), l AS (SELECT id, text, lower(text) AS w, trim(" + _cut("text", "(position('<json>' IN text) - 1 + 6)", "(position('</json>' IN text) - 1)") +
        ") AS b FROM resp) SELECT id, contains(w, 'deprotection') AS deprotection, contains(w, 'protecting group') AS protecting_group, contains(w, 'hydrolysis') OR contains(w, 'hydrogenolysis') AS conditions, "
        "contains(w, 'ethox') OR contains(w, 'oet') AS ethoxy, contains(text, '<json>') AND contains(text, '</json>') AS has_json, "
        "contains(text, '<json>') AND contains(text, '</json>') AND regexp_matches(b, '[&%$]') AS masked_left FROM l",
}
