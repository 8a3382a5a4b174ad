from pyspark.sql import functions as F

from routegrid import dims
from routegrid.functions import answers as A
from routegrid.operators import responses as R

GOOD = "<cot>\n<thinking type=\"a\">one</thinking>\n<thinking>two</thinking>\n</cot>\n<json>\n{'data': [['CCO', 'CC(=O)O'], 'CCN'], 'explanation': ['x', 'y'], 'confidence_scores': [0.9, 0.4]}\n</json>"


def py_cot(t):
    body = t[t.find("<cot>\n") + 6:t.find("</cot>")]
    steps = [s[:s.find("</thinking>")] for s in body.split("<thinking")[1:]]
    js = t[t.find("<json>\n") + 7:t.find("</json>")]
    return (200, steps, js) if body and steps and js else (501, [], "")


def test_split_cot(spark):
    texts = [GOOD, "", GOOD.replace("</cot>", ""), GOOD.replace("<cot>\n", ""), GOOD.replace("</thinking>", ""), GOOD.replace("<json>\n", ""),
             GOOD.replace("</json>", ""), "<cot>\n</cot><json>\n{}</json>", "plain words", "é" + GOOD]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", A.split_cot(F.col("t")).alias("a")).collect():
        assert (r["a"]["status"], list(r["a"]["thinking"]), r["a"]["json"]) == py_cot(texts[r["id"]]), r["id"]


def test_families(spark):
    rows = [("other", ""), ("gpt-4o", ""), ("azure_ai/DeepSeek-R1", ""), ("gpt-4o:adv", ""), ("other", None), ("other", GOOD), ("gpt-4o", GOOD)]
    df = spark.createDataFrame(rows, "model string, text string").withColumn("id", F.monotonically_increasing_id())
    got = sorted((r["model"], r["text"] or "", r["status"]) for r in R.split_answers(df, dims.model_families(spark)).collect())
    assert got == sorted([("other", "", 501), ("gpt-4o", "", 502), ("azure_ai/DeepSeek-R1", "", 503), ("gpt-4o:adv", "", 501), ("other", "", 505),
                          ("other", GOOD, 200), ("gpt-4o", GOOD, 200)])


def test_candidates_with_single_quotes(spark):
    js = py_cot(GOOD)[2]
    df = spark.createDataFrame([(0, js), (1, ""), (2, "{'data': []}"), (3, "{\"data\": [[\"[Na+]\"], \"[K+]\"], \"explanation\": [\"a\", \"b\"], \"confidence_scores\": [1, 0]}")], "id int, json string")
    parsed = R.parse_candidates(df)
    assert {r["id"]: r["parse_status"] for r in parsed.collect()} == {0: 200, 1: 504, 2: 504, 3: 200}
    rows = {(r["id"], r["rank"]): (r["reactants"], r["confidence"]) for r in R.candidate_rows(parsed, ["id"]).collect()}
    assert rows == {(0, 0): (["CCO", "CC(=O)O"], 0.9), (0, 1): (["CCN"], 0.4), (3, 0): (["[Na+]"], 1.0), (3, 1): (["[K+]"], 0.0)}


def test_first_good_attempt(spark):
    def text(*paths):
        data = ", ".join("[" + ", ".join(f"'{m}'" for m in p) + "]" for p in paths)
        n = ", ".join("'e'" for _ in paths)
        return f"<cot>\n<thinking>t</thinking></cot><json>\n{{'data': [{data}], 'explanation': [{n}], 'confidence_scores': [{', '.join('0.5' for _ in paths)}]}}</json>"

    rows = [
        ("CCOC(C)=O", "m", 0, 200, text(["CCOC(=O)C"])),           # the target itself
        ("CCOC(C)=O", "m", 1, 200, text(["C(C"], ["CCO", "CC(=O)O"])),
        ("CCOC(C)=O", "m", 2, 200, text(["CCBr"])),
        ("CCN", "m", 0, 400, text(["CC"])), ("CCN", "m", 1, 200, "no tags"), ("CCN", "m", 6, 200, text(["CC"])),
        ("CCCl", "m", 3, 200, text(["CCCCl"], ["CCO"])),            # the first contains the target
        ("CCF", "m", 0, 200, text(["[CH2+]C"])), ("CCF", "m", 1, 200, text(["CC"])),
    ]
    df = spark.createDataFrame(rows, "target string, model string, attempt int, status_code int, text string")
    got = {(r["target"], r["attempt"], r["rank"]) for r in R.first_good_attempt(df, dims.model_families(spark), attempts=6).collect()}
    assert got == {("CCOC(C)=O", 1, 1), ("CCCl", 3, 1), ("CCF", 0, 0)}
    every = {(r["target"], r["attempt"], r["rank"]) for r in R.first_good_attempt(df, dims.model_families(spark)).collect()}
    assert every == got | {("CCN", 6, 0)}
    checked = {(r["target"], r["attempt"]) for r in R.first_good_attempt(df, dims.model_families(spark), True, True).collect()}
    assert ("CCF", 1) in checked and ("CCN", 6) in checked and ("CCOC(C)=O", 1) in checked


def test_metadata_answers(spark):
    t = ["{'temperature': '25', 'pressure': '1', 'solvent': 'w', 'time': '2h'}", "{'temperature': '25'}", "x"]
    df = spark.createDataFrame(list(enumerate(t)), "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(R.parse_conditions(F.col("text"))["status"]).collect()] == [200, 404, 404]
    lit = spark.createDataFrame([(0, '{"literature_reaction": "r"}'), (1, "{}")], "id int, text string")
    assert [r[0] for r in lit.orderBy("id").select(R.parse_literature(F.col("text"))["status"]).collect()] == [200, 404]
    reag = spark.createDataFrame([(0, "{'data': ['O', 'bad!'], 'explanation': 'e'}"), (1, "{'data': ['bad!'], 'explanation': 'e'}"), (2, "{'data': ['O']}")], "id int, text string")
    rows = {r["id"]: r for r in R.parse_reagents(reag).collect()}
    assert [rows[i]["status"] for i in range(3)] == [200, 404, 404]
    assert rows[0]["reagents"][0]["chemical_formula"] == "H2O"


def test_validity_filter_tells_answers_apart(spark):
    rows = [(1, "CCO", 0, ["CCCC"]), (2, "CCO", 0, ["Cx"]), (3, "CCN", 0, ["CCC"])]
    df = spark.createDataFrame(rows, "id int, target string, rank int, reactants array<string>")
    assert {r["id"] for r in R.validity_filter(df, ("id", "rank")).collect()} == {1, 3}
    assert {r["id"] for r in R.validity_filter(df, ("target", "rank")).collect()} == {3}


def test_validity_filter_parses_once(spark, monkeypatch):
    """Candidates are read for their parts and for the result, never again."""
    written = []
    real = R.stage
    monkeypatch.setattr(R, "stage", lambda df: (written.append(df.schema.simpleString()), real(df))[1])
    rows = [("CCO", 0, ["CC", "O"]), ("CCO", 1, ["OCC"]), ("CC", 2, ["CCC"]), ("CCO", 3, ["Cx"]), ("CCO", 4, []), ("Cx", 5, ["CC"])]
    df = spark.createDataFrame(rows, "target string, rank int, reactants array<string>")
    assert {r["rank"] for r in R.validity_filter(df, ("target", "rank")).collect()} == {0, 4, 5}
    assert written[0] == "struct<target:string,rank:int,place:int,smiles:string>"
    assert written[-1] == "struct<mol_id:string,bits:string>"
