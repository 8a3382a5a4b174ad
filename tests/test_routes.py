import hashlib
import json

import pytest
from pyspark.sql import functions as F

from routegrid import dims
from routegrid.operators import batch as L
from routegrid.operators import classify as K
from routegrid.operators import edit as H
from routegrid.operators import evaluate as J
from routegrid.operators import memo as I
from routegrid.operators import routes as R
from routegrid.plans.ranking import numbered
from routegrid.sources import readers, writers


def _cands(spark, rows):
    return spark.createDataFrame([(t, k, i, m, 0.5) for t, k, ms in rows for i, m in enumerate(ms)],
                                 "target string, rank int, ord int, smiles string, confidence double")


def _expand(spark, strict=False):
    cands = _cands(spark, [("T", 0, ["A", "X", "S1"]), ("T", 1, ["A", "B"]), ("A", 0, ["S1", "T"]), ("A", 1, ["S2"]), ("B", 0, ["S1"])])
    stock = spark.createDataFrame([("S1",), ("S2",)], "smiles string")
    targets = spark.createDataFrame([(1, "T"), (2, "S1"), (3, "X")], "route_id int, smiles string")
    return R.expand_routes(targets, cands, stock, 10, strict)


def test_expand_compatible(spark):
    got = {(r["route_id"], tuple(r["path"]), r["smiles"], r["status"]) for r in _expand(spark).collect()}
    assert got == {(1, (), "T", "expanded"), (1, (0,), "A", "expanded"), (1, (1,), "X", "dead_end"), (1, (2,), "S1", "stock"),
                   (1, (0, 0), "S1", "stock"), (1, (0, 1), "T", "cycle"), (2, (), "S1", "stock"), (3, (), "X", "dead_end")}


def test_expand_strict(spark):
    got = {(tuple(r["path"]), r["smiles"], r["status"]) for r in _expand(spark, True).where("route_id = 1").collect()}
    assert got == {((), "T", "expanded"), ((0,), "A", "expanded"), ((1,), "B", "expanded"), ((0, 0), "S2", "stock"), ((1, 0), "S1", "stock")}


def test_strict_choice_carries_only_what_is_missing(spark, monkeypatch):
    import random
    rng, rows = random.Random(5), []
    for t in range(60):
        rows += [(f"M{t}", k, [rng.choice(["S1", "S2", "N"] + [f"M{i}" for i in range(60)]) for _ in range(rng.randint(1, 4))]) for k in range(3)]
    rows += [("S1", 0, ["S2"]), ("M0", None, ["S1"]), (None, 0, ["S1"]), ("M1", 7, [None]), ("M2", 9, ["S2", "S2"])]
    solved, want = {"S1", "S2"}, {}
    while True:  # round by round, by hand
        done = {}
        for t, k, ms in rows:
            if t is not None and k is not None and t not in solved and all(m in solved for m in ms):
                done[t] = min(k, done.get(t, k))
        if not done:
            break
        want.update(done)
        solved |= set(done)
    cands, sizes, write = _cands(spark, rows), [], R.stage

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(R, "stage", counted)
    got = R.solvable_pathways(cands, spark.createDataFrame([("S1",), ("S2",)], "smiles string")).collect()
    assert {(r["target"], r["rank"]) for r in got} == set(want.items())
    assert len(got) == sum(len(ms) for t, k, ms in rows if want.get(t, -1) == k)
    # the first table after the stock holds what is not in stock; each further one no more than it
    assert max(sizes) == sum(m not in ("S1", "S2") for t, k, ms in rows if t is not None and k is not None for m in ms)


def test_flatten_and_dependencies(spark):
    basic = spark.createDataFrame([("S1",)], "smiles string")
    steps, mols, deps = R.format_route(_expand(spark), basic)
    assert {(r["step"], r["product"], r["confidence"]) for r in steps.collect()} == {(1, "T", 0.8), (2, "A", 0.8)}
    assert {(r["step"], r["smiles"], r["role"]) for r in mols.collect()} == {(1, "A", "reactant"), (1, "S1", "reagent"), (2, "S1", "reagent")}
    assert {(r["step"], r["dep"]) for r in deps.collect()} == {(1, 2), (2, None)}
    text = {r["step"]: r["reaction"] for r in R.reaction_text(mols, steps).collect()}
    assert text == {1: "A.S1>>T", 2: "S1>>A"}


@pytest.mark.parametrize("made,want", [
    ([("A", []), ("B", ["A"]), ("C", ["B"])], {1: [], 2: [1], 3: [2]}),
    ([("A", []), ("B", []), ("C", ["A", "B"])], {1: [], 2: [], 3: [1, 2]}),
    ([("A", ["X"]), ("B", ["Y"])], {1: [], 2: []}),
])
def test_dependency_goldens(spark, made, want):
    steps = spark.createDataFrame([(1, i + 1, p) for i, (p, _) in enumerate(made)], "route_id int, step int, product string")
    mols = spark.createDataFrame([(1, i + 1, k, m, "reactant") for i, (_, ms) in enumerate(made) for k, m in enumerate(ms)],
                                 "route_id int, step int, ord int, smiles string, role string")
    got = {i + 1: [] for i in range(len(made))}
    for r in R.resolve_dependencies(steps, mols).where("dep IS NOT NULL").orderBy("ord").collect():
        got[r["step"]].append(r["dep"])
    assert got == want


def test_confidence(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.5,), (0.7,), (0.995,)], "p double")
    assert [r[0] for r in df.select(R.confidence_estimate(F.col("p"))).collect()] == [0.8, 0.9, 0.8, 0.7, 0.99]


@pytest.mark.parametrize("n,deps,start,new,new_deps,want_steps,want", [
    (3, [(1, 2), (2, 3)], 2, 2, [(1, 2)], [1, 2, 3], [(1, 2), (2, 3)]),
    (2, [(1, 2)], 1, 2, [(1, 2)], [1, 2], [(1, 2)]),
    (2, [(1, 2)], 2, 1, [], [1, 2], [(1, 2)]),
    (2, [(1, 2)], 2, 0, [], [1], []),
])
def test_splice_goldens(spark, n, deps, start, new, new_deps, want_steps, want):
    # nobody asked to splice route 2
    steps = spark.createDataFrame([(1, i + 1) for i in range(n)] + [(2, 1)], "route_id int, step int")
    edges = spark.createDataFrame([(1, a, b) for a, b in deps], "route_id int, step int, dep int")
    starts = spark.createDataFrame([(1, start)], "route_id int, step int")
    new_steps = spark.createDataFrame([(1, i + 1) for i in range(new)] + [(2, 1), (2, 2)], "route_id int, step int")
    new_edges = spark.createDataFrame([(1, a, b) for a, b in new_deps] + [(2, 1, 2)], "route_id int, step int, dep int")
    merged, all_edges = H.splice(steps, edges, starts, new_steps, new_edges)
    assert sorted(r["step"] for r in merged.collect()) == want_steps
    assert sorted((r["step"], r["dep"]) for r in all_edges.collect()) == want


def test_tree_view(spark):
    steps = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "route_id int, step int")
    edges = spark.createDataFrame([(1, 1, 2)], "route_id int, step int, dep int")
    parents = H.parent_of_step(steps, edges)
    assert {(r["step"], r["parent"]) for r in parents.collect()} == {(1, 0), (2, 1), (3, None)}
    assert {(r["step"], tuple(r["path"])) for r in H.route_tree(parents).collect()} == {(0, (0,)), (1, (0, 1)), (2, (0, 1, 2)), (3, (3,))}


def test_numbered_in_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("o"))
    got = numbered(df, ["g"], ["o"], "n").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r["g"], r["o"])):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["n"] == seen[r["g"]]
    assert len(got) == 5000


def test_memo(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "x string")
    key = "f:" + hashlib.md5(b'{"x":"a"}').hexdigest()
    memo = spark.createDataFrame([(key, '{"x":"a"}', "old")], "key string, input_args string, result string")
    out, added = I.compute_missing(inputs, memo, "f", ["x"], lambda m: m.withColumn("result", F.upper("x")))
    assert sorted((r["x"], r["result"]) for r in out.collect()) == [("a", "old"), ("b", "B"), ("b", "B"), ("c", "C")]
    assert added.count() == 2
    store = spark.createDataFrame([("1", "CCO", "r"), ("2", "CN", "r"), ("3", "NCC", "r"), ("4", "", "r")], "key string, input_args string, result string")
    assert {r["key"] for r in I.evict(store, "CC").collect()} == {"2", "4"}
    gone = spark.createDataFrame([("CC",), ("CNO",)], "smiles string")
    assert {r["key"] for r in I.evict_all(store, gone).collect()} == {"2", "4"}


def test_scores(spark):
    truth = spark.createDataFrame([(1, "CCO"), (1, "CN"), (2, "CC"), (3, "C"), (3, "C")], "id int, smiles string")
    pred = spark.createDataFrame([(1, "OCC"), (1, "CF"), (2, "CC"), (3, "C")], "id int, smiles string")
    got = {r["id"]: (r["any_correct"], r["all_correct"]) for r in J.score_predictions(truth, pred).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (0, 0)}
    t, p = J.with_keys(truth), J.with_keys(pred)
    assert [r["smiles"] for r in J.not_common(t, p).collect()] == ["CF"]
    assert [r["smiles"] for r in J.not_common(p, t).collect()] == ["CN"]


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("smiles, common_name\nCC,\nO,water\n")
    assert [tuple(r) for r in readers.read_molecules(spark, str(tmp_path / "m.csv")).collect()] == [("CC", None), ("O", "water")]
    (tmp_path / "r.csv").write_text(",input,output,reaction_type\n35,CCO,CC.O,2\n")
    assert readers.read_reactions(spark, str(tmp_path / "r.csv")).first().asDict() == {"row_id": 35, "input": "CCO", "output": "CC.O", "reaction_type": 2}
    routes = tmp_path / "routes"
    routes.mkdir()
    for i in (3, 12):
        (routes / f"route_{i}.json").write_text(json.dumps({"steps": [{"step": "1"}], "dependencies": {"1": []}}, indent=1))
    assert sorted(r["route_id"] for r in readers.read_routes(spark, str(routes)).collect()) == [3, 12]
    model = {"internal_name": "i", "display_name": "d", "supports_advanced_prompt": True, "supports_stability_check": True, "supports_hallucination_check": False}
    (tmp_path / "c.json").write_text(json.dumps({"llm_models": {"a": model}, "az_models": {}, "defaults": {"model_type": "a", "stability_flag": True}}, indent=1))
    models, defaults = readers.read_config(spark, str(tmp_path / "c.json"))
    assert models.first()["supports_hallucination_check"] is False
    assert {r["name"]: r["value"] for r in defaults.collect()} == {"model_type": "a", "stability_flag": "true"}
    assert readers.load_result(spark, str(tmp_path / "none")).count() == 0
    save = spark.createDataFrame([("t", 1, "old"), ("t", 2, "new")], "target string, saved_at int, result string")
    writers.save_result(save, str(tmp_path / "saved"))
    assert [tuple(r) for r in readers.load_result(spark, str(tmp_path / "saved")).collect()] == [("t", "new")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{not json\n")
    assert [tuple(r) for r in readers.load_result(spark, str(tmp_path / "bad")).collect()] == [(None, None)]


def test_config_and_requests(spark):
    good = {"llm_models": {}, "az_models": {"v": {}}, "defaults": {"model_type": "m", "model_version": "v"}}
    df = spark.createDataFrame([(1, json.dumps(good))], "config_id int, text string")
    assert {r["violation"] for r in L.check_config(df).collect()} == {
        "missing default advanced_prompt", "missing default stability_flag", "missing default hallucination_check", "unknown default model m"}


def test_model_round_trip(spark, tmp_path):
    # many telling bits: each split looks at a random 64 of 4096 columns
    rows = [(i, "train", float(i % 2), list(range(i % 2, 2000, 2)), [3]) for i in range(40)]
    data = K.features(spark.createDataFrame(rows, "id int, split string, label double, input_bits array<int>, output_bits array<int>"))
    model = K.train(data, trees=5)
    K.save_model(model, str(tmp_path / "m"))
    a = {r["id"]: r["prediction"] for r in K.predict(model, data).collect()}
    b = {r["id"]: r["prediction"] for r in K.predict(K.load_model(str(tmp_path / "m")), data).collect()}
    assert a == b and all(a[i] == i % 2 for i in a)
    named = R.reaction_type(spark.createDataFrame([(1,), (2,)], "pair_id int"), spark.createDataFrame([(1, 2.0)], "pair_id int, prediction double"), dims.reaction_classes(spark))
    assert {r["pair_id"]: r["code"] for r in named.collect()} == {1: 2, 2: -1}


def test_judged_runs_are_written_and_reported_at_once(spark, tmp_path):
    from routegrid.sources import writers

    rows = [(i, "ok" if i % 3 else ("error" if i % 2 else None), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, status string, elapsed double")
    report = {r["status"]: (r["n"], r["share"], r["mean_elapsed"]) for r in writers.write_judged(df, f"{tmp_path}/a").collect()}
    good = [e for _, s, e in rows if s == "ok"]
    bad = [e for _, s, e in rows if s != "ok"]
    assert report == {"ok": (20, round(20 / 30, 6), round(sum(good) / 20, 6)), "error": (10, round(10 / 30, 6), round(sum(bad) / 10, 6))}
    assert sorted(r["elapsed"] for r in spark.read.parquet(f"{tmp_path}/a/status=error").collect()) == bad
    assert writers.write_judged(df.where("false"), f"{tmp_path}/b").count() == 0
    only = writers.write_judged(df.where("status = 'ok'"), f"{tmp_path}/c").collect()
    assert [(r["status"], r["n"], r["share"]) for r in only] == [("ok", 20, 1.0)]
