"""Containment index, automaton eviction, pointer doubling and closures against brute force."""
import itertools

from pyspark.sql import functions as F

from routegrid.bridge import POOL
from routegrid.functions.matching import embeds
from routegrid.operators import edit as H
from routegrid.operators import graph as G
from routegrid.operators import memo as I
from routegrid.operators import molecule as M
from routegrid.plans import frontier


def test_search_finds_what_all_pairs_find(spark, table):
    texts = [*POOL, "C", "CO", "c1ccccc1", "C1CCCCC1C", "N"]
    forms = {r["mol_id"]: r for r in M.match_form(G.structures(table(texts))).collect()}
    want = {(q, t) for q, t in itertools.product(forms, forms)
            if embeds(forms[t]["m_atoms"], forms[t]["m_bonds"], forms[q]["m_atoms"], forms[q]["m_bonds"])}
    got = [tuple(r) for r in M.search(G.structures(table(texts)), G.structures(table(texts))).select("query", "target").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3 * len(forms)
    none = G.structures(table(["C(C"]))
    assert M.search(none, G.structures(table(texts))).count() == 0 and M.search(G.structures(table(texts)), none).count() == 0


def test_rarity_order_does_not_change_matches():
    ring = [f"{i} C0" for i in range(6)] + ["6 N0"]
    bonds = [f"{a} {b} 1" for i in range(6) for a, b in ((i, (i + 1) % 6), ((i + 1) % 6, i))] + ["6 0 1", "0 6 1"]
    assert embeds(ring, bonds, ["0 C0", "1 C0", "2 N0"], ["0 1 1", "1 0 1", "1 2 1", "2 1 1"])
    assert not embeds(ring, bonds, ["0 C0", "1 N0", "2 N0"], ["0 1 1", "1 0 1", "1 2 1", "2 1 1"])
    assert not embeds(ring, bonds, ["0 N0", "1 C0", "2 C0"], ["0 1 2", "1 0 2", "1 2 1", "2 1 1"])


def test_eviction_in_many_shards_and_slices(spark):
    rows = [(f"k{i}", f"{{\"smiles\": \"{'CO' * (i % 7)}N{i}\"}}", "r") for i in range(300)] + [("none", None, "r"), ("empty", "", "r")]
    memo = spark.createDataFrame(rows, "key string, input_args string, result string")
    gone = ["N7", "COCOCON1", "N29", "\"}", "", None, "é"]
    for words in (gone[:3], gone):
        table = spark.createDataFrame([(w,) for w in words], "smiles string")
        want = {k for k, t, _ in rows if not any(w and w in (t or "") for w in words)}
        for sizes in ({}, {"automaton_chars": 4, "task_chars": 900}):
            assert {r["key"] for r in I.evict_all(memo, table, **sizes).collect()} == want
    assert I.evict_all(memo, table.where("false")).count() == len(rows)


def test_a_long_chain_takes_log_rounds(spark, monkeypatch):
    n = 10_000
    chain = spark.range(1, n + 1).selectExpr("1L route_id", "cast(id as int) step", "cast(if(id = 1, null, id - 1) as int) parent")
    loop = spark.createDataFrame([(2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 1, 9), (4, 1, 0)], "route_id bigint, step int, parent int")
    rounds = []
    real = H.stage
    monkeypatch.setattr(H, "stage", lambda df: (rounds.append(1), real(df))[1])
    tree = H.route_tree(chain.unionByName(loop), paths=False).collect()
    assert len(rounds) <= 17
    assert {(r["step"], r["depth"], r["root"]) for r in tree if r["route_id"] == 1} == {(i, i - 1, 1) for i in range(1, n + 1)}
    assert sorted((r["route_id"], r["step"], r["depth"], r["root"]) for r in tree if r["route_id"] > 1) == [(4, 0, 0, 0), (4, 1, 1, 0)]


def test_closure_whole_and_by_rounds(spark):
    links = [(r, a, b) for r in (1, 2) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (9, 1)] + [(i, i + 1) for i in range(20, 60)]]
    edges = spark.createDataFrame(links, "route_id bigint, node int, next int")
    start = spark.createDataFrame([(1, 2), (1, 20), (2, 6), (3, 1)], "route_id bigint, node int")
    want = {(1, x) for x in [1, 2, 3, 4, 5, 6, 7, *range(20, 61)]} | {(2, 6), (2, 7), (3, 1)}
    for growth in (0, 1, 100):
        got = [tuple(r) for r in frontier.closure(start, edges, ["route_id"], growth=growth).collect()]
        assert len(got) == len(set(got)) and set(got) == want, growth


def test_a_key_stored_twice_answers_each_row_once(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, x string")
    args = "{\"x\":\"a\"}"
    memo = spark.createDataFrame([(args, "A")] * 2 + [("{\"x\":\"z\"}", "Z")], "input_args string, result string").withColumn(
        "key", I.memo_key("f", F.col("input_args")))
    out, added = I.compute_missing(inputs, memo, "f", ["x"], lambda m: m.withColumn("result", F.upper("x")))
    assert sorted((r["id"], r["result"]) for r in out.collect()) == [(1, "A"), (2, "A"), (3, "B")]
    assert [r["result"] for r in added.collect()] == ["B"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_target_goes_through_the_driver(spark, table, tmp_path):
    table([*POOL, "C", "CO"]).write.parquet(str(tmp_path / "m"))
    molecules = spark.read.parquet(str(tmp_path / "m"))
    pairs = molecules.select(F.col("mol_id").alias("pair_id"), F.col("mol_id").alias("target"), F.floor(F.col("mol_id") / 10).alias("query"))
    found = M.contains(pairs, M.match_form(G.structures(molecules)))
    assert "BroadcastExchange" not in _plan(found)
    s = G.structures(molecules)
    few, many = M.search(s, s), M.search(s, s, few=0)
    assert "BroadcastHashJoin [target" not in _plan(few) and "BroadcastHashJoin [target" not in _plan(many)
    assert "BroadcastHashJoin [query" not in _plan(many)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} != set()
