import itertools

from pyspark.sql import functions as F

from routegrid.operators import compare as D
from routegrid.operators import graph as G
from routegrid.operators import stability as E

PAIRS = [
    ("c1ccccc1CC(N)C(=O)O", "c1ccccc1CC(N)C(=O)O"), ("CC", "CCC"), ("CSO", "CCO"), ("CCO", "CCCl"), ("CCCO", "CC(O)C"),
    ("CC", "C1CC1"), ("C1CCCCC1", "CCCCCC"), ("C1CCCCC1", "C1CCCC1"), ("c1ccccc1", "C1CCCCC1"), ("invalid_smiles", "CCO"),
    ("Cc1ccc(Cl)cc1", "Cc1cccc(Cl)c1"),
]


def _table(spark):
    return D.compare_table(spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(PAIRS)], "pair_id int, reactant string, product string"))


def test_pairs(spark):
    t = D.consistency_scores(_table(spark))
    rows = {r["pair_id"]: r for r in t.select(
        "pair_id", "score", "severity", D.atom_diffs().alias("a"), D.ring_diffs().alias("r"), D.moves().alias("m"),
        (F.col("p_n_bonds") - F.col("r_n_bonds")).alias("b"), (F.col("r_n_arom") - F.col("p_n_arom")).alias("ar")).collect()}
    assert rows[0]["score"] == 100 and not rows[0]["a"] and not rows[0]["r"] and not rows[0]["m"]
    assert [tuple(x) for x in rows[1]["a"]] == [("C", 2, 3)] and rows[1]["b"] == 1 and rows[1]["score"] == 90
    assert ("S", 1, 0) in [tuple(x) for x in rows[2]["a"]]
    assert ("Cl", 0, 1) in [tuple(x) for x in rows[3]["a"]]
    assert not rows[4]["a"] and not rows[4]["r"]
    assert [tuple(x) for x in rows[5]["r"]] == [(3, "added", 1)]
    assert not rows[6]["a"] and [tuple(x) for x in rows[6]["r"]] == [(6, "removed", 1)]
    assert sorted(tuple(x) for x in rows[7]["r"]) == [(5, "added", 1), (6, "removed", 1)]
    assert not rows[8]["a"] and rows[8]["ar"] == 6 and rows[8]["score"] == 60
    assert (rows[9]["score"], rows[9]["severity"]) == (0, "critical")
    assert {(m["substituent"], tuple(m["from_positions"]), tuple(m["to_positions"])) for m in rows[10]["m"]} == {
        ("Methyl", ("para",), ("meta",)), ("Chloro", ("para",), ("meta",))}
    assert rows[10]["score"] == 0
    change = {r["pair_id"]: r["change"] for r in D.position_pairs(t).collect()}
    assert change == {10: "Meta <-> Para position change detected"}


def test_bands(spark):
    df = spark.createDataFrame([(95,), (85,), (75,), (55,), (35,), (15,), (5,)], "s int")
    got = [r[0].split()[0] for r in df.select(D.score_message(F.col("s"))).collect()]
    assert got == ["Highly", "Generally", "Mostly", "Questionable", "Likely", "Severe", "Complete"]


def test_names(spark):
    df = spark.createDataFrame([("C1",), ("N1.O2",), ("Cl1",), ("",)], "s string")
    assert [r[0] for r in df.select(D.friendly_name(F.col("s"))).collect()] == ["Methyl", "Nitro", "Chloro", "Group ()"]


def test_pathway_features_add_up(spark):
    """Adding molecule features gives what the dot-joined text gives, broken texts included."""
    paths = [("CCO", 0, ["CC", "O"]), ("Cc1ccccc1", 0, ["c1ccccc1", "C"]), ("Cc1ccc(Cl)cc1", 1, ["c1ccccc1C", "Cc1cccc(Cl)c1", "CCl"]),
             ("C1CC1", 0, ["C1C", "CC1"]), ("C1CC1", 1, ["C1C", "CO"])]
    df = spark.createDataFrame(paths, "target string, rank int, reactants array<string>")
    cols = ["score", "severity"]
    one = {(r["target"], r["rank"]): r for r in D.consistency_scores(D.pathway_table(df)).select("target", "rank", *cols).collect()}
    joined = df.select("target", "rank", F.array_join("reactants", ".").alias("reactant"), F.col("target").alias("product"))
    two = {(r["target"], r["rank"]): r for r in D.consistency_scores(D.compare_table(joined)).select("target", "rank", *cols).collect()}
    assert one == two and len(one) == len(paths)
    kept = {(r["target"], r["rank"]) for r in D.consistency_filter(df, ("target", "rank")).collect()}
    assert kept == {k for k, r in one.items() if r["severity"] in ("low", "medium")}


def test_substituent_members(table):
    subs = D.substituents(G.structures(table(["CC(C)c1ccc(N)cc1"]))).collect()
    assert {(tuple(s["members"]), s["position"], s["signature"]) for s in subs} == {
        ((0, 1, 2), "para", "C3"), ((7,), "para", "N1")}


def test_filters_write_what_they_read_again(spark, monkeypatch):
    """Lines carry no feature that the score leaves alone; scores stand written before a filter may move into them."""
    written = []

    def recorded(module):
        real = module.stage
        monkeypatch.setattr(module, "stage", lambda df: (written.append(df.schema.simpleString()), real(df))[1])

    recorded(D)
    recorded(E)
    df = spark.createDataFrame([("CCO", 0, ["CC", "O"]), ("C1CC1", 0, ["C1C", "CC1"]), ("CCO", 1, ["c1ccccc1", "O"])],
                               "target string, rank int, reactants array<string>")
    kept = {(r["target"], r["rank"]) for r in D.consistency_filter(df, ("target", "rank")).collect()}
    scores = {(r["target"], r["rank"]): r["severity"] for r in D.consistency_scores(D.pathway_table(df)).collect()}
    assert kept == {k for k, band in scores.items() if band in ("low", "medium")} and 0 < len(kept) < len(scores)
    steps = written[:written.index("struct<target:string,rank:int,severity:string>") + 1]
    assert steps[0] == df.schema.simpleString() and not any("envs" in s for s in steps) and not any("places" in s for s in steps[3:])
    written.clear()
    assert E.stability_filter(df, ("target", "rank")).count() == 2
    assert written[0] == df.schema.simpleString()


def test_texts_that_cannot_be_read_when_joined(spark, table):
    """No joined text that is read is ruled out, and the parts that are broken in themselves rule out theirs."""
    parts = ["CC", "C1CC", "CC1", "C(C", "CC)C", "C)C(C", "C=", "=C", ".C", "C.", "Cx", "C[Na", "C]", "C(C)(C)(C)(C)C", "(C)", "C1CC1(C)(C)(C)C", "C%01C", "", "C(=O", "C1.C1", "[Zz2"]
    texts = [".".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    read = {r["smiles"] for r in table(texts).join(G.graph(table(texts)), "mol_id").where("valid").select("smiles").collect()}
    closed = {r[0] for r in table(texts).where(G.closes(F.col("smiles"))).select("smiles").collect()}
    alone = {r["smiles"] for r in table(parts).where(G.spoils_any(F.col("smiles"))).select("smiles").collect()}
    spoilt = [".".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n) if set(p) & (alone - read)]
    assert read <= closed < set(texts) and {"C1CC.CC1", "C(C.CC)C", "CC.=C"} <= read
    assert not read & set(spoilt) and {"C=", "Cx", "C[Na", "C]", "C(C)(C)(C)(C)C"} <= alone and not alone & {"C1CC", "C(C", "CC)C", "=C", ""}
