import pytest
from pyspark.sql import functions as F

from routegrid.functions import text as T
from routegrid.operators import graph as G
from routegrid.operators import molecule as M
from routegrid.operators import stability as E

MASSES = {
    "NC(=O)c1cncc(F)n1": ("C5H4FN3O", 141.033839968), "O": ("H2O", 18.010564684),
    "NC(=O)C1=NC(F)=CN=C1O": ("C5H4FN3O2", 157.028754588), "O=C(O)O": ("CH2O3", 62.000393924),
    "N#Cc1cncc(F)n1": ("C5H2FN3", 123.023275284), "C[Si](C)(C)C#N": ("C4H9NSi", 99.050425818),
    "[O-][n+]1ccncc1F": ("C4H3FN2O", 114.022940936), "Fc1cnccn1": ("C4H3FN2", 98.028026316),
    "O=C(OO)c1cccc(Cl)c1": ("C7H5ClO3", 171.9927217),
}


def test_formula_and_mass(table):
    texts = list(MASSES) + ["not a molecule"]
    rows = {r["mol_id"]: r for r in M.formula_and_mass(table(texts)).collect()}
    for i, (formula, mass) in enumerate(MASSES.values()):
        assert rows[i]["chemical_formula"] == formula
        assert rows[i]["mass"] == pytest.approx(mass, abs=2e-6)
    assert (rows[len(MASSES)]["chemical_formula"], rows[len(MASSES)]["mass"]) == ("N/A", 0.0)


def test_descriptors(table):
    rows = {r["mol_id"]: r for r in M.describe(G.structures(table(["CCO", "CC(=O)OC1=CC=CC=C1C(=O)O"]))).collect()}
    got = [(round(r["weight"], 3), r["donors"], r["acceptors"], r["rotatable"]) for r in (rows[0], rows[1])]
    assert got[0] == (46.069, 1, 1, 0)
    assert got[1][0] == pytest.approx(180.159, abs=2e-3)
    assert got[1][1:] == (1, 3, 2)


def test_validity(table):
    cases = [("CCO", True), ("", True), ("C(C", False), ("C1CC", False), ("xx", False), ("C(C)(C)(C)(C)C", False),
             ("C=", False), ("CC)C", False), ("C%12CC%12", True), ("[Na+].[OH-]", True), ("C11", False), ("this_is_not_a_smiles", False),
             ("F/C=C/F", True), ("[C@@H](N)(C)C(=O)O", True), ("[Xx9", False)]
    rows = {r["mol_id"]: r["valid"] for r in M.is_valid(table([c for c, _ in cases])).collect()}
    assert [rows[i] for i in range(len(cases))] == [ok for _, ok in cases]


def test_structure_key_ignores_writing(table):
    same = [("OCC", "CCO"), ("c1ccccc1C", "CC1=CC=CC=C1"), ("C([H])([H])([H])O", "CO"), ("CC(C)O", "OC(C)C"), ("c1ccc2ccccc2c1", "C1=CC2=CC=CC=C2C=C1")]
    texts = [t for p in same for t in p] + ["CCN", "C(C"]
    keys = {r["mol_id"]: r["skey"] for r in M.structure_key(G.structures(table(texts))).collect()}
    for i in range(0, len(same) * 2, 2):
        assert keys[i] == keys[i + 1]
    assert len({keys[i] for i in range(0, len(same) * 2, 2)} | {keys[len(same) * 2]}) == len(same) + 1
    assert keys[len(same) * 2 + 1] is None


def test_structure_key_of_regular_graphs(table):
    """Graphs that neighbour hashing alone cannot tell apart, and other ways to write each."""
    groups = [
        ["C1CCC2CCCCC2C1", "C12CCCCC1CCCC2", "C1CCCC2C1CCCC2"], ["C1CCCC1C1CCCC1", "C1(CCCC1)C1CCCC1", "C1CCC(C1)C2CCCC2"],
        ["C1CCCCC1.C1CCCCC1", "C1CCCCC1.C2CCCCC2"], ["C1CCCCCCCCCCC1"], ["C12C3C1C1C2C31", "C12C3C4C1C4C32"], ["C12C3C1C2C3"],
    ]
    texts = [t for g in groups for t in g]
    keys = {r["mol_id"]: r["skey"] for r in M.structure_key(G.structures(table(texts))).collect()}
    found = [keys[i] for i in range(len(texts))]
    assert None not in found
    at = 0
    seen = []
    for g in groups[:4]:
        assert len(set(found[at:at + len(g)])) == 1, g
        seen.append(found[at])
        at += len(g)
    assert len(set(seen)) == len(seen)


def test_structure_key_of_long_chains(table):
    """A methyl at 15 or at 18 of 40 carbons; the first one also written from the other end."""
    texts = ["C" * 15 + "(C)" + "C" * 25, "C" * 18 + "(C)" + "C" * 22, "C" * 26 + "(C)" + "C" * 14]
    keys = [r["skey"] for r in M.structure_key(G.structures(table(texts))).orderBy("mol_id").collect()]
    assert keys[0] == keys[2] and keys[0] != keys[1] and None not in keys


def test_linear_text_reversed_keeps_formula(table):
    texts = ["CCOC(C)N", "NC(C)OCC", "CC(=O)CCCl", "ClCCC(C)=O"]
    rows = {r["mol_id"]: r["chemical_formula"] for r in M.formula_and_mass(table(texts)).collect()}
    assert rows[0] == rows[1] and rows[2] == rows[3]


def test_contains(spark, table):
    texts = ["Cc1ccccc1O", "c1ccccc1", "CCO", "OCC(N)C", "C1CCCCC1", "C(C"]
    forms = M.match_form(G.structures(table(texts)))
    pairs = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 3, 2), (3, 4, 1), (4, 0, 5), (5, 2, 2)], "pair_id long, target long, query long")
    got = {r["pair_id"]: r["found"] for r in M.contains(pairs, forms).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_masking(table):
    cases = [("COC", "&"), ("COC.COC", "&"), ("COCc1ccccc1", "%"), ("COC.COCc1ccccc1", "&"), ("COC.Cl", "&Cl"),
             ("COC(=O)[C@H](C)O", "&(=O)[C@H](C)O"), ("CCO", "CCO"), ("", ""), ("invalid_smiles", "INVALID_SMILES")]
    rows = {r["mol_id"]: r["masked"] for r in M.masked(table([c for c, _ in cases])).collect()}
    assert [rows[i] for i in range(len(cases))] == [m for _, m in cases]


def test_unmasking(table):
    cases = [("&", "COC"), ("%", "COCc1ccccc1"), ("CC(C)%", "CC(C)COCc1ccccc1"), ("CC(C)$%", "CC(C)OCCOCc1ccccc1")]
    rows = {r["mol_id"]: r for r in M.unmasked(table([c for c, _ in cases])).collect()}
    assert [rows[i]["unmasked"] for i in range(len(cases))] == [m for _, m in cases]
    assert all(r["is_masked"] for r in rows.values())


def test_drawing_sizes(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "H"), (3, "C6H12O6"), (4, "C60H60")], "id int, f string")
    rows = {r["id"]: r for r in df.select("id", T.formula_radius(F.col("f")).alias("r"), T.formula_svg(F.col("f")).alias("s"), T.format_formula(F.col("f")).alias("h")).collect()}
    assert (rows[0]["r"], rows[0]["s"]) == (35.0, 60.0) == (rows[1]["r"], rows[1]["s"])
    assert rows[2]["r"] == 45.0 and rows[3]["r"] > 45 and rows[4]["r"] > rows[3]["r"]
    assert rows[4]["s"] == pytest.approx(rows[4]["r"] * 2) and rows[3]["s"] == pytest.approx(rows[3]["r"] * 1.8)
    assert rows[3]["h"].count("<tspan") == 3


STABLE = {
    "c1ccccc1": (100, "Likely stable"), "C1CCNCCCCCCN1": (70, "Moderately stable"), "[CH2+]C": (45, "Potentially unstable"),
    "this_is_not_a_smiles": (0, ""),
}
ISSUES = {
    "C1CN1": ["Three-membered heterocycle"], "C1CNC1": ["Four-membered heterocycle"], "C1=CC=C1": ["4-membered ring with 4 π electrons"],
    "C1C2CC12": ["Fused 3 and 3-membered rings", "WARNING"], "C1CCNCCCC1": ["Large (8-membered) heterocycle with N"],
    "C1CNCCNCCNCCN1": ["Large (12-membered)", "Very large"], "C1CC2OCC12": ["Four-membered heterocycle", "Fused 4 and 4"],
    "[CH2+]C=C": ["primary carbocation"], "[CH2+]c1ccccc1": ["primary carbocation"], "C[C+](C)C": ["non-stabilized sp2"],
    "[CH2+]C": ["non-stabilized sp2", "primary carbocation"],
}
ABSENT = {"C1CC1": "heterocycle", "C1CCC1": "heterocycle", "[CH2+]C=C": "non-stabilized", "[CH2+]c1ccccc1": "non-stabilized", "C[C+](C)C": "primary"}


def test_stability(table):
    texts = sorted(set(STABLE) | set(ISSUES) | set(ABSENT))
    rows = {texts[r["mol_id"]]: r for r in E.stability(G.structures(table(texts))).collect()}
    for t, (score, word) in STABLE.items():
        assert (rows[t]["score"], rows[t]["assessment"]) == (score, word), t
    for t, wanted in ISSUES.items():
        have = [i["text"] for i in rows[t]["issues"]]
        assert all(any(w in h for h in have) for w in wanted), (t, have)
    for t, word in ABSENT.items():
        assert not any(word in i["text"] for i in rows[t]["issues"]), t


def test_logp_column(table):
    s = G.structures(table(["CCC"])).withColumn("logp", F.lit(11.0))
    assert E.stability(s).first()["score"] == 90
