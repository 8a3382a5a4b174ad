"""Heuristic stability of molecules: issues, score and assessment.

One row per molecule in, one row out; every rule is an expression over the row.  The order
matters: structural issues (E1-E6) cost 15 points each before charge-related issues are
added to the list.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import count_if, let, total
from ..plans.staging import stage
from .compare import text_structures
from .molecule import bridgeheads, ring_kinds, rotatable_bonds

_NONE = "array<struct<code:string,text:string>>"
# Neighbours that pull electrons from a charged or electron-poor carbon.
_HALOGENS = ["F", "Cl", "Br", "I"]


def _none() -> Column:
    return F.array().cast(_NONE)


def _issue(code: str, text) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def _once(code: str, test: Column, text: str) -> Column:
    return F.when(test, F.array(_issue(code, text))).otherwise(_none())


def _hetero(at: Column, ring: Column) -> Column:
    return F.filter(F.transform(ring, lambda i: F.get(at, i)["el"]), lambda e: ~e.isin("C", "H"))


def _names(els: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(els)), ", ")


def _non_c(at: Column, ring: Column) -> Column:
    return F.exists(ring, lambda i: F.get(at, i)["el"] != "C")


def small_hetero_rings(at: Column, rings: Column) -> Column:
    """E1."""
    hit = F.filter(rings, lambda r: (F.size(r) < 3) | (F.size(r).isin(3, 4) & _non_c(at, r)))
    return F.transform(hit, lambda r: _issue(
        "E1",
        F.when(F.size(r) == 3, "Three-membered heterocycle (potentially unstable)")
        .when(F.size(r) == 4, "Four-membered heterocycle (potentially unstable)")
        .otherwise(F.concat(F.lit("Highly strained ring of size "), F.size(r).cast("string")))))


def _ring_doubles(at: Column, ring: Column) -> Column:
    """Ends of double bonds inside the ring (each bond counts twice)."""
    return total(ring, lambda i: count_if(
        F.get(at, i)["nbrs"],
        lambda x: (x["ord"] == 2) & F.array_contains(ring, x["n"])
        & ~(F.get(at, i)["arom"] & F.get(at, x["n"])["arom"])))


def antiaromatic_motifs(at: Column, rings: Column) -> Column:
    """The three fixed motifs, each reported once."""

    def carbons(r: Column, arom: bool) -> Column:
        return F.forall(r, lambda i: (F.get(at, i)["el"] == "C") & (F.get(at, i)["arom"] == arom))

    def alternating(r: Column) -> Column:
        return F.forall(r, lambda i: count_if(
            F.get(at, i)["nbrs"], lambda x: (x["ord"] == 2) & F.array_contains(r, x["n"])) == 1)

    four = F.exists(rings, lambda r: (F.size(r) == 4) & carbons(r, True))
    eight = F.exists(rings, lambda r: (F.size(r) == 8) & carbons(r, False) & alternating(r))
    fives = F.filter(rings, lambda r: (F.size(r) == 5) & carbons(r, True))
    fused = let(fives, lambda f: F.exists(f, lambda r: F.exists(
        f, lambda q: (r != q) & (F.size(F.array_intersect(r, q)) == 2))))
    return F.concat(
        _once("E2", four, "Contains cyclobutadiene-like (anti-aromatic) motif"),
        _once("E2", eight, "Contains cyclooctatetraene-like (potential anti-aromatic) motif"),
        _once("E2", fused, "Contains pentalene-like (potential anti-aromatic) motif"),
    )


def four_n_rings(at: Column, rings: Column) -> Column:
    """Rings of 4, 8, 12 or 16 atoms with a multiple of four pi electrons."""
    counted = F.transform(
        F.filter(rings, lambda r: F.size(r).isin(4, 8, 12, 16)),
        lambda r: F.struct(
            F.size(r).alias("size"),
            (count_if(r, lambda i: F.get(at, i)["arom"]) + _ring_doubles(at, r)).alias("pi")),
    )
    return F.transform(
        F.filter(counted, lambda c: (c["pi"] > 0) & (c["pi"] % 4 == 0)),
        lambda c: _issue("E3", F.concat(
            c["size"].cast("string"), F.lit("-membered ring with "), c["pi"].cast("string"),
            F.lit(" π electrons (potential anti-aromatic)"))),
    )


def fused_small_rings(rings: Column) -> Column:
    """Pairs of rings up to four atoms that share atoms, and one warning."""
    small = F.filter(rings, lambda r: F.size(r) <= 4)
    pairs = let(small, lambda s: F.flatten(F.transform(s, lambda r, i: F.transform(
        F.filter(F.slice(s, i + 2, F.size(s)), lambda q: F.arrays_overlap(r, q)),
        lambda q: _issue("E4", F.concat(
            F.lit("Fused "), F.size(r).cast("string"), F.lit(" and "), F.size(q).cast("string"),
            F.lit("-membered rings (highly strained system)")))))))
    warn = _issue("E4", "WARNING: Fused small rings create highly strained and potentially explosive compounds")
    return let(pairs, lambda p: F.when(F.size(p) > 0, F.array_append(p, warn)).otherwise(_none()))


def large_heterocycles(at: Column, rings: Column) -> Column:
    """E5."""
    big = F.filter(rings, lambda r: (F.size(r) >= 7) & (F.size(_hetero(at, r)) > 0))
    return F.flatten(F.transform(big, lambda r: F.concat(
        F.array(_issue("E5", F.concat(
            F.lit("Large ("), F.size(r).cast("string"), F.lit("-membered) heterocycle with "),
            _names(_hetero(at, r)), F.lit(" (potentially unstable)")))),
        _once("E5", (F.size(r) > 10) & (F.size(_hetero(at, r)) >= 3),
              "Very large heterocycle with multiple heteroatoms (significant stability concern)"))))


def strained_bridges(rings: Column, n_bridgeheads: Column) -> Column:
    """E6."""
    return _once("E6", (n_bridgeheads >= 2) & F.exists(rings, lambda r: F.size(r) <= 4),
                 "Strained polycyclic system with bridgehead atoms")


def _pulled(at: Column, a: Column) -> Column:
    """Singly bonded to a halogen or to a positive N, S or O."""

    def hit(x: Column) -> Column:
        b = F.get(at, x["n"])
        return (x["ord"] == 1) & ~b["arom"] & (
            b["el"].isin(_HALOGENS) | (b["el"].isin("N", "S", "O") & (b["charge"] == 1)))

    return F.exists(a["nbrs"], hit)


def carbocations(at: Column) -> Column:
    """Struct of issues and points."""

    def next_to(a: Column, test) -> Column:
        return F.exists(a["nbrs"], lambda x: test(x, F.get(at, x["n"])))

    def c(a: Column) -> Column:
        return (a["el"] == "C") & ~a["arom"]

    plus = F.filter(at, lambda a: c(a) & (a["charge"] == 1))

    def rules(p: Column) -> Column:
        allylic = F.exists(p, lambda a: next_to(a, lambda x, b: (x["ord"] == 1) & c(b) & next_to(
            b, lambda y, d: (y["ord"] == 2) & c(d))))
        benzylic = F.exists(p, lambda a: next_to(
            a, lambda x, b: (x["ord"] == 1) & b["arom"] & (b["el"] == "C")))
        three = F.filter(p, lambda a: F.size(a["nbrs"]) + a["h"] == 3)
        free = F.filter(three, lambda a: ~(allylic | benzylic | next_to(a, lambda x, b: b["arom"])))
        sp = F.exists(p, lambda a: F.size(a["nbrs"]) + a["h"] == 2)
        pulled = F.exists(p, lambda a: _pulled(at, a))

        def carbons(a: Column) -> Column:
            return count_if(a["nbrs"], lambda x: (x["ord"] == 1) & (F.get(at, x["n"])["el"] == "C"))

        primary = F.exists(p, lambda a: (a["h"] == 2) & (carbons(a) >= 1))
        secondary = ~primary & F.exists(p, lambda a: (a["h"] == 1) & (carbons(a) >= 2))
        issues = F.concat(
            F.transform(free, lambda a: _issue(
                "E7", "Contains non-stabilized sp2 carbocation (highly unstable intermediate)")),
            _once("E7", sp, "Contains sp carbocation (highly unstable intermediate)"),
            _once("E7", pulled, "Contains carbocation adjacent to electron-withdrawing group (extremely unstable)"),
            _once("E7", primary, "Contains primary carbocation (highly unstable)"),
            _once("E7", secondary, "Contains secondary carbocation (unstable intermediate)"),
        )
        points = (
            10 * (F.size(three) - F.size(free)) - 25 * F.size(free)
            - 30 * sp.cast("int") - 35 * pulled.cast("int") - 30 * primary.cast("int") - 25 * secondary.cast("int")
        )
        return F.struct(issues.alias("issues"), points.alias("points"))

    none = F.struct(_none().alias("issues"), F.lit(0).alias("points"))
    return let(plus, lambda p: F.when(F.size(p) > 0, rules(p)).otherwise(none))


def carbenes(at: Column, rings: Column) -> Column:
    """Struct of issues and points."""
    lone = F.filter(at, lambda a: (a["el"] == "C") & ~a["arom"] & (a["charge"] == 0) & (a["h"] == 0)
                    & (F.size(a["nbrs"]) == 2))

    def rules(p: Column) -> Column:
        def in_ring(size: int) -> Column:
            def plain(r: Column) -> Column:
                return F.forall(r, lambda i: F.get(at, i)["el"].isin("C", "N", "O") & ~F.get(at, i)["arom"]
                                & ~F.exists(F.get(at, i)["nbrs"], lambda x: (x["ord"] > 1) & F.array_contains(r, x["n"])))

            return F.exists(p, lambda a: F.exists(
                rings, lambda r: (F.size(r) == size) & F.array_contains(r, a["idx"]) & plain(r)))

        pulled = F.exists(p, lambda a: _pulled(at, a))
        issues = F.concat(
            F.array(_issue("E8", "Contains carbene (highly reactive intermediate)")),
            _once("E8", pulled, "Contains carbene adjacent to electron-withdrawing group (extremely unstable)"),
            _once("E8", in_ring(3), "Contains carbene in 3-membered ring (extremely unstable)"),
            _once("E8", in_ring(4), "Contains carbene in 4-membered ring (highly unstable)"),
        )
        points = -35 - 10 * pulled.cast("int") - 15 * in_ring(3).cast("int") - 10 * in_ring(4).cast("int")
        return F.struct(issues.alias("issues"), points.alias("points"))

    none = F.struct(_none().alias("issues"), F.lit(0).alias("points"))
    return let(lone, lambda p: F.when(F.size(p) > 0, rules(p)).otherwise(none))


def fused_five_rings(at: Column, rings: Column) -> Column:
    """Carbon 5-rings sharing an atom with a 3- or 4-ring that has a hetero atom.

    Applies once the molecule has a saturated-bond aliphatic carbon 5-ring.
    """
    def plain(r: Column) -> Column:
        return F.forall(r, lambda i: (F.get(at, i)["el"] == "C") & ~F.get(at, i)["arom"]
                        & ~F.exists(F.get(at, i)["nbrs"], lambda x: (x["ord"] > 1) & F.array_contains(r, x["n"])))

    trigger = F.exists(rings, lambda r: (F.size(r) == 5) & plain(r))
    fives = F.filter(rings, lambda r: (F.size(r) == 5) & ~_non_c(at, r))
    small = F.filter(rings, lambda r: F.size(r).isin(3, 4) & _non_c(at, r))
    found = let(small, lambda s: F.flatten(F.transform(fives, lambda r: F.transform(
        F.filter(s, lambda q: F.arrays_overlap(r, q)),
        lambda q: _issue("E9", F.concat(
            F.lit("5-membered carbon ring fused with "), F.size(q).cast("string"),
            F.lit("-membered ring containing "),
            _names(F.filter(F.transform(q, lambda i: F.get(at, i)["el"]), lambda e: e != "C")),
            F.lit(" (strained system)")))))))
    return F.when(trigger, found).otherwise(_none())


def stability(s: DataFrame) -> DataFrame:
    """(mol_id, valid, issues, score, assessment); optional ``logp`` input column."""
    at, rings = F.col("atoms"), F.col("rings")
    logp = F.col("logp") if "logp" in s.columns else F.lit(0.0)
    parts = s.select(
        "mol_id", "valid", "rings", logp.alias("logp"),
        F.size(bridgeheads(rings)).alias("n_bridge"),
        let(at, lambda a: ring_kinds(a, rings)).alias("kinds"),
        let(at, lambda a: rotatable_bonds(a, rings)).alias("rotatable"),
        let(at, lambda a: F.concat(
            small_hetero_rings(a, rings), antiaromatic_motifs(a, rings), four_n_rings(a, rings))).alias("first"),
        fused_small_rings(rings).alias("fused"),
        let(at, lambda a: large_heterocycles(a, rings)).alias("large"),
        let(at, carbocations).alias("cations"),
        let(at, lambda a: carbenes(a, rings)).alias("carbenes"),
        let(at, lambda a: fused_five_rings(a, rings)).alias("fives"),
    )
    before = F.concat("first", "fused", "large", strained_bridges(F.col("rings"), F.col("n_bridge")))
    listed = parts.withColumn("before", before).withColumn(
        "issues", F.concat("before", F.col("cations.issues"), F.col("carbenes.issues"), "fives"))
    kinds = F.col("kinds")
    n_aromatic = count_if(kinds, lambda k: k["arom"])
    n_aliphatic = count_if(kinds, lambda k: ~k["arom"])
    n_ali_hetero = count_if(kinds, lambda k: ~k["arom"] & ~k["carbo"])
    anti = count_if(F.col("issues"), lambda i: F.contains(i["text"], F.lit("anti-aromatic")))
    big = count_if(F.col("issues"), lambda i: F.contains(i["text"], F.lit("heterocycle"))
                   & F.contains(F.lower(i["text"]), F.lit("large")))
    raw = (
        100 - 15 * F.size("before") + F.col("cations.points") + F.col("carbenes.points") - 40 * F.size("fives")
        - F.when(F.abs("logp") > 10, 10).otherwise(0) - F.when(F.col("rotatable") > 15, 10).otherwise(0)
        + F.least(5 * n_aromatic, F.lit(15))
        - F.when(n_aliphatic <= 3, 5 * n_ali_hetero).otherwise(0)
        - F.when(F.exists("rings", lambda r: F.size(r) <= 5), 5 * F.col("n_bridge")).otherwise(0)
        - F.when(F.size("fused") > 0, 30).otherwise(0) - 25 * anti - 10 * big
    )
    score = F.when(F.col("valid"), F.least(F.greatest(raw, F.lit(0)), F.lit(100))).otherwise(0)
    invalid = F.array(_issue("invalid", "Invalid SMILES string or cannot be parsed"))
    out = listed.select(
        "mol_id", "valid", F.when(F.col("valid"), F.col("issues")).otherwise(invalid).alias("issues"),
        score.cast("int").alias("score"))
    return out.withColumn("assessment", F.when(~F.col("valid"), "").otherwise(assessment(F.col("score"))))


def assessment(score: Column) -> Column:
    return F.when(score >= 80, "Likely stable").when(score >= 50, "Moderately stable").otherwise("Potentially unstable")


def issue_rows(st: DataFrame) -> DataFrame:
    return st.select("mol_id", F.explode("issues").alias("i")).select("mol_id", "i.*")


def stability_filter(pathways: DataFrame, key: Sequence[str], scores: DataFrame | None = None) -> DataFrame:
    """``pathways(target, rank, reactants)`` whose molecules are all stable enough.

    ``key`` names the columns that tell pathways apart.  Counts per pathway combine before the shuffle; the reactant lists themselves stay put.
    """
    key = list(key)
    pathways = stage(pathways)  # read three times below
    parts = pathways.select(*key, F.explode("reactants").alias("smiles"))
    if scores is None:
        scores = stability(text_structures(parts))
    good = scores.select("mol_id", F.col("assessment").isin("Likely stable", "Moderately stable").alias("good"))
    judged = parts.withColumn("mol_id", F.md5("smiles")).join(good, "mol_id", "left")
    bad = judged.groupBy(*key).agg(
        F.min(F.coalesce("good", F.lit(False))).alias("all_good")).where("NOT all_good")
    return pathways.join(bad, key, "left_anti")
