"""Scalars, descriptors and predicates of molecules.

Input is the ``structures`` table (one row per molecule: atoms, rings), so every check here
is a projection over one row: no shuffle, whatever the number of molecules.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ELEMENTS
from ..functions.matching import embeds_udf
from ..functions.rows import count_if, let, total
from ..functions.text import is_masked_text, mask_groups, unmask_groups
from ..plans.staging import stage
from .graph import graph, n_bonds, ring_count, structures


def heavy(at: Column) -> Column:
    return F.filter(at, lambda a: a["el"] != "")


def chemical_formula(at: Column) -> Column:
    """Hill order (C, H, then by name; by name alone without C), charge at the end."""

    def counted(names: Column) -> Column:
        # hydrogens carried by atoms are added to the element list once
        return F.transform(
            names,
            lambda e: F.struct(
                e.alias("el"),
                (count_if(at, lambda a: a["el"] == e)
                 + F.when(e == "H", total(at, lambda a: a["h"])).otherwise(0)).alias("n"),
            ),
        )

    names = F.array_distinct(
        F.concat(
            F.transform(at, lambda a: a["el"]),
            F.when(F.exists(at, lambda a: a["h"] > 0), F.array(F.lit("H")))
            .otherwise(F.array().cast("array<string>")),
        )
    )

    def text(parts: Column) -> Column:
        has_c = F.exists(parts, lambda p: p["el"] == "C")
        ranked = F.array_sort(
            F.transform(
                parts,
                lambda p: F.struct(
                    F.when(has_c & (p["el"] == "C"), 0).when(has_c & (p["el"] == "H"), 1)
                    .otherwise(2).alias("r"),
                    p["el"].alias("el"), p["n"].alias("n"),
                ),
            )
        )
        return F.array_join(
            F.transform(
                ranked,
                lambda p: F.concat(p["el"], F.when(p["n"] == 1, "").otherwise(p["n"].cast("string"))),
            ),
            "",
        )

    charge = total(at, lambda a: a["charge"])
    sign = F.when(charge > 0, "+").otherwise("-")
    suffix = F.when(charge == 0, "").when(F.abs(charge) == 1, sign).otherwise(
        F.concat(sign, F.abs(charge).cast("string"))
    )
    return F.concat(let(counted(names), text), suffix)


def _mass(at: Column, slot: int) -> Column:
    table = F.create_map(*[F.lit(x) for el, v in ELEMENTS.items() for x in (el, float(v[slot]))])
    h = ELEMENTS["H"][slot]
    return total(at, lambda a: F.coalesce(table[a["el"]], F.lit(0.0)) + a["h"] * h, "double")


def exact_mass(at: Column) -> Column:
    """C3."""
    return _mass(at, 1)


def average_weight(at: Column) -> Column:
    """C4."""
    return _mass(at, 2)


def _order_sum(a: Column) -> Column:
    return total(a["nbrs"], lambda x: x["ord"])


def _in_one_ring(rings: Column, i: Column, j: Column) -> Column:
    return F.exists(rings, lambda r: F.array_contains(r, i) & F.array_contains(r, j))


def h_donors(at: Column) -> Column:
    """N or O/S that carry hydrogen and are not charged up beyond an ammonium."""
    return count_if(
        at,
        lambda a: F.when(
            (a["el"] == "N") & ~a["arom"],
            (a["h"] > 0)
            & (((a["charge"] == 0) & (_order_sum(a) + a["h"] == 3))
               | ((a["charge"] == 1) & (_order_sum(a) + a["h"] == 4))),
        )
        .when(a["el"] == "N", (a["h"] == 1) & (a["charge"] == 0))
        .when(a["el"].isin("O", "S") & ~a["arom"], (a["h"] == 1) & (a["charge"] == 0))
        .otherwise(False),
    )


def h_acceptors(at: Column, rings: Column) -> Column:
    """Lone pairs free to accept; an acid OH or an amide N does not count."""

    def pulls(x: Column, outside_only: bool) -> Column:
        """Atom ``x`` has a double bond to O, N, P or S."""
        me = F.get(at, x)

        def hit(y: Column) -> Column:
            other = F.get(at, y["n"])
            plain = (y["ord"] == 2) & other["el"].isin("O", "N", "P", "S")
            if outside_only:
                return plain & ~_in_one_ring(rings, x, y["n"])
            return plain & ~(me["arom"] & other["arom"])

        return F.exists(me["nbrs"], hit)

    def accepts(a: Column) -> Column:
        v = _order_sum(a) + a["h"]
        chalcogen = a["el"].isin("O", "S") & ~a["arom"]
        return (
            F.when(
                chalcogen,
                ((a["h"] == 1) & (v == 2)
                 & F.exists(a["nbrs"], lambda x: (x["ord"] == 1) & ~pulls(x["n"], False)))
                | ((a["h"] == 0) & (v == 2)) | (a["charge"] == -1),
            )
            .when(a["arom"] & (a["el"] == "N"), (a["h"] == 0) & (a["charge"] == 0))
            .when(a["arom"] & a["el"].isin("O", "S"), a["charge"] == 0)
            .when(
                a["el"] == "N",
                (v == 3) & ~F.exists(a["nbrs"], lambda x: (x["ord"] == 1) & pulls(x["n"], True)),
            )
            .otherwise(False)
        )

    return count_if(at, accepts)


def rotatable_bonds(at: Column, rings: Column) -> Column:
    """Single non-ring bonds between inner atoms, without amide, ester or alkyne ends."""

    def triple(a: Column) -> Column:
        return F.exists(a["nbrs"], lambda x: x["ord"] == 3)

    def acyl(a: Column) -> Column:
        return (a["el"] == "C") & (F.size(a["nbrs"]) == 3) & F.exists(
            a["nbrs"], lambda x: (x["ord"] == 2) & F.get(at, x["n"])["el"].isin("N", "O", "S")
        )

    def turns(a: Column, x: Column) -> Column:
        b = F.get(at, x["n"])
        joint = (acyl(a) & b["el"].isin("N", "O", "S")) | (acyl(b) & a["el"].isin("N", "O", "S"))
        return (
            (x["n"] > a["idx"]) & (x["ord"] == 1)
            & (F.size(a["nbrs"]) > 1) & (F.size(b["nbrs"]) > 1)
            & ~_in_one_ring(rings, a["idx"], x["n"]) & ~triple(a) & ~triple(b) & ~joint
        )

    return total(at, lambda a: count_if(a["nbrs"], lambda x: turns(a, x)))


def ring_bonds(ring: Column) -> Column:
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring, turned, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    )


def bridgeheads(rings: Column) -> Column:
    """Ends of a path of two or more bonds shared by two rings, as an atom list."""

    def ends(shared: Column) -> Column:
        flat = F.concat(F.transform(shared, lambda b: b["a"]), F.transform(shared, lambda b: b["b"]))
        return let(flat, lambda all_: F.filter(
            all_, lambda i: count_if(all_, lambda j: j == i) == 1))

    def pairs(sides: Column) -> Column:
        return F.flatten(F.transform(
            sides,
            lambda x, i: F.flatten(F.transform(
                F.slice(sides, i + 2, F.size(sides)),
                lambda y: let(F.array_intersect(x, y),
                              lambda s: F.when(F.size(s) >= 2, ends(s))
                              .otherwise(F.array().cast("array<int>"))),
            )),
        ))

    found = F.array_distinct(let(F.transform(rings, ring_bonds), pairs))
    return F.when(F.size(rings) > 1, found).otherwise(F.array().cast("array<int>"))


def ring_kinds(at: Column, rings: Column) -> Column:
    """Per ring its size, aromatic flag and whether it is all carbon."""
    return F.transform(
        rings,
        lambda r: F.struct(
            F.size(r).alias("size"),
            F.forall(r, lambda i: F.get(at, i)["arom"]).alias("arom"),
            F.forall(r, lambda i: F.get(at, i)["el"] == "C").alias("carbo"),
        ),
    )


def describe(s: DataFrame) -> DataFrame:
    """C2-C8 for valid molecules, one column per descriptor."""
    at, rings = F.col("atoms"), F.col("rings")
    base = s.where("valid").select(
        "mol_id", "atoms", "rings",
        let(heavy(at), chemical_formula).alias("formula"),
        let(heavy(at), exact_mass).alias("exact_mass"),
        let(heavy(at), average_weight).alias("weight"),
        let(at, h_donors).alias("donors"),
        let(at, lambda a: h_acceptors(a, rings)).alias("acceptors"),
        let(at, lambda a: rotatable_bonds(a, rings)).alias("rotatable"),
        let(at, lambda a: ring_kinds(a, rings)).alias("kinds"),
        bridgeheads(rings).alias("bridgeheads"),
    )
    kinds = F.col("kinds")

    def kind(arom: bool, carbo: bool | None = None) -> Column:
        return count_if(
            kinds, lambda k: (k["arom"] == arom) & (F.lit(True) if carbo is None else k["carbo"] == carbo)
        )

    n_heavy = count_if(at, lambda a: (a["el"] != "") & (a["el"] != "H"))
    n_arom = count_if(at, lambda a: a["arom"])
    return base.select(
        "mol_id", "formula", "exact_mass", "weight", "donors", "acceptors", "rotatable",
        F.size("rings").alias("n_rings"),
        kind(False, True).alias("aliphatic_carbocycles"),
        kind(False, False).alias("aliphatic_heterocycles"),
        kind(False).alias("aliphatic_rings"),
        kind(True, True).alias("aromatic_carbocycles"),
        kind(True, False).alias("aromatic_heterocycles"),
        kind(True).alias("aromatic_rings"),
        F.size("bridgeheads").alias("n_bridgeheads"),
        F.size(heavy(at)).alias("n_atoms"),
        n_bonds().alias("n_bonds"),
        n_heavy.alias("n_heavy"),
        n_arom.alias("n_aromatic"),
        (n_heavy - n_arom).alias("n_aliphatic"),
    )


def formula_and_mass(molecules: DataFrame) -> DataFrame:
    """C2 and C3 for every text: ``N/A`` and 0.0 where it cannot be read."""
    at = F.col("atoms")
    return graph(molecules).select(
        "mol_id",
        F.when(F.col("valid"), let(heavy(at), chemical_formula)).otherwise("N/A").alias("chemical_formula"),
        F.when(F.col("valid"), let(heavy(at), exact_mass)).otherwise(0.0).alias("mass"),
    )


def is_valid(molecules: DataFrame) -> DataFrame:
    """C1."""
    return graph(molecules).select("mol_id", "valid")


def of_heavy(at: Column, values: Column) -> Column:
    """The entries of ``values`` (one per atom) that belong to unfolded atoms."""
    return F.transform(heavy(at), lambda a: F.get(values, a["idx"]))


def _of(values: Column, at: Column) -> Column:
    """``values`` at the places ``at``."""
    return F.transform(at, lambda i: F.get(values, i))


def _hashing(at: Column, rings: Column, body: Callable[[Column, Callable[[Column], Column], Column], Column]) -> Column:
    """``body(start, turn, places)`` of a molecule's atoms.

    ``start`` is every atom's first hash, ``turn`` makes all hashes the next ones by a round over
    the neighbours, ``places`` are the numbers of unfolded atoms.  Bond labels and places are found
    once per molecule, not once a round.
    """
    def links(a: Column) -> Column:
        def label(x: Column) -> Column:
            shared = a["arom"] & F.get(at, x["n"])["arom"] & _in_one_ring(rings, a["idx"], x["n"])
            return F.concat(F.when(shared, "a").otherwise(x["ord"].cast("string")), F.lit(":"))

        return F.transform(a["nbrs"], lambda x: F.struct(x["n"].alias("n"), label(x).alias("label")))

    start = F.transform(
        at,
        lambda a: F.md5(F.concat_ws(
            "|", a["el"], a["arom"].cast("int"), a["charge"], a["h"], F.size(a["nbrs"]))),
    )

    def bound(m: Column) -> Column:
        def turn(now: Column) -> Column:
            # sort_array compares natively; array_sort calls a lambda for every comparison
            return F.transform(m["links"], lambda near, i: F.md5(F.concat(
                F.get(now, i), F.lit("|"),
                F.array_join(F.sort_array(F.transform(near, lambda x: F.concat(x["label"], F.get(now, x["n"])))), ","))))

        return body(start, turn, m["places"])

    return let(F.struct(
        F.transform(at, links).alias("links"), F.transform(heavy(at), lambda a: a["idx"]).alias("places")), bound)


def _environments(at: Column, rings: Column, radius: int) -> Column:
    """Hash of every atom's surroundings for each radius 0..radius, as one flat list."""
    def body(start: Column, turn: Callable[[Column], Column], places: Column) -> Column:
        def grow(state: Column, _: Column) -> Column:
            return let(turn(state["now"]), lambda n: F.struct(
                n.alias("now"), F.concat(state["seen"], _of(n, places)).alias("seen")))

        first = let(start, lambda n: F.struct(n.alias("now"), _of(n, places).alias("seen")))
        rounds = F.sequence(F.lit(1), F.lit(radius)) if radius else F.array().cast("array<int>")
        return F.aggregate(rounds, first, grow)

    return _hashing(at, rings, body)


def environment_hashes(s: DataFrame, radius: int) -> DataFrame:
    """Atom hashes at exactly ``radius``, as ``envs`` (folded hydrogens left out)."""
    env = let(F.col("atoms"), lambda at: let(
        _environments(at, F.col("rings"), radius)["now"],
        lambda now: of_heavy(at, now)))
    return s.where("valid").withColumn("envs", env)


def _settled_hashes(start: Column, turn: Callable[[Column], Column], places: Column, rounds: int) -> Column:
    """Atom hashes after ``rounds`` rounds and as many more as tell further atoms apart.

    Every further round but the last tells at least one more atom apart, so their number is bounded
    by the atoms not told apart yet.  A longer fold would copy all hashes once a step for nothing.
    """

    def state(now: Column, before: Column) -> Column:
        return let(now, lambda n: F.struct(
            n.alias("now"), before.alias("before"), F.size(F.array_distinct(_of(n, places))).alias("kinds")))

    def grow(s: Column, _: Column) -> Column:
        return F.when(s["kinds"] > s["before"], state(turn(s["now"]), s["kinds"])).otherwise(s)

    def settle(s: Column) -> Column:
        steps = F.when(s["kinds"] > s["before"], F.sequence(F.lit(1), F.size(places) - s["kinds"] + 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, s, grow)["now"]

    if not rounds:
        return let(state(start, F.lit(0)), settle)
    early = F.aggregate(F.sequence(F.lit(1), F.lit(rounds - 1)), start, lambda now, _: turn(now)) if rounds > 1 else start
    return let(let(early, lambda now: state(turn(now), F.size(F.array_distinct(_of(now, places))))), settle)


def structure_key(s: DataFrame, rounds: int = 6) -> DataFrame:
    """One text per structure, equal for every way to write the molecule.

    Iterated neighbour hashing, until no round tells more atoms apart (``rounds`` rounds at
    least).  Of a molecule with rings that leaves atoms alike, the smallest class of such atoms
    (of equal ones the least hash) is individualised: each of its atoms in turn gets a hash of
    its own, the hashes settle again, and all outcomes, sorted, go into the key.  That tells
    regular graphs apart, such as two fused from two joined rings; atoms that are alike by
    symmetry give equal outcomes.  Blind to stereo marks.  NULL for invalid texts.
    """
    def key(at: Column) -> Column:
        def body(start: Column, turn: Callable[[Column], Column], places: Column) -> Column:
            def listed(now: Column) -> Column:
                return F.array_join(F.sort_array(_of(now, places)), ",")

            def outcomes(now: Column) -> Column:
                alike = let(_of(now, places), lambda h: F.array_min(F.filter(F.transform(
                    F.array_distinct(h), lambda x: F.struct(count_if(h, lambda o: o == x).alias("n"), x.alias("h"))), lambda c: c["n"] > 1)))
                return let(alike, lambda cell: F.sort_array(F.transform(
                    F.filter(places, lambda p: F.get(now, p) == cell["h"]),
                    lambda p: F.md5(listed(_settled_hashes(F.transform(
                        now, lambda h, i: F.when(i == p, F.md5(F.concat(h, F.lit("*")))).otherwise(h)), turn, places, 0))))))

            def whole(now: Column) -> Column:
                tied = (F.size("rings") > 0) & (F.size(F.array_distinct(_of(now, places))) < F.size(places))
                return F.md5(F.when(tied, F.concat(listed(now), F.lit("|"), F.array_join(outcomes(now), ","))).otherwise(listed(now)))

            return let(_settled_hashes(start, turn, places, rounds), whole)

        return _hashing(at, F.col("rings"), body)

    return s.select("mol_id", F.when(F.col("valid"), let(F.col("atoms"), key)).alias("skey"))


def fingerprint(s: DataFrame, radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """Sorted set bits; NULL for invalid texts."""
    hashes = let(F.col("atoms"), lambda at: _environments(at, F.col("rings"), radius)["seen"])
    bits = F.sort_array(F.array_distinct(F.transform(
        hashes, lambda x: F.pmod(F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint"), F.lit(n_bits)).cast("int"))))
    return s.select("mol_id", F.when(F.col("valid"), bits).alias("bits"))


def same_molecule(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """``pairs(pair_id, left, right)`` of mol ids -> ``same`` (NULL if one is invalid)."""
    left = keys.select(F.col("mol_id").alias("left"), F.col("skey").alias("lkey"))
    right = keys.select(F.col("mol_id").alias("right"), F.col("skey").alias("rkey"))
    return (
        pairs.join(left, "left", "left").join(right, "right", "left")
        .select("pair_id", (F.col("lkey") == F.col("rkey")).alias("same"))
    )


def is_basic(s: DataFrame, molecules: DataFrame, stock: DataFrame) -> DataFrame:
    """In stock, or fewer than five atoms, or fewer than five carbons."""
    at = F.col("atoms")
    small = F.col("valid") & (
        (F.size(heavy(at)) < 5) | (count_if(at, lambda a: a["el"] == "C") < 5))
    known = stock.select("smiles").distinct().withColumn("_known", F.lit(True))
    return (
        molecules.join(known, "smiles", "left")
        .join(s.select("mol_id", small.alias("_small")), "mol_id")
        .select("mol_id", (F.coalesce(F.col("_known"), F.lit(False)) | F.col("_small")).alias("basic"))
    )


def has_ring_of_size(s: DataFrame, size: int) -> DataFrame:
    """C13."""
    return s.select(
        "mol_id",
        (F.col("valid") & F.exists("rings", lambda r: F.size(r) == size)).alias("has_ring"),
    )


def masked(molecules: DataFrame) -> DataFrame:
    """C14."""
    return molecules.join(is_valid(molecules), "mol_id").select(
        "mol_id", mask_groups(F.col("smiles"), F.col("valid")).alias("masked"))


def unmasked(molecules: DataFrame) -> DataFrame:
    """Group texts restored, NULL where the result is not a molecule."""
    plain = molecules.select(
        "mol_id", F.col("smiles").alias("_in"), unmask_groups(F.col("smiles")).alias("smiles"))
    return plain.join(is_valid(plain.select("mol_id", "smiles")), "mol_id").select(
        "mol_id", F.when(F.col("valid"), F.col("smiles")).alias("unmasked"),
        is_masked_text(F.col("_in")).alias("is_masked"))


def match_form(s: DataFrame) -> DataFrame:
    """C11 input: atoms and bonds of a molecule as short texts, plus element counts."""
    at, rings = F.col("atoms"), F.col("rings")
    atom = F.transform(heavy(at), lambda a: F.concat_ws(
        " ", a["idx"], F.concat(F.when(a["arom"], F.lower(a["el"])).otherwise(a["el"]), a["charge"].cast("string"))))

    def links(all_: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            both = a["arom"] & F.get(all_, x["n"])["arom"] & _in_one_ring(rings, a["idx"], x["n"])
            return F.concat_ws(" ", a["idx"], x["n"], F.when(both, "a").otherwise(x["ord"].cast("string")))

        return F.flatten(F.transform(all_, lambda a: F.transform(a["nbrs"], lambda x: one(a, x))))

    kinds = F.transform(heavy(at), lambda a: F.concat(
        F.when(a["arom"], F.lower(a["el"])).otherwise(a["el"]), a["charge"].cast("string")))
    counts = let(kinds, lambda k: F.map_from_entries(F.transform(
        F.array_distinct(k),
        lambda e: F.struct(e.alias("k"), count_if(k, lambda o: o == e).alias("n")))))
    return s.where("valid").select(
        "mol_id", atom.alias("m_atoms"), let(at, links).alias("m_bonds"), counts.alias("m_counts"))


def contains(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """C11: ``pairs(pair_id, target, query)`` -> ``found`` 1/0; unreadable texts give 0.

    Pairs whose query needs more atoms of some kind than the target has are settled in the
    JVM; only the rest is matched.  Forms are written once, as both joins read them.
    """
    forms = stage(forms)
    joined = (
        pairs.join(_spread(_side("t", forms)), F.col("target") == F.col("t_mol_id"), "left")
        .join(_spread(_side("q", forms)), F.col("query") == F.col("q_mol_id"), "left")
    )
    return _matched(joined, "pair_id")


def _side(prefix: str, forms: DataFrame) -> DataFrame:
    return forms.select(*[F.col(c).alias(f"{prefix}_{c}") for c in forms.columns])


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that carry molecules, to be joined where they are dealt out.

    Nested rows take a hundredth of their size in a file, so Catalyst, which goes by files, would
    send far more than its limit through the driver.
    """
    return rows.hint("merge")


def _matched(joined: DataFrame, *keys: str) -> DataFrame:
    """keys and ``found`` of rows that hold both sides' match forms."""
    enough = F.forall(
        F.map_entries("q_m_counts"),
        lambda e: F.coalesce(F.col("t_m_counts")[e["key"]], F.lit(0)) >= e["value"],
    ) & (F.size("q_m_bonds") <= F.size("t_m_bonds"))
    test = F.coalesce(enough, F.lit(False))
    sides = [f"{t}_m_{c}" for t in ("t", "q") for c in ("atoms", "bonds")]
    # pairs that are settled send NULLs to Python and come back as "no"
    ready = joined.withColumn("_try", test).select(*keys, *[F.when(F.col("_try"), F.col(c)).alias(c) for c in sides])
    return ready.withColumn("found", embeds_udf(*sides).cast("int")).select(*keys, "found")


def path_features(s: DataFrame) -> DataFrame:
    """C11 index input: ``m_paths``, the distinct labelled paths of one, two and three atoms of a valid molecule.

    A molecule that holds another holds all its paths, as atoms and bonds map to equal ones.
    """
    at, rings = F.col("atoms"), F.col("rings")

    def kind(a: Column) -> Column:
        return F.concat(F.when(a["arom"], F.lower(a["el"])).otherwise(a["el"]), a["charge"].cast("string"))

    def paths(all_: Column) -> Column:
        def bond(a: Column, x: Column) -> Column:
            both = a["arom"] & F.get(all_, x["n"])["arom"] & _in_one_ring(rings, a["idx"], x["n"])
            return F.when(both, "a").otherwise(x["ord"].cast("string"))

        def around(a: Column) -> Column:
            near = F.filter(a["nbrs"], lambda x: F.get(all_, x["n"])["el"] != "")
            arms = F.transform(near, lambda x: F.struct(x["n"].alias("n"), F.concat(bond(a, x), kind(F.get(all_, x["n"]))).alias("arm")))
            return let(arms, lambda ends: F.concat(
                F.array(kind(a)), F.transform(ends, lambda e: F.concat_ws("-", kind(a), e["arm"])),
                F.flatten(F.transform(ends, lambda e: F.transform(
                    F.filter(ends, lambda o: (o["n"] != e["n"]) & (o["arm"] >= e["arm"])), lambda o: F.concat_ws("-", e["arm"], kind(a), o["arm"]))))))

        return F.array_distinct(F.flatten(F.transform(heavy(all_), around)))

    return s.where("valid").select("mol_id", let(at, paths).alias("m_paths"))


def search(queries: DataFrame, targets: DataFrame, few: int = 5000) -> DataFrame:
    """C11 over an index: ``query, target`` of every molecule of ``targets`` that holds one of ``queries``.

    Targets are listed under each of their paths.  A query looks up only its rarest path; what it
    finds there must hold all its paths before the matcher sees it.  No pair is formed otherwise.
    Up to ``few`` queries are broadcast; targets never are.
    """
    queries, targets = stage(queries), stage(targets)
    rows = stage(path_features(targets))
    listed = rows.select("mol_id", F.explode("m_paths").alias("path"))
    count = listed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    asked = stage(path_features(queries))
    lay = F.broadcast if asked.count() <= few else _spread
    rarest = (
        asked.select("mol_id", F.size("m_paths").alias("_size"), F.explode("m_paths").alias("path")).join(count, "path")
        .groupBy("mol_id", "_size").agg(F.count(F.lit(1)).alias("_known"), F.min(F.struct("n", "path")).alias("_least"))
        .where("_known = _size")
    )
    pairs = listed.withColumnRenamed("mol_id", "target").join(
        lay(rarest.select(F.col("mol_id").alias("query"), F.col("_least.path").alias("path"))), "path").select("query", "target")
    held = (
        pairs.join(_spread(rows.select(F.col("mol_id").alias("target"), F.col("m_paths").alias("_t"))), "target")
        .join(lay(asked.select(F.col("mol_id").alias("query"), F.col("m_paths").alias("_q"))), "query")
        .where(F.size(F.array_except("_q", "_t")) == 0).select("query", "target")
    )
    joined = held.join(_spread(_side("t", match_form(targets))), F.col("target") == F.col("t_mol_id")).join(
        lay(_side("q", match_form(queries))), F.col("query") == F.col("q_mol_id"))
    return _matched(joined, "query", "target").where("found = 1").select("query", "target")
