"""Reactant text against product text.

Each distinct text is analysed once (`text_features`); a pair then needs two joins and a
projection.  Joins are on the text, where a popular reactant may hold a large share of the
rows: the feature side is unique per text, so AQE may split such a partition freely.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import GROUP_NAMES, SCORE_MESSAGES
from ..functions.rows import count_if, let, total
from ..plans.staging import stage
from .graph import closes, n_bonds, n_components, spoils_any, structures
from .molecule import environment_hashes, heavy


def text_structures(texts: DataFrame) -> DataFrame:
    """Structures of the distinct values of ``smiles``; ``mol_id`` is the md5 of the text.

    The distinct texts are written first: they are few next to the rows they come from, and
    later stages then start from them instead of from the fact table.
    """
    unique = stage(texts.select("smiles").where("smiles IS NOT NULL").distinct())
    return structures(unique.select(F.md5("smiles").alias("mol_id"), "smiles"))


def ring_systems(s: DataFrame) -> DataFrame:
    """One row per ring, with the molecule's atoms kept for the checks below."""
    rows = s.where("valid").select("mol_id", "atoms", F.posexplode("rings").alias("ring_id", "ring"))
    return rows.select(
        "mol_id", "ring_id", "ring", F.size("ring").alias("size"),
        let(F.col("atoms"), lambda at: F.forall("ring", lambda i: F.get(at, i)["arom"])).alias("is_aromatic"),
        "atoms",
    )


def connected_atoms(at: Column, start: Column, exclude: Column) -> Column:
    """Atoms reached from ``start`` without entering ``exclude``, breadth first."""

    def grow(s: Column, _: Column) -> Column:
        near = F.flatten(F.transform(
            s["front"], lambda i: F.transform(F.get(at, i)["nbrs"], lambda x: x["n"])))
        fresh = F.array_except(F.array_distinct(near), F.concat(s["seen"], exclude))
        step = let(fresh, lambda n: F.struct(F.concat(s["seen"], n).alias("seen"), n.alias("front")))
        return F.when(F.size(s["front"]) == 0, s).otherwise(step)

    first = F.struct(F.array(start).alias("seen"), F.array(start).alias("front"))
    return F.aggregate(F.sequence(F.lit(1), F.size(at)), first, grow)["seen"]


def ring_position(at: Column, ring: Column, attach: Column) -> Column:
    """Name of the nearest other substituted atom of a 6-ring; "1" otherwise."""

    def branched(i: Column) -> Column:
        return F.exists(F.get(at, i)["nbrs"], lambda x: ~F.array_contains(ring, x["n"]))

    size = F.size(ring)

    def distance(i: Column) -> Column:
        apart = F.abs(F.array_position(ring, i) - F.array_position(ring, attach)).cast("int")
        return F.least(apart, size - apart)

    others = F.filter(ring, lambda i: (i != attach) & branched(i))
    nearest = F.array_min(F.transform(others, distance))
    return (
        F.when(size != 6, "1").when(nearest == 1, "ortho").when(nearest == 2, "meta")
        .when(nearest == 3, "para").otherwise("1")
    )


def signature(at: Column, members: Column) -> Column:
    """Sorted element counts, e.g. ``C1.O1``."""
    names = F.transform(members, lambda i: F.get(at, i)["el"])
    return let(names, lambda els: F.array_join(F.array_sort(F.transform(
        F.array_distinct(els),
        lambda e: F.concat(e, count_if(els, lambda o: o == e).cast("string")))), "."))


def friendly_name(sig: Column) -> Column:
    """D10."""
    names = F.create_map(*[F.lit(x) for pair in GROUP_NAMES for x in pair])
    return F.coalesce(names[sig], F.concat(F.lit("Group ("), sig, F.lit(")")))


def _substituents(at: Column, ring: Column) -> Column:
    def of_atom(i: Column) -> Column:
        outside = F.filter(F.get(at, i)["nbrs"], lambda x: ~F.array_contains(ring, x["n"]))
        return F.transform(
            outside,
            lambda x: F.struct(
                i.alias("attach"), x["n"].alias("first"),
                connected_atoms(at, x["n"], ring).alias("members"),
                ring_position(at, ring, i).alias("position"),
            ),
        )

    return F.flatten(F.transform(ring, of_atom))


def substituents(s: DataFrame) -> DataFrame:
    """One row per substituent: ring, attachment, first atom, members, position, names."""
    rows = ring_systems(s).select(
        "mol_id", "ring_id", "size", "is_aromatic", "atoms",
        F.explode(let(F.col("atoms"), lambda at: _substituents(at, F.col("ring")))).alias("sub"),
    )
    return rows.select(
        "mol_id", "ring_id", "size", "is_aromatic", "sub.attach", "sub.first",
        F.array_sort("sub.members").alias("members"), "sub.position",
        let(F.col("atoms"), lambda at: signature(at, F.col("sub.members"))).alias("signature"),
    )


def _ring_groups(at: Column, rings: Column) -> Column:
    """Aromatic rings of a row: (size, nth of that size, signature, sorted positions)."""
    aromatic = F.filter(rings, lambda r: F.forall(r, lambda i: F.get(at, i)["arom"]))

    def shaped(list_: Column) -> Column:
        def one(r: Column, pos: Column) -> Column:
            nth = count_if(F.slice(list_, 1, pos + 1), lambda q: F.size(q) == F.size(r))
            named = F.transform(
                _substituents(at, r),
                lambda x: F.struct(
                    signature(at, x["members"]).alias("sig"),
                    F.when(x["position"] == "1", "position 1").otherwise(x["position"]).alias("at"),
                ),
            )
            return let(named, lambda subs: F.transform(
                F.array_distinct(F.transform(subs, lambda x: x["sig"])),
                lambda g: F.struct(
                    F.size(r).alias("size"), nth.alias("nth"), g.alias("sig"),
                    F.array_sort(F.transform(F.filter(subs, lambda x: x["sig"] == g), lambda x: x["at"])).alias("at"),
                )))

        return F.flatten(F.transform(list_, one))

    return let(aromatic, shaped)


def _ring_marks(at: Column, rings: Column) -> Column:
    """Aromatic rings of a row: (size, places of substituents, one entry per bond leaving)."""

    def places(r: Column) -> Column:
        return F.flatten(F.transform(r, lambda i, p: F.transform(
            F.filter(F.get(at, i)["nbrs"], lambda x: ~F.array_contains(r, x["n"])),
            lambda _: p.cast("int"))))

    return F.transform(
        F.filter(rings, lambda r: F.forall(r, lambda i: F.get(at, i)["arom"])),
        lambda r: F.struct(F.size(r).alias("size"), places(r).alias("places")),
    )


def _element_counts(at: Column) -> Column:
    names = F.transform(heavy(at), lambda a: a["el"])
    return let(names, lambda els: F.map_from_entries(F.transform(
        F.array_distinct(els), lambda e: F.struct(e.alias("k"), count_if(els, lambda o: o == e).alias("n")))))


def text_features(s: DataFrame) -> DataFrame:
    """Everything a pair comparison needs, once per molecule."""
    at, rings = F.col("atoms"), F.col("rings")
    hashed = environment_hashes(s, 1)
    return hashed.select(
        "mol_id",
        let(at, _element_counts).alias("els"),
        F.transform(rings, lambda r: F.size(r)).alias("ring_sizes"),
        count_if(at, lambda a: a["arom"]).alias("n_arom"),
        n_bonds().alias("n_bonds"),
        n_components().alias("n_frag"),
        let(at, lambda a: _ring_groups(a, rings)).alias("groups"),
        let(at, lambda a: _ring_marks(a, rings)).alias("marks"),
        "envs",
    )


_FEATURES = ["els", "ring_sizes", "n_arom", "n_bonds", "n_frag", "groups", "marks", "envs"]
_SCORED = ["els", "ring_sizes", "n_arom", "n_bonds", "groups"]


def compare_table(pairs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """``pairs(pair_id, reactant, product)`` with features of both sides (r_*, p_*)."""
    if features is None:
        both = pairs.select(F.explode(F.array("reactant", "product")).alias("smiles"))
        # written once: both joins below read it, and a text is never analysed twice
        features = stage(text_features(text_structures(both)))

    def side(tag: str) -> DataFrame:
        return features.select(
            F.col("mol_id").alias(f"{tag}_key"), *[F.col(c).alias(f"{tag}_{c}") for c in _FEATURES])

    keyed = pairs.withColumn("r_key", F.md5("reactant")).withColumn("p_key", F.md5("product"))
    return (
        keyed.join(side("r"), "r_key", "left").join(side("p"), "p_key", "left")
        .drop("r_key", "p_key")
        .withColumn("both_valid", F.col("r_els").isNotNull() & F.col("p_els").isNotNull())
    )


def _sum_entries(parts: Column) -> Column:
    entries = F.flatten(F.transform(parts, lambda p: p["els"]))
    return let(entries, lambda all_: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(all_, lambda e: e["key"])),
        lambda k: F.struct(k, total(F.filter(all_, lambda e: e["key"] == k), lambda e: e["value"])))))


def _joined_features(parts: Column, columns: Sequence[str]) -> Column:
    """Features of dot-joined molecules from the features of each."""

    def groups(p: Column, i: Column) -> Column:
        def earlier(size: Column) -> Column:
            return total(F.slice(parts, 1, i), lambda q: count_if(q["arom_sizes"], lambda z: z == size))

        return F.transform(p["groups"], lambda g: g.withField("nth", g["nth"] + earlier(g["size"])))

    def joined(c: str) -> Column:
        if c == "els":
            return _sum_entries(parts)
        if c in ("n_arom", "n_bonds", "n_frag"):
            return total(parts, lambda p: p[c])
        return F.flatten(F.transform(parts, groups if c == "groups" else lambda p: p[c]))

    return F.struct(*[joined(c).alias(c) for c in columns])


def pathway_table(
    pathways: DataFrame, features: DataFrame | None = None, key: Sequence[str] = ("target", "rank"), columns: Sequence[str] = _FEATURES
) -> DataFrame:
    """`compare_table` for ``pathways(target, rank, reactants)``: dot-joined reactants
    against the target.

    Molecules are analysed one by one and their features added up, so a molecule used by
    many pathways costs once.  Only where a reactant cannot be read alone (its ring digits
    may close in another one) is the joined text analysed as a whole, unless a part spoils it
    or a ring or branch stays open.  ``key`` names the
    columns that tell pathways apart, ``columns`` the features that are read later: every
    line of a pathway carries those, and no others, to its pathway.
    """
    key = [*key, *[c for c in ["target"] if c not in key]]
    parts = pathways.select(*key, F.posexplode("reactants").alias("place", "smiles"))
    if features is None:
        texts = parts.select("smiles").union(pathways.select("target"))
        features = stage(text_features(text_structures(texts)).select("mol_id", *dict.fromkeys([*columns, "marks"])))
    part = F.struct(
        "place", "smiles", F.map_entries("els").alias("els"), F.transform("marks", lambda m: m["size"]).alias("arom_sizes"),
        *[c for c in columns if c != "els"])
    gathered = (
        parts.withColumn("mol_id", F.md5("smiles")).join(features, "mol_id", "left")
        .groupBy(*key).agg(
            F.array_sort(F.collect_list(part)).alias("parts"), F.min(F.col("els").isNotNull()).alias("readable"),
            F.max(F.when(F.col("els").isNull(), spoils_any(F.col("smiles"))).otherwise(False)).alias("spoiled"))
    )
    added = let(F.when(F.col("readable"), F.col("parts")), lambda p: F.when(p.isNotNull(), _joined_features(p, columns)))
    gathered = stage(gathered.select(
        *key, "readable", "spoiled", F.array_join(F.transform("parts", lambda p: p["smiles"]), ".").alias("reactant"), added.alias("a_f")))
    open_ones = gathered.where("NOT readable AND NOT spoiled").where(closes(F.col("reactant")))
    whole = text_features(text_structures(open_ones.select(F.col("reactant").alias("smiles"))))

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col("mol_id").alias(f"{tag}_key"), F.struct(*columns).alias(f"{tag}_f"))

    rows = (
        gathered.withColumn("w_key", F.when(~F.col("readable"), F.md5("reactant")))
        .withColumn("p_key", F.md5("target"))
        .join(side(whole, "w"), "w_key", "left").join(side(features, "p"), "p_key", "left")
        .withColumn("r_f", F.when(F.col("readable"), F.col("a_f")).otherwise(F.col("w_f")))
    )
    return rows.select(
        *key, "reactant", F.col("target").alias("product"),
        *[F.col(f"{t}_f.{c}").alias(f"{t}_{c}") for t in ("r", "p") for c in columns],
        (F.col("r_f.els").isNotNull() & F.col("p_f.els").isNotNull()).alias("both_valid"),
    )


def atom_diffs() -> Column:
    """D1 per pair: elements whose counts differ."""
    all_els = F.array_union(F.map_keys("r_els"), F.map_keys("p_els"))
    counts = F.transform(
        all_els,
        lambda e: F.struct(
            e.alias("el"), F.coalesce(F.col("r_els")[e], F.lit(0)).alias("n_reactant"),
            F.coalesce(F.col("p_els")[e], F.lit(0)).alias("n_product"),
        ),
    )
    return F.filter(counts, lambda c: c["n_reactant"] != c["n_product"])


def ring_diffs() -> Column:
    """D2 per pair: (size, change, entries); one entry per ring on the richer side."""

    def changes(mine: str, other: str, word: str) -> Column:
        return F.transform(
            F.filter(
                F.array_distinct(mine),
                lambda z: count_if(F.col(mine), lambda o: o == z) > count_if(F.col(other), lambda o: o == z),
            ),
            lambda z: F.struct(
                z.alias("size"), F.lit(word).alias("change"),
                count_if(F.col(mine), lambda o: o == z).alias("entries"),
            ),
        )

    return F.concat(
        changes("r_ring_sizes", "p_ring_sizes", "removed"),
        changes("p_ring_sizes", "r_ring_sizes", "added"),
    )


def moves() -> Column:
    """D11 per pair: substituents whose positions on the matched ring differ."""
    found = F.flatten(F.transform(
        "r_groups",
        lambda r: F.transform(
            F.filter(
                "p_groups",
                lambda p: (p["size"] == r["size"]) & (p["nth"] == r["nth"])
                & (p["sig"] == r["sig"]) & (p["at"] != r["at"]),
            ),
            lambda p: F.struct(
                r["size"].alias("size"), r["nth"].alias("nth"), friendly_name(r["sig"]).alias("substituent"),
                r["at"].alias("from_positions"), p["at"].alias("to_positions"),
            ),
        ),
    ))
    same_count = F.size("r_ring_sizes") == F.size("p_ring_sizes")
    return F.when(same_count, found).otherwise(F.filter(found, lambda _: F.lit(False)))


def severity(score: Column) -> Column:
    """Band of a score."""
    return (
        F.when(score >= 80, "low").when(score >= 40, "medium").when(score >= 20, "high")
        .otherwise("critical")
    )


def score_message(score: Column) -> Column:
    """Text of a score; an invalid pair is worded by the caller."""
    out = F.when(score >= SCORE_MESSAGES[0][0], SCORE_MESSAGES[0][1])
    for low, text in SCORE_MESSAGES[1:]:
        out = out.when(score >= low, text)
    return out.otherwise(SCORE_MESSAGES[-1][1])


def consistency_scores(table: DataFrame) -> DataFrame:
    """D12 and D13 on a `compare_table`."""
    worst = F.array_max(F.transform(
        atom_diffs(), lambda c: F.least(5 * F.abs(c["n_reactant"] - c["n_product"]), F.lit(100))))
    entries = F.aggregate(ring_diffs(), F.lit(0), lambda s, c: s + c["entries"])
    extra = F.col("p_n_bonds") - F.col("r_n_bonds")
    raw = (
        100 - F.coalesce(worst, F.lit(0)) - F.least(25 * entries, F.lit(50))
        - F.least(60 * F.size(moves()), F.lit(100))
        - F.when(F.abs(F.col("r_n_arom") - F.col("p_n_arom")) > 2, 40).otherwise(0)
        - F.when(extra > 0, F.least(5 * extra, F.lit(30))).otherwise(0)
    )
    scored = table.withColumn(
        "score", F.when(F.col("both_valid"), F.greatest(raw, F.lit(0))).otherwise(0).cast("int"))
    return scored.withColumn("severity", F.when(F.col("both_valid"), severity(F.col("score"))).otherwise("critical")).withColumn(
        "message",
        F.when(F.col("both_valid"), score_message(F.col("score")))
        .otherwise("Invalid SMILES string detected - cannot assess transformation"),
    )


def consistency_filter(pathways: DataFrame, key: Sequence[str]) -> DataFrame:
    """``pathways(target, rank, reactants)``; keeps those scored low or medium risk.

    Scores are written before they are filtered: Catalyst would move the filter below the
    projections and evaluate them anew for every mention of the score in it.
    """
    key = list(key)
    pathways = stage(pathways)
    bands = stage(consistency_scores(pathway_table(pathways, key=key, columns=_SCORED)).select(*key, "severity"))
    kept = bands.where(F.col("severity").isin("low", "medium"))
    return pathways.join(kept.select(*key), key, "left_semi")


def position_pairs(table: DataFrame) -> DataFrame:
    """Ring pairs of equal size and substituent count whose first two places differ
    in distance."""

    def gap(m: Column) -> Column:
        d = F.abs(m["places"][0] - m["places"][1])
        return F.least(d, m["size"] - d)

    def word(r: Column, p: Column) -> Column:
        low, high = F.least(gap(r), gap(p)), F.greatest(gap(r), gap(p))
        return (
            F.when((low == 1) & (high == 2), "Ortho <-> Meta position change detected")
            .when((low == 1) & (high == 3), "Ortho <-> Para position change detected")
            .when((low == 2) & (high == 3), "Meta <-> Para position change detected")
        )

    usable = lambda m: (m["size"] == 6) & (F.size(m["places"]) > 1)
    found = F.flatten(F.transform(
        F.filter("r_marks", usable),
        lambda r: F.transform(
            F.filter(F.filter("p_marks", usable), lambda p: F.size(p["places"]) == F.size(r["places"])),
            lambda p: word(r, p),
        ),
    ))
    return table.where("both_valid").select("pair_id", F.explode(found).alias("change")).where("change IS NOT NULL")


def shared_atoms() -> Column:
    """Size of the multiset intersection of the two sides' atom surroundings."""
    return F.aggregate(
        F.array_distinct("r_envs"), F.lit(0),
        lambda s, e: s + F.least(
            count_if(F.col("r_envs"), lambda o: o == e), count_if(F.col("p_envs"), lambda o: o == e)),
    )


def structure_consistency(table: DataFrame) -> DataFrame:
    """The first failing rule, or NULL."""
    nr, np_ = F.size("r_envs"), F.size("p_envs")
    issue = (
        F.when(~F.col("both_valid"), "Invalid SMILES notation")
        .when(
            F.size("r_ring_sizes") != F.size("p_ring_sizes"),
            F.concat(F.lit("Ring count changed from "), F.size("r_ring_sizes").cast("string"),
                     F.lit(" to "), F.size("p_ring_sizes").cast("string")),
        )
        .when(
            (F.col("_shared") * 10 < nr * 7) | (F.col("_shared") * 10 < np_ * 7),
            "Significant structural rearrangement detected",
        )
        .when(
            F.col("r_n_frag") != F.col("p_n_frag"),
            F.concat(F.lit("Fragment count changed from "), F.col("r_n_frag").cast("string"),
                     F.lit(" to "), F.col("p_n_frag").cast("string")),
        )
    )
    return table.withColumn("_shared", shared_atoms()).select(
        "pair_id", issue.isNull().alias("consistent"), issue.alias("issue"))


def changed_atoms(pairs: DataFrame) -> DataFrame:
    """Atoms whose surroundings (radius 1) have no counterpart on the other side.

    A bag difference both ways: with m copies here and n there, the last m-n copies in atom
    order are the changed ones.  ``attachments`` are their unchanged neighbours.
    """
    both = pairs.select(F.explode(F.array("reactant", "product")).alias("smiles"))
    s = environment_hashes(text_structures(both), 1)
    info = stage(s.select(F.col("mol_id"), F.transform(
        heavy(F.col("atoms")), lambda a: F.struct(
            a["idx"].alias("idx"), a["el"].alias("el"),
            F.transform(a["nbrs"], lambda x: x["n"]).alias("near"))).alias("info"), "envs"))

    def side(tag: str) -> DataFrame:
        return info.select(F.col("mol_id").alias(f"{tag}_key"), F.col("info").alias(f"{tag}_info"),
                           F.col("envs").alias(f"{tag}_envs"))

    rows = (
        pairs.select("pair_id", F.md5("reactant").alias("r_key"), F.md5("product").alias("p_key"))
        .join(side("r"), "r_key").join(side("p"), "p_key")
    )

    def changed(mine: str, other: str) -> Column:
        def lost(e: Column, pos: Column) -> Column:
            nth = count_if(F.slice(F.col(f"{mine}_envs"), 1, pos + 1), lambda o: o == e)
            return nth > count_if(F.col(f"{other}_envs"), lambda o: o == e)

        flags = F.transform(f"{mine}_envs", lost)
        marked = F.filter(
            F.arrays_zip(F.col(f"{mine}_info").alias("i"), flags.alias("lost")), lambda z: z["lost"])
        return let(marked, lambda hit: let(
            F.transform(hit, lambda z: z["i"]["idx"]),
            lambda ids: F.transform(hit, lambda z: F.struct(
                F.lit("reactant" if mine == "r" else "product").alias("side"),
                z["i"]["idx"].alias("idx"), z["i"]["el"].alias("el"),
                F.array_sort(F.array_except(z["i"]["near"], ids)).alias("attachments")))))

    return rows.select(
        "pair_id", F.explode(F.concat(changed("r", "p"), changed("p", "r"))).alias("c")
    ).select("pair_id", "c.*")
