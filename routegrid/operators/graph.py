"""Molecule text to relational graph tables.

``molecules(mol_id, smiles)`` is hashed on ``mol_id`` while it is still one short row per
molecule.  Tokens, atoms, bonds and the nested ``graph`` table all keep that layout, so the
whole chain costs one shuffle of the input text.
"""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import ELEMENTS
from ..functions.cycles import ring_lists
from ..functions.rows import let

TOKEN = r"(\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9]{2}|[0-9]|[()=#:/\\.$~-])"
BRACKET = (
    r"^\[[0-9]*(se|as|[bcnops]|[A-Z][a-z]?)(@*)(H[0-9]*)?([+-][0-9]*|[+]+|-+)?(:[0-9]+)?\]$"
)
BOND_SYMBOLS = ["-", "=", "#", "$", ":", "/", "\\", "~"]
ATOM_TYPE = (
    "struct<idx:int,el:string,arom:boolean,charge:int,h:int,comp:int,"
    "nbrs:array<struct<n:int,ord:int>>>"
)


def tokenize(molecules: DataFrame) -> DataFrame:
    """B1: (mol_id, covered, pos, tok); a text without tokens keeps one row with NULL."""
    toks = _tokens(F.col("smiles"))
    # The partition number is explicit because the texts are small but the work per byte is
    # not: AQE would merge them by size into a few tasks.
    n = int(molecules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        molecules.select("mol_id", "smiles")
        .repartition(n, "mol_id")
        .select("mol_id", "smiles", toks.alias("toks"))
        .select(
            "mol_id", "toks",
            F.coalesce(F.array_join("toks", "") == F.col("smiles"), F.lit(False)).alias("covered"),
        )
        .select("mol_id", "covered", F.posexplode_outer("toks").alias("pos", "tok"))
    )


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def _ring_digits(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike("^[0-9%]"))


def spoils_any(text: Column) -> Column:
    """Whether an unreadable text makes every dot-joined text that it is a part of unreadable.

    So it is with signs that are no tokens, and with a text that neither opens nor closes a ring or
    a branch of another part: it is read there as it is alone.  A first or last dot, or a bond
    ahead of the first atom, counts only at the ends of a text, so these are left open.
    """
    def own(toks: Column) -> Column:
        depth = F.aggregate(toks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda s, t: let(
            s["now"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0),
            lambda d: F.struct(d.alias("now"), F.least(s["low"], d).alias("low"))))
        closed = let(depth, lambda d: (d["now"] == 0) & (d["low"] == 0))
        ends = F.get(toks, F.lit(0)).rlike(r"^[\[A-Za-z]") & (F.element_at(toks, -1) != ".")
        return (F.array_join(toks, "") != text) | F.when(F.size(toks) > 0, ends & (F.size(_ring_digits(toks)) == 0) & closed)

    return F.coalesce(let(_tokens(text), own), F.lit(False))


def closes(text: Column) -> Column:
    """Whether a text has as many branch ends as starts and every ring digit an even number of times, as readable ones do."""
    def paired(toks: Column) -> Column:
        labels = F.transform(_ring_digits(toks), lambda t: F.regexp_replace(t, "%", "").cast("int"))
        return (F.size(F.filter(toks, lambda t: t == "(")) == F.size(F.filter(toks, lambda t: t == ")"))) & let(
            labels, lambda all_: F.forall(F.array_distinct(all_), lambda x: F.size(F.filter(all_, lambda o: o == x)) % 2 == 0))

    return F.coalesce(let(_tokens(text), paired), F.lit(False))


def _order(sym: Column) -> Column:
    return F.when(sym == "=", 2).when(sym == "#", 3).when(sym == "$", 4).otherwise(1)


def scan_tokens(tokens: DataFrame) -> DataFrame:
    """Every token with its depth, atom number, component, partner atom and order.

    A branch is followed with a running depth; the parent of an atom is the latest earlier
    atom at its level (an as-of lookup done as a running ``last``), and the two ends of a
    ring digit are neighbours in the (molecule, digit) order.
    """
    by_pos = Window.partitionBy("mol_id").orderBy("pos")
    upto = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    tok = F.col("tok")
    is_bond = tok.isin(BOND_SYMBOLS)
    is_atom = tok.rlike(r"^[\[A-Za-z]")
    is_digit = tok.rlike("^[0-9%]")
    base = (
        tokens.withColumn("is_atom", F.coalesce(is_atom, F.lit(False)))
        .withColumn("is_digit", F.coalesce(is_digit, F.lit(False)))
        .withColumn(
            "depth", F.sum(F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)).over(upto)
        )
        .withColumn("idx", (F.sum(F.col("is_atom").cast("int")).over(upto) - 1).cast("int"))
        .withColumn("comp", F.sum((tok == ".").cast("int")).over(upto).cast("int"))
        .withColumn("prev", F.lag("tok").over(by_pos))
        .withColumn("next", F.lead("tok").over(by_pos))
        .withColumn("anchor", F.last(F.when(~is_bond, tok), ignorenulls=True).over(before))
    )
    # One level per branch depth for atoms and '(' (which looks one level up), one per digit.
    level = (
        F.when(F.col("is_digit"), 100000 + F.regexp_replace("tok", "%", "").cast("int"))
        .when(F.col("is_atom"), F.col("depth"))
        .when(tok == "(", F.col("depth") - 1)
        .otherwise(-1)
    )
    by_level = Window.partitionBy("mol_id", "level").orderBy("pos")
    level_before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        base.withColumn("level", level)
        .withColumn(
            "up", F.last(F.when(F.col("is_atom"), F.col("idx")), ignorenulls=True).over(level_before)
        )
        .withColumn("nth", F.row_number().over(by_level))
        .withColumn("mate", F.lag("idx").over(by_level))
        .withColumn("mate_prev", F.lag("prev").over(by_level))
        .withColumn("open_end", F.lead("idx").over(by_level).isNull() & (F.col("nth") % 2 == 1))
    )
    branch = F.last(F.when(tok == "(", F.col("up")), ignorenulls=True).over(before)
    closes = F.col("is_digit") & (F.col("nth") % 2 == 0)
    linked = (
        leveled.withColumn("branch", branch)
        .withColumn(
            "partner",
            F.when(closes, F.col("mate"))
            .when(
                F.col("is_atom") & F.col("anchor").isNotNull() & (F.col("anchor") != "."),
                F.when(F.col("anchor") == "(", F.col("branch")).otherwise(F.col("up")),
            ),
        )
        .withColumn(
            "ord",
            F.when(closes, F.greatest(_order(F.col("prev")), _order(F.col("mate_prev"))))
            .when(F.col("partner").isNotNull(), _order(F.col("prev"))),
        )
    )
    nxt, prv = F.col("next"), F.col("prev")
    bad = (
        (is_bond & (nxt.isNull() | nxt.isin(BOND_SYMBOLS + ["(", ")", "."])))
        | ((F.col("pos") == 0) & ~F.col("is_atom"))
        | ((tok == "(") & (nxt.isNull() | (nxt == ")") | prv.isin(BOND_SYMBOLS + ["(", "."])))
        | ((tok == ".") & (nxt.isNull() | prv.isin(["("])))
        | (F.col("is_digit") & (F.col("open_end") | prv.isin(["(", "."])))
        | (closes & (F.col("mate") == F.col("idx")))
        | (F.col("depth") < 0)
        | (nxt.isNull() & (F.col("depth") != 0))
        | (tok.startswith("[") & ~tok.rlike(BRACKET))
    )
    return linked.withColumn("bad", F.coalesce(bad, F.lit(False)) | ~F.col("covered"))


def _atom_props() -> Column:
    """Element, aromatic flag, charge, written hydrogens of an atom token."""
    tok = F.col("tok")
    bracket = tok.startswith("[")
    symbol = F.when(bracket, F.regexp_extract(tok, BRACKET, 1)).otherwise(tok)
    h = F.regexp_extract(tok, BRACKET, 3)
    sign = F.regexp_extract(tok, BRACKET, 4)
    digits = F.regexp_extract(sign, "([0-9]+)", 1)
    size = F.when(digits != "", digits.cast("int")).otherwise(F.length(sign))
    charge = F.when(sign.startswith("-"), -size).otherwise(size)
    written = F.when(h == "", 0).when(h == "H", 1).otherwise(F.substring(h, 2, 9).cast("int"))
    return F.struct(
        # initcap was a tenth of the samples of a run
        F.concat(F.translate(F.substring(symbol, 1, 1), ascii_lowercase, ascii_uppercase), F.substring(symbol, 2, 9)).alias("el"),
        (symbol == F.lower(symbol)).alias("arom"),
        F.when(bracket, charge).otherwise(0).alias("charge"),
        F.when(bracket, written).alias("written"),
        F.col("comp").alias("comp"),
    )


def _lowest(el: Column) -> Column:
    return F.create_map(*[F.lit(x) for e, (v, _, _) in ELEMENTS.items() for x in (e, v)])[el]


def implicit_h(el: Column, arom: Column, order_sum: Column) -> Column:
    """Hydrogens an organic-subset atom carries beside its written bonds."""
    ladder = (
        F.when(el.isin("P", "N") & (order_sum > 3), 5)
        .when((el == "S") & (order_sum > 4), 6)
        .when((el == "S") & (order_sum > 2), 4)
        .otherwise(_lowest(el))
    )
    plain = F.greatest(ladder - order_sum, F.lit(0))
    ring = F.greatest(_lowest(el) - order_sum - 1, F.lit(0))
    return F.when(arom, ring).otherwise(plain)


def valence_limit(el: Column, charge: Column) -> Column:
    return (
        F.when(el == "C", 4 - F.abs(charge))
        .when(el == "N", F.when(charge == 0, 5).otherwise(3 + charge))
        .when(el == "O", 2 + charge)
        .when(el == "B", 3 - charge)
        .when(el.isin("F", "Cl", "Br", "I", "H"), 1 + F.abs(charge))
        .when(el == "P", 5 + F.abs(charge))
        .when(el == "S", 6)
        .otherwise(8)
    )


def atoms(tokens: DataFrame) -> DataFrame:
    """One row per atom with its neighbour list; ``idx`` -1 carries only flags.

    Each token emits its atom and the two directions of its bond, so adjacency needs no
    join: grouping by (molecule, atom) gathers both.
    """
    item = "struct<idx:int,props:struct<el:string,arom:boolean,charge:int,written:int,comp:int>,link:struct<n:int,ord:int>>"
    me, mate = F.col("idx"), F.col("partner")

    def half(at: Column, to: Column) -> Column:
        return F.struct(
            at.alias("idx"), F.lit(None).alias("props"),
            F.struct(to.alias("n"), F.col("ord").alias("ord")).alias("link"),
        ).cast(item)

    atom = F.struct(
        me.alias("idx"), F.when(F.col("is_atom"), _atom_props()).alias("props"),
        F.lit(None).alias("link"),
    ).cast(item)
    records = F.when(
        mate.isNotNull(), F.array(atom, half(me, mate), half(mate, me))
    ).otherwise(F.array(atom))
    rows = scan_tokens(tokens).select("mol_id", "bad", F.explode(records).alias("r"))
    grouped = (
        rows.groupBy("mol_id", F.col("r.idx").alias("idx"))
        .agg(
            F.max("r.props").alias("p"),
            F.sort_array(F.collect_list("r.link")).alias("nbrs"),
            F.coalesce(F.sum("r.link.ord"), F.lit(0)).cast("int").alias("order_sum"),
            F.max("bad").alias("bad"),
        )
    )
    el, arom = F.col("p.el"), F.col("p.arom")
    h = F.coalesce(F.col("p.written"), implicit_h(el, arom, F.col("order_sum")))
    total = F.col("order_sum") + F.coalesce(F.col("p.written"), F.lit(0))
    doubled = F.size(F.array_distinct(F.transform("nbrs", lambda x: x["n"]))) < F.size("nbrs")
    return grouped.select(
        "mol_id", "idx", el.alias("el"), arom.alias("arom"), F.col("p.charge").alias("charge"),
        h.cast("int").alias("h"), F.col("p.comp").alias("comp"), "nbrs", "order_sum",
        (F.col("bad") | F.coalesce((total > valence_limit(el, F.col("p.charge"))) | doubled, F.lit(False))).alias("bad"),
    )


def graph(molecules: DataFrame) -> DataFrame:
    """One row per molecule: ``mol_id, valid, atoms[], edges[]``.

    The position in ``atoms`` is the atom number; ``edges`` lists bond ends [a0, b0, ...].

    The empty text is a valid molecule without atoms.
    """
    rows = atoms(tokenize(molecules))
    entry = F.when(
        F.col("el").isNotNull(),
        F.struct("idx", "el", "arom", "charge", "h", "comp", "nbrs"),
    )
    ends = F.transform(
        F.filter("nbrs", lambda x: x["n"] > F.col("idx")), lambda x: F.array(F.col("idx"), x["n"])
    )
    return (
        rows.groupBy("mol_id")
        .agg(
            (~F.max("bad")).alias("valid"),
            F.sort_array(F.collect_list(entry)).alias("atoms"),
            F.flatten(F.flatten(F.collect_list(ends))).alias("edges"),
        )
        .withColumn("atoms", let(F.col("atoms"), fold_hydrogens))
    )


def fold_hydrogens(at: Column) -> Column:
    """Written ``[H]`` atoms join the hydrogen count of their neighbour.

    Atom numbers stay; a folded atom keeps its place with an empty element and no bonds.
    """

    def element(i: Column) -> Column:
        return F.get(at, i)["el"]

    def one(a: Column) -> Column:
        extra = F.size(F.filter(a["nbrs"], lambda x: element(x["n"]) == "H"))
        gone = (a["el"] == "H") & F.exists(a["nbrs"], lambda x: element(x["n"]) != "H")
        kept = F.filter(a["nbrs"], lambda x: element(x["n"]) != "H")
        none = F.filter(a["nbrs"], lambda x: F.lit(False))
        plain = F.when(
            a["el"] == "H", F.when(gone, a.withField("el", F.lit("")).withField("nbrs", none)).otherwise(a)
        ).otherwise(a.withField("h", a["h"] + extra).withField("nbrs", kept))
        return plain

    return F.when(F.exists(at, lambda a: a["el"] == "H"), F.transform(at, one)).otherwise(at)


def atom_table(g: DataFrame) -> DataFrame:
    """B2 in long form, valid molecules only."""
    return (
        g.where("valid").select("mol_id", F.explode("atoms").alias("a"))
        .select("mol_id", "a.*").where("el <> ''")
    )


def adjacency(g: DataFrame) -> DataFrame:
    """Both directions of every bond."""
    return atom_table(g).select(
        "mol_id", F.col("idx").alias("a"), F.explode("nbrs").alias("x")
    ).select("mol_id", "a", F.col("x.n").alias("b"), F.col("x.ord").alias("ord"))


def bonds(g: DataFrame) -> DataFrame:
    """One row per bond, lower atom first."""
    return adjacency(g).where("a < b")


def components(g: DataFrame) -> DataFrame:
    """Number of dot-separated fragments."""
    return g.where("valid").select("mol_id", n_components().alias("n_components"))


def n_components() -> Column:
    return F.when(F.size("atoms") == 0, 0).otherwise(
        F.array_max(F.transform("atoms", lambda a: a["comp"])) + 1
    )


def n_bonds() -> Column:
    """Bonds of a graph row."""
    ends = F.aggregate("atoms", F.lit(0), lambda s, a: s + F.size(a["nbrs"]))
    return (ends / 2).cast("int")


def ring_count() -> Column:
    heavy = F.size(F.filter("atoms", lambda a: a["el"] != ""))
    return n_bonds() - heavy + n_components()


def with_rings(g: DataFrame) -> DataFrame:
    """``rings`` column, one atom list per ring.

    Only the bond ends of molecules that have a ring are sent to Python; for the rest the
    call gets a NULL and gives an empty list.
    """
    ringed = F.col("valid") & (ring_count() > 0)
    return g.withColumn("rings", ring_lists(F.when(ringed, F.col("edges")))).drop("edges")


def ring_table(g: DataFrame) -> DataFrame:
    """B8 in long form: (mol_id, ring_id, size, place, idx)."""
    return (
        g.select("mol_id", F.posexplode("rings").alias("ring_id", "ring"))
        .select("mol_id", "ring_id", F.size("ring").alias("size"),
                F.posexplode("ring").alias("place", "idx"))
    )


def mark_kekule(g: DataFrame) -> DataFrame:
    """Rings of 5 or 6 atoms written with alternating double bonds become aromatic.

    Approximation: a 6-ring where every atom has exactly one double bond, or a 5-ring with
    two double bonds whose fifth atom is N, O or S without one; at least four atoms must have
    their double bond inside the ring.  A double bond to an atom outside every ring, or a
    triple bond, blocks the ring.
    """

    def run(at: Column) -> Column:
        def doubles(i: Column) -> Column:
            return F.filter(F.get(at, i)["nbrs"], lambda x: x["ord"] == 2)

        def pi(i: Column) -> Column:
            return F.get(at, i)["arom"] | (F.size(doubles(i)) == 1)

        def flat_rings(members: Column) -> Column:
            def blocked(i: Column) -> Column:
                return F.exists(
                    F.get(at, i)["nbrs"],
                    lambda x: (x["ord"] > 2) | ((x["ord"] == 2) & ~F.array_contains(members, x["n"])),
                )

            def flat(ring: Column) -> Column:
                donors = F.filter(ring, lambda i: ~pi(i))
                inside = F.filter(
                    ring,
                    lambda i: F.get(at, i)["arom"]
                    | F.exists(doubles(i), lambda x: F.array_contains(ring, x["n"])),
                )
                six = (F.size(ring) == 6) & (F.size(donors) == 0)
                five = (F.size(ring) == 5) & (F.size(donors) == 1) & F.forall(
                    donors, lambda i: F.get(at, i)["el"].isin("N", "O", "S")
                )
                return (six | five) & (F.size(inside) >= 4) & ~F.exists(ring, blocked)

            return F.flatten(F.filter("rings", flat))

        def apply(marked: Column) -> Column:
            return F.transform(
                at,
                lambda a: a.withField("arom", a["arom"] | F.array_contains(marked, a["idx"])),
            )

        return let(let(F.flatten("rings"), flat_rings), apply)

    return g.withColumn("atoms", F.when(F.size("rings") > 0, let(F.col("atoms"), run)).otherwise(F.col("atoms")))


def structures(molecules: DataFrame) -> DataFrame:
    """``mol_id, valid, atoms, rings``: the input of every molecule-level check."""
    return mark_kekule(with_rings(graph(molecules)))
