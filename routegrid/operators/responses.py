"""Model answers: prompts out, candidate pathways in."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import CANDIDATES, as_list, split_for
from ..functions.rows import let
from ..functions.text import INVALID
from ..plans.staging import stage
from .compare import consistency_filter, text_structures
from .molecule import chemical_formula, contains, exact_mass, fingerprint, heavy, match_form
from .stability import stability_filter

MISSING_METADATA = 404


def split_answers(responses: DataFrame, families: DataFrame) -> DataFrame:
    """adds ``status, thinking, json`` by the model's answer family."""
    known = responses.join(families, "model", "left")
    return known.withColumn("_a", split_for(F.col("text"), F.col("family"))).select(
        *responses.columns, "_a.*")


def parse_candidates(answers: DataFrame) -> DataFrame:
    """adds ``parse_status`` (504 unless data, explanation and scores are there) and
    ``parsed``."""
    parsed = F.from_json("json", CANDIDATES)
    full = F.col("parsed.data").isNotNull() & F.col("parsed.explanation").isNotNull() & F.col(
        "parsed.confidence_scores").isNotNull()
    return answers.withColumn("parsed", parsed).withColumn(
        "parse_status", F.when(F.coalesce(full, F.lit(False)), 200).otherwise(504))


def candidate_rows(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per proposed pathway: rank, reactants, explanation, confidence."""
    return (
        parsed.where("parse_status = 200")
        .select(*keep, "parsed", F.posexplode("parsed.data").alias("rank", "item"))
        .select(
            *keep, "rank", as_list(F.col("item")).alias("reactants"),
            F.get(F.col("parsed.explanation"), F.col("rank")).alias("explanation"),
            F.get(F.col("parsed.confidence_scores"), F.col("rank")).alias("confidence"),
        )
    )


def validity_filter(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """``candidates(target, rank, reactants, ...)`` whose molecules are all readable, not
    the target itself and do not contain it.

    ``key`` names the columns that tell pathways apart, such as the answer's id and the rank.

    "The target itself" is equality of folded neighbourhood bits (radius 2, 1024 bits).
    """
    key = list(key)
    parts = candidates.select(*key, *[c for c in ["target"] if c not in key], F.posexplode("reactants").alias("place", "smiles"))
    parts = stage(parts)  # answers are parsed once for all that follows, bits are computed once for both joins
    s = stage(text_structures(parts.select("smiles").union(parts.select("target"))))
    prints = stage(fingerprint(s, 2, 1024).select("mol_id", F.array_join("bits", ",").alias("bits")))
    keyed = (
        parts.withColumn("part", F.md5("smiles")).withColumn("whole", F.md5("target"))
        .join(prints.select(F.col("mol_id").alias("part"), F.col("bits").alias("part_bits")), "part", "left")
        .join(prints.select(F.col("mol_id").alias("whole"), F.col("bits").alias("whole_bits")), "whole", "left")
    )
    links = keyed.where("part_bits IS NOT NULL").select("part", "whole").distinct().select(
        F.struct("part", "whole").alias("pair_id"), F.col("part").alias("target"), F.col("whole").alias("query"))
    inside = contains(links, match_form(s)).where("found = 1").select("pair_id.*").withColumn("_in", F.lit(True))
    judged = keyed.join(inside, ["part", "whole"], "left")
    fails = (
        F.col("part_bits").isNull() | F.coalesce(F.col("part_bits") == F.col("whole_bits"), F.lit(False))
        | F.col("_in").isNotNull()
    )
    bad = judged.where(fails).select(*key).distinct()
    return candidates.join(bad, key, "left_anti")


def first_good_attempt(
    responses: DataFrame, families: DataFrame, check_stability: bool = False, check_consistency: bool = False,
    attempts: int | None = None,
) -> DataFrame:
    """per target the surviving pathways of the first attempt that has any.

    ``responses(target, model, attempt, status_code, text)``; attempts count from 0.  The
    cheap checks run first; ``attempts`` limits how many are looked at (none: all); each pathway keeps its own explanation and confidence.
    """
    tried = responses.where("status_code = 200")
    if attempts is not None:
        tried = tried.where(F.col("attempt") < attempts)
    answers = split_answers(tried, families).where("status = 200")
    rows = candidate_rows(parse_candidates(answers), ["target", "model", "attempt"])
    rows = stage(rows.withColumn("rank", F.struct("attempt", "model", "rank")).drop("attempt", "model"))
    key = ["target", "rank"]  # two models may answer for one target
    kept = validity_filter(rows, key)
    if check_stability:
        kept = stability_filter(kept, key)
    if check_consistency:
        kept = consistency_filter(kept, key)
    kept = stage(kept)
    first = kept.groupBy("target").agg(F.min("rank.attempt").alias("attempt"))
    return (
        kept.join(first, "target").where("rank.attempt = attempt")
        .withColumn("rank", F.col("rank.rank"))
    )


def explain_status(df: DataFrame, codes: DataFrame, column: str = "status") -> DataFrame:
    """F8."""
    known = codes.withColumnRenamed("code", column)
    return df.join(known, column, "left").withColumn(
        "description", F.coalesce("description", F.lit("not recognized")))


def choose_prompt(requests: DataFrame, families: DataFrame, templates: DataFrame) -> DataFrame:
    """``templates(advanced, family, system, user, max_tokens)`` by model name.

    A name ending in ``:adv`` asks for the advanced form; such names are in no family list,
    so they use the tagged layout.
    """
    marked = requests.withColumn("advanced", F.coalesce(F.get(F.split("model", ":"), F.lit(1)) == "adv", F.lit(False)))
    named = marked.join(families, "model", "left").withColumn(
        "family", F.coalesce("family", F.lit("tagged")))
    return named.join(templates, ["advanced", "family"], "left")


def build_messages(prompts: DataFrame, seven_ring_note: str, group_note: str) -> DataFrame:
    """messages from ``target, system, user, family, has_ring, masked``.

    Notes are added for a 7-ring and for masked groups ({original} and {masked} are filled).
    """
    context = F.replace(F.replace(F.lit(group_note), F.lit("{original}"), F.col("target")), F.lit("{masked}"), F.col("masked"))
    has_groups = (F.col("masked") != F.col("target")) & (F.col("masked") != INVALID)
    add_on = F.concat(
        F.when(F.col("has_ring"), seven_ring_note).otherwise(""), F.when(has_groups, context).otherwise(""))
    user = F.concat("user", F.when(F.col("family") == "think", F.col("_add")).otherwise(""))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return prompts.withColumn("_add", add_on).withColumn(
        "messages",
        F.array(
            message("system", F.concat("system", "_add")),
            message("user", F.concat(F.replace(user, F.lit("{target_smiles}"), F.col("target")), F.lit("\n\n"), F.col("_add"))),
        ),
    ).drop("_add")


def parse_reagents(texts: DataFrame) -> DataFrame:
    """``texts(id, text)`` -> status and reagents with formula and mass; 404 without a
    readable one."""
    parsed = texts.withColumn("p", F.from_json("text", "data array<string>, explanation string"))
    listed = parsed.where("p.data IS NOT NULL AND p.explanation IS NOT NULL").select(
        "id", F.posexplode("p.data").alias("place", "smiles"))
    at = F.col("atoms")
    facts = text_structures(listed).where("valid").select(
        "mol_id", let(heavy(at), chemical_formula).alias("chemical_formula"),
        let(heavy(at), exact_mass).alias("mass"))
    found = (
        listed.withColumn("mol_id", F.md5("smiles")).join(facts, "mol_id")
        .groupBy("id").agg(F.array_sort(F.collect_list(
            F.struct("place", "smiles", "chemical_formula", "mass"))).alias("reagents"))
    )
    return texts.select("id").join(found, "id", "left").withColumn(
        "status", F.when(F.col("reagents").isNull(), MISSING_METADATA).otherwise(200))


def parse_conditions(text: Column) -> Column:
    """struct(status, temperature, pressure, solvent, time)."""
    names = ["temperature", "pressure", "solvent", "time"]
    got = F.from_json(text, ", ".join(f"`{n}` string" for n in names))

    def read(p: Column) -> Column:
        full = p.isNotNull()
        for n in names:
            full = full & p[n].isNotNull()
        full = F.coalesce(full, F.lit(False))
        return F.struct(
            F.when(full, 200).otherwise(MISSING_METADATA).alias("status"),
            *[F.when(full, p[n]).alias(n) for n in names])

    return let(got, read)


def parse_literature(text: Column) -> Column:
    """struct(status, reaction)."""
    reaction = F.get_json_object(text, "$.literature_reaction")
    return F.struct(
        F.when(reaction.isNull(), MISSING_METADATA).otherwise(200).alias("status"), reaction.alias("reaction"))


def reaction_prompt(template: Column, product: Column, reactants: Column, reagents: Column, conditions: Column) -> Column:
    """placeholders filled, lists joined with a comma and a blank."""
    out = template
    for name, value in [
        ("{product}", product), ("{reactants}", F.array_join(reactants, ", ")),
        ("{reagents}", F.array_join(reagents, ", ")), ("{conditions}", conditions),
    ]:
        out = F.replace(out, F.lit(name), value)
    return out
