"""Text expressions on molecule and formula columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import PROTECTING_GROUPS

INVALID = "INVALID_SMILES"
MASKED_CHARS = r"^[A-Za-z0-9()\[\]{}@+\-=#$%&*./\\]*$"


def groups() -> Column:
    """C17: the protecting groups as an array of (symbol, name, text)."""
    return F.array(*[
        F.struct(F.lit(a).alias("symbol"), F.lit(b).alias("name"), F.lit(c).alias("text"))
        for a, b, c in PROTECTING_GROUPS
    ])


def mask_groups(smiles: Column, valid: Column) -> Column:
    """C14: protecting groups to symbols, longest text first, then runs to their first sign."""
    out = smiles
    for symbol, _, text in PROTECTING_GROUPS:
        out = F.replace(out, F.lit(text), F.lit(symbol))
    out = F.regexp_replace(out, r"([.$%&])[.$%&]*", "$1")
    return F.when(valid, out).otherwise(F.lit(INVALID))


def unmask_groups(smiles: Column) -> Column:
    """Symbols back to group texts; the caller checks validity of the result."""
    out = smiles
    for symbol in ("$", "%", "&"):
        text = next(t for s, _, t in PROTECTING_GROUPS if s == symbol)
        out = F.replace(out, F.lit(symbol), F.lit(text))
    return out


def is_masked_text(smiles: Column) -> Column:
    """Empty, or has a symbol and only molecule characters."""
    return (smiles == "") | (smiles.rlike("[$%&]") & smiles.rlike(MASKED_CHARS))


def formula_atoms(formula: Column) -> Column:
    """Atoms counted in a formula text."""
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))
    counts = F.transform(parts, lambda p: F.regexp_extract(p, r"(\d+)", 1))
    return F.aggregate(
        counts, F.lit(0), lambda s, c: s + F.when(c == "", 1).otherwise(c.cast("int"))
    )


def formula_radius(formula: Column) -> Column:
    """Drawing radius."""
    grown = 45 + 20 * F.ln(formula_atoms(formula).cast("double"))
    return (
        F.when(formula.isNull() | (formula == ""), 35.0)
        .otherwise(F.greatest(F.lit(45.0), F.coalesce(grown, F.lit(45.0))))
    )


def formula_svg(formula: Column) -> Column:
    """Drawing box."""
    r = formula_radius(formula)
    return (
        F.when(formula.isNull() | (formula == ""), 60.0)
        .when(formula_atoms(formula) > 50, r * 2)
        .otherwise(r * 1.8)
    )


def format_formula(formula: Column) -> Column:
    """Digit runs as subscripts."""
    return F.regexp_replace(formula, r"(\d+)", '<tspan baseline-shift="sub">$1</tspan>')
