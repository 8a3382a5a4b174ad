"""Splitting model answers by their tags, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATES = "data array<string>, explanation array<string>, confidence_scores array<double>"


def find(text: Column, part: str) -> Column:
    """0-based place of ``part``, -1 if absent."""
    return F.position(F.lit(part), text) - 1


def between(text: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1; an end of -1 means "all but the last character"."""
    stop = F.when(end < 0, F.length(text) + end).otherwise(end)
    return F.substr(text, start + 1, F.greatest(stop - start, F.lit(0)))


def tagged(text: Column, tag: str, offset: int) -> Column:
    """Text after the opening tag; the offset counts from the tag's place, present or not."""
    return between(text, find(text, f"<{tag}>\n") + offset, find(text, f"</{tag}>"))


def _answer(status: Column, thinking: Column, body: Column, code: int) -> Column:
    ok = status
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, 200).otherwise(code).alias("status"),
        F.when(ok, thinking).otherwise(none).alias("thinking"),
        F.when(ok, body).otherwise("").alias("json"),
    )


def json_body(text: Column) -> Column:
    return tagged(text, "json", 7)


def split_cot(text: Column) -> Column:
    """struct(status, thinking, json) of the tagged layout."""
    thoughts = tagged(text, "cot", 6)
    steps = F.transform(
        F.slice(F.split(thoughts, "<thinking"), F.lit(2), F.size(F.split(thoughts, "<thinking"))),
        lambda s: between(s, F.lit(0), find(s, "</thinking>")),
    )
    ok = (thoughts != "") & (F.size(F.split(thoughts, "<thinking")) > 1) & (json_body(text) != "")
    return _answer(ok, steps, json_body(text), 501)


def split_json_only(text: Column) -> Column:
    """F2."""
    return _answer(json_body(text) != "", F.array().cast("array<string>"), json_body(text), 502)


def split_think(text: Column) -> Column:
    """one thinking text, which keeps the rest of its opening tag."""
    thought = tagged(text, "think", 6)
    return _answer((thought != "") & (json_body(text) != ""), F.array(thought), json_body(text), 503)


def split_for(text: Column, family: Column) -> Column:
    """by answer family; any other model uses the tagged layout; 505 for no text."""
    failed = F.struct(F.lit(505).alias("status"), F.array().cast("array<string>").alias("thinking"), F.lit("").alias("json"))
    return (
        F.when(text.isNull(), failed).when(family == "think", split_think(text))
        .when(family == "json", split_json_only(text)).otherwise(split_cot(text))
    )


def as_list(item: Column) -> Column:
    """A data entry as a list: a nested list arrives as JSON text, a bare text stands alone."""
    nested = item.rlike(r'^\s*\[\s*(["\'][\s\S]*)?\]\s*$')
    return F.when(nested, F.from_json(item, "array<string>")).otherwise(F.array(item))


def response_flags(text: Column) -> Column:
    """which hints an answer holds."""
    low = F.lower(text)
    body = F.trim(between(text, find(text, "<json>") + 6, find(text, "</json>")))
    has_json = F.contains(text, F.lit("<json>")) & F.contains(text, F.lit("</json>"))
    return F.struct(
        F.contains(low, F.lit("deprotection")).alias("deprotection"),
        F.contains(low, F.lit("protecting group")).alias("protecting_group"),
        (F.contains(low, F.lit("hydrolysis")) | F.contains(low, F.lit("hydrogenolysis"))).alias("conditions"),
        (F.contains(low, F.lit("ethox")) | F.contains(low, F.lit("oet"))).alias("ethoxy"),
        has_json.alias("has_json"),
        (has_json & body.rlike("[&%$]")).alias("masked_left"),
    )
