"""URL filters: rules by host and path, and a path-template tree learned from the urls they decide."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

# The rules of the url query, as (verdict, host and path prefix).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or above it and whose path starts the url's."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(longest_first):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    """The wildcard a variable segment becomes: its digits, letters and other signs by kind."""
    shape = F.regexp_replace(segment, r"\p{L}+", "a")
    shape = F.regexp_replace(shape, r"\d+", "0")
    return F.concat(F.lit("{"), F.regexp_replace(shape, r"(a0|0a)[a0]*", "x"), F.lit("}"))


def templates(paths: DataFrame, many: int = 4, per_value: float = 8.0, z: float = 2.0) -> DataFrame:
    """The template of each path: (host, path, template).

    ``paths``: host, path, n, blocked, allowed (counts of urls; the labelled ones by verdict), a
    row per host and path.  The tree of each host is walked level by level until no path has a
    further segment.  At a node (host, template so far):

    * a child value is variable, and becomes a wildcard of its shape, if its shape has at least
      ``many`` values there and these have at most ``per_value`` urls each on average, or if it
      holds a digit;
    * the other values stay, but those whose labelled share of blocked urls differs by less than
      ``z`` standard errors from that of all labelled values of the node are merged into one
      branch ``{~}``; values without a label, and nodes with fewer than two labelled values, merge nothing.
    """
    state = paths.select("host", "path", "n", "blocked", "allowed", F.lit("").alias("template"), F.split("path", "/").alias("parts"), F.lit(1).alias("at"))
    state = stage(state)
    done = []
    while True:
        done.append(state.where(F.size("parts") <= F.col("at")).select("host", "path", "template"))
        state = state.where(F.size("parts") > F.col("at")).withColumn("value", F.get("parts", F.col("at")))
        if state.isEmpty():
            break
        node = ["host", "template"]
        values = state.groupBy(*node, "value").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]).withColumn("shape", _shape(F.col("value")))
        shapes = values.groupBy(*node, "shape").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("urls"))
        labelled = F.col("blocked") + F.col("allowed")
        pooled = values.groupBy(*node).agg(
            F.sum("blocked").alias("b"), F.sum(labelled).alias("l"), F.count(F.when(labelled > 0, 1)).alias("branches"))
        p = (F.col("b") + 1) / (F.col("l") + 2)
        alike = (F.col("branches") > 1) & (labelled > 0) & (
            F.abs(F.col("blocked") / labelled - F.col("b") / F.col("l")) < z * F.sqrt(p * (1 - p) / F.greatest(labelled, F.lit(1))))
        variable = F.col("value").rlike(r"\d") | ((F.col("values") >= many) & (F.col("urls") <= per_value * F.col("values")))
        named = F.when(F.col("value") == "", "").when(variable, F.col("shape")).when(alike, "{~}").otherwise(F.col("value"))
        named_values = values.join(shapes, [*node, "shape"]).join(pooled, node).select(*node, "value", named.alias("name"))
        state = stage(state.join(named_values, [*node, "value"]).select(
            "host", "path", "n", "blocked", "allowed", F.concat_ws("/", "template", "name").alias("template"), "parts", (F.col("at") + 1).alias("at")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, reject: float = 0.8, prior_weight: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every url.

    The longest fitting rule decides (a rule fits its host, all hosts below it, and paths that
    start with its path).  Urls that a rule decides are the labelled ones.  The others take the
    verdict of their template: with b blocked of l labelled urls of the same host and template,
    or, where a host has no labelled url, of the same template on all hosts, the smoothed purity is
    (b + prior_weight * share) / (l + prior_weight), with the share of blocked urls among all
    labelled ones, a half at most; a template is blocked from ``reject`` on.

    A null url, or one without "://", has an empty host and path and no rule.  Rows are judged
    one by one, repeated rows alike; counts are summed per host and path before they meet.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))
    paths = stage(seen.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed")))
    named = stage(paths.join(templates(paths), ["host", "path"]))
    total = named.agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l")).first()
    share = min(0.5, (total["b"] or 0) / total["l"]) if total["l"] else 0.0  # a template without labels is never blocked
    sums = [F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l")]
    own = named.groupBy("host", "template").agg(*sums)
    hosts = own.groupBy("host").agg(F.sum("l").alias("host_labels"))
    anywhere = own.groupBy("template").agg(F.sum("b").alias("all_b"), F.sum("l").alias("all_l"))
    alone = F.col("host_labels") == 0
    b, n = F.when(alone, F.col("all_b")).otherwise(F.col("b")), F.when(alone, F.col("all_l")).otherwise(F.col("l"))
    purity = own.join(hosts, "host").join(anywhere, "template").select(
        "host", "template", ((b + F.lit(prior_weight * share)) / (n + F.lit(prior_weight))).alias("purity"))
    judged = named.join(purity, ["host", "template"]).select("host", "path", "template", "purity")
    return seen.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")
