"""URL filters: fixed rules, and per host a tree of path templates learned from labelled URLs.

The tree is built level by level as joins and aggregations over distinct (host, path) pairs; no host is
ever held in one task. At each node, segments that hardly repeat become a wildcard; the other branches
are merged when their labelled block rates can't be told apart. A template is rejected when its labelled
purity, smoothed by a prior, is high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 4  # levels of the tree; deeper segments are folded into one tail
    min_kinds: int = 4  # fewer different segments than this are never a wildcard
    repeats: float = 2.0  # mean number of paths below a segment under which the segments count as variable
    many_kinds: int = 64  # so many different segments at one node count as variable in any case
    z_similar: float = 2.0  # branches whose block rate is within so many standard errors of the node's merge
    prior_weight: float = 2.0  # smoothing: so many invented labels ...
    prior_block: float = 0.5  # ... of which this share is block
    reject_purity: float = 0.8


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits; null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last branch tried is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def learn_templates(urls: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``urls``: ``host, path, labelled, blocked`` (counts of labels per row, 0 where there are none).

    One row per distinct host and path: ``host, path, template, labelled, blocked, purity, reject``.
    A template without labels keeps the prior and is not rejected. An empty table gives an empty result.
    """
    s = settings
    rows = urls.groupBy("host", "path").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    tail = F.when(F.size(parts) > s.depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("segments", F.concat(F.slice(parts, 1, s.depth), tail)).withColumn("template", F.lit(""))
    rows = materialize(rows, "urls")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0  # one number, at most depth + 1
    for level in range(1, deepest + 1):
        here = rows.withColumn("segment", F.when(F.size("segments") >= level, F.get("segments", F.lit(level - 1))))
        open_rows = here.where("segment is not null")
        totals = [F.sum("labelled").alias("lab"), F.sum("blocked").alias("blk")]
        kids = open_rows.groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n"), *totals)
        nodes = kids.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kinds"),
            F.sum("n").alias("paths"),
            F.sum("lab").alias("node_lab"),
            F.sum("blk").alias("node_blk"),
        )
        # Written: the adaptive plan cuts a large host only where the join reads two plain exchanges.
        nodes = materialize(nodes, "nodes")
        variable = (F.col("kinds") >= s.min_kinds) & (
            (F.col("paths") < F.col("kinds") * s.repeats) | (F.col("kinds") >= s.many_kinds)
        )
        rate = _smoothed(F.col("node_blk"), F.col("node_lab"), s)
        z = (F.col("blk") - F.col("lab") * rate) / F.sqrt(F.col("lab") * rate * (1 - rate))
        branch = (
            F.when(variable, "*")
            .when(F.col("segment") == "**", "**")
            .when(F.col("lab") == 0, "{unlabelled}")
            .when(z > s.z_similar, "{worse}")
            .when(z < -s.z_similar, "{better}")
            .otherwise("{alike}")
        )
        chosen = kids.join(nodes, ["host", "template"]).select("host", "template", "segment", branch.alias("branch"))
        grown = open_rows.join(chosen, ["host", "template", "segment"])
        grown = grown.withColumn("template", F.concat("template", F.lit("/"), "branch")).select(*rows.columns)
        rows = materialize(grown.unionByName(here.where("segment is null").select(*rows.columns)), "urls")
    facts = rows.groupBy("host", "template").agg(F.sum("labelled").alias("lab"), F.sum("blocked").alias("blk"))
    facts = facts.withColumn("purity", _smoothed(F.col("blk"), F.col("lab"), s))
    reject = (F.col("lab") > 0) & (F.col("purity") >= s.reject_purity)
    facts = materialize(facts.withColumn("reject", reject), "templates")
    return rows.select("host", "path", "template").join(facts, ["host", "template"])


def _smoothed(blocked: Column, labelled: Column, s: TreeSettings) -> Column:
    return (blocked + s.prior_weight * s.prior_block) / (labelled + s.prior_weight)


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", settings: TreeSettings = TreeSettings()
) -> DataFrame:
    """One row per page: ``<id_col>, host, path, rule, verdict, template, purity``.

    Pages that a rule fits are the labelled sample of the tree; the others follow their template. A null url,
    or one without ``://``, has an empty host and path. Repeated and null ids stay rows of their own.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    flat = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = flat.select(
        "*",
        matching_rule(F.col("host"), F.col("path"), rules, "text").alias("rule"),
        matching_rule(F.col("host"), F.col("path"), rules, "verdict").alias("by_rule"),
    )
    labels = ruled.select(
        "host",
        "path",
        F.col("by_rule").isNotNull().cast("long").alias("labelled"),
        F.coalesce((F.col("by_rule") == "block").cast("long"), F.lit(0)).alias("blocked"),
    )
    tree = learn_templates(labels, settings).select("host", "path", "template", "purity", "reject")
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return ruled.join(tree, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", method).alias("verdict"),
        "template",
        "purity",
    )
