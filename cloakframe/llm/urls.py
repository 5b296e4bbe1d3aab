"""URL filters: rules on hosts and paths, and below them a path-template tree judged by labelled purity.

For each host the segments of its paths form a tree.  Level by level a segment is kept as it is only if it is
frequent and its labels differ from those of all branches beside it; else its shape (digits, text, ending) is kept
under the same condition; else it becomes the wildcard ``*``, merged with all branches that are statistically alike.
What remains are templates, each judged by its smoothed share of good labels.  Levels go on as long as the data have a
node that can still be parted; below one that cannot, every further segment is a wildcard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch


@dataclass(frozen=True)
class UrlConfig:
    """A branch of ``support`` labelled pages or more whose share of good labels is ``apart`` standard errors from its
    siblings' is kept.  A template is rejected if (good + prior * overall share) / (labelled + prior) is below ``purity``."""

    support: int = 20
    apart: float = 2.58
    prior: float = 20.0
    purity: float = 0.7


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: Fixed by the contract of the query.
RULES = (Rule(False, "net", "/"), Rule(True, "example.net", "/en/"), Rule(False, "example.com", "/de/"), Rule(True, "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, or null: its host is the url's or a parent of it, its path begins the
    url's.  Of rules equally long the first wins."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        at_host = (host == rule.host) | host.endswith("." + rule.host)
        found = F.when(at_host & path.startswith(rule.path), F.lit(rule.name)).otherwise(found)
    return found


def _shape(segment: Column) -> Column:
    """Runs of digits as 0, other letters as a, the ending after the last dot as it is."""
    stem = F.regexp_replace(segment, r"(?s)\.[A-Za-z]{1,5}$", "")
    ending = F.regexp_extract(segment, r"(?s)(\.[A-Za-z]{1,5})$", 1)
    kind = F.when(stem.rlike(r"^[0-9]+$"), F.lit("{0}")).when(stem.rlike(r"[0-9]"), F.lit("{a0}")).otherwise(F.lit("{a}"))
    return F.concat(kind, ending)


def _apart(of: DataFrame, by: list[str], config: UrlConfig) -> DataFrame:
    """Branches ``by`` of the nodes (host, template) that are frequent and differ from their siblings."""
    labelled = of.where(F.col("good").isNotNull())
    branches = labelled.groupBy("host", "template", *by).agg(F.count(F.lit(1)).alias("m"), F.sum("good").alias("g"))
    nodes = branches.groupBy("host", "template").agg(F.sum("m").alias("all_m"), F.sum("g").alias("all_g"))
    frequent = branches.where(F.col("m") >= config.support)
    share = F.col("all_g") / F.col("all_m")
    spread = F.sqrt(share * (1 - share) * F.try_divide(F.lit(1.0), F.col("m")))
    siblings = F.col("all_m") > F.col("m")
    differs = F.abs(F.col("g") / F.col("m") - share) > F.lit(config.apart) * spread
    return frequent.join(nodes, ["host", "template"]).where(siblings & differs).select("host", "template", *by)


def templates(urls: DataFrame, config: UrlConfig = UrlConfig(), scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, good) -> the same with ``template``.  ``good`` is 1, 0 or null (no label).

    A node can be parted while more than ``support`` labelled pages go on below it and their labels differ; a level is
    one round over the pages of such nodes alone, and there are as many rounds as the data have levels of them.  Of a
    path that does not go on in such a node each segment left becomes ``*``."""
    scratch = scratch or Scratch(urls.sparkSession)
    segments = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    rows = urls.withColumns({"segments": segments, "template": F.lit("")})
    level, done, own = 0, [], ["page_id", "host", "path", "good", "template"]
    while True:
        here = rows.withColumn("segment", F.get("segments", F.lit(level))).withColumn("shape", _shape(F.col("segment")))
        here = scratch.settle(here, "level")
        inner = here.where(F.col("segment").isNotNull())
        nodes = inner.groupBy("host", "template").agg(F.count("good").alias("all_m"), F.sum("good").alias("all_g"))
        nodes = scratch.settle(nodes.where((F.col("all_m") > config.support) & (F.col("all_g") > 0) & (F.col("all_g") < F.col("all_m"))).select("host", "template"), "nodes")
        left = F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - level))
        done.append(here.join(nodes, ["host", "template"], "left_anti").withColumn("template", left).select(own))
        done[-1] = done[-1].unionByName(here.join(nodes, ["host", "template"], "left_semi").where(F.col("segment").isNull()).select(own))
        if nodes.isEmpty():
            break
        open_rows = inner.join(nodes, ["host", "template"], "left_semi")
        literal = scratch.settle(_apart(open_rows, ["segment"], config).withColumn("by_name", F.lit(True)), "literal")
        shapes = scratch.settle(_apart(open_rows, ["shape"], config).withColumn("by_shape", F.lit(True)), "shapes")
        joined = open_rows.join(literal, ["host", "template", "segment"], "left").join(shapes, ["host", "template", "shape"], "left")
        step = (
            F.when(F.col("by_name"), F.concat(F.lit("/"), "segment"))
            .when(F.col("by_shape"), F.concat(F.lit("/"), "shape"))
            .otherwise(F.lit("/*"))
        )
        rows, level = joined.withColumn("template", F.concat("template", step)).select(*own, "segments"), level + 1
    placed = scratch.settle(reduce(DataFrame.unionByName, done), "templates")
    scratch.drop("level", "nodes", "literal", "shapes")
    return placed


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, config: UrlConfig = UrlConfig()
) -> DataFrame:
    """page_id, host, path, template, rule and verdict of every page; ``labels`` has page_id and good (1 or 0; of
    several the worst counts, nulls do not).  A url without ``://`` has empty host and path and is a host of its own.
    Without labels nothing but the rules rejects.  Repeated rows agree.  Other columns are left behind."""
    one_each = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").cast("int").alias("good"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(one_each, "page_id", "left")
    scratch = Scratch(pages.sparkSession)
    placed = templates(urls, config, scratch)
    counted = placed.groupBy("host", "template").agg(F.count("good").alias("m"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    overall = placed.agg(F.coalesce(F.avg("good"), F.lit(1.0))).first()[0]
    purity = (F.col("g") + F.lit(config.prior * overall)) / (F.col("m") + F.lit(config.prior))
    judged = scratch.settle(counted.select("host", "template", (purity >= config.purity).alias("pure")), "purity")
    rows = placed.join(judged, ["host", "template"]).withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    allowed = F.lit(None).cast("boolean")
    for rule in rules:
        allowed = F.when(F.col("rule") == rule.name, F.lit(rule.allow)).otherwise(allowed)
    verdict = F.when(F.coalesce(allowed, F.col("pure")), F.lit("allow")).otherwise(F.lit("block"))
    return rows.select("page_id", "host", "path", "template", "rule", verdict.alias("verdict"))
