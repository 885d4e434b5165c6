"""URL filters: explicit host and path rules, then a path-template tree judged by labelled purity.

DataFrame functions only. Segments that are variable by shape (numbers, hexadecimal ids, dates)
become a typed wildcard; what lies beyond ``depth`` segments is one last segment. The tree is then
built over the distinct typed paths of each host, top down: under every parent the children of few
rows or few labels are generalised to ``*``; a child with enough of both stays a branch however
many siblings it has.

Branches are merged bottom up. A branch whose labelled purity does not differ from that of its
siblings (a two-proportion z-test against the rest) is merged with its like, and what is merged
counts for the parent when that is compared with its own siblings. Every template thus belongs to
its deepest ancestor that stands apart, or to the host. That branch is rejected when its purity,
smoothed towards the corpus prior, is below ``floor`` times the prior and its labels are too few
good ones to be chance (``z_block`` standard errors below the prior).

Null urls and urls without ``://`` have an empty host and path. An empty table gives an empty
table. Repeated rows are judged alike and each kept. A url of any length is judged. Input columns
other than the id and the url are not carried, so their names cannot clash. Labels with null id or
label are ignored; without labels nothing but the rules blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table
from tidelog.session import drop, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    pattern: str  # host followed by the path it starts with

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


#: The rules that the contract of op5 states.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits; of two equally long ones the first listed."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.pattern))
        for r in sorted(rules, key=lambda r: -len(r.pattern))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def segment_shape(segment: Column) -> Column:
    """A segment that is variable by its shape as a typed wildcard; any other as it is."""
    stem = F.regexp_replace(segment, r"\.(html?|php|aspx?|jsp)$", "")
    return (
        F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{hex}"))
        .otherwise(segment)
    )


def typed_path(path: Column, depth: int) -> Column:
    """The segments of a path, each by its shape; what lies beyond ``depth`` of them is the last."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    first = F.transform(F.slice(parts, 1, depth), segment_shape)
    rest = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(1))), "/")
    return F.when(F.size(parts) > depth, F.concat(first, F.array(segment_shape(rest)))).otherwise(first)


def url_templates(paths: DataFrame, min_rows: int = 20, min_labelled: int = 5) -> DataFrame:
    """Adds ``template`` (an array) to rows of (host, segments) with row, good and label counts (n, good, labelled).

    Level by level, as many as the longest path has, a child of (host, template so far) of less
    than ``min_rows`` rows or ``min_labelled`` labels becomes ``*``; typed wildcards stay.
    """
    out = save(paths.withColumn("template", F.array().cast("array<string>")), "url-tree")
    levels = out.agg(F.max(F.size("segments"))).first()[0] or 0
    for i in range(levels):
        seg = F.get("segments", F.lit(i))
        few = out.where(seg.isNotNull() & ~seg.startswith("{")).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("rows"), F.sum("labelled").alias("known")).where((F.col("rows") < min_rows) | (F.col("known") < min_labelled)).select("host", "template", "seg", F.lit("*").alias("wild"))
        grown = out.withColumn("seg", seg).join(few, ["host", "template", "seg"], "left").withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.coalesce("wild", "seg"))))).drop("seg", "wild")
        done = save(grown, "url-tree")  # the next level reads it twice
        drop(out)
        out = done
    return out


def branch_purity(templates: DataFrame, z: float = 2.58) -> DataFrame:
    """(host, branch, good, labelled): the branches that stand apart, and of each host the rest as branch ``[]``.

    ``templates`` has (host, template, good, labelled). Bottom up, a branch has its own labels and
    those merged below it. It stands apart from its siblings if their labels together, without its
    own, have a purity that differs by ``z`` standard errors.
    """
    own = templates.groupBy("host", F.col("template").alias("branch")).agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    own = save(own, "url-branches")
    levels = own.agg(F.max(F.size("branch"))).first()[0] or 0
    apart_of, below = [], None
    for level in range(levels, 0, -1):
        rows = own.where(F.size("branch") == level)
        rows = (rows if below is None else rows.unionByName(below)).groupBy("host", "branch").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
        rows = rows.withColumn("parent", F.slice("branch", 1, level - 1) if level > 1 else F.array().cast("array<string>"))
        pooled = rows.groupBy("host", "parent").agg(F.sum("good").alias("all_good"), F.sum("labelled").alias("all_labelled"))
        rest_n = F.col("all_labelled") - F.col("labelled")
        rest_p = F.try_divide(F.col("all_good") - F.col("good"), rest_n)
        p = F.try_divide(F.col("all_good"), F.col("all_labelled"))
        error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_n)))
        apart = F.coalesce(F.abs(F.try_divide(F.col("good"), F.col("labelled")) - rest_p) > z * error, F.lit(False))  # null without labels on both sides
        judged = save(rows.join(pooled, ["host", "parent"]).select("host", "branch", "parent", "good", "labelled", apart.alias("apart")), "url-level")
        apart_of.append(judged.where("apart").select("host", "branch", "good", "labelled"))
        below = judged.where(~F.col("apart")).select("host", F.col("parent").alias("branch"), "good", "labelled")
    root = own.where(F.size("branch") == 0)
    root = (root if below is None else root.unionByName(below)).groupBy("host", "branch").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    return reduce(DataFrame.unionByName, apart_of, root)


def judged_templates(templates: DataFrame, prior: float, strength: float = 5.0, floor: float = 0.75, z_block: float = 3.0) -> DataFrame:
    """(host, template, branch, purity, rejected) of every template, by the deepest branch that holds it."""
    smoothed = (F.col("good") + strength * prior) / (F.col("labelled") + strength)
    below = F.lit(prior) * F.col("labelled") - F.col("good") > z_block * F.sqrt(F.lit(prior * (1 - prior)) * F.col("labelled"))
    branches = branch_purity(templates).select("host", "branch", smoothed.alias("purity"), ((smoothed < floor * prior) & below).alias("rejected"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template")), lambda k: F.slice("template", F.lit(1), k))
    each = templates.select("host", "template").distinct().select("host", "template", F.explode(prefixes).alias("branch"))
    deepest = F.max_by(F.struct("branch", "purity", "rejected"), F.size("branch"))
    return each.join(branches, ["host", "branch"]).groupBy("host", "template").agg(deepest.alias("d")).select("host", "template", "d.*")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, depth: int = 8, **limits: float) -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict, template, branch, purity).

    ``pages`` has (page_id, url), ``labels`` (page_id, good 0/1). A url that a rule fits takes
    the rule's action; any other is blocked when the branch of its template is rejected
    (``limits`` as in ``judged_templates``).
    """
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("segments", typed_path(F.col("path"), depth))
    known = labels.where(F.col("page_id").isNotNull() & F.col("good").isNotNull()).groupBy("page_id").agg((F.avg("good") >= 0.5).cast("long").alias("good"))
    prior = known.agg(F.coalesce(F.avg("good"), F.lit(1.0))).first()[0]
    distinct = (
        base.join(known, "page_id", "left").groupBy("host", "segments")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("labelled"))
    )
    templates = url_templates(distinct)
    judged = save(templates.select("host", "segments", "template").join(judged_templates(templates, prior, **limits), ["host", "template"]), "url-verdicts")
    drop(templates)
    rule = rule_column(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.pattern, F.lit(r.action)).otherwise(by_rule)
    by_tree = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    name = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    return (
        base.join(judged, ["host", "segments"], "left").withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_tree).alias("verdict"), name("template").alias("template"), name("branch").alias("branch"), "purity")
    )


def op5_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``, judged; a page holds the document that the last number of its path names, and has its quality as label."""
    pages = table(spark, sf_dir, "pages")
    held = F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    of = pages.select("page_id", F.when(held != "", held).cast("long").alias("doc_id"))
    labels = of.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")
    return filter_urls(pages, labels)
