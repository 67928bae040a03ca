"""Operator 2: URL filters by a tree of path templates.

Fixed rules decide what they fit.  The other urls are judged by what the rules say
of urls built alike:

1.  Per host a tree of path segments grows level by level.  A segment keeps its own branch
    where its urls give evidence of their own: ``LABELLED`` of them are decided by rules,
    or there are ``ENOUGH`` of them, or their share of blocked ones differs significantly from
    that of the rest of the node.  All others, and segments that look like an id and have
    no ``LABELLED`` decided urls, are one wildcard.  How large the node is, and how many
    children it has, does not matter.
2.  Branches of a host that differ in their first literal segment only, and whose shares of
    blocked urls do not differ significantly, are merged (in steps of the share, so that a
    host's branches never meet in one task).
3.  Purity is the share of blocked urls among the labelled ones (those that a rule decides),
    smoothed down the tree: a node's prior is its parent's purity and that of the same path on
    other hosts, each weighed by its labelled urls (``TRUST`` at most).  The host itself starts from
    the share of all labelled urls.  So every url has a purity, on hosts without rules too.
4.  A template is rejected if its purity reaches ``REJECT_AT``.

All segments of a path are looked at, however deep.  All steps are DataFrame
aggregations and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from prepkit.functions.numbering import small_side

#: (verdict, host and path) of the rules (fixed values of the contract)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
LABELLED = 5        #: a child with so many urls that a rule decides is literal
ENOUGH = 20         #: a child with so many urls is literal, but for ids
TESTED = 3          #: a child's share of blocked urls is tested from so many decided ones
REJECT_AT = 0.8
PRIOR = 4.0         #: pseudo urls with the prior's share of blocked ones
TRUST = 20          #: labelled urls that count, at most, where evidence from two sides is weighed
STEPS = 64          #: classes of shares within which branches are merged at once
SIGNIFICANT = 1.96  #: standard errors
ID_LIKE = r"^(?:[0-9]+|[0-9]+\.[a-z0-9]+|[0-9a-fA-F-]{8,}|.*[0-9]{4,}.*|.{40,})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]], what: str) -> Column:
    """The longest fitting rule, or its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule if what == "rule" else verdict)).otherwise(out)
    return out


def _literal(rows: DataFrame) -> DataFrame:
    """node, seg of the children that are branches of their own."""
    counts = rows.groupBy("node", "seg").agg(
        F.count(F.lit(1)).alias("urls"), F.count("said").alias("n"), F.count_if(F.col("said") == "block").alias("b"))
    nodes = counts.groupBy("node").agg(F.sum("n").alias("n0"), F.sum("b").alias("b0"))
    rest = (counts.where((F.col("n") >= TESTED) | (F.col("urls") >= ENOUGH)).join(nodes, "node")
            .withColumn("n0", F.col("n0") - F.col("n")).withColumn("b0", F.col("b0") - F.col("b")))
    # two proportions, with the correction for small counts
    pooled = (F.col("b") + F.col("b0")) / (F.col("n") + F.col("n0"))
    both = 1 / F.col("n") + 1 / F.col("n0")
    differs = F.abs(F.col("b") / F.col("n") - F.col("b0") / F.col("n0")) - both / 2 > SIGNIFICANT * F.sqrt(pooled * (1 - pooled) * both)
    differs = F.when((F.col("n") >= TESTED) & (F.col("n0") > 0), differs).otherwise(F.lit(False))
    own = (F.col("n") >= LABELLED) | (~F.col("seg").rlike(ID_LIKE) & ((F.col("urls") >= ENOUGH) | differs))
    return rest.where(own).select("node", "seg", F.lit(True).alias("literal"))


def _templates(urls: DataFrame) -> DataFrame:
    """Adds ``template`` (segments joined by /) and ``grown`` (its levels in the tree) to rows of host, segments, said.

    Ends when no url has segments left.  Below a node with fewer urls than any literal child
    has, all segments are wildcards, so its urls are finished at once.
    """
    rows, level, finished = urls.withColumn("node", F.col("host")), 0, None
    while True:
        # checkpointed: an aggregation in the stage of the join would keep a large node from being split
        grows = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("urls"), F.count("said").alias("n"))
                 .where((F.col("urls") >= ENOUGH) | (F.col("n") >= TESTED)).select("node", F.lit(True).alias("grows")).checkpoint())
        rows = rows.join(grows, "node", "left").withColumn("seg", F.get("segments", F.lit(level))).checkpoint()
        more = F.col("grows").isNotNull() & F.col("seg").isNotNull()
        ended = rows.where(~more).withColumn(
            "template", F.expr(f"concat(node, repeat('/*', greatest(size(segments) - {level}, 0)))")).withColumn(
            "grown", F.lit(level)).drop("node", "seg", "grows")
        finished = ended if finished is None else finished.union(ended)
        rows = rows.where(more).drop("grows")
        if rows.isEmpty():
            return finished
        rows = rows.join(_literal(rows), ["node", "seg"], "left")
        name = F.when(F.col("literal"), F.col("seg")).otherwise("*")
        rows = rows.withColumn("node", F.concat("node", F.lit("/"), name)).select(*urls.columns, "node")
        level += 1


def _merged(own: DataFrame, overall: float) -> DataFrame:
    """host, template, mb, mn: blocked and labelled urls of the merged branch of each labelled template."""
    tail = F.substring("template", F.length("host") + 1, F.length("template"))
    rate = (F.col("b") + PRIOR * overall) / (F.col("n") + PRIOR)
    own = own.where("n > 0").withColumn("family", F.concat("host", F.lit("|"), F.regexp_replace(tail, "^/[^/*][^/]*", "/{}")))
    own = own.withColumn("share", F.floor(rate * STEPS).cast("int"))
    # at most STEPS + 1 rows a family
    steps = own.groupBy("family", "share").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    near = W.partitionBy("family").orderBy("share")
    pooled = (F.col("b") + F.col("b0")) / (F.col("n") + F.col("n0"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("n0")))
    apart = F.abs(F.col("b") / F.col("n") - F.col("b0") / F.col("n0")) > SIGNIFICANT * error
    steps = (steps.withColumn("b0", F.lag("b").over(near)).withColumn("n0", F.lag("n").over(near))
             .withColumn("branch", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(near)))
    whole = W.partitionBy("family", "branch")
    steps = steps.select("family", "share", F.sum("b").over(whole).alias("mb"), F.sum("n").over(whole).alias("mn"))
    return own.join(small_side(steps), ["family", "share"]).select("host", "template", "mb", "mn")


def _judged(rows: DataFrame) -> DataFrame:
    """host, template, purity of every template."""
    own = rows.groupBy("host", "template").agg(
        F.max("grown").alias("grown"), F.count_if(F.col("said") == "block").alias("b"), F.count("said").alias("n")).checkpoint()
    blocked, labelled = own.agg(F.sum("b"), F.sum("n")).first()
    blocked, labelled = blocked or 0, labelled or 0
    overall = blocked / (labelled or 1)
    # the nodes of a template: its first 0 to ``grown`` segments, then all of them
    segments = F.split(F.substring("template", F.length("host") + 2, F.length("template")), "/")
    levels = own.withColumn("segments", segments).select("host", "template", "b", "n", F.posexplode(F.expr(
        "concat(transform(sequence(0, grown), k -> array_join(slice(segments, 1, k), '/')), array(concat(array_join(segments, '/'), '/')))")).alias(
        "level", "node"))
    here = levels.groupBy("host", "node").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn")).checkpoint()
    everywhere = here.where("node <> ''").groupBy("node").agg(F.sum("hb").alias("eb"), F.sum("hn").alias("en"))
    both = (levels.select("host", "template", "level", "node").join(small_side(here), ["host", "node"])
            .join(small_side(everywhere.checkpoint()), "node", "left")
            .withColumns({"eb": F.coalesce("eb", F.lit(blocked)), "en": F.coalesce("en", F.lit(labelled))}))
    last = F.col("node").endswith("/")
    both = both.join(small_side(_merged(own, overall)), ["host", "template"], "left").select(
        "host", "template", F.struct(
            "level", F.when(last, F.coalesce("mb", F.lit(0))).otherwise(F.col("hb")).alias("b"),
            F.when(last, F.coalesce("mn", F.lit(0))).otherwise(F.col("hn")).alias("n"),
            (F.col("eb") - F.col("hb")).alias("ob"), (F.col("en") - F.col("hn")).alias("on")).alias("at"))
    chain = both.groupBy("host", "template").agg(F.sort_array(F.collect_list("at")).alias("at"))
    others = f"(x.ob + {PRIOR}D * {overall!r}D) / (x.on + {PRIOR}D)"
    weight = f"double(least(x.on, {TRUST}))"
    prior = f"if(s.trust + {weight} = 0, s.p, (s.p * s.trust + {others} * {weight}) / (s.trust + {weight}))"
    return chain.select("host", "template", F.expr(
        f"aggregate(at, struct({overall!r}D as p, 0D as trust), (s, x) -> struct((x.b + {PRIOR}D * {prior}) / (x.n + {PRIOR}D) as p, "
        f"double(least(x.n, {TRUST})) as trust), s -> s.p)").alias("purity"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, template, purity; one row per input row.

    A rule fits its host and all subdomains, if the url's path starts with the rule's path;
    the longest wins.  Null urls and urls without ``://`` have an empty host and path, no
    rule, and are allowed unless their (empty) template is rejected.  Without any url that a rule
    decides all purities are 0.  Repeated rows and
    null ids each give a row; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select(
        "*", rule_column(F.col("host"), F.col("path"), rules, "rule").alias("rule"),
        rule_column(F.col("host"), F.col("path"), rules, "verdict").alias("said"),
        F.filter(F.split("path", "/"), lambda x: x != "").alias("segments"))
    rows = _templates(rows).select("page_id", "host", "path", "rule", "said", "template", "grown").checkpoint()
    return rows.join(small_side(_judged(rows).checkpoint()), ["host", "template"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow")).alias("verdict"),
        "template", "purity")
