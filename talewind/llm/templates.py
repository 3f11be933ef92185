"""URL filter: rules by host and path, and for all other urls a tree of path templates judged by labelled purity.

Each host has a tree whose levels are the segments of its paths. From the first level down, segments that are frequent enough
among the pages of their branch stay; all others are variable and become one wildcard (of one file ending). Then, from the last level up,
sibling branches are merged that have the same templates below them, in shares that a chi-square test can't tell apart, and labels
that a binomial test can't tell apart. A branch is tested against all its alike siblings together, never against each one.
A template is rejected if its share of bad labels, smoothed towards its host's (and that towards all pages'), is over LIMIT.

Labels are given, or are the verdicts of the rules. All of it are column functions; pages of one host and path are one row from
the start, and every step is a sum by (host, branch, segment), which spreads a large host over its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import prepare
from talewind.session import cut_lineage

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Levels of the tree; what is left of a longer path is its last segment.
LEVELS = 4
#: A segment stays if it has so many pages, and one in so many of its branch.
PAGES, ONE_IN = 3, 50
#: Weight of the smoothing, in labels, and the share of bad labels above which a template is rejected.
PRIOR, LIMIT = 4, 0.5
#: Standard deviations up to which shares count as alike.
DEVIATIONS = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for text without ://."""
    there = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return tuple(F.when(there, x).otherwise("") for x in (host, path))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct of rule and verdict (null: none). Ties: the longer host, then block. Rules are part of the plan."""
    order = sorted(set(rules), key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r[1:]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in reversed(order):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, levels: int = LEVELS) -> Column:
    """What follows each slash; the last level has all that is left."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, 2, F.length(path)), "/", levels))


def wildcard(segment: Column) -> Column:
    """The wildcard of a variable segment; an empty one (a slash at the end) stays."""
    return F.when(segment == "", "").otherwise(F.concat(F.lit("*"), F.lower(F.regexp_extract(segment, r"\.[A-Za-z0-9]{1,5}$", 0))))


def generalised(paths: DataFrame, levels: int = LEVELS, pages: int = PAGES, one_in: int = ONE_IN) -> DataFrame:
    """host, path, n, good, bad, segments, and template: an array of kept segments and wildcards."""
    paths = paths.withColumn("segments", segments(F.col("path"), levels)).withColumn("template", F.array().cast("array<string>"))
    for k in range(1, levels + 1):
        segment = F.try_element_at("segments", F.lit(k))
        at = cut_lineage(paths.withColumn("segment", segment))
        of = at.filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("_n"))
        whole = of.groupBy("host", "template").agg(F.sum("_n").alias("_all"))
        kept = of.filter(F.col("_n") >= pages).join(whole, ["host", "template"]).filter(F.col("_n") * one_in >= F.col("_all"))
        joined = at.join(kept.select("host", "template", "segment", F.lit(True).alias("_kept")), ["host", "template", "segment"], "left")
        token = F.when(F.col("_kept"), F.col("segment")).otherwise(wildcard(F.col("segment")))
        step = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.array(token)))
        paths = joined.select("host", "path", "n", "good", "bad", "segments", step.alias("template"))
    return paths


def _apart(seen: Column, tries: Column, share: Column) -> Column:
    """Whether ``seen`` of ``tries`` is too far from what ``share`` makes expect."""
    return F.abs(seen - tries * share) > DEVIATIONS * F.sqrt(tries * share * (1 - share))


def merged(templates: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, template, n, good, bad, merged: the template after merging alike branches, from the last level up."""
    rows = templates.withColumn("merged", F.col("template"))
    for k in range(levels, 0, -1):
        rows = cut_lineage(rows)
        here = rows.filter(F.size("merged") >= k).select(
            "host", F.slice("merged", 1, k - 1).alias("above"), F.element_at("merged", k).alias("token"),
            F.slice("merged", F.lit(k + 1), F.greatest(F.size("merged") - k, F.lit(0))).alias("below"), "n", "good", "bad",
        )
        leaves = here.groupBy("host", "above", "token", "below").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        branch = leaves.groupBy("host", "above", "token").agg(
            *(F.sum(c).alias(c) for c in ("n", "good", "bad")), F.sort_array(F.collect_set(F.to_json("below"))).alias("shape"),
        )
        # A branch has at most ONE_IN kept children and some wildcards at each level below it, so its shape is bounded.
        branch = cut_lineage(branch.withColumn("shape", F.sha2(F.concat_ws("\n", "shape"), 256)))
        family = branch.groupBy("host", "above", "shape").agg(
            F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("of"),
        ).filter("of > 1")
        member = cut_lineage(branch.join(family, ["host", "above", "shape"]))
        parts = leaves.select("host", "above", "token", "below", F.col("n").alias("k")).join(member, ["host", "above", "token"])
        together = parts.groupBy("host", "above", "shape", "below").agg(F.sum("k").alias("all_k"))
        expected = F.col("n") * F.col("all_k") / F.col("all_n")
        chi = parts.join(together, ["host", "above", "shape", "below"]).groupBy("host", "above", "token").agg(
            F.sum((F.col("k") - expected) ** 2 / expected).alias("chi"), (F.count("*") - 1).alias("free")
        )
        share = F.when(F.col("all_good") + F.col("all_bad") > 0, F.col("all_bad") / (F.col("all_good") + F.col("all_bad"))).otherwise(0.0)
        alike = (F.col("chi") <= F.col("free") + DEVIATIONS * F.sqrt(2 * F.col("free")) + 1e-9) & ~_apart(F.col("bad"), F.col("good") + F.col("bad"), share)
        into = member.join(chi, ["host", "above", "token"]).filter(alike).groupBy("host", "above", "shape").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
        named = into.filter(F.size("tokens") > 1).select("host", "above", F.explode("tokens").alias("token"), F.concat(F.lit("("), F.array_join("tokens", "|"), F.lit(")")).alias("to"))
        above, token = F.slice("merged", 1, k - 1), F.try_element_at("merged", F.lit(k))
        met = rows.withColumn("above", above).withColumn("token", token).join(named, ["host", "above", "token"], "left")
        renamed = F.when(F.col("to").isNull(), F.col("merged")).otherwise(
            F.concat("above", F.array("to"), F.slice("merged", F.lit(k + 1), F.greatest(F.size("merged") - k, F.lit(0))))
        )
        rows = met.select("host", "template", "n", "good", "bad", renamed.alias("merged"))
    return rows


def purity(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, template, merged, bad_share: smoothed shares of bad labels of the merged templates."""
    sums = rows.groupBy("host", "merged").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    hosts = sums.groupBy("host").agg(F.sum("g").alias("host_g"), F.sum("b").alias("host_b"))
    everywhere = hosts.agg(F.coalesce(F.sum("host_g"), F.lit(0)).alias("all_g"), F.coalesce(F.sum("host_b"), F.lit(0)).alias("all_b")).first()
    base = (everywhere.all_b + 1) / (everywhere.all_g + everywhere.all_b + 2)
    own = hosts.select("host", ((F.col("host_b") + prior * base) / (F.col("host_g") + F.col("host_b") + prior)).alias("of_host"))
    share = (F.col("b") + prior * F.col("of_host")) / (F.col("g") + F.col("b") + prior)
    judged = sums.join(own, "host").select("host", "merged", share.alias("bad_share"))
    return rows.select("host", "template", "merged").join(judged, ["host", "merged"])


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, levels: int = LEVELS, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share for each row of ``pages`` (page_id, url; other columns are not read).

    rules: (verdict, host, path). The longest one that fits decides; rule is null where none does. labels: page_id, bad (0 or 1; the
    largest of several); without it the verdicts of the rules are the labels. Null urls and urls without :// have an empty host
    and path, which is a template as any other. Repeated rows are judged each, and count each. An empty table gives no rows.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        rows = rows.withColumn("bad", (F.col("r.verdict") == "block").cast("long"))
    else:
        known = labels.filter("bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
        rows = rows.join(known, "page_id", "left")
    rows = cut_lineage(rows)
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
    )
    paths = cut_lineage(generalised(paths, levels))
    templates = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    found = cut_lineage(purity(merged(templates, levels)))
    of_path = paths.select("host", "path", "template").join(found, ["host", "template"])
    of_path = of_path.select("host", "path", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "bad_share")
    verdict = F.coalesce("r.verdict", F.when(F.col("bad_share") > limit, "block").otherwise("allow"))
    return rows.join(of_path, ["host", "path"]).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")
