"""Probabilistic linking of accounts across platforms from public data.

Actors: actor_id, primary_platform, username, bio, active_hours array<int>, primary_topics array<string>.
Pairs: actor_a < actor_b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import row_key
from talewind.functions.scores import (
    BIO_PATTERNS, account_name, behavior_score, bio_handles, bio_score, fingerprint_score, noisy_or, username_score,
)
from talewind.functions.text import strip, words
from talewind.functions.times import AsOf, instant
from talewind.operators.skew import top_per_group
from talewind.session import cut_lineage

LINK_CONFIDENCE = 0.70
# Length of the pieces by which names are looked for in biographies.
GRAM = 3
HASHES_KEPT = 50


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("actor_a"), F.greatest(a, b).alias("actor_b")]


def _not_linked(pairs: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return pairs
    known = links.select(*_ordered("actor_a", "actor_b"))
    return pairs.join(known, ["actor_a", "actor_b"], "left_anti")


def _pairs_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of accounts of different platforms that agree in ``keys``."""
    other = df.select(*keys, F.col("actor_id").alias("_b"), F.col("primary_platform").alias("_p"))
    joined = df.join(other, keys).filter((F.col("primary_platform") != F.col("_p")) & (F.col("actor_id") < F.col("_b")))
    return joined.select(F.col("actor_id").alias("actor_a"), F.col("_b").alias("actor_b"))


def on_several_platforms(actors: DataFrame) -> DataFrame:
    """Accounts whose name (any case) is held on more than one platform."""
    named = actors.filter(F.coalesce("username", F.lit("")) != "").withColumn("_name", F.lower("username"))
    shared = named.groupBy("_name").agg(F.min("primary_platform").alias("_p"), F.max("primary_platform").alias("_q")).filter("_p <> _q")
    return named.join(shared.select("_name"), "_name", "left_semi").drop("_name")


def account_groups(actors: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """actor_id, head: accounts that are alike in all that a score looks at - name, platform, biography, hours, topics and shared
    content (``hashes``: actor_id, hash) - are one group under its smallest account. Accounts without a name are in none.

    A name held by very many accounts ("anonymous") is mostly held by alike ones. What holds for two heads holds for all accounts of
    their groups, so groups are paired and scored once, at every size, and no pair of accounts is made for it.
    """
    named = actors.filter(F.coalesce("username", F.lit("")) != "").select(
        "actor_id", F.lower("username").alias("_name"), "username", "primary_platform", F.to_json(F.struct(
            "bio", F.array_sort("active_hours").alias("h"), F.array_sort("primary_topics").alias("t"))).alias("_profile"),
    )
    if hashes is not None:
        # Two numbers for each hash go through the shuffles, not its 64 letters.
        own = hashes.select("actor_id", *(F.xxhash64("hash", F.lit(k)).alias(f"_h{k}") for k in (0, 1))).distinct()
        contents = own.groupBy("actor_id").agg(F.concat_ws("/", F.count("*"), *(F.bit_xor(f"_h{k}") for k in (0, 1))).alias("_contents"))
        named = named.join(contents, "actor_id", "left")
    else:
        named = named.withColumn("_contents", F.lit(None).cast("string"))
    alike = [F.coalesce(c, F.lit("")).alias(c) for c in ("username", "primary_platform", "_profile", "_contents")]
    named = named.select("actor_id", "_name", *alike)
    keys = ["_name", "username", "primary_platform", "_profile", "_contents"]
    heads = named.groupBy(*keys).agg(F.min("actor_id").alias("head"))
    return named.join(heads, keys).select("actor_id", "head")


def group_pairs(actors: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of heads of different platforms with the same name (any case)."""
    heads = groups.filter(F.col("actor_id") == F.col("head")).select("actor_id")
    named = actors.join(heads, "actor_id").select(F.lower("username").alias("_name"), "actor_id", "primary_platform")
    return _pairs_on(named, ["_name"])


def expanded(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of heads as pairs of all their accounts; further columns are kept."""
    rest = [c for c in pairs.columns if c not in ("actor_a", "actor_b")]
    of_a = groups.select(F.col("head").alias("actor_a"), F.col("actor_id").alias("_a"))
    of_b = groups.select(F.col("head").alias("actor_b"), F.col("actor_id").alias("_b"))
    return pairs.join(of_a, "actor_a").join(of_b, "actor_b").select(*_ordered("_a", "_b"), *rest)


def candidates_by_username(actors: DataFrame, links: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Accounts of different platforms with the same name (any case) that are not linked yet, one row for each pair.

    That is the product of a crowded name's groups; ``linked_accounts`` follows the same rule without it.
    """
    named = actors.filter(F.coalesce("username", F.lit("")) != "").select(F.lower("username").alias("_name"), "actor_id", "primary_platform")
    pairs = _not_linked(_pairs_on(named, ["_name"]).distinct(), links)
    return pairs if limit is None else pairs.orderBy("actor_a", "actor_b").limit(limit)


def linked_accounts(
    actors: DataFrame, hashes: DataFrame | None = None, min_confidence: float = LINK_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """(links between heads with accounts_a and accounts_b, the sizes of their groups; account_groups): the links of all pairs of accounts
    of one name, as many rows as there are pairs of different profiles. ``expanded`` gives the pairs of accounts.

    A name of a single platform makes no pair, so only accounts of the other names are in groups; their hashes are made and written
    once, and no other account's are made at all."""
    actors = cut_lineage(on_several_platforms(actors))
    if hashes is not None:
        hashes = cut_lineage(hashes.join(actors.select("actor_id").distinct(), "actor_id", "left_semi"))
    groups = cut_lineage(account_groups(actors, hashes))
    links = score_identity(group_pairs(actors, groups), actors, hashes, min_confidence=min_confidence)
    sizes = groups.groupBy("head").agg(F.count("*").alias("_n"))
    size_of = lambda side: sizes.select(F.col("head").alias(f"actor_{side}"), F.col("_n").alias(f"accounts_{side}"))
    return links.join(size_of("a"), "actor_a").join(size_of("b"), "actor_b"), groups


def candidates_by_bio(actors: DataFrame, links: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Accounts whose biography names the other account, not linked yet.

    A biography names an account by a platform's own pattern (link or handle), by the bare name as a word, or by the
    other platform's name where the two names agree up to separators. All three are equi-joins on the name.
    """
    writers = actors.filter(F.coalesce("bio", F.lit("")) != "")
    handles = [F.transform(bio_handles("bio", p), lambda h: F.struct(F.lit(p).alias("_p"), h.alias("_h"))) for p in BIO_PATTERNS]
    patterned = writers.select("actor_id", F.col("primary_platform").alias("_own"), F.inline(F.concat(*handles)))
    targets = actors.select(
        F.col("actor_id").alias("_other"), F.col("primary_platform").alias("_tp"), account_name("username").alias("_tn")
    ).filter(F.coalesce("_tn", F.lit("")) != "")
    by_handle = patterned.filter(F.col("_h") != "").join(
        targets, (F.col("_p") == F.col("_tp")) & (F.col("_h") == F.col("_tn"))
    ).filter(F.col("_own") != F.col("_tp"))
    tokens = F.array_distinct(F.split(F.lower("bio"), r"(?U)[^\w.\-]+"))
    by_word = writers.select("actor_id", F.col("primary_platform").alias("_own"), F.explode(tokens).alias("_w")).join(
        targets, F.col("_w") == F.col("_tn")
    ).filter(F.col("_own") != F.col("_tp"))
    bare = F.regexp_replace(account_name("username"), r"[_\-.]", "")
    by_platform = writers.select(
        "actor_id", F.col("primary_platform").alias("_own"), F.lower("bio").alias("_bio"), bare.alias("_bare")
    ).filter(F.col("_bare") != "").join(
        targets.withColumn("_tb", F.regexp_replace("_tn", r"[_\-.]", "")), F.col("_bare") == F.col("_tb")
    ).filter((F.col("_own") != F.col("_tp")) & F.col("_bio").contains(F.lower("_tp")))
    found = reduce(DataFrame.unionByName, [d.select("actor_id", "_other") for d in (by_handle, by_word, by_platform)])
    pairs = _not_linked(found.filter(F.col("actor_id") != F.col("_other")).select(*_ordered("actor_id", "_other")).distinct(), links)
    return pairs if limit is None else pairs.orderBy("actor_a", "actor_b").limit(limit)


def _grams(text: str, size: int) -> Column:
    """All pieces of ``size`` characters, in one pass over the text; none of a shorter one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Which of ``names`` (name) each of ``texts`` (key, text) holds, inside words too: key, name, one row each.

    A name meets only texts that hold its rarest piece of GRAM characters (a shorter name is its own piece), so a piece that is in very
    many texts is looked at for no name that has another; whether the text holds the whole name is checked then. Empty names are in
    no text.
    """
    names = names.filter(F.col("name") != "").select("name").distinct()
    sizes = range(1, GRAM + 1)
    of_texts = texts.select("key", F.explode(F.array_distinct(F.concat(*[_grams("text", q) for q in sizes]))).alias("gram"))
    size = F.least(F.length("name"), F.lit(GRAM))
    pieces = reduce(lambda rest, q: F.when(size == q, _grams("name", q)).otherwise(rest), sizes, F.array().cast("array<string>"))
    of_names = cut_lineage(names.select("name", F.explode(F.array_distinct(pieces)).alias("gram")))
    counts = of_texts.join(of_names.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = of_names.join(counts, "gram", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_g")
    ).filter(F.col("_g.n") > 0).select("name", F.col("_g.gram").alias("gram"))
    met = of_texts.join(rarest, "gram").select("key", "name")
    return met.join(texts, "key").filter(F.contains("text", "name")).select("key", "name")


def _named(actors: DataFrame, names: DataFrame) -> DataFrame:
    """actor_id, _own, name: accounts whose biography holds a name. Equal biographies are looked at once."""
    text = F.lower("bio")
    writers = actors.filter(F.coalesce("bio", F.lit("")) != "").select("actor_id", F.col("primary_platform").alias("_own"), F.sha2(text, 256).alias("key"), text.alias("text"))
    found = contained(cut_lineage(writers.groupBy("key").agg(F.first("text").alias("text"))), names)
    return writers.drop("text").join(found, "key").drop("key")


def candidates_by_mention(actors: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Accounts of different platforms of which one's biography holds the other's name (any case, as it is written, inside words
    too), not linked yet, one row for each pair. Accounts without a name are named by none."""
    names = actors.select(F.lower("username").alias("name"), F.col("actor_id").alias("_other"), F.col("primary_platform").alias("_p"))
    found = _named(actors, names).join(names, "name").filter((F.col("_own") != F.col("_p")) & (F.col("actor_id") != F.col("_other")))
    return _not_linked(found.select(*_ordered("actor_id", "_other")).distinct(), links)


def platform_mentions(actors: DataFrame) -> DataFrame:
    """actor_id, platform: other platforms that an account's biography names.

    Each row stands for a candidate with every account of that platform, which is a product and is not made here: next to what
    other rules find, a score can only reach the threshold for accounts that share contents or a name. ``mentioned_pairs`` picks these.
    """
    platforms = actors.select("primary_platform", F.lower("primary_platform").alias("name")).distinct()
    found = _named(actors, platforms).join(platforms, "name").filter(F.col("_own") != F.col("primary_platform"))
    return found.select("actor_id", F.col("primary_platform").alias("platform")).distinct()


def mentioned_pairs(pairs: DataFrame, actors: DataFrame) -> DataFrame:
    """Of given pairs, those in which one account's biography names the other's platform."""
    named = platform_mentions(actors).withColumn("_named", F.lit(True))
    on = actors.select("actor_id", "primary_platform")
    out = pairs
    for side, other in (("actor_a", "actor_b"), ("actor_b", "actor_a")):
        at = on.select(F.col("actor_id").alias(other), F.col("primary_platform").alias("_at"))
        named_here = named.select(F.col("actor_id").alias(side), F.col("platform").alias("_at"), F.col("_named").alias(f"_by_{side}"))
        out = out.join(at, other).join(named_here, [side, "_at"], "left").drop("_at")
    return out.filter(F.coalesce("_by_actor_a", "_by_actor_b").isNotNull()).select(*pairs.columns)


def fuzzy_candidates(actors: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Optional rule: names of different platforms that agree without separators."""
    bare = F.regexp_replace(account_name("username"), r"[_\-.]", "")
    named = actors.select("actor_id", "primary_platform", bare.alias("_bare")).filter(F.col("_bare") != "")
    return _not_linked(_pairs_on(named, ["_bare"]), links)


def candidate_pairs(*sources: DataFrame) -> DataFrame:
    """Union of candidate lists, each unordered pair once."""
    every = reduce(DataFrame.unionByName, [s.select("actor_a", "actor_b") for s in sources])
    return every.select(*_ordered("actor_a", "actor_b")).distinct()


def content_hashes(posts: DataFrame, keep: int = HASHES_KEPT) -> DataFrame:
    """Hashes of each account's last ``keep`` texts (case and white space ignored): actor_id, hash."""
    normal = F.array_join(words(F.lower(strip("text"))), " ")
    recent = top_per_group(
        posts.filter(F.coalesce("text", F.lit("")) != ""), ["actor_id"], [F.desc("created_at"), F.desc("content_id")], keep
    )
    return recent.select("actor_id", F.sha2(normal, 256).alias("hash")).distinct()


def content_fingerprints(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Shared hashes of each candidate pair. Only the given pairs are looked at, so a text copied by very many
    accounts costs no more than any other. Hashes of the pairs' accounts are written once and read for both sides."""
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.explode(F.array("actor_a", "actor_b")).alias("actor_id")).distinct()
    own = cut_lineage(hashes.join(ends, "actor_id", "left_semi"))
    a = pairs.join(own.withColumnRenamed("actor_id", "actor_a"), "actor_a")
    both = a.join(own.withColumnRenamed("actor_id", "actor_b"), ["actor_b", "hash"])
    return both.groupBy("actor_a", "actor_b").agg(F.count("*").alias("shared_hashes"))


def score_pairs(pairs: DataFrame, actors: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Scores of the four methods for every pair of different platforms."""
    if hashes is not None:
        pairs = cut_lineage(pairs)  # read more than once below; finding candidates is the dear part
    needed = ["actor_id", "primary_platform", "username", "bio", "active_hours", "primary_topics"]
    a = actors.select(*[F.col(c).alias(f"a_{c}") for c in needed])
    b = actors.select(*[F.col(c).alias(f"b_{c}") for c in needed])
    both = pairs.join(a, F.col("actor_a") == F.col("a_actor_id")).join(b, F.col("actor_b") == F.col("b_actor_id"))
    both = both.filter(F.col("a_primary_platform") != F.col("b_primary_platform"))
    if hashes is not None:
        both = both.join(content_fingerprints(pairs, hashes), ["actor_a", "actor_b"], "left")
    else:
        both = both.withColumn("shared_hashes", F.lit(0))
    bio = F.greatest(
        bio_score("a_bio", "b_primary_platform", "b_username"), bio_score("b_bio", "a_primary_platform", "a_username")
    )
    return both.select(
        "actor_a", "actor_b", F.col("a_primary_platform").alias("platform_a"), F.col("b_primary_platform").alias("platform_b"),
        username_score("a_username", "b_username").alias("username_matching"),
        bio.alias("bio_cross_reference"),
        fingerprint_score("shared_hashes").alias("content_fingerprinting"),
        behavior_score("a_active_hours", "b_active_hours", "a_primary_topics", "b_primary_topics").alias("behavioral_fingerprinting"),
    )


METHODS = ("username_matching", "bio_cross_reference", "content_fingerprinting", "behavioral_fingerprinting")


def score_identity(
    pairs: DataFrame, actors: DataFrame, hashes: DataFrame | None = None, as_of: AsOf | None = None,
    min_confidence: float = LINK_CONFIDENCE,
) -> DataFrame:
    """Links: pairs whose methods together reach the threshold, with the evidence of each method."""
    scored = score_pairs(pairs, actors, hashes).withColumn("_c", noisy_or(F.array(*METHODS))).filter(F.col("_c") >= min_confidence)
    evidence = F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 4).alias("confidence")) for m in METHODS])
    out = scored.select(
        "actor_a", "actor_b", "platform_a", "platform_b", F.round("_c", 4).alias("confidence"),
        F.filter(evidence, lambda e: e["confidence"] > 0).alias("methods"),
    )
    if as_of is not None:
        out = out.withColumn("created_at", instant(as_of)).withColumn("id", row_key("actor_a", "actor_b"))
    return out


def link_edges(links: DataFrame) -> DataFrame:
    """SAME_PERSON edges of the links."""
    return links.select(
        F.col("actor_a").alias("src"), F.col("actor_b").alias("dst"), F.lit("SAME_PERSON").alias("edge_type"), "confidence",
        F.to_json("methods").alias("methods"),
    )
