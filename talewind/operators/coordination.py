"""Signals of coordinated or automated behaviour.

Posts: narrative_id, actor_id, platform, content_id, created_at. Edges: src, dst, edge_type, interaction_count.
A detector returns one row per signal; the accounts of a signal are a second, long table (signal_id, actor_id), so
that a signal of any size stays a table and never becomes one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import row_key
from talewind.functions.times import AsOf, instant, micros, since
from talewind.operators.skew import SLICE, running_sum, top_per_group, with_previous
from talewind.session import cut_lineage

BURST_SECONDS, BURST_AUTHORS, BURST_DENSITY = 120, 10, 0.1
WINDOWS_TRIED = 4
HISTORY, HISTORY_MIN, TIMES_MIN, GAPS_MIN = 100, 20, 10, 5
REGULAR_CV, REGULAR_MEAN = 0.3, 3600
DIVERSITY_CLASSES, DIVERSITY_ENTROPY = 3, 0.3
FRESH_DAYS, FRESH_POSTS, FRESH_ACCOUNTS = 7, 3, 5
STAR_LEAVES, STAR_REPOSTS, STAR_CONNECTIVITY = 10, 20, 0.1


# --- bursts -----------------------------------------------------------------------------------------------------------

def active_spells(posts: DataFrame, window_seconds: int = BURST_SECONDS) -> DataFrame:
    """Per (narrative, author) the spells [start, end] in which the author counts for the trailing window.

    An author counts at time t when it posted in [t - window, t]; posts closer than the window merge into one spell.
    """
    width = window_seconds * 1_000_000
    keys = ["narrative_id", "actor_id"]
    times = posts.select(*keys, micros("created_at").alias("_us")).distinct()
    gaps = with_previous(times, keys, "_us", ["_us"], {"_prev": "_us"})
    opening = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > width), 1).otherwise(0)
    numbered = running_sum(gaps.withColumn("_new", opening), keys, "_us", ["_us"], {"_spell": "_new"})
    return numbered.groupBy(*keys, "_spell").agg(
        F.min("_us").alias("start"), (F.max("_us") + width).alias("end")
    ).drop("_spell")


def _swept(posts: DataFrame, spells: DataFrame, marks: dict[str, DataFrame]) -> DataFrame:
    """Running counts at every post time: ``marks`` maps a name to spells (narrative_id, start, end) that count from start to end."""
    names = list(marks)
    none = {name: F.lit(0) for name in names}
    parts = [posts.select("narrative_id", micros("created_at").alias("window_end"), *[c.alias(n) for n, c in none.items()], F.lit(1).alias("posted"))]
    for name, of in marks.items():
        for at, step in ((F.col("start"), 1), (F.col("end") + 1, -1)):
            own = {**none, name: F.lit(step)}
            parts.append(of.select("narrative_id", at.alias("window_end"), *[c.alias(n) for n, c in own.items()], F.lit(0).alias("posted")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    steps = every.groupBy("narrative_id", "window_end").agg(*[F.sum(n).alias(f"_{n}") for n in names], F.max("posted").alias("posted"))
    swept = running_sum(steps, ["narrative_id"], "window_end", ["window_end"], {n: f"_{n}" for n in names})
    return swept.filter(F.col("posted") == 1).select("narrative_id", "window_end", *names)


def burst_windows(posts: DataFrame, window_seconds: int = BURST_SECONDS, min_authors: int = BURST_AUTHORS) -> DataFrame:
    """Every post time at which the trailing window holds at least ``min_authors`` distinct authors:
    narrative_id, window_end (epoch microseconds), authors.

    Distinct authors are counted by sweeping spell starts (+1) and ends (-1), a running sum per narrative: no author
    set is ever collected, and a narrative of any size is cut into time slices.
    """
    spells = active_spells(posts, window_seconds)
    return _swept(posts, spells, {"authors": spells}).filter(F.col("authors") >= min_authors)


def linked_spells(spells: DataFrame, edges: DataFrame) -> DataFrame:
    """When both accounts of an edge are in a spell of one narrative: narrative_id, start, end. Spells meet by day, so that an
    account's spells are not all held against another's."""
    pairs = edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    day = lambda c: F.floor(F.col(c) / SLICE)
    daily = spells.withColumn("_day", F.explode(F.sequence(day("start"), day("end"))))
    one = daily.select("narrative_id", "_day", F.col("actor_id").alias("a"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    other = daily.select("narrative_id", "_day", F.col("actor_id").alias("b"), "start", "end")
    met = one.join(pairs, "a").join(other, ["narrative_id", "_day", "b"])
    both = met.select("narrative_id", "_day", F.greatest("_s", "start").alias("start"), F.least("_e", "end").alias("end"))
    return both.filter((F.col("start") <= F.col("end")) & (day("start") == F.col("_day"))).drop("_day")


def burst_peaks(windows: DataFrame) -> DataFrame:
    """Strongest window per narrative, the earliest of equals."""
    return windows.groupBy("narrative_id").agg(
        F.max("authors").alias("authors"), F.min_by("window_end", F.struct(-F.col("authors"), "window_end")).alias("window_end")
    )


def burst_members(posts: DataFrame, peaks: DataFrame, window_seconds: int = BURST_SECONDS) -> DataFrame:
    """Authors of each window: narrative_id, window_end, actor_id."""
    width = window_seconds * 1_000_000
    us = micros("created_at")
    timed = posts.select("narrative_id", "actor_id", us.alias("_us"))
    inside = timed.join(peaks.select("narrative_id", "window_end"), "narrative_id").filter(
        F.col("_us").between(F.col("window_end") - width, F.col("window_end"))
    )
    return inside.select("narrative_id", "window_end", "actor_id").distinct()


def connection_density(members: DataFrame, edges: DataFrame, set_keys: Sequence[str]) -> DataFrame:
    """Per account set: size, distinct unordered pairs joined by an edge, and their share of all pairs.

    ``members``: set keys and actor_id, one row per account. Edges are followed from the members (two equi-joins);
    the pairs of a set are never enumerated.
    """
    keys = list(set_keys)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("accounts"))
    pairs = edges.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).distinct()
    near = members.withColumnRenamed("actor_id", "a").join(pairs, "a")
    inside = near.join(members.withColumnRenamed("actor_id", "b"), [*keys, "b"], "left_semi")
    linked = inside.groupBy(*keys).agg(F.count("*").alias("linked_pairs"))
    possible = F.col("accounts") * (F.col("accounts") - 1) / 2
    return sizes.join(linked, keys, "left").select(
        *keys, "accounts", F.coalesce("linked_pairs", F.lit(0)).alias("linked_pairs"),
        F.coalesce(F.when(possible > 0, F.coalesce("linked_pairs", F.lit(0)) / possible), F.lit(0.0)).alias("density"),
    )


def _linked_at(windows: DataFrame, spells: DataFrame, edges: DataFrame) -> DataFrame:
    """Linked pairs among the authors of each of some windows: narrative_id, window_end, linked."""
    at = windows.select("narrative_id", "window_end")
    inside = spells.join(at, "narrative_id").filter(F.col("window_end").between(F.col("start"), F.col("end")))
    members = cut_lineage(inside.select("narrative_id", "window_end", "actor_id").distinct())
    present = members.select("actor_id").distinct()
    # Only edges between authors of the windows are told apart.
    near = edges.select("src", "dst")
    for end in ("src", "dst"):
        near = near.join(present.withColumnRenamed("actor_id", end), end, "left_semi")
    density = connection_density(members, near, ["narrative_id", "window_end"])
    return density.select("narrative_id", "window_end", F.col("linked_pairs").alias("linked"))


def _sparse(windows: DataFrame, linked: DataFrame, max_density: float) -> DataFrame:
    """Windows (narrative_id, window_end, authors) of less than ``max_density``, with it."""
    of = windows.select("narrative_id", "window_end", "authors").join(linked, ["narrative_id", "window_end"], "left")
    density = F.coalesce("linked", F.lit(0)) / (F.col("authors") * (F.col("authors") - 1) / 2)
    rated = of.withColumn("density", F.coalesce(F.when(F.col("authors") > 1, density), F.lit(0.0)))
    return rated.filter(F.col("density") < max_density).drop("linked")


def _first_of(windows: DataFrame) -> DataFrame:
    rest = F.struct("window_end", "authors", "density")
    return windows.groupBy("narrative_id").agg(F.min_by(rest, F.struct(-F.col("authors"), "window_end")).alias("_b"))


def temporal_burst(
    posts: DataFrame, edges: DataFrame, window_seconds: int = BURST_SECONDS, min_authors: int = BURST_AUTHORS,
    max_density: float = BURST_DENSITY,
) -> DataFrame:
    """Strongest burst per narrative by authors that are hardly connected. Density is judged at every window that may be the answer, so
    a burst of connected authors hides no other.

    The answer is a narrative's first sparse window in order of authors. The first ``WINDOWS_TRIED`` of each narrative are judged by
    their own authors; where all are dense, linked pairs are counted at all windows, by the same sweep as authors."""
    spells = cut_lineage(active_spells(posts, window_seconds))
    windows = cut_lineage(_swept(posts, spells, {"authors": spells}).filter(F.col("authors") >= min_authors))
    first = top_per_group(windows, ["narrative_id"], [F.desc("authors"), F.asc("window_end")], WINDOWS_TRIED).drop("rank")
    tried = cut_lineage(_sparse(first, _linked_at(first, spells, edges), max_density))
    open_ = cut_lineage(windows.select("narrative_id").distinct().join(tried.select("narrative_id").distinct(), "narrative_id", "left_anti"))
    best = _first_of(tried)
    if not open_.isEmpty():
        rest = spells.join(open_, "narrative_id", "left_semi")
        swept = _swept(posts.join(open_, "narrative_id", "left_semi"), rest, {"authors": rest, "linked": linked_spells(rest, edges)})
        scored = swept.filter(F.col("authors") >= min_authors)
        best = best.unionByName(_first_of(_sparse(scored, scored.select("narrative_id", "window_end", "linked"), max_density)))
    return best.select(
        "narrative_id", "_b.*", F.least(F.lit(0.95), 0.5 + (F.col("_b.authors") - min_authors) * 0.05).alias("confidence")
    )


# --- posting habits ---------------------------------------------------------------------------------------------------

def recent_history(posts: DataFrame, length: int = HISTORY) -> DataFrame:
    """The ``length`` posts before the latest one of every author, newest first (``rank`` 1 is the one just before)."""
    order = [F.desc("created_at"), F.desc("content_id")]
    latest = top_per_group(posts, ["actor_id"], order, length + 1)
    return latest.filter(F.col("rank") > 1).withColumn("rank", F.col("rank") - 1)


def posting_intervals(history: DataFrame) -> DataFrame:
    """Per author: posts, positive gaps, their mean, population deviation and the ratio of the two.

    A history is at most ``HISTORY`` rows, so its times fit one sorted array.
    """
    times = history.groupBy("actor_id").agg(
        F.count("*").alias("posts"), F.sort_array(F.collect_list(micros("created_at"))).alias("_t")
    )
    gap = F.zip_with(
        F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda a, b: (b - a) / 1_000_000
    )
    gaps = times.filter(F.col("posts") > 1).select("actor_id", "posts", F.explode(gap).alias("_gap"))
    positive = F.when(F.col("_gap") > 0, F.col("_gap"))
    return gaps.groupBy("actor_id").agg(
        F.max("posts").alias("posts"), F.count(positive).alias("gaps"), F.avg(positive).alias("mean_gap"),
        F.stddev_pop(positive).alias("gap_deviation"),
    ).withColumn("cv", F.coalesce(F.col("gap_deviation") / F.nullif(F.col("mean_gap"), F.lit(0.0)), F.lit(0.0)))


def posting_regularity(posts: DataFrame, max_cv: float = REGULAR_CV, max_mean: float = REGULAR_MEAN) -> DataFrame:
    """Authors that post like a clock."""
    stats = posting_intervals(recent_history(posts))
    enough = (F.col("posts") >= HISTORY_MIN) & (F.col("posts") >= TIMES_MIN) & (F.col("gaps") >= GAPS_MIN)
    regular = stats.filter(enough & (F.col("cv") < max_cv) & (F.col("mean_gap") < max_mean))
    return regular.select(
        "actor_id", "gaps", F.round("cv", 4).alias("cv"), F.round("mean_gap", 1).alias("mean_gap"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.9 - F.col("cv") * 2)).alias("confidence"),
    )


def narrative_entropy(posts: DataFrame) -> DataFrame:
    """Per author with a long enough history, with enough positive gaps in it: classes, posts and normalised entropy of its
    narratives."""
    history = recent_history(posts)
    sizes = history.groupBy("actor_id").agg(F.count("*").alias("history"))
    counts = history.filter(F.col("narrative_id").isNotNull()).groupBy("actor_id", "narrative_id").agg(F.count("*").alias("n"))
    # Entropy from sums: H = log2(N) - sum(n log2 n) / N.
    sums = counts.groupBy("actor_id").agg(
        F.count("*").alias("narratives"), F.sum("n").alias("posts"), F.sum(F.col("n") * F.log2("n")).alias("_nlogn")
    )
    entropy = (F.log2("posts") - F.col("_nlogn") / F.col("posts")) / F.log2("narratives")
    steady = posting_intervals(history).filter((F.col("posts") >= TIMES_MIN) & (F.col("gaps") >= GAPS_MIN)).select("actor_id")
    long = sums.join(sizes, "actor_id").filter((F.col("history") >= HISTORY_MIN) & (F.col("narratives") >= DIVERSITY_CLASSES))
    rich = long.join(steady, "actor_id", "left_semi")
    return rich.select("actor_id", "narratives", "posts", F.greatest(F.lit(0.0), entropy).alias("entropy"))


def content_diversity(posts: DataFrame, max_entropy: float = DIVERSITY_ENTROPY) -> DataFrame:
    """Authors that push few of the narratives they touch."""
    narrow = narrative_entropy(posts).filter(F.col("entropy") < max_entropy)
    return narrow.select(
        "actor_id", "narratives", "posts", F.round("entropy", 4).alias("entropy"),
        F.round(0.7 - F.col("entropy"), 3).alias("confidence"),
    )


# --- swarms and stars -------------------------------------------------------------------------------------------------

def fresh_accounts(actors: DataFrame, as_of: AsOf, days: int = FRESH_DAYS, min_posts: int = FRESH_POSTS) -> DataFrame:
    young = since("first_seen", as_of, days=days) & (F.col("first_seen") <= instant(as_of))
    return actors.filter(young & (F.col("content_count") >= min_posts)).select("actor_id")


def fresh_account_swarm(
    actors: DataFrame, participation: DataFrame, as_of: AsOf, days: int = FRESH_DAYS, min_posts: int = FRESH_POSTS,
    min_accounts: int = FRESH_ACCOUNTS,
) -> DataFrame:
    """Narratives taken up by many new accounts. ``participation``: narrative_id, actor_id. The accounts themselves:
    ``fresh_accounts`` joined with the participation."""
    fresh = fresh_accounts(actors, as_of, days, min_posts)
    taken = participation.select("narrative_id", "actor_id").distinct().join(fresh, "actor_id", "left_semi")
    swarm = taken.groupBy("narrative_id").agg(F.count("*").alias("accounts")).filter(F.col("accounts") >= min_accounts)
    return swarm.withColumn("confidence", F.least(F.lit(0.90), 0.5 + (F.col("accounts") - min_accounts) * 0.05))


def star_topology(
    edges: DataFrame, min_leaves: int = STAR_LEAVES, min_reposts: int = STAR_REPOSTS,
    max_connectivity: float = STAR_CONNECTIVITY, repost_type: str = "REPOSTED", limit: int | None = None,
) -> DataFrame:
    """Hubs reposted by many accounts that hardly touch one another. ``edges`` are merged edges, which are written once here."""
    edges, leaves = _written_leaves(edges, repost_type)
    out = _stars(edges, leaves, min_leaves, min_reposts, max_connectivity)
    return out if limit is None else out.orderBy(F.desc("confidence"), F.desc("repost_count"), "hub").limit(limit)


def stars_and_accounts(
    edges: DataFrame, min_leaves: int = STAR_LEAVES, min_reposts: int = STAR_REPOSTS, max_connectivity: float = STAR_CONNECTIVITY,
    repost_type: str = "REPOSTED",
) -> tuple[DataFrame, DataFrame]:
    """The stars of ``star_topology`` and their accounts as in ``star_accounts``; the edges are written and looked at once for both."""
    edges, leaves = _written_leaves(edges, repost_type)
    stars = cut_lineage(_stars(edges, leaves, min_leaves, min_reposts, max_connectivity))
    return stars, _with_centres(leaves.select("hub", "actor_id"), stars.select("hub"))


def _written_leaves(edges: DataFrame, repost_type: str) -> tuple[DataFrame, DataFrame]:
    """Edges, and who reposted whom (hub, actor_id) how often (reposts), each written once."""
    edges = cut_lineage(edges.select("src", "dst", "edge_type", "interaction_count"))
    reposts = edges.filter((F.col("edge_type") == repost_type) & (F.col("src") != F.col("dst")))
    leaves = reposts.groupBy(F.col("dst").alias("hub"), F.col("src").alias("actor_id")).agg(F.sum("interaction_count").alias("reposts"))
    return edges, cut_lineage(leaves)


def _stars(edges: DataFrame, leaves: DataFrame, min_leaves: int, min_reposts: int, max_connectivity: float) -> DataFrame:
    hubs = cut_lineage(leaves.groupBy("hub").agg(F.count("*").alias("leaf_count"), F.sum("reposts").alias("repost_count")).filter(
        (F.col("leaf_count") >= min_leaves) & (F.col("repost_count") >= min_reposts)
    ))
    leaves = leaves.select("hub", "actor_id").join(hubs, "hub", "left_semi")
    links = edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    # An edge to an account that is no hub's leaf joins no two leaves. Such accounts are found among the ends of edges, and written, so
    # that edges and leaves are moved only where many are left.
    ends = cut_lineage(links.select("dst").distinct().join(leaves.select(F.col("actor_id").alias("dst")), "dst", "left_semi"))
    links = cut_lineage(links.join(ends, "dst", "left_semi"))
    near = leaves.withColumnRenamed("actor_id", "src").join(links, "src")
    between = near.join(leaves.withColumnRenamed("actor_id", "dst"), ["hub", "dst"], "left_semi")
    # Every stored edge is met once from either end.
    linked = between.groupBy("hub").agg((F.count("*") * 2).alias("leaf_links"))
    possible = F.col("leaf_count") * (F.col("leaf_count") - 1) / 2
    scored = hubs.join(linked, "hub", "left").withColumn("leaf_links", F.coalesce("leaf_links", F.lit(0)))
    scored = scored.withColumn("leaf_connectivity", F.coalesce(F.col("leaf_links") / F.nullif(possible, F.lit(0.0)), F.lit(0.0)))
    stars = scored.filter((F.col("leaf_links") < F.col("leaf_count")) & (F.col("leaf_connectivity") < max_connectivity))
    return stars.select(
        "hub", "leaf_count", "repost_count", "leaf_links", F.round("leaf_connectivity", 4).alias("leaf_connectivity"),
        F.least(F.lit(0.90), 0.6 + (F.col("leaf_count") - min_leaves) * 0.02).alias("confidence"),
    )


def star_accounts(edges: DataFrame, stars: DataFrame, repost_type: str = "REPOSTED") -> DataFrame:
    """All accounts of each star: hub, actor_id, role (hub or leaf). ``edges`` are the merged edges that ``stars`` were found in."""
    reposts = edges.filter((F.col("edge_type") == repost_type) & (F.col("src") != F.col("dst")))
    leaves = reposts.select(F.col("dst").alias("hub"), F.col("src").alias("actor_id")).distinct()
    return _with_centres(leaves, stars.select("hub").distinct())


def _with_centres(leaves: DataFrame, hubs: DataFrame) -> DataFrame:
    centres = hubs.select("hub", F.col("hub").alias("actor_id"), F.lit("hub").alias("role"))
    return leaves.join(hubs, "hub", "left_semi").withColumn("role", F.lit("leaf")).unionByName(centres)


# --- signal tables ----------------------------------------------------------------------------------------------------

def as_signals(
    df: DataFrame, signal_type: str, detected_at: Column | AsOf, evidence: Sequence[str], narrative: str | None = None,
    platform: str | None = None, key: Sequence[str] = (),
) -> DataFrame:
    """Detector output as signal rows: signal_id, type, narrative_id, platform, confidence, evidence, detected_at."""
    facts = [x for name in evidence for x in (F.lit(name), F.col(name).cast("string"))]
    return df.select(
        row_key(F.lit(signal_type), *key).alias("signal_id"),
        F.lit(signal_type).alias("type"),
        (F.col(narrative) if narrative else F.lit(None)).cast("string").alias("narrative_id"),
        (F.col(platform) if platform else F.lit(None)).cast("string").alias("platform"),
        F.col("confidence").cast("double").alias("confidence"),
        F.create_map(*facts).alias("evidence"),
        instant(detected_at).alias("detected_at"),
    )


def as_signal_accounts(df: DataFrame, signal_type: str, key: Sequence[str], actor: str = "actor_id") -> DataFrame:
    """Accounts of signals as rows: signal_id, actor_id. ``df`` has a row for each account, with the key columns that
    ``as_signals`` made the signal's id from."""
    return df.select(row_key(F.lit(signal_type), *key).alias("signal_id"), F.col(actor).alias("actor_id")).distinct()


def recent_signals(signals: DataFrame, as_of: AsOf, hours: int = 48) -> DataFrame:
    return signals.filter(since("detected_at", as_of, hours=hours) & (F.col("detected_at") <= instant(as_of)))


def signal_graph(signal_accounts: DataFrame) -> DataFrame:
    """Edges that connect the accounts of each signal: from its smallest account to every other one.

    The star gives the same components as all pairs, in linear size.
    """
    first = signal_accounts.groupBy("signal_id").agg(F.min("actor_id").alias("src"))
    spokes = signal_accounts.join(first, "signal_id").filter(F.col("actor_id") != F.col("src"))
    return spokes.select("src", F.col("actor_id").alias("dst"), "signal_id").distinct()


def cluster_reach(members: DataFrame, actors: DataFrame, set_keys: Sequence[str]) -> DataFrame:
    """Followers of each account set; unknown counts as 0."""
    followers = actors.select("actor_id", "follower_count")
    joined = members.join(followers, "actor_id", "left")
    return joined.groupBy(*set_keys).agg(F.sum(F.coalesce("follower_count", F.lit(0))).alias("estimated_reach"))


def cluster_alerts(clusters: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """Alert rows of clusters worth telling."""
    return clusters.filter(F.col("confidence") > min_confidence).select(
        "cluster_id", "confidence", "account_count", "signal_types", "severity"
    )


def tag_cluster_members(actors: DataFrame, members: DataFrame) -> DataFrame:
    """Actors with the id of their cluster. ``members``: cluster_id, actor_id."""
    tags = members.select("actor_id", F.col("cluster_id").alias("coordination_cluster_id"))
    return actors.join(tags, "actor_id", "left")
