"""Names and platforms inside biographies, held against a loop over all pairs."""

import random

from talewind.operators import identity as idn

SCHEMA = "actor_id string, primary_platform string, username string, bio string"
PLATFORMS = ("twitter", "reddit", "gab")


def frame(spark, people):
    return spark.createDataFrame(people, SCHEMA)


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def by_name(people):
    out = set()
    for a, p, _, bio in people:
        for b, q, name, _ in people:
            if a != b and p != q and bio and name and name.lower() in bio.lower():
                out.add((min(a, b), max(a, b)))
    return out


def by_platform(people):
    return {(a, q) for a, p, _, bio in people for q in {x[1] for x in people} if p and q and p != q and bio and q.lower() in bio.lower()}


def drawn(n):
    """Short names over few letters, so that many are inside words of biographies; a third of all hold one biography."""
    deal = random.Random(7)
    word = lambda a, b: "".join(deal.choice("abÄé.") for _ in range(deal.randint(a, b)))
    people = []
    for i in range(n):
        bio = "see AbAb on Reddit" if i % 3 == 0 else " ".join([*(word(1, 6) for _ in range(4)), deal.choice(["", "", "Twitter", "xGABx"])])
        people.append((f"a{i:03}", PLATFORMS[i % 3 - (i % 7 == 0)], word(1, 5), bio))
    return people


def test_names_inside_words(spark):
    people = drawn(150) + [
        ("n1", "gab", None, None), ("n2", "gab", "", ""), ("n3", "reddit", "x", "y" * 100_000 + "nobody_else" + "z" * 50), ("n4", "gab", "Nobody_Else", None),
        ("n5", None, "ab", "reddit abab"), ("n6", "twitter", "%_", "100%_sure"), ("n7", "gab", "%_", ""),
    ]
    actors = frame(spark, people)
    # Without a platform an account is of no other one.
    known = [x for x in people if x[1]]
    want = by_name(known)
    assert got(idn.candidates_by_mention(actors)) == want and ("n3", "n4") in want and ("n6", "n7") in want
    known_links = sorted(want)[::2]
    links = spark.createDataFrame([(b, a) for a, b in known_links], "actor_a string, actor_b string")
    assert got(idn.candidates_by_mention(actors, links)) == want - set(known_links)
    assert got(idn.platform_mentions(actors)) == by_platform(people)


def test_pairs_with_a_named_platform(spark):
    people = drawn(60)
    actors, platform, named = frame(spark, people), {x[0]: x[1] for x in people}, by_platform(people)
    pairs = [(a, b) for a in sorted(platform)[::4] for b in sorted(platform) if a < b]
    want = {(a, b) for a, b in pairs if platform[a] != platform[b] and ((a, platform[b]) in named or (b, platform[a]) in named)}
    found = got(idn.mentioned_pairs(spark.createDataFrame(pairs, "actor_a string, actor_b string"), actors))
    assert found == want and 0 < len(want) < len(pairs)


def test_a_name_meets_only_texts_with_its_rarest_piece(spark):
    texts = spark.createDataFrame([(str(i), "the common start " + ("zq" if i == 5 else "")) for i in range(50)], "key string, text string")
    names = spark.createDataFrame([("start zq",), ("start zz",), ("common",), ("",), (None,), ("qz",)], "name string")
    assert got(idn.contained(texts, names)) == {("5", "start zq")} | {(str(i), "common") for i in range(50)}


def test_empty_tables(spark):
    actors = frame(spark, [])
    assert idn.candidates_by_mention(actors).count() == idn.platform_mentions(actors).count() == 0
