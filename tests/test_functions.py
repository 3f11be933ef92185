"""Scalar functions against exact values."""

import hashlib
import uuid

import numpy as np
from pyspark.sql import functions as F

from talewind.functions import curves, ids, scores, text, times


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def S(x):
    return F.lit(x)


def test_ids_equal_python(spark):
    for platform, who in (("reddit", "Ann"), ("4chan", "é日本"), ("telegram", "-100123")):
        r = one(spark, a=ids.actor_uuid(S(platform), S(who)))
        assert r.a == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{platform}:{who}"))
    r = one(spark, t=ids.trend_id(S("US"), S("Tea"), S("2024-01-02")), n=ids.anon_id(S("Anonymous"), S(None).cast("string")))
    assert r.t == hashlib.sha256(b"gtrends:US:Tea:2024-01-02").hexdigest()[:24]
    assert r.n == hashlib.md5(b"Anonymous:").hexdigest()[:16]


def test_comment_html_and_references(spark):
    html = '<a href="#p1">&gt;&gt;123</a><br>a &amp;lt; b<br/><span class="q">&gt;x</span> &#039;q&#039;  '
    r = one(spark, t=text.clean_comment_html(S(html)), n=text.clean_comment_html(S(None).cast("string")))
    assert r.t == ">>123\na &lt; b\n>x 'q'" and r.n == ""
    r = one(spark, b=text.backlinks(S(">>12 and >>345 >x")), m=text.user_mentions(S("u/ann (/u/Bob) xu/no U/cé")), c=text.cashtags(S("$TSLA $toolow $ABCDEF $A.")))
    assert r.b == ["12", "345"] and r.m == ["u/ann", "u/Bob", "U/cé"] and r.c == ["TSLA", "A"]


def test_traffic_and_small_text_functions(spark):
    for raw, n in (("200K+", 200_000), ("1,000", 1000), ("2M", 2_000_000), ("1.5k", 1500), ("n/a", 0), ("", 0), ("nan", 0)):
        assert one(spark, v=text.parse_traffic(S(raw))).v == n, raw
    r = one(
        spark, w=text.is_high_signal(S("UKRAINE war")), x=text.is_high_signal(S("The NATO")), p=text.is_paywalled(S("https://www.NYTimes.com/a")),
        q=text.is_paywalled(S("not a url")), e=text.excerpt(S("x" * 301)), s=text.excerpt(S("x" * 300)), f=text.metric_family(S("reply")), g=text.metric_family(S("video")),
        r=text.revert_flag(S("Undid: Reverted")), d=text.diff_size(F.lit(None).cast("long"), F.lit(7)), t=text.embedding_text(S("A  b"), S("c\nd e"), 4),
    )
    assert r.w and not r.x and r.p and not r.q and len(r.e) == 303 and len(r.s) == 300 and (r.f, r.g) == ("comments", "posts")
    assert r.r and r.d == -7 and r.t == "A b c d"


def test_username_and_bio_scores(spark):
    for a, b, score in (("Ann", "ann", .60), ("@ann", "ann", .60), ("ann_b", "ann-b", .45), ("annabel", "annabelx", .35), ("ann", "zzzzzz", 0), ("", "x", 0), (None, "x", 0)):
        r = one(spark, v=scores.username_score(F.lit(a).cast("string"), F.lit(b).cast("string")))
        assert abs(r.v - score) < 1e-12, (a, b)
    for bio, platform, name, score in (
        ("find me twitter.com/Ann", "twitter", "@ann", .9), ("I am u/bob", "reddit", "bob", .9), ("@other twitter.com/ann", "twitter", "other", .9), ("nothing", "twitter", "ann", 0), (None, "twitter", "ann", 0),
        ("t.me/ann", "twitter", "ann", 0), ("mail me @first @second", "twitter", "second", 0),
    ):
        assert one(spark, v=scores.bio_score(F.lit(bio).cast("string"), S(platform), S(name))).v == score, bio


def test_behavior_score_bounds(spark):
    h = lambda a, b: F.array(*[F.lit(i) for i in range(a, b)])
    t = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, v=scores.behavior_score(h(9, 15), h(10, 16), t("a", "b", "c"), t("b", "c", "d")), n=scores.behavior_score(F.array().cast("array<int>"), h(1, 3), F.array().cast("array<string>"), t("a")))
    assert abs(r.v - .4 * (.4 * 5 / 7 + .6 * 2 / 4)) < 1e-12 and r.n == 0


def test_small_scores(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(
        spark, n=scores.noisy_or(arr(.5, .5)), e=scores.normalized_entropy(arr(1, 1, 1, 1)), z=scores.normalized_entropy(arr(9)), j=scores.jaccard(F.array(S("a"), S("b")), F.array(S("b"), S("c"))),
        k=scores.jaccard(F.array().cast("array<string>"), F.array(S("b"))), s=scores.severity_of(F.lit(.9)), t=scores.severity_of(F.lit(.91)), f=scores.fingerprint_score(F.lit(2)), g=scores.fingerprint_score(F.lit(9)),
        o=scores.origin_score(S(""), S("")), c=scores.capped_ratio(F.lit(30), 20), m=scores.reaction_total(F.create_map(S("a"), F.lit(2), S("b"), F.lit(3))),
    )
    assert r.n == .75 and r.e == 1 and r.z == 0 and abs(r.j - 1 / 3) < 1e-12 and r.k == 0 and (r.s, r.t) == ("high", "critical")
    assert abs(r.f - .6) < 1e-12 and r.g == .8 and r.o == 0 and r.c == 1 and r.m == 5


def test_curves_equal_numpy(spark):
    rng = np.random.default_rng(1)
    for n, m in ((1, 5), (7, 48), (100, 3), (31, 30)):
        a, b = rng.random(n).tolist(), rng.random(m).tolist()
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        r = df.select(curves.resample_curve("a").alias("r"), curves.curve_similarity("a", "b").alias("s")).first()
        grid = lambda v: np.interp(np.linspace(0, 1, 48), np.linspace(0, 1, len(v)), v)
        assert np.allclose(r.r, grid(a))
        expected = 0.0 if n == 1 else (np.corrcoef(grid(a), grid(b))[0, 1] + 1) / 2
        assert abs(r.s - expected) < 1e-9
    df = spark.createDataFrame([([1., 2., 3.], [1., 2., 3.], [3., 2., 1.], [])], "a array<double>, b array<double>, c array<double>, d array<double>")
    r = df.select(curves.curve_similarity("a", "b").alias("x"), curves.curve_similarity("a", "c").alias("y"), curves.curve_similarity("a", "d").alias("z")).first()
    assert r.x > .95 and r.y < .3 and r.z == 0


def test_times(spark):
    r = one(spark, a=F.unix_timestamp(times.parse_iso_ts(S("2024-01-02T03:04:05Z"), "2024-06-01")), b=F.unix_timestamp(times.parse_iso_ts(S("junk"), "1970-01-02")), c=F.unix_timestamp(times.parse_epoch_ts(F.lit(60))))
    assert (r.a, r.b, r.c) == (1704164645, 86400, 60)
