"""Source mappings on one or two hand-made rows; validation, topics, generator."""

import json

from pyspark.sql import functions as F

from talewind.schemas import CONTENT
from talewind.sources.generate import generate_content
from talewind.sources.reddit import normalize_reddit_comments, normalize_reddit_posts
from talewind.sources.telegram import normalize_telegram
from talewind.sources.topics import keyed_json, read_topic, write_topic
from talewind.sources.trends import normalize_trending
from talewind.sources.validate import validate_content

NOW = "2024-06-01"


def raw(spark, schema, *rows):
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


POST = (
    "id string, title string, selftext string, author struct<name:string,created_utc:double,has_verified_email:boolean>, score long, num_comments long, num_crossposts long, view_count long, created_utc double, "
    "permalink string, url string, subreddit string, upvote_ratio double, is_self boolean, link_flair_text string, over_18 boolean, spoiler boolean, stickied boolean, domain string, is_gallery boolean, is_video boolean, "
    "media_metadata map<string,struct<status:string,s:struct<u:string>>>, media struct<reddit_video:struct<fallback_url:string>>"
)


def test_reddit_posts(spark):
    df = raw(
        spark, POST,
        {"id": "a", "title": "T", "selftext": "body u/bob", "author": {"name": "ann", "created_utc": 60.0}, "score": 5, "num_comments": 2, "created_utc": 120.0, "permalink": "/r/x/a", "url": "https://i/x.jpg",
         "is_gallery": True, "media_metadata": {"1": {"status": "valid", "s": {"u": "g?a=1&amp;b"}}, "2": {"status": "failed", "s": {"u": "no"}}}},
        {"id": "b", "title": "only", "selftext": "", "created_utc": 1.0 + i, "permalink": "/p"},
    )
    out = {r.platform_content_id: r for r in normalize_reddit_posts(df, NOW).collect()}
    a, b = out["a"], out["b"]
    assert a.text == "T\n\nbody u/bob" and a.media_urls == ["https://i/x.jpg", "g?a=1&b"] and a.mentions == ["bob"] and a.url == "https://reddit.com/r/x/a"
    assert a.actor.profile_url == "https://reddit.com/user/ann" and a.engagement.replies == 2 and a.engagement.views is None and a.root_id == "a"
    assert b.text == "only" and b.actor.username == "[deleted]" and b.actor.profile_url is None and b.media_urls == [] and b.engagement.likes == 0
    assert normalize_reddit_posts(df, NOW).schema.fieldNames() == CONTENT.fieldNames()


def test_reddit_comment_parent_loses_its_prefix(spark):
    schema = ("id string, submission_id string, body string, author struct<name:string,has_verified_email:boolean>, score long, created_utc double, permalink string, parent_id string, depth int, n_replies long, "
              "is_submitter boolean, controversiality int, distinguished string, stickied boolean")
    rows = [{"id": f"c{i}", "submission_id": "p", "body": "x", "score": i, "created_utc": 1.0 + i, "permalink": "/", "parent_id": "t3_p"} for i in range(5)]
    out = normalize_reddit_comments(raw(spark, schema, *rows), NOW, per_post=2).collect()
    assert {r.platform_content_id for r in out} == {"c3", "c4"} and {r.parent_id for r in out} == {"p"} and out[0].actor.username == "[deleted]"


def test_telegram_parent_is_a_content_id(spark):
    schema = ("channel_id long, channel_username string, channel_title string, id long, date timestamp, text string, sender_id long, post_author string, views long, forwards long, n_replies long, reactions map<string,long>, "
              "reply_to_msg_id long, has_photo boolean, has_document boolean, web_preview_url string, grouped_id long, edit_date string, forward struct<channel_id:long,from_name:string,date:string,channel_post:long>")
    df = raw(spark, schema, {"channel_id": 7, "channel_username": "ch", "channel_title": "Ch", "id": 1, "text": "a", "reactions": {"+": 2, "-": 3}, "has_photo": True},
             {"channel_id": 7, "id": 2, "text": "b", "reply_to_msg_id": 1}, {"channel_id": 7, "id": 3, "text": "c", "reply_to_msg_id": 1, "forward": {"channel_id": 9}})
    out = {r.platform_content_id: r for r in normalize_telegram(df, NOW).collect()}
    assert out["7:2"].parent_id == "7:1" and out["7:1"].engagement.likes == 5 and out["7:1"].media_urls == ["tg://photo/1"] and out["7:1"].url == "https://t.me/ch/1"
    assert [out[k].content_type for k in ("7:1", "7:2", "7:3")] == ["post", "reply", "forward"] and out["7:3"].forwarded_from == "9" and out["7:2"].actor.username == "7"


def test_generated_records_are_valid_and_survive_a_topic(spark, tmp_path):
    content = generate_content(spark, 50, seed=1)
    good, bad = validate_content(content)
    assert good.count() == 50 and bad.count() == 0
    assert sorted(map(str, content.collect())) == sorted(map(str, generate_content(spark, 50, seed=1).collect()))
    write_topic(content, "raw.x", "id", fmt="json", root=str(tmp_path))
    (tmp_path / "raw.x" / "junk.txt").write_text('{"platform": "myspace", "actor": {"platform_id": "a"}}\nnot json\n')
    again, rejected = validate_content(read_topic(spark, ["raw.x"], CONTENT, fmt="json", root=str(tmp_path)))
    assert again.count() == 50 and rejected.count() == 2
    assert "unknown platform" in {r.reject_reason for r in rejected.collect()}
    assert keyed_json(content, "id").columns == ["key", "value"]


def test_bounds(spark):
    bad_score = generate_content(spark, 3).withColumn("nlp", F.col("nlp").withField("sentiment_score", F.lit(1.5)))
    good, bad = validate_content(bad_score)
    assert good.count() == 0 and {r.reject_reason for r in bad.collect()} == {"sentiment_score out of bounds"}


def test_trending_topics_are_whole_unless_bounded(spark):
    schema = "region string, title string, formattedTraffic string, articles array<struct<title:string,source:string,url:string>>, relatedQueries array<string>"
    df = raw(spark, schema, {"region": "US", "title": "t", "articles": [{"title": f"a{i}", "source": "s", "url": "u"} for i in range(12)], "relatedQueries": [f"q{i}" for i in range(15)]})
    sizes = lambda r: (len(r.text.split("\n")), len(json.loads(r.raw_payload)["related_queries"]), len(json.loads(r.raw_payload)["articles"]))
    assert sizes(normalize_trending(df, NOW).first()) == (12, 15, 12)
    assert sizes(normalize_trending(df, NOW, snippets=3, queries=10, articles=5).first()) == (3, 10, 5)
