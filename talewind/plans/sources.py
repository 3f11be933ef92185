"""Source mappings, validation, storage and first sightings, fed from the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.functions import ids, text as tx, times
from talewind.functions.times import micros
from talewind.plans.catalog import query
from talewind.plans.graph import uuid5_sql
from talewind.plans.tables import HALF, NOW, POSTS, WHITE, posts, table
from talewind.schemas import PLATFORMS
from talewind.sources import seen, store, trends
from talewind.sources.bluesky import normalize_bluesky
from talewind.sources.feeds import normalize_news, normalize_substack
from talewind.sources.fourchan import normalize_4chan
from talewind.sources.reddit import normalize_reddit_comments, normalize_reddit_posts
from talewind.sources.telegram import normalize_telegram
from talewind.sources.twitter import normalize_tweets
from talewind.sources.validate import check_content, out_of_bounds
from talewind.sources.wikipedia import normalize_wikipedia
from talewind.sources.youtube import normalize_youtube

AS_OF = "2024-06-01 00:00:00"
AS_OF_US = f"epoch_us(TIMESTAMP '{AS_OF}')"


def s(x):
    return F.col(x).cast("string")


def none(kind="string"):
    return F.lit(None).cast(kind)


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WHITE}|{WHITE}$', '', 'g')"


def clean_sql(expr: str) -> str:
    out = f"regexp_replace(replace(replace({expr}, '<br>', chr(10)), '<br/>', chr(10)), '<[^>]+>', '', 'g')"
    for entity, plain in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&#039;", "''")):
        out = f"replace({out}, '{entity}', '{plain}')"
    return strip_sql(out)


# --- per-source mappings ------------------------------------------------------------------------------------------------

@query(
    "normalize_4chan",
    f"""WITH p AS (SELECT page_id, (page_id // 10) * 10 AS thread, {clean_sql('html')} AS txt, html, url FROM pages)
    SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id = thread THEN 'post' ELSE 'comment' END AS content_type, md5(txt) AS text_md5,
      coalesce(nullif(regexp_extract(txt, '>>(\\d+)', 1), ''), CASE WHEN page_id <> thread THEN CAST(thread AS VARCHAR) END) AS parent_id,
      CAST(thread AS VARCHAR) AS root_id, left(md5('Anonymous:' || page_id % 7), 16) AS author, 'Anonymous' AS username,
      page_id * 60000000 AS us, CASE WHEN page_id = thread THEN length(url) ELSE 0 END AS replies,
      'https://boards.4chan.org/g/thread/' || thread || '#p' || page_id AS url
    FROM p""",
)
def n_4chan(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select(
        F.lit("g").alias("board"), F.col("page_id").alias("no"), (F.floor(F.col("page_id") / 10) * 10).alias("thread_no"),
        F.col("html").alias("com"), none().alias("sub"), none().alias("name"), F.lit("").alias("trip"), (F.col("page_id") % 7).cast("string").alias("id"),
        (F.col("page_id") * 60).alias("time"), F.length("url").alias("replies"), none().alias("country"), none().alias("country_name"),
        none("long").alias("tim"), none().alias("ext"), *[none().alias(c) for c in ("capcode", "filename", "md5")],
        *[none("long").alias(c) for c in ("fsize", "w", "h", "sticky", "closed", "archived")],
    )
    out = normalize_4chan(raw, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), "content_type", F.md5("text").alias("text_md5"), "parent_id", "root_id",
        F.col("actor.platform_id").alias("author"), F.col("actor.username").alias("username"), micros("created_at").alias("us"),
        F.col("engagement.replies").alias("replies"), "url",
    )


@query(
    "normalize_reddit_posts",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, {uuid5_sql("'content:reddit:' || doc_id")} AS record_id,
      md5(CASE WHEN text <> '' THEN {strip_sql("source || chr(10) || chr(10) || text")} ELSE source END) AS text_md5, source AS title,
      n_chars AS likes, length(lang) AS replies, 'https://reddit.com/r/' || source AS url,
      CASE WHEN doc_id % 5 = 0 THEN '[deleted]' ELSE lang END AS author, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'https://reddit.com/user/' || lang END AS profile,
      CASE WHEN doc_id % 3 = 0 THEN 'https://i.example/' || doc_id || '.png' || CASE WHEN doc_id % 2 = 0 THEN '|v' || doc_id ELSE '' END
           ELSE CASE WHEN doc_id % 2 = 0 THEN 'v' || doc_id ELSE '' END END AS media
    FROM documents""",
)
def n_reddit_posts(spark, sf_dir):
    item = "struct<status:string,s:struct<u:string>>"
    raw = table(spark, sf_dir, "documents").select(
        s("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("selftext"),
        F.when(F.col("doc_id") % 5 != 0, F.struct(F.col("lang").alias("name"), none("double").alias("created_utc"), F.lit(True).alias("has_verified_email"))).alias("author"),
        F.col("n_chars").alias("score"), F.length("lang").alias("num_comments"), F.lit(0).alias("num_crossposts"), none("long").alias("view_count"),
        (F.col("doc_id") * 60).cast("double").alias("created_utc"), F.concat(F.lit("/r/"), "source").alias("permalink"),
        F.concat(F.lit("https://i.example/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".html")).alias("url"),
        F.lit(False).alias("is_gallery"), (F.col("doc_id") % 2 == 0).alias("is_video"), none(f"map<string,{item}>").alias("media_metadata"),
        F.struct(F.struct(F.concat(F.lit("v"), "doc_id").alias("fallback_url")).alias("reddit_video")).alias("media"),
        F.col("source").alias("subreddit"), *[none().alias(c) for c in ("upvote_ratio", "is_self", "link_flair_text", "over_18", "spoiler", "stickied", "domain")],
    )
    out = normalize_reddit_posts(raw, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), F.col("id").alias("record_id"), F.md5("text").alias("text_md5"), "title",
        F.col("engagement.likes").alias("likes"), F.col("engagement.replies").alias("replies"), "url", F.col("actor.username").alias("author"),
        F.col("actor.profile_url").alias("profile"), F.array_join("media_urls", "|").alias("media"),
    )


@query(
    "normalize_reddit_comments",
    """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, turn || '@' || conv_id) AS n FROM conversations)
    SELECT turn || '@' || conv_id AS id, CAST(conv_id AS VARCHAR) AS root_id, md5(text) AS text_md5, length(text) AS likes,
      CASE WHEN turn > 0 THEN (turn - 1) || '@' || conv_id END AS parent_id, role AS author FROM c WHERE n <= 4""",
)
def n_reddit_comments(spark, sf_dir):
    return _comments(spark, sf_dir, per_post=4)


@query(
    "normalize_reddit_comments_all",
    """SELECT turn || '@' || conv_id AS id, CAST(conv_id AS VARCHAR) AS root_id, md5(text) AS text_md5, length(text) AS likes,
      CASE WHEN turn > 0 THEN (turn - 1) || '@' || conv_id END AS parent_id, role AS author FROM conversations""",
)
def n_reddit_comments_all(spark, sf_dir):
    return _comments(spark, sf_dir)


def _comments(spark, sf_dir, per_post=None):
    t = table(spark, sf_dir, "conversations")
    raw = t.select(
        F.concat_ws("@", "turn", "conv_id").alias("id"), s("conv_id").alias("submission_id"), F.col("text").alias("body"),
        F.struct(F.col("role").alias("name"), F.lit(False).alias("has_verified_email")).alias("author"), F.length("text").alias("score"),
        F.lit(0).alias("n_replies"), (F.col("turn") * 60).cast("double").alias("created_utc"), F.lit("/c").alias("permalink"),
        F.when(F.col("turn") > 0, F.concat(F.lit("t1_"), F.concat_ws("@", F.col("turn") - 1, "conv_id"))).alias("parent_id"),
        *[none().alias(c) for c in ("depth", "is_submitter", "controversiality", "distinguished", "stickied")],
    )
    out = normalize_reddit_comments(raw, AS_OF, per_post=per_post)
    return out.select(
        F.col("platform_content_id").alias("id"), "root_id", F.md5("text").alias("text_md5"), F.col("engagement.likes").alias("likes"), "parent_id",
        F.col("actor.username").alias("author"),
    )


@query(
    "normalize_tweets",
    f"""WITH {POSTS}
    SELECT CAST(content_id AS VARCHAR) AS id,
      CASE platform WHEN 'click' THEN 'reply' WHEN 'view' THEN 'repost' WHEN 'error' THEN 'quote' ELSE 'post' END AS content_type,
      CASE WHEN platform IN ('click', 'view', 'error') THEN CAST(content_id - 1 AS VARCHAR) END AS parent_id,
      coalesce(c_name, CAST(actor_id AS VARCHAR)) AS username, 'https://x.com/' || c_name AS profile, CAST(floor(c_acctbal) AS BIGINT) AS followers,
      CAST(round(value) AS BIGINT) AS likes, p.p_name || '|' || q.p_name AS media, platform AS hashtags, 'u' || narrative_id AS mentions, us
    FROM posts LEFT JOIN customer ON c_custkey = actor_id LEFT JOIN part p ON p.p_partkey = narrative_id LEFT JOIN part q ON q.p_partkey = narrative_id + 1""",
)
def n_tweets(spark, sf_dir):
    kind = F.when(F.col("platform") == "click", "replied_to").when(F.col("platform") == "view", "retweeted").when(F.col("platform") == "error", "quoted")
    ref = F.array(F.struct(kind.alias("type"), (F.col("content_id") - 1).cast("string").alias("id")))
    tweets = posts(spark, sf_dir).select(
        s("content_id").alias("id"), F.col("platform").alias("text"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        s("actor_id").alias("author_id"), none().alias("conversation_id"), none().alias("in_reply_to_user_id"),
        F.when(kind.isNotNull(), ref).alias("referenced_tweets"),
        F.struct(F.array(s("narrative_id"), (F.col("narrative_id") + 1).cast("string")).alias("media_keys")).alias("attachments"),
        F.struct(F.round("value").cast("long").alias("like_count"), *[none("long").alias(c) for c in ("retweet_count", "reply_count", "impression_count", "quote_count", "bookmark_count")]).alias("public_metrics"),
        F.struct(
            F.array(F.struct(F.col("platform").alias("tag"))).alias("hashtags"), F.array(F.struct(F.concat(F.lit("u"), "narrative_id").alias("username"))).alias("mentions"),
            none("array<struct<expanded_url:string>>").alias("urls"),
        ).alias("entities"), none().alias("lang"), none().alias("source"),
    )
    users = table(spark, sf_dir, "customer").select(
        s("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("username"), none().alias("created_at"), F.lit(True).alias("verified"),
        F.struct(F.floor("c_acctbal").alias("followers_count"), F.lit(0).alias("following_count")).alias("public_metrics"), none().alias("description"),
    )
    media = table(spark, sf_dir, "part").select(s("p_partkey").alias("media_key"), F.col("p_name").alias("url"), none().alias("preview_image_url"))
    out = normalize_tweets(tweets, users, media, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), "content_type", "parent_id", F.col("actor.username").alias("username"), F.col("actor.profile_url").alias("profile"),
        F.col("actor.follower_count").alias("followers"), F.col("engagement.likes").alias("likes"), F.array_join("media_urls", "|").alias("media"),
        F.array_join("hashtags", "|").alias("hashtags"), F.array_join("mentions", "|").alias("mentions"), micros("created_at").alias("us"),
    )


@query(
    "normalize_telegram",
    f"""SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 4 = 3 THEN 'forward' WHEN turn > 0 THEN 'reply' ELSE 'post' END AS content_type, md5(text) AS text_md5,
      CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_id, CASE WHEN turn % 4 = 3 THEN CAST(conv_id % 7 AS VARCHAR) END AS forwarded_from,
      length(text) + turn AS likes, turn AS shares, role AS display_name, CAST(conv_id AS VARCHAR) AS author,
      'tg://photo/' || turn AS media, {AS_OF_US} AS us
    FROM conversations""",
)
def n_telegram(spark, sf_dir):
    fwd = F.struct((F.col("conv_id") % 7).alias("channel_id"), none().alias("from_name"), none().alias("date"), none().alias("channel_post"))
    raw = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("channel_id"), none().alias("channel_username"), F.lit("title").alias("channel_title"), F.col("turn").alias("id"), none("timestamp").alias("date"),
        "text", none("long").alias("sender_id"), F.col("role").alias("post_author"), none("long").alias("views"), F.col("turn").alias("forwards"), F.lit(0).alias("n_replies"),
        F.create_map(F.lit("a"), F.length("text").cast("long"), F.lit("b"), F.col("turn")).alias("reactions"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("reply_to_msg_id"), F.lit(True).alias("has_photo"), F.lit(False).alias("has_document"), none().alias("web_preview_url"),
        none().alias("grouped_id"), none().alias("edit_date"), F.when(F.col("turn") % 4 == 3, fwd).alias("forward"),
    )
    out = normalize_telegram(raw, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), "content_type", F.md5("text").alias("text_md5"), "parent_id", "forwarded_from", F.col("engagement.likes").alias("likes"),
        F.col("engagement.shares").alias("shares"), F.col("actor.display_name").alias("display_name"), F.col("actor.platform_id").alias("author"),
        F.array_join("media_urls", "|").alias("media"), micros("created_at").alias("us"),
    )


@query(
    "normalize_youtube",
    """SELECT CAST(doc_id AS VARCHAR) AS id, md5(source || chr(10) || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || chr(10) || '[TRANSCRIPT]' || chr(10) || lang ELSE '' END) AS text_md5,
      n_chars AS views, lang AS language, source || '|' || lang AS hashtags, 'high' || doc_id AS media, doc_id * 1000000 AS us,
      'https://www.youtube.com/channel/' || source AS profile
    FROM documents""",
)
def n_youtube(spark, sf_dir):
    def thumb(x):
        return F.struct(x.alias("url"))
    snippet = F.struct(
        F.col("source").alias("channelId"), F.col("source").alias("channelTitle"), F.date_format(times.parse_epoch_ts("doc_id"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.col("source").alias("title"), F.col("text").alias("description"), F.array("source", "lang").alias("tags"),
        F.struct(thumb(none()).alias("maxres"), thumb(F.concat(F.lit("high"), "doc_id")).alias("high"), thumb(F.lit("m")).alias("medium"), thumb(F.lit("d")).alias("default")).alias("thumbnails"),
        F.lit("").alias("defaultAudioLanguage"), F.col("lang").alias("defaultLanguage"), none().alias("categoryId"), none().alias("liveBroadcastContent"),
    )
    stats = F.struct(s("n_chars").alias("viewCount"), none().alias("likeCount"), none().alias("commentCount"), none().alias("favoriteCount"))
    raw = table(spark, sf_dir, "documents").select(
        s("doc_id").alias("id"), snippet.alias("snippet"), stats.alias("statistics"), F.struct(none().alias("duration"), none().alias("definition")).alias("contentDetails"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("transcript"),
    )
    out = normalize_youtube(raw, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), F.md5("text").alias("text_md5"), F.col("engagement.views").alias("views"), "language",
        F.array_join("hashtags", "|").alias("hashtags"), F.array_join("media_urls", "|").alias("media"), micros("created_at").alias("us"),
        F.col("actor.profile_url").alias("profile"),
    )


@query(
    "normalize_bluesky",
    """SELECT 'at://did:' || source || '/post/' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'reply' WHEN doc_id % 4 = 1 THEN 'quote' ELSE 'post' END AS content_type,
      md5(text) AS text_md5, 'https://bsky.app/profile/' || source || '/post/' || doc_id AS url, lang AS language, lang AS hashtags,
      CASE WHEN doc_id % 4 = 0 THEN 'p' || doc_id END AS parent_id, n_chars AS likes,
      'https://cdn.bsky.app/img/feed_thumbnail/plain/did:' || source || '/r' || doc_id || '@jpeg' AS media
    FROM documents""",
)
def n_bluesky(spark, sf_dir):
    reply = F.struct(F.struct(F.concat(F.lit("p"), "doc_id").alias("uri")).alias("parent"), F.struct(F.lit("r").alias("uri")).alias("root"))
    feature = F.array(
        F.struct(F.lit("app.bsky.richtext.facet#tag").alias("type"), F.col("lang").alias("tag")), F.struct(F.lit("app.bsky.richtext.facet#link").alias("type"), F.col("source").alias("tag"))
    )
    embed = F.struct(
        F.when(F.col("doc_id") % 4 == 1, "app.bsky.embed.record").otherwise("app.bsky.embed.images").alias("type"),
        F.array(F.struct(F.struct(F.struct(F.concat(F.lit("r"), "doc_id").alias("link")).alias("ref")).alias("image"))).alias("images"),
    )
    raw = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("at://did:"), "source", F.lit("/post/"), "doc_id").alias("uri"), F.lit("cid").alias("cid"),
        F.struct(F.concat(F.lit("did:"), "source").alias("did"), F.col("source").alias("handle"), none().alias("displayName"), none().alias("description"), none("array<string>").alias("labels")).alias("author"),
        F.struct(
            "text", none().alias("createdAt"), F.array("lang").alias("langs"), F.when(F.col("doc_id") % 4 == 0, reply).alias("reply"),
            F.array(F.struct(feature.alias("features"))).alias("facets"), embed.alias("embed"),
        ).alias("record"),
        F.col("n_chars").alias("likeCount"), F.lit(0).alias("repostCount"), F.lit(0).alias("replyCount"), F.lit(0).alias("quoteCount"), none("array<struct<val:string>>").alias("labels"),
    )
    out = normalize_bluesky(raw, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), "content_type", F.md5("text").alias("text_md5"), "url", "language", F.array_join("hashtags", "|").alias("hashtags"), "parent_id",
        F.col("engagement.likes").alias("likes"), F.array_join("media_urls", "|").alias("media"),
    )


@query(
    "normalize_wikipedia",
    """SELECT 'wiki:' || doc_id || ':' || (doc_id + 1) AS id, 'Election of ' || source AS title, md5(text) AS text_md5,
      contains(lower(text), 'revert') OR contains(lower(text), 'undo') AS is_revert, n_chars AS diff_size, (doc_id + 1) * 1000000 AS us
    FROM documents WHERE lang = 'en'""",
)
def n_wikipedia(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.concat(F.lit("Election of "), "source")).otherwise(F.concat(F.lit("About "), "source")).alias("title"),
        F.col("source").alias("user"), F.col("text").alias("comment"), F.lit(0).alias("namespace"), F.lit("edit").alias("type"), F.lit("enwiki").alias("wiki"), F.lit("").alias("server_name"),
        (F.col("doc_id") + 1).alias("timestamp"), *[none("boolean").alias(c) for c in ("minor", "bot", "anon")],
        F.struct((F.col("doc_id") + 1).alias("new"), F.col("doc_id").alias("old")).alias("revision"), F.struct(F.col("n_chars").alias("new"), none("long").alias("old")).alias("length"),
    )
    out = normalize_wikipedia(raw, AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), "title", F.md5("text").alias("text_md5"), (F.get_json_object("raw_payload", "$.is_revert") == "true").alias("is_revert"),
        F.get_json_object("raw_payload", "$.diff_size").cast("long").alias("diff_size"), micros("created_at").alias("us"),
    )


def _entries(spark, sf_dir):
    article = F.struct(
        F.col("html").alias("text"), F.lit("").alias("title"), F.when(F.col("page_id") % 3 == 0, "jane").alias("author"), F.lit("site").alias("sitename"), none().alias("language"),
        *[none().alias(c) for c in ("description", "categories", "tags")],
    )
    return table(spark, sf_dir, "pages").select(
        F.lit("feed").alias("feed_name"), s("page_id").alias("id"), F.col("url").alias("link"), F.concat(F.lit("T"), "page_id").alias("title"), F.lit("summary").alias("summary"),
        F.lit("bob").alias("author"), none().alias("published"), F.when(F.col("page_id") % 2 == 0, "2024-01-02T03:04:05Z").alias("updated"), F.lit("").alias("language"),
        F.array(F.struct(F.col("url").alias("href")), F.struct(F.lit("").alias("href"))).alias("enclosures"), none("array<struct<url:string>>").alias("media_content"),
        F.array(F.struct(F.lit("tag").alias("term")), F.struct(none().alias("term"))).alias("tags"), F.when(F.length("html") > 2000, article).alias("article"),
    )


ENTRY_SQL = f"""page_id || '' AS id, md5(CASE WHEN length(html) > 2000 THEN html ELSE 'summary' END) AS text_md5, 'T' || page_id AS title,
      CASE WHEN length(html) > 2000 AND page_id % 3 = 0 THEN 'jane' ELSE 'bob' END AS author, url AS media,
      CASE WHEN page_id % 2 = 0 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05') ELSE {AS_OF_US} END AS us"""


@query("normalize_news", f"SELECT {ENTRY_SQL}, CASE WHEN length(html) > 2000 THEN 'site' ELSE 'feed' END AS platform_id FROM pages")
def n_news(spark, sf_dir):
    out = normalize_news(_entries(spark, sf_dir), AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), F.md5("text").alias("text_md5"), "title", F.col("actor.username").alias("author"), F.array_join("media_urls", "|").alias("media"),
        micros("created_at").alias("us"), F.col("actor.platform_id").alias("platform_id"),
    )


@query(
    "normalize_substack",
    f"SELECT {ENTRY_SQL}, 'substack:feed' AS platform_id, 'tag' AS hashtags, regexp_replace(url, '/[^/]*$', '') AS profile FROM pages",
)
def n_substack(spark, sf_dir):
    out = normalize_substack(_entries(spark, sf_dir), AS_OF)
    return out.select(
        F.col("platform_content_id").alias("id"), F.md5("text").alias("text_md5"), "title", F.col("actor.username").alias("author"), F.array_join("media_urls", "|").alias("media"),
        micros("created_at").alias("us"), F.col("actor.platform_id").alias("platform_id"), F.array_join("hashtags", "|").alias("hashtags"), F.col("actor.profile_url").alias("profile"),
    )


@query(
    "normalize_trending",
    """SELECT left(sha256('gtrends:' || p_brand || ':' || p_name || ':2024-06-01'), 24) AS id, '[Google Trends] ' || p_name AS title,
      '- ' || p_type || ' (' || p_brand || ')' AS text, p_size * 1000::BIGINT AS views, 'https://trends.google.com/trends/explore?q=' || p_name || '&geo=' || p_brand AS url
    FROM part""",
)
def n_trending(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("region"), F.col("p_name").alias("title"), F.concat("p_size", F.lit("K+")).alias("formattedTraffic"),
        F.array(F.struct(F.col("p_type").alias("title"), F.col("p_brand").alias("source"), F.lit("u").alias("url"))).alias("articles"), none("array<string>").alias("relatedQueries"),
    )
    out = trends.normalize_trending(raw, AS_OF)
    return out.select(F.col("platform_content_id").alias("id"), "title", "text", F.col("engagement.views").alias("views"), "url")


INTEREST = """
points AS (SELECT event_type AS keyword, 'US' AS region, CAST(ts AS DATE) AS date, count(*) AS value FROM events GROUP BY ALL)"""


def _interest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("keyword"), F.to_date("ts").alias("date")).agg(
        F.count("*").alias("value")
    ).withColumn("region", F.lit("US"))


@query("latest_interest", f"WITH {INTEREST} SELECT keyword, region, max(date) AS date, arg_max(value, date) AS value FROM points GROUP BY ALL")
def latest_interest(spark, sf_dir):
    return trends.latest_interest(_interest(spark, sf_dir))


@query(
    "normalize_interest",
    f"""WITH {INTEREST}
    SELECT left(sha256('gtrends:US:' || keyword || ':' || date), 24) AS id, 'Interest score ' || value || '/100 for ''' || keyword || ''' in US' AS text, value AS views FROM points""",
)
def n_interest(spark, sf_dir):
    out = trends.normalize_interest(_interest(spark, sf_dir), AS_OF)
    return out.select(F.col("platform_content_id").alias("id"), "text", F.col("engagement.views").alias("views"))


@query(
    "rising_queries",
    """WITH r AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY -n, CAST(user_id AS VARCHAR)) AS rk FROM r)
    SELECT event_type || ' -> ' || user_id AS keyword, 'US' AS region, DATE '2024-06-01' AS date, n AS value FROM k WHERE rk <= 5""",
)
def rising_queries(spark, sf_dir):
    related = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("keyword"), s("user_id").alias("query")).agg(F.count("*").alias("value"))
    return trends.rising_queries(related.withColumn("region", F.lit("US")).withColumn("position", -F.col("value")), AS_OF)


# --- validation, storage, sightings ---------------------------------------------------------------------------------------

_PLATFORM_LIST = ", ".join(f"'{p}'" for p in PLATFORMS)


@query(
    "validate_content",
    f"""WITH d AS (SELECT lang, source, ([{_PLATFORM_LIST}, 'myspace'])[1 + n_chars % 18] AS platform, nullif(source, 'src0') AS cid, (n_chars % 25 - 12) / 10 AS score FROM documents),
    r AS (SELECT CASE WHEN platform NOT IN ({_PLATFORM_LIST}) THEN 'unknown platform' WHEN cid IS NULL THEN 'missing platform_content_id'
                      WHEN score < -1 OR score > 1 THEN 'sentiment_score out of bounds' ELSE 'ok' END AS reason FROM d)
    SELECT reason, count(*) AS records FROM r GROUP BY ALL""",
)
def validated(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in (*PLATFORMS, "myspace")])
    content = table(spark, sf_dir, "documents").select(
        F.get(names, (F.col("n_chars") % 18).cast("int")).alias("platform"), F.lit("post").alias("content_type"), F.nullif("source", F.lit("src0")).alias("platform_content_id"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"), F.struct(F.col("source").alias("platform_id"), F.col("source").alias("username")).alias("actor"),
        F.struct(
            none().alias("sentiment"), ((F.col("n_chars") % 25 - 12) / 10).alias("sentiment_score"), none("array<struct<confidence:double,entity_type:string>>").alias("entities")
        ).alias("nlp"),
    )
    return check_content(content).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("records"))


@query("out_of_bounds", "SELECT l_orderkey, l_linenumber, l_discount * 12 AS score FROM lineitem WHERE l_discount * 12 > 1")
def bounds(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("score"))
    return out_of_bounds(scored, "score")


KEYED = """
d AS (SELECT doc_id, source, md5(text) AS h, quality FROM documents LEFT JOIN labels USING (doc_id)),
known AS (SELECT DISTINCT source, h FROM d WHERE quality = 1)"""


def _keyed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("platform"), F.md5("text").alias("platform_content_id"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return docs.drop("doc_id"), docs.join(good, "doc_id", "left_semi").drop("doc_id")


@query(
    "append_if_absent",
    f"WITH {KEYED} SELECT DISTINCT source AS platform, h AS platform_content_id FROM d WHERE (source, h) NOT IN (SELECT (source, h) FROM known)",
)
def append_if_absent(spark, sf_dir):
    return store.append_if_absent(*_keyed(spark, sf_dir))


@query(
    "append_report",
    f"""WITH {KEYED}, f AS (SELECT DISTINCT source, h FROM d WHERE (source, h) NOT IN (SELECT (source, h) FROM known))
    SELECT (SELECT count(*) FROM d) AS rows_read, (SELECT count(*) FROM f) AS inserted, (SELECT count(*) FROM d) - (SELECT count(*) FROM f) AS skipped""",
)
def append_report(spark, sf_dir):
    return store.append_report(*_keyed(spark, sf_dir))


@query("project_content_row", f"WITH {POSTS} SELECT platform, CAST(created_at AS DATE) AS created_date, count(*) AS records FROM posts GROUP BY ALL")
def project_rows(spark, sf_dir):
    rows = store.project_content_row(posts(spark, sf_dir).withColumn("raw_payload", F.lit("x")))
    return rows.groupBy("platform", "created_date").agg(F.count("*").alias("records"))


@query("retain", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR")
def retained(spark, sf_dir):
    return store.retain(table(spark, sf_dir, "events"), "ts", NOW, hours=48).select("event_id")


@query(
    "list_content",
    f"WITH {POSTS} SELECT content_id, us FROM posts WHERE platform = 'view' ORDER BY us DESC, content_id LIMIT 50 OFFSET 100",
)
def listed(spark, sf_dir):
    rows = posts(spark, sf_dir).withColumnRenamed("content_id", "platform_content_id")
    page = store.list_content(rows, "view", 50, 100)
    return page.select(F.col("platform_content_id").alias("content_id"), micros("created_at").alias("us"))


@query("content_by_platform_id", f"WITH {POSTS} SELECT content_id, us FROM posts WHERE platform = 'view' AND content_id = 2")
def by_platform_id(spark, sf_dir):
    rows = posts(spark, sf_dir).withColumnRenamed("content_id", "platform_content_id")
    return store.content_by_platform_id(rows, "view", 2).select(F.col("platform_content_id").alias("content_id"), micros("created_at").alias("us"))


@query(
    "author_of_content",
    f"""WITH {POSTS} SELECT platform, CAST(content_id AS VARCHAR) AS platform_content_id, {uuid5_sql("platform || ':' || actor_id")} AS actor_id FROM posts""",
)
def authors(spark, sf_dir):
    content = posts(spark, sf_dir).select(
        "platform", s("content_id").alias("platform_content_id"), F.struct(s("actor_id").alias("platform_id")).alias("actor"), none().alias("conversation_id"),
        none().alias("parent_id"), F.lit("post").alias("content_type"), "created_at",
    )
    return store.author_of_content(content).select("platform", "platform_content_id", "actor_id")


@query(
    "first_sightings",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events),
    kept(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY user_id
      UNION ALL SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us > k.us + 172800000000) AS nxt
      FROM kept k WHERE (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us > k.us + 172800000000) IS NOT NULL)
    SELECT min(event_id) AS event_id, user_id, us FROM e JOIN kept USING (user_id, us) GROUP BY user_id, us""",
)
def first_sightings(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("us"))
    return seen.drop_seen(events, "user_id", "us", "event_id", 48)


MARKS = f"""
marks AS (SELECT event_type, max(event_id) AS high_mark FROM events WHERE ts < TIMESTAMP '{HALF}' GROUP BY ALL)"""


def _marks(events):
    old = events.filter(F.col("ts") < F.lit(HALF).cast("timestamp"))
    return old.groupBy("event_type").agg(F.max("event_id").alias("high_mark"))


@query("read_increment", f"WITH {MARKS} SELECT event_id, event_type FROM events LEFT JOIN marks USING (event_type) WHERE event_id > coalesce(high_mark, 0)")
def increment(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return seen.read_increment(events, _marks(events), "event_type", "event_id").select("event_id", "event_type")


@query("advance_marks", "SELECT event_type, max(event_id) AS high_mark FROM events GROUP BY ALL")
def advanced(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    marks = _marks(events)
    return seen.advance_marks(marks, seen.read_increment(events, marks, "event_type", "event_id"), "event_type", "event_id")


# --- scalar functions -----------------------------------------------------------------------------------------------------

@query("comment_html_text", f"SELECT page_id, md5({clean_sql('html')}) AS text_md5, length({clean_sql('html')}) AS n FROM pages")
def comment_html(spark, sf_dir):
    t = table(spark, sf_dir, "pages").withColumn("_t", tx.clean_comment_html("html"))
    return t.select("page_id", F.md5("_t").alias("text_md5"), F.length("_t").cast("long").alias("n"))


@query(
    "text_references",
    """SELECT doc_id, array_to_string(regexp_extract_all(text, '>>(\\d+)', 1), '|') AS backlinks,
      array_to_string(regexp_extract_all(text, '(?i)(?:^|[\\s(])/?(u/\\w+)', 1), '|') AS mentions,
      array_to_string(regexp_extract_all(text, '\\$([A-Z]{1,5})\\b', 1), '|') AS cashtags
    FROM (SELECT doc_id, '>>' || doc_id || ' (u/' || source || ' >>x $' || upper(lang) || '. $TOOLONG /u/' || lang || ' ' || text AS text FROM documents)""",
)
def references(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit(">>"), "doc_id", F.lit(" (u/"), "source", F.lit(" >>x $"), F.upper("lang"), F.lit(". $TOOLONG /u/"), "lang", F.lit(" "), "text")
    t = t.withColumn("text", marked)
    return t.select("doc_id", *[F.array_join(f("text"), "|").alias(n) for f, n in ((tx.backlinks, "backlinks"), (tx.user_mentions, "mentions"), (tx.cashtags, "cashtags"))])


@query(
    "actor_uuids",
    f"""SELECT s_suppkey AS id, {uuid5_sql("'twitter:' || s_name")} AS actor_id, left(md5(s_name || ':' || s_suppkey), 16) AS anon_id,
      left(sha256('gtrends:US:' || s_name || ':2024-01-01'), 24) AS trend_id FROM supplier
    UNION ALL SELECT c_custkey + 1000000, {uuid5_sql("'twitter:' || c_name")}, left(md5(c_name || ':' || c_custkey), 16), left(sha256('gtrends:US:' || c_name || ':2024-01-01'), 24) FROM customer""",
)
def uuids(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    b = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    both = a.unionByName(b)
    return both.select(
        "id", ids.actor_uuid(F.lit("twitter"), "n").alias("actor_id"), ids.anon_id("n", s("k")).alias("anon_id"),
        ids.trend_id(F.lit("US"), "n", F.lit("2024-01-01")).alias("trend_id"),
    )


@query(
    "page_hosts",
    """SELECT page_id, host LIKE '%ft.com' OR host LIKE '%wsj.com' OR host LIKE '%nytimes.com' OR host LIKE '%washingtonpost.com'
      OR host LIKE '%bloomberg.com' OR host LIKE '%economist.com' AS paywalled
    FROM (SELECT page_id, ['www.nytimes.com', 'washingtonpost.com', 'BLOOMBERG.com', 'blog.wsj.com', 'ft.com', 'economist.com', 'example.org', 'wsj.org'][1 + page_id % 8] AS h,
      lower(h) AS host FROM pages)""",
)
def hosts(spark, sf_dir):
    hosts = ("www.nytimes.com", "washingtonpost.com", "BLOOMBERG.com", "blog.wsj.com", "ft.com", "economist.com", "example.org", "wsj.org")
    url = F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, hosts)), (F.col("page_id") % 8 + 1).cast("int")), F.lit("/a?b=ft.com"))
    return table(spark, sf_dir, "pages").select("page_id", tx.is_paywalled(url).alias("paywalled"))


@query(
    "content_facts",
    f"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(source || ' ' || text, '{WHITE}'), lambda w: w <> ''), ' ')) AS embedding_md5,
      md5(left(text, 200)) AS preview_md5, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END) AS excerpt_md5,
      contains(lower(text), 'revert') OR contains(lower(text), 'undo') AS is_revert, CASE lang WHEN 'en' THEN 'comments' WHEN 'de' THEN 'articles' ELSE 'posts' END AS family,
      n_chars * 1000 AS traffic FROM documents""",
)
def facts(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "reply").when(F.col("lang") == "de", "article").otherwise("video")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.embedding_text("source", "text")).alias("embedding_md5"), F.md5(tx.preview("text")).alias("preview_md5"),
        F.md5(tx.excerpt("text")).alias("excerpt_md5"), tx.revert_flag("text").alias("is_revert"), tx.metric_family(kind).alias("family"),
        tx.parse_traffic(F.concat("n_chars", F.lit("K+"))).alias("traffic"),
    )
