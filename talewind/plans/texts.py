"""Language of communities over the sample documents: a community is a source; labelled documents are the baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.functions.times import micros
from talewind.operators import language as la
from talewind.operators.identity import content_hashes
from talewind.plans.catalog import query
from talewind.plans.tables import table, words_sql

MIN_TEXTS = 5

WORDS = f"docs AS (SELECT doc_id, source, lang, doc_id IN (SELECT doc_id FROM labels) AS old, {words_sql('lower(text)')} AS w FROM documents)"


def _grams_sql(name: str, condition: str = "true", k: int = 100) -> str:
    return f"""
{name}_all AS (
  SELECT source, ngram, count(*) AS n FROM (
    SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM docs WHERE {condition})
  GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, ngram) AS rank FROM {name}_all QUALIFY rank <= {k})"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def _halves(spark, sf_dir):
    docs, labelled = _documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(labelled, "doc_id", "left_anti"), docs.join(labelled, "doc_id", "left_semi")


@query("top_ngrams", f"WITH {WORDS}, {_grams_sql('grams')} SELECT source, ngram, n, rank FROM grams")
def top_ngrams(spark, sf_dir):
    found = la.top_ngrams(_documents(spark, sf_dir), ["source"])
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "type_token_ratio",
    f"WITH {WORDS}, u AS (SELECT source, unnest(w) AS word FROM docs) SELECT source, round(count(DISTINCT word) / count(*), 9) AS type_token_ratio FROM u GROUP BY source",
)
def type_token_ratio(spark, sf_dir):
    found = la.type_token_ratio(_documents(spark, sf_dir), ["source"])
    return found.withColumn("type_token_ratio", F.round("type_token_ratio", 9))


def _profile_sql(name: str, condition: str) -> str:
    return f"""
{name} AS (
  SELECT a.source, texts, avg_text_length, type_token_ratio
  FROM (SELECT source, count(*) AS texts, avg(len(w)) AS avg_text_length FROM docs WHERE {condition} GROUP BY source HAVING count(*) >= {MIN_TEXTS}) a
  JOIN (SELECT source, count(DISTINCT word) / count(*) AS type_token_ratio FROM (SELECT source, unnest(w) AS word FROM docs WHERE {condition}) GROUP BY source) b
    ON a.source = b.source)"""


@query(
    "language_profile",
    f"""WITH {WORDS}, {_profile_sql('profile', 'true')}
    SELECT source, texts, round(avg_text_length, 6) AS avg_text_length, round(type_token_ratio, 9) AS type_token_ratio FROM profile""",
)
def language_profile(spark, sf_dir):
    found = la.language_profile(_documents(spark, sf_dir), "source", min_texts=MIN_TEXTS)
    return found.select("source", "texts", F.round("avg_text_length", 6).alias("avg_text_length"), F.round("type_token_ratio", 9).alias("type_token_ratio"))


DRIFT = f"""{WORDS}, {_grams_sql('cur', 'NOT old')}, {_grams_sql('bas', 'old')},
j AS (SELECT coalesce(c.source, b.source) AS source, c.ngram AS cn, b.ngram AS bn FROM cur c FULL JOIN bas b ON c.source = b.source AND c.ngram = b.ngram),
drift AS (
  SELECT source, 1 - count(*) FILTER (cn IS NOT NULL AND bn IS NOT NULL) / count(*) AS d,
         array_to_string(list_slice(list_sort(list(cn) FILTER (bn IS NULL)), 1, 20), '|') AS fresh
  FROM j GROUP BY source HAVING count(cn) > 0 AND count(bn) > 0)"""


@query("ngram_drift", f"WITH {DRIFT} SELECT source, round(d, 9) AS ngram_drift, fresh AS new_ngrams FROM drift")
def ngram_drift(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir)
    found = la.ngram_drift(la.top_ngrams(current, ["source"]), la.top_ngrams(baseline, ["source"]), "source")
    return found.select("source", F.round("ngram_drift", 9).alias("ngram_drift"), F.array_join("new_ngrams", "|").alias("new_ngrams"))


@query(
    "language_shift",
    f"""WITH {DRIFT}, {_profile_sql('pc', 'NOT old')}, {_profile_sql('pb', 'old')}
    SELECT source, CASE WHEN d > 0.25 THEN 'high' ELSE 'medium' END AS severity, round(d, 4) AS ngram_drift, fresh AS new_ngrams,
      round(pc.type_token_ratio - pb.type_token_ratio, 4) AS vocab_richness_change, round(pc.avg_text_length - pb.avg_text_length, 1) AS avg_length_change
    FROM drift JOIN pc USING (source) JOIN pb USING (source) WHERE d > 0.15""",
)
def language_shift(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir)
    found = la.language_shift(
        la.language_profile(current, "source", min_texts=MIN_TEXTS), la.language_profile(baseline, "source", min_texts=MIN_TEXTS),
        la.top_ngrams(current, ["source"]), la.top_ngrams(baseline, ["source"]), "source",
    )
    return found.select("source", "severity", "ngram_drift", F.array_join("new_ngrams", "|").alias("new_ngrams"), "vocab_richness_change", "avg_length_change")


def _community_input(spark, sf_dir):
    """Turns as posts of their role and conversation group; roles are communities."""
    t = table(spark, sf_dir, "conversations")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int"))
    actor = F.concat_ws("-", "role", (F.length("text") % 10).cast("string"))
    posts = t.select(actor.alias("actor_id"), F.concat_ws(":", "conv_id", "turn").alias("content_id"), at.alias("created_at"), "text", "role")
    members = posts.select(F.col("role").alias("community_id"), "actor_id").distinct()
    return posts.drop("role"), members


@query(
    "community_texts",
    """WITH p AS (SELECT role, role || '-' || (length(text) % 10) AS actor_id, conv_id || ':' || turn AS content_id, conv_id * 10 + turn AS m, text FROM conversations WHERE text <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY m DESC, content_id DESC) AS n FROM p)
    SELECT role AS community_id, actor_id, content_id, md5(text) AS text_md5 FROM r WHERE n <= 20""",
)
def community_texts(spark, sf_dir):
    found = la.community_texts(*_community_input(spark, sf_dir), per_actor=20)
    return found.select("community_id", "actor_id", "content_id", F.md5("text").alias("text_md5"))


@query(
    "content_hashes",
    f"""WITH d AS (SELECT source, doc_id, array_to_string({words_sql('lower(text)')}, ' ') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n
      FROM documents WHERE text <> '')
    SELECT DISTINCT source AS actor_id, sha256(t) AS hash FROM d WHERE n <= 50""",
)
def hashes(spark, sf_dir):
    posts = _documents(spark, sf_dir).select(
        F.col("source").alias("actor_id"), F.col("doc_id").alias("content_id"), F.timestamp_seconds("doc_id").alias("created_at"), "text"
    )
    return content_hashes(posts)
