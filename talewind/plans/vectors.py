"""Vectors, narratives and images over the sample embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.operators import images as im
from talewind.operators import vectors as ve
from talewind.operators.density import density_clusters
from talewind.plans.catalog import query
from talewind.plans.tables import table

# Sample vectors are random directions: bounds on the cosine are far below the defaults.
NEAR = 0.3


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _labels(spark, sf_dir):
    """Given cluster ids; cluster 0 stands for noise."""
    return _vectors(spark, sf_dir).select("id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("label"))


@query("noise_ratio", "SELECT count(*) FILTER (label = 0) / count(*) AS noise_ratio, count(DISTINCT label) FILTER (label <> 0) AS clusters_found FROM embeddings")
def noise_ratio(spark, sf_dir):
    return ve.noise_ratio(_labels(spark, sf_dir))


CENTROIDS = """
el AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label <> 0),
cx AS (SELECT label, i, avg(x) AS x FROM el GROUP BY ALL),
cent AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS len FROM cx GROUP BY label)"""


@query(
    "centroids",
    f"WITH {CENTROIDS}, n AS (SELECT label, count(*) AS content_count FROM embeddings GROUP BY ALL) "
    "SELECT cx.label, i AS position, round(x, 9) AS x, content_count FROM cx JOIN n ON n.label = cx.label",
)
def centroids(spark, sf_dir):
    found = ve.centroids(_vectors(spark, sf_dir), _labels(spark, sf_dir))
    return found.select("label", "content_count", F.posexplode("vector").alias("position", "x")).select(
        "label", (F.col("position") + 1).cast("long").alias("position"), F.round("x", 9).alias("x"), "content_count"
    )


# Existing narratives: one vector per (label, part) of the sample, named by its id.
EXISTING = "ex AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "match_centroids",
    f"""WITH {CENTROIDS}, {EXISTING},
    c AS (SELECT label, vec_id, list_dot_product(cent.v, ex.v) / len / sqrt(list_dot_product(ex.v, ex.v)) AS cosine FROM cent CROSS JOIN ex),
    b AS (SELECT label, arg_max(vec_id, cosine) AS vec_id, max(cosine) AS cosine FROM c WHERE cosine > {NEAR} GROUP BY label)
    SELECT CAST(cent.label AS VARCHAR) AS label, CAST(vec_id AS VARCHAR) AS narrative, vec_id IS NULL AS is_new, round(cosine, 7) AS cosine FROM cent LEFT JOIN b ON b.label = cent.label""",
)
def match_centroids(spark, sf_dir):
    new = ve.centroids(_vectors(spark, sf_dir), _labels(spark, sf_dir))
    existing = _vectors(spark, sf_dir).select(F.col("id").alias("narrative_id"), "vector")
    found = ve.match_centroids(new, existing, "2024-01-31", NEAR)
    return found.select("label", F.when(~F.col("is_new"), F.col("narrative_id")).alias("narrative"), "is_new", F.round("cosine", 7).alias("cosine"))


def _matched(spark, sf_dir):
    """Clusters against a part of the narratives, so that some are new."""
    new = ve.centroids(_vectors(spark, sf_dir), _labels(spark, sf_dir))
    existing = new.filter("label <= 4").select(F.concat(F.lit("n"), "label").alias("narrative_id"), "vector")
    return ve.match_centroids(new, existing, "2024-01-31", 0.999)


@query(
    "narrative_events",
    """SELECT CASE WHEN label <= 4 THEN 'narrative_updated' ELSE 'narrative_candidate_created' END AS event,
      CASE WHEN label <= 4 THEN 'n' || label END AS narrative_id, count(*) AS content_count FROM embeddings WHERE label <> 0 GROUP BY label""",
)
def narrative_events(spark, sf_dir):
    found = ve.narrative_events(_matched(spark, sf_dir))
    return found.withColumn("narrative_id", F.when(F.col("event") == "narrative_updated", F.col("narrative_id")))


@query("narrative_of_content", "SELECT vec_id AS content_id, CASE WHEN label <= 4 THEN 'n' || label END AS narrative_id FROM embeddings WHERE label <> 0")
def narrative_of_content(spark, sf_dir):
    found = ve.narrative_of_content(_labels(spark, sf_dir), _matched(spark, sf_dir))
    return found.select("content_id", F.when(F.length("narrative_id") < 30, F.col("narrative_id")).alias("narrative_id"))


@query(
    "candidate_samples",
    """WITH d AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)
    SELECT source AS narrative_id, rank, doc_id AS content_id, md5(left(text, 200)) AS preview_md5 FROM d WHERE rank <= 20""",
)
def candidate_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    of_content = docs.select(F.col("doc_id").alias("content_id"), F.col("source").alias("narrative_id"))
    previews = docs.select(F.col("doc_id").alias("id"), F.left("text", F.lit(200)).alias("text_preview"))
    found = ve.candidate_samples(of_content, previews, of_content.select("narrative_id").distinct())
    return found.select("narrative_id", F.col("rank").cast("long").alias("rank"), "content_id", F.md5("text_preview").alias("preview_md5"))


VERDICTS = """
v AS (SELECT doc_id, source, quality = 1 AS coherent, (n_chars % 100) / 100 AS confidence FROM labels JOIN documents USING (doc_id))"""


def _gated(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    fields = F.struct((F.col("quality") == 1).alias("is_coherent_narrative"), ((F.col("n_chars") % 100) / 100).alias("confidence"), F.col("source").alias("category"))
    return ve.validation_gate(joined.select(F.col("doc_id").alias("narrative_id"), F.to_json(fields).alias("verdict")))


@query("validation_gate", f"WITH {VERDICTS} SELECT doc_id AS narrative_id, source AS category, coherent AND confidence > 0.6 AS accepted FROM v")
def validation_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("narrative_id", "category", "accepted")


@query("validation_counts", f"WITH {VERDICTS} SELECT count(*) FILTER (coherent AND confidence > 0.6) AS validated, count(*) FILTER (NOT (coherent AND confidence > 0.6)) AS rejected FROM v")
def validation_counts(spark, sf_dir):
    return ve.validation_counts(_gated(spark, sf_dir))


@query(
    "semantic_clones",
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.vec_id, a.label, b.vec_id AS o, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS c FROM e a JOIN e b ON a.label <> b.label)
    SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS actor_id, count(*) AS partners, CAST(arg_max(o, c) AS VARCHAR) AS best_id, round(max(c), 7) AS best_cosine
    FROM p WHERE c >= {NEAR} GROUP BY ALL""",
)
def semantic_clones(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumnRenamed("label", "actor_id")
    return ve.semantic_clones(rows, NEAR).withColumn("best_cosine", F.round("best_cosine", 7))


@query("clone_links")
def clone_links(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("actor_id", F.col("id"))
    return ve.clone_links(rows.drop("label"), NEAR)


def _text_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("content_id"), F.lit(None).cast("string").alias("title"), "text", F.col("source").alias("platform"), F.lit("post").alias("content_type"),
        F.timestamp_seconds("doc_id").alias("created_at"), F.col("source").alias("actor_id"),
    )
    return ve.embed_content(docs)


@query("embed_content")
def embed_content(spark, sf_dir):
    return _text_vectors(spark, sf_dir).select("id", "platform", "text_preview", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query("recent_vectors", "SELECT doc_id AS id FROM documents WHERE doc_id > 500 - 300 AND doc_id <= 500")
def recent_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("created_at"))
    return ve.recent_vectors(rows, "1970-01-21 20:00:00", hours=300).select("id")


@query("density_clusters")
def clusters(spark, sf_dir):
    rows = _text_vectors(spark, sf_dir).select("id", "vector")
    return density_clusters(rows, min_cluster_size=10, min_samples=5)


# --- images: a checksum of brand and size stands for the hash ---------------------------------------------------------------

def _hashes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("content_id"), F.col("p_type").alias("platform"), F.conv(F.left(F.md5(F.concat_ws("|", "p_brand", "p_size")), F.lit(15)), 16, 10).cast("long").alias("hash"),
    )


HASHES = """
h AS (SELECT p_partkey AS content_id, p_type AS platform, CAST(('0x' || left(md5(p_brand || '|' || p_size), 15)) AS BIGINT) AS hash FROM part)"""


@query(
    "image_hash_matches",
    f"""WITH {HASHES}, g AS (SELECT hash, count(*) AS n, count(DISTINCT platform) AS platforms FROM h GROUP BY hash), p AS (SELECT hash, platform, count(*) AS here FROM h GROUP BY ALL)
    SELECT content_id, h.platform, h.hash, n - here AS matches, platforms FROM h JOIN g ON g.hash = h.hash JOIN p ON p.hash = h.hash AND p.platform = h.platform WHERE platforms > 1""",
)
def image_hash_matches(spark, sf_dir):
    return im.image_hash_matches(_hashes(spark, sf_dir)).withColumn("matches", F.col("matches").cast("long"))


@query(
    "image_match_members",
    f"WITH {HASHES} SELECT o.content_id, o.platform, o.hash FROM h o JOIN h m ON m.content_id = 4 AND o.hash = m.hash AND o.platform <> m.platform",
)
def image_match_members(spark, sf_dir):
    return im.image_match_members(_hashes(spark, sf_dir), 4)


@query(
    "image_near_matches",
    f"""WITH {HASHES}, d AS (SELECT DISTINCT hash FROM h)
    SELECT a.hash AS hash_a, b.hash AS hash_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM d a JOIN d b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 14""",
)
def image_near_matches(spark, sf_dir):
    # Checksums are random bits, so a wider bound than for images leaves rows.
    return im.image_near_matches(_hashes(spark, sf_dir), bits=14)
