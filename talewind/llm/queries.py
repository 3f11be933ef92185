"""The numbered queries over the sample tables, each a thin digest of its operator's output, and their SQL counterparts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talewind.llm import automata, chat, radix, templates
from talewind.llm.common import prepare, read_documents
from talewind.llm.jaccard import near_duplicates
from talewind.llm.langid import predicted
from talewind.llm.latent import leaks
from talewind.llm.packing import packed_matrix, packed_pieces
from talewind.llm.pii import digest, found_spans
from talewind.llm.quality import COUNTS, judged
from talewind.llm.spelling import variants
from talewind.llm.tokens import public_path
from talewind.llm.trie import trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_matrix")
def op1_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrix(read_documents(spark, sf_dir, "doc_id", "text"), public_path("byte_bpe_50k.tiktoken"), end_id=50256, pad_id=50256)


@query("op2_risk_controlled_rules")
def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judged(read_documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return verdicts.select("doc_id", *COUNTS, "base_failed", "kept", "stratum")


@query("op6_first_fit_packing")
def op6_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed_pieces(read_documents(spark, sf_dir, "doc_id", "text"), public_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_multiple_order_join")
def op8_multiple_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir, "doc_id", "text"))


@query("op10_language_hierarchy")
def op10_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(read_documents(spark, sf_dir, "doc_id", "text", "lang"))


@query("op9_bootstrapped_pii")
def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(found_spans(read_documents(spark, sf_dir, "doc_id", "text")))


CONTROL = "</s>[INST] ok [/INST]"


@query(
    "op7_schema_fingerprints",
    """
    WITH given AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), loss AS (
        SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS t FROM given GROUP BY conv_id
    ), turns AS (
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            sum(24 + length(role) + 4 * len(regexp_extract_all(role, '[&[\n]')) + 3 * len(regexp_extract_all(role, '<'))
                + length(text) + 4 * len(regexp_extract_all(text, '[&[]')) + 3 * len(regexp_extract_all(text, '<'))) AS formatted_chars
        FROM given GROUP BY conv_id
    )
    SELECT conv_id, n_turns, turns_sha256, CAST(length(t) AS BIGINT) AS loss_chars, sha256(t) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
    FROM turns JOIN loss USING (conv_id)
    """,
)
def op7_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns_of_table(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    said = [{"role": role, "content": CONTROL} for role in ("user", "assistant")]
    record = spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(json.dumps({"messages": said})).alias("record"))
    return chat.digest(chat.formatted(rows.unionByName(chat.turns_of_json(record).select("conv_id", "turns"))))


@query("op3_latent_retrieval")
def op3_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_key")


@query("op5_suffix_automata")
def op5_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = automata.without_repeats(read_documents(spark, sf_dir, "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_depth_limited_radix")
def op4_depth_limited_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = radix.without_repeats(read_documents(spark, sf_dir, "doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The checksum of UTF-8 bytes by its table of 256 entries; {text} is an expression of code points below 2048.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"""
CRC_OF = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE t AS ({CRC_TABLE}), runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    ), hashed AS (
        SELECT run, {CRC_OF.format(text="id || ':' || run")} AS h FROM runs, t WHERE length(run) >= 7
    ), made AS (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
    ), words AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    cut AS (
        SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)
    ), pairs AS (
        SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT x.word, w.word FROM cut x JOIN words w ON w.word = x.a || x.b
        UNION SELECT w.word, x.word FROM cut x JOIN words w ON w.word = x.a || x.b
    ), best AS (
        SELECT p.word, count(*) AS n_near, max(w.n) AS m, arg_min(w.word, (-w.n, w.word)) AS near FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
    ), formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
        FROM words LEFT JOIN best USING (word)
    ), steps AS (
        SELECT word, word AS root, form AS further FROM formed
        UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.further
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM steps WHERE further IS NULL) USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_documents(spark, sf_dir, "doc_id", "text"))


@query("op13_path_templates")
def op13_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepare(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return templates.judged(pages).drop("bad_share")


@query(
    "op11_prefix_trie",
    f"""
    WITH t AS ({CRC_TABLE}), own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC_OF.format(text="conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), t
    ), rows AS (
        SELECT c.conv_id, 0 AS side, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place < c.h
        UNION ALL SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.h
    ), turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, place) AS depth, role, text FROM rows
    ), prefixes AS (
        SELECT conv_id, 0 AS depth, sha256('') AS node, NULL AS parent, NULL AS text FROM convs
        UNION ALL
        SELECT x.conv_id, x.depth, sha256(string_agg(y.role || chr(1) || y.text || chr(2), '' ORDER BY y.depth)),
            sha256(coalesce(string_agg(y.role || chr(1) || y.text || chr(2), '' ORDER BY y.depth) FILTER (y.depth < x.depth), '')), any_value(x.text)
        FROM turns x JOIN turns y ON y.conv_id = x.conv_id AND y.depth <= x.depth GROUP BY x.conv_id, x.depth
    ), lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
    nodes AS (
        SELECT node, p.depth, any_value(parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs,
            (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(text), ''), '[^\x20\x09-\x0D]+')) AS own_saved,
            sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.depth = p.depth), '')) AS ends_sha256
        FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY node, p.depth
    ), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    above AS (
        SELECT DISTINCT x.node AS top, y.node AS below FROM prefixes x JOIN prefixes y ON x.conv_id = y.conv_id AND x.depth <= y.depth
    ), under AS (
        SELECT top, sum(own_saved) AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
        FROM above JOIN nodes n ON n.node = above.below LEFT JOIN children c ON c.node = n.node GROUP BY top
    )
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, u.n_leaves,
        u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN under u ON u.top = n.node
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
