"""Quality rules whose cutoffs come with a guarantee: per stratum, few good documents are rejected.

A rule is a share of a document (symbols, capitals, repeats ...), rejected from a cutoff on. Labelled documents are parted by
their text: a quarter picks the rules that tell bad from good in a stratum, the rest (the holdout) sets the cutoffs. Going from
the strictest cutoff down, a cutoff stays as long as the exact binomial test rejects "more than the rule's part of ``alpha`` of
the good documents are lost". The order is fixed beforehand, so a stratum's rule spends one error probability for all its
cutoffs; ``delta`` is divided by the number of rules times strata that are tested (Bonferroni).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import filled, prepare, raw_bytes, slices, split_words
from talewind.operators.skew import top_per_group
from talewind.session import cut_lineage

ALPHA, DELTA = 0.02, 0.05
#: Steps of a cutoff between 0 and 1.
STEPS = 200
WINDOW = 8
#: Toxic words of a stratum: in so many tuning texts labelled toxic at least, and so many times as often there as in others.
TOXIC_TEXTS, TOXIC_TIMES, TOXIC_WORDS = 5, 10, 1000
TRIMMED = ".,;:!?\"'()[]{}*#|<>&%$-_"
RULES = ("symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "top_word_share", "toxic_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = f"doc_id long, stratum string, text_key long, {', '.join(f'{x} long' for x in COUNTS)}, {', '.join(f'{x} double' for x in RULES)}"


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


SYMBOLS, UPPER, MARKS = _among("#*$%&|<>"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("!?")
LETTERS = UPPER | _among("abcdefghijklmnopqrstuvwxyz")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def repeated_words(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, the words in windows that it holds twice or more. Windows are compared exactly, by doubled ranks."""
    n, rank, width = len(codes), codes.astype(np.int64), 1
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if n < window:
        return np.zeros(len(starts) - 1, np.int64)
    while width < window:
        step = min(width, window - width)
        rank = pd.factorize(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:])[0].astype(np.int64)
        width += step
    inside = doc[: len(rank)] == doc[window - 1 :]
    key, at = pd.factorize(rank[inside] * len(starts) + doc[: len(rank)][inside])[0], np.flatnonzero(inside)
    twice = at[np.bincount(key)[key] > 1] if len(key) else at
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    return _sums(np.cumsum(change)[:n] > 0, starts)


def _measured(texts: pa.Array, strata: list[str], toxic: dict[str, list[str]]) -> dict[str, np.ndarray]:
    texts = filled(texts)
    docs = len(texts)
    codes, starts, words = split_words(texts)
    n_words = np.diff(starts)
    doc = np.repeat(np.arange(docs), n_words)
    data, at = raw_bytes(texts)
    word_chars = _sums(pc.utf8_length(words).to_numpy()[codes] if len(words) else np.zeros(0, np.int64), starts)
    n_symbols, upper, letters, marks = (_sums(table[data], at) for table in (SYMBOLS, UPPER, LETTERS, MARKS))
    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(docs), np.diff(lines.offsets.to_numpy()))
    flat = lines.flatten()
    with_word = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy() > 0
    line_key = flat.dictionary_encode().indices.to_numpy().astype(np.int64) * max(1, docs) + line_doc
    again = pd.Series(line_key[with_word]).duplicated().to_numpy()
    n_lines, n_dup = (np.bincount(x, minlength=docs) for x in (line_doc[with_word], line_doc[with_word][again]))
    n_repeat = repeated_words(codes, starts)
    pair, pairs = pd.factorize(codes.astype(np.int64) * max(1, docs) + doc)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, pairs % max(1, docs), np.bincount(pair, minlength=len(pairs)))
    n_toxic, of_doc = np.zeros(docs, np.int64), np.array(strata, dtype=object)
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=TRIMMED) if toxic else words
    for x in set(strata) & set(toxic) if len(words) else ():
        hit = pc.is_in(plain, value_set=pa.array(toxic[x], pa.string())).to_numpy(zero_copy_only=False)[codes]
        n_toxic = np.where(of_doc == x, _sums(hit, starts), n_toxic)
    share = lambda a, b: np.minimum(1, a / np.maximum(1, b))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "symbol_share": share(n_symbols, word_chars), "upper_share": share(upper, letters), "mark_share": share(marks, n_words),
        "dup_line_share": share(n_dup, n_lines), "repeat_share": share(n_repeat, n_words), "top_word_share": share(top, n_words),
        "toxic_share": share(n_toxic, n_words),
    }


def _stratum(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _tuning(text_key):
    return F.pmod(F.xxhash64(text_key), F.lit(4)) == 0


def toxic_words(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> dict[str, list[str]]:
    """For each stratum the words that mark toxic texts in the tuning part, at most TOXIC_WORDS, the most frequent first."""
    if "toxic" not in labels.columns:
        return {}
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).cast("long").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _stratum(stratum).alias("stratum"), F.xxhash64("text").alias("text_key"), "text")
    texts = own.filter(F.col("text").isNotNull() & _tuning("text_key")).join(marks, "doc_id").groupBy("stratum", "text_key").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    texts = cut_lineage(texts)
    word = F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.btrim(w, F.lit(TRIMMED))))
    each = texts.select("stratum", "toxic", F.explode(word).alias("word")).filter(F.col("word") != "")
    counts = each.groupBy("stratum", "word").agg(F.sum("toxic").alias("there"), F.sum(1 - F.col("toxic")).alias("other")).filter(F.col("there") >= TOXIC_TEXTS)
    totals = texts.groupBy("stratum").agg(F.sum("toxic").alias("n_there"), F.sum(1 - F.col("toxic")).alias("n_other"))
    often = F.col("there") * F.col("n_other") >= TOXIC_TIMES * F.col("other") * F.col("n_there")
    found = counts.join(totals, "stratum").filter(often & (F.col("n_other") > 0))
    top = top_per_group(found, ["stratum"], [F.desc("there"), F.asc("word")], TOXIC_WORDS)
    out: dict[str, list[str]] = {}
    for r in top.select("stratum", "word").collect():
        out.setdefault(r["stratum"], []).append(r["word"])
    return out


def measures(docs: DataFrame, stratum: str = "lang", toxic: dict[str, list[str]] | None = None) -> DataFrame:
    """Counts and rule values of each whole text: see MEASURES. A null text has no words; a null stratum is its own, ''."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _measured(batch.column("text"), batch.column("stratum").to_pylist(), toxic or {})
            own = [batch.column("doc_id"), batch.column("stratum"), batch.column("text_key")]
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RULES)
            made = [pa.array(found[x], kind) for x, kind in zip((*COUNTS, *RULES), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *made], ["doc_id", "stratum", "text_key", *COUNTS, *RULES])

    prepare(docs.sparkSession)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _stratum(stratum).alias("stratum"),
        F.xxhash64("text").alias("text_key"), "text",
    )
    return given.mapInArrow(measure, MEASURES)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed term by term."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    most = max(logs)
    return min(1.0, math.exp(most) * math.fsum(math.exp(x - most) for x in logs))


def lowest_cutoff(lost: list[int], n: int, alpha: float, delta: float) -> int | None:
    """lost[b]: good documents of n with a step of b or more. The least b reached from the top while the test holds."""
    best = None
    for b in range(len(lost) - 1, 0, -1):
        if binomial_tail(lost[b], n, alpha) > delta:
            break
        best = b
    return best


def _from_top(rows: pd.DataFrame, good: int) -> np.ndarray:
    own = rows[rows["good"] == good]
    counts = np.bincount(own["step"], weights=own["n"], minlength=STEPS + 1)
    return counts[::-1].cumsum()[::-1].astype(np.int64)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, step, n_good, n_lost: the cutoffs that the labelled holdouts warrant.

    labels: doc_id, quality (1 good, 0 bad; null: not labelled) and, if there, toxic (1: bad whatever its quality). Equal texts count once, as copies are no independent draws;
    of differing labels of one text the worse holds. Strata with too few labelled documents for the bound get no cutoffs.
    """
    good = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")) if "toxic" in labels.columns else F.col("quality")
    marks = labels.withColumn("_good", good.cast("int")).filter(F.col("_good").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("_good").alias("good"))
    once = measured.join(marks, "doc_id").groupBy("stratum", "text_key").agg(F.min("good").alias("good"), *(F.max(x).alias(x) for x in RULES))
    step = F.floor(F.col("value") * STEPS).cast("int")
    long = once.select(
        "stratum", "good", _tuning("text_key").alias("tune"),
        F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.col(x).alias("value")) for x in RULES))).alias("_r"),
    ).select("stratum", "good", "tune", "_r.rule", F.col("_r.value").alias("value"))
    # At most 2 * 2 * len(RULES) * (STEPS + 1) rows for a stratum from here on, whatever the input.
    counts = cut_lineage(long.groupBy("stratum", "rule", "tune", "good", step.alias("step")).agg(F.count("*").alias("n")))

    def picked(rows: pd.DataFrame) -> pd.DataFrame:
        """Rules that catch bad documents of the tuning part while hardly a good one is lost."""
        out = []
        for rule, own in rows.groupby("rule"):
            lost, caught = _from_top(own, 1), _from_top(own, 0)
            clean = np.flatnonzero(lost <= alpha / 8 * lost[0])
            clean = clean[clean > 0]
            if len(clean) and lost[0] and caught[clean[0]] >= max(2, 0.05 * caught[0]):
                out.append((rows["stratum"].iloc[0], rule))
        return pd.DataFrame(out, columns=["stratum", "rule"])

    rules = cut_lineage(counts.filter("tune").groupBy("stratum").applyInPandas(picked, "stratum string, rule string"))
    tests = max(1, rules.count())

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        out, share = [], alpha / rows["rule"].nunique()
        for rule, own in rows.groupby("rule"):
            lost = _from_top(own, 1)
            b = lowest_cutoff(lost.tolist(), int(lost[0]), share, delta / tests)
            if b is not None:
                out.append((rows["stratum"].iloc[0], rule, b, int(lost[0]), int(lost[b])))
        return pd.DataFrame(out, columns=["stratum", "rule", "step", "n_good", "n_lost"])

    held = counts.filter("not tune").join(rules, ["stratum", "rule"])
    return cut_lineage(held.groupBy("stratum").applyInPandas(chosen, "stratum string, rule string, step int, n_good long, n_lost long"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and the stratum's column; others are not read): MEASURES, base_failed, kept.

    base_failed: fewer than 20 words, or over 30 in 100 words in repeated windows of 8. kept: not base_failed, and below all
    cutoffs of the row's stratum; a stratum without cutoffs rejects nothing. A null or empty text has no words and fails.
    Repeated rows are judged alike, null doc_ids too; an empty table or no labels give no cutoffs.
    """
    measured = cut_lineage(measures(docs, stratum, toxic_words(docs, labels, stratum)))
    cuts = cutoffs(measured, labels, alpha, delta)
    wide = cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == x, F.col("step"))).alias(f"_cut_{x}") for x in RULES))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = F.lit(False)
    for x in RULES:
        over = over | F.coalesce(F.floor(F.col(x) * STEPS) >= F.col(f"_cut_{x}"), F.lit(False))
    both = measured.join(cut_lineage(wide), "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
    return both.select("doc_id", "stratum", "text_key", *COUNTS, *RULES, "base_failed", "kept")


def kept_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose verdict is kept, all columns as they were. Verdicts are met by id (null too) and text."""
    keep = verdicts.filter("kept").select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(docs["text"]) == F.col("_text_key")), "left_semi")
