"""Personal data: fixed patterns as seeds, and identifiers found by patterns that the seeds teach. Column functions only.

Seeds are e-mail and IP addresses, card and phone numbers. Every word with a digit or an @ is an instance; its patterns are the
word before it, the two words before it, the word after it, and its shape. Patterns and instances form a graph: a pattern is as
sure as the mean score of its instances for a kind, an instance as the noisy-or of its sure patterns. Rounds over the whole
graph let patterns learned from seeds find instances, and these again patterns. What is sure at the end and is no seed is a span
of its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import prepare
from talewind.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SPACE = r"\x20\x09-\x0D"
_LOCAL = "[A-Za-z0-9._%+-]"


def _at_run(run: str) -> str:
    """Only where a run begins, or where the match before ended: elsewhere in the run a match would have begun earlier. This
    keeps the search linear on long runs."""
    return rf"(?:(?<!{run})|\G)"


PATTERNS = {
    # Possessive repeats match the same, as nothing follows, and don't recurse on addresses of many parts.
    "email": _at_run(_LOCAL) + _LOCAL + r"+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _at_run("[0-9]") + r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an @.
INSTANCE = rf"(?:(?<![^{SPACE}])|\G)[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Letters of the text around an instance that context words are taken from.
AROUND = 48
SURE, SUPPORT, ROUNDS = 0.9, 5, 3
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_BLOCK = 256


def _running(values: Column, start: Column) -> Column:
    """start + the sum of the values before each."""
    zero = F.struct(start.cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    return F.aggregate(values, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")))["a"]


def running_sums(values: Column) -> Column:
    """The sum of the values before each, by blocks, so that long arrays aren't copied once for each value."""
    n = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, _running(totals, F.lit(0)), _running))


def _located(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds ``name``: array of struct(i, start, end, hit) of the leftmost non-overlapping matches in ``text``; the places follow from
    the lengths of matches and of the text between them."""
    df = df.withColumn("_hits", F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, F.transform(F.split("text", pattern, -1), lambda x: F.length(x).cast("long"))))
    df = df.withColumn("_steps", F.zip_with(F.slice("_gaps", 1, F.size("_hits")), "_hits", lambda g, h: g + F.length(h)))
    df = df.withColumn("_before", F.when(F.size("_hits") > 0, running_sums(F.col("_steps"))))
    found = F.transform(
        F.arrays_zip(F.col("_hits").alias("h"), F.slice("_gaps", 1, F.size("_hits")).alias("g"), F.col("_before").alias("b")),
        lambda x: F.struct((x["b"] + x["g"]).alias("start"), (x["b"] + x["g"] + F.length(x["h"])).alias("end"), x["h"].alias("hit")),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    return df.withColumn(name, F.coalesce(F.when(F.size("_hits") > 0, found), empty)).drop("_hits", "_gaps", "_steps", "_before")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Whether the sum of the digits, every second one from the right doubled and cast to one digit, ends in 0."""
    digits = F.transform(F.split(F.reverse(_digits(hit)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v) % 10 == 0


def _small_parts(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


_HOLDS = {
    "email": lambda hit: F.lit(True),
    "ip": _small_parts,
    "card": lambda hit: F.length(_digits(hit)).between(13, 19) & _luhn(hit),
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: spans (kind, start, end; code points, end exclusive) of the fixed patterns, by kind and start. A match
    that fails its test is dropped, nothing within it is tried again."""
    text, out = F.col("text"), docs
    for kind in KINDS:
        when = F.instr(text, "@") > 0 if kind == "email" else F.instr(text, "+") > 0 if kind == "phone" else F.rlike(text, F.lit("[0-9]"))
        out = _located(out, f"_{kind}", PATTERNS[kind], when)

    def held(kind: str) -> Column:
        right = F.filter(f"_{kind}", lambda x: _HOLDS[kind](x["hit"]))
        return F.transform(right, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    parts = [held(kind) for kind in KINDS]
    return out.withColumn("base", F.concat(*parts).cast(SPANS)).drop(*(f"_{k}" for k in KINDS))


def _instances(docs: DataFrame) -> DataFrame:
    """Adds ``seen``: each word with a digit or @ without the marks around it, its place, its patterns, and the kind of the base
    span that it meets, if any."""
    df = _located(docs, "_i", INSTANCE, F.rlike("text", F.lit("[0-9@]")))

    def one(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["hit"], r"^[^\p{L}0-9+@]*", 0))
        core = F.regexp_replace(F.regexp_replace(x["hit"], r"^[^\p{L}0-9+@]*", ""), r"[^\p{L}0-9@]+$", "")
        start = x["start"] + lead
        before = F.lower(F.substring(F.col("text"), F.greatest(x["start"] - AROUND, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(AROUND)).cast("int")))
        after = F.lower(F.substring(F.col("text"), x["end"].cast("int") + 1, F.lit(AROUND)))
        last = rf"[^{SPACE}]+[{SPACE}]*$"
        context = [
            F.concat(F.lit("1:"), F.trim(F.regexp_extract(before, last, 0))),
            F.concat(F.lit("2:"), F.trim(F.regexp_extract(before, rf"[^{SPACE}]+[{SPACE}]+" + last, 0))),
            F.concat(F.lit("n:"), F.regexp_extract(after, rf"^[{SPACE}]*([^{SPACE}]+)", 1)),
        ]
        shape = F.concat(F.lit("s:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(core, r"\p{Lu}", "A"), r"\p{Ll}+", "a"), "[0-9]", "9"))
        patterns = F.filter(F.array(*context, shape), lambda p: F.length(p) > 2)
        end = start + F.length(core)
        met = F.filter("base", lambda s: (s["start"] < end) & (s["end"] > start))
        return F.struct(start.alias("start"), end.alias("end"), core.alias("value"), patterns.alias("patterns"), F.get(met, F.lit(0))["kind"].alias("kind"))

    # Lone digits and short numbers identify nobody.
    kept = F.filter(F.transform("_i", one), lambda x: F.length(x["value"]) >= 6)
    return df.withColumn("seen", kept).drop("_i")


def learned_instances(rows: DataFrame, sure: float = SURE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """value, kind of the words that patterns find. rows: ``seen``, one row for each document."""
    # One edge for each pattern and value, however often they meet.
    each = rows.select(F.explode("seen").alias("x")).select(F.col("x.value").alias("value"), F.col("x.kind").alias("kind"), F.explode("x.patterns").alias("pattern"))
    edges = cut_lineage(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    seeds = edges.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    totals = cut_lineage(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    scores = cut_lineage(seeds.select("value", "kind", "score"))
    for _ in range(rounds):
        met = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        trusted = met.filter(F.col("mass") >= support).join(totals, "pattern").withColumn("conf", F.col("mass") / (F.col("n") + 1))
        trusted = cut_lineage(trusted.filter(F.col("conf") >= sure / 2).select("pattern", "kind", "conf"))
        found = edges.filter("kind is null").select("pattern", "value").join(trusted, "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")
        )
        best = found.filter(F.col("score") >= sure).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
        learned = best.select("value", "b.kind", "b.score").join(seeds.select("value"), "value", "left_anti")
        scores = cut_lineage(seeds.select("value", "kind", "score").unionByName(learned))
    return scores.filter("score < 1").select("value", "kind")


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, spans for each row of ``docs`` (doc_id, text; other columns are not read).

    spans: the base spans and those that patterns find, by kind in the order of KINDS, then start. A null text has no spans;
    repeated rows have equal ones; a null doc_id stays null; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    given = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = cut_lineage(_instances(base_spans(given)).select("doc_id", "text_key", "base", "seen"))
    seen = rows.select("doc_id", "text_key", F.explode("seen").alias("x")).filter("x.kind is null")
    hits = seen.select("doc_id", "text_key", "x.start", "x.end", "x.value").join(learned_instances(rows), "value")
    # At most as many as a text has words with digits.
    more = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = more.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("more").cast(SPANS).alias("more"))
    both = rows.join(more, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["text_key"] == F.col("_key")), "left")
    every = F.concat("base", F.coalesce("more", F.array().cast(SPANS)))
    of = lambda kind: F.array_sort(F.filter(every, lambda s: s["kind"] == kind))
    parts = [of(kind) for kind in KINDS]
    return both.select("doc_id", "text_key", "base", F.concat(*parts).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with spans replaced by <KIND> (touching or overlapping spans of several kinds by the first one's), ``n_chars`` as the
    new length where there is such a column. Texts without spans, null ones too, stay as they are."""
    spans = found_spans(docs).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"),
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind")))).alias("_spans"),
    ).dropDuplicates(["_doc", "_key"])
    both = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, b.cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], cut(acc["at"], s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    both = both.withColumn("_done", F.when(F.col("_spans").isNotNull(), F.aggregate("_spans", zero, step)))
    text = F.when(F.col("_done").isNotNull(), F.concat("_done.out", cut(F.col("_done.at"), F.length("text")))).otherwise(F.col("text"))
    out = both.withColumn("_text", text)
    columns = [
        F.col("_text").alias("text") if c == "text"
        else F.when(F.col("_done").isNotNull(), F.length("_text").cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c)
        for c, t in docs.dtypes
    ]
    return out.select(*columns)


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(found: DataFrame) -> DataFrame:
    counts = [count_of(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
