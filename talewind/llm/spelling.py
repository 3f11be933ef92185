"""Spelling variants: frequent words one edit apart, by PartEnum signatures of their letters.

A word is a binary vector with one place for each letter and each of its occurrences (the second "e" has a place of its own).
One replaced letter puts two vectors of words of equal length at Hamming distance two at most, one inserted letter at distance one.
The letters are dealt to PARTS parts. At distance k, all but k parts agree at least, so words that can be near share one of
the signatures that name the kind of edit, the lengths, and what a choice of PARTS - k parts hold. One edit also leaves
the first or the last half of a word as it is; that half is part of the signature. Words are equi-joined on 64-bit hashes of
signatures, so a false meeting costs a comparison and a true one can't be missed, and every meeting is verified as one edit.

All of it are column functions. Words are counted with partial sums before their shuffle; the join is between signatures, which spread
a frequent word, ending or letter over many keys.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import prepare
from talewind.session import cut_lineage

#: Maximal runs of these characters are words.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One of so many occurrences loses a letter, chosen by checksum.
NOISE = 31
PARTS = 3
#: Letters of English by falling frequency, dealt to the parts in turn.
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(run: Column) -> Column:
    """Lower case for A-Z alone; the plain function does that where all characters are ASCII."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int | None = NOISE) -> DataFrame:
    """word, n of all texts. A shorter run can't become a long enough word, so it is not made a row."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)).alias("run"),
    ).select("id", lower_ascii(F.col("run")).alias("run"))
    if noise is None:
        word = F.col("run")
    else:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        without = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % noise == 0, without).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def part_of(letter: str, parts: int = PARTS) -> int:
    place = BY_FREQUENCY.find(letter)
    return (place if place >= 0 else ord(letter)) % parts


def parts_of(word: Column, parts: int = PARTS) -> list[Column]:
    """For each part, its letters in the word, sorted: the places that are 1."""
    alphabet = LOWER + "".join(map(chr, range(0xC0, 0x100)))
    mine = ["".join(x for x in alphabet if part_of(x, parts) == p) for p in range(parts)]
    return [F.array_join(F.sort_array(F.split(F.regexp_replace(word, f"[^{x}]", ""), "")), "") for x in mine]


def signatures(words: DataFrame, differ: int, least: Column, parts: int = PARTS) -> DataFrame:
    """sig, word: for vectors at distance ``differ``, and words of which the shorter has ``least`` characters."""
    half = F.floor(least / 2).cast("int")
    rest = least - half
    halves = (F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - rest + 1, rest))
    # Hashed once each; the projections stay apart, so no part is computed again for each signature.
    split = words.select("word", least.alias("least"), *(F.xxhash64(F.lit(i), x).alias(f"end{i}") for i, x in enumerate(halves)), *(F.xxhash64(x).alias(f"p{i}") for i, x in enumerate(parts_of(F.col("word"), parts))))
    made = []
    for end in range(2):
        for chosen in combinations(range(parts), parts - differ):
            made.append(F.xxhash64(F.lit(str(chosen)), "least", f"end{end}", *(f"p{i}" for i in chosen)))
    return split.select(F.explode(F.array(*made)).alias("sig"), "word")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, b: each pair of words one inserted, deleted or replaced code point apart, once."""
    length = F.length("word")
    # Rows are made of words in the plan, so the size of the words says little of theirs: never broadcast.
    side = lambda rows, name: rows.select("sig", F.col("word").alias(name)).hint("merge")
    replaced, short, long = (signatures(words, *x, parts) for x in ((2, length), (1, length), (1, length - 1)))
    one_edit = F.levenshtein("a", "b", 1) == 1
    of_one_length = side(replaced, "a").join(side(replaced, "b"), "sig").filter((F.col("a") < F.col("b")) & one_edit)
    inserted = side(short, "a").join(side(long, "b"), "sig").filter(one_edit)
    return of_one_length.union(inserted).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word -> root for (word, form): forms followed to the last by doubling the steps. A form has more occurrences than its
    word, so there are no circles."""
    to = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(to.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return to
        to = moved.select("word", "root")


def variants(docs: DataFrame, times: int = TIMES, parts: int = PARTS, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs`` (doc_id, text; other columns are not read).

    form is the near word of largest n (ties: the smallest), if that is ``times`` the word's own n or more. Null texts have no
    words; a null doc_id has the checksum of an empty one; repeated rows count again; an empty table gives no rows. A run of any
    length is one word.
    """
    prepare(docs.sparkSession)
    words = cut_lineage(counted(docs.select("doc_id", "text"), **counting))
    pairs = cut_lineage(near_pairs(words, parts))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    of_near = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = both.join(of_near, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= F.col("n") * times
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"),
    )
    rows = cut_lineage(rows)
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
