"""Language identification in two steps: the family first, then the languages within it.

Both steps hold one-versus-one linear support vector machines over hashed byte trigrams of the letters; each pair's machine has
a vote, and summed margins decide among equal votes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import filled, prepare, raw_bytes, slices
from talewind.session import cut_lineage

DIMENSIONS = 2048
#: The classifier is fitted on at most about so many labelled rows, as many of each language; everything else reads all rows.
SAMPLE = 8000
#: Machines of one versus one grow with the square of their classes; more classes than so many are first parted in halves.
MOST_CLASSES = 64
ROWS = 256
# Families of languages by their ISO 639-1 codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi fo".split(),
    "romance": "fr es it pt ro ca gl oc la rm co wa".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "indic": "hi ur bn pa gu mr ne si or as sa".split(),
    "turkic": "tr az kk uz ky tk tt ug".split(),
    "uralic": "fi et hu se".split(),
    "semitic": "ar he mt am ti".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_BYTES = np.full(256, 32, np.uint8)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the trigrams' shares for each text, as rows of length 1 (0 without letters). Whole texts are read."""
    texts = pc.utf8_lower(filled(texts))
    data, starts = raw_bytes(texts)
    data = _BYTES[data]
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    if len(data) < 3:
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    code = (data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << 8) | (data[2:].astype(np.uint32) << 16)) * np.uint32(0x9E3779B1)
    # A trigram within one text, with a letter in its middle.
    inside = (doc[:-2] == doc[2:]) & (data[1:-1] != 32)
    place = doc[:-2][inside] * DIMENSIONS + (code[inside] >> np.uint32(21)).astype(np.int64)
    counts = np.bincount(place, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(np.float32)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def fit_pair(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss, by coordinate descent in the dual."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha, size, rng = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / c, np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            to = max(0.0, alpha[i] - gradient / size[i])
            if to != alpha[i]:
                w += (to - alpha[i]) * y[i] * x[i]
                alpha[i] = to
    return w.astype(np.float32)


class OneVersusOne:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y.tolist()))
        self.pairs, weights = list(combinations(range(len(self.classes)), 2)), []
        for a, b in self.pairs:
            own = (y == self.classes[a]) | (y == self.classes[b])
            weights.append(fit_pair(x[own], np.where(y[own] == self.classes[a], 1.0, -1.0)))
        self.weights = np.array(weights, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its class, and how sure its machines are (0 to 1)."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margins[:, k] > 0
            votes[:, b] += margins[:, k] <= 0
            for c, sign in ((a, 1), (b, -1)):
                sums[:, c] += sign * margins[:, k]
                least[:, c] = np.minimum(least[:, c], sign * margins[:, k])
        best = (votes + 1e-3 * np.tanh(sums)).argmax(1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(x)), best], -20, 20)))


class Halves:
    """Very many classes: a machine tells one half from the other, parted by the main direction of the classes' means."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y.tolist()))
        code = np.searchsorted(np.array(self.classes, dtype=object), y)
        means = np.array([x[code == c].mean(0) for c in range(len(self.classes))], np.float64)
        main = np.linalg.svd(means - means.mean(0), full_matrices=False)[2][0]
        order = np.argsort(means @ main, kind="stable")
        self.halves = [np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])]
        side = np.isin(code, self.halves[1]).astype(int)
        self.side = OneVersusOne(x, side)
        self.within = [machines(x[side == s], y[side == s]) for s in (0, 1)]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side, sure = self.side(x)
        best = np.zeros(len(x), np.int64)
        for s, half in enumerate(self.halves):
            own = np.flatnonzero(side == s)
            if len(own):
                inner, more = self.within[s](x[own])
                best[own] = half[inner]
                sure[own] *= more
        return best, sure


def machines(x: np.ndarray, y: np.ndarray) -> OneVersusOne | Halves:
    return OneVersusOne(x, y) if len(set(y.tolist())) <= MOST_CLASSES else Halves(x, y)


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: np.ndarray, family_of: dict[str, str] | None = None):
        known = FAMILY_OF if family_of is None else family_of
        families = np.array([known.get(lang, f"={lang}") for lang in langs.tolist()], dtype=object)
        self.top = machines(x, families)
        self.within = [machines(x[families == f], langs[families == f]) for f in self.top.classes]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self.top(x)
        out = np.empty(len(x), dtype=object)
        for f, machine in enumerate(self.within):
            own = np.flatnonzero(family == f)
            if len(own):
                best, inner = machine(x[own])
                out[own] = np.array(machine.classes, dtype=object)[best]
                sure[own] *= inner
        return out, sure


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, sample: int = SAMPLE, family_of: dict[str, str] | None = None) -> Hierarchy | None:
    """A hierarchy learned from the rows with a language outside the held-out fold, or None if there are none.

    Any number of languages is learned, as long as some of their rows are drawn: about ``sample`` rows, as many of each."""
    given = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0)).select("doc_id", "text", "lang")
    counts = cut_lineage(given.groupBy("lang").agg(F.count("*").alias("_of")))
    languages = counts.count()
    if not languages:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    share = F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(sample / languages) / F.col("_of"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    def learn(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
        langs = np.array(table.column("lang").to_pylist(), dtype=object)
        order = np.lexsort((x.sum(1), x[:, :64].sum(1), langs.astype(str)))
        return pa.table({"model": pa.array([pickle.dumps(Hierarchy(x[order], langs[order], family_of))], pa.binary())})

    drawn = given.join(counts, "lang").filter(draw < share).select("text", "lang")
    rows = drawn.mapInArrow(read, "lang string, x binary")
    # One group of about ``sample`` rows of 4 KB.
    model = rows.groupBy(F.lit(0).alias("_g")).applyInArrow(lambda table: learn(table), "model binary").first()
    return pickle.loads(model[0]) if model else None


def predicted(docs: DataFrame, sample: int = SAMPLE, family_of: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang; others are not read).

    lang_pred is a learned language, or 'und' with score 0 where the text is null or has no letter, or where no row could be
    learned from. A null doc_id belongs to no fold: it is not held out and nothing is learned from it. Repeated rows are
    predicted alike; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, family_of))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            for at in range(0, part.num_rows, ROWS):
                batch = part.slice(at, ROWS)
                letters = pc.match_substring_regex(filled(batch.column("text")), r"\p{L}").to_numpy(zero_copy_only=False)
                lang, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
                if model and letters.any():
                    best, sure = model(features(batch.column("text")))
                    lang[letters], score[letters] = best[letters], sure[letters]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
