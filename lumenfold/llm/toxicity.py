"""Operator 10: toxicity by a counterfactual-regularised linear classifier.

Features of a text: its distinct lower-case words and their prefixes, chosen by a
signed likelihood-ratio test on the training rows. A logistic regression is trained on labelled
rows; every labelled sentence that names an identity term is also scored with the term swapped for
each other term of its group, and the squared change of score is penalised, so that a group's
name alone moves no score.

Training reads at most SAMPLE rows of either label, chosen by a hash of doc_id. Their texts stay on the executors: features
are counted and tested there, and the driver gets, for each row, which of at most MOST_FEATURES it has, and how often
each swap changes which of them; so what it holds is bounded however long the texts are. Scoring reads every whole text where it
lies, in one task, without a shuffle.

Defined results: an empty table gives an empty one; only named columns are read, so others cannot clash; of rows that tie for the
last place of the sample or of the features the order of hash or name decides. Null and empty texts have the score of no feature at all; a row is scored by its text alone, so
equal texts have equal scores; with no labelled row of either kind every score is the base rate
(0.5 with no label at all). doc_ids that occur more than once are scored row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Most training rows of each label: the bound of the sample that a classifier may be fitted on.
SAMPLE = 4000
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: The size of the model: its features, the strongest by the test.
MOST_FEATURES = 4000
LEAST_TEST, LEAST_ROWS = 10.8, 4
L2, COUNTERFACTUAL, ROUNDS = 1e-3, 1.0, 300
#: Identity terms; a term is swapped with the others of its group.
IDENTITY = (
    "christian muslim jewish hindu buddhist atheist catholic protestant",
    "christians muslims jews hindus buddhists atheists catholics protestants",
    "black white asian african european latino arab",
    "gay straight lesbian bisexual transgender queer",
    "man woman", "men women", "boy girl", "boys girls", "he she", "his her",
    "american mexican chinese indian german french spanish turkish polish",
    "immigrant native refugee", "immigrants natives refugees", "young old", "deaf blind disabled",
    "mann frau", "männer frauen", "christen muslime juden", "homme femme", "hommes femmes",
    "chrétiens musulmans juifs", "hombre mujer", "hombres mujeres", "cristianos musulmanes judíos",
)
SWAPS = {w: [x for x in g.split() if x != w] for g in IDENTITY for w in g.split()}


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def parts(word: str) -> list[str]:
    """The features of one word: itself, and marked prefixes."""
    return [word] + [word[:n] + "-" for n in PREFIXES if len(word) > n]


def features(text: str) -> set[str]:
    return {f for w in words(text) for f in parts(w)}


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Features of each sentence with an identity term, and of the sentence with the term swapped."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        said = words(sentence)
        for term in said & SWAPS.keys():
            mine = {f for w in said for f in parts(w)}
            for other in SWAPS[term]:
                out.append((mine, {f for w in (said - {term}) | {other} for f in parts(w)}))
    return out


def chosen(texts: list[str], labels: list[int]) -> list[str]:
    """Features whose presence depends on the label by a likelihood-ratio test, strongest first."""
    seen = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, labels, strict=True):
        seen[y].update(features(t))
    n1, n = sum(labels), len(labels)
    log = lambda k, e: k * math.log(k / e) if k else 0.0
    scored = []
    for f in seen[1].keys() | seen[0].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b >= LEAST_ROWS:
            e = (a + b) / n
            g = 2 * (log(a, e * n1) + log(b, e * (n - n1)) + log(n1 - a, (1 - e) * n1) + log(n - n1 - b, (1 - e) * (n - n1)))
            if g >= LEAST_TEST:
                scored.append((-g, f))
    return [f for _, f in sorted(scored)[:MOST_FEATURES]]


def swaps(texts: Iterable[str], at: dict[str, int]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Of each counterfactual pair, the model's features that the swap takes away and brings."""
    place = lambda fs: tuple(sorted(at[f] for f in fs if f in at))
    for t in texts:
        for mine, other in counterfactuals(t):
            yield place(mine - other), place(other - mine)


def fitted(size: int, rows: list[np.ndarray], labels: list[int], pairs: dict[tuple, int], penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: the features of each text; pairs: how often a swap takes and brings features."""
    n1, n = sum(labels), len(labels)
    r, k = np.repeat(np.arange(n), [len(x) for x in rows]), np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    y = np.array(labels, dtype=float)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))  # both labels count alike
    kinds = sorted(pairs)
    often = np.array([pairs[x] for x in kinds], dtype=float)
    r0, r1 = (np.repeat(np.arange(len(kinds)), [len(x[i]) for x in kinds]) for i in (0, 1))
    k0, k1 = (np.array([j for x in kinds for j in x[i]], np.int64) for i in (0, 1))
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    score = lambda rows, cols, size: np.bincount(rows, w[cols], size)
    for step in range(1, ROUNDS + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(score(r, k, n) + bias, -30, 30)))
        error = weight * (p - y)
        grad = np.bincount(k, error[r], size) + L2 * w
        if kinds:
            change = (score(r0, k0, len(kinds)) - score(r1, k1, len(kinds))) * often * (2 * penalty / often.sum())
            grad += np.bincount(k0, change[r0], size) - np.bincount(k1, change[r1], size)
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, float(bias)


def one_sided(n: int, n1: int) -> float:
    """The intercept where there is no label to tell from another."""
    return 0.0 if not n else (6.0 if n1 else -6.0)


def trained(texts: list[str], labels: list[int], penalty: float = COUNTERFACTUAL) -> tuple[dict[str, float], float]:
    """Weights by feature, and the intercept, from texts at hand; model() gives the same from a table."""
    n1, n = sum(labels), len(labels)
    if not n1 or n1 == n:
        return {}, one_sided(n, n1)
    at = {f: j for j, f in enumerate(chosen(texts, labels))}
    rows = [np.array(sorted(at[f] for f in features(t) if f in at), np.int64) for t in texts]
    w, bias = fitted(len(at), rows, labels, Counter(swaps(texts, at)), penalty)
    return {f: float(w[j]) for f, j in at.items()}, bias


class Scorer:
    """Scores texts; remembers which of a word's parts carry weight."""

    def __init__(self, weights: dict[str, float], bias: float, memory: int = 400_000):
        self.weights, self.bias, self.memory, self.known = weights, bias, memory, {}

    def __call__(self, text: str) -> float:
        found: set[str] = set()
        known = self.known
        for w in words(text):
            has = known.get(w)
            if has is None:
                has = [f for f in parts(w) if f in self.weights]
                if len(known) < self.memory:
                    known[w] = has
            found.update(has)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@F.arrow_udf(T.ArrayType(T.StringType()))
def featured(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(features(x.as_py() or "")) for x in texts], pa.list_(pa.string()))


def strongest(rows: DataFrame, n: int, n1: int) -> list[str]:
    """chosen() of a table (text, toxic): at most MOST_FEATURES names."""
    counts = rows.select("toxic", F.explode(featured("text")).alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("both"))
    a, both = F.col("a").cast("double"), F.col("both").cast("double")
    log = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    e = both / n
    g = 2 * (log(a, e * n1) + log(both - a, e * (n - n1)) + F.when(both < n, log(n1 - a, (1 - e) * n1) + log((n - n1) - (both - a), (1 - e) * (n - n1))).otherwise(0.0))
    strong = counts.filter(both >= LEAST_ROWS).withColumn("g", F.round(g, 9)).filter(F.col("g") >= LEAST_TEST)
    return [r["f"] for r in strong.orderBy(F.col("g").desc(), "f").limit(MOST_FEATURES).collect()]


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Trains on rows out of the held-out fold: at most `sample` of either label, and 2 * sample where doc_ids repeat."""
    usable = labels.filter((held_out() == F.lit(False)) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    picks = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * sample rows of two numbers
    rows = docs.select("doc_id", c.text_of().alias("text")).join(picked, "doc_id").filter(F.length("text") > 0)
    rows = c.written(rows.select("text", "toxic", F.xxhash64("text", "toxic").alias("h"), F.monotonically_increasing_id().alias("i")))
    if rows.count() > 2 * sample:
        rows = rows.join(F.broadcast(rows.select("h", "i").orderBy("h", "i").limit(2 * sample)), ["h", "i"])
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n1 or n1 == n:
        return {}, one_sided(n, n1)
    at = {f: j for j, f in enumerate(strongest(rows, n, n1))}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(at[f] for f in features(x.as_py()) if f in at) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "h", "has"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = Counter(swaps((x.as_py() for x in batch.column(0)), at))
            lost, gained = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(lost, pa.list_(pa.int32())), pa.array(gained, pa.list_(pa.int32())), pa.array(list(pairs.values()), pa.int64())], names=["lost", "gained", "n"])

    has = rows.select("text", "toxic", "h").mapInArrow(placed, "toxic int, h long, has array<int>").collect()
    has = sorted((r["toxic"], r["h"], r["has"]) for r in has)
    pairs = rows.select("text").mapInArrow(swapped, "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n")).collect()
    w, bias = fitted(len(at), [np.array(x[2], np.int64) for x in has], [x[0] for x in has], {(tuple(r["lost"]), tuple(r["gained"])): r["n"] for r in pairs}, COUNTERFACTUAL)
    return {f: float(w[j]) for f, j in at.items()}, bias


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def scored(docs: DataFrame, weights: dict[str, float], bias: float, text: str = "text"):
    """The score of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scorer = Scorer(weights, bias)
        return pa.array([scorer(x.as_py() or "") for x in texts], pa.float64())

    return score(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias = model(docs, c.table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out().alias("held_out"), scored(docs, weights, bias).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
