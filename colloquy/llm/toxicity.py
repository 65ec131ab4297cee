"""Toxicity scores of deobfuscated text by a noisy channel.

A disguised word is a lattice of the characters that may have been meant:
letters for look-alike digits and signs, one or two letters for a stretched one,
and nothing for separators. A Viterbi search under a trigram model of the
corpus's characters restores the word. Restored words are scored by how much
more often they occur in toxic texts, and a logistic model turns a text's
highest word scores into a probability.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, settled, table

# Labelled texts that the classifier is fitted on, at most about so many of each class, and the words it keeps.
SAMPLE = {1: 4_000, 0: 8_000}
LEAST_CONTEXTS = 3
PREFIXES = (4, 5, 6)
FOLDS = 5
THRESHOLD = 0.5
REMEMBERED = 100_000
GATHERED = 50_000

# Letters of the character model; 0 is what separates words, the last code any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1
SIZE = OTHER + 1
MEANT = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c"}
MEANT_COST, STRETCH_COST, DROP_COST, DROP_MEANT_COST, SPLIT_COST = 1.0, 0.5, 0.5, 7.0, 1.0
EDGES = ".,;:!?\"'()[]{}<>*%&#~`_=/\\-…“”„‘’«»¿¡"
STRETCHED = re.compile(r"(.)\1\1", re.S)
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")

_TABLE = np.full(0x250, 0, np.int64)
for _c in range(0x250):
    _TABLE[_c] = CODE.get(chr(_c), OTHER if chr(_c).isalpha() else 0)


def letter_codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c < len(_TABLE), _TABLE[np.minimum(c, len(_TABLE) - 1)], OTHER)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three characters follow each other in all texts; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            for part in portions(batch.column(0), 1 << 18):
                c = letter_codes(" " + "  ".join(part.to_pylist()) + " ")
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["three", "n"])

    out = np.zeros(SIZE ** 3)
    for r in docs.where("text is not null").select("text").mapInArrow(count, "three long, n long") \
            .groupBy("three").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["three"]] = r["n"]
    return out.reshape(SIZE, SIZE, SIZE)


def log_model(counts: np.ndarray) -> array:
    """Log probability of a character after two, each order smoothed by the one below; flat, in four bytes each."""
    p = (counts.sum(axis=(0, 1)) + 0.1) / (counts.sum() + 0.1 * SIZE)
    two = counts.sum(axis=0)
    p = (two + 5 * p[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
    p = (counts + 5 * p[None, :, :]) / (counts.sum(axis=2, keepdims=True) + 5)
    return array("f", np.log(p).ravel().astype(np.float32).tobytes())


def arcs(c: str, n: int) -> list[tuple[str, float]]:
    """What ``n`` equal characters may stand for, each with its cost."""
    if c in MEANT:
        once = [(m, MEANT_COST + STRETCH_COST * (n > 1)) for m in MEANT[c]]
        return [*once, *((m * 2, MEANT_COST + STRETCH_COST * (n > 2)) for m in MEANT[c] if n > 1), ("", DROP_MEANT_COST)]
    if c.isalpha():
        return [(c, STRETCH_COST * (n > 1)), *([(c * 2, STRETCH_COST * (n > 2))] if n > 1 else [])]
    return [("", DROP_COST), (" ", SPLIT_COST)]


class Restorer:
    """Restores disguised words under a character model."""

    def __init__(self, model: array):
        self.model = model

    def word(self, token: str) -> str:
        """The most likely words meant by a lower-case token."""
        model, code = self.model, CODE
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for c, run in groupby(token):
            ways, new = arcs(c, sum(1 for _ in run)), {}
            for (a, b), (score, path) in states.items():
                for out, cost in ways:
                    x, y, s = a, b, score - cost
                    for ch in out:
                        k = 0 if ch == " " else code.get(ch, OTHER)
                        s += model[(x * SIZE + y) * SIZE + k]
                        x, y = y, k
                    best = new.get((x, y))
                    if best is None or s > best[0]:
                        new[x, y] = (s, (path, out) if out else path)
            states = new
        _, path = max(((s + model[(a * SIZE + b) * SIZE], p) for (a, b), (s, p) in states.items()), key=lambda t: t[0])
        parts = []
        while path:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts))

    def restore(self, token: str) -> str:
        """A lower-case token without the signs at its edges, restored if it is disguised.

        A token of letters that are not stretched has one path only: itself.
        """
        core = token.strip(EDGES)
        return core if core.isalpha() and not STRETCHED.search(core) else self.word(core) if core else ""


def spaced(low: str) -> list[str]:
    """Words written letter by letter."""
    return ["".join(m[0].split()) for m in SPACED.finditer(low)]


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    return low.split() + spaced(low)


def restore_text(text: str, restorer: Restorer) -> str:
    """The text in lower case with every word restored; a word written letter by letter follows at the end."""
    return " ".join(w for w in map(restorer.restore, tokens_of(text)) if w)


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


class Scorer:
    """Word scores of a text."""

    def __init__(self, model: array, weights: dict[str, float]):
        self.restorer, self.weights, self.known = Restorer(model), weights, {}

    def weight(self, token: str) -> float:
        best = 0.0
        for word in self.restorer.restore(token).split():
            for f in features(word):
                best = max(best, self.weights.get(f, 0.0))
        if len(token) <= 64:
            self.known[token] = best
        return best

    def of(self, text: str) -> tuple[float, float, float]:
        """The two highest scores among different words, and how large a share of all words scores, on a logarithmic scale."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, words = self.known, tokens_of(text)
        score = {t: known[t] if t in known else self.weight(t) for t in set(words)}
        found = {t: w for t, w in score.items() if w > 0}
        if not found:
            return 0.0, 0.0, 0.0
        top = [*heapq.nlargest(2, found.values()), 0.0]
        total = sum(found[t] for t in words if t in found)
        return top[0], top[1], math.log1p(100 * total / (len(words) + 10))


def contexts(docs: DataFrame, model, only) -> DataFrame:
    """``feature, first, n``: in how many different contexts (words beside it) a feature occurs.

    ``first`` counts those of texts that are not ``second``, ``n`` all. Copies of
    a text add no contexts. ``only`` limits the features to a broadcast set.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, wanted, rows = Restorer(model.value), only and only.value, set()
        for batch in batches:
            for t, second in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = ["", *(w for x in tokens_of(t.as_py() or "") for w in restorer.restore(x).split()), ""]
                for i in range(1, len(words) - 1):
                    mine = [x for x in features(words[i]) if wanted is None or x in wanted]
                    if mine:
                        near = xxhash.xxh3_64_intdigest(f"{words[i - 1]} {words[i + 1]}") >> 1
                        rows.update((x, near, not second) for x in mine)
                        if len(rows) > GATHERED:
                            yield frame(rows)
                            rows.clear()
        yield frame(rows)

    def frame(rows: set) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        kinds = {"feature": pa.string(), "near": pa.int64(), "first": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    once = docs.select("text", "second").mapInArrow(spread, "feature string, near long, first boolean").groupBy("feature", "near").agg(F.max("first").alias("first"))
    return once.groupBy("feature").agg(F.count_if("first").alias("first"), F.count("*").alias("n"))


def word_weights(sample: DataFrame, model) -> tuple[dict[str, float], dict[str, float]]:
    """Lower bounds of the log odds of the words and beginnings that mark toxic texts.

    Once from the texts that are not ``second``, once from all. The sample is
    bounded, and so is what it gives.
    """
    context = sample.sparkSession.sparkContext
    size = {(r["toxic"], r["second"]): r["count"] for r in sample.groupBy("toxic", "second").count().collect()}
    of = lambda toxic: sample.where(F.col("toxic") == toxic).select("text", "second")
    seen = {r["feature"]: (r["first"], r["n"]) for r in contexts(of(1), model, None).where(f"n >= {LEAST_CONTEXTS}").toLocalIterator()}
    other = {}
    if seen:
        wanted = context.broadcast(frozenset(seen))
        other = {r["feature"]: (r["first"], r["n"]) for r in contexts(of(0), model, wanted).toLocalIterator()}
        wanted.unpersist()
    weights = []
    for part, kinds in enumerate(((False,), (False, True))):
        n_toxic, n_clean = (sum(size.get((k, s), 0) for s in kinds) for k in (1, 0))
        out = {}
        for f, counts in seen.items() if n_toxic and n_clean else ():
            t, c = counts[part], other.get(f, (0, 0))[part]
            bound = math.log((t + 0.5) / n_toxic) - math.log((c + 0.5) / n_clean) - 1.64 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
            if t >= LEAST_CONTEXTS and bound > 1:
                out[f] = bound
        weights.append(out)
    return weights[0], weights[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method; no coefficient is below zero.

    A row counts as ``weight`` rows, or as one.
    """
    weight = np.ones(len(x)) if weight is None else weight
    x, active = np.column_stack([np.ones(len(x)), x]), list(range(x.shape[1] + 1))
    while True:
        z, b = x[:, active], np.zeros(len(active))
        penalty = np.diag([1e-6] + [ridge] * (len(active) - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        low = [a for a, v in zip(active[1:], b[1:], strict=True) if v < 0]
        if not low:
            out = np.zeros(x.shape[1])
            out[active] = b
            return out
        active = [a for a in active if a not in low]


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


class Model:
    """A fitted classifier: the broadcast character model and word scores, and the logistic coefficients.

    Without coefficients every score is ``rate``.
    """

    def __init__(self, model, weights, coefficients: np.ndarray | None, rate: float):
        self.model, self.weights, self.coefficients, self.rate = model, weights, coefficients, rate

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic; a null text is an empty one."""
        model, weights, b, rate = self.model, self.weights, self.coefficients, self.rate
        if b is None:
            return F.lit(rate)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = Scorer(model.value, weights.value)
            for texts in batches:
                x = np.array([scorer.of(t.as_py() or "") for t in texts]).reshape(-1, 3)
                yield pa.array(1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30))))

        return F.arrow_udf(run, "double")(text)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on texts of ``docs`` that ``labels`` marks, but those of fold 0.

    The character model counts all texts. Of each class a hash of doc_id picks
    about SAMPLE texts. The logistic model is fitted on half of the folds, with
    word scores from the other half; the final word scores are from all. A row of
    the sample counts as many times as its class was thinned, so that the rate of
    toxic texts is that of all labels. Without texts of both classes every score
    is the share of toxic ones.
    """
    spark = docs.sparkSession
    marked = settled(labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                     .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(fold(F.col("doc_id")) != 0))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE[1] / max(1, n.get(1, 0)))).otherwise(min(1.0, SAMPLE[0] / max(1, n.get(0, 0))))
    picked = settled(marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)))
    kept = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    # At most about the sum of SAMPLE rows of two numbers.
    sample = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
                     .select("text", "toxic", (fold(F.col("doc_id")) > FOLDS // 2).alias("second")).repartition(16, F.xxhash64("text")))
    model = spark.sparkContext.broadcast(log_model(trigram_counts(docs)))
    half, weights = word_weights(sample, model)
    halves = spark.sparkContext.broadcast(half)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.value, halves.value)
        for batch in batches:
            x = np.array([s.of(t.as_py() or "") for t in batch.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i].copy()) for i in range(3)), batch.column(1).cast(pa.float64())], list("abcy"))

    # As many rows as the sample has, of four numbers.
    rows = sample.where("second").select("text", "toxic").mapInArrow(measure, "a double, b double, c double, y double") \
        .orderBy("a", "b", "c", "y").toPandas().to_numpy()
    halves.unpersist()
    total = sum(n.values())
    if not half or len(set(rows[:, 3])) < 2:
        return Model(model, None, None, n.get(1, 0) / total if total else 0.0)
    thinned = np.array([n.get(k, 0) / max(1, kept.get(k, 0)) for k in (0, 1)])
    coefficients = fit_logistic(rows[:, :3], rows[:, 3], weight=thinned[rows[:, 3].astype(int)])
    return Model(model, spark.sparkContext.broadcast(weights), coefficients, 0.0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document.

    ``held_out`` tells the documents of fold 0, whose labels are never read. Only
    the text goes into a score.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score is below ``threshold``."""
    return docs.where(fit(docs, labels).score(F.col("text")) < threshold)


def op7_toxicity(spark, sf_dir) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
