"""Toxicity by class-conditional Kneser-Ney models.

Two models over the letters of words, one of toxic and one of ordinary
documents, differ in their high orders only; both back off to one shared
Kneser-Ney model, whose counts pool both classes. A rare expression that
neither class knows thus gets the same likelihood from both, and only
what a class has seen moves the ratio. Toxic and ordinary log-likelihoods are compared
per letter, in every expression of a whole document (a few words
in a row, so that length doesn't dilute it); the most toxic one decides, on a logistic scale fitted on
labelled documents that the models did not see. Orders, discount and length of an expression were chosen by
cross-validation within the labels learnt from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fold_of, fresh, python_ready, staged
from .held import held

FOLDS, HELD_OUT = 3, 1
#: About as many labelled documents of each class are fitted, a quarter of them for the scale.
PER_CLASS = 3000
ORDER, SHARED = 5, 4
DISCOUNT = 0.9
#: Likelihood of a letter that no count covers.
FLOOR = 1e-4
THRESHOLD = 0.7
#: Words of an expression.
EXPRESSION = 2
#: Longest words that are cached, and grams or words held before they are sent on.
SHORT, MANY = 40, 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall((text or "").lower())


def grams(word: str) -> Iterator[str]:
    """The ORDER-grams of a word between its marks, one for each letter and the end."""
    s = "^" * (ORDER - 1) + word + "$"
    return (s[i : i + ORDER] for i in range(len(s) - ORDER + 1))


def continuations(counts) -> Counter:
    """For each gram of one order below: before how many different letters of ``counts`` it is found."""
    return Counter(g[1:] for g in counts)


class Backoff:
    """Interpolated absolute discounting over counts of grams of one order, in the form that backs off.

    ``logs``: log-probabilities of the grams counted. ``weights``: by context, the log of what an uncounted
    gram's shorter one is multiplied with; a context that isn't there passes it on as it is.
    """

    def __init__(self, counts: dict[str, int], lower):
        total: Counter = Counter()
        types: Counter = Counter()
        for g, k in counts.items():
            total[g[:-1]] += k
            types[g[:-1]] += 1
        self.weights = {c: math.log(DISCOUNT * types[c] / total[c]) for c in total}
        self.logs = {g: math.log(max(k - DISCOUNT, 0.0) / total[g[:-1]] + math.exp(self.weights[g[:-1]] + lower(g[1:]))) for g, k in counts.items()}


class Ratio:
    """log P(letter | context, toxic) - log P(letter | context, ordinary), for ORDER-grams.

    A class's counts of ORDER-grams are its own; each order below counts in how many
    different contexts of the class a gram stands, and the shared model of ``SHARED`` letters
    and fewer does so over both classes.
    """

    def __init__(self, toxic: dict[str, int], ordinary: dict[str, int]):
        orders: list[list[dict[str, int]]] = []
        for counts in (toxic, ordinary):
            orders.append([counts])
            while len(orders[-1]) < ORDER - SHARED:
                orders[-1].append(continuations(orders[-1][-1]))
        pooled: dict[str, int] = orders[0][-1] | orders[1][-1]
        below = []
        for _ in range(SHARED):
            pooled = continuations(pooled)
            below.append(pooled)
        self.shared: list[Backoff] = [Backoff({}, None)]
        for counts in reversed(below):
            self.shared.append(Backoff(counts, self.of_shared))
        self.logs: tuple[dict[str, float], ...] = ({}, {})
        self.weights: tuple[dict[str, float], ...] = ({}, {})
        for k in (0, 1):
            for counts in reversed(orders[k]):
                one = Backoff(counts, lambda g: self.of_class(k, g))
                self.logs[k].update(one.logs)
                self.weights[k].update(one.weights)
        self.known: dict[str, float] = {}

    def of_shared(self, gram: str) -> float:
        passed = 0.0
        while gram:
            one = self.shared[len(gram)]
            if gram in one.logs:
                return passed + one.logs[gram]
            passed += one.weights.get(gram[:-1], 0.0)
            gram = gram[1:]
        return passed + math.log(FLOOR)

    def backed(self, k: int, gram: str) -> tuple[float, str]:
        """(log-probability so far, what is left to the shared model) of a gram in class ``k``."""
        logs, weights, passed = self.logs[k], self.weights[k], 0.0
        while len(gram) > SHARED:
            if gram in logs:
                return passed + logs[gram], ""
            passed += weights.get(gram[:-1], 0.0)
            gram = gram[1:]
        return passed, gram

    def of_class(self, k: int, gram: str) -> float:
        passed, rest = self.backed(k, gram)
        return passed + self.of_shared(rest) if rest else passed

    def gram(self, g: str) -> float:
        if g in self.known:
            return self.known[g]
        if len(self.known) >= 2 * MANY:
            self.known.clear()
        (a, rest_a), (b, rest_b) = self.backed(0, g), self.backed(1, g)
        if not (rest_a and rest_b):  # what both leave to the shared model is the same
            a, b = a + (self.of_shared(rest_a) if rest_a else 0.0), b + (self.of_shared(rest_b) if rest_b else 0.0)
        self.known[g] = found = a - b
        return found


class Scorer:
    def __init__(self, toxic: dict[str, int], ordinary: dict[str, int], limit: int = 2 * MANY):
        self.ratio, self.limit, self.words = Ratio(toxic, ordinary), limit, {}

    def word(self, w: str) -> float:
        if w in self.words:
            return self.words[w]
        found = sum(map(self.ratio.gram, grams(w)))
        if len(w) <= SHORT:
            if len(self.words) >= self.limit:
                self.words.clear()
            self.words[w] = found
        return found

    def evidence(self, text: str | None) -> float:
        """Ratio per letter (and word's end) of the text's strongest expression, of all of a shorter text; zero without words."""
        words, known = letter_words(text), self.words
        if not words:
            return 0.0
        ratios = np.array([known[w] if w in known else self.word(w) for w in words])
        sizes = np.array([len(w) + 1 for w in words])
        window = np.ones(min(EXPRESSION, len(words)))
        return float((np.convolve(ratios, window, "valid") / np.convolve(sizes, window, "valid")).max())


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of ``x`` and a constant, by Newton's method with a small ridge; both classes weigh alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + pull * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS):
    """(toxic counts, ordinary counts, weights), from about ``per_class`` documents of each class; None if a class is missing.

    The ids come from the labels by a hash against the class's count, so there are about
    2 * ``per_class`` of them, and they are broadcast: no text is shuffled. A word counts once
    for each document that has it, so that one document's favourites don't pass for its class's. The
    driver gets counts of letter n-grams of the documents chosen, and the evidence of each
    document of the scale's quarter. Labels that are neither 0 nor 1, or of a null id, teach nothing; of an id's labels the
    larger holds; null and empty texts have no grams. Without labels: None.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold_of(F.col("id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1_000_000)) / 1_000_000
    chance = F.when(F.col("y") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    scale = F.pmod(F.xxhash64(F.lit("scale"), F.col("id")), F.lit(4)) == 0
    chosen = rows.where(draw < chance).withColumn("scale", scale)
    texts = staged(python_ready(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y", "scale"), "toxic-texts")

    def as_batch(y: int, found: Counter):
        return pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["y", "gram", "n"])

    def count(batches):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                own = found[y]
                for w in set(letter_words(text.as_py())):
                    for g in grams(w):
                        own[g] += 1
                        if len(own) >= MANY:
                            yield as_batch(y, own)
                            own.clear()
        for y, own in found.items():
            if own:
                yield as_batch(y, own)

    counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
    found = texts.where("NOT scale").select("text", "y").mapInArrow(count, "y int, gram string, n long").groupBy("y", "gram").agg(F.sum("n").alias("n")).toArrow()
    for y, gram, n in zip(*(found.column(k).to_pylist() for k in ("y", "gram", "n"))):
        counts[1 - y][gram] = n
    if not all(counts):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def measure(batches):
        own = None
        for batch in batches:
            own = own or Scorer(*shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([own.evidence(t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1)], ["x", "y"])

    table = texts.where("scale").select("text", "y").mapInArrow(measure, "x double, y int").toPandas()
    if table.y.nunique() < 2:
        return None
    weights = logistic(table[["x"]].to_numpy(), table.y.to_numpy())
    return shared, weights


def score_udf(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Arrow function: whole text to a score from 0 to 1, fitted outside the held-out fold."""
    fitted = fit(docs, labels, id_col, text_col, label_col)
    shared, weights = fitted or (None, None)
    name = uuid4().hex

    def run(batches):
        own = held(name, lambda: Scorer(*shared.value)) if shared is not None else None
        for column in batches:
            if own is None:
                yield pa.array(np.zeros(len(column)))
                continue
            found = np.array([own.evidence(t.as_py()) for t in column], np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(found * weights[0] + weights[1], -30, 30))))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "double").asNondeterministic()  # so that it's never run twice for a row


def score_documents(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; a map without shuffle.

    Learns from rows of ``labels`` (0 or 1; others and nulls are passed over)
    outside the held-out fold only; if an id has both labels it counts as toxic. Null texts and texts
    without letters have the score of no evidence. If either class is missing, all
    scores are 0. A null id is neither learnt from nor held out. Equal rows each get a row.
    """
    score = score_udf(labelled_docs, labels, id_col, text_col, label_col)
    held = F.coalesce(fold_of(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False))
    out = python_ready(docs).select(F.col(id_col).alias("doc_id"), held.alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_civil(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, with a score below ``threshold``; a map without shuffle.

    Scores are those of ``score_documents``: null texts and texts without letters have the score of
    no evidence, and if nothing can be learnt every row stays. Equal rows go or stay
    together. No rows: no rows. Columns of any name stay as they are.
    """
    (mark,) = fresh(docs, "toxic_score")
    score = score_udf(labelled_docs, labels, id_col, text_col, label_col)
    return python_ready(docs).withColumn(mark, score(F.col(text_col))).where(F.col(mark) < threshold).drop(mark)
