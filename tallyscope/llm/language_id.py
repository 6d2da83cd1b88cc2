"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of one fixed public
vocabulary. A word's probability is the sum over all ways to cut it in pieces,
found by a forward pass; a text's is the product over its words.
Probabilities come from expectation-maximisation: pieces are
counted in every segmentation by its posterior weight.
"""

from __future__ import annotations

import re
import sys
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
from .token_counts import SPACE

UNDETERMINED = "und"
FOLDS = 5
#: About as many labelled documents of each language are fitted.
PER_LANGUAGE = 2000
ROUNDS = 3
#: Longest words, mark included, that are scored many at a time and cached.
SHORT = 48
#: Letters of the words that are scored at once.
AT_ONCE = 200_000
#: Least probability of a character that no piece of one character covers.
LEAST = 1e-12
#: Runs of word characters but decimal digits; a few of them hold fractions, superscripts, circled or Roman numerals, which are no letters.
_RUNS = re.compile(r"[^\W\d_]+")
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(f"[^{_NUMERALS}]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode's category L), marked at their start."""
    out = []
    for w in _RUNS.findall((text or "").lower()):
        if w.isalpha():
            out.append(SPACE + w)
        else:
            out += [SPACE + x for x in _LETTERS.findall(w)]
    return out


def letter_pieces(model_path: str) -> list[str]:
    """Pieces of a public sentencepiece vocabulary made of letters, lower-cased, and the bare word mark."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {m.id_to_piece(i).lower() for i in range(m.get_piece_size()) if not m.is_byte(i)}
    return sorted(p for p in found if p and re.fullmatch(f"{SPACE}?([^\\W\\d_]*)", p))


def logarithms(probs: np.ndarray) -> np.ndarray:
    """Of a matrix of probabilities; none for row 0, which stands for no piece."""
    out = np.full(probs.shape, -np.inf)
    out[1:] = np.log(np.maximum(probs[1:], 1e-300))
    return out


class Lattice:
    """Cuts of words into pieces, for many words of one length at a time.

    Row 0 of a matrix of log-probabilities stands for no piece, the last for a character
    that no piece of one character covers. All sums are of logarithms, so a word of
    any length has a finite one.
    """

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for k, p in enumerate(pieces, 1):
            self.matches.add_word(p, (len(p), k))
        self.matches.make_automaton()
        self.rows, self.longest = len(pieces) + 2, max(map(len, pieces), default=1)
        self.cuts: dict[int, list[tuple[int, int]]] = {}

    def of(self, n: int) -> list[tuple[int, int]]:
        if n not in self.cuts:
            self.cuts[n] = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
        return self.cuts[n]

    def ids(self, words: list[str]) -> np.ndarray:
        """(cuts, words): the row of the piece that each cut of each word is."""
        cuts = self.of(len(words[0]))
        blank = np.array([0 if j - i > 1 else self.rows - 1 for i, j in cuts], np.int32)
        # where, among the cuts, the one of size 0 that ends there would stand
        past = [k + 1 for k, (i, j) in enumerate(cuts) if j - i == 1]
        find, at, ids = self.matches.iter, [], []
        for base, w in zip(range(0, len(words) * len(cuts), len(cuts)), words):
            for end, (size, k) in find(w):
                at.append(base + past[end] - size)
                ids.append(k)
        out = np.tile(blank, len(words))
        out[at] = ids
        return np.ascontiguousarray(out.reshape(len(words), -1).T)

    def forward(self, ids: np.ndarray, n: int, logs: np.ndarray) -> np.ndarray:
        """(n + 1, words, languages): log-probability of each beginning, by all its cuts."""
        alpha = np.full((n + 1, ids.shape[1], logs.shape[1]), -np.inf)
        alpha[0] = 0
        for (i, j), k in zip(self.of(n), ids):
            if k.any():
                np.logaddexp(alpha[j], alpha[i] + logs[k], alpha[j])
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected number of each row of ``logs`` (one language) in words that occur ``counts`` times."""
        n, ids, out = len(words[0]), self.ids(words), np.zeros(self.rows)
        alpha = self.forward(ids, n, logs)[:, :, 0]
        beta = np.full_like(alpha, -np.inf)
        beta[n] = np.log(counts) - alpha[n]
        for (i, j), k in zip(reversed(self.of(n)), ids[::-1]):
            if k.any():
                ahead = logs[k, 0] + beta[j]
                out += np.bincount(k, np.exp(alpha[i] + ahead), self.rows)
                np.logaddexp(beta[i], ahead, beta[i])
        return out

    def expect_long(self, word: str, count: float, logs: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` what ``expected`` is of one word of any length; only the pieces that are in it are held, not all cuts."""
        n = len(word)
        ways: list[tuple[int, int, int]] = []  # (begin, end, row) by rising end
        single = np.zeros(n, bool)
        for end, (size, k) in self.matches.iter(word):
            ways.append((end + 1 - size, end + 1, k))
            single[end] |= size == 1
        ways += [(k, k + 1, self.rows - 1) for k in np.flatnonzero(~single).tolist()]
        ways.sort(key=lambda w: w[1])
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = 0
        for i, j, k in ways:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + logs[k])
        beta[n] = np.log(count) - alpha[n]
        for i, j, k in sorted(ways, key=lambda w: -w[0]):
            ahead = logs[k] + beta[j]
            out[k] += np.exp(alpha[i] + ahead)
            beta[i] = np.logaddexp(beta[i], ahead)

    def long(self, word: str, logs: np.ndarray) -> np.ndarray:
        """The same sum for one word of any length; only as many beginnings as the longest piece are held."""
        held = [np.zeros(logs.shape[1])]
        found = self.matches.iter(word)
        end, piece = next(found, (-1, None))
        for at in range(len(word)):
            ways, single = [], False
            while end == at:
                size, k = piece
                single |= size == 1
                ways.append(held[-size] + logs[k])
                end, piece = next(found, (-1, None))
            if not single:
                ways.append(held[-1] + logs[-1])
            held.append(np.logaddexp.reduce(ways))
            if len(held) > self.longest:
                del held[0]
        return held[-1]


def by_length(words) -> Iterator[list[str]]:
    sizes: dict[int, list[str]] = {}
    for w in words:
        sizes.setdefault(len(w), []).append(w)
    for n, found in sizes.items():
        step = max(1, min(4096, AT_ONCE // n))
        for a in range(0, len(found), step):
            yield found[a : a + step]


def fit(labelled: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities) from about ``per_language`` documents of each language.

    Documents are chosen by a hash of their id against the language's count. Their words, of any length, are
    counted on the executors; each round sends the probabilities out and
    brings one number per language and piece back, whatever the number of documents. Every
    character has some probability in every language, so all of them are finite logarithms.
    """
    pieces = letter_pieces(model_path)
    n_rows = len(pieces) + 2
    labelled = python_ready(labelled).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], pieces, np.zeros((n_rows, 0))
    chance = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / sizes[lang]))]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1_000_000)) / 1_000_000
    chosen = labelled.where(draw < chance).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.update((lang, w) for w in letter_words(text.as_py()))
            if seen:
                (lang, word), n = zip(*seen), list(seen.values())
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(n, pa.int64())], ["lang", "word", "n"])

    words = staged(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    place = {lang: k for k, lang in enumerate(langs)}
    # at first a piece weighs by its length, so that longer pieces stand a chance
    start = np.array([0.0, *[10.0 ** -(5 - min(len(p), 4) * 0.5) for p in pieces], 1e-9])
    probs = np.repeat((start / start.sum())[:, None], len(langs), 1)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(logarithms(probs))

        def expect(batches):
            lattice, total = Lattice(pieces), {}
            for batch in batches:
                own: dict[str, dict[str, int]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    own.setdefault(lang, {})[word] = n
                for lang, seen in own.items():
                    out = total.setdefault(lang, np.zeros(lattice.rows))
                    for word in [w for w in seen if len(w) > SHORT]:
                        lattice.expect_long(word, seen.pop(word), shared.value[:, place[lang]], out)
                    for group in by_length(seen):
                        out += lattice.expected(group, np.array([seen[w] for w in group], float), shared.value[:, place[lang], None])
            for lang, out in total.items():
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(out[at])], ["lang", "piece", "n"])

        rows = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(probs)
        counts[rows.column("piece").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
        counts[1:] += 0.01
        counts[-1] = np.maximum(counts[-1], 0.1)
        probs = np.maximum(counts / counts.sum(0), LEAST)
    assert np.isfinite(probs).all()
    return langs, pieces, probs


def groups(column: pa.Array, rows: int = 512, chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """A text column in lists of bounded rows and, but for one longer text, characters."""
    held, n = [], 0
    for x in column:
        x = x.as_py()
        if held and (len(held) == rows or n + len(x or "") > chars):
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x or "")
    if held:
        yield held


class Scorer:
    def __init__(self, pieces: list[str], probs: np.ndarray, limit: int = 250_000):
        self.lattice, self.logs_of, self.limit = Lattice(pieces), logarithms(probs), limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((1024, self.logs_of.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        for group in by_length(words):
            found = self.lattice.forward(self.lattice.ids(group), len(group[0]), self.logs_of)[-1]
            at = len(self.place)
            while len(self.logs) < at + len(group):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.logs[at : at + len(group)] = found
            self.place.update((w, at + k) for k, w in enumerate(group))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log-likelihoods by language; None for a text without letters.

        Words past the cache's limit are learnt in parts that fit it, each after a
        clear, and a text's sum is that of its parts. Long words are scored one by one.
        """
        cut = [letter_words(t) for t in texts]
        sums: list[np.ndarray | None] = [np.zeros(self.logs_of.shape[1]) if words else None for words in cut]
        for k, words in enumerate(cut):
            for w in (w for w in words if len(w) > SHORT):
                sums[k] += self.lattice.long(w, self.logs_of)
            cut[k] = [w for w in words if len(w) <= SHORT]
        new = {w for words in cut for w in words if w not in self.place}
        if len(self.place) + len(new) > self.limit:
            self.clear()
            new = {w for words in cut for w in words}
        parts = sorted(new) if len(new) > self.limit else list(new)  # so that a sum doesn't depend on the order of a set
        for a in range(0, max(1, len(parts)), self.limit):
            if a:
                self.clear()
            self.learn(set(parts[a : a + self.limit]))
            for k, words in enumerate(cut):
                if words:
                    sums[k] += self.total(words if len(parts) <= self.limit else [w for w in words if w in self.place])
        return sums

    def total(self, words: list[str]) -> np.ndarray:
        return self.logs[[self.place[w] for w in words]].sum(0, dtype=np.float64) if words else np.zeros(self.logs_of.shape[1])


def predict_udf(spark, langs: list[str], pieces: list[str], probs: np.ndarray):
    """Arrow function: whole text to (lang_pred, score), the posterior at equal priors."""
    shared, name = spark.sparkContext.broadcast((langs, pieces, probs)), uuid4().hex

    def run(batches):
        own = held(name, lambda: Scorer(*shared.value[1:]))
        for column in batches:
            names, scores = [], []
            for texts in groups(column):
                for logs in own.score(texts):
                    if logs is None or not langs:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    best = int(logs.argmax())
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "lang_pred string, score double").asNondeterministic()  # so that it's never run twice for a row


def fitted_udf(labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS):
    """A ``predict_udf`` fitted on rows of ``labelled`` outside fold 0."""
    model = fit(labelled.where(fold_of(F.col(id_col), folds) != 0), model_path, text_col, lang_col, id_col)
    return predict_udf(labelled.sparkSession, *model)


def identify(docs: DataFrame, labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; a map without shuffle.

    Only ids outside fold 0 and with a language are learnt from, and only their
    text and language. Null texts and texts without a letter are ``und`` with
    score 0; so is every text if nothing can be learnt. Equally likely languages:
    the first by code point. A null id is neither learnt from nor held out.
    """
    predict = fitted_udf(labelled, model_path, id_col, text_col, lang_col, folds)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold_of(F.col(id_col), folds) == 0, F.lit(False)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return chosen.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is known with a score of at least ``least``; a map without shuffle.

    Languages and scores are those of ``identify``, so null texts and texts without a letter go, and
    if nothing can be learnt every row goes. Equal rows go or stay together. No rows: no rows.
    """
    (mark,) = fresh(docs, "language")
    marked = docs.withColumn(mark, fitted_udf(labelled, model_path, id_col, text_col, lang_col)(F.col(text_col)))
    return marked.where((F.col(mark)["lang_pred"] != UNDETERMINED) & (F.col(mark)["score"] >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
