"""Token counts of a unigram tokenizer, without tokens.

An Aho-Corasick automaton finds all vocabulary pieces in a text; dynamic
programming over their ends carries the best score and the number of pieces of
the path that has it. Rules that decide counts are the tokenizer's own: at
equal scores the piece that starts first stays, a character that no
piece of one character covers may pass as unknown at the lowest score less
10, and unknowns become their UTF-8 bytes if the vocabulary has bytes, else a
run of them is one token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import python_ready
from .held import held

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Nats are held in whole 1/1024ths, so that sums are exact and ties are ties.
SCALE = 1024


def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a public sentencepiece file's ordinary pieces, and whether it has bytes.

    Scores follow the pieces' rank: minus the logarithm of rank plus 2, in whole steps.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [(m.id_to_piece(i), -float(round(SCALE * math.log(k + 2)))) for k, i in enumerate(ids)], any(m.is_byte(i) for i in range(m.get_piece_size()))


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], bytes_for_unknown: bool, limit: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - SCALE * UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        # a space mark begins a segment if no piece holds one after another character, and no run of unknowns goes through it
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces) and (bytes_for_unknown or SPACE in self.single)
        self.limit, self.known = limit, {}

    def viterbi(self, text: str) -> int:
        """Pieces of the best path. Matches come by their end, the longest first, so the first of equals stays."""
        if not self.single.issuperset(text):
            return self.viterbi_unknown(text)
        score, count = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
        for end, (size, s) in self.automaton.iter(text):
            s += score[end + 1 - size]
            if s > score[end + 1]:
                score[end + 1] = s
                count[end + 1] = count[end + 1 - size] + 1
        return count[-1]

    def viterbi_unknown(self, text: str) -> int:
        """The same where some character is no piece of its own."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(n):
            best, start, unknown, single = -math.inf, e, False, False
            for size, s in sorted(ends[e], reverse=True) if len(ends[e]) > 1 else ends[e]:
                single |= size == 1
                s += score[e + 1 - size]
                if s > best:
                    best, start = s, e + 1 - size
            if not single and score[e] + self.unknown > best:
                best, start, unknown = score[e] + self.unknown, e, True
            if not unknown:
                more = 1
            elif self.bytes_for_unknown:
                more = len(text[e].encode("utf-8", "surrogatepass"))
            else:
                more = 0 if loose[e] else 1
            score[e + 1], count[e + 1], loose[e + 1] = best, count[start] + more, unknown
        return count[n]

    def segments(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE)
        return re.split(f"(?<=[^{SPACE}])(?={SPACE})", marked) if self.cuts else [marked]

    def fill(self, segment: str) -> int:
        if len(self.known) >= self.limit:
            self.known.clear()
        got = self.viterbi(segment)
        if len(segment) <= 64:
            self.known[segment] = got
        return got

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        return sum([known[s] if s in known else self.fill(s) for s in self.segments(text)])


def counter(model_path: str) -> Counter:
    """One for each Python worker, kept between its tasks."""
    return held(("counter", model_path), lambda: Counter(*vocabulary(model_path)))


def count_udf(model_path: str):
    def run(batches):
        for column in batches:
            count = counter(model_path)
            yield pa.array([count(x.as_py()) for x in column], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "long")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens; a map without shuffle.

    Null or empty text: 0. A text gets one space mark in front and each
    space becomes one; nothing else is changed. Texts of any length are counted
    whole. Equal rows each get a row; other columns are left out.
    """
    return python_ready(docs).select(F.col(id_col).alias("doc_id"), count_udf(model_path)(F.col(text_col)).alias("n_tokens"))
