"""Packing documents into sequences by patterns of lengths.

A pattern is a few lengths that share a sequence. Non-negative least squares
fits how often to repeat each pattern to the histogram of lengths; rounded
repeats are packed as they are, the largest first, fractions below a half
rounded up to one while their lengths last. What is left is fitted again a few
times, then goes to patterns made by best fit: mostly short pieces, of which more than
four fill a sequence. Everything but the histogram stays distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, staged
from .encoding import encoder, slices

Run = tuple[int, int, int, int, int]
#: Fits at most; each is to what the ones before left.
FITS = 4


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", drops_spaces: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole encoded text, in the tasks that scan it.

    ``part`` and ``nth`` number the pieces of one length within a task. Null or
    empty text: one piece with the end id.
    """

    def cut(batches):
        part, seen, enc, end = TaskContext.get().partitionId(), {}, encoder(tokenizer_path, drops_spaces), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch, 1):
                rows, at = [], []
                for i, got in enumerate(enc.encode(texts), first):
                    got += end
                    for piece, start in enumerate(range(0, len(got) // 4, capacity)):
                        some = got[4 * start : 4 * (start + capacity)]
                        n = len(some) // 4
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((piece, start, n, zlib.crc32(some), part, seen[n]))
                        at.append(i)
                piece, start, n, crc, parts, nth = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(parts, pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    chosen = python_ready(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def candidate_patterns(counts: dict[int, int], capacity: int, often: int = 16) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths that fill a sequence, or all but fill it.

    Each length meets its complement, and with each one or two of the
    ``often`` most frequent lengths the complement of their sum; where that
    is absent, the next shorter present length stands in.
    """
    present = sorted(counts)
    top = sorted(sorted(counts, key=lambda n: (-counts[n], -n))[:often])
    found: set[tuple[int, ...]] = set()

    def close(*held: int) -> None:
        rest = capacity - sum(held)
        if rest < 0:
            return
        k = bisect_right(present, rest)
        found.add(tuple(sorted(held + ((present[k - 1],) if k else ()), reverse=True)))

    for a in present:
        close(a)
        for i, b in enumerate(top):
            close(a, b)
            close(a, b, top[-1 - i])
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 150) -> np.ndarray:
    """Least squares of A x - h for x >= 0, A holding each pattern's lengths.

    Accelerated projected gradient; lengths weigh by one over the patterns that
    hold them and patterns step by one over their lengths, which bounds the
    step's norm by 1.
    """
    size = max(counts) + 1
    h = np.zeros(size)
    h[list(counts)] = list(counts.values())
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    by_row = 1 / np.maximum(1, np.bincount(rows, minlength=size))
    by_col = 1 / np.bincount(cols, minlength=len(patterns))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        left = (np.bincount(rows, y[cols], size) - h) * by_row
        new = np.maximum(0.0, y - by_col * np.bincount(cols, left[rows], len(patterns)))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up ``counts``: the longest first, then what fills the rest best.

    The rest is filled by an exact pair where one is present, else by the longest
    length that fits. A pattern repeats as often as its lengths last, so the
    number of patterns follows the number of lengths, not of documents.
    """
    left = dict(counts)
    there = np.zeros(capacity + 1, bool)
    there[list(left)] = True
    out = []
    while left:
        held: dict[int, int] = {}
        present, rest = sorted(left), capacity
        while present:
            k = bisect_right(present, rest)
            while k and held.get(present[k - 1], 0) >= left[present[k - 1]]:
                k -= 1
            if not k:
                break
            n = present[k - 1]
            if held and n < rest:
                pair = np.flatnonzero(there[1 : (rest + 1) // 2] & there[rest - 1 : rest // 2 : -1]) + 1
                pair = next((int(a) for a in pair[::-1] if held.get(int(a), 0) < left[int(a)] and held.get(rest - int(a), 0) < left[rest - int(a)]), None)
                n = rest - pair if pair else n
            held[n] = held.get(n, 0) + 1
            rest -= n
        times = min(left[n] // k for n, k in held.items())
        out.append((tuple(sorted((n for n, k in held.items() for _ in range(k)), reverse=True)), times))
        for n, k in held.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                there[n] = False
    return out


def plan_packing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs (length, first rank, end rank, sequence of the first, offset) for a histogram of lengths.

    The size of the plan depends on ``capacity``, not on the documents.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    packed: list[tuple[tuple[int, ...], int]] = []
    if left.pop(capacity, 0):
        packed.append(((capacity,), counts[capacity]))
    for _ in range(FITS):
        # a stand-in that fills too little waits for the residual
        patterns = [p for p in candidate_patterns(left, capacity) if capacity - sum(p) <= capacity // 1024]
        if not patterns:
            break
        repeats = fit_repeats(patterns, left)
        before = len(packed)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] <= 0:
                break
            p = patterns[k]
            times = min(max(1, int(np.rint(repeats[k]))), *(left.get(n, 0) // p.count(n) for n in p))
            if times > 0:
                packed.append((p, times))
                for n in p:
                    left[n] -= times
        left = {n: c for n, c in left.items() if c}
        if len(packed) == before:
            break
    packed += best_fit(left, capacity)
    used: dict[int, int] = {}
    runs, seq = [], 0
    for p, times in packed:
        at = 0
        for n in p:
            lo = used.get(n, 0)
            runs.append((n, lo, lo + times, seq, at))
            used[n], at = lo + times, at + n
        seq += times
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each staged piece its sequence and offset.

    The histogram (at most ``capacity`` rows) goes to the driver, the plan comes
    back; a piece's rank among those of its length is its number in its task
    plus the tasks before, so no task ever gathers a length. Equal pieces
    keep separate ranks. No rows: no rows.
    """
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = sorted(plan_packing(counts, capacity))
    keys = np.array([r[:2] for r in runs], np.int64).reshape(-1, 2)
    values = np.array([r[3:] for r in runs], np.int64).reshape(-1, 2)
    shared = pieces.sparkSession.sparkContext.broadcast((keys, values))

    def place(batches):
        keys, values = shared.value
        first = {int(n): int(i) for i, n in reversed(list(enumerate(keys[:, 0])))}
        last = {int(n): int(i) + 1 for i, n in enumerate(keys[:, 0])}
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            run = np.empty(len(n), np.int64)
            for x in np.unique(n):
                own = n == x
                a, b = first[int(x)], last[int(x)]
                run[own] = a + np.searchsorted(keys[a:b, 1], rank[own], "right") - 1
            seq = values[run, 0] + rank - keys[run, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(values[run, 1])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return python_ready(ranked).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", drops_spaces: bool = True) -> DataFrame:
    """Tokenise, cut and pack ``docs``: a row per piece with its ids' place in the document, length, checksum, sequence and offset.

    Null and empty texts are one piece, the end id; a text of any length is cut in pieces of ``capacity``. Repeated rows and ids, null
    ids too, are packed row by row. No rows: no rows. Columns but the id and the text are left out, so no name can clash.
    """
    return pack(staged(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, drops_spaces), "pieces"), capacity)
