"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Distances are integers, but the search for the nearest entry is a float32 matrix
product. Every rounding of that product is bounded, so each distance lies in an interval;
entries whose interval meets the best one's are compared again in 64-bit integers, and
ties go to the lower number.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, spread_join, staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of at least this size are compared as whole numbers of any length; below it, distances of parts of up to 4096 components fit 64 bits.
WIDE = 1 << 24
#: Components that a long can't hold with room for differences leave the table, as those that are no number do.
MOST = 2.0**62
UNIT = 2.0**-24
#: Vectors compared at once.
ROWS = 4096


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, whether integers had to decide) of each row of ``x`` (int64, below WIDE), without the distances themselves.

    |c|^2 - 2 x.c orders a row's entries as their distances do. In float32, each component is within a unit roundoff u of
    its integer, and a product of d terms adds at most d / (1 - d u) roundoffs to the sum of |x| |c|, which the norms
    bound; sums of float64 add their own. All bounds are rounded up.
    """
    d = x.shape[1]
    xf, cf = x.astype(np.float64), entries.astype(np.float64)
    c2, xn = (cf * cf).sum(1), np.sqrt((xf * xf).sum(1))
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    scale = xn[:, None] * np.sqrt(c2)[None, :]
    bound = 1.01 * (2 * (d + 3) * UNIT * scale + (d + 4) * 2.0**-52 * (c2[None, :] + 2 * scale)) + 1e-30
    score = c2[None, :] - 2 * product
    close = score - bound <= (score + bound).min(1, keepdims=True)
    best = close.argmax(1)
    unsure = close.sum(1) > 1
    if unsure.any():
        rows = np.flatnonzero(unsure)
        exact = ((x[rows, None, :] - entries[None, :, :]) ** 2).sum(2)
        exact[~close[rows]] = np.iinfo(np.int64).max
        best[rows] = exact.argmin(1)
    return best, unsure


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, the lower of equal ones; squared distance) of each row of integers."""
    wide = (np.abs(x) >= WIDE).any(1) if np.abs(entries).max(initial=0) < WIDE else np.ones(len(x), bool)
    best = np.zeros(len(x), np.int64)
    away = np.zeros(len(x), object if wide.any() else np.int64)
    plain = np.flatnonzero(~wide)
    if len(plain):
        best[plain], _ = screened(x[plain], entries)
        away[plain] = ((x[plain] - entries[best[plain]]) ** 2).sum(1)
    for i in np.flatnonzero(wide):
        far = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], c)) for c in entries]
        away[i] = min(far)
        best[i] = far.index(away[i])
    return best, away


def _vectors(batch, column: str, dim: int):
    """(first row, components by row) of a batch, in slices."""
    lists = batch.column(column)
    for at in range(0, len(lists), ROWS):
        yield at, lists.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(books: np.ndarray, dim: int):
    """Assign, and add up each entry's parts: a row for each part position and entry that a task has met."""

    def run(batches):
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for _, v in _vectors(batch, "components", dim):
                for p in range(PARTS):
                    x = v[:, p * (dim // PARTS) : (p + 1) * (dim // PARTS)]
                    best, _ = nearest(x, books[p])
                    for e in np.unique(best):
                        own = x[best == e]
                        # halves, so that no sum of a slice leaves 64 bits
                        total = [(int(a) << 31) + int(b) for a, b in zip((own >> 31).sum(0), (own & (2**31 - 1)).sum(0))]
                        held = found.setdefault((p, int(e)), [0] * (1 + dim // PARTS))
                        held[:] = [a + b for a, b in zip(held, [len(own), *total])]
        keys = [(p, e, i) for (p, e), v in found.items() for i in range(len(v))]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k in keys], pa.int32()) for j in range(3)), pa.array([Decimal(found[p, e][i]) for p, e, i in keys], pa.decimal128(38, 0))],
            ["part", "entry", "i", "total"],
        )

    return run


def train(vectors: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) of staged ``vectors`` (vec_id, components): from the smallest ids, refined ``rounds`` times.

    A round is one pass; a task's sums are a row for each entry, so the driver gets
    as many rows as there are entries, components and parts, however long the table is.
    """
    firsts = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).collect()
    books = np.array([r.components for r in firsts], np.int64).reshape(len(firsts), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        summed = vectors.select("components").mapInArrow(_sums(books, dim), "part int, entry int, i int, total decimal(38,0)")
        totals = {(r.part, r.entry, r.i): int(r.total) for r in summed.groupBy("part", "entry", "i").agg(F.sum("total").alias("total")).collect()}
        for (p, e, i), total in totals.items():
            if i:
                books[p, e, i - 1] = total // totals[p, e, 0]
    return books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of finite numbers.

    Components become floor(``scale`` x); a vector is cut in eight parts of equal length. ``code`` has two hex digits for each part, ``error`` is
    the sum of the parts' squared distances, ``label_error`` that over all rows of the label.

    Rows without a vector, or with a component that is null, not finite or beyond 2^62 as an integer, are left out.
    Vectors shorter than the longest, or of a length that eight doesn't divide, count as ended by zeros. Null ids stand last and equal
    ids in order of their vectors when the codebooks begin; fewer than 16 vectors give fewer entries. Null labels are one label.
    An error that a long can't hold is null. Equal rows count one by one. No rows: no rows. Other columns are left out, so no name can clash.
    """
    x = F.col(f"`{vector_col}`")
    scaled = lambda v: v.cast("double") * float(scale)
    finite = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(scaled(v)) < MOST), F.lit(False)))
    kept = python_ready(table).where(finite).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.transform(x, lambda v: F.floor(scaled(v)).cast("long")).alias("components"))
    sized = staged(kept, "vectors")
    longest = sized.agg(F.max(F.size("components"))).first()[0]
    dim = max(PARTS, -(-(longest or 0) // PARTS) * PARTS)
    vectors = sized.withColumn("components", F.concat("components", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("components"))))
    books = train(vectors, dim)
    long = 2**63 - 1

    def encode(batches):
        for batch in batches:
            for at, v in _vectors(batch, "components", dim):
                found = [nearest(v[:, p * (dim // PARTS) : (p + 1) * (dim // PARTS)], books[p]) for p in range(PARTS)]
                digits = np.array([f"{k:02x}" for k in range(256)])
                codes = ["".join(c) for c in zip(*(digits[best] for best, _ in found))]
                errors = [e if e <= long else None for e in map(sum, zip(*(away.tolist() for _, away in found)))]
                own = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(codes), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    coded = staged(vectors.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    labels = keyed.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    out = spread_join(keyed, labels, "key", "n", coded.count())
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
