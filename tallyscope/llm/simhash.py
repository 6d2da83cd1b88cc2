"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, where neighbours share many bits. A node
of the index stands for a run of them and keeps the bits that all of its run
share (a mask and their pattern). A query whose shared bits already differ in
more places than allowed leaves the whole run; one whose shared differences
and all open bits together stay within the limit links the whole run. Runs nest,
so differences are found once for many fingerprints.

Across the cluster, two fingerprints within three bits are equal in one of four blocks
of 16 bits. Each block in turn is rotated to the front and rotated fingerprints are cut, in
Gray order, into runs that keep a block's equals together; a run is a task's, with an
index of its own. So a fingerprint is sent four times; where a block holds too many, the other 48 bits are
cut in four again, and what is in it is sent four times within it. Within a task,
links join a union-find and only a spanning forest comes out, so a group of n near
copies gives n rows, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, python_ready, spread_join, staged
from .components import components
from .held import release

SEED = 42
BITS = 64
FAN = 8
#: Fingerprints of one run; time and memory of a task follow it, up to twice of it.
PER_PART = 16_384
LEAST_PARTS = 16
#: Times that blocks too large are cut in blocks again.
LEVELS = 4


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of A-Z-lowered words, repeats included; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = (b" ".join(x) for x in zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def fingerprint_udf(shingle: int = 3):
    """Arrow function: whole text to its 64-bit fingerprint, as a signed long.

    Words are those of A-Z-lowered text; shingles of ``shingle`` words keep
    repeats; fewer words are one shingle, none give 0. Null is as empty.
    """

    def run(batches):
        release()
        for column in batches:
            yield pa.array(np.array([combine(shingle_hashes(t.as_py(), shingle)) for t in column], np.uint64).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "long").asNondeterministic()  # so that it's never run twice for a row


def combine(hashes: np.ndarray) -> np.uint64:
    """Bits set in over half of ``hashes``."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: each bit is the parity of the bits from it up."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of (mask, pattern) over sorted fingerprints; level 0 has single ones, each further one runs of FAN."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.all_and, self.all_or = [self.fps], [self.fps]
        while len(self.all_and[-1]) > FAN:
            self.grow()

    def grow(self) -> None:
        at = np.arange(0, len(self.all_and[-1]), FAN)
        self.all_and.append(np.bitwise_and.reduceat(self.all_and[-1], at))
        self.all_or.append(np.bitwise_or.reduceat(self.all_or[-1], at))

    def node(self, level: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.all_and[level][k]
        return ~(low ^ self.all_or[level][k]), low

    def children(self, level: int, k: np.ndarray) -> np.ndarray:
        """FAN columns of a level's nodes below; -1 past the end."""
        below = k[:, None] * FAN + np.arange(FAN)
        return np.where(below < len(self.all_and[level - 1]), below, -1)

    def uniform(self, level: int, root: np.ndarray) -> np.ndarray:
        """The component of each node's run if it is in one alone, else -1."""
        at = np.arange(0, len(root), FAN**level)
        low = np.minimum.reduceat(root, at)
        return np.where(low == np.maximum.reduceat(root, at), low, -1)


class Forest:
    """Union-find over 0..n-1 by vectors of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return up
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root = self.settle()
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))


def join_indexes(x: GrayIndex, y: GrayIndex, forest: Forest, y0: int, limit: int, chunk: int = 16_384) -> None:
    """Join in ``forest`` what is within ``limit`` bits between two indexes (or within one).

    Both trees are walked together from the top, pairs of runs at a time; a
    pair that differs too much on bits that both runs share is left
    whole, a pair that can't differ by more is joined whole, and a pair that is
    in one component already needs no look. ``y0``: where y's places begin.
    """
    same = x is y
    for index, other in ((x, y), (y, x)):
        while len(index.all_and) < len(other.all_and):
            index.grow()
    top = len(x.all_and) - 1
    i, j = (k.ravel() for k in np.indices((len(x.all_and[top]), len(y.all_and[top]))))
    work = [(top, i[i <= j], j[i <= j]) if same else (top, i, j)]
    while work:
        level, i, j = work.pop()
        if len(i) > chunk:
            work += [(level, i[a : a + chunk], j[a : a + chunk]) for a in range(0, len(i), chunk)]
            continue
        if level:
            root = forest.settle()
            of_x, of_y = x.uniform(level, root[: len(x.fps)]), y.uniform(level, root[y0 : y0 + len(y.fps)])
            open_ = (of_x[i] != of_y[j]) | (of_x[i] < 0)
            i, j = i[open_], j[open_]
        (mask_x, low_x), (mask_y, low_y) = x.node(level, i), y.node(level, j)
        mask = mask_x & mask_y
        far = np.bitwise_count((low_x ^ low_y) & mask)
        whole = far + np.bitwise_count(~mask) <= limit
        if whole.any():
            span = FAN**level
            for index, k, at in ((x, i[whole], 0), (y, j[whole], y0)):
                lo = k * span
                width = np.minimum(lo + span, len(index.fps)) - lo
                step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                forest.join(np.repeat(i[whole] * span, width), np.repeat(lo, width) + step + at)
        rest = (far <= limit) & ~whole
        i, j = i[rest], j[rest]
        if level and len(i):
            below_x, below_y = x.children(level, i)[:, :, None], y.children(level, j)[:, None, :]
            both = (below_x >= 0) & (below_y >= 0)
            if same:
                both &= below_x <= below_y
            if level == 1:  # single fingerprints: compare blocks
                near = np.bitwise_count(x.fps[below_x] ^ y.fps[below_y]) <= limit
                r, u, v = np.nonzero(near & both)
                forest.join(below_x[r, u, 0], below_y[r, 0, v] + y0)
            else:
                r, u, v = np.nonzero(both)
                work.append((level - 1, below_x[r, u, 0], below_y[r, 0, v]))


def local_links(own: np.ndarray, guests: np.ndarray, limit: int, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links own-own (if ``within``) and own-guest, as pairs of fingerprints."""
    index = GrayIndex(own)
    everyone, forest = index.fps, Forest(len(own) + len(guests))
    if len(own) and within:
        join_indexes(index, index, forest, 0, limit)
    if len(own) and len(guests):
        other = GrayIndex(guests)
        everyone = np.concatenate([index.fps, other.fps])
        join_indexes(index, other, forest, len(own), limit)
    root = forest.settle()[: len(everyone)]
    linked = root != np.arange(len(everyone))
    return everyone[linked], everyone[root[linked]]


def turned(rows: DataFrame, limit: int, used: int) -> DataFrame:
    """``rows`` (key, n, fp, code) once for each turn: (key, n, turn, block, fp, code).

    The first ``used`` bits of ``code`` are the same for all rows of a key; the others are cut in blocks, one more than ``limit``, and each in
    turn is moved to the front of them. Two codes of a key within ``limit`` bits agree in one block at least.
    """
    free = BITS - used
    size, mask = free // (limit + 1), (1 << free) - 1
    signed = mask - (1 << 64) if mask >> 63 else mask
    rest = F.col("code").bitwiseAND(F.lit(signed))
    front = F.col("code").bitwiseAND(F.lit(~signed))
    moved = [rest if not k else F.shiftleft(rest, k * size).bitwiseOR(F.shiftrightunsigned(rest, free - k * size)).bitwiseAND(F.lit(signed)) for k in range(limit + 1)]
    width = min(size, 16)
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(m, free - width).alias("block"), front.bitwiseOR(m).alias("code")) for k, m in enumerate(moved)])
    return rows.select("key", "n", "fp", F.inline(turns)).select("key", "n", "turn", "block", "fp", "code")


def runs(fps: DataFrame, total: int, limit: int, per_part: int) -> DataFrame:
    """(key, turn, run, x, y, part, fp, code) for each of ``total`` fingerprints, turn by turn: the run that a task compares.

    Every pair within ``limit`` bits is in one run at least. A run has the codes whose block begins alike,
    which are side by side in Gray order, and how many bits that is follows the table's size. A run of twice
    too many is cut by whole blocks. A block of twice too many is a key of its own: what its codes have besides the block
    is cut in blocks again, so each code is sent on to limit + 1 runs of it, not to all parts of it, whatever it
    holds. Only codes that agree in the blocks of four levels (for three bits, 43 of 64 bits) and are still too many are cut in
    parts that meet two at a time; there are too few different ones to go on.

    Blocks of the first level are at most (limit + 1) * 65,536 rows, whatever the table's size, so they are broadcast; those of
    further levels meet their codes by a shuffle.
    """
    if total <= per_part:
        return fps.select(F.lit("").alias("key"), *[F.lit(0).alias(c) for c in ("turn", "run", "x", "y", "part")], "fp", F.col("fp").alias("code"))
    rows, used, out = fps.select(F.lit("").alias("key"), F.lit(total).cast("long").alias("n"), "fp", F.col("fp").alias("code")), 0, []
    for level in range(LEVELS):
        width = min((BITS - used) // (limit + 1), 16)
        each = turned(rows, limit, used)
        bits = F.least(F.lit(width), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / per_part)).cast("int"))).alias("bits")
        counts = each.groupBy("key", "turn", "block").agg(F.count("*").alias("here"), F.max(bits).alias("bits")).withColumn("begin", F.expr(f"shiftright(block, {width} - bits)"))
        full = F.col("here") > 2 * per_part
        sums = counts.groupBy("key", "turn", "begin").agg(F.sum(F.when(~full, F.col("here"))).alias("light"))
        found = counts.join(F.broadcast(sums) if not level else sums, ["key", "turn", "begin"])
        found = staged(found.select("key", "turn", "block", "here", full.alias("full"), F.when(F.col("light") > 2 * per_part, -1 - F.col("block")).otherwise(F.col("begin")).alias("run")), "simhash-blocks")
        placed = each.join(F.broadcast(found) if not level else found, ["key", "turn", "block"])
        last = level == LEVELS - 1 or not found.where("full").limit(1).count()
        parts = F.when(F.col("full"), F.ceil(F.col("here") / per_part)).otherwise(1).cast("int") if last else F.lit(1)
        here = (placed if last else placed.where("NOT full")).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        run = F.when(F.col("full"), -1 - F.col("block")).otherwise(F.col("run")).alias("run")
        here = here.select("key", "turn", run, "part", "fp", "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
        out.append(here.select("key", "turn", "run", F.least("part", "to").alias("x"), F.greatest("part", "to").alias("y"), "part", "fp", "code"))
        if last:
            break
        rows = placed.where("full").select(F.concat_ws(":", "key", "turn", "block").alias("key"), F.col("here").alias("n"), "fp", "code")
        used += width
    return reduce(DataFrame.unionByName, out)


def near_links(fps: DataFrame, limit: int = 3, per_part: int = PER_PART) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (distinct longs in column fp) within ``limit`` bits.

    The number of tasks follows the number of fingerprints, which is all that the driver sees.
    """
    total = python_ready(fps).count()
    tasks = max(LEAST_PARTS, -(-(limit + 1) * total // per_part))

    def link(key, table):
        x, y = (k.as_py() for k in key[-2:])
        code, part = table.column("code").to_numpy().view(np.uint64), table.column("part").to_numpy()
        order = np.argsort(code)
        fp, known = table.column("fp").to_numpy()[order], code[order]
        found = local_links(code[part == x], code[part == y] if x != y else code[:0], limit, x == y)
        return pa.table(dict(zip("ab", (fp[np.searchsorted(known, v)] for v in found))))

    keys = ["key", "turn", "run", "x", "y"]
    return runs(fps.select("fp"), total, limit, per_part).repartition(tasks, *keys).groupBy(*keys).applyInArrow(link, "a long, b long")


def near_duplicate_groups(docs: DataFrame, limit: int = 3, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """(fp, n, root, component_id) for each distinct fingerprint, n rows having it; docs has ids and fingerprints.

    Exact copies share a fingerprint and are one node, so they cost one row of
    a combined aggregate. ``component_id`` is the smallest id in reach; null if all
    ids in reach are null. Null fingerprints are left out. No rows: no rows.
    """
    distinct = staged(docs.where(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "simhash")
    return grouped(distinct, near_links(distinct, limit))


def grouped(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) for each row of ``distinct`` (fp, n, and low: its smallest id), joined by ``links`` (a, b)."""
    roots = components(links)
    noted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    sums = noted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    return staged(spread_join(noted, sums, "root", "members", distinct.count()).select("fp", "n", "root", "component_id"), "simhash-groups")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null or blank texts have fingerprint zero and link like any other; a null id counts as larger
    than any. Texts of any length are hashed whole. Equal rows each get a row. No rows: no rows. Other columns
    are left out, so no name can clash.
    """
    marked = staged(python_ready(docs).select(F.col(id_col).alias("doc_id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")), "simhash-docs")
    groups = near_duplicate_groups(marked, limit)
    return spread_join(marked, groups, "fp", "n", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """Keep of each group the document with the smallest id, with all columns of ``docs``, whatever their names.

    A null id counts as larger than any; null and blank texts are copies of each other. Of rows that share id
    and fingerprint one stays. No rows: no rows.
    """
    mark, row = fresh(docs, "simhash_fp", "simhash_row")
    marked = staged(python_ready(docs).withColumns({mark: fingerprint_udf(shingle)(F.col(text_col)), row: F.monotonically_increasing_id()}), "simhash-docs")
    plain = marked.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(mark).alias("fp"))
    return keep_first(marked, plain, near_duplicate_groups(plain, limit, "id"), row).drop(mark, row)


def keep_first(marked: DataFrame, plain: DataFrame, groups: DataFrame, row: str) -> DataFrame:
    """Rows of ``marked`` that stand for their group: of ``plain`` (row, id, fp) the least id, fingerprint and row.

    Only numbers are grouped; the documents themselves are shuffled once, by row.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "row"))
    kept = spread_join(plain, groups, "fp", "n", plain.count()).groupBy("root").agg(first.alias("first"))
    # the column's name is the table's own, so that no other can be meant
    return marked.join(kept.select(F.col("first.row").alias(row)), row, "left_semi")
