"""Document fingerprints by invertible Bloom lookup sketches, DataFrame functions only.

A text is a set of digests of its paragraphs (lines; long ones in blocks). A
sketch adds each digest to one cell in each of three subtables; a cell holds
a count, the exclusive-or of digests and that of their checks. The difference of
two texts' sketches holds only the digests that one text has alone; cells
with a single digest give it away, it is taken out of its other cells, and
so on until nothing is left. The sketches in the fingerprints come first, within
the row. Where cells remain, larger sketches with other hashes are tried, first as
large as the difference that the fingerprints' counts let expect, then four times that, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged

#: The first 24 characters of a line, then blocks of 128.
BLOCKS = r"(?<=\A|\n)[^\n]{1,24}|[^\n]{1,128}"
TABLES = 3
#: Cells of a subtable of the fingerprint that is returned.
SMALL = 4
#: Cells for each digest that is expected to differ; one third more than must do for large sets.
SPREAD = 1.6
#: How far above the estimated difference the first larger sketch is sized.
MARGIN = 2.5
PEELS = 6
PER_RANGE = 16_384
LEAST_RANGES = 64
#: The driver holds one id per range; beyond this many, ranges grow instead (their tasks sort with spilling).
MOST_RANGES = 20_000


def digests(text: Column) -> Column:
    """Array of the distinct 64-bit digests of a text's blocks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0)), lambda x: F.xxhash64(x)))


def check_of(key: Column) -> Column:
    return F.xxhash64(F.lit("check"), key)


def cell_of(key: Column, table: int | Column, size: Column, seed: int) -> Column:
    """Where ``key`` is in a subtable of ``size`` (long) cells, counted from the first subtable."""
    return F.pmod(F.xxhash64(key, F.lit(table + TABLES * seed)), size) + table * size


def small_cell(key: Column, table: int | Column) -> Column:
    return cell_of(key, table, F.lit(SMALL).cast("long"), 0)


def as_cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), key.alias("key"), check.alias("check"))


def small_sketch(keys: Column) -> Column:
    """The fingerprint's own cells, an array of (n, key, check)."""
    zero = F.lit(0).cast("long")
    marked = F.transform(keys, lambda k: F.struct(k.alias("key"), check_of(k).alias("check"), *[small_cell(k, t).alias(f"in{t}") for t in range(TABLES)]))

    def cell(marked: Column, c: int) -> Column:
        return let(F.filter(marked, lambda x: x[f"in{c // SMALL}"] == c), lambda own: as_cell(
            F.size(own),
            F.aggregate(own, zero, lambda a, x: a.bitwiseXOR(x["key"])),
            F.aggregate(own, zero, lambda a, x: a.bitwiseXOR(x["check"])),
        ))

    return let(marked, lambda marked: F.array(*[cell(marked, c) for c in range(TABLES * SMALL)]))


def fingerprint_text(text: Column, keys: Column, cells: Column) -> Column:
    """Hex of the whole text's hash, the number of digests, and the sketch's cells."""
    cell = lambda x: F.concat(F.lpad(F.hex(x["n"]), 8, "0"), F.lpad(F.hex(x["key"]), 16, "0"), F.lpad(F.hex(x["check"]), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.size(keys)), 8, "0"), F.array_join(F.transform(cells, cell), "")))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: as_cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def peeled(cells: Column) -> Column:
    """How many digests a subtracted fingerprint sketch gives away; null if cells remain.

    A step takes one digest out and leaves its cell empty for good, so there are at most as many as cells.
    """

    def step(s: Column, _: Column) -> Column:
        pure = lambda x: (F.abs(x["n"]) == 1) & (x["check"] == check_of(x["key"]))
        found = F.filter(s["cells"], lambda x, i: pure(x) & (small_cell(x["key"], F.floor(i / SMALL).cast("int")) == i))

        def without(p: Column) -> Column:
            places = F.array(*[small_cell(p["key"], t) for t in range(TABLES)])
            less = lambda x: as_cell(x["n"] - p["n"], x["key"].bitwiseXOR(p["key"]), x["check"].bitwiseXOR(p["check"]))
            rest = let(places, lambda at: F.transform(s["cells"], lambda x, i: F.when(F.array_contains(at, i.cast("long")), less(x)).otherwise(x)))
            return F.when(p.isNull(), s).otherwise(F.struct(rest.alias("cells"), (s["found"] + 1).alias("found")))

        return let(F.get(found, F.lit(0)), without)

    start = F.struct(cells.alias("cells"), F.lit(0).cast("long").alias("found"))
    some = lambda x: (x["n"] != 0) | (x["key"] != 0) | (x["check"] != 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLES * SMALL)), start, step, lambda s: F.when(~F.exists(s["cells"], some), s["found"]))


def expected_difference(cells: Column) -> Column:
    """An estimate of the differing digests by the spread of a subtracted sketch's counts.

    Each digest adds 1 or -1 to one cell of a subtable, so the squared deviations of a
    subtable's counts sum to the number of digests times 1 - 1 / cells, in the mean.
    """

    def squares(t: int) -> Column:
        own = F.transform(F.slice(cells, t * SMALL + 1, SMALL), lambda x: x["n"].cast("double"))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        return let(own, lambda own: total(F.transform(own, lambda x: x * x)) - total(own) * total(own) / SMALL)

    return sum((squares(t) for t in range(1, TABLES)), squares(0)) / TABLES * SMALL / (SMALL - 1)


def peel(cells: DataFrame, seed: int) -> DataFrame:
    """PEELS rounds over cells (uid, pair, size, cell, n, key, check), without leaving their partition of uid.

    A round looks at one subtable, in which each digest has one cell, so none is
    taken out twice. What is found adds to the count of cell -1.
    """
    for r in range(PEELS):
        t = r % TABLES
        mine = (F.col("cell") >= t * F.col("size")) & (F.col("cell") < (t + 1) * F.col("size"))
        pure = mine & (F.abs("n") == 1) & (F.col("check") == check_of(F.col("key"))) & (F.col("cell") == cell_of(F.col("key"), t, F.col("size"), seed))
        zero = F.lit(0).cast("long")
        row = lambda cell, n, key, check: F.struct(cell.alias("cell"), n.alias("n"), key.alias("key"), check.alias("check"))
        out = [row(F.lit(-1).cast("long"), F.lit(1).cast("long"), zero, zero)] + [row(cell_of(F.col("key"), k, F.col("size"), seed), -F.col("n"), F.col("key"), F.col("check")) for k in range(TABLES) if k != t]
        cells = cells.select("uid", "pair", "size", F.inline(F.when(pure, F.array(*out)).otherwise(F.array(row(*map(F.col, ("cell", "n", "key", "check")))))))
        cells = merged(cells)
    return cells


def merged(cells: DataFrame) -> DataFrame:
    found = cells.groupBy("uid", "pair", "size", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return found.where("n <> 0 OR key <> 0 OR check <> 0")


def differing(pairs: DataFrame, rounds: int = 40, tries: int = 8) -> DataFrame:
    """(uid, pair, differing) for ``pairs`` (uid, pair, guess, a, b), a and b being arrays of distinct digests.

    ``guess``: about how many are thought to differ; the first sketch is for so many, each further one for four times as many.
    ``differing``: how many digests peeling recovers; pairs that no size of ``tries`` peels are counted exactly. The work is split by uid once;
    within a task, cells are exploded, combined and peeled without another shuffle.
    """
    done: list[DataFrame] = []
    for seed in range(1, tries + 1):
        most = F.least(F.greatest(F.col("guess"), F.abs(F.size("a") - F.size("b"))), F.size("a") + F.size("b"))
        size = F.ceil(most * (SPREAD * 4 ** (seed - 1)) / TABLES) + SMALL
        sized = (pairs if seed == 1 else pairs.repartition("uid")).select("uid", "pair", size.cast("long").alias("size"), "a", "b")
        keys = sized.select("uid", "pair", "size", F.inline(F.concat(F.transform("a", lambda k: F.struct(k.alias("key"), F.lit(1).cast("long").alias("n"))), F.transform("b", lambda k: F.struct(k.alias("key"), F.lit(-1).cast("long").alias("n"))))))
        cells = keys.select("uid", "pair", "size", "n", "key", check_of(F.col("key")).alias("check"), F.explode(F.array(*[cell_of(F.col("key"), t, F.col("size"), seed) for t in range(TABLES)])).alias("cell"))
        now = merged(cells)
        left = None
        for _ in range(rounds):
            now = staged(peel(now, seed), "peeled")
            seen = now.where("cell >= 0").count()
            if seen == 0 or (left is not None and seen > 0.9 * left):  # done, or stalled: the rest needs larger sketches
                break
            left = seen
            now = now.repartition("uid")
        failed = now.where("cell >= 0").select("uid", "pair").distinct()
        found = now.where("cell = -1").select("uid", "pair", F.col("n").alias("differing"))
        if not seen:
            done.append(found)
            break
        done.append(found.join(failed, ["uid", "pair"], "left_anti"))
        pairs = staged(pairs.join(failed, ["uid", "pair"], "left_semi"), "unpeeled")
    else:  # what no size gave away is counted on the sets themselves
        counted = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
        done.append(pairs.select("uid", "pair", counted.cast("long").alias("differing")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def cuts_below(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``, by halving steps over one constant array."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(2**k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(held, n + s - 1) <= x, n + s).otherwise(n))


def with_next_text(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with the next text in descending order of id and then text; the first follows the last.

    Ids are dealt to ranges cut at their quantiles. Each range gets the first text
    of the range below as a row of its own at its end, so the next row is
    always in the same task; only one id per range is seen by the driver, MOST_RANGES at most.
    """
    spark, total = docs.sparkSession, docs.count()
    n = min(MOST_RANGES, max(LEAST_RANGES, -(-total // PER_RANGE)))
    cuts = sorted(set(docs.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 50 * n)).first()[0] or []))
    place = F.when(F.col("id").isNull(), -1).otherwise(cuts_below(F.col("id"), cuts))
    placed = docs.select("id", "text", place.cast("long").alias("part"), F.lit(0).alias("guard"))
    firsts = sorted(docs.select("id", place.cast("long").alias("part")).groupBy("part").agg(F.max("id").alias("id")).collect(), key=lambda r: -r.part)
    # by range: the largest id of the range below; the highest range follows the lowest
    marks = spark.createDataFrame([(firsts[k - 1].part, r.id) for k, r in enumerate(firsts)], "part long, first long")
    low = docs.join(F.broadcast(marks), F.col("id").eqNullSafe(F.col("first")))
    guards = low.groupBy("part").agg(F.max("text").alias("text")).select(F.lit(None).cast("long").alias("id"), "text", "part", F.lit(1).alias("guard"))
    order = Window.partitionBy("part").orderBy(F.col("guard"), F.col("id").desc_nulls_last(), F.col("text").desc())
    return placed.unionByName(guards).withColumn("next", F.lead("text").over(order)).where("guard = 0").select("id", "text", "next")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and likenesses found by peeling.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as
    many of the next text. Likeness: digests in both over digests in either, 1 for two texts without any.

    Null text: as empty, without digests. Null ids come last in order, equal ids in
    descending order of text; equal rows each get a row, a single document is its own
    next. No rows: no rows. Repeated blocks of a text count once; the hash in front of a fingerprint still tells such texts apart.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next_text(texts)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("id", "text", "next", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next", F.lit(1), half)).alias("edited"))
    rows = rows.select("*", digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next")).alias("b"))
    rows = rows.select("*", *[small_sketch(F.col(x)).alias(f"s{x}") for x in "aeb"])
    made = rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("text"), F.col("a"), F.col("sa")).alias("fingerprint"), fingerprint_text(F.col("edited"), F.col("e"), F.col("se")).alias("edited_fingerprint"),
        "a", "e", "b", *[let(subtracted(F.col("sa"), F.col(s)), lambda x: F.struct(peeled(x).alias("found"), expected_difference(x).alias("about"))).alias(d) for s, d in (("se", "de"), ("sb", "db"))],
    )
    made = staged(made, "fingerprints")
    # pairs that their fingerprints don't tell apart: each row's own set is sent once, for both of its pairs
    hard = made.where("de.found IS NULL OR db.found IS NULL").select("uid", "a", "e", "b", "de", "db").repartition("uid")
    pair = lambda k, x: F.when(F.col(f"d{x}.found").isNull(), F.struct(F.lit(k).alias("pair"), (MARGIN * F.col(f"d{x}.about")).alias("guess"), F.col(x).alias("b")))
    pairs = hard.select("uid", "a", F.inline(F.array_compact(F.array(pair(0, "e"), pair(1, "b"))))).select("uid", "pair", "guess", "a", "b")
    found = differing(pairs).groupBy("uid").agg(*[F.sum(F.when(F.col("pair") == k, F.col("differing"))).alias(f"d{k}") for k in (0, 1)])
    sizes = made.select("uid", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("de.found").alias("fe"), F.col("db.found").alias("fb"), F.size("a").alias("na"), F.size("e").alias("ne"), F.size("b").alias("nb"))

    def likeness(other: str, first: str, later: str) -> Column:
        d = F.coalesce(F.col(first), F.col(later))
        both = (F.col("na") + F.col(other) - d) / 2
        return F.when(both + d == 0, 1.0).otherwise(both / (both + d))

    return sizes.join(found, "uid", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("ne", "fe", "d0").alias("near_edited"), likeness("nb", "fb", "d1").alias("near_next"))
