"""Mixing sources to target weights by systematic sampling, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, staged

#: Weights by a source's place in code-point order, repeated from the start.
WEIGHTS = (5.0, 2.0, 1.0)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df``, staged, with its place in ``order`` (``place``, from 0) and, by name, the sum of each of ``sums`` over the rows before.

    Rows are dealt to ranges of the order; a row's sum is the one in its range and those of the ranges
    before, a row each, so no task sees more than a range.
    """
    cut = df.select("*", *[v.alias(k) for k, v in {"place": F.lit(1).cast("long"), **sums}.items()])
    placed = cut.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    names = ["place", *sums]
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(placed.select(*df.columns, "range", *names, *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_here") for c in names]), "running")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(*[F.sum(c).alias(c) for c in names])
    ranges = ranges.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in names])
    return placed.join(F.broadcast(ranges), "range").select(*df.columns, *[(F.col(f"{c}_here") + F.col(f"{c}_base")).alias(c) for c in names])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size): source, source_size, target, rate, start.

    All targets sum to ``share`` times all sizes. A source whose share by
    weight passes ``most`` times its size stops there, and the excess is
    shared again by weight: with sources by rising size over weight, the
    saturated ones come first, and the level of the others follows from
    running sums. The driver gets two sums and the level, however many sources there are.
    """
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = running(listed, [F.col("source").asc_nulls_last()], {}).withColumns({"w": F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")), "cap": most * F.col("source_size")})
    rising = [(F.col("cap") / F.col("w")).asc(), F.col("nth").asc()]
    listed = running(listed.withColumnRenamed("place", "nth"), rising, {"cap_before": F.col("cap"), "w_before": F.col("w")})
    whole = listed.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    level = (F.lit(share * (whole["size"] or 0)) - F.col("cap_before")) / (F.lit(whole["w"] or 1.0) - F.col("w_before"))
    level = listed.select("cap", "w", level.alias("level")).where(F.col("cap") > F.col("w") * F.col("level")).agg(F.max("level")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("w") * level)
    start = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    return listed.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), start.alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, dict[str, str]]:
    """Rows of ``docs`` (the columns ``keep``) with size, source_size, target and copies.

    Returns the table and the names it gave these columns, which avoid those
    of ``keep``. A document of a source with target t and size s is expected
    t / s times. Within a source, documents stand in order of size, then md5
    of the id, then id; the running sum of expected copies, moved by one offset
    drawn from the source's name, takes a document once at each integer it
    passes. Order by size keeps a source's words within about a document of
    its target; nothing depends on partitions, so reruns agree.

    Only numbers and names are sorted, in range partitions that also cut a source with most
    rows; a document's rank is its place in its partition plus the ranks before, one
    row per partition and source. The kept columns are shuffled once, to meet their copies.

    Null text: size 0. Null source: a source of its own, last in order. Equal
    rows stand side by side and count one by one. Null ids come first among
    equals. Columns of any name stay as they are. No rows: no rows.
    """
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    size, total, target, copies, row = fresh(kept, "size", "source_size", "target", "copies", "mix_row")
    (facts,) = fresh(kept, "mix_facts")
    made = F.struct(F.monotonically_increasing_id().alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.col(id_col).alias("id"))
    rows = staged(docs.select(*[F.col(f"`{c}`") for c in keep], made.alias(facts)), "mix-sizes")
    plain = rows.select(F.col(facts)["row"].alias("row"), F.col(facts)["source"].alias("source"), F.col(facts)["size"].alias("size"), F.col(facts)["id"].alias("id"))
    plain = plain.withColumn("tie", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("tie"), F.col("id"), F.col("row")]
    placed = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = staged(placed.select("row", "source", "size", "at", F.shiftright("at", 33).alias("part")), "mix-order")
    targets = source_targets(placed, weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    bases = bases.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    a, b = bases.alias("a"), targets.alias("b")
    # one row per partition and source: with ranges, at most their numbers' sum
    plan = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "part", "base", "source_size", "target", "rate", "start").alias("p")
    joined = placed.alias("d").join(plan, (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    rank = F.col("at") + F.col("base")
    taken = F.floor(F.col("rate") * (rank + 1) + F.col("start")) - F.floor(F.col("rate") * rank + F.col("start"))
    decided = joined.select(F.col("row").alias(row), F.struct("source_size", "target", taken.cast("long").alias("copies")).alias(copies))
    out = rows.withColumn(row, F.col(facts)["row"]).join(decided, row)
    found = F.col(copies)
    out = out.select(*[F.col(f"`{c}`") for c in keep], F.col(facts)["size"].alias(size), found["source_size"].alias(total), found["target"].alias(target), found["copies"].alias(copies))
    return out, {"size": size, "source_size": total, "target": target, "copies": copies}
