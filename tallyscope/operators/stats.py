"""Aggregates over file statistics, and what reports derive from them.

All of it is one pass of partial and final aggregation by language; everything
after that works on one row per language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHERS = "others"


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero on the double itself, as ``round(x * 10^d) / 10^d``."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def language_stats(files: DataFrame) -> DataFrame:
    """(language, files, bytes, lines, code_lines, extra_lines) of ``files`` (language, bytes, lines, code_lines).

    A file without lines is faulty and counts for nothing; a language without other files is left out.
    """
    valid = F.col("lines").isNotNull()
    out = files.groupBy("language").agg(
        F.count_if(valid).alias("files"), *[F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("bytes", "lines", "code_lines")]
    )
    return out.where("files > 0").withColumn("extra_lines", F.col("lines") - F.col("code_lines"))


def size_unit(size: Column) -> Column:
    """For totals: a million or a thousand and more."""
    return F.when(size >= 1_000_000, "MBs").when(size >= 1000, "KBs").otherwise("Bytes")


def size_value(size: Column) -> Column:
    return round_to(F.when(size >= 1_000_000, size / 1e6).when(size >= 1000, size / 1e3).otherwise(size.cast("double")), 1)


def detail_size_unit(size: Column) -> Column:
    """For languages: more than a million or a thousand."""
    return F.when(size > 1_000_000, "MBs").when(size > 1000, "KBs").otherwise("Bytes")


def totals(stats: DataFrame) -> DataFrame:
    """One row over ``language_stats``: sums, the average size in whole bytes, and both sizes with their units."""
    sums = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("files", "lines", "code_lines", "extra_lines", "bytes")])
    average = F.when(F.col("files") > 0, F.expr("bytes div files")).otherwise(F.lit(0)).cast("long")
    sums = sums.withColumn("average_bytes", average)
    return sums.withColumns({"size": size_value(F.col("bytes")), "size_unit": size_unit(F.col("bytes")), "average_size": size_value(F.col("average_bytes")), "average_unit": size_unit(F.col("average_bytes"))})


def with_total(stats: DataFrame) -> DataFrame:
    """Languages and, last, a row ``Total``."""
    sums = [F.sum(c).alias(c) for c in ("files", "bytes", "lines", "code_lines", "extra_lines")]
    found = stats.rollup("language").agg(F.grouping_id().alias("level"), *sums)
    name = F.when(F.col("level") == 1, "Total").otherwise(F.col("language"))
    return found.select(name.alias("language"), "files", "bytes", "lines", "code_lines", "extra_lines")


def keyword_totals(keyword_stats: DataFrame) -> DataFrame:
    """(keyword, n) over all languages, without zeros."""
    return keyword_stats.groupBy("keyword").agg(F.sum("n").alias("n")).where("n > 0")


def ranked(stats: DataFrame) -> DataFrame:
    """``stats`` with ``rank`` from 1, by ten times the files plus the bytes; equal ones by name."""
    order = Window.orderBy((F.col("files") * 10 + F.col("bytes")).desc(), F.col("language").asc())
    return stats.withColumn("rank", F.row_number().over(order))


def top_and_others(stats: DataFrame, most: int = 4) -> DataFrame:
    """At most ``most`` rows (rank, language, files, lines, bytes): with more languages, the last is what the others hold together."""
    placed = ranked(stats).withColumn("languages", F.count("*").over(Window.partitionBy(F.lit(0))))
    place = F.when((F.col("languages") > most) & (F.col("rank") >= most), F.lit(most)).otherwise(F.col("rank"))
    name = F.when((F.col("languages") > most) & (F.col("rank") >= most), F.lit(OTHERS)).otherwise(F.col("language"))
    grouped = placed.groupBy(place.cast("int").alias("rank"), name.alias("language"))
    return grouped.agg(*[F.sum(c).alias(c) for c in ("files", "lines", "bytes")])


def percentages(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (rank and ``columns``) with a ``<column>_pct`` each: shares to two digits, the last one being what is left to 100."""
    whole = Window.partitionBy(F.lit(0))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("rank") == F.max("rank").over(whole)
    # the helper columns' names are longer than any of the table's, so none is the same
    pad = "_" * (1 + max(map(len, rows.columns)))
    for c in columns:
        share = F.round(F.col(c) / F.sum(c).over(whole) * 10000.0, 0) / 100.0
        rows = rows.withColumn(f"{pad}share", F.coalesce(share, F.lit(0.0))).withColumn(f"{pad}before", F.coalesce(F.sum(f"{pad}share").over(before), F.lit(0.0)))
        rest = F.when(F.col(f"{pad}before") > 99.99, 0.0).otherwise(round_to(100.0 - F.col(f"{pad}before"), 2))
        rows = rows.withColumn(f"{c}_pct", F.when(last, rest).otherwise(F.col(f"{pad}share"))).drop(f"{pad}share", f"{pad}before")
    return rows


def code_percentage(code: Column, lines: Column) -> Column:
    return F.when(lines > 0, round_to(code / lines * 100.0, 2)).otherwise(0.0)


def scan_summary(listing: DataFrame) -> DataFrame:
    """(total, relevant, excluded) of a listing with a status for each file."""
    return listing.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "relevant").alias("relevant"), F.count_if(F.col("status") == "excluded").alias("excluded"))


def without_overlaps(paths: DataFrame) -> DataFrame:
    """Distinct rows of ``paths`` (path) that are below no other.

    Each path looks up its own ancestors, as many as it has components, by an equi-join;
    no path meets all others.
    """
    distinct = paths.select(F.regexp_replace("path", "(?<=.)/+$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    ups = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    below = distinct.where(F.size(parts) > 1).select("path", ups.alias("up")).join(distinct.select(F.col("path").alias("up")), "up").select("path").distinct()
    return distinct.join(below, "path", "left_anti")
