"""The log of runs, as a Parquet table or in its text form, and progress against earlier runs."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import round_to

SCHEMA = "name string, ts timestamp, files long, lines long, code_lines long, extra_lines long, bytes long, average_bytes long"
#: A run in the log's table: its numbers, and its entry in the text form.
LOGGED = f"{SCHEMA}, text string"
COMPARED = ("files", "lines", "code_lines", "extra_lines")
RULE = "-" * 92

# The labels of an entry's numbers in the text form.
LABELS = {"files": "Files:", "lines": "Lines:", "code_lines": "Code:", "extra_lines": "Extra:", "bytes": "Total Size:", "average_bytes": "Average Size:"}


def parse_log(log: DataFrame) -> DataFrame:
    """Entries of text logs: ``log`` has a column ``content``, a whole log per row, newest entry first.

    Returns LOGGED and ``place``, the entry's number in its log. An entry without an average size is
    incomplete and left out. Dates have offsets with or without a colon; one that can't be read is null.
    """
    entries = F.slice(F.split("content", r"(?m)^\s*===>"), F.lit(2), F.lit(2**31 - 1))
    each = log.select(F.posexplode(entries).alias("place", "entry"))
    name = F.trim(F.regexp_extract("entry", r"^([^\n]*)", 1))
    date = F.trim(F.regexp_extract("entry", r"^[^\n]*\n([^\n]*)", 1))
    stamp = F.coalesce(*[F.try_to_timestamp(date, F.lit(f"yyyy-MM-dd HH:mm:ss {z}")) for z in ("Z", "XXX")])
    numbers = [F.expr(f"try_cast(nullif(regexp_extract(entry, '(?m)^ *{label} *([0-9]+)', 1), '') AS BIGINT)").alias(c) for c, label in LABELS.items()]
    return each.select("place", F.nullif(name, F.lit("")).alias("name"), stamp.alias("ts"), *numbers, F.concat(F.lit("===>"), "entry").alias("text")).where("average_bytes IS NOT NULL")


def latest(log: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest entries."""
    return log.orderBy(F.col("ts").desc_nulls_last()).limit(n)


def signed_percentage(old: Column, new: Column) -> Column:
    """Change in percent, to two digits; changes too small to show are 0.01. From 0 it has no value."""
    size = F.try_divide(F.abs(new - old) * 100.0, old.cast("double"))
    shown = F.when((size > 0) & (size < 0.01), 0.01).otherwise(round_to(F.try_divide(F.abs(new - old).cast("double"), old.cast("double")) * 100.0, 2))
    return F.when(old == new, 0.0).when(new > old, shown).otherwise(-shown)


def signed_percentage_text(old: int, new: int) -> str:
    """The same for a report: with its sign, and `` <`` before a change too small to show."""
    sign = "+" if new > old else "-" if old > new else ""
    if not old:
        return "0" if not new else f"{sign}inf"
    size = abs(new - old) / old * 100
    less, size = (" <", 0.01) if 0 < size < 0.01 else ("", int(size * 100 + 0.5) / 100)
    return f"{sign}{less}{size:g}"


def age(ts: Column, now: Column) -> list[Column]:
    """Whole days, hours and minutes from ``ts`` to ``now``."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60).cast("long")
    return [F.floor(minutes / 1440).alias("days"), F.floor(minutes % 1440 / 60).alias("hours"), (minutes % 60).alias("minutes")]


def age_parts(minutes: int) -> tuple[int, int, int]:
    return minutes // 1440, minutes % 1440 // 60, minutes % 60


def compare(log: DataFrame, current: DataFrame, n: int, now: Column) -> DataFrame:
    """The ``n`` newest entries with their age and the change of each number up to ``current`` (one row)."""
    held = F.broadcast(current.select(*[F.col(c).alias(f"now_{c}") for c in COMPARED]).limit(1))
    joined = latest(log, n).withColumn("_one", F.lit(1)).join(held.withColumn("_one", F.lit(1)), "_one")
    return joined.select("name", "ts", *age(F.col("ts"), now), *COMPARED, *[signed_percentage(F.col(c), F.col(f"now_{c}")).alias(f"{c}_pct") for c in COMPARED])


def table_of(path: str) -> str:
    """Where the runs of a text log are kept as a table."""
    return os.path.splitext(path)[0] + ".runs"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def runs(spark: SparkSession, table: str) -> list[str]:
    """Folders of the table's committed runs, newest first: their names begin with the time."""
    files, where, _ = _files(spark, table)
    if not files.exists(where):
        return []
    found = [x.getPath().getName() for x in files.listStatus(where)]
    return sorted((x for x in found if x.startswith("run=")), reverse=True)


def _commit(spark: SparkSession, table: str, rows: DataFrame, newest: datetime, mark: str) -> None:
    """Write ``rows`` aside, under a name that readers pass over, and rename the folder: a run is there whole or not at all, whoever else writes."""
    aside = f"{table}/_writing-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(aside)
    files, where, path = _files(spark, aside)
    stamp = newest.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    if not files.rename(where, path(f"{table}/run={stamp}-{mark}")):
        raise OSError(f"could not add a run to {table}")


def append_entry(spark: SparkSession, table: str, entry: dict, mark: str | None = None) -> None:
    """Add a run (LOGGED) to the table; nothing that is there is read or rewritten, so any number of runs may do so at once. A run whose ``mark`` is there already is not added again."""
    if mark is not None and any(name.endswith(f"-{mark}") for name in runs(spark, table)):
        return
    row = tuple(entry.get(c.split()[0]) for c in LOGGED.split(", "))
    _commit(spark, table, spark.createDataFrame([row], LOGGED), entry["ts"], mark or uuid.uuid4().hex[:12])


def import_text(spark: SparkSession, table: str, text: str) -> None:
    """Add the entries of a text log, as one folder named after the newest; a second writer's folder of that name ends up inside it, where readers pass it over."""
    found = parse_log(spark.createDataFrame([(text,)], "content string"))
    if first := found.agg(F.max(F.unix_timestamp("ts"))).first()[0]:
        names = [c.split()[0] for c in LOGGED.split(", ")]
        _commit(spark, table, found.select(*names), datetime.fromtimestamp(first, timezone.utc), "text")


def read_runs(spark: SparkSession, table: str, n: int | None = None) -> DataFrame | None:
    """The table's runs, or its ``n`` newest, for which only as many folders are opened; None if there is none."""
    found = runs(spark, table)[:n]
    if not found:
        return None
    rows = spark.read.schema(LOGGED).parquet(*[f"{table}/{x}" for x in found])
    return rows if n is None else latest(rows, n)


def entry_text(entry: dict, config: dict) -> str:
    """An entry in the text form; new entries stand before older ones."""
    ts: datetime = entry["ts"]
    yes = lambda x: "yes" if x else "no"
    lists = {k: ",".join(config.get(k) or ()) for k in ("dirs", "exclude", "languages", "excluded_languages")}
    return "\n".join([
        f"===>{entry.get('name') or ''}", f"{ts:%Y-%m-%d %H:%M:%S %z}", "Configuration:",
        f"    dirs: {lists['dirs']}", f"    exclude: {lists['exclude']}", f"    languages: {lists['languages']}", f"    excluded-languages: {lists['excluded_languages']}",
        f"    braces-as-code: {yes(config.get('braces_as_code'))}", f"    search-in-dotted: {yes(config.get('search_in_dotted'))}",
        "Stats:", f"    Files: {entry['files']}", f"    Lines: {entry['lines']}", f"        Code: {entry['code_lines']}", f"        Extra: {entry['extra_lines']}",
        f"    Total Size: {entry['bytes']}", f"        Average Size: {entry['average_bytes']}", "", "", RULE, "", "", "",
    ])
