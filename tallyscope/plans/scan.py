"""A whole run: targets to listing to statistics, report and log."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..languages import Language, extension_owners, language_frame, select_languages
from ..operators import history, lines, stats
from ..sources.code_files import BYTES_PER_TASK, RANGE_BYTES, file_ranges, list_files
from ..sources.globs import exclude_regex
from ..sources.listing import ListOptions
from ..staging import new_path
from . import report


class NoFilesError(RuntimeError):
    """No file to count, or none that can be read."""


@dataclass
class Scan:
    """The tables of a run, lazy over its written listing and file statistics, and what was counted as these were written.

    ``listed``: total, relevant and excluded files. ``counted``: the files that could be read, their lines, code_lines, extra_lines, bytes and
    average_bytes, and how many were faulty.
    """

    spark: SparkSession
    languages: dict[str, Language]
    listing: DataFrame
    files: DataFrame
    listed: dict[str, int]
    counted: dict[str, int]
    keywords: bool = True
    seconds: float = 0.0
    unknown: tuple[str, ...] = ()

    def language_stats(self) -> DataFrame:
        return stats.language_stats(self.files)

    def keyword_stats(self) -> DataFrame:
        return lines.keyword_stats(self.files, language_frame(self.spark, self.languages))

    def totals(self) -> DataFrame:
        return stats.totals(self.language_stats())

    def faulty(self) -> DataFrame:
        return self.files.where("lines IS NULL").select("path", "error", "bytes")

    def summary(self) -> DataFrame:
        return stats.scan_summary(self.listing)

    def metrics(self, row) -> dict[str, int] | None:
        """Files and lines a second, for runs of more than a second."""
        return {"files_per_sec": int(row["files"] / self.seconds), "lines_per_sec": int(row["lines"] / self.seconds)} if self.seconds > 1 else None

    def register(self, prefix: str = "code_") -> None:
        """Temporary views, so that SQL can ask more of a run."""
        for name in ("listing", "files", "language_stats", "keyword_stats", "totals", "faulty"):
            value = getattr(self, name)
            (value if isinstance(value, DataFrame) else value()).createOrReplaceTempView(prefix + name)


def count_files(files: DataFrame, sizes: dict[str, int], languages: dict[str, Language], options: Options, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, language, bytes, error, lines, code_lines, counts) of listed files (path, language, bytes).

    ``sizes``: bytes, and of the files over ``range_bytes`` large (their number) and large_bytes. These are cut in ranges that tasks share, the others
    are read whole, many to a task.
    """
    braces, keywords = bool(options.braces_as_code), not options.no_keywords
    counted = lines.path_stats(files.where(F.col("bytes") <= range_bytes), languages, braces, keywords, sizes["bytes"] - sizes["large_bytes"])
    if sizes["large"]:
        tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-sizes["large_bytes"] // BYTES_PER_TASK))
        ranges = file_ranges(files.where(F.col("bytes") > range_bytes), range_bytes).repartition(tasks, "path", "start")
        counted = counted.unionByName(lines.range_stats(ranges, languages, braces, keywords))
    return counted


def scan(spark: SparkSession, targets: list[str], languages: dict[str, Language], options: Options, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> Scan:
    """List, read and count ``targets``; the listing and the file statistics are written as Parquet in ``folder``, or in the shared folder.

    Files of at most ``range_bytes`` are read whole, many to a task; larger ones are cut in ranges that tasks share.
    """
    began = time.time()
    folder = folder or new_path(spark, "scan")
    kept, unknown = select_languages(languages, options.languages, options.exclude_languages)
    dimension = language_frame(spark, kept)
    wanted = frozenset(x for language in kept.values() for x in language.extensions)
    listing, listed = list_files(spark, targets, ListOptions(wanted, exclude_regex(options.exclude or []), bool(options.search_in_dotted), not options.no_gitignore), f"{folder}/listing", range_bytes)
    if not listed["relevant"]:
        raise NoFilesError("no relevant files")
    # the dimension has a row per extension, and extensions come from definitions, not from data
    files = listing.where("status = 'relevant'").join(F.broadcast(extension_owners(dimension)), "ext")
    keywords, counted = not options.no_keywords, count_files(files, listed, kept, options, range_bytes)
    seen, valid = Observation(), F.col("lines").isNotNull()
    sums = [F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).alias(c) for c in ("lines", "code_lines", "bytes")]
    counted.observe(seen, F.count_if(valid).alias("files"), F.count_if(~valid).alias("faulty"), *sums).write.mode("overwrite").parquet(f"{folder}/files")
    found = dict(seen.get)
    found |= {"extra_lines": found["lines"] - found["code_lines"], "average_bytes": found["bytes"] // found["files"] if found["files"] else 0}
    return Scan(spark, kept, listing, spark.read.schema(counted.schema).parquet(f"{folder}/files"), listed, found, keywords, time.time() - began, tuple(unknown))


def render(run: Scan, options: Options, log: DataFrame | None = None, now: datetime | None = None) -> tuple[str, dict]:
    """(report, log entry) of a run; a row per language is all that reaches the driver, and the list of faulty files if asked for. ``log``: earlier runs, as ``history.SCHEMA``."""
    if not run.counted["files"]:
        raise NoFilesError("all files are faulty")
    ranked = stats.ranked(run.language_stats())
    rows = [r.asDict() for r in ranked.orderBy("rank").collect()]
    total = run.counted
    words: dict[str, dict[str, int]] = {}
    sums: dict[str, int] = {}
    for r in run.keyword_stats().collect() if run.keywords else ():
        words.setdefault(r.language, {})[r.keyword] = r.n
        if r.n:
            sums[r.keyword] = sums.get(r.keyword, 0) + r.n
    parts = [report.summary(run.listed, run.counted["faulty"], run.unknown), report.details(rows, words)]
    if len(rows) > 1:
        top = stats.top_and_others(run.spark.createDataFrame(rows, ranked.schema)).orderBy("rank").collect()
        parts += [report.total(total, sums), report.overview([r.asDict() for r in top], not options.no_visual, options.colors)]
    now = now or datetime.now(timezone.utc)
    if log is not None and options.compare:
        entries = [r.asDict() for r in history.latest(log, options.compare).withColumn("epoch", F.unix_timestamp("ts")).collect()]
        for e in entries:
            e["ts"] = datetime.fromtimestamp(e["epoch"], timezone.utc) if e["epoch"] is not None else now
        if entries:
            parts.append(report.progress(entries, total, now))
    if (speed := run.metrics(total)) is not None:
        parts.append(f"{speed['files_per_sec']} files/s | {speed['lines_per_sec']} lines/s")
    if options.show_faulty_files:
        parts += [f"faulty: {r.path} ({r.error})" for r in run.faulty().orderBy("path").toLocalIterator()]
    entry = {"name": options.log or None, "ts": now} | {c: total[c] for c in ("files", "lines", "code_lines", "extra_lines", "bytes", "average_bytes")}
    return "\n\n".join(parts), entry


def read_log(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    """The ``n`` newest runs of the log at ``path`` (a text file; its runs are a table beside it); None without any."""
    table = history.table_of(path)
    if not history.runs(spark, table) and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            history.import_text(spark, table, f.read())
    return history.read_runs(spark, table, n)


def write_log(spark: SparkSession, path: str, entry: dict, options: Options) -> None:
    """Add a run to the log's table, then write the text form anew from it, newest run first; runs that end together both stay."""
    config = {"dirs": options.dirs, "exclude": options.exclude, "languages": options.languages, "excluded_languages": options.exclude_languages, "braces_as_code": options.braces_as_code, "search_in_dotted": options.search_in_dotted}
    read_log(spark, path, 1)  # takes a text log over that has no table yet
    history.append_entry(spark, history.table_of(path), entry | {"text": history.entry_text(entry, config)})
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(aside, "w", encoding="utf-8") as f:
        for r in history.read_runs(spark, history.table_of(path)).orderBy(F.col("ts").desc_nulls_last()).select("text").toLocalIterator():
            f.write(r.text)
    os.replace(aside, path)
