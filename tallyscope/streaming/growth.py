"""Trees followed as they change: file statistics that a stream keeps up to date from batch to batch.

Each batch lists the tree, by rounds over a frontier as a scan does; only files that are new or changed since the kept table was written are
read, the others' rows are carried over, and rows of files that went are dropped. The
table has a row of numbers per file, so writing it anew is small beside reading the files.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..config import Options
from ..languages import Language, extension_owners, language_frame, select_languages
from ..operators import history, stats
from ..plans.scan import count_files
from ..sources.code_files import LISTING, RANGE_BYTES, list_files
from ..sources.globs import exclude_regex
from ..sources.listing import ListOptions
from ..staging import new_path, remove, staged

#: A file and when it or its name last changed, in nanoseconds.
SEEN = f"{LISTING}, stamp long"
#: File statistics as kept; ``settled``: the file had been left alone for a while when it was listed.
KEPT = "path string, language string, bytes long, stamp long, settled boolean, error string, lines long, code_lines long, counts array<long>"
#: A file changed within so many seconds before its listing may change again under the same stamp, so it is read again next time.
SETTLE = 2.0
#: What makes a file the same one as before.
SAME = ["path", "language", "bytes", "stamp"]


class Rounds(DataSource):
    """``format("code_rounds")``: a stream that has a batch whenever its trigger asks, a row for each of the option ``targets`` and the time of asking, which is the offset.

    What a batch does with them is shared by tasks; the stream itself opens no folder.
    """

    @classmethod
    def name(cls) -> str:
        return "code_rounds"

    def schema(self) -> str:
        return "target string, at long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RoundsReader(self.options)


class RoundsReader(DataSourceStreamReader):
    def __init__(self, options):
        self.targets = json.loads(options["targets"])

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict):
        return [InputPartition((self.targets, end["at"]))]

    def read(self, part):
        targets, at = part.value
        for target in targets:
            yield (target, at)


@dataclass(frozen=True)
class Change:
    """What a batch did: files read, of these the ones that were ``new`` or different, files carried over, files that went; totals as a log has them.

    ``again``: the batch had been done before it was run, by a driver that ended before the stream knew.
    """

    batch: int
    read: int
    new: int
    carried: int
    gone: int
    totals: dict[str, int]
    again: bool = False


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, where, _ = history._files(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(where) if x.getPath().getName().startswith("version=")) if files.exists(where) else []


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest file statistics kept in ``folder`` (KEPT); no rows before the first batch."""
    found = _names(spark, folder)
    return spark.read.schema(KEPT).parquet(f"{folder}/{found[-1]}") if found else spark.createDataFrame([], KEPT)


def _totals(kept: DataFrame) -> dict[str, int]:
    valid = kept.where("lines IS NOT NULL")
    found = valid.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "code_lines", "bytes")]).first().asDict()
    return found | {"extra_lines": found["lines"] - found["code_lines"], "average_bytes": found["bytes"] // found["files"] if found["files"] else 0}


def absorb(listing: DataFrame, seen: int, batch: int, folder: str, languages: dict[str, Language], options: Options, settle: float = SETTLE, range_bytes: int = RANGE_BYTES) -> Change:
    """Bring the table in ``folder`` up to ``listing`` (SEEN, one row per path, made from the time ``seen`` on, in nanoseconds), as version ``batch``.

    The new version is written aside and renamed, so it is there whole or not at all, and a batch
    that is run again finds it and changes nothing. Without any change nothing is written. The version before stays for
    readers that have it open; older ones go. An empty listing leaves an empty table.
    """
    spark = listing.sparkSession
    names, mine = _names(spark, folder), f"version={batch:012d}"
    if mine in names:
        kept = spark.read.schema(KEPT).parquet(f"{folder}/{mine}")
        return Change(batch, 0, 0, kept.count(), 0, _totals(kept), True)
    old = current(spark, folder)
    owners = F.broadcast(extension_owners(language_frame(spark, languages)))
    settled = F.col("stamp") < F.lit(seen - int(settle * 1e9))
    aside = [new_path(spark, "growth-listing"), new_path(spark, "growth-changed")]
    now = staged(listing.where("status = 'relevant'").join(owners, "ext").select(*SAME, settled.alias("settled")), "", aside[0])
    before = old.select(*SAME, F.col("settled").alias("was_settled"))
    found = now.join(before, SAME, "left")
    watch, size, large = Observation(), F.col("bytes"), F.col("bytes") > range_bytes
    marked = found.where("NOT coalesce(was_settled, false)").observe(
        watch, F.count("*").alias("read"), F.count_if(F.col("was_settled").isNull()).alias("new"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.count_if(large).alias("large"), F.coalesce(F.sum(F.when(large, size)), F.lit(0)).alias("large_bytes"),
    )
    changed = staged(marked.select(*SAME, "settled"), "", aside[1])
    got = dict(watch.get)
    same = old.where("settled").join(now.select(*SAME), SAME, "left_semi")
    gone = old.join(now.select("path"), "path", "left_anti").count()
    carried = same.count()
    if names and not got["read"] and not gone:
        new = old
    else:
        counted = count_files(changed, got, languages, options, range_bytes).join(changed.select("path", "stamp", "settled"), "path")
        columns = [c.split()[0] for c in KEPT.split(", ")]
        written = f"{folder}/_writing-{uuid.uuid4().hex}"
        same.select(*columns).unionByName(counted.select(*columns)).write.parquet(written)
        files, where, path = history._files(spark, written)
        if not files.rename(where, path(f"{folder}/{mine}")):
            raise OSError(f"could not add {mine} to {folder}")
        for name in names[:-1]:
            remove(spark, f"{folder}/{name}")
        new = spark.read.schema(KEPT).parquet(f"{folder}/{mine}")
    change = Change(batch, got["read"], got["new"], carried, gone, _totals(new))
    for path in aside:
        remove(spark, path)
    return change


def language_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics by language of the newest version."""
    return stats.language_stats(current(spark, folder))


def follow(
    spark: SparkSession, targets: list[str], languages: dict[str, Language], options: Options, folder: str, log: str | None = None,
    every: str | None = None, settle: float = SETTLE, range_bytes: int = RANGE_BYTES, on_change: Callable[[Change], None] | None = None,
) -> StreamingQuery:
    """Keep the file statistics of ``targets`` in ``folder`` up to date: once, or ``every`` so often (like ``"1 minute"``) until the query is stopped.

    Where a query on the same folder stopped, the next goes on. Each batch that finds new, different or gone files adds
    a run to the table of the text log ``log``, once even if the batch is run again. The folder has to be shared by driver and executors;
    languages and options have to stay as they are in a folder, as files that didn't change are not counted anew.
    """
    kept, _ = select_languages(languages, options.languages, options.exclude_languages)
    wanted = frozenset(x for language in kept.values() for x in language.extensions)
    given = ListOptions(wanted, exclude_regex(options.exclude or []), bool(options.search_in_dotted), not options.no_gitignore)

    def step(round_: DataFrame, batch: int) -> None:
        seen, here, aside = time.time_ns(), [r.target for r in round_.collect() if os.path.exists(r.target)], new_path(spark, "growth-listed")
        listing, _ = list_files(spark, here, given, aside, range_bytes, stamps=True)
        change = absorb(listing, seen, batch, folder, kept, options, settle, range_bytes)
        remove(spark, aside)
        if log is not None and (change.new or change.gone or change.again):
            entry = {"name": options.log or None, "ts": datetime.now(timezone.utc)} | {c: change.totals[c] for c in ("files", "lines", "code_lines", "extra_lines", "bytes", "average_bytes")}
            config = {"dirs": targets, "exclude": options.exclude, "languages": options.languages, "excluded_languages": options.exclude_languages, "braces_as_code": options.braces_as_code, "search_in_dotted": options.search_in_dotted}
            history.append_entry(spark, history.table_of(log), entry | {"text": history.entry_text(entry, config)}, f"{zlib.crc32(folder.encode()):08x}.{batch:012d}")
        if on_change is not None:
            on_change(change)

    spark.dataSource.register(Rounds)
    rounds = spark.readStream.format("code_rounds").option("targets", json.dumps(targets)).load()
    stream = rounds.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/stream")
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
