"""Source files as DataFrames: listings, by rounds over a frontier or as a data source, and contents, whole or by ranges."""

from __future__ import annotations

import json
import os
from dataclasses import replace
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from ..shipping import ship
from ..staging import new_path
from .globs import IgnoreStack
from .listing import Ahead, Entry, ListOptions, list_target, visit, walk

LISTING = "path string, ext string, bytes long, status string"
#: A listing in progress: a folder that no round has opened yet has the status ``folder``, where its ignore files are, and the real paths above it.
FRONTIER = f"{LISTING}, stamp long, ignores array<string>, way array<string>"
#: Folders that a round opens for each folder it is given; the first rounds are short, to spread what they find.
FIRST_FOLDERS, ROUND_FOLDERS = 16, 2000
#: Rows that a task of a listing holds before it hands them on, however many its folders have.
ROWS_AT_ONCE = 10_000
#: About as many bytes of files are read by one task.
BYTES_PER_TASK = 64 << 20
#: Larger files are read by ranges of this size, each by a task of its own.
RANGE_BYTES = 64 << 20


class Part(InputPartition):
    def __init__(self, rows=(), folder=None, stack=None, way=frozenset()):
        super().__init__(None)
        self.rows, self.folder, self.stack, self.way = rows, folder, stack, way


class CodeFiles(DataSource):
    """``format("code_files")``: one row per file below ``targets`` (a JSON list of absolute paths).

    The driver opens the targets' first level only; each subfolder is a partition that a
    task walks, pruning hidden, excluded and ignored subtrees on the way. With the option ``pushdown`` (and the session's
    ``spark.sql.python.filterPushdown.enabled``), conditions on ext, status and path are part of the walk, and folders that can't hold a
    path asked for are not opened. The targets have to be on a file system that all machines mount.
    """

    @classmethod
    def name(cls) -> str:
        return "code_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return (PushdownReader if self.options.get("pushdown") == "true" else CodeFilesReader)(self.options)


class CodeFilesReader(DataSourceReader):
    def __init__(self, options):
        self.targets = json.loads(options["targets"])
        self.options = ListOptions(frozenset(json.loads(options.get("extensions", "[]"))), options.get("exclude") or None, options.get("dotted") == "true", options.get("gitignore") != "false")

    def partitions(self):
        parts: list[Part] = []
        here: list[Entry] = []
        for target in self.targets:
            if os.path.isdir(target):
                stack = IgnoreStack.for_target(target) if self.options.gitignore else IgnoreStack()
                here += walk(target, self.options, stack, lambda *found: parts.append(Part((), *found)))
            else:
                here += list_target(target, self.options)
        return [Part(tuple(here)), *parts]

    def read(self, part):
        found = list(part.rows) if part.folder is None else walk(part.folder, self.options, part.stack, None, part.way)
        for e in found:
            yield (e.path, e.ext, e.bytes, e.status)


class PushdownReader(CodeFilesReader):
    """Spark takes a reader that can be asked only where the session's setting allows it."""

    def pushFilters(self, filters):
        """Take what the walk can ask; hand the rest back."""
        for f in filters:
            column = getattr(f, "attribute", None)
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else [])
            o = self.options
            if column == ("ext",) and values:
                self.options = replace(o, only_ext=values if o.only_ext is None else o.only_ext & values)
            elif column == ("status",) and values:
                self.options = replace(o, only_status=values if o.only_status is None else o.only_status & values)
            elif column == ("path",) and isinstance(f, StringStartsWith) and (f.value.startswith(o.under) or o.under.startswith(f.value)):
                self.options = replace(o, under=max(f.value, o.under, key=len))
            else:
                if column == ("path",) and isinstance(f, EqualTo) and f.value.startswith(o.under):
                    self.options = replace(o, under=f.value)  # paths that only begin so are left to Spark
                yield f


def source_options(targets: list[str], options: ListOptions) -> dict[str, str]:
    given = {"targets": json.dumps(targets), "extensions": json.dumps(sorted(options.extensions)), "dotted": str(options.dotted).lower(), "gitignore": str(options.gitignore).lower()}
    return given | ({"exclude": options.exclude} if options.exclude else {})


def code_files(spark: SparkSession, targets: list[str], options: ListOptions) -> DataFrame:
    """The data source over ``targets``, for SQL on a tree that is not kept."""
    ship(spark)
    spark.dataSource.register(CodeFiles)
    reader = spark.read.format("code_files").options(**source_options(targets, options))
    return reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()


def _folder(path: str, stack: IgnoreStack, way) -> tuple:
    return (path, None, 0, "folder", 0, stack.folders, sorted(way))


def list_files(spark: SparkSession, targets: list[str], options: ListOptions, path: str | None = None, large: int = RANGE_BYTES, first_folders: int = FIRST_FOLDERS, round_folders: int = ROUND_FOLDERS, stamps: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(LISTING of all files below ``targets``, and ``stamp`` if asked for; how many there are: total, relevant, excluded; of the relevant ones bytes, and number and bytes of those over ``large``).

    The folders still to open are a table, dealt out anew each round: a task opens a bounded number of folders for each one it
    gets and writes down the files, and the folders it came to beyond that, which are the next round's table. So a tree
    of any shape is shared by all tasks, and the driver holds no more than the targets. Rounds are Parquet tables below ``path``; the
    counts are observed as these are written. Links back into a folder on the way down end there: each row has the way it came.
    """
    ship(spark)
    path = path or new_path(spark, "listing")
    rows: list[tuple] = []
    for target in targets:
        if os.path.isdir(target):
            rows.append(_folder(target, IgnoreStack.for_target(target) if options.gitignore else IgnoreStack(), ()))
        else:
            rows += [(e.path, e.ext, e.bytes, e.status, e.stamp, None, None) for e in list_target(target, options)]

    def opened(budget: int):
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    found = visit(r["path"], options, IgnoreStack.of_folders(r["ignores"]), frozenset(r["way"]), budget)
                    rows = (_folder(*e) if isinstance(e, Ahead) else (e.path, e.ext, e.bytes, e.status, e.stamp, None, None) for e in found)
                    while out := list(islice(rows, ROWS_AT_ONCE)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        return run

    names = [f.split()[0] for f in FRONTIER.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    counts = dict.fromkeys(("total", "relevant", "excluded", "bytes", "large", "large_bytes"), 0)
    status, size, n = F.col("status"), F.when(F.col("status") == "relevant", F.col("bytes")), 0
    table, left = spark.createDataFrame(rows, FRONTIER), 1
    while left:
        seen = Observation()
        found = table.observe(
            seen, F.count_if(status == "folder").alias("folders"), F.count_if(status != "folder").alias("total"), F.count_if(status == "relevant").alias("relevant"),
            F.count_if(status == "excluded").alias("excluded"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(size > large).alias("large"), F.coalesce(F.sum(F.when(size > large, size)), F.lit(0)).alias("large_bytes"),
        )
        found.write.mode("overwrite").parquet(f"{path}/round={n}")
        got = seen.get
        counts, left = {k: v + got[k] for k, v in counts.items()}, got["folders"]
        here = spark.read.schema(FRONTIER).parquet(f"{path}/round={n}")
        tasks = min(left, 8 * spark.sparkContext.defaultParallelism) or 1
        table = here.where(status == "folder").repartition(tasks, "path").mapInArrow(opened(first_folders if n < 2 else round_folders), FRONTIER)
        n += 1
    listing = spark.read.schema(FRONTIER).parquet(*[f"{path}/round={k}" for k in range(n)]).where(status != "folder")
    return listing.select("path", "ext", "bytes", "status", *(["stamp"] if stamps else [])), counts


def read_text(path: str) -> tuple[str | None, str | None]:
    """(text, error) of a whole file: one that can't be read or isn't UTF-8 has an error and no text."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8"), None
    except (OSError, UnicodeDecodeError) as e:
        return None, str(e)


def dealt_files(files: DataFrame, total_bytes: int | None = None) -> DataFrame:
    """(path, language, bytes) of listed files, dealt by a hash of their path to tasks of about BYTES_PER_TASK."""
    if total_bytes is None:
        total_bytes = files.agg(F.sum("bytes")).first()[0] or 0
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-total_bytes // BYTES_PER_TASK))
    return files.select("path", "language", "bytes").repartition(n, "path")


def _read(batches):
    for batch in batches:
        paths, languages, sizes = (batch.column(k).to_pylist() for k in ("path", "language", "bytes"))
        for path, language, size in zip(paths, languages, sizes):
            text, error = read_text(path)
            yield pa.RecordBatch.from_pydict({"path": [path], "language": [language], "bytes": pa.array([size], pa.int64()), "text": pa.array([text], pa.string()), "error": pa.array([error], pa.string())})


def read_contents(files: DataFrame, total_bytes: int | None = None) -> DataFrame:
    """(path, language, bytes, text, error) of listed files (path, language, bytes).

    Files are dealt as in ``dealt_files``; a file that can't be read or isn't UTF-8 has an error and no text. Spark's own
    file sources are not used here: they hide names with a leading underscore or dot, which count.
    """
    ship(files.sparkSession)
    return dealt_files(files, total_bytes).mapInArrow(_read, "path string, language string, bytes long, text string, error string")


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, language, bytes, start, stop) for each range of each file; the last one's stop is null, as it goes on to the file's end."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    cut = files.select("path", "language", "bytes", F.explode(starts).alias("start"))
    return cut.withColumn("stop", F.when(F.col("start") + range_bytes < F.col("bytes"), F.col("start") + range_bytes))


def read_range(path: str, start: int, stop: int | None, block: int = 1 << 20) -> tuple[int, bytes]:
    """(place of the first line, bytes of all lines) that begin from ``start`` on and before ``stop``.

    A line end is one byte that no other character of UTF-8 holds, so such a cut splits neither a character nor CR LF.
    """
    with open(path, "rb") as f:
        at = start
        if start:
            f.seek(start - 1)  # a line begins at start if the byte before ends one
            at = start - 1
            while True:
                found = f.read(block)
                end = found.find(b"\n")
                if end >= 0:
                    at += end + 1
                    break
                at += len(found)
                if not found or (stop is not None and at >= stop):
                    return at, b""
            if stop is not None and at >= stop:
                return at, b""
            f.seek(at)
        if stop is None:
            return at, f.read()
        out = [f.read(stop - at)]
        while out[-1] and not out[-1].endswith(b"\n"):
            out.append(f.readline(block))
        return at, b"".join(out)


def decode(data: bytes, at: int) -> str:
    """Text of ``data``; an error names the place in the file, where ``data`` begins ``at``."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        what = f"byte 0x{data[e.start]:02x} in position {at + e.start}" if e.end - e.start == 1 else f"bytes in position {at + e.start}-{at + e.end - 1}"
        raise ValueError(f"'utf-8' codec can't decode {what}: {e.reason}") from e
