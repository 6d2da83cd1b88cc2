"""Line classification and keyword counts over files held in a DataFrame.

``file_stats`` runs the lexer once per file: one narrow map, right for trees of
many files; ``path_stats`` does so for files still to be read. ``range_stats`` lets many tasks share one huge file: each walks a
range from every state it may begin in, and ranges compose. ``line_states`` asks the same of
lines held as rows: what a line does to the state is a byte, and the state before each line a prefix scan over bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexer
from ..languages import Language
from ..shipping import ship
from ..sources.code_files import dealt_files, decode, read_range, read_text
from ..staging import staged

STATS = "lines long, code_lines long, counts array<long>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines of a text as an array, without an empty one after the last line's end."""
    text = F.coalesce(text, F.lit(""))
    # one character is found much faster than an expression, and few texts have carriage returns
    found = F.when(F.contains(text, F.lit("\r\n")), F.split(text, "\r?\n")).otherwise(F.split(text, "\n"))
    return let(found, lambda x: F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def trim(line: Column) -> Column:
    """Without the characters of Unicode's White_Space property at both ends; unlike an expression, it looks at no others."""
    return F.trim(line, F.lit(lexer.WHITE))


def blank_or_braces(line: Column) -> Column:
    """A line that is no code wherever it stands outside of strings and comments."""
    return trim(line).isin("", *sorted(lexer.BRACES))


def is_extra(trimmed: Column, braces_as_code: bool = False) -> Column:
    """Whether cleansed text counts as extra."""
    return F.lit(False) if braces_as_code else trimmed.isin(*sorted(lexer.BRACES))


def file_stats(files: DataFrame, languages: dict[str, Language], braces_as_code: bool = False, keywords: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``files`` (language, text and the columns ``keep``) with lines, code_lines and a count for each keyword of the language.

    A null text or a null or unknown language has null counts, an empty text no lines. Equal files each get
    a row. Columns of ``keep`` may have any names but those three. It is a map without shuffle, and only
    the text's batch is held.
    """
    ship(files.sparkSession)
    keep = [c for c in files.columns if c not in ("text", "error")] if keep is None else keep
    found = ("lines", "code_lines", "counts")
    if clash := {c.lower() for c in keep} & set(found):
        raise ValueError(f"columns {sorted(clash)} would stand twice; rename them or leave them out of keep")
    kept = files.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], "language", "text")
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(keep, kept.schema.fields)), *T.StructType.fromDDL(STATS).fields])

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1)):
                language, text = languages.get(name), text.as_py()
                rows.append((None, None, None) if language is None or text is None else lexer.file_facts(text, language, braces_as_code, keywords))
            lines, code, counts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lines, pa.int64()), pa.array(code, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], [*keep, *found])

    return kept.mapInArrow(run, schema)


def path_stats(files: DataFrame, languages: dict[str, Language], braces_as_code: bool = False, keywords: bool = True, total_bytes: int | None = None) -> DataFrame:
    """(path, language, bytes, error, lines, code_lines, counts) of listed files (path, language, bytes): ``file_stats`` of their contents.

    A task reads a file, counts it and lets go of it before the next, so it holds one text and no batch of texts. A file
    that can't be read or isn't UTF-8 has an error and null counts.
    """
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            found = []
            for path, name in zip(batch.column("path").to_pylist(), batch.column("language").to_pylist()):
                text, error = read_text(path)
                language = languages.get(name)
                facts = (None, None, None) if language is None or text is None else lexer.file_facts(text, language, braces_as_code, keywords)
                found.append((error, *facts))
            errors, lines, code, counts = zip(*found) if found else ((), (), (), ())
            made = [pa.array(errors, pa.string()), pa.array(lines, pa.int64()), pa.array(code, pa.int64()), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "language", "bytes")), *made], names)

    names = ["path", "language", "bytes", "error", "lines", "code_lines", "counts"]
    return dealt_files(files, total_bytes).mapInArrow(run, f"path string, language string, bytes long, error string, {STATS}")


def range_stats(ranges: DataFrame, languages: dict[str, Language], braces_as_code: bool = False, keywords: bool = True) -> DataFrame:
    """(path, language, bytes, error, lines, code_lines, counts) of files cut in ``file_ranges``: the rows of ``file_stats``, made by many tasks a file.

    A task walks the lines of a range from each state they may begin in; what it finds is a small row, and a
    file's rows are folded in order. A file of which any range can't be read or isn't UTF-8 has the first such error and no
    counts. A path is one file, however often it is listed; unknown languages have null counts. No rows: no rows.
    """
    ship(ranges.sparkSession)
    schema = "path string, language string, bytes long, start long, error string, lines long, after array<int>, code array<long>, counts array<array<long>>"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                language, row = languages.get(r["language"]), {k: r[k] for k in ("path", "language", "bytes", "start")} | dict.fromkeys(("error", "lines", "after", "code", "counts"))
                try:
                    at, data = read_range(r["path"], r["start"], r["stop"])
                    text = decode(data, at)
                except (OSError, ValueError) as e:
                    yield pa.RecordBatch.from_pylist([row | {"error": str(e)}], arrow)
                    continue
                if language is not None:
                    states = lexer.states_of(language)
                    found = dict(zip(states, lexer.text_facts(text, language, states, braces_as_code, keywords)))
                    each = [found.get(s, (s, 0, [0] * len(language.keywords))) for s in range(4)]
                    row |= {"lines": lexer.count_lines(text), "after": [x[0] for x in each], "code": [x[1] for x in each], "counts": [x[2] for x in each]}
                yield pa.RecordBatch.from_pylist([row], arrow)

    longs = pa.list_(pa.int64())
    arrow = pa.schema([("path", pa.string()), ("language", pa.string()), ("bytes", pa.int64()), ("start", pa.int64()), ("error", pa.string()), ("lines", pa.int64()), ("after", pa.list_(pa.int32())), ("code", longs), ("counts", pa.list_(longs))])
    each = ranges.mapInArrow(run, schema)
    r = F.sort_array(F.collect_set(F.struct("start", "lines", "after", "code", "counts")))
    files = each.groupBy("path", "language", "bytes").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("start"))).alias("error"), r.alias("r"))
    none = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("code"), F.transform(F.get(F.get("r", F.lit(0))["counts"], F.lit(0)), lambda x: F.lit(0).cast("long")).alias("counts"))

    def go_on(a, x):
        counts = F.zip_with(a["counts"], F.get(x["counts"], a["state"]), lambda m, n: m + n)
        return F.struct(F.get(x["after"], a["state"]).alias("state"), (a["lines"] + x["lines"]).alias("lines"), (a["code"] + F.get(x["code"], a["state"])).alias("code"), counts.alias("counts"))

    folded = files.withColumn("f", F.when(F.col("error").isNull(), F.aggregate("r", none, go_on)))
    return folded.select("path", "language", "bytes", "error", F.col("f.lines").alias("lines"), F.col("f.code").alias("code_lines"), F.col("f.counts").alias("counts"))


def keyword_stats(stats: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, keyword, n) over all files of ``stats``; every keyword of a language that has files is there, if only with 0."""
    names = languages.select(F.col("name").alias("language"), F.posexplode("keywords").alias("k", "word")).select("language", "k", F.col("word.name").alias("keyword"))
    counted = stats.where("counts IS NOT NULL").select("language", F.posexplode("counts").alias("k", "n")).groupBy("language", "k").agg(F.sum("n").alias("n"))
    present = stats.where("lines IS NOT NULL").select("language").distinct()
    found = names.join(counted, ["language", "k"], "left").join(present, "language", "left_semi")
    return found.groupBy("language", "keyword").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def line_facts(lines: DataFrame, languages: dict[str, Language], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``lines`` (language, line, state) with cleansed, has_literal and next_state: each line by itself, trimmed, from its state.

    A blank or null line leaves its state; an unknown language has nulls. Columns of ``keep`` may have any names but those three.
    """
    ship(lines.sparkSession)
    given = [F.col("language"), trim(F.coalesce("line", F.lit(""))).alias("line"), F.col("state").cast("int").alias("state")]
    kept = lines.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], *given)
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(keep, kept.schema.fields)), *T.StructType.fromDDL("cleansed string, has_literal boolean, next_state int").fields])

    def run(batches):
        for batch in batches:
            found = []
            for name, line, state in zip(*(batch.column(k).to_pylist() for k in ("language", "line", "state"))):
                facts = lexer.line_facts(line, languages[name], state) if line and name in languages else None
                found.append((facts.cleansed, facts.has_literal, facts.state) if facts else (None, False, state) if name in languages else (None, None, None))
            cleansed, literal, after = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(cleansed, pa.string()), pa.array(literal, pa.bool_()), pa.array(after, pa.int32())], schema.names)

    return kept.mapInArrow(run, schema)


#: A line's effect is a byte, two bits for the state that each of the four states becomes; this one leaves them as they are.
SAME = 0b11_10_01_00


def effect_byte(after: list[int]) -> int:
    return sum(b << 2 * a for a, b in enumerate(after))


@lru_cache(maxsize=1)
def composed() -> np.ndarray:
    """What two effects are together, at [first, second]: 256 times 256 bytes."""
    after = (np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3
    return sum(after[:, after[:, a]].T << 2 * a for a in range(4)).astype(np.uint8)


def prefixes(effects: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each line, what the lines of its run up to it do together; ``first`` marks where runs begin.

    Effects compose associatively, so a run of n lines takes log n look-ups of whole arrays.
    """
    table, out, begin = composed(), effects.copy(), np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    at, step, longest = np.arange(len(out)), 1, int((np.arange(len(out)) - begin).max(initial=0))
    while step <= longest:
        (has,) = np.nonzero(at - begin >= step)
        out[has] = table[out[has - step], out[has]]
        step *= 2
    return out


def line_outcomes(lines: DataFrame, languages: dict[str, Language], braces_as_code: bool = False) -> DataFrame:
    """``lines`` (file, line_no, language, line) with ``effect`` and ``code``: the state that each of the four states becomes, two bits each, and in which of them the line is code, a bit each.

    Lines without any mark of their language are settled by column functions and never reach
    Python: code stays code, a comment stays a comment, a string stays a string. Lines of unknown languages are left out.
    """
    ship(lines.sparkSession)
    known = F.col("language").isin(*sorted(languages))
    marks = F.lit(None).cast("string")
    for name, x in languages.items():
        marks = F.when(F.col("language") == name, F.lit(lexer.any_mark(x).pattern)).otherwise(marks)
    trimmed = lines.where(known).withColumn("text", trim(F.coalesce("line", F.lit("")))).withColumn("marked", F.rlike("text", marks))
    full, extra = (F.col("text") != "").cast("int"), is_extra(F.col("text"), braces_as_code).cast("int")
    plain = trimmed.where("NOT marked").select("file", F.col("line_no").cast("long").alias("line_no"), F.lit(SAME).alias("effect"), (full * (13 - extra)).cast("int").alias("code"))

    def run(batches):
        held: dict[tuple[str, str], tuple[int, int]] = {}
        for batch in batches:
            found = []
            for key in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()):
                got = held.get(key)
                if got is None:
                    language, after, code = languages[key[0]], [0, 1, 2, 3], 0
                    for state in lexer.states_of(language):
                        facts = lexer.line_facts(key[1], language, state)
                        after[state] = facts.state
                        code |= lexer.is_code(facts, braces_as_code) << state
                    got = (effect_byte(after), code)
                    if len(key[1]) <= 80:
                        if len(held) >= 50_000:
                            held.clear()
                        held[key] = got
                found.append(got)
            effects, codes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("line_no"), pa.array(effects, pa.int32()), pa.array(codes, pa.int32())], ["file", "line_no", "effect", "code"])

    kind = dict(lines.dtypes)["file"]
    marked = trimmed.where("marked").select("file", F.col("line_no").cast("long").alias("line_no"), "language", "text").mapInArrow(run, f"file {kind}, line_no long, effect int, code int")
    return plain.unionByName(marked)


def _scanned(rows: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """``rows`` (keys, effect, others), sorted, with ``before``, what the rows of the same keys above do together, and, in a key's last row, ``whole``, what they all do."""
    names = [f.name for f in schema.fields]

    def changes(table: pa.Table) -> np.ndarray:
        first = np.zeros(table.num_rows, bool)
        first[:1] = True
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first[1:] |= codes[1:] != codes[:-1]
        return first

    def run(batches):
        held = None  # the last row so far, with all that its run did up to it: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).append_column("before", pa.nulls(batch.num_rows, pa.int32())).append_column("upto", pa.nulls(batch.num_rows, pa.int32()))
            table = pa.concat_tables([held, table]) if held is not None else table
            first = changes(table)
            effects = table.column("effect").to_numpy().astype(np.uint8)
            if held is not None:
                effects[0] = held.column("upto")[0].as_py()
            upto = prefixes(effects, first)
            before = np.where(first, SAME, np.roll(upto, 1)).astype(np.int32)
            if held is not None:
                before[0] = held.column("before")[0].as_py()
            table = table.drop(["before", "upto"]).append_column("before", pa.array(before, pa.int32())).append_column("upto", pa.array(upto.astype(np.int32)))
            last = np.append(first[1:], False)
            yield from finished(table.slice(0, table.num_rows - 1), last[:-1])
            held = table.slice(table.num_rows - 1)
        if held is not None:
            yield from finished(held, np.array([True]))

    def finished(table, last):
        whole = pa.array(table.column("upto").to_numpy(), pa.int32(), mask=~last)
        yield from table.append_column("whole", whole).select(names).to_batches()

    return rows.mapInArrow(run, schema)


def line_states(outcomes: DataFrame, stretch: int = 4096) -> DataFrame:
    """(file, line_no, state, is_code) for ``line_outcomes``: the state before each line by a prefix scan.

    Lines fall in stretches, which tasks share whatever their file. One pass composes the effects of a stretch's lines and is
    staged; a row for each stretch is scanned again within its file, which gives the state that each begins in; the
    rest is a join and two shifts. A file of any length is shared by many tasks. No rows: no rows.
    """
    kind = next(f.dataType for f in outcomes.schema.fields if f.name == "file")

    def typed(ddl: str) -> T.StructType:
        return T.StructType([T.StructField("file", kind), *T.StructType.fromDDL(ddl).fields])

    cut = outcomes.select("file", F.floor(F.col("line_no") / stretch).cast("long").alias("stretch"), "line_no", "effect", "code")
    dealt = cut.repartition("file", "stretch").sortWithinPartitions("file", "stretch", "line_no")
    lines = staged(_scanned(dealt, ["file", "stretch"], typed("stretch long, line_no long, code int, before int, whole int")), "line-effects")
    wholes = lines.where("whole IS NOT NULL").select("file", "stretch", F.col("whole").alias("effect")).repartition("file").sortWithinPartitions("file", "stretch")
    # a file begins in state 0, so the state that a stretch begins in is what all before it make of 0
    firsts = _scanned(wholes, ["file"], typed("stretch long, before int")).select("file", "stretch", F.col("before").bitwiseAND(3).alias("first"))
    a, b = lines.alias("a"), firsts.alias("b")
    met = a.join(b, F.col("a.file").eqNullSafe(F.col("b.file")) & (F.col("a.stretch") == F.col("b.stretch")))
    state = F.expr("shiftright(a.before, 2 * b.first) & 3")
    return met.select(F.col("a.file").alias("file"), F.col("a.line_no").alias("line_no"), state.alias("state"), (F.expr("shiftright(a.code, shiftright(a.before, 2 * b.first) & 3) & 1") == 1).alias("is_code"))
