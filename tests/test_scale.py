"""Huge files by ranges, listings by rounds, conditions in the walk, and a log that several runs write."""

from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.config import DEFAULTS
from tallyscope.functions import lexer
from tallyscope.languages import built_in
from tallyscope.operators import history, lines
from tallyscope.plans import scan
from tallyscope.sources import listing
from tallyscope.sources.code_files import PushdownReader, code_files, decode, list_files, read_contents, read_range
from tallyscope.sources.globs import IgnoreFile, IgnoreStack, Segments
from tallyscope.sources.listing import ListOptions, list_target

LANGUAGES = built_in()
PIECES = ['"', "'", "/*", "*/", "//", "#", "\\", " ", "a", "class", "{", "}", "\n", "\n", "\r\n", "é", "日本", "🙂", "\n\n", "record "]


def random_text(rng: random.Random, n: int) -> str:
    return "".join(rng.choices(PIECES, k=n))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_ranges_hold_each_line_once(tmp_path, size):
    rng, path = random.Random(size), tmp_path / "f"
    for text in ("", "\n", "\n\n", "a", "a\r\n", "no end", "x" * 200, *(random_text(rng, rng.randrange(60)) for _ in range(60))):
        data = text.encode()
        path.write_bytes(data)
        starts = list(range(0, max(1, len(data)), size))
        found = [read_range(str(path), a, a + size if a + size < len(data) else None, block=3) for a in starts]
        assert b"".join(x for _, x in found) == data
        assert all(data[at : at + len(x)] == x and (not x or at == 0 or data[at - 1 : at] == b"\n") for at, x in found)
        assert all(x.decode() is not None for _, x in found)


def test_decoding_errors_name_the_place_in_the_file(tmp_path):
    for bad in (b"\xff", b"\xe2\x82", b"\xe2\x28\xa1", b"\xf0\x9f\x98"):
        data = b"ok\n\xc3\xa9\n" + bad + b"\nrest\n"
        with pytest.raises(UnicodeDecodeError) as want:
            data.decode()
        with pytest.raises(ValueError) as got:
            decode(data[6:], 6)
        assert str(got.value) == str(want.value)


def test_huge_files_are_counted_as_whole_ones(spark, tmp_path):
    """The same rows, whatever the ranges: cuts inside strings, comments, CR LF and characters, long lines, faulty files."""
    rng, src = random.Random(5), tmp_path / "src"
    src.mkdir()
    for k, ext in enumerate(["java", "py", "php", "hs", "js", "html", "sql", "rs"] * 3):
        (src / f"f{k}.{ext}").write_bytes(random_text(rng, rng.choice([0, 30, 400])).encode())
    (src / "long.py").write_text("x = '" + "y" * 5000 + "\nz = 1'\n" + "class A\n" * 50)
    (src / "bad.java").write_bytes(b"class A {\n" * 40 + b"\xff\n" + b"}\n" * 40)
    (src / "cut.java").write_bytes(b"class A {\n" * 40 + "é".encode()[:1])

    def rows(folder, size):
        run = scan.scan(spark, [str(src)], LANGUAGES, DEFAULTS, str(tmp_path / folder), size)
        found = {(os.path.basename(r.path), r.language, r.bytes, r.error, r.lines, r.code_lines, tuple(r.counts or ())) for r in run.files.collect()}
        return found, run

    whole, run = rows("whole", 1 << 20)
    assert run.listed["large"] == 0 and run.counted["faulty"] == 2 and len(whole) == 27
    for size in (16, 333):
        cut, run = rows(f"cut{size}", size)
        assert cut == whole and run.listed["large"] > 10
    total = run.totals().first()
    assert {c: total[c] for c in ("files", "lines", "code_lines", "extra_lines", "bytes", "average_bytes")} == {k: v for k, v in run.counted.items() if k != "faulty"}
    text, _ = scan.render(run, DEFAULTS)
    assert "2 could not be read" in text


def test_a_task_holds_one_text_at_a_time(spark, tmp_path):
    """Files read and counted within a task: the rows of contents counted as a table, without texts on their way between processes."""
    rng, rows = random.Random(8), [("/nowhere/a.py", "Python", 3), (str(tmp_path), "Java", 0)]
    for k, name in enumerate(["Java", "Python", "Nope"] * 13):
        path = tmp_path / f"f{k}"
        path.write_bytes(b"\xff" if k % 13 == 5 else random_text(rng, rng.choice([0, 30, 400])).encode())
        rows.append((str(path), name, path.stat().st_size))
    files = spark.createDataFrame(rows, "path string, language string, bytes long").repartition(3)
    want = lines.file_stats(read_contents(files), LANGUAGES, keep=["path", "language", "bytes", "error"])
    counted = scan.count_files(files, {"bytes": 1, "large": 0, "large_bytes": 0}, LANGUAGES, DEFAULTS)
    assert counted.columns == want.columns and sorted(map(repr, counted.collect())) == sorted(map(repr, want.collect()))
    assert lines.path_stats(files.limit(0), LANGUAGES).count() == 0
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_many_tasks_read_one_file(spark, tmp_path):
    path = tmp_path / "one.java"
    path.write_text("/* x\n" + "int a = 1; // class\nclass B {\n}\n" * 40_000 + "*/ class C\n")
    files = spark.createDataFrame([(str(path), "Java", path.stat().st_size)], "path string, language string, bytes long")
    ranges = scan.file_ranges(files, 1 << 17)
    assert ranges.count() == 10
    counted = lines.range_stats(ranges.repartition(10, "start"), LANGUAGES)
    assert counted.first().lines == 120_002 and counted.first().code_lines == 1 and list(counted.first().counts) == [1, 0]
    assert lines.range_stats(ranges.limit(0), LANGUAGES).count() == 0


def test_prefix_scan_goes_on_across_batches(spark):
    rng, rows, want = random.Random(2), [], {}
    for file, language in (("a", "Java"), ("b", "Python"), (None, "PHP"), ("c", "Java")):
        state = lexer.CODE
        for k in range(300 if file != "c" else 1):
            raw = "".join(rng.choices(['"', "'", "/*", "*/", "//", "#", " ", "a", "{"], k=rng.randrange(4)))
            rows.append((file, k, language, raw))
            line = raw.strip(lexer.WHITE)
            facts = lexer.line_facts(line, LANGUAGES[language], state) if line else None
            want[file, k] = (state, bool(facts and lexer.is_code(facts)))
            state = facts.state if facts else state
    rng.shuffle(rows)
    frame = spark.createDataFrame([*rows, ("d", 0, "Java", None)], "file string, line_no int, language string, line string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for stretch in (1, 5, 64, 4096):
            got = {(r.file, r.line_no): (r.state, r.is_code) for r in lines.line_states(lines.line_outcomes(frame, LANGUAGES), stretch).collect()}
            assert got == want | {("d", 0): (0, False)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert lines.line_states(lines.line_outcomes(frame.limit(0), LANGUAGES)).count() == 0


def test_composed_effects():
    table = lines.composed()
    for f, g in np.random.default_rng(0).integers(0, 256, (500, 2)).tolist():
        assert table[f, g] == lines.effect_byte([g >> 2 * (f >> 2 * s & 3) & 3 for s in range(4)])


def deep_tree(top) -> None:
    """One first-level folder, with a wide and a deep part, ignore files on the way, and links back."""
    rng = random.Random(4)
    for a in range(6):
        for b in range(5):
            folder = top / "repo" / f"a{a}" / f"b{b}"
            folder.mkdir(parents=True)
            for name in ("x.py", "y.rs", ".hidden.py", "note", "gen.py", "keep.log"):
                (folder / name).write_text("x" * rng.randrange(9))
    (top / "repo" / ".git").mkdir()
    (top / "repo" / ".gitignore").write_text("gen.py\n/a1\n**/b2/*.rs\n!a3/**/gen.py\n")
    (top / "repo" / "a3" / ".gitignore").write_text("*.py\n!x.py\n")
    (top / "repo" / ".dots").mkdir()
    (top / "repo" / ".dots" / "z.py").write_text("z")
    (top / "repo" / "a5" / "loop").symlink_to(top / "repo")
    (top / "repo" / "a4" / "again").symlink_to(top / "repo" / "a2")
    deep = top / "repo" / "deep"
    for k in range(30):
        deep = deep / f"d{k}"
        deep.mkdir(parents=True)
        (deep / "v.py").write_text("v")


@pytest.mark.parametrize("options", [{}, {"gitignore": False}, {"dotted": True, "exclude": r"^(?:.*/)?a0$"}])
def test_listing_by_rounds(spark, tmp_path, options):
    deep_tree(tmp_path)
    given = ListOptions(frozenset({"py", "rs"}), **options)
    want = sorted((e.path, e.ext, e.bytes, e.status) for e in list_target(str(tmp_path), given))
    for first, later in ((1, 1), (1, 4), (16, 2000)):
        got, counts = list_files(spark, [str(tmp_path)], given, str(tmp_path.parent / f"out-{first}-{later}-{len(options)}"), 5, first, later)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
        assert counts["total"] == len(want) and counts["excluded"] == sum(w[3] == "excluded" for w in want) and counts["bytes"] == sum(w[2] for w in want)
        assert counts["large"] == sum(w[2] > 5 for w in want)
    if not options:  # all below one first-level folder, and yet many tasks found files
        spread, _ = list_files(spark, [str(tmp_path)], given, str(tmp_path.parent / "spread"), 5, 2, 2)
        assert spread.select(F.input_file_name()).distinct().count() > 8


def test_a_wide_folder_is_never_held(spark, tmp_path, monkeypatch):
    """Entries and folders left to others come one by one, whatever a folder's width; the same rows as before."""
    wide, taken = tmp_path / "wide", []
    for k in range(300):
        (wide / f"d{k}").mkdir(parents=True)
        (wide / f"f{k}.py").write_text("x" * (k % 7))

    class Counted:
        def __init__(self, path):
            self.found = scandir(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.found.close()

        def __iter__(self):
            return self

        def __next__(self):
            e = next(self.found)
            taken.append(e.name)
            return e

    given, scandir = ListOptions(frozenset({"py"})), os.scandir
    monkeypatch.setattr(listing.os, "scandir", Counted)
    walked, seen = listing.visit(str(wide), given, IgnoreStack(), budget=3), []
    for n in range(1, 401):
        seen.append(next(walked))
        assert len(taken) <= n + 2  # what it came to is handed on, but for the folders that it opens itself
    seen += walked
    monkeypatch.undo()
    ahead = {x.path for x in seen if isinstance(x, listing.Ahead)}
    files = sorted((x.path, x.bytes) for x in seen if not isinstance(x, listing.Ahead))
    assert len(ahead) == 298 and files == sorted((f"{wide}/f{k}.py", k % 7) for k in range(300))
    got, counts = list_files(spark, [str(tmp_path)], given, str(tmp_path.parent / "wide-out"), 5, 1, 3)
    assert sorted((r.path, r.bytes) for r in got.collect()) == files and counts["total"] == 300


def test_stack_from_its_folders(tmp_path):
    deep_tree(tmp_path)
    stack = IgnoreStack.for_target(str(tmp_path / "repo" / "a3" / "b1"))
    again = IgnoreStack.of_folders(stack.folders)
    for name in ("x.py", "gen.py", "y.rs"):
        assert again.ignores(f"{tmp_path}/repo/a3/b1/{name}", False) == stack.ignores(f"{tmp_path}/repo/a3/b1/{name}", False)


def test_conditions_are_part_of_the_walk(spark, tmp_path, monkeypatch):
    deep_tree(tmp_path)
    given = ListOptions(frozenset({"py", "rs"}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        under = f"{tmp_path}/repo/a2/"
        files = code_files(spark, [str(tmp_path)], given)
        for asked, test in (
            (F.col("ext") == "rs", lambda e: e.ext == "rs"), (F.col("status").isin("excluded", "other"), lambda e: e.status != "relevant"), (F.col("path").startswith(under), lambda e: e.path.startswith(under)),
            ((F.col("path") == f"{under}b1/x.py") & (F.col("ext") == "py"), lambda e: e.path == f"{under}b1/x.py"), (F.col("path").startswith("/nowhere"), lambda e: False), (F.col("bytes") > 3, lambda e: e.bytes > 3),
        ):
            want = sorted(e.path for e in list_target(str(tmp_path), given) if test(e))
            assert sorted(r.path for r in files.where(asked).collect()) == want
        plan = files.where(F.col("path").startswith(under) & (F.col("ext") == "rs"))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan or "Filter (" not in plan.replace("Filter (isnotnull", "")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    opened = []
    scandir = os.scandir
    monkeypatch.setattr(listing.os, "scandir", lambda at: opened.append(at) or scandir(at))
    reader = PushdownReader({"targets": f'["{tmp_path}"]', "extensions": '["py", "rs"]'})
    assert list(reader.pushFilters([StringStartsWith(("path",), under), EqualTo(("ext",), "rs"), EqualTo(("bytes",), 3)])) == [EqualTo(("bytes",), 3)]
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert len(rows) == 5 and {os.path.relpath(at, tmp_path) for at in opened} == {".", "repo", "repo/a2", *(f"repo/a2/b{k}" for k in range(5))}


def test_a_log_for_several_writers(spark, tmp_path):
    path, now = str(tmp_path / "logs" / "mine.txt"), datetime(2024, 5, 2, 3, 4, 5, tzinfo=timezone.utc)
    entry = lambda k: {"name": f"run {k}", "ts": now + timedelta(minutes=k), "files": k, "lines": 2, "code_lines": 1, "extra_lines": 1, "bytes": 9, "average_bytes": 9}
    assert scan.read_log(spark, path, 3) is None
    os.makedirs(tmp_path / "logs")
    with open(path, "w") as f:
        f.write("".join(history.entry_text(entry(k), {}) for k in (-1, -2)))
    assert [r.name for r in scan.read_log(spark, path, 1).collect()] == ["run -1"]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: scan.write_log(spark, path, entry(k), DEFAULTS), range(6)))
    assert [r.name for r in scan.read_log(spark, path, 3).collect()] == ["run 5", "run 4", "run 3"]
    assert {r.name for r in history.read_runs(spark, history.table_of(path)).collect()} == {f"run {k}" for k in range(-2, 6)}
    assert len(history.read_runs(spark, history.table_of(path), 2).inputFiles()) == 2
    scan.write_log(spark, path, entry(9), DEFAULTS)
    with open(path) as f:
        found = history.parse_log(spark.createDataFrame([(f.read(),)], "content string")).orderBy("place").collect()
    assert [r.name for r in found] == [f"run {k}" for k in (9, 5, 4, 3, 2, 1, 0, -1, -2)]
    os.makedirs(f"{history.table_of(path)}/_writing-other")  # a writer that died leaves no run
    assert len(history.runs(spark, history.table_of(path))) == 8


def rule_by_rule(ignore: IgnoreFile, path: str, is_dir: bool) -> bool | None:
    below = path[len(ignore.folder) + 1 :]
    return next((not keep for regex, keep, only_dirs in reversed(ignore.rules) if (is_dir or not only_dirs) and regex.fullmatch(below)), None)


def test_rules_by_names_decide_as_rule_by_rule():
    rng = random.Random(8)
    names = ["a", "b", "ab", "a.py", "b.py", ".x", "**", "*", "*.py", "a*", "?", "[ab]", "*b*", "a**", "\\*", "[!a]b", "**b"]
    paths = ["/r/" + "/".join(rng.choices(["a", "b", "ab", "a.py", "b.py", ".x", "aab", "*", "c"], k=rng.randint(1, 4))) for _ in range(200)]
    seen = set()
    for _ in range(300):
        rules = [rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + "/".join(rng.choices(names, k=rng.randint(1, 3))) + rng.choice(["", "", "/"]) for _ in range(rng.randint(1, 6))]
        ignore = IgnoreFile.parse("/r", "\n".join(rules))
        for path in rng.sample(paths, 25):
            for is_dir in (False, True):
                want = rule_by_rule(ignore, path, is_dir)
                seen.add(want)
                assert ignore.verdict(path, is_dir) == want, (rules, path, is_dir)
    assert seen == {True, False, None}


def test_rules_that_cannot_match_cost_nothing():
    many = IgnoreFile.parse("/r", "\n".join(f"name{k}\n/top{k}/x\n*.ext{k}\npre{k}*" for k in range(5000)) + "\nwanted\n")
    looked_at = []
    step = Segments.step
    try:
        Segments.step = lambda self, name, out: looked_at.append((len(self.others), len(self.ends_with), len(self.starts_with))) or step(self, name, out)
        assert many.verdict("/r/some/deep/wanted", False) and many.verdict("/r/some/deep/other", False) is None
    finally:
        Segments.step = step
    assert len(looked_at) <= 16 and max(map(max, looked_at)) <= 4 and not many.odd
