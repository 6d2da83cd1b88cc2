from __future__ import annotations

import math
import os
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyscope import __main__ as cli
from tallyscope.config import DEFAULTS, ArgumentError, Options, config_text, load_config, parse_arguments, parse_config, save_config
from tallyscope.functions import formatting, lexer
from tallyscope.languages import LanguageError, built_in, extension_owners, language_frame, load_languages, parse_language, save_languages, select_languages, serialize_language
from tallyscope.operators import history, lines, stats
from tallyscope.plans import report, scan
from tallyscope.sources.code_files import code_files, list_files, read_contents
from tallyscope.sources.globs import GlobError, IgnoreFile, exclude_regex
from tallyscope.sources.listing import ListOptions, TargetError, extension, list_target, resolve_targets, without_overlaps

LANGUAGES = built_in()


def tree(root, files: dict[str, str | bytes]) -> str:
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return str(root)


IGNORED = {".git/config": "x", ".gitignore": "*.py\nignored_dir/\n!keep.py\n", "a.py": "", "keep.py": "x\n", "b.rs": "x\n", "ignored_dir/c.rs": "x\n", "sub/.gitignore": "*.rs\n", "sub/d.rs": "x", "sub/e.py": "x"}


def counts(target: str, **options) -> tuple:
    found = list(list_target(target, ListOptions(frozenset({"py", "rs"}), **options)))
    return len(found), sum(e.status == "relevant" for e in found), sum(e.status == "excluded" for e in found), sorted(os.path.basename(e.path) for e in found if e.status == "relevant")


def test_ignore_files(tmp_path):
    top = tree(tmp_path, IGNORED)
    assert counts(top) == (7, 2, 3, ["b.rs", "keep.py"])
    assert counts(top, gitignore=False)[:3] == (8, 6, 0)
    assert counts(f"{top}/ignored_dir") == (1, 1, 0, ["c.rs"])
    assert counts(top, dotted=True)[0] == 8
    assert counts(top, exclude=exclude_regex(["sub", "b.rs"])) == (4, 1, 2, ["keep.py"])


def test_ignore_rules():
    f = IgnoreFile.parse("/r", "# note\n/top\nlogs/\na/b\n*.tmp\n!keep.tmp\nx/**\n\\#odd\n**/deep/c\n[z-a]\n")
    assert f.verdict("/r/top", False) and f.verdict("/r/sub/top", False) is None
    assert f.verdict("/r/s/logs", True) and f.verdict("/r/s/logs", False) is None
    assert f.verdict("/r/a/b", False) and f.verdict("/r/s/a/b", False) is None
    assert f.verdict("/r/q.tmp", False) and f.verdict("/r/s/keep.tmp", False) is False
    assert f.verdict("/r/x/y/z", False) and f.verdict("/r/x", True) is None
    assert f.verdict("/r/#odd", False) and f.verdict("/r/s/deep/c", False) and f.verdict("/r/deep/c", False)


def test_listing_through_spark(spark, tmp_path):
    top = tree(tmp_path, IGNORED | {"__init__.rs": "x", ".hidden.rs": "x", "note": "x"})
    os.symlink(f"{top}/b.rs", f"{top}/link.rs")
    os.symlink(top, f"{top}/loop")
    targets, options = [top, f"{top}/sub/e.py"], ListOptions(frozenset({"py", "rs"}))
    got, counts = list_files(spark, targets, options)
    assert tuple(stats.scan_summary(got).first()) == (11, 5, 3) == (counts["total"], counts["relevant"], counts["excluded"])
    assert sorted(map(tuple, code_files(spark, targets, options).collect())) == sorted(map(tuple, got.collect()))
    assert {os.path.basename(r.path) for r in got.where("status = 'relevant'").collect()} == {"b.rs", "keep.py", "__init__.rs", ".hidden.rs", "e.py"}


def test_extension():
    assert [extension(x) for x in ("a.py", ".py", "a", "a.b.PY", ".x.py", "a.", "d.py/a")] == ["py", None, None, "PY", "py", "", None]


def test_exclude_globs():
    import re

    def hit(pattern, path):
        return bool(re.match(exclude_regex([pattern]), path))

    assert hit("*.py", "/a/b.py") and hit("b", "/a/b") and hit("a/*.py", "/x/a/b.py") and not hit("a/*.py", "/x/a/c/b.py")
    assert hit("a/**/b", "/a/b") and hit("a/**/b", "/a/x/y/b") and hit("{x,y}.rs", "/d/y.rs") and hit("b\\", "/a/b") and hit("[!a].c", "/b.c") and not hit("b", "/a/bc")
    assert hit("**/t", "/q/t") and exclude_regex([]) is None
    for bad in ("[", "{a", "a}", "[z-a]", "{a,{b}}"):
        with pytest.raises(GlobError):
            exclude_regex([bad])


def test_overlaps(spark):
    paths = ["D:/a", "D:/a-b", "D:/a/b", "D:/ab", "D:/a", "D:/a_/x", "D:/a/b/c", "/x/"]
    want = ["/x/", "D:/a", "D:/a-b", "D:/a_/x", "D:/ab"]
    assert without_overlaps(paths) == want
    got = stats.without_overlaps(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r.path for r in got.collect()) == [p.rstrip("/") for p in want]


def test_targets(tmp_path, monkeypatch):
    top = tree(tmp_path, {".git/x": "", ".gitignore": "build/\n", "build/a.rs": "", "kept/a.rs": "", "kept/in/b.rs": "", ".dot/a.rs": ""})
    assert resolve_targets([f"{top}/*"]) == [f"{top}/kept"]
    assert resolve_targets([f"{top}/build", f"{top}/kept/in", f"{top}/kept"]) == [f"{top}/build", f"{top}/kept"]
    assert f"{top}/build" in resolve_targets([f"{top}/*"], gitignore=False)
    assert f"{top}/.dot" in resolve_targets([f"{top}/*"], dotted=True)
    for bad in ("nothing", f"{top}/q*", f"{top}/buil?", f"{top}/[z-a]"):
        with pytest.raises(TargetError):
            resolve_targets([bad])
    monkeypatch.chdir(tmp_path)
    assert resolve_targets(["kept"]) == [os.path.realpath(f"{top}/kept")]


def test_language_files(tmp_path):
    save_languages(LANGUAGES, tmp_path)
    assert load_languages(tmp_path) == (LANGUAGES, [])
    (tmp_path / "Broken.txt").write_text("Language\nX\nstray\n\nExtensions\nx\n")
    found, faulty = load_languages(tmp_path)
    assert len(found) == 30 and faulty == ["broken.txt"]
    for text in ("", "Language\nA\n\nExtensions\na\n\nString symbols\n\n\nComment symbols\n#\n", serialize_language(LANGUAGES["C"]).replace("structs", "")):
        with pytest.raises(LanguageError):
            parse_language(text)
    assert parse_language("L\nA\n\nE\na b\n\nS\n\n\nC\n#\n", strict=False).extensions == ("a", "b")
    with pytest.raises(LanguageError):
        load_languages(tmp_path / "none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_text("x")
    with pytest.raises(LanguageError):
        load_languages(tmp_path / "bad")


def test_language_selection(spark):
    kept, unknown = select_languages(LANGUAGES, ["java", "RUST", "nope"], ["rust"])
    assert list(kept) == ["Java"] and unknown == ["nope"]
    for include, exclude in ((["java"], ["JAVA"]), (["nope"], [])):
        with pytest.raises(LanguageError):
            select_languages(LANGUAGES, include, exclude)
    twice = LANGUAGES | {"Aaa": replace(LANGUAGES["Rust"], name="Aaa")}
    owners = {r.ext: r.language for r in extension_owners(language_frame(spark, twice)).collect()}
    assert owners["rs"] == "Aaa" and owners["htm"] == "HTML" and len(owners) == 35


def test_file_stats_and_faulty_files(spark, tmp_path):
    top = tree(tmp_path, {"a.java": "class A {\n}\n", "b.java": b"\xff\xfe", "c.py": "# x\nclass B\n", "d.txt": "x"})
    run = scan.scan(spark, [top], LANGUAGES, DEFAULTS)
    rows = {r.language: r for r in run.language_stats().collect()}
    assert {k: (r.files, r.lines, r.code_lines, r.bytes) for k, r in rows.items()} == {"Java": (1, 2, 1, 12), "Python": (1, 2, 1, 12)}
    assert [os.path.basename(r.path) for r in run.faulty().collect()] == ["b.java"]
    assert {(r.language, r.keyword): r.n for r in run.keyword_stats().collect()} == {("Java", "classes"): 1, ("Java", "interfaces"): 0, ("Python", "classes"): 1}
    total = run.totals().first()
    assert (total.files, total.lines, total.code_lines, total.average_bytes, total.size, total.size_unit) == (2, 4, 2, 12, 24.0, "Bytes")
    run.register("t_")
    assert spark.sql("SELECT sum(lines) FROM t_files").first()[0] == 4
    text, entry = scan.render(run, replace(DEFAULTS, show_faulty_files=True))
    assert "1 could not be read" in text and "no such language: nope" in report.summary({"total": 1, "relevant": 1, "excluded": 0}, 0, ("nope",))
    assert "Java" in text and "Overview" in text and "faulty: " in text and entry["lines"] == 4
    with pytest.raises(scan.NoFilesError):
        scan.scan(spark, [f"{top}/d.txt"], LANGUAGES, DEFAULTS)
    written = scan.scan(spark, [top], LANGUAGES, replace(DEFAULTS, no_keywords=True), str(tmp_path / "out"))
    assert written.totals().first().lines == 4


def test_contents_of_unreadable_files(spark):
    files = spark.createDataFrame([("/nowhere/a.py", "Python", 3)], "path string, language string, bytes long")
    row = read_contents(files).first()
    assert row.text is None and row.error


def test_strategies_agree(spark):
    text = 'int a; /* x\n "y" */ b\n"s\nin */ string\n" {\n\n};\n/* " */ c // d\n/*\n\n*/\n}\nclass Q {'
    rows = [("f", k, "Java", x) for k, x in enumerate(lexer.split_lines(text))] + [("g", k, "Python", x) for k, x in enumerate(["'a", "b", "c' # x", "#", "{", "x"])] + [("h", 0, "Nope", "x")]
    frame = spark.createDataFrame(rows, "file string, line_no int, language string, line string")
    for stretch in (1, 3, 100):
        got = {(r.file, r.line_no): (r.state, r.is_code) for r in lines.line_states(lines.line_outcomes(frame, LANGUAGES), stretch).collect()}
        for name, language in (("f", "Java"), ("g", "Python")):
            state = lexer.CODE
            for _, k, _, raw in (r for r in rows if r[0] == name):
                line = raw.strip(lexer.WHITE)
                facts = lexer.line_facts(line, LANGUAGES[language], state) if line else None
                assert got[name, k] == (state, bool(facts and lexer.is_code(facts))), (name, k, stretch)
                state = facts.state if facts else state
        assert len(got) == len(rows) - 1


def test_report_maths():
    assert report.fit_slots([18, 15, 19, 1]) == [16, 15, 18, 1]
    assert report.bar_slots([33.33, 33.33, 33.34]) == [16, 17, 17]
    assert sum(report.bar_slots([0.01, 0.0, 50.0, 49.99])) == 50 and report.bar_slots([100.0]) == [50]
    shares = [[a / 2, b / 2, c / 2, 100 - (a + b + c) / 2] for a in range(0, 100, 7) for b in range(0, 200 - a, 9) for c in range(0, 200 - a - b, 11)]
    assert all(sum(max(1, int(formatting.round_half_away(p / 2))) if p else 0 for p in s) >= report.SLOTS - 1 and sum(report.bar_slots(s)) == report.SLOTS for s in shares)
    assert report.percentages([20, 20, 20]) == [33.33, 33.33, 33.34]
    assert report.percentages([100, 100, 100, 0]) == [33.33, 33.33, 33.33, 0.01]
    assert report.percentages([201, 200, 200, 0]) == [33.44, 33.28, 33.28, 0.0]
    assert report.total_size(1000) == (1.0, "KBs") and report.detail_size(1000, "total") == "1000.0 Bytes total"
    assert report.total_size(2417403) == (2.4, "MBs") and report.total_size(49334) == (49.3, "KBs")


def test_columns_of_any_name(spark):
    rows = [("Java", "class A {\n}\n", 1, 2, 3, 4), ("Nope", "x", 1, 2, 3, 4), (None, None, None, None, None, None), ("Java", "", 1, 2, 3, 4)]
    files = spark.createDataFrame(rows, "language string, text string, `_language` int, `a.b` int, `_text` int, `Text 2` int")
    got = lines.file_stats(files, LANGUAGES, keep=["language", "_language", "a.b", "_text", "Text 2"]).collect()
    assert sorted((str(r.language), r["a.b"], r.lines, r.code_lines) for r in got) == [("Java", 2, 0, 0), ("Java", 2, 2, 1), ("None", None, None, None), ("Nope", 2, None, None)]
    with pytest.raises(ValueError):
        lines.file_stats(files.withColumn("Lines", F.lit(1)), LANGUAGES, keep=["Lines"])
    shares = spark.createDataFrame([(1, 3, "x", "y"), (2, 1, "x", "y")], "rank int, files long, _share string, _before string")
    assert [(r.files_pct, r._share) for r in stats.percentages(shares, "files").orderBy("rank").collect()] == [(75.0, "x"), (25.0, "x")]
    none = lines.file_stats(files.limit(0), LANGUAGES, keep=["a.b"])
    assert none.count() == 0 and none.columns == ["a.b", "lines", "code_lines", "counts"]


def test_derived_tables(spark):
    rows = [("py", 5, 500, 1000, 10), ("java", 4, 400, 900, 5), ("cs", 3, 300, 800, 5), ("rs", 2, 200, 700, 5), ("go", 1, 100, 600, 5)]
    table = spark.createDataFrame(rows, "language string, files long, bytes long, lines long, code_lines long").withColumn("extra_lines", F.col("lines") - F.col("code_lines"))
    top = {r.language: r for r in stats.percentages(stats.top_and_others(table), "files", "lines").collect()}
    assert list(top) == ["py", "java", "cs", "others"] and (top["others"].files, top["others"].bytes, top["others"].lines) == (3, 300, 1300)
    assert top["py"].files_pct == 33.33 and top["others"].files_pct == 20.0
    small = stats.top_and_others(table.limit(3))
    assert "others" not in {r.language for r in small.collect()}
    assert stats.with_total(table).where("language = 'Total'").first().lines == 4000
    assert stats.totals(table.limit(0)).first().average_bytes == 0
    values = spark.sql("SELECT * FROM VALUES (1.005D), (0.285D), (2.5D) AS t(x)").select(stats.round_to(F.col("x"), 2)).collect()
    assert [r[0] for r in values] == [1.0, 0.28, 2.5]


def test_history(spark, tmp_path):
    now = datetime(2024, 5, 2, 3, 4, 5, tzinfo=timezone.utc)
    entries = [{"name": n, "ts": now - timedelta(minutes=m), "files": f, "lines": 22819, "code_lines": 10, "extra_lines": 5, "bytes": 100, "average_bytes": 10} for n, m, f in (("one", 1501, 10), (None, 3000, 20))]
    text = "".join(history.entry_text(e, {"dirs": ["./"]}) for e in entries)
    got = history.parse_log(spark.createDataFrame([(text.replace("+0000", "+00:00", 1),)], "content string")).orderBy("place").collect()
    assert [(r.name, r.files, r.average_bytes) for r in got] == [("one", 10, 10), (None, 20, 10)] and got[0].ts is not None and got[1].ts is not None
    current = spark.createDataFrame([(20, 22820, 5, 5)], "files long, lines long, code_lines long, extra_lines long")
    frame = spark.createDataFrame([(*(e[c] for c in ("name", "ts", "files", "lines", "code_lines", "extra_lines", "bytes", "average_bytes")),) for e in entries], history.SCHEMA)
    row = history.compare(frame, current, 1, F.lit(now)).first()
    assert (row.days, row.hours, row.minutes, row.files_pct, row.lines_pct, row.code_lines_pct, row.extra_lines_pct) == (1, 1, 1, 100.0, 0.01, -50.0, 0.0)
    assert history.signed_percentage_text(22819, 22820) == "+ <0.01" and history.signed_percentage_text(4, 2) == "-50" and history.signed_percentage_text(3, 3) == "0"
    assert "1 days, 1 hours and 1 minutes ago" in report.progress(entries[:1], entries[0], now)
    history.append_entry(spark, str(tmp_path / "log"), entries[0])
    history.append_entry(spark, str(tmp_path / "log"), entries[1])
    assert [r.name for r in history.latest(spark.read.parquet(str(tmp_path / "log")), 1).collect()] == ["one"] == [r.name for r in history.read_runs(spark, str(tmp_path / "log"), 1).collect()]


def test_formatting():
    assert formatting.with_separators(1234567) == "1,234,567" and formatting.n_separators(999) == 0 and formatting.n_separators(1000) == 1
    assert formatting.parse_languages(" .RS, py ,,") == ["rs", "py"]
    assert formatting.parse_paths('"a\\b", c" ,"d , ') == ["a/b", "c", '"d']
    assert formatting.parse_number(" 5 ", 0, 10) == 5 and formatting.parse_number("11", 0, 10) is None and formatting.parse_number("x", 0, 1) is None
    assert formatting.parse_two_numbers("2 30", (1, 8), (1, 30)) == (2, 30) and formatting.parse_two_numbers("2", (1, 8), (1, 30)) is None
    assert formatting.parse_colors("Red bright_blue #A0b1C2") == ["red", "bright-blue", "a0b1c2"] and formatting.parse_colors("") is None and formatting.parse_colors("redd") is None
    assert formatting.load_palette("OCEAN") == ["22d3ee", "60a5fa", "34d399", "94a3b8"] and formatting.load_palette("none") is None
    assert math.isclose(formatting.round_half_away(-2.5), -3.0)


def test_configurations(tmp_path):
    folder = str(tmp_path / "config")
    src = tree(tmp_path / "src", {"a.py": ""})
    options = Options(dirs=[src], exclude=["a", "b.c"], threads=(1, 2), braces_as_code=True, colors=["red", "0a0b0c"], log="x", compare=3)
    found, invalid = parse_config(config_text(options))
    assert not invalid and found == replace(options, log=None)
    save_config(folder, "mine", options)
    assert load_config(folder, "mine").threads == (1, 2)
    text = "===> dirs\na,\nb\nc,d\n\n===> braces-as-code\nmaybe\n===> threads\n0 1\n===> compare \n1\n===> log\nNightly\n===> no-visual\n\n"
    found, invalid = parse_config(text)
    assert found.dirs == ["a", "b", "c", "d"] and found.log == "nightly" and found.compare == 1 and found.no_visual is None and invalid == ["braces-as-code", "threads"]
    got = parse_arguments(f"{src} --load mine --compare 5 --languages .PY", folder)
    assert got.compare == 5 and got.braces_as_code and got.languages == ["py"] and got.no_visual is False
    with open(os.path.join(folder, "default.txt"), "w") as f:
        f.write("===> compare\n7\n\n===> no-visual\nyes\n")
    got = parse_arguments(f"--dirs {src} --save other", folder)
    assert got.compare == 7 and got.no_visual and load_config(folder, "other").compare is None
    with open(os.path.join(folder, "gone.txt"), "w") as f:
        f.write("===> dirs\n/no/such/path\n")
    tree(tmp_path / "src", {".hidden.py": ""})
    for line, kind in (
        (f"{src} --dirs {src}", "DoublePath"), (f"{src} --nope", "UnrecognisedCommand"), (f"{src} --threads 9 1", "IncorrectCommandArgs"), (f"{src} --load none", "NonExistentConfig"),
        ("/no/such/path", "InvalidPath"), (f"{src} --exclude [", "IncorrectCommandArgs"), (f"{src} --braces-as-code yes", "UnexpectedCommandArgs"), (" ", "NoArgsProvided"),
        (f"{src}/q*", "NoGlobMatches"), (f"{src}/[z-a]", "InvalidGlobPattern"), ("--load gone", "InvalidPathInConfig"), (f"{src}/.hid*", "AllGlobMatchesIgnored"), (f"{src} --color-palette none", "UnknownPalette"), ("--dirs ", "IncorrectCommandArgs"),
    ):
        with pytest.raises(ArgumentError) as e:
            parse_arguments(line, folder)
        assert e.value.kind == kind, line
    with open(os.path.join(folder, "bad.txt"), "w") as f:
        f.write("===> compare\n70\n")
    with pytest.raises(ArgumentError):
        parse_arguments(f"{src} --load bad", folder)
    assert parse_arguments(f"{src} --load bad --compare 2", folder).compare == 2


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TALLYSCOPE_HOME", str(tmp_path / "home"))
    src = tree(tmp_path / "src", {"a.py": "x\n", "b.rs": "fn a() {\n}\n"})
    assert cli.main([src, "--save", "run", "--log", "first", "--no-visual"]) == 0
    out = capsys.readouterr().out
    assert "Total" in out and "2 files: 2 of a known language, 0 excluded" in out
    assert cli.load_languages(str(tmp_path / "home" / "languages")) == (LANGUAGES, []) and (tmp_path / "home" / "config" / "default.txt").is_file()
    assert cli.main(["--load", "run", "--log", "second"]) == 0
    out = capsys.readouterr().out
    assert "Progress" in out and '"first"' in out
    log = (tmp_path / "home" / "logs" / "run.txt").read_text()
    assert log.index("second") < log.index("first")
    assert cli.main(["--show-languages"]) == 0 and "Haskell" in capsys.readouterr().out
    assert cli.main(["--show-configs"]) == 0 and "run" in capsys.readouterr().out
    assert cli.main(["--show-palettes"]) == 0 and "Ocean" in capsys.readouterr().out
    assert cli.main(["--changelog"]) == 0 and cli.main(["--help"]) == 0
    assert cli.main(["/no/such/path"]) == 1
