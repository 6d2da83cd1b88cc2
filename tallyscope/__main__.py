"""``python -m tallyscope PATHS [--option value]...``: count the code below some paths."""

from __future__ import annotations

import os
import sys
from dataclasses import replace

from .config import DEFAULT_NAME, DEFAULTS, MESSAGES, ArgumentError, config_path, config_text, parse_arguments
from .functions.formatting import PALETTES
from .languages import LanguageError, built_in, load_languages, save_languages

HELP = """Count lines, code lines and keywords of source files.

python -m tallyscope [PATHS] [OPTIONS]       PATHS: folders, files or globs, between commas

--dirs PATHS                 targets, if none stand in front
--exclude GLOBS              files and folders to leave out
--languages NAMES            only these
--exclude-languages NAMES    all but these
--threads N N                accepted for old configurations; Spark plans its own tasks
--braces-as-code             lines of braces alone are code
--search-in-dotted           enter hidden folders
--show-faulty-files          list files that can't be read
--no-keywords                don't count keywords
--no-visual                  no bars and colours
--no-gitignore               count ignored files as well
--colors C1 ... C5           colours of the overview
--color-palette NAME         the same, by name
--log [NAME]                 add the run to the configuration's log
--compare N                  compare with N earlier runs (0 to 10)
--save NAME, --load NAME     keep or use a configuration
--show-languages, --show-configs, --show-palettes, --changelog, --help
"""


def message(which: str, home: str, languages) -> str:
    if which == "show-languages":
        return "\n".join(sorted(languages))
    if which == "show-configs":
        folder = os.path.join(home, "config")
        return "\n".join(sorted(os.path.splitext(x)[0] for x in os.listdir(folder))) if os.path.isdir(folder) else ""
    if which == "show-palettes":
        folder = os.path.join(home, "palettes")
        own = [os.path.splitext(x)[0] for x in os.listdir(folder)] if os.path.isdir(folder) else []
        return "\n".join(sorted({*PALETTES, *own}, key=str.lower))
    if which == "changelog":
        from . import __version__

        return f"version {__version__}"
    return HELP


def furnish(home: str) -> None:
    """Put the built-in languages and palettes and a default configuration in a new data folder, for the user to edit."""
    if not os.path.isdir(os.path.join(home, "languages")):
        save_languages(built_in(), os.path.join(home, "languages"))
    palettes = os.path.join(home, "palettes")
    if not os.path.isdir(palettes):
        os.makedirs(palettes)
        for name, colors in PALETTES.items():
            with open(os.path.join(palettes, f"{name}.txt"), "w", encoding="utf-8") as f:
                f.write(f"{colors}\n")
    default = config_path(os.path.join(home, "config"), DEFAULT_NAME)
    if not os.path.isfile(default):
        os.makedirs(os.path.dirname(default), exist_ok=True)
        with open(default, "w", encoding="utf-8") as f:
            f.write(config_text(replace(DEFAULTS, colors=None)))


def main(args: list[str] | None = None) -> int:
    line = " ".join(sys.argv[1:] if args is None else args) or "./"
    home = os.environ.get("TALLYSCOPE_HOME", os.path.expanduser("~/.tallyscope"))
    try:
        furnish(home)
        languages, faulty = load_languages(os.path.join(home, "languages"))
        if faulty:
            print(f"unusable language files: {', '.join(faulty)}", file=sys.stderr)
        for which in MESSAGES:
            if f"--{which}" in line:
                print(message(which, home, languages))
                return 0
        options = parse_arguments(line, os.path.join(home, "config"), os.path.join(home, "palettes"))
        from pyspark.sql import SparkSession

        from .plans import scan

        spark = SparkSession.builder.appName("tallyscope").getOrCreate()
        name = options.save or options.load
        log = os.path.join(home, "logs", f"{name}.txt") if name else None
        older = scan.read_log(spark, log, options.compare) if log and options.compare else None
        run = scan.scan(spark, options.dirs, languages, options)
        text, entry = scan.render(run, options, older)
        print(text)
        if options.log is not None and log:
            scan.write_log(spark, log, entry, options)
    except (ArgumentError, LanguageError, OSError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
