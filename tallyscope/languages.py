"""The language dimension: definitions, their files, and the DataFrame."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, extensions array<string>, string_symbols array<string>, comment_symbols array<string>, ml_start string, ml_end string, keywords array<struct<name: string, aliases: array<string>>>"


@dataclass(frozen=True)
class Keyword:
    name: str
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    string_symbols: tuple[str, ...]
    comment_symbols: tuple[str, ...]
    block_start: str | None = None
    block_end: str | None = None
    keywords: tuple[Keyword, ...] = ()

    @property
    def strings(self) -> tuple[str, ...]:
        """The string symbols in use: two if there are two, else the first."""
        return self.string_symbols if len(self.string_symbols) == 2 else self.string_symbols[:1]


# Name | extensions | string symbols | line comments | block start and end | keyword=aliases; ...
BUILT_IN = """
C | c | " | // | /* */ | structs=struct
C Header | h | " | // | /* */ | structs=struct
C++ | cpp | " | // | /* */ | classes=class; structs=struct
C++ Header | hpp | " | // | /* */ | classes=class; structs=struct
C# | cs | " | // | /* */ | classes=class; structs=struct; interfaces=interface
CSS | css | " ' | // | /* */ |
Dart | dart | " ' | // | /* */ | classes=class; enums=enum
Elixir | ex exs | " | # | | modules=defmodule; functions=def defp
GO | go | " | // | /* */ | structs=struct
Haskell | hs | " | -- | {- -} | data types=data; classes=class
HTML | html htm | " ' | &none/ | <!-- --> |
JAI | jai | " | // | /* */ | structs=struct
Java | java | " | // | /* */ | classes=class record; interfaces=interface
JS | js | " ' | // | /* */ | classes=class
Kotlin | kt kts | " | // | /* */ | classes=class; interfaces=interface
Odin | odin | ",',` | // | /* */ | structs=struct; enums=enum; unions=union
PHP | php | " ' | // # | /* */ | classes=class
Python | py | " ' | # | | classes=class
R | r | " | # | |
Ruby | rb | " ' | # | =begin =end | classes=class; modules=module
Rust | rs | " | // | /* */ | structs=struct; enums=enum; traits=trait
SCSS | scss sass | " ' | // | /* */ |
SQL | sql | ' " | -- | /* */ | tables=TABLE table; views=VIEW view
Scala | scala | " | // | /* */ | classes=class; objects=object; traits=trait
Shell | sh bash | " ' | # | | functions=function
Swift | swift | " | // | /* */ | classes=class; structs=struct
TS | ts | " ' | // | /* */ | classes=class; enums=enum
TSX | tsx | " ' | // | /* */ | classes=class; interfaces=interface; enums=enum
Vue | vue | " ' | // | /* */ | classes=class; interfaces=interface
Zig | zig | " | // | | structs=struct; enums=enum
"""


def built_in() -> dict[str, Language]:
    out = {}
    for row in BUILT_IN.strip().splitlines():
        name, extensions, strings, comments, block, words = (x.strip() for x in row.split("|"))
        start, end = block.split() if block else (None, None)
        keywords = [w.split("=") for w in words.split(";") if w.strip()]
        out[name] = Language(name, tuple(extensions.split()), tuple(strings.split()), tuple(comments.split()), start, end, tuple(Keyword(k.strip(), tuple(v.split())) for k, v in keywords))
    return out


class LanguageError(ValueError):
    """A definition file or folder that can't be used."""


class _Reader:
    def __init__(self, text: str):
        self.lines, self.at = text.splitlines(), 0

    def next(self) -> str:
        if self.at >= len(self.lines):
            raise LanguageError("the file ends too early")
        self.at += 1
        return self.lines[self.at - 1]

    def heading(self, text: str, strict: bool) -> None:
        if self.next().rstrip() != text and strict:
            raise LanguageError(f"line {self.at}: {text!r} expected")

    def values(self) -> tuple[str, ...]:
        return tuple(self.next().split())


def parse_language(text: str, strict: bool = True) -> Language:
    """A definition from its file's text. Strict: every heading must be in place and no list of string symbols or aliases empty."""
    r = _Reader(text)

    def required(found):
        if not found and strict:
            raise LanguageError(f"line {r.at}: a value expected")
        return found

    r.heading("Language", strict)
    name = r.next().strip()
    r.next()
    r.heading("Extensions", strict)
    extensions = r.values()
    r.next()
    r.heading("String symbols", strict)
    strings = required(r.values())
    r.next()
    r.heading("Comment symbols", strict)
    comments = r.values()
    start = end = None
    if r.at < len(r.lines):
        # one line follows the comments: the block's heading, or a line of any text
        if r.next().rstrip() == "Multi line comment start":
            start = required(r.next().strip())
            r.heading("Multi line comment end", strict)
            end = required(r.next().strip())
            if r.at < len(r.lines) or not strict:
                r.at += 1
    keywords = []
    while r.at < len(r.lines):
        if r.next().rstrip() != "Keyword" and not strict:
            break
        r.next()
        word = required(r.next().strip())
        r.next()
        keywords.append(Keyword(word, required(r.values())))
    return Language(name, extensions, strings, comments, start or None, end or None, tuple(keywords))


def serialize_language(language: Language) -> str:
    out = ["Language", language.name, "", "Extensions", " ".join(language.extensions), "", "String symbols", " ".join(language.string_symbols), "", "Comment symbols", " ".join(language.comment_symbols)]
    if language.block_start:
        out += ["Multi line comment start", language.block_start, "Multi line comment end", language.block_end]
    out.append("")
    for word in language.keywords:
        out += ["Keyword", "    NAME", f"    {word.name}", "    ALIASES", f"    {' '.join(word.aliases)}"]
    return "\n".join(out).rstrip("\n") + "\n"


def load_languages(folder: str) -> tuple[dict[str, Language], list[str]]:
    """(languages by name, names of files that can't be used, in lower case) of a folder of definitions."""
    if not os.path.isdir(folder):
        raise LanguageError(f"no folder {folder}")
    found, faulty = {}, []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if not os.path.isfile(path):
            continue
        try:
            with open(path, encoding="utf-8") as f:
                language = parse_language(f.read())
        except (LanguageError, OSError, UnicodeDecodeError):
            faulty.append(name.lower())
        else:
            found[language.name] = language
    if not found:
        raise LanguageError(f"no usable definition in {folder}" if faulty else f"no file in {folder}")
    return found, faulty


def save_languages(languages: dict[str, Language], folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for language in languages.values():
        with open(os.path.join(folder, f"{language.name}.txt"), "w", encoding="utf-8") as f:
            f.write(serialize_language(language))


def select_languages(languages: dict[str, Language], include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[dict[str, Language], list[str]]:
    """(languages kept, included names that don't exist); names are compared in lower case."""
    wanted, unwanted = {x.lower() for x in include or ()}, {x.lower() for x in exclude or ()}
    if wanted and wanted <= unwanted:
        raise LanguageError("every language to include is excluded as well")
    names = {x.lower() for x in languages}
    kept = {k: v for k, v in languages.items() if (not wanted or k.lower() in wanted) and k.lower() not in unwanted}
    if wanted and not wanted & names:
        raise LanguageError("none of the languages to include exists")
    return kept, sorted(wanted - names)


def language_frame(spark: SparkSession, languages: dict[str, Language]) -> DataFrame:
    rows = [(x.name, list(x.extensions), list(x.string_symbols), list(x.comment_symbols), x.block_start, x.block_end, [(k.name, list(k.aliases)) for k in x.keywords]) for x in languages.values()]
    return spark.createDataFrame(rows, SCHEMA)


def extension_owners(languages: DataFrame) -> DataFrame:
    """(ext, language): of the languages that claim an extension, the first by name."""
    return languages.select(F.explode("extensions").alias("ext"), "name").groupBy("ext").agg(F.min("name").alias("language"))
