"""Options of a run: the command line, saved configurations, and how they are layered."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace

from .functions.formatting import load_palette, parse_colors, parse_languages, parse_number, parse_paths, parse_two_numbers
from .sources.globs import GlobError, exclude_regex
from .sources.listing import TargetError, resolve_targets

DEFAULT_NAME = "default"
LEVELS = (0, 10)
WRITERS, READERS = (1, 8), (1, 30)


class ArgumentError(ValueError):
    """``kind`` names what is wrong with the arguments."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


@dataclass(frozen=True)
class Options:
    """What was said; None where nothing was."""

    dirs: list[str] | None = None
    exclude: list[str] | None = None
    languages: list[str] | None = None
    exclude_languages: list[str] | None = None
    threads: tuple[int, int] | None = None
    braces_as_code: bool | None = None
    search_in_dotted: bool | None = None
    show_faulty_files: bool | None = None
    no_keywords: bool | None = None
    no_visual: bool | None = None
    no_gitignore: bool | None = None
    colors: list[str] | None = None
    color_palette: str | None = None
    log: str | None = None
    compare: int | None = None
    save: str | None = None
    load: str | None = None

    def over(self, lower: Options) -> Options:
        """These options, and ``lower``'s where nothing was said."""
        return Options(**{f.name: getattr(lower, f.name) if getattr(self, f.name) is None else getattr(self, f.name) for f in fields(self)})


#: What holds where neither the arguments nor a configuration say anything.
DEFAULTS = Options(
    exclude=[], languages=[], exclude_languages=[], braces_as_code=False, search_in_dotted=False, show_faulty_files=False,
    no_keywords=False, no_visual=False, no_gitignore=False, colors=[], compare=1,
)
FLAGS = ("braces_as_code", "search_in_dotted", "show_faulty_files", "no_keywords", "no_visual", "no_gitignore")
LISTS = {"dirs": parse_paths, "exclude": parse_paths, "languages": parse_languages, "exclude_languages": parse_languages}
MESSAGES = ("help", "changelog", "show-languages", "show-configs", "show-palettes", "tune-palettes")


def config_path(folder: str, name: str) -> str:
    return os.path.join(folder, f"{name}.txt")


def parse_config(text: str, palettes: str | None = None) -> tuple[Options, list[str]]:
    """(options, names of fields with a value that can't be read) of a configuration's text.

    A line ``===> name`` is followed by its value: a list up to an empty line, else one line.
    """
    values, invalid = {}, []
    lines = text.splitlines()
    for at, line in enumerate(lines):
        if not line.strip().startswith("===>"):
            continue
        name = (line.split(" ") + [""])[1].strip()
        key = name.replace("-", "_")
        value = lines[at + 1] if at + 1 < len(lines) else ""
        if key in LISTS:
            held = []
            for x in lines[at + 1 :]:
                if not x.strip():
                    break
                held += LISTS[key](x)
            if key == "exclude":
                try:
                    exclude_regex(held)
                except GlobError:
                    invalid.append(name)
                    continue
            if held:
                values[key] = held
        elif key in FLAGS:
            word = value.strip().lower()
            if word in ("yes", "true", "no", "false"):
                values[key] = word in ("yes", "true")
            elif word:
                invalid.append(name)
        elif key in ("threads", "compare", "colors"):
            found = parse_two_numbers(value, WRITERS, READERS) if key == "threads" else parse_number(value, *LEVELS) if key == "compare" else parse_colors(value)
            if found is None:
                invalid.append(name)
            else:
                values[key] = found
        elif key == "color_palette":
            if load_palette(value.strip(), palettes) is None:
                invalid.append(name)
            else:
                values[key] = value.strip()
        elif key == "log":
            word = value.strip().lower()
            if word not in ("no", "false"):
                values[key] = "" if word in ("yes", "true") else word
    return Options(**values), invalid


def config_text(options: Options) -> str:
    """A configuration's text with what ``options`` say; whether to log is never kept."""
    out = ["Auto-generated config file."]
    for f in fields(options):
        value = getattr(options, f.name)
        if value is None or f.name in ("log", "save", "load"):
            continue
        if f.name in LISTS:
            shown = ",".join(value)
        elif f.name in FLAGS:
            shown = "yes" if value else "no"
        else:
            shown = " ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
        out.append(f"\n===> {f.name.replace('_', '-')}\n{shown}")
    return "\n".join(out) + "\n"


def _value(name: str, text: str, palettes: str | None):
    """The value of an argument other than targets; ArgumentError if it can't be read."""
    key = name.replace("-", "_")
    wrong = ArgumentError("IncorrectCommandArgs", name)
    if key in FLAGS:
        if text.strip():
            raise ArgumentError("UnexpectedCommandArgs", name)
        return True
    if key in LISTS:
        found = LISTS[key](text)
        if key == "exclude":
            try:
                exclude_regex(found)
            except GlobError as e:
                raise wrong from e
    elif key == "threads":
        found = parse_two_numbers(text, WRITERS, READERS)
    elif key == "compare":
        found = parse_number(text, *LEVELS)
    elif key == "colors":
        found = parse_colors(text)
    elif key == "color_palette":
        found = text.strip()
        if found and load_palette(found, palettes) is None:
            raise ArgumentError("UnknownPalette", found)
    elif key == "log":
        return text.strip()
    elif key in ("save", "load"):
        found = text.strip()
    else:
        raise ArgumentError("UnrecognisedCommand", name)
    if found in (None, [], ""):
        raise wrong
    return found


def parse_arguments(line: str, folder: str, palettes: str | None = None) -> Options:
    """All options for a command line: the arguments over a loaded configuration, over the default one, over DEFAULTS.

    What is saved is what was said or loaded. A configuration's value that can't be read is
    an error unless the arguments give another.
    """
    if not line.strip():
        raise ArgumentError("NoArgsProvided")
    head, *rest = line.split("--")
    gitignore, dotted = "--no-gitignore" not in line, "--search-in-dotted" in line
    said: dict = {}

    def targets(entries: list[str], config: str | None = None) -> list[str]:
        try:
            return resolve_targets(entries, gitignore, dotted)
        except TargetError as e:
            if config is not None:
                raise ArgumentError("InvalidPathInConfig", f"{config}: {e}") from e
            raise ArgumentError(e.kind, str(e)) from e

    if head.strip():
        said["dirs"] = targets(parse_paths(head))
    for part in rest:
        name, _, text = part.strip().partition(" ")
        key = name.replace("-", "_")
        if key == "dirs":
            if "dirs" in said:
                raise ArgumentError("DoublePath")
            found = parse_paths(text)
            if not found:
                raise ArgumentError("IncorrectCommandArgs", name)
            said[key] = targets(found)
        else:
            said[key] = _value(name, text, palettes)
    own = Options(**said)
    for name in filter(None, (own.load, DEFAULT_NAME)):
        loaded = load_config(folder, name, own, palettes, must=name == own.load)
        if name == own.load:
            own = own.over(replace(loaded, dirs=targets(loaded.dirs, name) if loaded.dirs and own.dirs is None else loaded.dirs))
            if own.save:
                save_config(folder, own.save, own)
        else:
            if own.save and not own.load:
                save_config(folder, own.save, own)
            own = own.over(loaded)
    if own.colors is None and own.color_palette:
        own = replace(own, colors=load_palette(own.color_palette, palettes))
    if own.dirs is None:
        own = replace(own, dirs=targets([os.getcwd()]))
    return own.over(DEFAULTS)


def load_config(folder: str, name: str, said: Options = Options(), palettes: str | None = None, must: bool = True) -> Options:
    path = config_path(folder, name)
    if not os.path.isfile(path):
        if must:
            raise ArgumentError("NonExistentConfig", name)
        return Options()
    with open(path, encoding="utf-8") as f:
        found, invalid = parse_config(f.read(), palettes)
    open_ = [x for x in invalid if getattr(said, x.replace("-", "_")) is None]
    if open_:
        raise ArgumentError("InvalidConfigValues", f"{name}: {', '.join(open_)}")
    return found


def save_config(folder: str, name: str, options: Options) -> None:
    if not options.dirs:
        raise ArgumentError("DirsNotSpecified", name)
    if not re.fullmatch(r"[^/\\]+", name):
        raise ArgumentError("IncorrectCommandArgs", "save")
    os.makedirs(folder, exist_ok=True)
    with open(config_path(folder, name), "w", encoding="utf-8") as f:
        f.write(config_text(options))
