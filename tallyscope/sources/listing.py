"""Targets and the walk below them.

Walking a tree prunes whole subtrees before they are opened, which no filter on
a finished listing could do. A walk opens as many folders as it may and hands the others
over, so that tasks share a tree of any shape (see ``code_files``).
"""

from __future__ import annotations

import glob
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from .globs import GlobError, IgnoreStack, glob_regex, is_path_ignored


class TargetError(ValueError):
    """A target that is missing, or a pattern without a usable match; ``kind`` names which."""

    def __init__(self, kind: str, detail: str):
        super().__init__(detail)
        self.kind = kind


@dataclass(frozen=True)
class ListOptions:
    extensions: frozenset[str] = frozenset()
    exclude: str | None = None
    dotted: bool = False
    gitignore: bool = True
    #: What a reader asks for: only these extensions and statuses, only paths that begin so; folders that can't hold such are not opened.
    only_ext: frozenset[str] | None = None
    only_status: frozenset[str] | None = None
    under: str = ""

    def wants(self, e: Entry) -> bool:
        return (self.only_ext is None or e.ext in self.only_ext) and (self.only_status is None or e.status in self.only_status) and e.path.startswith(self.under)

    def may_hold(self, folder: str) -> bool:
        folder = f"{folder.rstrip('/')}/"
        return self.under.startswith(folder) or folder.startswith(self.under)


@dataclass(frozen=True)
class Entry:
    """A file: ``status`` is relevant, excluded or other (an extension of no language); ``stamp``: when a relevant one or its name last changed, in nanoseconds."""

    path: str
    ext: str | None
    bytes: int
    status: str
    stamp: int = 0


class Ahead(NamedTuple):
    """A folder that a walk came to and left for others to open."""

    path: str
    stack: IgnoreStack
    way: frozenset[str]


def extension(path: str) -> str | None:
    """After the last dot of the name; none for names whose only dot is the first character."""
    name = os.path.basename(path)
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else None


def absolute(path: str) -> str:
    return path.replace("\\", "/") if os.path.isabs(path) else os.path.realpath(path)


def without_overlaps(paths: list[str]) -> list[str]:
    """Sorted distinct paths without those below another."""
    kept: list[str] = []
    tops: set[str] = set()
    for path in sorted(set(paths)):
        at, below = path.rstrip("/"), False
        while "/" in at and not below:
            at = at.rpartition("/")[0]
            below = at in tops
        if not below:
            kept.append(path)
            tops.add(path.rstrip("/"))
    return kept


def resolve_targets(entries: list[str], gitignore: bool = True, dotted: bool = False) -> list[str]:
    """Absolute targets for paths and glob patterns, without overlaps.

    A path must exist and is used as it is. A pattern must match something that is neither
    dotted nor ignored, unless the options say otherwise.
    """
    out = []
    for entry in entries:
        entry = entry.strip()
        if not any(c in entry for c in "*?[{"):
            if not os.path.exists(entry):
                raise TargetError("InvalidPath", f"no such path: {entry}")
            out.append(absolute(entry))
            continue
        pattern = entry.replace("\\", "/")
        try:
            glob_regex(pattern, braces=False)
        except GlobError as e:
            raise TargetError("InvalidGlobPattern", f"invalid pattern: {entry}") from e
        found = [p for p in sorted(glob.glob(pattern, recursive=True, include_hidden=True)) if os.path.isdir(p) or os.path.isfile(p)]
        if not found:
            raise TargetError("NoGlobMatches", f"nothing matches {entry}")
        found = [p.rstrip("/") for p in found]
        usable = [p for p in found if (dotted or not os.path.basename(p).startswith(".")) and not (gitignore and is_path_ignored(absolute(p)))]
        if not usable:
            raise TargetError("AllGlobMatchesIgnored", f"all that {entry} matches is hidden or ignored; --no-gitignore or --search-in-dotted take it in")
        out += map(absolute, usable)
    return without_overlaps(out)


def walk(folder: str, options: ListOptions, stack: IgnoreStack, on_folder=None, way: frozenset[str] = frozenset(), budget: int = 1) -> Iterator[Entry]:
    """Files below ``folder``, as ``visit`` comes to them; ``on_folder(path, stack, way)``, if given, takes over the folders beyond the first ``budget``."""
    for found in visit(folder, options, stack, way, None if on_folder is None else budget):
        if isinstance(found, Ahead):
            on_folder(*found)
        else:
            yield found


def visit(folder: str, options: ListOptions, stack: IgnoreStack, way: frozenset[str] = frozenset(), budget: int | None = None) -> Iterator[Entry | Ahead]:
    """Files below ``folder``, level by level, and the folders beyond the first ``budget`` (None: all are opened); ``way`` has the real paths of the folders above.

    Hidden folders are left out unless asked for, hidden files are not. Links to folders are followed, but not back into a folder on the
    way down; links to files and other special files are passed over. Entries come in the order that the file system gives, one at a
    time: however many a folder has, what is held are the folders still to open, ``budget`` at most.
    """
    excluded = re.compile(options.exclude, re.S) if options.exclude else None
    todo = deque([(folder, stack, way)])
    while todo:
        at, stack, way = todo.popleft()
        real = os.path.realpath(at)
        if real in way or not options.may_hold(at):
            continue
        if budget is not None:
            budget -= 1
        own, below = stack.inside(at) if options.gitignore else stack, way | {real}
        for e in _entries(at):
            path = f"{at.rstrip('/')}/{e.name}"
            if e.is_file(follow_symlinks=False):
                found = _entry(path, e, options, excluded, own)
                if options.wants(found):
                    yield found
            elif (options.dotted or not e.name.startswith(".")) and options.may_hold(path) and not (excluded and excluded.match(path)) and not own.ignores(path, True):
                if os.path.isdir(path):
                    if budget is None or len(todo) < budget:
                        todo.append((path, own, below))
                    else:
                        yield Ahead(path, own, below)


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """One that can't be opened counts as empty; where reading breaks off, what was read counts."""
    try:
        with os.scandir(folder) as found:
            yield from found
    except OSError:
        return


def _relevant(path: str, ext: str, found: os.stat_result) -> Entry:
    return Entry(path, ext, found.st_size, "relevant", max(found.st_mtime_ns, found.st_ctime_ns))


def _entry(path: str, e: os.DirEntry, options: ListOptions, excluded: re.Pattern | None, own: IgnoreStack) -> Entry:
    ext = extension(e.name)
    if ext is None or ext not in options.extensions:
        return Entry(path, ext, 0, "other")
    if (excluded and excluded.match(path)) or own.ignores(path, False):
        return Entry(path, ext, 0, "excluded")
    try:
        return _relevant(path, ext, e.stat())
    except OSError:
        return Entry(path, ext, 0, "relevant")


def list_target(target: str, options: ListOptions) -> Iterator[Entry]:
    """A named file, which no rule keeps out, or all files below a named folder."""
    if os.path.isdir(target):
        yield from walk(target, options, IgnoreStack.for_target(target) if options.gitignore else IgnoreStack())
    else:
        ext = extension(target)
        if ext in options.extensions and options.wants(found := _relevant(target, ext, os.stat(target))):
            yield found
