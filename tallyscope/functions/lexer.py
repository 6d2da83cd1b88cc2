"""The line lexer: what of a line is code, and the state it leaves behind.

A language row is compiled into a table over kinds of marks (line comments, string symbols,
block starts, block ends): for each mode the lexer can be in and each kind of mark, apart from the one before
or touching it, the next mode and what happens to the text. A line is read as its marks
in order of place, one table look-up each; whatever text a mode keeps is cut out between
them. Which places are marks at all (escapes, pairs of string symbols,
overlaps) is settled before, on the line as a whole.

States are small integers, so that they fit a column: 0 code, 1 block comment,
2 + k an open string of the language's symbol k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ..languages import Language

CODE, BLOCK, STRING = 0, 1, 2
#: White space in the sense of Unicode's White_Space property; str.strip() alone would take more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BRACES = frozenset({"{", "}", "};"})
#: Characters that end a keyword, besides the text's edges.
KEYWORD_EDGES = " {},"


@dataclass(frozen=True)
class LineFacts:
    """``cleansed``: text outside strings and comments, None if there is none to speak of."""

    cleansed: str | None
    has_literal: bool
    state: int


def places(text: str, symbol: str) -> list[int]:
    """Where ``symbol`` is found from left to right, without overlaps."""
    out, at = [], text.find(symbol)
    while at >= 0:
        out.append(at)
        at = text.find(symbol, at + len(symbol))
    return out


def unescaped(text: str, found: list[int]) -> list[int]:
    """Those places that an even number of backslashes precedes."""
    return [p for p in found if (p - len(text[:p].rstrip("\\"))) % 2 == 0]


def string_marks(text: str, symbols: tuple[str, ...], open_symbol: int | None) -> list[tuple[int, int]]:
    """(place, symbol number) of the string symbols that open or close a string.

    With two symbols, what lies inside a string of the one is no mark of the other. If
    only one of the two is in the line, it counts only where no string of the other is open; if one of them is
    there but always escaped, all of the other's places count.
    """
    raw = [places(text, s) for s in symbols]
    live = [unescaped(text, found) for found in raw]
    if len(raw) == 1:
        return [(p, 0) for p in live[0]]
    if not all(raw):
        only = 0 if raw[0] else 1
        return [(p, only) for p in live[only]] if open_symbol in (None, only) else []
    if not all(live):
        only = 0 if live[0] else 1
        return [(p, only) for p in live[only]]
    heads, out, within = [0, 0], [], open_symbol
    while True:
        left = [live[k][heads[k] :] for k in (0, 1)]
        if within is not None:
            if not left[within]:
                return out
            close = left[within][0]
            out.append((close, within))
            heads[within] += 1
            heads[1 - within] += sum(p < close for p in left[1 - within])
            within = None
        elif not (left[0] and left[1]):
            return out + [(p, k) for k in (0, 1) for p in left[k]]
        else:
            within = 0 if left[0][0] < left[1][0] else 1
            out.append((left[within][0], within))
            heads[within] += 1


def untangle(starts: list[int], ends: list[int], in_block: bool, size: int) -> None:
    """Remove marks that share characters with a mark that counts (``/*/``, ``*/*``).

    Marks are read in the order of their places. Outside of a block a start counts, inside an end does;
    each takes the marks of the other kind that overlap it away.
    """
    gone: set[tuple[int, bool]] = set()
    for mark in sorted([(p, False) for p in starts] + [(p, True) for p in ends]):
        place, closes = mark
        if closes == in_block and mark not in gone:
            gone |= {(place + d, not closes) for d in range(1 - size, size) if d}
            in_block = not in_block
    starts[:] = [p for p in starts if (p, False) not in gone]
    ends[:] = [p for p in ends if (p, True) not in gone]


#: Kinds of marks.
COMMENT, QUOTE, OPEN, CLOSE = range(4)
#: Modes: outside of all, the same right behind a block's end, in a string, in a block, in a block that began right behind another's end.
OUT, BEHIND, WITHIN, DEEP, RESUMED = range(5)
#: What a mark does: the text before it is kept; text goes on behind its first character, or behind all of it; a literal was met; the line is decided; an end of no block is remembered, or the ends remembered are looked at.
KEEP, NEXT, PAST, LITERAL, STOP, STRAY, PAIR = (1 << k for k in range(7))


@lru_cache(maxsize=256)
def table(language: Language) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each mode, at place 2 * kind + (touching the mark before): the next mode and what the mark does."""
    rules = {
        (OUT, COMMENT): (OUT, KEEP | STOP),
        (OUT, QUOTE): (WITHIN, KEEP | LITERAL),
        (WITHIN, QUOTE): (OUT, NEXT | LITERAL),
    }
    if language.block_start:
        rules |= {(OUT, OPEN): (DEEP, KEEP | PAIR), (OUT, CLOSE): (OUT, STRAY), (DEEP, CLOSE): (BEHIND, PAST), (RESUMED, CLOSE): (BEHIND, PAST)}
    rules |= {(BEHIND, kind): to for (mode, kind), to in rules.items() if mode == OUT}
    # a quote glued to a block's end closes a string that never began; a start glued to it goes on with a block
    glued = rules | {(BEHIND, QUOTE): (OUT, NEXT | LITERAL), (BEHIND, OPEN): (RESUMED, 0)}
    return tuple(tuple(r.get((mode, kind), (mode, 0)) for kind in range(4) for r in (rules, glued)) for mode in range(5))


@lru_cache(maxsize=256)
def any_mark(language: Language) -> re.Pattern:
    """Finds a line's first mark; valid for Python and for ``rlike``."""
    marks = [*language.strings, *language.comment_symbols[:2], *filter(None, (language.block_start, language.block_end))]
    return re.compile("|".join(map(re.escape, marks)))


def comment_marks(text: str, language: Language, ends: list[int]) -> list[int]:
    """Places of line comments.

    With blocks, one that begins on a block end's last character is none, and of two symbols the second counts only behind all of the
    first.
    """
    found = [places(text, s) for s in language.comment_symbols[:2]]
    if language.block_end is None:
        return sorted(p for of in found for p in of)
    size, closed = len(language.block_end), set(ends)
    found = [[p for p in of if max(0, p - size + 1) not in closed] for of in found]
    if len(found) == 2 and found[0]:
        found[1] = [p for p in found[1] if p > found[0][-1]]
    return [p for of in found for p in of]


def line_marks(text: str, language: Language, state: int) -> list[tuple[int, int, int]]:
    """(place, kind, string symbol) of the marks that count in a line which begins in ``state``, in order."""
    ends = places(text, language.block_end) if language.block_end else []
    quotes = string_marks(text, language.strings, state - STRING if state >= STRING else None)
    comments = comment_marks(text, language, ends)
    starts: list[int] = []
    if language.block_start:
        known = set(comments)
        starts = [p for p in places(text, language.block_start) if p + 1 not in known]
        if starts and ends:
            untangle(starts, ends, state == BLOCK, len(language.block_start))
    marks = [(p, QUOTE, k) for p, k in quotes]
    marks += [(p, kind, 0) for kind, found in ((COMMENT, comments), (OPEN, starts), (CLOSE, ends)) for p in found]
    marks.sort()
    return marks


def line_facts(text: str, language: Language, state: int = CODE) -> LineFacts:
    """Facts of one trimmed, non-empty line that begins in ``state``."""
    if state == CODE and not any_mark(language).search(text):
        return LineFacts(text, False, CODE)
    rules, size = table(language), len(language.block_end or "")
    mode, symbol = (OUT, DEEP, WITHIN)[min(state, STRING)], max(0, state - STRING)
    kept, begin, literal, behind = "", 0, False, -1
    strays: list[int] = []  # ends met outside of blocks since the last mark that mattered
    for place, kind, k in line_marks(text, language, state):
        now, mode = mode, rules[mode][2 * kind + (place == behind)][0]
        does = rules[now][2 * kind + (place == behind)][1]
        if not does:
            continue
        if does & KEEP:
            kept += text[begin:place]
        if does & LITERAL:
            literal, symbol = True, k
        if does & STOP:
            return LineFacts(kept or None, literal, CODE)
        if does & STRAY:
            strays.append(place)
            continue
        if does & PAIR and len(strays) > 1:
            # the first stray end is passed over, the second closes the block before it began
            mode, begin, strays = OUT, strays[1] + size, strays[2:]
            continue
        strays = []
        if does & NEXT:
            begin = place + 1
        elif does & PAST:
            begin = behind = place + size
    if mode == WITHIN:
        return LineFacts(kept or None, True, STRING + symbol)
    if mode == DEEP:
        return LineFacts(kept or None, literal and bool(kept), BLOCK)
    if mode == RESUMED:
        return LineFacts(kept, literal, BLOCK)
    return LineFacts(kept + text[begin:] or None, literal, CODE)


def split_lines(text: str) -> list[str]:
    """Lines ended by LF or CR LF; no empty line after the last end."""
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines[:-1]] + ([x[:-1] if text.endswith("\n") and x.endswith("\r") else x for x in lines[-1:]])


def is_code(facts: LineFacts, braces_as_code: bool = False) -> bool:
    """A line of braces alone is extra, unless asked for; a line with only a literal is code."""
    if facts.cleansed is None:
        return facts.has_literal
    return braces_as_code or facts.cleansed.strip(WHITE) not in BRACES


def touching(found: list[int], size: int) -> list[list[int]]:
    """Places in runs of occurrences without anything between them."""
    runs: list[list[int]] = []
    for p in found:
        if runs and runs[-1][-1] + size == p:
            runs[-1].append(p)
        else:
            runs.append([p])
    return runs


def count_alias(text: str, alias: str) -> int:
    """Occurrences of ``alias`` between edges.

    Of a run of touching occurrences every third one counts and, if it is left over, the last;
    two left over don't, but then the next run's first one stands apart from its run. An
    occurrence that counts is an edge for the ones beside it, as the text's ends are.
    """
    size, kept, apart = len(alias), [], False
    for run in touching(places(text, alias), size):
        if apart:
            kept.append(run.pop(0))
        kept += run[2::3] + (run[-1:] if len(run) % 3 == 1 else [])
        apart = len(run) % 3 == 2
    lefts, rights = {0, *(p + size for p in kept)}, {len(text), *kept}
    return sum((p in lefts or text[p - 1] in KEYWORD_EDGES) and (p + size in rights or text[p + size] in KEYWORD_EDGES) for p in kept)


@lru_cache(maxsize=256)
def any_alias(language: Language) -> re.Pattern | None:
    aliases = [a for word in language.keywords for a in word.aliases]
    return re.compile("|".join(map(re.escape, sorted(aliases, key=len, reverse=True)))) if aliases else None


def count_keywords(cleansed: str, language: Language, counts: list[int]) -> None:
    found = any_alias(language)
    if found is None or not found.search(cleansed):
        return
    cleansed = cleansed.strip(WHITE)
    for k, word in enumerate(language.keywords):
        counts[k] += sum(count_alias(cleansed, alias) for alias in word.aliases if alias in cleansed)


class Stretch:
    """Lines without a mark, in a row: they leave any state as it is, so all that a state asks of them is a sum."""

    __slots__ = ("counts", "full", "plain", "text")

    def __init__(self, text: str):
        self.text, self.plain, self.full, self.counts = text, None, 0, None

    def code(self, state: int, braces_as_code: bool) -> int:
        if state == BLOCK or not self.text:
            return 0
        if self.plain is None:
            lines = [x for x in (x.strip(WHITE) for x in self.text.split("\n")) if x]
            self.full = len(lines)
            self.plain = self.full if braces_as_code else sum(x not in BRACES for x in lines)
        return self.plain if state == CODE else self.full

    def keywords(self, language: Language) -> list[int]:
        if self.counts is None:
            self.counts, found, at = [0] * len(language.keywords), any_alias(language), 0
            while found and (hit := found.search(self.text, at)):
                begin = self.text.rfind("\n", 0, hit.start()) + 1
                at = self.text.find("\n", hit.end())
                at = len(self.text) if at < 0 else at
                count_keywords(self.text[begin:at], language, self.counts)
        return self.counts


def stretches(text: str, language: Language) -> list[tuple[Stretch, str]]:
    """The text as (lines without a mark, then a trimmed line with one); the last line is empty."""
    out, at, found = [], 0, any_mark(language)
    while hit := found.search(text, at):
        begin = max(at, text.rfind("\n", at, hit.start()) + 1)
        end = text.find("\n", hit.end())
        end = len(text) if end < 0 else end
        out.append((Stretch(text[at:begin]), text[begin:end].strip(WHITE)))
        at = end + 1
    out.append((Stretch(text[at:]), ""))
    return out


def text_facts(text: str, language: Language, states: tuple[int, ...] = (CODE,), braces_as_code: bool = False, keywords: bool = True) -> list[tuple[int, int, list[int]]]:
    """For each state that a text may begin in: (the state after it, its code lines, count of each keyword).

    The first state's walk is kept line by line; the walk from another state ends where it meets it, as all that follows is the same.
    """
    cut, out = stretches(text, language), []
    trail: list[tuple[int, int, list[int]]] = []  # before each stretch, of the first walk
    for first in states:
        state, code, counts = first, 0, [0] * len(language.keywords)
        for at, (plain, line) in enumerate(cut):
            if not out:
                trail.append((state, code, list(counts)))
            elif trail[at][0] == state:
                end, rest, later = out[0]
                state, code = end, code + rest - trail[at][1]
                counts = [a + b - c for a, b, c in zip(counts, later, trail[at][2])]
                break
            code += plain.code(state, braces_as_code)
            if keywords and state == CODE:
                counts = [a + b for a, b in zip(counts, plain.keywords(language))]
            if line:
                facts = line_facts(line, language, state)
                state = facts.state
                if is_code(facts, braces_as_code):
                    code += 1
                    if keywords and facts.cleansed:
                        count_keywords(facts.cleansed, language, counts)
        out.append((state, code, counts))
    return out


def count_lines(text: str) -> int:
    """Lines ended by LF, and one more that has no end."""
    return text.count("\n") + (not text.endswith("\n") if text else 0)


def file_facts(text: str, language: Language, braces_as_code: bool = False, keywords: bool = True) -> tuple[int, int, list[int]]:
    """(lines, code lines, count of each keyword) of a whole file."""
    ((_, code, counts),) = text_facts(text, language, (CODE,), braces_as_code, keywords)
    return count_lines(text), code, counts


def states_of(language: Language) -> tuple[int, ...]:
    return (CODE, *((BLOCK,) if language.block_start else ()), *(STRING + k for k in range(len(language.strings))))
