"""The text report: pure functions of a few collected rows."""

from __future__ import annotations

from ..functions.formatting import paint, round_half_away, with_separators
from ..operators.history import age_parts, signed_percentage_text

SLOTS = 50
# Colours of the overview's languages, and of the fourth if it stands for the others.
DEFAULT_COLORS = ("cyan", "bright-magenta", "bright-yellow", "6ad9bd")
OTHERS_COLOR = "d7c9f0"


def percentages(numbers: list[int]) -> list[float]:
    """Shares to two digits; the last is what is left to 100."""
    total, out = sum(numbers), []
    for n in numbers[:-1]:
        out.append(round_half_away(n / total * 10000) / 100 if total else 0.0)
    used = sum(out)
    return [*out, 0.0 if used > 99.99 else round_half_away((100.0 - used) * 100) / 100]


def bar_slots(shares: list[float]) -> list[int]:
    """Slots of a bar: half of each share, one at least for any share, adjusted to SLOTS in all."""
    return fit_slots([0 if not p else max(1, int(round_half_away(p / 2))) for p in shares])


#: How far the two largest bars may be apart for slots to be taken from the second as well.
NEAR = 3


def fit_slots(slots: list[int]) -> list[int]:
    """``slots`` with the sum SLOTS. A slot that is missing goes to the largest bar (halves of four shares lack one at most); slots too many come
    from the two largest: first the largest, then the other as long as they are near.
    """
    slots, gap = list(slots), SLOTS - sum(slots)
    first, second = (sorted(range(len(slots)), key=lambda k: -slots[k]) * 2)[:2]
    slots[first] += max(gap, 0)
    for n in range(-gap):
        slots[second if n and slots[first] - slots[second] <= NEAR else first] -= 1
    return slots


def detail_size(n: int, what: str) -> str:
    value, unit = (n / 1e6, "MBs") if n > 1_000_000 else (n / 1e3, "KBs") if n > 1000 else (float(n), "Bytes")
    return f"{value:.1f} {unit} {what}"


def total_size(n: int) -> tuple[float, str]:
    value, unit = (n / 1e6, "MBs") if n >= 1_000_000 else (n / 1e3, "KBs") if n >= 1000 else (float(n), "Bytes")
    return round_half_away(value, 1), unit


def code_share(code: int, lines: int) -> float:
    return code / lines * 100 if lines else 0.0


def _lines_text(row) -> str:
    return f"lines {with_separators(row['lines'])} {{{with_separators(row['code_lines'])} code ({code_share(row['code_lines'], row['lines']):.2f}%) + {with_separators(row['extra_lines'])} extra}}"


def _keywords_text(counts: dict[str, int]) -> str:
    return " , ".join(f"{k}: {with_separators(n)}" for k, n in sorted(counts.items()))


def details(rows: list[dict], keywords: dict[str, dict[str, int]] | None) -> str:
    """A block for each language, in the order of ``rows``."""
    width = max(max(len(r["language"]) for r in rows), 5) + max(len(with_separators(sum(r["files"] for r in rows))), 1)
    texts = [_lines_text(r) for r in rows]
    out = []
    for r, text in zip(rows, texts):
        files = with_separators(r["files"])
        line = f"{r['language']}   {' ' * (width - len(r['language']) - len(files))}{files} files  -> {text.ljust(max(map(len, texts)))}  |  {detail_size(r['bytes'], 'total')} - {detail_size(r['bytes'] // r['files'], 'average')}"
        if keywords and keywords.get(r["language"]):
            line += f"\n{' ' * (width + 13)}{_keywords_text(keywords[r['language']])}"
        out.append(line)
    return "Details.\n\n" + "\n\n".join(out)


def total(row: dict, keyword_sums: dict[str, int] | None) -> str:
    (size, unit), (average, average_unit) = total_size(row["bytes"]), total_size(row["average_bytes"])
    line = f"Total   {with_separators(row['files'])} files  -> {_lines_text(row)}  |  {size} {unit} total - {average} {average_unit} average"
    rule = "-" * len(line)
    return "\n".join([rule, line, *([_keywords_text(keyword_sums)] if keyword_sums else [])])


def overview(rows: list[dict], visual: bool = True, colors: list[str] | None = None) -> str:
    """Shares of files, lines and bytes of at most four rows, with bars unless ``visual`` is off."""
    names = [r["language"] for r in rows]
    chosen = list(colors or [])
    tint = [*chosen[:4], *DEFAULT_COLORS[len(chosen[:4]) :]]
    if names[-1] == "others":
        tint[len(names) - 1] = chosen[4] if len(chosen) >= 5 else chosen[3] if len(chosen) == 4 else OTHERS_COLOR
    out = []
    for title, column in (("Files:", "files"), ("Lines:", "lines"), ("Size :", "bytes")):
        shares = percentages([r[column] for r in rows])
        line = f"{title}    " + " - ".join(f"{p:5.2f}% {paint(n, c) if visual else n}" for p, n, c in zip(shares, names, tint))
        if visual:
            line += "    [-" + "".join(paint("|", c) * k for k, c in zip(bar_slots(shares), tint)) + "-]"
        out.append(line)
    return "Overview.\n\n" + "\n\n".join(out)


def summary(counts: dict, faulty: int, unknown: tuple[str, ...] = ()) -> str:
    """How many files the run met, and what of the request it could not follow."""
    out = [f"{with_separators(counts['total'])} files: {with_separators(counts['relevant'])} of a known language, {with_separators(counts['excluded'])} excluded"]
    if faulty:
        out.append(f"{with_separators(faulty)} could not be read (--show-faulty-files lists them)")
    if unknown:
        out.append(f"no such language: {', '.join(unknown)}")
    return "\n".join(out)


def progress(entries: list[dict], now: dict, now_ts) -> str:
    """Each earlier run's age and the change of its numbers up to ``now``."""
    out = []
    for e in entries:
        d, h, m = age_parts(int((now_ts - e["ts"]).total_seconds() // 60))
        change = {c: signed_percentage_text(e[c], now[c]) for c in ("files", "lines", "code_lines", "extra_lines")}
        title = f'"{e["name"]}"' if e.get("name") else f"{e['ts']:%Y-%m-%d %H:%M:%S}"
        out.append(
            f"-> {title} ({d} days, {h} hours and {m} minutes ago)\n     Files: {with_separators(e['files'])}({change['files']}%) Lines: {with_separators(e['lines'])}({change['lines']}%) "
            f"{{Code: {with_separators(e['code_lines'])}({change['code_lines']}%), Extra: {with_separators(e['extra_lines'])}({change['extra_lines']}%)}}"
        )
    return "Progress.\n\n" + "\n\n".join(out)
