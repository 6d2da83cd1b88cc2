"""Numbers, lists and colours in text."""

from __future__ import annotations

import math
import os
import re

# Names of colours; others are six hexadecimal digits.
COLORS = ("black", "red", "green", "yellow", "blue", "magenta", "cyan", "white")
NAMED = {**{c: 30 + k for k, c in enumerate(COLORS)}, **{f"bright-{c}": 90 + k for k, c in enumerate(COLORS)}}

# The palettes that come with the package.
PALETTES = {
    "Catppuccin": "f38ba8 fab387 a6e3a1 cba6f7",
    "Dracula": "ff79c6 8be9fd 50fa7b bd93f9",
    "Gruvbox": "fb4934 fabd2f b8bb26 83a598",
    "Classic": "cyan bright-magenta bright-yellow 6ad9bd d7c9f0",
    "Neon": "ff2e97 00f0ff f9f002 9d72ff",
    "Ocean": "22d3ee 60a5fa 34d399 94a3b8",
}


def round_half_away(x: float, digits: int = 0) -> float:
    scaled = abs(x) * 10**digits
    whole = math.floor(scaled)
    return math.copysign((whole + (scaled - whole >= 0.5)) / 10**digits, x)


def with_separators(n: int | str) -> str:
    return re.sub(r"(?<=.)(?=(?:.{3})+$)", ",", str(n))


def n_separators(n: int) -> int:
    return max(0, (len(str(n)) - 1) // 3)


def parse_languages(text: str) -> list[str]:
    """Names or extensions between commas, lower-cased, without one leading dot."""
    return [x for part in text.split(",") if (x := part.strip().lower().removeprefix(".").strip())]


def parse_paths(text: str) -> list[str]:
    """Paths between commas with forward slashes; double quotes around them go, a closing one also alone."""
    out = []
    for part in text.split(","):
        x = part.strip().replace("\\", "/")
        if x.endswith('"'):
            x = (x[1:] if x.startswith('"') and len(x) > 1 else x)[:-1]
        if x.strip():
            out.append(x.strip())
    return out


def parse_number(text: str, low: int, high: int) -> int | None:
    text = text.strip()
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and low <= int(text) <= high else None


def parse_two_numbers(text: str, first: tuple[int, int], second: tuple[int, int]) -> tuple[int, int] | None:
    parts = text.split()
    if len(parts) != 2:
        return None
    a, b = parse_number(parts[0], *first), parse_number(parts[1], *second)
    return None if a is None or b is None else (a, b)


def parse_color(token: str) -> str | None:
    """A colour's name, or its six digits; None for anything else."""
    token = token.lower().replace("_", "-")
    if token in NAMED:
        return token
    digits = token.removeprefix("#")
    return digits if re.fullmatch(r"[0-9a-f]{6}", digits) else None


def parse_colors(text: str) -> list[str] | None:
    """One to five colours."""
    found = [parse_color(x) for x in text.split()]
    return found if 1 <= len(found) <= 5 and None not in found else None


def load_palette(name: str, folder: str | None = None) -> list[str] | None:
    """A palette of the folder or the package, by name without regard to case."""
    if folder and os.path.isdir(folder):
        for file in sorted(os.listdir(folder)):
            if os.path.splitext(file)[0].lower() == name.lower():
                with open(os.path.join(folder, file), encoding="utf-8") as f:
                    line = next((x for x in f if x.strip()), "")
                return parse_colors(line)
    found = next((v for k, v in PALETTES.items() if k.lower() == name.lower()), None)
    return parse_colors(found) if found else None


def paint(text: str, color: str) -> str:
    code = str(NAMED[color]) if color in NAMED else "38;2;" + ";".join(str(int(color[k : k + 2], 16)) for k in (0, 2, 4))
    return f"\x1b[{code}m{text}\x1b[0m"
