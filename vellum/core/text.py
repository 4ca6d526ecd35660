"""Numerals, and the text of pages from their text objects."""

from __future__ import annotations

import textwrap
from collections.abc import Iterable, Sequence
from itertools import groupby
from typing import Any

SOFT_HYPHEN = "\xad"


def roman(n: int) -> str:
    if not 0 < n < 4000:
        raise ValueError(f"{n} has no Roman numeral")
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out += sign * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """a, ..., z, aa, ab, ...: digits from 1 to 26."""
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, 26)
        out = chr(97 + digit) + out
    return out


def numeral(n: int, style: str | None) -> str:
    """A page number in one of the five styles; none gives none."""
    try:
        return {"D": lambda: str(n), "R": lambda: roman(n).upper(), "r": lambda: roman(n), "A": lambda: letters(n).upper(), "a": lambda: letters(n)}[style or ""]()
    except (KeyError, ValueError):
        return ""


def next_line(dx: float, dy: float, vertical: bool, space: str) -> bool:
    return dx < 0 if vertical else (-dy if space == "screen" else dy) < 0


def untagged_text(texts: Iterable[dict[str, Any]], space: str = "screen", box: Sequence[float] | None = None) -> str:
    """Lines by the direction of writing; a gap of over half a unit is a space.

    Each text has `glyphs` (text, x, y, end x, end y), `vertical` and `origin`; with a box, texts
    that don't cross it are left out.
    """
    lines: list[str] = []
    line = ""
    before: tuple[float, float] | None = None
    end = 0.0
    for t in texts:
        origin, vertical = t["origin"], t["vertical"]
        if before is not None and next_line(origin[0] - before[0], origin[1] - before[1], vertical, space):
            lines.append(line)
            line = ""
            fresh = True
        else:
            fresh = before is None
        inside = box is None or crosses(t, box)
        for g in t["glyphs"]:
            at = g[2] if vertical else g[1]
            gap = end - at if vertical and space != "screen" else at - end
            if inside and not fresh and line and not line.endswith(" ") and gap > 0.5:
                line += " "
            fresh = False
            if inside:
                line += g[0]
            end = g[4] if vertical else g[3]
        before = origin
    if line:
        lines.append(line)
    return "\n".join(lines)


def crosses(t: dict[str, Any], box: Sequence[float]) -> bool:
    """Whether the stretch from a text's origin to its end meets a box."""
    (x, y), (u, v) = t["origin"], t["end"]
    left, right, low, high = max(min(x, u), box[0]), min(max(x, u), box[2]), max(min(y, v), box[1]), min(max(y, v), box[3])
    return right > left and high >= low


def tagged_text(texts: Iterable[dict[str, Any]], space: str = "screen", width: int = 70) -> str:
    """The text of marked content that isn't an artifact, in stream order, as paragraphs of wrapped lines."""
    out: list[str] = []
    held: list[str] = []
    before_id: int | None = None
    before: tuple[float, float] | None = None
    for key, run in groupby(texts, key=lambda t: (t["mcid"], t["tag"], t["actual"])):
        mcid, tag, actual = key
        own = list(run)
        if mcid is None or tag in (None, "Artifact"):
            continue
        first = own[0]
        if before is not None and mcid != before_id and next_line(first["origin"][0] - before[0], first["origin"][1] - before[1], first["vertical"], space):
            out += textwrap.wrap("".join(held), width) if held else []
            held = []
        said = actual if actual is not None else "".join(t["chars"] for t in own)
        if tag == "ReversedChars":
            said = said[::-1]
        held.append(said.replace(SOFT_HYPHEN, ""))
        before_id, before = mcid, own[-1]["origin"]
    if held:
        out += textwrap.wrap("".join(held), width)
    return "\n".join(out)
