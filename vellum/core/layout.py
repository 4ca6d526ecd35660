"""Layout analysis of a page: characters to lines, lines to boxes, boxes to a reading order."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .geometry import Point, Rect, union
from .interp import Item

CELL = 50.0


@dataclass(frozen=True)
class LayoutParams:
    """How near things have to be. boxes_flow weighs height against width, from -1 to 1; None: no grouping."""

    line_overlap: float = 0.5
    char_margin: float = 2.0
    line_margin: float = 0.5
    word_margin: float = 0.1
    boxes_flow: float | None = 0.5
    detect_vertical: bool = False
    all_texts: bool = False

    def __post_init__(self) -> None:
        if self.boxes_flow is not None and not -1 <= self.boxes_flow <= 1:
            raise ValueError("boxes_flow is from -1 to 1, or None")


@dataclass(eq=False)
class Part:
    """A piece of a layout: char, textline, textbox, group, line, rect, curve or image."""

    kind: str
    bbox: Rect
    text: str = ""
    vertical: bool = False
    parts: list[Part] = field(default_factory=list)
    index: int | None = None
    order: int = 0
    size: float = 0.0
    stroke: bool = False
    fill: bool = False

    @property
    def width(self) -> float:
        return self.bbox[2] - self.bbox[0]

    @property
    def height(self) -> float:
        return self.bbox[3] - self.bbox[1]


def _apart(low: float, high: float, other_low: float, other_high: float) -> float:
    return 0.0 if other_low <= high and low <= other_high else min(abs(low - other_high), abs(high - other_low))


def _shared(low: float, high: float, other_low: float, other_high: float) -> float:
    return min(abs(low - other_high), abs(high - other_low)) if other_low <= high and low <= other_high else 0.0


def _aligned(a: Part, b: Part, p: LayoutParams) -> tuple[bool, bool]:
    """Whether two characters can follow one another in a horizontal, and in a vertical line."""
    (x0, y0, x1, y1), (u0, v0, u1, v1) = a.bbox, b.bbox
    level = _shared(y0, y1, v0, v1) > min(a.height, b.height) * p.line_overlap and _apart(x0, x1, u0, u1) < max(a.width, b.width) * p.char_margin
    upright = p.detect_vertical and _shared(x0, x1, u0, u1) > min(a.width, b.width) * p.line_overlap and _apart(y0, y1, v0, v1) < max(a.height, b.height) * p.char_margin
    level = level and _meet(y0, y1, v0, v1)
    upright = upright and _meet(x0, x1, u0, u1)
    return level, upright


def _meet(low: float, high: float, other_low: float, other_high: float) -> bool:
    return other_low <= high and low <= other_high


def _line(chars: Sequence[Part], vertical: bool, p: LayoutParams) -> Part:
    out = Part("textline", chars[0].bbox, vertical=vertical)
    text: list[str] = []
    edge: float | None = None
    for c in chars:
        margin = p.word_margin * max(c.width, c.height)
        if edge is not None and (edge > c.bbox[3] + margin if vertical else edge < c.bbox[0] - margin):
            text.append(" ")
        text.append(c.text)
        edge = c.bbox[1] if vertical else c.bbox[2]
    out.parts = list(chars)
    out.bbox = union(c.bbox for c in chars) or chars[0].bbox
    out.text = "".join(text) + "\n"
    return out


def lines_of(chars: Sequence[Part], p: LayoutParams) -> Iterator[Part]:
    """Characters in stream order to lines. A character that ends a line is placed with the one after it."""
    held: list[Part] = []
    vertical = False
    for a, b in zip(chars, chars[1:], strict=False):
        level, upright = _aligned(a, b, p)
        if held:
            if level and not vertical or upright and vertical:
                held.append(b)
            else:
                yield _line(held, vertical, p)
                held = []
        elif upright and not level:
            held, vertical = [a, b], True
        elif level and not upright:
            held, vertical = [a, b], False
        else:
            yield _line([a], False, p)
    if held:
        yield _line(held, vertical, p)
    elif chars:
        yield _line([chars[-1]], False, p)


class Grid:
    """Parts by the cells they touch, of a size that follows the part's: it touches four at most, however large it is."""

    def __init__(self, parts: Iterable[Part]) -> None:
        self.levels: dict[int, dict[tuple[int, int], list[Part]]] = {}
        for part in parts:
            self.add(part)

    @staticmethod
    def _range(r: Rect, side: float) -> tuple[int, int, int, int]:
        return int(r[0] // side), int(r[1] // side), int(r[2] // side), int(r[3] // side)

    def add(self, part: Part) -> None:
        level = max(0, math.frexp(max(part.width, part.height) / CELL)[1])
        cells = self.levels.setdefault(level, {})
        a, b, c, d = self._range(part.bbox, CELL * 2.0**level)
        for i in range(a, c + 1):
            for j in range(b, d + 1):
                cells.setdefault((i, j), []).append(part)

    def find(self, r: Rect) -> list[Part]:
        """What overlaps a box, in the order of their numbers."""
        seen: dict[int, Part] = {}
        for level, cells in self.levels.items():
            a, b, c, d = self._range(r, CELL * 2.0**level)
            if (c - a + 1) * (d - b + 1) > len(cells):
                met = (q for own in cells.values() for q in own)
            else:
                met = (q for i in range(a, c + 1) for j in range(b, d + 1) for q in cells.get((i, j), ()))
            seen.update((id(q), q) for q in met)
        return sorted((q for q in seen.values() if not (q.bbox[2] <= r[0] or r[2] <= q.bbox[0] or q.bbox[3] <= r[1] or r[3] <= q.bbox[1])), key=lambda q: q.order)


def _neighbours(line: Part, grid: Grid, ratio: float) -> list[Part]:
    x0, y0, x1, y1 = line.bbox
    side = 0 if line.vertical else 1
    d = ratio * (line.width if line.vertical else line.height)
    area = (x0 - d, y0, x1 + d, y1) if line.vertical else (x0, y0 - d, x1, y1 + d)
    out = []
    for q in grid.find(area):
        same = abs((q.width if line.vertical else q.height) - (line.width if line.vertical else line.height)) <= d
        low, high = (y0, y1) if line.vertical else (x0, x1)
        qlow, qhigh = q.bbox[1 - side], q.bbox[3 - side]
        qlow, qhigh = (q.bbox[1], q.bbox[3]) if line.vertical else (q.bbox[0], q.bbox[2])
        if q.vertical == line.vertical and same and (abs(low - qlow) <= d or abs(high - qhigh) <= d or abs((low + high) - (qlow + qhigh)) / 2 <= d):
            out.append(q)
    return out


def boxes_of(lines: Sequence[Part], p: LayoutParams) -> list[Part]:
    """Lines that neighbour each other share a box; the order of the lines decides what is joined when."""
    for k, line in enumerate(lines):
        line.order = k
    grid = Grid(lines)
    member: dict[int, list[Part]] = {}
    for line in lines:
        joined: dict[int, Part] = {id(line): line}
        for q in _neighbours(line, grid, p.line_margin):
            joined.setdefault(id(q), q)
            for r in member.get(id(q), ()):
                joined.setdefault(id(r), r)
        own = list(joined.values())
        for q in own:
            member[id(q)] = own
    out, seen = [], set()
    for line in lines:
        own = member[id(line)]
        if id(own) in seen:
            continue
        seen.add(id(own))
        box = Part("textbox", union(q.bbox for q in own) or line.bbox, vertical=line.vertical)
        box.parts = sorted(own, key=lambda q: (-q.bbox[2] if box.vertical else -q.bbox[3]))
        box.text = "".join(q.text for q in box.parts)
        if box.width > 0 and box.height > 0:
            out.append(box)
    return out


def _area(r: Rect) -> float:
    return (r[2] - r[0]) * (r[3] - r[1])


def grouped(boxes: Sequence[Part], flow: float) -> Part | None:
    """Always the nearest two as one group, where nothing lies between; equal distances by order."""
    if not boxes:
        return None
    live: dict[int, Part] = {}
    for k, b in enumerate(boxes):
        b.order = k
        live[k] = b
    items = list(boxes)
    corners, areas, alive = np.zeros((2 * len(boxes), 4)), np.zeros(2 * len(boxes)), np.zeros(2 * len(boxes), bool)
    corners[: len(boxes)] = [b.bbox for b in boxes]
    areas[: len(boxes)] = [_area(b.bbox) for b in boxes]
    alive[: len(boxes)] = True
    # the nearest pairs come from sorted streams: one of all the boxes, then one for each new group
    heap: list[tuple[bool, float, int, int, int]] = []
    streams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    places: list[int] = []

    def distances(box: Rect, others: np.ndarray) -> np.ndarray:
        w = np.maximum(corners[others, 2], box[2]) - np.minimum(corners[others, 0], box[0])
        h = np.maximum(corners[others, 3], box[3]) - np.minimum(corners[others, 1], box[1])
        return w * h

    def proceed(k: int) -> None:
        """Puts the next pair of a stream whose parts are both still there on the heap."""
        dist, first, second = streams[k]
        at = places[k]
        while at < len(dist) and not (first[at] in live and second[at] in live):
            at += 1
        places[k] = at + 1
        if at < len(dist):
            heapq.heappush(heap, (False, float(dist[at]), int(first[at]), int(second[at]), k))

    def stream(dist: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        order = np.lexsort((second, first, dist))
        streams.append((dist[order], first[order], second[order]))
        places.append(0)
        proceed(len(streams) - 1)

    every = np.arange(len(boxes))
    pairs = [(distances(b.bbox, every[k + 1 :]) - areas[k] - areas[k + 1 : len(boxes)], np.full(len(boxes) - k - 1, k), every[k + 1 :]) for k, b in enumerate(boxes[:-1])]
    if pairs:
        stream(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
    while heap:
        skip, dist, i, j, k = heapq.heappop(heap)
        if not skip:
            proceed(k)
        if i not in live or j not in live:
            continue
        a, b = live[i], live[j]
        if not skip:
            x0, y0, x1, y1 = union((a.bbox, b.bbox)) or a.bbox
            alive[[i, j]] = False
            between = (alive & (corners[:, 0] < x1) & (corners[:, 2] > x0) & (corners[:, 1] < y1) & (corners[:, 3] > y0)).any()
            alive[[i, j]] = True
            if between:
                heapq.heappush(heap, (True, dist, i, j, k))
                continue
        del live[i], live[j]
        alive[[i, j]] = False
        new = Part("group", union((a.bbox, b.bbox)) or a.bbox, vertical=a.vertical or b.vertical, order=len(items))
        key = (lambda q: -(1 + flow) * (q.bbox[0] + q.bbox[2]) - (1 - flow) * q.bbox[3]) if new.vertical else (lambda q: (1 - flow) * q.bbox[0] - (1 + flow) * (q.bbox[1] + q.bbox[3]))
        new.parts = sorted((a, b), key=key)
        items.append(new)
        rest = np.flatnonzero(alive)
        live[new.order] = new
        corners[new.order], areas[new.order], alive[new.order] = new.bbox, _area(new.bbox), True
        if len(rest):
            stream(distances(new.bbox, rest) - areas[new.order] - areas[rest], rest, np.full(len(rest), new.order))
    return next(iter(live.values()))


def number_boxes(top: Part | None) -> None:
    stack, n = [top] if top else [], 0
    while stack:
        part = stack.pop()
        if part.kind == "textbox":
            part.index = n
            n += 1
        elif part.kind == "group":
            stack += reversed(part.parts)


def path_parts(segments: Sequence[tuple[str, list[Point]]], stroke: bool, fill: bool) -> Iterator[Part]:
    """Each subpath as a line, an upright rectangle or a curve."""
    subpath: list[tuple[str, list[Point]]] = []
    for op, points in [*segments, ("m", [])]:
        if op == "m" and subpath:
            shape = "".join(o for o, _ in subpath)
            ends = [ps[-1] for _, ps in subpath if ps]
            every = [q for _, ps in subpath for q in ps]
            box = (min(x for x, _ in every), min(y for _, y in every), max(x for x, _ in every), max(y for _, y in every))
            if shape in ("ml", "mlh"):
                yield Part("line", box, stroke=stroke, fill=fill)
            elif shape in ("mlllh", "mllll", "mllllh") and (shape == "mlllh" or ends[0] == ends[4]) and _upright(ends[:4]):
                yield Part("rect", box, stroke=stroke, fill=fill)
            elif shape != "m":
                yield Part("curve", box, stroke=stroke, fill=fill)
            subpath = []
        if points or op == "h":
            subpath.append((op, points))


def _upright(c: Sequence[Point]) -> bool:
    return c[0][0] == c[1][0] and c[1][1] == c[2][1] and c[2][0] == c[3][0] and c[3][1] == c[0][1] or c[0][1] == c[1][1] and c[1][0] == c[2][0] and c[2][1] == c[3][1] and c[3][0] == c[0][0]


class Container:
    """What a page or a form paints, in the order of painting."""

    def __init__(self) -> None:
        self.parts: list[Part] = []

    def analysed(self, p: LayoutParams) -> list[Part]:
        """The boxes, then what isn't text, then lines without text."""
        chars = [q for q in self.parts if q.kind == "char"]
        others = [q for q in self.parts if q.kind != "char"]
        lines = list(lines_of(chars, p))
        empty = [q for q in lines if q.width <= 0 or q.height <= 0 or not q.text.strip()]
        without = set(map(id, empty))
        boxes = boxes_of([q for q in lines if id(q) not in without], p)
        if p.boxes_flow is None:
            boxes.sort(key=lambda b: (0, -b.bbox[2], -b.bbox[1]) if b.vertical else (1, -b.bbox[1], b.bbox[0]))
            for k, b in enumerate(boxes):
                b.index = k
        else:
            number_boxes(grouped(boxes, p.boxes_flow))
            boxes.sort(key=lambda b: b.index or 0)
        return [*boxes, *others, *empty]


def analyse(items: Iterable[Item], p: LayoutParams = LayoutParams()) -> list[Part]:
    """The parts of a page. A form is a figure with what it paints as its parts: as they come, or with all_texts by an analysis of its own."""
    page = Container()
    inside: dict[tuple[int, ...], Container] = {(): page}
    figures: list[tuple[Part, Container]] = []
    for it in items:
        own = inside.get(it.forms, page).parts
        if it.kind == "text":
            own += [Part("char", g.bbox, g.text or f"(cid:{g.cid})", size=g.bbox[3] - g.bbox[1]) for g in it.glyphs]
        elif it.kind == "path":
            own += path_parts(it.segments, it.stroke, it.fill)
        elif it.kind == "image" and it.bbox:
            own.append(Part("image", it.bbox))
        elif it.kind == "xobject" and it.bbox:
            own.append(Part("figure", it.bbox))
            figures.append((own[-1], Container()))
            inside[*it.forms, it.stream.objid if it.stream else 0] = figures[-1][1]
    for figure, container in figures:
        figure.parts = container.analysed(p) if p.all_texts else container.parts
    return page.analysed(p)


def rows(parts: Sequence[Part]) -> Iterator[dict[str, Any]]:
    """The parts and what is in them as rows, parents first."""
    n = 0
    stack: list[tuple[Part, int | None, int]] = [(q, None, k) for k, q in reversed(list(enumerate(parts)))]
    while stack:
        part, parent, ordinal = stack.pop()
        yield {"item_id": n, "parent_id": parent, "kind": part.kind, "ordinal": ordinal, "reading_index": part.index, "writing_mode": "tb-rl" if part.vertical else "lr-tb", "text": part.text or None, "bbox": part.bbox}
        stack += [(q, n, k) for k, q in reversed(list(enumerate(part.parts)))]
        n += 1
