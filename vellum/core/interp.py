"""Content streams to objects: texts with glyphs, paths, images, forms and tags, in stream order."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field, fields
from operator import attrgetter
from typing import Any

from .document import Document, Page
from .fonts import Font
from .geometry import IDENTITY, Matrix, Point, Rect, apply, apply_vector, bound, moved, multiply, transform_rect, union
from .lexer import content_operations
from .values import Name, PdfError, Ref, Stream, number, numbers, plain, text_of

TEXT, PATH, IMAGE, FORM, TAG = "text", "path", "image", "xobject", "tag"
KINDS = (TEXT, PATH, IMAGE, FORM, TAG)
DEPTH = 32
#: What an image fills.
UNIT: Rect = (0.0,) * 2 + (1.0,) * 2


@dataclass(slots=True)
class State:
    """The graphics state, with the part of it that holds for texts."""

    linewidth: float = 1.0
    linecap: int = 0
    linejoin: int = 0
    miterlimit: float = 10.0
    dash: tuple[float, ...] = ()
    dash_phase: float = 0.0
    intent: str = "RelativeColorimetric"
    flatness: float = 1.0
    blend_mode: tuple[str, ...] = ("Normal",)
    salpha: float = 1.0
    nalpha: float = 1.0
    alpha_source: bool = False
    black_pt_comp: str = "Default"
    stroke_adjustment: bool = False
    smask: str | None = None
    knockout: bool = True
    scs: str = "DeviceGray"
    ncs: str = "DeviceGray"
    scolor: tuple[float, ...] = (0.0,)
    ncolor: tuple[float, ...] = (0.0,)
    spattern: str | None = None
    npattern: str | None = None
    sparts: int = 1
    nparts: int = 1
    font: Font | None = None
    fontsize: float = 1.0
    charspace: float = 0.0
    wordspace: float = 0.0
    scaling: float = 100.0
    leading: float = 0.0
    render_mode: int = 0
    rise: float = 0.0


_STATE = attrgetter(*(f.name for f in fields(State)))


def copied(state: State) -> State:
    return State(*_STATE(state))


@dataclass(slots=True)
class Mark:
    """A marked-content section; stream is the form that opens it (None: the page), key that stream's entry in the parent tree."""

    tag: str
    mcid: int | None
    props: dict[str, Any] = field(default_factory=dict)
    stream: int | None = None
    key: int | None = None


@dataclass(slots=True)
class Glyph:
    cid: int
    text: str
    matrix: Matrix
    displacement: Point
    bbox: Rect | None


#: Text of glyphs that follow each other directly, and where the first starts and the last ends.
Run = tuple[str, float, float, float, float]


@dataclass(slots=True)
class Item:
    """One painted thing. `forms` are the object numbers of the forms it lies in (0 for an inline one)."""

    kind: str
    seq: int
    ctm: Matrix
    state: State
    marks: tuple[Mark, ...]
    forms: tuple[int, ...]
    parent_key: int | None
    bbox: Rect | None = None
    # text; without boxes there are runs in place of glyphs
    glyphs: list[Glyph] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)
    n_glyphs: int = 0
    matrix: Matrix = IDENTITY
    end: Point = (0.0, 0.0)
    # path
    segments: list[tuple[str, list[Point]]] = field(default_factory=list)
    stroke: bool = False
    fill: bool = False
    evenodd: bool = False
    # image, form
    name: str | None = None
    stream: Stream | None = None
    #: the parent tree's own entry for an image or form
    own_key: int | None = None
    mark: Mark | None = None

    @property
    def numbered(self) -> Mark | None:
        """The innermost section with a number, which holds within its stream."""
        return next((m for m in reversed(self.marks) if m.mcid is not None), None)

    @property
    def chars(self) -> str:
        return "".join(r[0] for r in self.runs) if self.runs else "".join(g.text for g in self.glyphs)

    @property
    def mcid(self) -> int | None:
        return m.mcid if (m := self.numbered) else None


_DEVICE = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "CalGray": 1, "CalRGB": 3, "Lab": 3, "Indexed": 1, "Separation": 1, "Pattern": 1}
_SHORT = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def color_space(doc: Document, value: Any, named: dict[str, Any]) -> tuple[str, int]:
    """(family, components) of a colour space."""
    value = doc.resolve(value)
    if isinstance(value, str):
        said = _SHORT.get(str(value), str(value))
        if said in named:
            return color_space(doc, named[said], {})
        return said, _DEVICE.get(said, 1)
    if isinstance(value, list) and value:
        family = doc.resolve(value[0])
        if family == "ICCBased" and len(value) > 1:
            n = doc.resolve(doc.dict_of(value[1]).get("N"))
            return "ICCBased", n if type(n) is int else 3
        if family == "DeviceN" and len(value) > 1:
            return "DeviceN", len(doc.list_of(value[1]))
        if family == "Pattern" and len(value) > 1:
            return "Pattern", 1 + color_space(doc, value[1], named)[1]
        return color_space(doc, family, {}) if isinstance(family, str) else ("DeviceGray", 1)
    return "DeviceGray", 1


class Interpreter:
    """The items of a page. `kinds` are those wanted; others are followed but not built. Without boxes, texts have none, and runs in place of glyphs;
    without states, an item's state holds until the next item is asked for; without segments, paths have only their boxes."""

    def __init__(self, doc: Document, page: Page, space: str = "screen", kinds: Collection[str] = KINDS, flat: bool = True, fonts: dict[Any, Font] | None = None, boxes: bool = True, states: bool = True, segments: bool = True) -> None:
        self.doc, self.page, self.kinds, self.flat, self.boxes, self.states, self.segments = doc, page, frozenset(kinds), flat, boxes, states, segments
        self.base = page.ctm(space)
        self.seq = 0
        self.fonts: dict[Any, Font] = {} if fonts is None else fonts

    def __iter__(self) -> Iterator[Item]:
        body = []
        for s in self.page.contents:
            try:
                body.append(self.doc.stream_bytes(s))
            except PdfError as e:
                self.doc.warnings.append(f"page {self.page.index}: {e}")
        key = self.doc.resolve(self.page.attrs.get("StructParents"))
        yield from self.run(b"\n".join(body), self.doc.dict_of(self.page.attrs.get("Resources")), self.base, State(), (), (), key if type(key) is int else None)

    def font(self, resources: dict[str, Any], name: str) -> Font:
        ref = self.doc.dict_of(resources.get("Font")).get(name)
        return self.font_of(ref, name)

    def font_of(self, ref: Any, name: str) -> Font:
        key: Any = ref.objid if isinstance(ref, Ref) else ("direct", name, repr(ref))
        if key not in self.fonts:
            attrs = self.doc.dict_of(ref)
            if not attrs:
                self.doc.warnings.append(f"page {self.page.index}: no font {name}")
            self.fonts[key] = Font(self.doc, attrs, ref.objid if isinstance(ref, Ref) else None)
        return self.fonts[key]

    def run(self, data: bytes, resources: dict[str, Any], ctm: Matrix, state: State, marks: tuple[Mark, ...], forms: tuple[int, ...], parent_key: int | None) -> Iterator[Item]:
        doc = self.doc
        spaces, properties, xobjects = (doc.dict_of(resources.get(k)) for k in ("ColorSpace", "Properties", "XObject"))
        saved: list[tuple[Matrix, State, Matrix, Point]] = []
        stack = list(marks)
        path: list[tuple[str, list[Point]]] = []
        line, pen = IDENTITY, [0.0, 0.0]
        uncoloured = False

        def item(kind: str, **more: Any) -> Item:
            return Item(kind, self.seq, ctm, copied(state) if self.states else state, tuple(stack), forms, parent_key, **more)

        def paint(stroke: bool, fill: bool, evenodd: bool, close: bool) -> Iterator[Item]:
            nonlocal path
            if close and path:
                path.append(("h", []))
            if path and PATH in self.kinds:
                points = [p for _, ps in path for p in ps]
                own = [(op, [apply(ctm, p) for p in ps]) for op, ps in path] if self.segments else []
                yield item(PATH, segments=own, stroke=stroke, fill=fill, evenodd=evenodd, bbox=transform_rect(ctm, bound(points)) if points else None)
            path = []

        def mark_of(tag: Any, props: Any = None) -> Mark:
            found = properties.get(str(props)) if isinstance(props, Name) else props
            d = doc.dict_of(found)
            mcid = doc.resolve(d.get("MCID"))
            return Mark(str(tag), mcid if type(mcid) is int else None, {k: doc.resolve(v) for k, v in d.items() if k != "MCID"}, forms[-1] if forms else None, parent_key)

        def show(parts: list[Any]) -> Iterator[Item]:
            nonlocal pen
            font = state.font
            if font is None:
                font = state.font = self.font_of(None, "(none)")
            size, scale = state.fontsize, state.scaling * 0.01
            rise = state.rise
            wanted = TEXT in self.kinds
            found: list[Glyph] = []
            base = multiply(line, ctm)
            shape = (size * scale * base[0], size * scale * base[1], size * base[2], size * base[3])

            def placed() -> Matrix:
                x, y = pen[0], pen[1] + rise
                return (*shape, x * base[0] + y * base[2] + base[4], x * base[1] + y * base[3] + base[5])

            start: Matrix | None = None
            vertical = font.vertical
            if not vertical and not self.boxes:
                runs, count = [], 0
                steps = font.steps(size, state.charspace, state.wordspace, scale)
                for part in parts:
                    if isinstance(part, int | float) and not isinstance(part, bool):
                        pen[0] -= part * 0.001 * size * scale
                    elif isinstance(part, bytes) and (found_codes := font.codes(part))[0]:
                        codes, said = found_codes
                        here = placed()
                        start = start or here
                        at, last = pen[0], 0.0
                        before = at
                        for cid in codes:
                            before = at
                            last = steps[cid]
                            at += last
                        if wanted:
                            count += len(codes)
                            y = pen[1] + rise
                            dx, dy = apply_vector(base, (last, 0.0))
                            x, y = before * base[0] + y * base[2] + base[4] + dx, before * base[1] + y * base[3] + base[5] + dy
                            if len(codes) == 1 or -1e9 < here[4] < 1e9 and -1e9 < x < 1e9:
                                runs.append((said, here[4], here[5], x, y))
                            else:  # too far out for sums to tell gaps
                                for k, (cid, own) in enumerate(font.decode(part)):
                                    if k:
                                        here = placed()
                                    dx, dy = apply_vector(base, (steps[cid], 0.0))
                                    runs.append((own, here[4], here[5], here[4] + dx, here[5] + dy))
                                    pen[0] += steps[cid]
                        pen[0] = at
                if wanted and start is not None:
                    stop = placed()
                    yield item(TEXT, runs=runs, n_glyphs=count, matrix=start, end=(stop[4], stop[5]))
                return
            for part in parts:
                if isinstance(part, int | float) and not isinstance(part, bool):
                    if vertical:
                        pen[1] -= part * 0.001 * size
                    else:
                        pen[0] -= part * 0.001 * size * scale
                    continue
                if not isinstance(part, bytes):
                    continue
                for cid, text in font.decode(part):
                    here = placed()
                    start = start or here
                    step = font.advance(cid) * size + state.charspace + (state.wordspace if cid == 32 and not font.multibyte else 0.0)
                    dx, dy = (0.0, step) if vertical else (step * scale, 0.0)
                    if wanted:
                        box = transform_rect(here, font.box(cid)) if self.boxes else None
                        found.append(Glyph(cid, text, here, apply_vector(base, (dx, dy)), box))
                    pen[0] += dx
                    pen[1] += dy
            if wanted and start is not None:
                stop = placed()
                yield item(TEXT, glyphs=found, n_glyphs=len(found), matrix=start, end=(stop[4], stop[5]), bbox=union(g.bbox for g in found) if self.boxes else None)

        def next_line(x: float, y: float) -> None:
            nonlocal line, pen
            line = moved(line, x, y)
            pen = [0.0, 0.0]

        def color(args: list[Any], stroking: bool) -> None:
            if uncoloured:
                return
            family, parts = (state.scs, state.sparts) if stroking else (state.ncs, state.nparts)
            name = str(args.pop()) if args and isinstance(args[-1], Name) else None
            count = parts - 1 if family == "Pattern" else parts
            values = [number(v) for v in args[-count:]] if count else []
            values += [0.0] * (count - len(values))
            if stroking:
                state.scolor, state.spattern = tuple(values), name
            else:
                state.ncolor, state.npattern = tuple(values), name

        def device(family: str, args: list[Any], stroking: bool) -> None:
            if stroking:
                state.scs, state.sparts = family, _DEVICE[family]
            else:
                state.ncs, state.nparts = family, _DEVICE[family]
            color(args, stroking)

        def external(name: Any) -> None:
            gs = doc.dict_of(doc.dict_of(resources.get("ExtGState")).get(str(name)))
            for k, v in gs.items():
                v = doc.resolve(v)
                if k in _STATE_NUMBERS and isinstance(v, int | float):
                    setattr(state, _STATE_NUMBERS[k], int(v) if k in ("LC", "LJ") else float(v))
                elif k == "D" and isinstance(v, list) and len(v) == 2:
                    state.dash, state.dash_phase = tuple(number(doc.resolve(x)) for x in doc.list_of(v[0])), number(doc.resolve(v[1]))
                elif k == "RI":
                    state.intent = str(v)
                elif k == "Font" and isinstance(v, list) and len(v) == 2:
                    state.font, state.fontsize = self.font_of(v[0], "(state)"), number(doc.resolve(v[1]), 1.0)
                elif k == "BM":
                    state.blend_mode = tuple(str(doc.resolve(x)) for x in v) if isinstance(v, list) else (str(v),)
                elif k == "SMask":
                    state.smask = None if v == "None" else "dict"
                elif k == "AIS":
                    state.alpha_source = bool(v)
                elif k == "TK":
                    state.knockout = bool(v)
                elif k == "SA":
                    state.stroke_adjustment = bool(v)
                elif k == "UseBlackPtComp":
                    state.black_pt_comp = str(v)

        def invoke(name: Any) -> Iterator[Item]:
            ref = xobjects.get(str(name))
            form = doc.resolve(ref)
            if not isinstance(form, Stream):
                doc.warnings.append(f"page {self.page.index}: no XObject {name}")
                return
            kind = doc.resolve(form.attrs.get("Subtype"))
            objid = ref.objid if isinstance(ref, Ref) else 0
            own_key = doc.resolve(form.attrs.get("StructParent"))
            if kind == "Image":
                if IMAGE in self.kinds:
                    yield item(IMAGE, name=str(name), stream=form, bbox=transform_rect(ctm, UNIT), own_key=own_key if type(own_key) is int else None)
                return
            if kind != "Form" and "BBox" not in form.attrs:
                return
            m = numbers(doc.resolve_all(form.attrs.get("Matrix")), 6)
            inner = multiply((m[0], m[1], m[2], m[3], m[4], m[5]), ctm) if m else ctm
            box = numbers(doc.resolve_all(form.attrs.get("BBox")), 4)
            if FORM in self.kinds:
                shape = transform_rect(inner, (box[0], box[1], box[2], box[3])) if box else transform_rect(self.base, self.page.cropbox)
                x = item(FORM, name=str(name), stream=form, bbox=shape, own_key=own_key if type(own_key) is int else None)
                x.ctm = inner
                yield x
            if not self.flat or objid in forms and objid:
                return
            if len(forms) >= DEPTH:
                doc.warnings.append(f"page {self.page.index}: forms deeper than {DEPTH} aren't followed")
                return
            try:
                body = doc.stream_bytes(form)
            except PdfError as e:
                doc.warnings.append(f"form {objid}: {e}")
                return
            key = doc.resolve(form.attrs.get("StructParents"))
            fresh = copied(state)
            plain_text = State()
            for k in ("font", "fontsize", "charspace", "wordspace", "scaling", "leading", "render_mode", "rise"):
                setattr(fresh, k, getattr(plain_text, k))
            yield from self.run(body, doc.dict_of(form.attrs.get("Resources")) or resources, inner, fresh, tuple(stack), (*forms, objid), key if type(key) is int else parent_key)

        for self_pos, op, args in content_operations(data):
            count = _COUNTS.get(op)
            if count is None:
                continue  # unknown words don't matter
            if count and len(args) < count:
                doc.warnings.append(f"page {self.page.index}: {op} at {self_pos} has {len(args)} operands")
                continue
            if count and op not in _FREE:
                args = args[-count:]
            self.seq += 1
            try:
                if op == "Tj":
                    yield from show([args[0]])
                elif op == "T*":
                    next_line(0.0, -state.leading)
                elif op == "q":
                    saved.append((ctm, copied(state), line, (pen[0], pen[1])))
                elif op == "Q":
                    if saved:
                        ctm, state, line, at = saved.pop()
                        pen = list(at)
                elif op == "cm":
                    ctm = multiply(tuple(_reals(args)), ctm)
                elif op in _SIMPLE:
                    setattr(state, _SIMPLE[op][0], _SIMPLE[op][1](args[0]))
                elif op == "d":
                    state.dash, state.dash_phase = tuple(_reals(args[0])), _real(args[1])
                elif op == "gs":
                    external(args[0])
                elif op in ("m", "l"):
                    path.append((op, [tuple(_reals(args))]))
                elif op == "c":
                    x = _reals(args)
                    path.append(("c", [(x[0], x[1]), (x[2], x[3]), (x[4], x[5])]))
                elif op in ("v", "y"):
                    x = _reals(args)
                    path.append((op, [(x[0], x[1]), (x[2], x[3])]))
                elif op == "h":
                    path.append(("h", []))
                elif op == "re":
                    x, y, w, h = _reals(args)
                    path += [("m", [(x, y)]), ("l", [(x + w, y)]), ("l", [(x + w, y + h)]), ("l", [(x, y + h)]), ("h", [])]
                elif op in _PAINT:
                    yield from paint(*_PAINT[op])
                elif op == "n":
                    path = []
                elif op in ("CS", "cs"):
                    found = color_space(doc, args[0], spaces)
                    if op == "CS":
                        state.scs, state.sparts = found
                    else:
                        state.ncs, state.nparts = found
                elif op in _DEVICE_OPS:
                    device(_DEVICE_OPS[op], args, op.isupper())
                elif op in ("SC", "SCN", "sc", "scn"):
                    color(args, op.isupper())
                elif op == "BT":
                    line, pen = IDENTITY, [0.0, 0.0]
                elif op == "Tf":
                    state.font, state.fontsize = self.font(resources, str(args[0])), _real(args[1])
                elif op == "Td":
                    next_line(*_reals(args))
                elif op == "TD":
                    x, y = _reals(args)
                    state.leading = -y
                    next_line(x, y)
                elif op == "Tm":
                    line, pen = tuple(_reals(args)), [0.0, 0.0]
                elif op == "TJ":
                    yield from show(args[0] if isinstance(args[0], list) else [args[0]])
                elif op == "'":
                    next_line(0.0, -state.leading)
                    yield from show([args[0]])
                elif op == '"':
                    state.wordspace, state.charspace = _real(args[0]), _real(args[1])
                    yield from show([args[2]])
                elif op == "EI":
                    if IMAGE in self.kinds:
                        yield item(IMAGE, stream=args[0], bbox=transform_rect(ctm, UNIT))
                elif op == "Do":
                    yield from invoke(args[0])
                elif op == "BMC":
                    stack.append(mark_of(args[0]))
                elif op == "BDC":
                    stack.append(mark_of(args[0], args[1]))
                elif op == "EMC":
                    if len(stack) > len(marks):
                        stack.pop()
                elif op in ("MP", "DP"):
                    if TAG in self.kinds:
                        yield item(TAG, mark=mark_of(*args))
                elif op == "d1":
                    uncoloured = True
            except (TypeError, ValueError, IndexError, PdfError) as e:
                doc.warnings.append(f"page {self.page.index}: {op} at {self_pos}: {e}")

    def glyph_items(self, item: Item, glyph: Glyph) -> Iterator[Item]:
        """What a Type 3 glyph paints."""
        font = item.state.font
        proc = font.procs.get(glyph.cid) if font else None
        if proc is not None:
            resources = self.doc.dict_of(font.attrs.get("Resources")) or self.doc.dict_of(self.page.attrs.get("Resources"))
            yield from self.run(self.doc.stream_bytes(proc), resources, multiply(font.matrix, glyph.matrix), copied(item.state), item.marks, item.forms, item.parent_key)


def _real(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise TypeError(f"{x!r} is no number")
    return float(x)


def _reals(xs: list[Any]) -> list[float]:
    return [_real(x) for x in xs]


_SIMPLE: dict[str, tuple[str, Callable[[Any], Any]]] = {
    "w": ("linewidth", _real), "J": ("linecap", int), "j": ("linejoin", int), "M": ("miterlimit", _real), "ri": ("intent", str), "i": ("flatness", _real),
    "Tc": ("charspace", _real), "Tw": ("wordspace", _real), "Tz": ("scaling", _real), "TL": ("leading", _real), "Tr": ("render_mode", int), "Ts": ("rise", _real),
}
_STATE_NUMBERS = {"LW": "linewidth", "LC": "linecap", "LJ": "linejoin", "ML": "miterlimit", "FL": "flatness", "CA": "salpha", "ca": "nalpha"}
#: stroke, fill, even-odd, close
_PAINT = {
    "S": (True, False, False, False), "s": (True, False, False, True), "f": (False, True, False, False), "F": (False, True, False, False), "f*": (False, True, True, False),
    "B": (True, True, False, False), "b": (True, True, False, True), "B*": (True, True, True, False), "b*": (True, True, True, True),
}
_DEVICE_OPS = {"G": "DeviceGray", "g": "DeviceGray", "RG": "DeviceRGB", "rg": "DeviceRGB", "K": "DeviceCMYK", "k": "DeviceCMYK"}
_COUNTS = {op: 1 for op in (*_SIMPLE, "gs", "CS", "cs", "G", "g", "Tj", "TJ", "'", "EI", "Do", "BMC", "MP")}
_COUNTS |= dict.fromkeys((*_PAINT, "q", "Q", "h", "n", "W", "W*", "BT", "ET", "BX", "EX", "T*", "EMC", "SC", "SCN", "sc", "scn"), 0)
_COUNTS |= {"cm": 6, "d": 2, "m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4, "RG": 3, "rg": 3, "K": 4, "k": 4, "Tf": 2, "Td": 2, "TD": 2, "Tm": 6, '"': 3, "BDC": 2, "DP": 2, "d0": 2, "d1": 6, "sh": 1}
_FREE = {"SC", "SCN", "sc", "scn"}
OPERATORS = frozenset(_COUNTS)


def image_attrs(doc: Document, stream: Stream, spaces: dict[str, Any] | None = None) -> dict[str, Any]:
    """Width, height, bits, colour space and filters of an image."""
    a = stream.attrs
    w, h, bits = (doc.resolve(a.get(k)) for k in ("Width", "Height", "BitsPerComponent"))
    mask = bool(doc.resolve(a.get("ImageMask")))
    family, parts = color_space(doc, a.get("ColorSpace"), spaces or {}) if "ColorSpace" in a else ("DeviceGray", 1)
    return {"width": w if type(w) is int else 1, "height": h if type(h) is int else 1, "bits": bits if type(bits) is int else 1, "colorspace": family, "components": parts, "mask": mask, "filters": [f for f, _ in doc.filters(stream)]}


def text_record(t: Item) -> dict[str, Any]:
    """What text extraction needs of a text item."""
    font = t.state.font
    inner = t.marks[-1] if t.marks else None
    actual = inner.props.get("ActualText") if inner else None
    return {
        "chars": t.chars,
        "glyphs": t.runs or [(g.text, g.matrix[4], g.matrix[5], g.matrix[4] + g.displacement[0], g.matrix[5] + g.displacement[1]) for g in t.glyphs],
        "vertical": bool(font and font.vertical),
        "origin": (t.matrix[4], t.matrix[5]),
        "end": t.end,
        "mcid": t.mcid,
        "tag": inner.tag if inner else None,
        "actual": text_of(actual) if isinstance(actual, bytes) else None,
        "props": plain(inner.props) if inner else None,
    }
