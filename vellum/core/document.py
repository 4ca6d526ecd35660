"""One file: its cross references, objects, pages and the relations between them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from .codecs import decoded, filter_list
from .crypto import Security
from .geometry import Matrix, Rect, initial_matrix, normal_rect, transform_rect
from .lexer import Parser, indirect_object, parse_one, physical_objects
from .values import Keyword, Name, PdfError, Ref, Stream, SyntaxProblem, number, numbers, text_of

LETTER: Rect = (0.0, 0.0, 612.0, 792.0)
_TRAILERS = re.compile(rb"trailer\s*(?=<<)")


@dataclass(slots=True)
class Entry:
    """Where an object is: at a position, or as a member of an object stream."""

    section: int
    kind: str  # table, stream or rebuilt
    objid: int
    genno: int
    pos: int | None = None
    container: int | None = None
    index: int | None = None
    free: bool = False


@dataclass(slots=True)
class Page:
    index: int
    objid: int | None
    attrs: dict[str, Any]
    mediabox: Rect
    cropbox: Rect
    rotate: int
    label: str = ""
    contents: list[Stream] = field(default_factory=list)

    def ctm(self, space: str = "screen") -> Matrix:
        return initial_matrix(self.mediabox, self.rotate, space)


def _int(value: Any, default: int = 0) -> int:
    return value if type(value) is int else default


class Document:
    """Lazily reads what is asked for; problems that don't stop it are kept in `warnings`."""

    def __init__(self, data: bytes, password: str = "", strict: bool = False) -> None:
        self.data, self.strict = data, strict
        self.warnings: list[str] = []
        #: Where CMap files lie, by their names.
        self.cmap_folder: str | None = None
        self.security: Security | None = None
        m = re.search(rb"%PDF-(\d\.\d)?", data)
        self.offset = m.start() if m else 0
        if not m:
            self.warnings.append("no header")
        self.header_version = m[1].decode() if m and m[1] else "1.0"
        self.entries: list[Entry] = []
        self.trailers: list[dict[str, Any]] = []
        self._cache: dict[int, Any] = {}
        self._members: dict[int, list[tuple[int, Any]]] = {}
        self._decoded: dict[int, bytes] = {}
        self._busy: set[int] = set()
        self.rebuilt = False
        try:
            self._read_chain()
            if not any("Root" in t for t in self.trailers):
                raise SyntaxProblem("no trailer names the catalog")
        except (PdfError, ValueError, TypeError, IndexError, KeyError, AttributeError) as e:
            self.warnings.append(f"cross references rebuilt: {e}")
            self._rebuild()
        self._index()
        encrypt = self.resolve(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            ids = self.resolve(self.trailer.get("ID"))
            first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
            encrypt = {k: self.resolve_all(v) for k, v in encrypt.items()}
            self.security = Security(encrypt, first if isinstance(first, bytes) else b"", password)
            self._encrypt_id = self.trailer["Encrypt"].objid if isinstance(self.trailer.get("Encrypt"), Ref) else None
            self._cache.clear()
            self._members.clear()
            self._decoded.clear()

    # cross references

    @property
    def trailer(self) -> dict[str, Any]:
        """The trailers as one: the newest section's keys go first."""
        out: dict[str, Any] = {}
        for t in reversed(self.trailers):
            out |= t
        return out

    def _read_chain(self) -> None:
        at = self.data.rfind(b"startxref")
        m = re.compile(rb"startxref\s*(\d+)").match(self.data, at) if at >= 0 else None
        if not m:
            raise SyntaxProblem("no startxref")
        waiting, seen = [int(m[1])], set()
        while waiting:
            pos = waiting.pop(0)
            if pos in seen:
                continue
            seen.add(pos)
            trailer = self._read_section(pos + self.offset)
            self.trailers.append(trailer)
            # a hybrid file's stream goes before the older section
            waiting = [p for p in (trailer.get("XRefStm"), trailer.get("Prev")) if type(p) is int] + waiting

    def _read_section(self, at: int) -> dict[str, Any]:
        section = len(self.trailers)
        m = re.compile(rb"\s*xref\s*").match(self.data, at)
        if not m:
            return self._read_stream_section(at, section)
        at = m.end()
        head = re.compile(rb"\s*(\d+)\s+(\d+)\s*?[\r\n]+\s*|\s*(\d+)\s+(\d+)[ ]+(?=\d{10})")
        row = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
        while h := head.match(self.data, at):
            first, count = int(h[1] or h[3]), int(h[2] or h[4])
            at = h.end()
            for k in range(count):
                r = row.match(self.data, at)
                if not r:
                    raise SyntaxProblem(f"a cross reference row at {at}")
                at = r.end()
                free = r[3] == b"f"
                self.entries.append(Entry(section, "table", first + k, int(r[2]), None if free else int(r[1]) + self.offset, free=free))
        t = re.compile(rb"\s*trailer\s*").match(self.data, at)
        trailer = parse_one(self.data, t.end()) if t else None
        if not isinstance(trailer, dict):
            raise SyntaxProblem(f"no trailer at {at}")
        return trailer

    def _read_stream_section(self, at: int, section: int) -> dict[str, Any]:
        _, _, stream, _ = indirect_object(self.data, at)
        if not isinstance(stream, Stream) or stream.attrs.get("Type") != "XRef":
            raise SyntaxProblem(f"no cross references at {at}")
        attrs = stream.attrs
        widths = [_int(w) for w in attrs["W"]]
        body = decoded(stream.raw, filter_list(attrs))
        index = attrs.get("Index") or [0, _int(attrs.get("Size"))]
        size, k = sum(widths), 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for objid in range(first, first + count):
                row = body[k : k + size]
                k += size
                if len(row) < size:
                    break
                cut = [0, widths[0], widths[0] + widths[1], size]
                kind, a, b = (int.from_bytes(row[x:y], "big") if y > x else None for x, y in zip(cut, cut[1:], strict=False))
                kind = 1 if kind is None else kind
                if kind == 0:
                    self.entries.append(Entry(section, "stream", objid, b or 0, free=True))
                elif kind == 1:
                    self.entries.append(Entry(section, "stream", objid, b or 0, (a or 0) + self.offset))
                elif kind == 2:
                    self.entries.append(Entry(section, "stream", objid, 0, container=a, index=b or 0))
        return attrs

    def _rebuild(self) -> None:
        """Every object that the bytes hold, a later one of the same or a higher generation replacing an earlier."""
        self.rebuilt = True
        self.entries, self.trailers = [], []
        self._cache.clear()
        best: dict[int, Entry] = {}
        for pos, objid, genno in physical_objects(self.data):
            if objid not in best or genno >= best[objid].genno:
                best.pop(objid, None)
                best[objid] = Entry(0, "rebuilt", objid, genno, pos)
        for e in list(best.values()):
            head = self.data[e.pos : e.pos + 400]
            if b"ObjStm" not in head and b"XRef" not in head:
                continue
            try:
                _, _, stream, _ = indirect_object(self.data, e.pos)
                if isinstance(stream, Stream) and stream.attrs.get("Type") == "ObjStm":
                    for k, (objid, _) in enumerate(self._stream_members(stream)):
                        best.setdefault(objid, Entry(0, "rebuilt", objid, 0, container=e.objid, index=k))
                elif isinstance(stream, Stream) and "Root" in stream.attrs:
                    self.trailers.insert(0, {k: v for k, v in stream.attrs.items() if k in ("Root", "Info", "ID", "Encrypt", "Size")})
            except (PdfError, ValueError, TypeError) as err:
                self.warnings.append(f"object {e.objid}: {err}")
        self.entries = list(best.values())
        for m in _TRAILERS.finditer(self.data):
            if isinstance(t := parse_one(self.data, m.end()), dict):
                self.trailers.insert(0, t)
        if not any("Root" in t for t in self.trailers):
            self._index()
            for e in self.entries:
                v = self._load(e)
                if isinstance(v, dict) and v.get("Type") == "Catalog":
                    self.trailers.append({"Root": Ref(e.objid, e.genno)})
                    break

    def _index(self) -> None:
        self._where: dict[int, list[Entry]] = {}
        for e in self.entries:
            if not e.free:
                self._where.setdefault(e.objid, []).append(e)

    # objects

    def _length(self, value: Any) -> Any:
        if isinstance(value, Ref) and hasattr(self, "_where"):
            return self.resolve(value)
        return value

    def _load(self, e: Entry) -> Any:
        if e.container is not None:
            members = self.members(e.container)
            if e.index is not None and e.index < len(members) and members[e.index][0] == e.objid:
                return members[e.index][1]
            return next((v for i, v in members if i == e.objid), None)
        if e.pos is None:
            return None
        objid, genno, value, _ = indirect_object(self.data, e.pos, self._length, self.strict)
        if objid != e.objid:
            raise SyntaxProblem(f"object {objid} where {e.objid} should be")
        return self.opened(objid, genno, value)

    def opened(self, objid: int, genno: int, value: Any) -> Any:
        if self.security and objid != getattr(self, "_encrypt_id", None):
            return self.security.decipher_strings(objid, genno, value)
        return value

    def _stream_members(self, stream: Stream) -> list[tuple[int, Any]]:
        body = self.stream_bytes(stream)
        n, first = _int(self.resolve(stream.attrs.get("N"))), _int(self.resolve(stream.attrs.get("First")))
        head = [v for _, v in Parser(body, 0, first) if type(v) is int][: 2 * n]
        out = []
        for objid, at in zip(head[::2], head[1::2], strict=False):
            out.append((objid, next((v for _, v in Parser(body, first + at)), None)))
        return out

    def members(self, container: int) -> list[tuple[int, Any]]:
        """(object number, value) of an object stream's members."""
        if container not in self._members:
            stream = self.get(container)
            self._members[container] = self._stream_members(stream) if isinstance(stream, Stream) else []
        return self._members[container]

    def get(self, objid: int) -> Any:
        """An object by its number, from the newest section that has it; None where there is none."""
        if objid in self._cache:
            return self._cache[objid]
        if objid in self._busy:
            return None
        self._busy.add(objid)
        value = None
        try:
            for e in self._where.get(objid, ()):
                try:
                    value = self._load(e)
                    break
                except (PdfError, ValueError, TypeError) as err:
                    self.warnings.append(f"object {objid}: {err}")
                    if not self.rebuilt:
                        trailers = self.trailers
                        self._rebuild()
                        self.trailers = self.trailers or trailers
                        self._index()
                        self._busy.discard(objid)
                        return self.get(objid)
        finally:
            self._busy.discard(objid)
        self._cache[objid] = value
        return value

    def resolve(self, value: Any) -> Any:
        for _ in range(64):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.objid)
        return None

    def resolve_all(self, value: Any, path: tuple[int, ...] = ()) -> Any:
        """A copy without references; what would lead back into itself stays a reference."""
        if isinstance(value, Ref):
            return value if value.objid in path else self.resolve_all(self.get(value.objid), (*path, value.objid))
        if isinstance(value, list):
            return [self.resolve_all(v, path) for v in value]
        if isinstance(value, dict):
            return {k: self.resolve_all(v, path) for k, v in value.items()}
        return value

    def dict_of(self, value: Any) -> dict[str, Any]:
        value = self.resolve(value)
        return value.attrs if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def list_of(self, value: Any) -> list[Any]:
        value = self.resolve(value)
        return value if isinstance(value, list) else []

    def filters(self, stream: Stream) -> list[tuple[str, dict[str, Any]]]:
        attrs = {k: self.resolve_all(v) for k, v in stream.attrs.items() if k in ("Filter", "F", "DecodeParms", "DP", "FDecodeParms")}
        return filter_list(attrs)

    def stream_bytes(self, stream: Stream) -> bytes:
        """Deciphered and decoded."""
        if (known := self._decoded.get(id(stream))) is not None:
            return known
        raw = stream.raw
        if stream.decipher is not None and stream.objid is not None:
            raw = stream.decipher.decipher(stream.objid, stream.genno, raw)
        out = decoded(raw, self.filters(stream))
        self._decoded[id(stream)] = out
        self._cache.setdefault(-id(stream), stream)  # keeps the stream, and so its id, alive
        return out

    def all_objects(self) -> Iterator[tuple[int, int, int, int | None, Any]]:
        """(position, number, generation, container, value) of every object in the bytes, old revisions too."""
        end = -1
        for pos, objid, genno in physical_objects(self.data):
            if pos < end:  # within the object before
                continue
            try:
                objid, genno, value, end = indirect_object(self.data, pos, self._length)
                value = self.opened(objid, genno, value)
                yield pos, objid, genno, None, value
                if isinstance(value, Stream) and value.attrs.get("Type") == "ObjStm":
                    for member, v in self._stream_members(value):
                        yield pos, member, 0, objid, v
            except (PdfError, ValueError, TypeError) as err:
                self.warnings.append(f"object at {pos}: {err}")

    # the document

    @property
    def catalog(self) -> dict[str, Any]:
        return self.dict_of(self.trailer.get("Root"))

    @property
    def version(self) -> str:
        v = self.resolve(self.catalog.get("Version"))
        return str(v) if isinstance(v, str) else self.header_version

    @property
    def tagged(self) -> bool:
        return bool(self.resolve(self.dict_of(self.catalog.get("MarkInfo")).get("Marked")))

    @property
    def permissions(self) -> tuple[bool, bool, bool]:
        return self.security.permissions if self.security else (True, True, True)

    def pages(self) -> list[Page]:
        if not hasattr(self, "_pages"):
            self._pages = list(self._walk_pages())
            for page, label in zip(self._pages, self.labels(len(self._pages)), strict=True):
                page.label = label
            self._page_ids: dict[int, int] = {}
            for p in self._pages:
                if p.objid is not None:
                    self._page_ids.setdefault(p.objid, p.index)
        return self._pages

    def page_of(self, value: Any) -> int | None:
        """The index of the page that a reference leads to."""
        self.pages()
        return self._page_ids.get(value.objid) if isinstance(value, Ref) else None

    def _walk_pages(self) -> Iterator[Page]:
        inherited = ("Resources", "MediaBox", "CropBox", "Rotate")
        root = self.catalog.get("Pages")
        index, seen = 0, set()
        if not self.dict_of(root):
            for e in self.entries:
                v = self.get(e.objid)
                if isinstance(v, dict) and v.get("Type") == "Page" and e.objid not in seen:
                    seen.add(e.objid)
                    yield self._page(index, e.objid, v)
                    index += 1
            return
        stack: list[tuple[Any, dict[str, Any]]] = [(root, {})]
        while stack:
            ref, above = stack.pop()
            if isinstance(ref, Ref):
                if ref.objid in seen:
                    self.warnings.append(f"page tree visits {ref.objid} again")
                    continue
                seen.add(ref.objid)
            node = self.resolve(ref)
            objid = ref.objid if isinstance(ref, Ref) else None
            if not isinstance(node, dict):
                self.warnings.append("a missing page")
                yield self._page(index, objid, {})
                index += 1
                continue
            own = above | {k: node[k] for k in inherited if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and self.resolve(node.get("Type")) != "Page":
                stack += [(kid, own) for kid in reversed(kids)]
            else:
                yield self._page(index, objid, own | node)
                index += 1

    def _box(self, value: Any) -> Rect | None:
        value = self.resolve_all(value)
        found = numbers(value, 4)
        return normal_rect((found[0], found[1], found[2], found[3])) if found else None

    def _page(self, index: int, objid: int | None, attrs: dict[str, Any]) -> Page:
        media = self._box(attrs.get("MediaBox")) or LETTER
        crop = self._box(attrs.get("CropBox")) or media
        rotate = (_int(self.resolve(attrs.get("Rotate"))) + 360) % 360
        content = self.resolve(attrs.get("Contents"))
        parts = [self.resolve(c) for c in (content if isinstance(content, list) else [content])]
        return Page(index, objid, attrs, media, crop, rotate, contents=[p for p in parts if isinstance(p, Stream)])

    def label_ranges(self) -> list[tuple[int, str | None, str, int]]:
        """(first page, style, prefix, start) of each range of labels, in order."""
        out = []
        for first, v in sorted((k, v) for k, v in self.number_tree(self.catalog.get("PageLabels"))):
            d = self.dict_of(v)
            style, prefix = self.resolve(d.get("S")), self.resolve(d.get("P"))
            out.append((first, str(style) if isinstance(style, str) else None, text_of(prefix) if isinstance(prefix, bytes) else "", _int(self.resolve(d.get("St")), 1)))
        if out and out[0][0] != 0:
            out[0] = (0, *out[0][1:])
        return out

    def labels(self, count: int) -> list[str]:
        from .text import numeral

        ranges = self.label_ranges()
        if not ranges:
            return [str(i + 1) for i in range(count)]
        out, k = [], 0
        for i in range(count):
            while k + 1 < len(ranges) and ranges[k + 1][0] <= i:
                k += 1
            first, style, prefix, start = ranges[k]
            out.append(prefix + numeral(start + i - first, style))
        return out

    # trees

    def _tree(self, root: Any, leaf: str) -> Iterator[tuple[Any, Any]]:
        stack, seen = [root], set()
        while stack:
            ref = stack.pop()
            if isinstance(ref, Ref):
                if ref.objid in seen:
                    continue
                seen.add(ref.objid)
            node = self.dict_of(ref)
            items = self.list_of(node.get(leaf))
            for k, v in zip(items[::2], items[1::2], strict=False):
                yield self.resolve(k), v
            stack += reversed(self.list_of(node.get("Kids")))

    def number_tree(self, root: Any) -> Iterator[tuple[int, Any]]:
        return ((k, v) for k, v in self._tree(root, "Nums") if type(k) is int)

    def name_tree(self, root: Any) -> Iterator[tuple[bytes, Any]]:
        return ((k, v) for k, v in self._tree(root, "Names") if isinstance(k, bytes))

    def tree_lookup(self, root: Any, key: Any, leaf: str) -> Any:
        """The value of a key by the nodes' limits."""
        stack, seen = [root], set()
        while stack:
            ref = stack.pop()
            if isinstance(ref, Ref):
                if ref.objid in seen:
                    continue
                seen.add(ref.objid)
            node = self.dict_of(ref)
            limits = [self.resolve(x) for x in self.list_of(node.get("Limits"))]
            if len(limits) == 2 and type(limits[0]) is type(limits[1]) is type(key) and not limits[0] <= key <= limits[1]:
                continue
            items = self.list_of(node.get(leaf))
            for k, v in zip(items[::2], items[1::2], strict=False):
                if self.resolve(k) == key:
                    return v
            stack += reversed(self.list_of(node.get("Kids")))
        return None

    # destinations, actions, outline

    def destinations(self) -> Iterator[tuple[str, Any]]:
        old = self.dict_of(self.catalog.get("Dests"))
        if old:
            yield from old.items()
        names = self.dict_of(self.catalog.get("Names"))
        for k, v in self.name_tree(names.get("Dests")):
            yield text_of(k), v

    def destination(self, value: Any, names: bool = True) -> dict[str, Any] | None:
        """What a destination shows: a name is looked up; positions are in the default space."""
        value = self.resolve(value)
        if isinstance(value, bytes | str) and not isinstance(value, Keyword) and names:
            key = text_of(value) if isinstance(value, bytes) else str(value)
            if not hasattr(self, "_dests"):
                self._dests: dict[str, Any] = {}
                for k, v in self.destinations():
                    self._dests.setdefault(k, v)
            return self.destination(self._dests.get(key), False)
        if isinstance(value, dict):
            value = self.resolve(value.get("D"))
        if not isinstance(value, list) or not value:
            return None
        pages = self.pages()
        if isinstance(value[0], Ref):
            at = self.page_of(value[0])
        else:
            n = self.resolve(value[0])
            at = (n - 1) % len(pages) if type(n) is int and pages and abs(n - 1) <= len(pages) else None
        display = self.resolve(value[1]) if len(value) > 1 else None
        display = str(display) if isinstance(display, str) else "Fit"
        args = [self.resolve(v) for v in value[2:]]
        box = pages[at].mediabox if at is not None else LETTER
        left, top, zoom, rect = box[0], box[3], None, None

        def given(k: int, default: float) -> float:
            return number(args[k], default) if k < len(args) and args[k] is not None else default

        if display == "XYZ":
            left, top, zoom = given(0, left), given(1, top), given(2, 0.0) or None
        elif display in ("FitH", "FitBH"):
            top = given(0, top)
        elif display in ("FitV", "FitBV"):
            left = given(0, left)
        elif display == "FitR":
            rect = normal_rect((given(0, box[0]), given(1, box[1]), given(2, box[2]), given(3, box[3])))
            left, top = rect[0], rect[3]
        return {"page_idx": at, "display": display, "left": left, "top": top, "zoom": zoom, "bbox": rect or box}

    def action(self, value: Any) -> dict[str, Any]:
        a = self.dict_of(value)
        kind, uri = self.resolve(a.get("S")), self.resolve(a.get("URI"))
        out: dict[str, Any] = {"type": str(kind) if isinstance(kind, Name) else None}
        out["uri"] = text_of(uri) if isinstance(uri, bytes) else None
        out["dest"] = a.get("D") if kind == "GoTo" else None
        return out

    def outline(self) -> Iterator[dict[str, Any]]:
        """Rows in the order of reading; a node is known by the path of its ordinals."""
        root = self.dict_of(self.catalog.get("Outlines"))
        stack: list[tuple[Any, tuple[int, ...], int | None]] = [(root.get("First"), (0,), None)] if root else []
        seen: set[int] = set()
        count = 0
        while stack:
            ref, path, parent = stack.pop()
            if not isinstance(ref, Ref) or ref.objid in seen:
                continue
            seen.add(ref.objid)
            node = self.dict_of(ref)
            if not node:
                continue
            title = self.resolve(node.get("Title"))
            action = self.action(node.get("A"))
            dest = node.get("Dest") if node.get("Dest") is not None else action["dest"]
            se = node.get("SE")
            yield {"node_id": count, "parent_id": parent, "depth": len(path) - 1, "path": list(path), "title": text_of(title) if isinstance(title, bytes) else None, "dest": self.destination(dest), "action": action["type"], "uri": action["uri"], "element": se.objid if isinstance(se, Ref) else None}
            stack.append((node.get("Next"), (*path[:-1], path[-1] + 1), parent))
            stack.append((node.get("First"), (*path, 0), count))
            count += 1

    def annotations(self, page: Page) -> Iterator[dict[str, Any]]:
        ctm = page.ctm("default")
        for k, ref in enumerate(self.list_of(page.attrs.get("Annots"))):
            a = self.resolve(ref)
            kind = self.resolve(a.get("Subtype")) if isinstance(a, dict) else None
            rect = self._box(a.get("Rect")) if isinstance(a, dict) else None
            if not isinstance(kind, Name) or rect is None:
                self.warnings.append(f"annotation {k} of page {page.index}")
                continue
            said = {key: text_of(v) if isinstance(v := self.resolve(a.get(src)), bytes) else None for key, src in (("contents", "Contents"), ("name", "NM"), ("mtime", "M"))}
            action = self.action(a.get("A"))
            dest = a.get("Dest") if a.get("Dest") is not None else action["dest"]
            target = self.resolve(dest)
            named = text_of(target) if isinstance(target, bytes) else str(target) if isinstance(target, Name) else None
            found = self.destination(dest)
            yield {"annot_idx": k, "objid": ref.objid if isinstance(ref, Ref) else None, "type": str(kind), "rect": rect, "bbox": transform_rect(ctm, rect), **said, "struct_parent": _int(self.resolve(a.get("StructParent")), -1) if a.get("StructParent") is not None else None, "action": action["type"], "uri": action["uri"], "dest_name": named, "dest_page_idx": found["page_idx"] if found else None}

    # logical structure

    def structure(self) -> Iterator[dict[str, Any]]:
        """Elements, marked-content items and objects in pre-order; `last` is the last row of the subtree."""
        root = self.dict_of(self.catalog.get("StructTreeRoot"))
        if not root:
            return
        roles = {k: self.resolve(v) for k, v in self.dict_of(root.get("RoleMap")).items()}
        rows: list[dict[str, Any]] = []
        seen: set[int] = set()
        top = self.resolve(root.get("K"))
        stack: list[tuple[Any, int | None, tuple[int, ...], Any]] = [(k, None, (i,), None) for i, k in reversed(list(enumerate(top if isinstance(top, list) else [root.get("K")])))]
        while stack:
            ref, parent, path, page_ref = stack.pop()
            node = self.resolve(ref)
            row: dict[str, Any] = {"node_id": len(rows), "parent_id": parent, "depth": len(path) - 1, "path": list(path), "objid": ref.objid if isinstance(ref, Ref) else None}
            if type(node) is int or isinstance(node, dict) and node.get("Type") == "MCR":
                mcid = node if type(node) is int else self.resolve(node.get("MCID"))
                page = page_ref if type(node) is int else node.get("Pg", page_ref)
                at, stm = self.page_of(page), node.get("Stm") if isinstance(node, dict) else None
                if at is None:
                    self.warnings.append("a marked-content item without a page")
                    continue
                rows.append(row | {"kind": "item", "page_idx": at, "mcid": mcid if type(mcid) is int else None, "stream_id": stm.objid if isinstance(stm, Ref) else None})
            elif isinstance(node, dict) and node.get("Type") == "OBJR":
                obj = node.get("Obj")
                rows.append(row | {"kind": "object", "page_idx": self.page_of(node.get("Pg", page_ref)), "objid": obj.objid if isinstance(obj, Ref) else None})
            elif isinstance(node, dict):
                if isinstance(ref, Ref):
                    if ref.objid in seen:
                        continue
                    seen.add(ref.objid)
                kind = self.resolve(node.get("S"))
                kind = str(kind) if isinstance(kind, str) else None
                role = roles.get(kind, kind) if kind else None
                page = node.get("Pg", page_ref)
                said = {key: text_of(v) if isinstance(v := self.resolve(node.get(src)), bytes) else None for key, src in (("title", "T"), ("lang", "Lang"), ("alt", "Alt"), ("expansion", "E"), ("actual_text", "ActualText"))}
                rows.append(row | {"kind": "element", "type": kind, "role": str(role) if role is not None else None, "page_idx": self.page_of(page), **said, "class_name": self._newest(node.get("C")), "attributes": self._attributes(node.get("A")), "bbox": self._element_box(node.get("A"))})
                kids = self.resolve(node.get("K"))
                kids = kids if isinstance(kids, list) else [] if kids is None else [node.get("K")]
                stack += [(k, row["node_id"], (*path, i), page) for i, k in reversed(list(enumerate(kids)))]
        ends = list(range(len(rows)))
        for k in range(len(rows) - 1, -1, -1):
            p = rows[k]["parent_id"]
            if p is not None:
                ends[p] = max(ends[p], ends[k])
        lines: list[list[int]] = []
        for row, end in zip(rows, ends, strict=True):
            p = row["parent_id"]
            lines.append([] if p is None else [*lines[p], p])
            yield row | {"last": end, "ancestors": lines[-1]}

    def _revisions(self, value: Any) -> list[tuple[Any, int]]:
        value = self.resolve(value)
        items = value if isinstance(value, list) else [] if value is None else [value]
        out: list[tuple[Any, int]] = []
        for item in items:
            item = self.resolve(item)
            if type(item) is int and out:
                out[-1] = (out[-1][0], item)
            else:
                out.append((item, 0))
        return out

    def _newest(self, value: Any) -> str | None:
        found = [(str(v), r) for v, r in self._revisions(value) if isinstance(v, str)]
        return max(found, key=lambda x: x[1])[0] if found else None

    def _attributes(self, value: Any) -> dict[str, Any]:
        """Of attribute dictionaries with revisions the highest counts; those of one revision, of several owners, are one."""
        found = self._revisions(value)
        newest = max((r for _, r in found), default=0)
        out: dict[str, Any] = {}
        for v, revision in found:
            if revision == newest:
                out |= {k: self.resolve_all(x) for k, x in self.dict_of(v).items()}
        return out

    def _element_box(self, value: Any) -> Rect | None:
        return self._box(self._attributes(value).get("BBox"))

    def parent_tree(self) -> Iterator[tuple[int, int | None, int | None]]:
        """(key, mcid or None, element's object number) of the tree from content to structure."""
        root = self.dict_of(self.catalog.get("StructTreeRoot"))
        for key, v in self.number_tree(root.get("ParentTree")):
            value = self.resolve(v)
            if isinstance(value, list):
                for mcid, e in enumerate(value):
                    if isinstance(e, Ref):
                        yield key, mcid, e.objid
            elif isinstance(v, Ref):
                yield key, None, v.objid
