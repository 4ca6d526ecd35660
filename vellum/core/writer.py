"""A small, deterministic PDF writer: the inputs of tests, queries and benchmarks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import Any

from .values import Name, Ref, Stream


def literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def text_string(s: str) -> bytes:
    """A text string: plain where ASCII, else UTF-16 with its mark."""
    return s.encode("ascii") if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be")


def written(value: Any) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, Ref):
        return f"{value.objid} {value.genno} R".encode()
    if isinstance(value, str):
        raw = value.encode()
        return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in raw)
    if isinstance(value, bytes):
        return literal(value)
    if isinstance(value, list | tuple):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(b"/" + k.encode() + b" " + written(v) for k, v in value.items()) + b">>"
    raise TypeError(f"{value!r} can't be written")


class Writer:
    """Objects are added in any order; save() writes them with a table, a stream or object streams."""

    def __init__(self, version: str = "1.7") -> None:
        self.version = version
        self.objects: dict[int, Any] = {}
        self.catalog: dict[str, Any] = {"Type": Name("Catalog")}
        self.root = self.add(self.catalog)
        self.pages: list[Ref] = []
        self.tree: dict[str, Any] = {"Type": Name("Pages")}
        self.tree_ref = self.add(self.tree)
        self.catalog["Pages"] = self.tree_ref
        self.encrypt: Callable[[int, bytes], bytes] | None = None
        self.extra: dict[str, Any] = {}

    def add(self, value: Any) -> Ref:
        ref = Ref(len(self.objects) + 1)
        self.objects[ref.objid] = value
        return ref

    def stream(self, data: bytes, compress: bool = False, **attrs: Any) -> Ref:
        if compress:
            data, attrs = zlib.compress(data), {"Filter": Name("FlateDecode")} | attrs
        return self.add(Stream(attrs, data))

    def core_font(self, name: str = "Helvetica", encoding: str | None = "WinAnsiEncoding") -> Ref:
        font: dict[str, Any] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name)}
        return self.add(font | ({"Encoding": Name(encoding)} if encoding else {}))

    def page(self, content: bytes | Ref | list[Ref], resources: dict[str, Any] | None = None, compress: bool = False, parent: Ref | None = None, **attrs: Any) -> Ref:
        body = content if not isinstance(content, bytes) else self.stream(content, compress)
        page = {"Type": Name("Page"), "Parent": parent or self.tree_ref, "Contents": body, "Resources": resources or {}, **attrs}
        ref = self.add(page)
        if parent is None:
            self.pages.append(ref)
        return ref

    def _body(self, objid: int, value: Any) -> bytes:
        if isinstance(value, Stream):
            raw = self.encrypt(objid, value.raw) if self.encrypt else value.raw
            return written(value.attrs | {"Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream"
        return written(self._secret(objid, value))

    def _secret(self, objid: int, value: Any) -> Any:
        if self.encrypt is None or self.objects.get(objid) is self.extra.get("_encrypt"):
            return value
        if isinstance(value, bytes):
            return self.encrypt(objid, value)
        if isinstance(value, list):
            return [self._secret(objid, v) for v in value]
        if isinstance(value, dict):
            return {k: self._secret(objid, v) for k, v in value.items()}
        return value

    def save(self, xref: str = "table", revisions: Sequence[dict[int, Any]] = (), damaged: bool = False) -> bytes:
        """xref: table, stream, or objects (object streams too). Each revision replaces objects in an appended section."""
        if "Kids" not in self.tree:
            self.tree |= {"Kids": list(self.pages), "Count": len(self.pages)}
        out = bytearray(f"%PDF-{self.version}\n%\xe2\xe3\n".encode("latin-1"))
        where: dict[int, tuple[int, int, int]] = {}
        trailer: dict[str, Any] = {"Root": self.root} | {k: v for k, v in self.extra.items() if k[0] != "_"}
        held = {k: v for k, v in self.objects.items() if not isinstance(v, Stream)} if xref == "objects" else {}
        for objid, value in self.objects.items():
            if objid not in held:
                where[objid] = (1, len(out), 0)
                out += b"%d 0 obj\n" % objid + self._body(objid, value) + b"\nendobj\n"
        size = len(self.objects) + 1
        if held:
            head, body = b"", b""
            for k, (objid, value) in enumerate(held.items()):
                head += b"%d %d " % (objid, len(body))
                body += written(value) + b" "
                where[objid] = (2, size, k)
            where[size] = (1, len(out), 0)
            attrs = {"Type": Name("ObjStm"), "N": len(held), "First": len(head), "Filter": Name("FlateDecode")}
            out += b"%d 0 obj\n" % size + self._body(size, Stream(attrs, zlib.compress(head + body))) + b"\nendobj\n"
            size += 1
        start = len(out)
        if xref == "table":
            out += b"xref\n0 %d\n0000000000 65535 f \n" % size
            out += b"".join(b"%010d 00000 n \n" % where[k][1] for k in range(1, size))
            out += b"trailer\n" + written(trailer | {"Size": size})
        else:
            where[size] = (1, start, 0)
            rows = b"\0" * 7 + b"".join(where[k][0].to_bytes(1, "big") + where[k][1].to_bytes(4, "big") + where[k][2].to_bytes(2, "big") for k in range(1, size + 1))
            attrs = {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")} | trailer
            raw = zlib.compress(rows)
            out += b"%d 0 obj\n" % size + written(attrs | {"Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream\nendobj"
            size += 1
        out += b"\nstartxref\n%d\n%%%%EOF\n" % (0 if damaged else start)
        for changes in revisions:
            places = {}
            for objid, value in changes.items():
                places[objid] = len(out)
                out += b"%d 0 obj\n" % objid + self._body(objid, value) + b"\nendobj\n"
            before, start = start, len(out)
            out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, p) for k, p in sorted(places.items()))
            out += b"trailer\n" + written(trailer | {"Size": max(size, *places) + 1 if places else size, "Prev": before})
            out += b"\nstartxref\n%d\n%%%%EOF\n" % (0 if damaged else start)
        return bytes(out)


def show_lines(lines: Sequence[str], font: str = "F1", size: float = 12, x: float = 72, y: float = 720, leading: float = 14) -> bytes:
    """A text block of Latin-1 lines."""
    shown = b" T*\n".join(literal(s.encode("latin-1", "replace")) + b" Tj" for s in lines)
    return f"BT /{font} {size:g} Tf {leading:g} TL {x:g} {y:g} Td\n".encode() + shown + b"\nET"
