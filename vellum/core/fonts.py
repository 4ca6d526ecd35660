"""Fonts: bytes to codes, codes to texts, and how far each moves the pen."""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from .encodings import DINGBATS, ENCODINGS, STANDARD, SYMBOL, core_font, core_shape, core_widths, glyph_text
from .lexer import Parser
from .values import Keyword, Name, PdfError, Stream, number, numbers, text_of


class CMap:
    """Code spaces, code -> CID and code -> text."""

    def __init__(self) -> None:
        self.spaces: list[tuple[int, int, int]] = []  # bytes, low, high
        self.cids: dict[tuple[int, int], int] = {}
        self.ranges: list[tuple[int, int, int, int]] = []
        self.texts: dict[int, str] = {}
        self.vertical = False
        self.identity = False

    @classmethod
    def parse(cls, data: bytes) -> CMap:
        out, held = cls(), []
        for _, v in Parser(data, refs=False):
            if not isinstance(v, Keyword):
                held.append(v)
                continue
            if v == "def" and len(held) > 1 and held[-2] == "WMode":
                out.vertical = held[-1] == 1
            elif v == "endcodespacerange":
                for a, b in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes) and a:
                        out.spaces.append((len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big")))
            elif v == "endcidchar":
                for a, n in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes) and type(n) is int:
                        out.cids[len(a), int.from_bytes(a, "big")] = n
            elif v == "endcidrange":
                for a, b, n in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes) and type(n) is int:
                        out.ranges.append((len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big"), n))
            elif v == "endbfchar":
                for a, t in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes):
                        out.texts[int.from_bytes(a, "big")] = cls._text(t)
            elif v == "endbfrange":
                for a, b, t in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out._bfrange(int.from_bytes(a, "big"), int.from_bytes(b, "big"), t)
            held = []
        out.spaces.sort()
        return out

    @staticmethod
    def _text(value: Any) -> str:
        if isinstance(value, bytes):
            return value.decode("utf-16-be", "ignore") if len(value) > 1 else value.decode("latin-1")
        if isinstance(value, Name):
            return glyph_text(value)
        return chr(value) if type(value) is int and 0 <= value < 0x110000 else ""

    def _bfrange(self, low: int, high: int, to: Any) -> None:
        high = min(high, low + 0xFFFF)
        if isinstance(to, list):
            for code, t in zip(range(low, high + 1), to, strict=False):
                self.texts[code] = self._text(t)
        elif isinstance(to, bytes) and to:
            head, tail = to[:-4], to[-4:]
            start = int.from_bytes(tail, "big")
            for code in range(low, high + 1):
                self.texts[code] = self._text(head + ((start + code - low) % (1 << 8 * len(tail))).to_bytes(len(tail), "big"))
        elif type(to) is int:
            for code in range(low, high + 1):
                self.texts[code] = self._text(to + code - low)

    def codes(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(bytes, code) of each code; what no code space has is one byte."""
        at = 0
        while at < len(data):
            for n, low, high in self.spaces:
                part = data[at : at + n]
                code = int.from_bytes(part, "big")
                if len(part) == n and all(lo <= c <= hi for c, lo, hi in zip(part, low.to_bytes(n, "big"), high.to_bytes(n, "big"), strict=True)):
                    break
            else:
                n, code = 1, data[at]
            yield n, code
            at += n

    def cid(self, size: int, code: int) -> int:
        if self.identity:
            return code
        if (found := self.cids.get((size, code))) is not None:
            return found
        for n, low, high, cid in reversed(self.ranges):
            if n == size and low <= code <= high:
                return cid + code - low
        return 0


def identity_cmap(size: int, vertical: bool) -> CMap:
    out = CMap()
    out.spaces, out.identity, out.vertical = [(size, 0, (1 << 8 * size) - 1)], True, vertical
    return out


#: Character sets of the predefined CMaps, by what their names begin with, as Python's codecs.
CHARSETS = {
    "90ms-RKSJ": "cp932", "90msp-RKSJ": "cp932", "83pv-RKSJ": "shift_jis", "90pv-RKSJ": "cp932", "Add-RKSJ": "shift_jis", "Ext-RKSJ": "shift_jis", "EUC-": "euc_jp",
    "GBK": "gbk", "GB-EUC": "gb2312", "GBpc-EUC": "gb2312", "GBT-EUC": "gb2312", "ETen-B5": "cp950", "ETenms-B5": "cp950", "B5pc": "big5", "HKscs-B5": "big5hkscs", "CNS-EUC": "euc_tw",
    "KSCms-UHC": "cp949", "KSC-EUC": "euc_kr", "KSCpc-EUC": "euc_kr", "KSC-Johab": "johab",
}


def charset(name: str) -> str | None:
    """The codec of a predefined CMap's codes."""
    if name in ("H", "V", "Add-H", "Add-V", "Ext-H", "Ext-V"):
        return "iso2022_jp"  # rows and cells of JIS X 0208
    if "UCS2" in name or "UTF16" in name:
        return "utf-16-be"
    if "UTF32" in name:
        return "utf-32-be"
    if "UTF8" in name:
        return "utf-8"
    return next((c for start, c in CHARSETS.items() if name.startswith(start)), None)


def code_texts(name: str) -> Callable[[int, int], str] | None:
    """(bytes, code) -> text for a predefined CMap whose character set is known."""
    codec = charset(name)
    try:
        codecs.lookup(codec or "")
    except LookupError:
        return None

    def text(size: int, code: int) -> str:
        raw = code.to_bytes(size, "big")
        return (b"\x1b$B" + raw + b"\x1b(B" if codec == "iso2022_jp" else raw).decode(codec or "ascii", "ignore")

    return text


def code_spaces(name: str) -> list[tuple[int, int, int]]:
    """The code lengths of a predefined CMap by its character set."""
    codec = charset(name)
    if codec == "utf-16-be":
        return [(2, 0, 0xD7FF), (4, 0xD800DC00, 0xDBFFDFFF), (2, 0xE000, 0xFFFF)]
    if codec == "utf-32-be":
        return [(4, 0, 0x0010FFFF)]
    if codec in ("cp932", "shift_jis"):
        return [(1, 0, 0x80), (1, 0xA0, 0xDF), (2, 0x8140, 0x9FFC), (2, 0xE040, 0xFCFC)]
    if codec in (None, "iso2022_jp"):
        return [(2, 0, 0xFFFF)]
    return [(1, 0, 0x80), (2, 0x8130, 0xFEFE)]


def predefined_cmap(folder: str | None, name: str) -> CMap | None:
    """A CMap file of that name in a folder, with what it builds upon."""
    if not folder or "/" in name or name.startswith("."):
        return None
    try:
        with open(f"{folder}/{name}", "rb") as f:
            data = f.read()
    except OSError:
        return None
    found = CMap.parse(data)
    for base in re.findall(rb"/([\w.-]+)\s+usecmap", data):
        if base.decode() != name and (below := predefined_cmap(folder, base.decode())) is not None:
            found.spaces = sorted({*below.spaces, *found.spaces})
            found.cids = below.cids | found.cids
            found.ranges = below.ranges + found.ranges
    return found


def truetype_texts(data: bytes) -> dict[int, str]:
    """Glyph -> text by a Unicode table of a TrueType program."""
    out: dict[int, str] = {}
    try:
        for k in range(struct.unpack_from(">H", data, 4)[0]):
            tag, _, base, _ = struct.unpack_from(">4sIII", data, 12 + 16 * k)
            if tag == b"cmap":
                break
        else:
            return out
        for k in range(struct.unpack_from(">H", data, base + 2)[0]):
            platform, kind, at = struct.unpack_from(">HHI", data, base + 4 + 8 * k)
            if platform not in (0, 3) or platform == 3 and kind not in (1, 10):
                continue
            at += base
            form = struct.unpack_from(">H", data, at)[0]
            if form == 0:
                for code, g in enumerate(data[at + 6 : at + 262]):
                    out.setdefault(g, chr(code))
            elif form == 4:
                n = struct.unpack_from(">H", data, at + 6)[0] // 2
                ends = struct.unpack_from(f">{n}H", data, at + 14)
                starts = struct.unpack_from(f">{n}H", data, at + 16 + 2 * n)
                deltas = struct.unpack_from(f">{n}h", data, at + 16 + 4 * n)
                where = at + 16 + 6 * n
                offsets = struct.unpack_from(f">{n}H", data, where)
                for i in range(n):
                    for code in range(starts[i], min(ends[i], 0xFFFE) + 1):
                        if offsets[i]:
                            g = struct.unpack_from(">H", data, where + 2 * i + offsets[i] + 2 * (code - starts[i]))[0]
                            g = (g + deltas[i]) & 0xFFFF if g else 0
                        else:
                            g = (code + deltas[i]) & 0xFFFF
                        if g:
                            out.setdefault(g, chr(code))
            elif form == 6:
                first, n = struct.unpack_from(">HH", data, at + 6)
                for i, g in enumerate(struct.unpack_from(f">{n}H", data, at + 10)):
                    out.setdefault(g, chr(first + i))
            elif form == 12:
                for i in range(struct.unpack_from(">I", data, at + 12)[0]):
                    a, b, g = struct.unpack_from(">III", data, at + 16 + 12 * i)
                    for code in range(a, min(b, a + 0xFFFF) + 1):
                        out.setdefault(g + code - a, chr(code))
    except struct.error:
        pass
    return out


#: Texts of CFF's own strings: the Standard glyphs in order, then the rest of the ISO-Adobe set.
_CFF_TEXTS = [""] + [STANDARD[c] for c in sorted(STANDARD)] + list("¹¬µ™Ð½±Þ¼÷¦°þ¾²®−ð×³©ÁÂÄÀÅÃÇÉÊËÈÍÎÏÌÑÓÔÖÒÕŠÚÛÜÙÝŸŽáâäàåãçéêëèíîïìñóôöòõšúûüùýÿž")


class Cff:
    """The built-in encoding (code -> text) of a compact font."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        at = data[2]
        _, at = self._index(at)
        tops, at = self._index(at)
        strings, at = self._index(at)
        self.strings = [s.decode("latin-1") for s in strings]
        top = self._dict(tops[0])
        glyphs, _ = self._index(int(top[17][0]))
        names = self._charset(int(top.get(15, [0])[0]), len(glyphs))
        self.encoding: dict[int, str] = {}
        where = int(top.get(16, [0])[0])
        if where < 2:
            self.encoding = dict(STANDARD)
        else:
            form, n, at = data[where], data[where + 1], where + 2
            g = 1
            for _ in range(n):
                if form & 127 == 0:
                    codes, at = [data[at]], at + 1
                else:
                    codes, at = range(data[at], data[at] + data[at + 1] + 1), at + 2
                for code in codes:
                    if g < len(names):
                        self.encoding[code] = names[g]
                    g += 1
            if form & 128:
                for k in range(data[at]):
                    code, sid = data[at + 1 + 3 * k], int.from_bytes(data[at + 2 + 3 * k : at + 4 + 3 * k], "big")
                    self.encoding[code] = self._string(sid)

    def _index(self, at: int) -> tuple[list[bytes], int]:
        n = int.from_bytes(self.data[at : at + 2], "big")
        if not n:
            return [], at + 2
        size = self.data[at + 2]
        ends = [int.from_bytes(self.data[at + 3 + size * k : at + 3 + size * (k + 1)], "big") for k in range(n + 1)]
        base = at + 2 + size * (n + 1)
        return [self.data[base + a : base + b] for a, b in zip(ends, ends[1:], strict=False)], base + ends[-1]

    def _dict(self, data: bytes) -> dict[int, list[float]]:
        out: dict[int, list[float]] = {}
        held: list[float] = []
        k = 0
        while k < len(data):
            b = data[k]
            k += 1
            if b <= 21:
                if b == 12:
                    b = 1200 + data[k]
                    k += 1
                out[b], held = held, []
            elif b == 28:
                held.append(int.from_bytes(data[k : k + 2], "big", signed=True))
                k += 2
            elif b == 29:
                held.append(int.from_bytes(data[k : k + 4], "big", signed=True))
                k += 4
            elif b == 30:
                text = ""
                while "x" not in text:
                    for n in (data[k] >> 4, data[k] & 15):
                        text += str(n) if n < 10 else {10: ".", 11: "E", 12: "E-", 14: "-", 15: "x"}.get(n, "")
                    k += 1
                held.append(float(text.split("x")[0] or 0))
            elif b <= 246:
                held.append(b - 139)
            elif b <= 250:
                held.append((b - 247) * 256 + data[k] + 108)
                k += 1
            elif b <= 254:
                held.append(-(b - 251) * 256 - data[k] - 108)
                k += 1
        return out

    def _string(self, sid: int) -> str:
        if sid < 391:
            return _CFF_TEXTS[sid] if sid < len(_CFF_TEXTS) else ""
        return glyph_text(self.strings[sid - 391]) if sid - 391 < len(self.strings) else ""

    def _charset(self, at: int, count: int) -> list[str]:
        if at < 3:
            return [self._string(k) for k in range(count)]
        sids, form = [0], self.data[at]
        at += 1
        while len(sids) < count:
            sid = int.from_bytes(self.data[at : at + 2], "big")
            more = 0 if form == 0 else self.data[at + 2] if form == 1 else int.from_bytes(self.data[at + 2 : at + 4], "big")
            at += 2 + form
            sids += range(sid, sid + more + 1)
        return [self._string(s) for s in sids[:count]]


class Steps(dict[int, float]):
    """How far the pen moves along a line, by CID, in one state of the texts."""

    def __init__(self, font: Font, size: float, charspace: float, wordspace: float, scale: float) -> None:
        super().__init__()
        self.font, self.state = font, (size, charspace, wordspace, scale)

    def __missing__(self, cid: int) -> float:
        size, charspace, wordspace, scale = self.state
        step = self.font.advance(cid) * size + charspace + (wordspace if cid == 32 and not self.font.multibyte else 0.0)
        self[cid] = step * scale
        return self[cid]


class Font:
    """What the interpreter asks of a font. Widths are in thousandths unless the matrix says otherwise."""

    def __init__(self, doc: Any, attrs: dict[str, Any], objid: int | None = None) -> None:
        self.doc, self.attrs, self.objid = doc, attrs, objid
        get = lambda k, d=attrs: doc.resolve(d.get(k))
        self.type = str(get("Subtype") or "unknown")
        base = get("BaseFont") if get("BaseFont") is not None else get("Name")
        self.name = text_of(base) if isinstance(base, bytes) else str(base) if isinstance(base, str) else "unknown"
        self.cid_font: dict[str, Any] = doc.dict_of(doc.list_of(attrs.get("DescendantFonts"))[0]) if self.type == "Type0" and doc.list_of(attrs.get("DescendantFonts")) else {}
        self.descriptor = doc.dict_of((self.cid_font or attrs).get("FontDescriptor"))
        self.multibyte = self.type == "Type0"
        self.vertical = False
        self.matrix = (0.001, 0.0, 0.0, 0.001, 0.0, 0.0)
        self.core = core_font(self.name.split("+")[-1]) if self.type in ("Type1", "MMType1", "TrueType") else None
        self.widths: dict[int, float] = {}
        self.heights: dict[int, tuple[float, float, float]] = {}
        d = {k: doc.resolve(v) for k, v in self.descriptor.items()}
        self.flags = d["Flags"] if type(d.get("Flags")) is int else 0
        self.default_width = number(d.get("MissingWidth"), 0.0)
        self.ascent, self.descent = number(d.get("Ascent"), 880.0), number(d.get("Descent"), -120.0)
        box = numbers(doc.resolve_all(self.descriptor.get("FontBBox")), 4)
        self.bbox = tuple(box) if box else (0.0, 0.0, 0.0, 0.0)
        if self.core and not self.descriptor:
            self.ascent, self.descent, self.bbox = core_shape(self.core)
        if self.descent > 0:
            self.descent = -self.descent
        if not self.ascent and not self.descent:
            self.ascent, self.descent = self.bbox[3], self.bbox[1]
        self.to_unicode: CMap | None = None
        tu = get("ToUnicode")
        if isinstance(tu, Stream):
            self.to_unicode = CMap.parse(self._bytes(tu))
        self.embedded = next((k for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(d.get(k), Stream)), None)
        self.program = d.get(self.embedded) if self.embedded else None
        self._texts: dict[int, str] = {}
        self._code_texts: list[str] | None = None
        self._steps: dict[tuple[float, float, float, float], Steps] = {}
        self.procs: dict[int, Stream] = {}
        if self.multibyte:
            self._composite()
        else:
            self._simple()

    def _bytes(self, stream: Stream) -> bytes:
        try:
            return self.doc.stream_bytes(stream)
        except PdfError as e:
            self.doc.warnings.append(f"font {self.name}: {e}")
            return b""

    def _simple(self) -> None:
        doc, get = self.doc, lambda k: self.doc.resolve(self.attrs.get(k))
        widths, first = get("Widths"), get("FirstChar")
        if isinstance(widths, list):
            start = first if type(first) is int else 0
            self.widths = {start + i: number(doc.resolve(w)) for i, w in enumerate(widths)}
        elif self.core and self.core not in ("Symbol", "ZapfDingbats"):
            self.default_width = 600.0 if self.core.startswith("Courier") else self.default_width
        encoding = get("Encoding")
        table = self._built_in()
        if isinstance(encoding, Name):
            table = dict(ENCODINGS.get(str(encoding), table))
        elif isinstance(encoding, dict):
            base = doc.resolve(encoding.get("BaseEncoding"))
            table = dict(ENCODINGS.get(str(base), table)) if isinstance(base, Name) else table
            code = 0
            self.names: dict[int, str] = {}
            for x in doc.list_of(encoding.get("Differences")):
                x = doc.resolve(x)
                if isinstance(x, Name):
                    table[code] = glyph_text(x)
                    self.names[code] = str(x)
                    code += 1
                elif type(x) is int:
                    code = x
        self._encoding = table
        self._texts = table
        if self.to_unicode is not None:
            self._texts = {c: self.to_unicode.texts.get(c, chr(c)) for c in range(256)}
        if self.type == "Type3":
            m = numbers(doc.resolve_all(self.attrs.get("FontMatrix")), 6)
            self.matrix = tuple(m) if m else self.matrix
            box = numbers(doc.resolve_all(self.attrs.get("FontBBox")), 4)
            self.bbox = tuple(box) if box else self.bbox
            self.ascent, self.descent = self.bbox[3], self.bbox[1]
            procs = doc.dict_of(self.attrs.get("CharProcs"))
            for code, name in getattr(self, "names", {}).items():
                if isinstance(s := doc.resolve(procs.get(name)), Stream):
                    self.procs[code] = s

    def _built_in(self) -> dict[int, str]:
        if self.core == "Symbol":
            return dict(SYMBOL)
        if self.core == "ZapfDingbats":
            return dict(DINGBATS)
        if self.type == "Type3":
            return {}
        if self.embedded == "FontFile":
            head = self._bytes(self.program)[:20000]
            found = {int(m[1]): glyph_text(m[2].decode("latin-1")) for m in re.finditer(rb"dup\s+(\d+)\s*/(\S+)\s+put", head)}
            if found:
                return found
        if self.embedded == "FontFile3" and self.type != "TrueType":
            try:
                return Cff(self._bytes(self.program)).encoding
            except (IndexError, KeyError, ValueError):
                self.doc.warnings.append(f"font {self.name}: its program can't be read")
        if self.type == "TrueType" and self.flags & 4:
            return {}
        return dict(STANDARD)

    def _composite(self) -> None:
        doc = self.doc
        self.code_text: Callable[[int, int], str] | None = None
        encoding = doc.resolve(self.attrs.get("Encoding"))
        self.cmap = identity_cmap(2, False)
        if isinstance(encoding, Name):
            said = str(encoding).replace("DLIdent", "Identity")
            self.cmap = identity_cmap(1 if said.startswith("OneByteIdentity") else 2, said.endswith("V"))
            if "Identity" not in said:
                self.code_text = code_texts(said)
                found = predefined_cmap(doc.cmap_folder, said)
                if found is not None:
                    found.vertical = found.vertical or self.cmap.vertical
                    self.cmap = found
                else:
                    self.cmap.spaces = code_spaces(said)
                    doc.warnings.append(f"font {self.name}: no CMap {said}" + ("" if self.code_text else ", so its texts aren't known"))
        elif isinstance(encoding, Stream):
            self.cmap = CMap.parse(self._bytes(encoding))
            mode = doc.resolve(encoding.attrs.get("WMode"))
            self.cmap.vertical = self.cmap.vertical or mode == 1
        self.vertical = self.cmap.vertical
        dw = doc.resolve(self.cid_font.get("DW"))
        self.default_width = number(dw, 1000.0)
        w = [doc.resolve(x) for x in doc.list_of(self.cid_font.get("W"))]
        k = 0
        while k < len(w):
            if k + 1 < len(w) and isinstance(w[k + 1], list):
                for i, x in enumerate(w[k + 1]):
                    self.widths[int(number(w[k])) + i] = number(doc.resolve(x))
                k += 2
            elif k + 2 < len(w):
                for cid in range(int(number(w[k])), min(int(number(w[k + 1])), 0xFFFF) + 1):
                    self.widths[cid] = number(w[k + 2])
                k += 3
            else:
                break
        dw2 = numbers(doc.resolve_all(self.cid_font.get("DW2")), 2) or [880.0, -1000.0]
        self.vy, self.default_height = dw2
        w2 = [doc.resolve(x) for x in doc.list_of(self.cid_font.get("W2"))]
        k = 0
        while k < len(w2):
            if k + 1 < len(w2) and isinstance(w2[k + 1], list):
                row = [number(doc.resolve(x)) for x in w2[k + 1]]
                for i in range(0, len(row) - 2, 3):
                    self.heights[int(number(w2[k])) + i // 3] = (row[i], row[i + 1], row[i + 2])
                k += 2
            elif k + 4 < len(w2):
                for cid in range(int(number(w2[k])), min(int(number(w2[k + 1])), 0xFFFF) + 1):
                    self.heights[cid] = (number(w2[k + 2]), number(w2[k + 3]), number(w2[k + 4]))
                k += 5
            else:
                break
        self.unknown = isinstance(encoding, Name) and "Ident" not in str(encoding)
        self._glyph_texts: dict[int, str] = {}
        if self.to_unicode is None and self.embedded == "FontFile2":
            self._glyph_texts = truetype_texts(self._bytes(self.program))

    def decode(self, data: bytes) -> Iterator[tuple[int, str]]:
        """(CID, text) of each code; a text of "" where it isn't known."""
        if not self.multibyte:
            for c in data:
                yield c, self._texts.get(c, "")
            return
        for size, code in self.cmap.codes(data):
            cid = self.cmap.cid(size, code)
            if self.to_unicode is not None:
                yield cid, self.to_unicode.texts.get(code, chr(code))
            elif self._glyph_texts:
                yield cid, self._glyph_texts.get(cid, "")
            elif self.code_text is not None:
                yield cid, self.code_text(size, code)
            elif self.unknown:
                yield cid, ""
            else:
                yield cid, chr(cid) if cid < 0x110000 and not 0xD800 <= cid < 0xE000 else ""

    def codes(self, data: bytes) -> tuple[Sequence[int], str]:
        """The CIDs of data, and its text."""
        if self.multibyte:
            found = list(self.decode(data))
            return [cid for cid, _ in found], "".join(text for _, text in found)
        if self._code_texts is None:
            self._code_texts = [self._texts.get(c, "") for c in range(256)]
        return data, "".join(map(self._code_texts.__getitem__, data))

    def steps(self, size: float, charspace: float, wordspace: float, scale: float) -> Steps:
        """How far the pen moves along a line, by CID."""
        key = (size, charspace, wordspace, scale)
        if (found := self._steps.get(key)) is None:
            if len(self._steps) >= 64:
                self._steps.clear()
            found = self._steps[key] = Steps(self, *key)
        return found

    def width(self, cid: int) -> float:
        if (w := self.widths.get(cid)) is not None:
            return w
        if self.core and not self.multibyte and not self.widths:
            return core_widths(self.core).get(self._encoding.get(cid, ""), self.default_width)
        return self.default_width

    def advance(self, cid: int) -> float:
        """How far the pen moves at size 1, along the direction of writing."""
        if self.vertical:
            return self.heights[cid][0] * 0.001 if cid in self.heights else self.default_height * 0.001
        return self.width(cid) * self.matrix[0]

    def position(self, cid: int) -> tuple[float, float]:
        """From the origin for vertical writing to that for horizontal writing, at size 1."""
        if not self.vertical:
            return (0.0, 0.0)
        _, x, y = self.heights.get(cid, (0.0, self.width(cid) / 2, self.vy))
        return (x * 0.001, y * 0.001)

    def box(self, cid: int) -> tuple[float, float, float, float]:
        """The glyph's box at size 1: its advance by ascent and descent."""
        if self.type == "Type3":
            x0, y0, x1, y1 = self.bbox
            a, b, c, d, _, _ = self.matrix
            xs, ys = [x0 * a + y0 * c, x1 * a + y1 * c], [x0 * b + y0 * d, x1 * b + y1 * d]
            if not (x1 or y1 or x0 or y0):
                return (0.0, 0.0, self.width(cid) * a, 0.0)
            return (min(xs), min(ys), max(xs), max(ys))
        if self.vertical:
            x, y = self.position(cid)
            return (-x, self.advance(cid), self.width(cid) * 0.001 - x, 0.0)
        return (0.0, self.descent * 0.001, self.width(cid) * 0.001, self.ascent * 0.001)
