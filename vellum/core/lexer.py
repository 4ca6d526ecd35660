"""Tokens and objects from bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

from .values import Keyword, Name, Ref, Stream, SyntaxProblem, name_text

_SPACE = rb"\x00\t\n\x0c\r "
_DELIM = rb"()<>\[\]{}/%"
_REGULAR = b"[^" + _SPACE + _DELIM + b"]"
_TOKEN = re.compile(
    rb"(?P<skip>(?:[" + _SPACE + rb"]+|%[^\r\n]*)+)"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[" + _SPACE + _DELIM + rb"]|$))"
    rb"|/(?P<name>" + _REGULAR + rb"*)"
    rb"|(?P<mark><<|>>|[\[\]{}])"
    rb"|<(?P<hex>[^<>]*)>"
    rb"|(?P<string>\()"
    rb"|(?P<word>" + _REGULAR + rb"+)"
    rb"|(?P<other>.)",
    re.S,
)
_ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
_IN_STRING = re.compile(rb"[()\\\r]")
_NUMBER_PREFIX = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_JUNK = re.compile(rb"[-+.\d]*")
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


_CONTENT = re.compile(
    rb"(?:[" + _SPACE + rb"]++|%[^\r\n]*+)*+"
    rb"(?:([+-]?(?:\d+\.?\d*|\.\d+))(?=[" + _SPACE + _DELIM + rb"]|$)"
    rb"|/(" + _REGULAR + rb"*)"
    rb"|\(([^()\\\r]*+)\)"
    rb"|(<<|>>|[\[\]{}])"
    rb"|<([^<>]*)>"
    rb"|(\()"
    rb"|(" + _REGULAR + rb"+)"
    rb"|(.))",
    re.S,
)
_NUMBER, _NAME, _PLAIN_STRING, _MARK, _HEX, _STRING, _WORD = range(1, 8)


class Token(NamedTuple):
    pos: int
    kind: str  # number, name, string, keyword, mark
    value: Any
    end: int


def unescape_name(raw: bytes) -> str:
    return name_text(_ESCAPED.sub(lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw)


def unhex(raw: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def read_string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening parenthesis ends at `at`, and where it ends; an open one ends with the data."""
    out = bytearray()
    depth = 1
    while m := _IN_STRING.search(data, at):
        out += data[at : m.start()]
        c, at = m[0], m.end()
        if c == b"(":
            depth += 1
            out += c
        elif c == b")":
            depth -= 1
            if not depth:
                return bytes(out), at
            out += c
        elif c == b"\r":
            out += b"\n"
            at += data[at : at + 1] == b"\n"
        else:
            c = data[at : at + 1]
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at):
                at = octal.end()
                if (code := int(octal[0], 8)) < 256:
                    out.append(code)
            elif c in (b"\r", b"\n"):
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out += _LETTERS.get(c, c)
                at += 1
    return bytes(out + data[at:]), len(data)


def tokens(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Token]:
    """The tokens of data from a position on; comments and white space are skipped."""
    end = len(data) if end is None else end
    match = _TOKEN.match
    while at < end:
        m = match(data, at, end)
        if m is None:
            return
        kind, start = m.lastgroup, at
        at = m.end()
        if kind == "skip":
            continue
        raw = m[kind]
        if kind == "number":
            yield Token(start, "number", float(raw) if b"." in raw else int(raw), at)
        elif kind == "name":
            yield Token(start, "name", Name(unescape_name(raw)), at)
        elif kind == "hex":
            yield Token(start, "string", unhex(raw), at)
        elif kind == "string":
            value, at = read_string(data, at)
            yield Token(start, "string", value, at)
        elif kind == "mark":
            yield Token(start, "mark", raw.decode(), at)
        elif kind == "word":
            if raw in (b"true", b"false"):
                yield Token(start, "boolean", raw == b"true", at)
            elif (n := _NUMBER_PREFIX.match(raw)) and raw[:1] in b"+-.0123456789" and not raw[n.end() : n.end() + 1].isalpha():
                # a number that something unexpected follows directly, as in "1.2.3" or "12-3"
                yield Token(start, "number", float(n[0]) if b"." in n[0] else int(n[0]), start + n.end())
                at = start + n.end()
                if data[at : at + 1] in (b".", b"-", b"+"):
                    junk = re.compile(rb"[-+.\d]*").match(data, at, end)
                    at = junk.end() if junk else at
            else:
                yield Token(start, "keyword", Keyword(raw.decode("latin-1")), at)
        else:
            yield Token(start, "keyword", Keyword(raw.decode("latin-1")), at)


class _Open(NamedTuple):
    mark: str
    pos: int


_PAIRS = {"]": "[", ">>": "<<", "}": "{"}


def build_dict(items: list[Any], strict: bool) -> dict[str, Any]:
    if len(items) % 2:
        if strict:
            raise SyntaxProblem("a dictionary with a key and no value")
        items = items[:-1]
    out: dict[str, Any] = {}
    for k, v in zip(items[::2], items[1::2], strict=True):
        if isinstance(k, bytes):
            k = name_text(k)
        if isinstance(k, str) and v is not None:
            out[str(k)] = v
    return out


class Parser:
    """Objects from tokens. At the top level operators come out as Keyword; "R" joins two integers before it."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, strict: bool = False, refs: bool = True) -> None:
        self.data, self.strict, self.refs = data, strict, refs
        self.end = len(data) if end is None else end
        self.stream = tokens(data, at, self.end)
        self.at = at

    def seek(self, at: int) -> None:
        self.at, self.stream = at, tokens(self.data, at, self.end)

    def __iter__(self) -> Iterator[tuple[int, Any]]:
        """(position, object) of each object at the top level."""
        held: list[tuple[int, Any]] = []
        stack: list[tuple[_Open, list[Any]]] = []

        def put(pos: int, value: Any) -> None:
            if stack:
                stack[-1][1].append(value)
            else:
                held.append((pos, value))

        while (t := next(self.stream, None)) is not None:
            self.at = t.end
            if t.kind == "mark":
                if t.value in ("[", "<<", "{"):
                    stack.append((_Open(t.value, t.pos), []))
                    continue
                want = _PAIRS[t.value]
                if not any(o.mark == want for o, _ in stack):
                    if self.strict:
                        raise SyntaxProblem(f"unexpected {t.value} at {t.pos}")
                    continue
                while True:
                    opened, items = stack.pop()
                    put(opened.pos, build_dict(items, self.strict) if opened.mark == "<<" else items)
                    if opened.mark == want:
                        break
            elif t.kind == "keyword" and t.value == "null":
                put(t.pos, None)
            elif t.kind == "keyword" and t.value == "R" and self.refs:
                items = stack[-1][1] if stack else held
                pair = items[-2:] if stack else [v for _, v in items[-2:]]
                if len(pair) == 2 and all(type(x) is int for x in pair):
                    at = t.pos if stack else items[-2][0]
                    del items[-2:]
                    put(at, Ref(*pair) if pair[0] > 0 else None)
            elif t.kind == "keyword" and stack and t.value in ("endobj", "endstream", "stream", "obj", "xref", "trailer"):
                # an object that its writer forgot to close
                if self.strict:
                    raise SyntaxProblem(f"{t.value} within an object at {t.pos}")
                while stack:
                    opened, items = stack.pop()
                    put(opened.pos, build_dict(items, False) if opened.mark == "<<" else items)
                put(t.pos, t.value)
            else:
                put(t.pos, t.value)
            if not stack:
                if held and isinstance(held[-1][1], Keyword):
                    yield from held
                    held = []
                elif len(held) > 2:
                    yield held.pop(0)
        while stack:
            opened, items = stack.pop()
            if self.strict:
                raise SyntaxProblem(f"{opened.mark} at {opened.pos} isn't closed")
            put(opened.pos, build_dict(items, False) if opened.mark == "<<" else items)
        yield from held


@lru_cache(4096)
def _name(raw: bytes) -> Name:
    return Name(unescape_name(raw))


def _plain_object(data: bytes, at: int, alone: bool = False) -> tuple[Any, str, int] | None:
    """(value, "endobj" or "stream", its position) from a position on; alone: a dictionary, which needs no word after it;
    None where anything is out of the ordinary, which is for Parser."""
    top: list[Any] = []
    stack: list[tuple[bytes, list[Any]]] = []
    inner, match = top, _CONTENT.match
    while m := match(data, at):
        kind, at = m.lastindex, m.end()
        raw = m[kind]
        if kind == _NAME:
            inner.append(_name(raw))
        elif kind == _NUMBER:
            inner.append(float(raw) if b"." in raw else int(raw))
        elif kind == _WORD:
            if raw == b"R":
                if len(inner) < 2 or type(inner[-1]) is not int or type(inner[-2]) is not int:
                    return None
                genno, objid = inner.pop(), inner.pop()
                inner.append(Ref(objid, genno) if objid > 0 else None)
            elif raw in (b"true", b"false", b"null"):
                inner.append(None if raw == b"null" else raw == b"true")
            elif raw in (b"endobj", b"stream") and not stack and len(top) == 1:
                return top[0], raw.decode(), m.start(kind)
            else:
                return None
        elif kind == _MARK:
            if raw in (b"<<", b"["):
                inner = []
                stack.append((raw, inner))
            elif stack and stack[-1][0] == (b"<<" if raw == b">>" else b"[" if raw == b"]" else b""):
                mark, items = stack.pop()
                inner = stack[-1][1] if stack else top
                inner.append(build_dict(items, False) if mark == b"<<" else items)
                if alone and not stack:
                    return top[0], "", at
            else:
                return None
        elif kind == _PLAIN_STRING:
            inner.append(raw)
        elif kind == _HEX:
            inner.append(unhex(raw))
        elif kind == _STRING:
            value, at = read_string(data, at)
            inner.append(value)
        else:
            return None
    return None


def parse_one(data: bytes, at: int = 0, strict: bool = False) -> Any:
    if not strict and data[at : at + 2] == b"<<" and (found := _plain_object(data, at, True)):
        return found[0]
    return next((v for _, v in Parser(data, at, strict=strict)), None)


_INDIRECT = re.compile(rb"(\d+)[" + _SPACE + rb"]+(\d+)[" + _SPACE + rb"]+obj")
_OBJECT = re.compile(rb"[" + _SPACE + rb"]*(\d+)[" + _SPACE + rb"]+(\d+)[" + _SPACE + rb"]+obj")
_TAIL = re.compile(rb"[" + _SPACE + rb"]*endstream")
_END_STREAM = re.compile(rb"endstream|endobj")


def indirect_object(data: bytes, at: int, length_of: Callable[[Any], Any] = lambda v: v, strict: bool = False) -> tuple[int, int, Any, int]:
    """(object number, generation, value, end) of the indirect object at a position."""
    m = _OBJECT.match(data, at)
    if not m:
        raise SyntaxProblem(f"no object at {at}")
    objid, genno = int(m[1]), int(m[2])
    if not strict and (found := _plain_object(data, m.end())) and found[1]:
        value, word, pos = found
        if word == "endobj":
            return objid, genno, value, pos + 6
        if isinstance(value, dict):
            raw, end = stream_body(data, pos + 6, length_of(value.get("Length")))
            return objid, genno, Stream(value, raw, objid, genno), end
    value: Any = None
    end = m.end()
    first = True
    parser = Parser(data, m.end(), strict=strict)
    for pos, v in parser:
        if isinstance(v, Keyword):
            end = pos + len(v)
            if v == "stream" and isinstance(value, dict):
                raw, end = stream_body(data, pos + 6, length_of(value.get("Length")), strict)
                return objid, genno, Stream(value, raw, objid, genno), end
            if v != "endobj" and strict:
                raise SyntaxProblem(f"no endobj after the object at {at}")
            if v == "obj" or v == "endobj" or v not in ("endobj",):
                break
        elif first:
            value, first = v, False
    else:
        if strict:
            raise SyntaxProblem(f"no endobj after the object at {at}")
        end = len(data)
    return objid, genno, value, end


def stream_body(data: bytes, at: int, length: Any, strict: bool = False) -> tuple[bytes, int]:
    """The bytes after "stream", by their stated length if endstream follows there, else up to endstream or endobj."""
    if data[at : at + 2] == b"\r\n":
        at += 2
    elif data[at : at + 1] in (b"\n", b"\r"):
        at += 1
    if type(length) is int and 0 <= length <= len(data) - at:
        tail = _TAIL.match(data, at + length)
        if tail or strict:
            return data[at : at + length], tail.end() if tail else at + length
    elif strict:
        raise SyntaxProblem(f"a stream without a length at {at}")
    m = _END_STREAM.search(data, at)
    if not m:
        return data[at:], len(data)
    raw = data[at : m.start()]
    for tail in (b"\r\n", b"\n", b"\r"):
        if raw.endswith(tail):
            raw = raw[: -len(tail)]
            break
    return raw, m.end() if m[0] == b"endstream" else m.start()


def physical_objects(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(position, object number, generation) of everything that looks like the start of an indirect object."""
    for m in re.finditer(rb"(?<![0-9])(\d{1,10})[" + _SPACE + rb"]+(\d{1,5})[" + _SPACE + rb"]+obj(?![a-z])", data):
        yield m.start(), int(m[1]), int(m[2])


_KEYS = {
    "BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width", "L": "Length",
}


def inline_image(data: bytes, at: int) -> tuple[Stream, int]:
    """The image whose dictionary starts at `at`, after "BI", and where its "EI" ends."""
    items: list[Any] = []
    stack: list[list[Any]] = [items]
    start = len(data)
    for t in tokens(data, at):
        if t.kind == "keyword" and t.value == "ID":
            start = t.end + 1
            break
        if t.kind == "mark" and t.value in ("[", "<<"):
            stack.append([])
        elif t.kind == "mark" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(build_dict(inner, False) if t.value == ">>" else inner)
        else:
            stack[-1].append(None if t.value == "null" else t.value)
    attrs = {_KEYS.get(k, k): v for k, v in build_dict(items, False).items()}
    filters = attrs.get("Filter")
    first = filters[0] if isinstance(filters, list) and filters else filters
    length = attrs.get("Length")
    m = None
    if type(length) is int and length >= 0:
        m = re.compile(rb"\s*EI\b").match(data, start + length)
        stop = start + length
    if m is None:
        shape = rb"(?<=~>)\s*EI\b" if first in ("A85", "ASCII85Decode") else rb"(?<=>)\s*EI\b" if first in ("AHx", "ASCIIHexDecode") else rb"\sEI(?=\s|$)"
        # what follows a true end are tokens: no byte outside of ASCII
        for m in re.compile(shape).finditer(data, max(start - 1, 0)):
            if first in ("A85", "ASCII85Decode", "AHx", "ASCIIHexDecode") or not re.search(rb"[^\x09-\x7e]", data[m.end() : m.end() + 12]):
                break
        else:
            last = data.rfind(b"EI", start)
            if last < 0:
                return Stream(attrs, data[start:]), len(data)
            return Stream(attrs, data[start:last]), last + 2
        stop = m.start()
    return Stream(attrs, data[start : max(start, stop)]), m.end()



def content_operations(data: bytes) -> Iterator[tuple[int, str, list[Any]]]:
    """(position, operator, operands) of a content stream; an inline image is the operand of "EI".

    What Parser gives without references, in one loop.
    """
    operands: list[Any] = []
    stack: list[tuple[str, list[Any]]] = []
    names: dict[bytes, Name] = {}
    words: dict[bytes, str] = {}
    inner = operands  # what values go to
    match, at, end = _CONTENT.match, 0, len(data)

    def close() -> str:
        nonlocal inner
        mark, items = stack.pop()
        inner = stack[-1][1] if stack else operands
        inner.append(build_dict(items, False) if mark == "<<" else items)
        return mark

    while m := match(data, at, end):
        kind, at = m.lastindex, m.end()
        raw = m[kind]
        if kind == _NUMBER:
            inner.append(float(raw) if b"." in raw else int(raw))
        elif kind == _WORD or kind == 8:
            if (said := words.get(raw)) is None:
                if kind == _WORD and raw in (b"true", b"false", b"null"):
                    inner.append(None if raw == b"null" else raw == b"true")
                    continue
                if kind == _WORD and (n := _NUMBER_PREFIX.match(raw)) and not raw[n.end() : n.end() + 1].isalpha():
                    inner.append(float(n[0]) if b"." in n[0] else int(n[0]))
                    at = m.start(kind) + n.end()
                    if data[at : at + 1] in (b".", b"-", b"+"):
                        junk = _JUNK.match(data, at, end)
                        at = junk.end() if junk else at
                    continue
                said = words[raw] = raw.decode("latin-1")
            if stack:
                if said not in ("endobj", "endstream", "stream", "obj", "xref", "trailer"):
                    inner.append(Keyword(said))
                    continue
                while stack:
                    close()
            if said == "BI":
                image, at = inline_image(data, m.start(kind) + 2)
                yield m.start(kind), "EI", [image]
            else:
                yield m.start(kind), said, operands
            operands = inner = []
        elif kind == _PLAIN_STRING:
            inner.append(raw)
        elif kind == _NAME:
            if (name := names.get(raw)) is None:
                name = names[raw] = Name(unescape_name(raw))
            inner.append(name)
        elif kind == _MARK:
            said = raw.decode()
            if said in ("[", "<<", "{"):
                inner = []
                stack.append((said, inner))
            elif any(mark == _PAIRS[said] for mark, _ in stack):
                while close() != _PAIRS[said]:
                    pass
        elif kind == _HEX:
            inner.append(unhex(raw))
        else:
            value, at = read_string(data, at)
            inner.append(value)
