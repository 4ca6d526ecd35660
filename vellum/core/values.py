"""The values a PDF is made of, and how they are coerced and shown."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class PdfError(Exception):
    """Anything that keeps a file, or a part of it, from being read."""


class SyntaxProblem(PdfError):
    """Bytes that don't form what is expected where they stand."""


class EncryptionProblem(PdfError):
    """A kind of encryption that can't be undone."""


class WrongPassword(EncryptionProblem):
    """Neither the user's nor the owner's password."""


class Name(str):
    """A name such as /Type; equal to its text."""

    __slots__ = ()

    def __repr__(self) -> str:
        return "/" + str(self)


class Keyword(str):
    """A bare word: an operator, or one of the words that structure a file."""

    __slots__ = ()


@dataclass(frozen=True, slots=True)
class Ref:
    objid: int
    genno: int = 0


@dataclass(slots=True)
class Stream:
    attrs: dict[str, Any]
    raw: bytes
    objid: int | None = None
    genno: int = 0
    #: The string and stream decipherer of the object, if the file is encrypted.
    decipher: Any = field(default=None, repr=False, compare=False)


Value = Any
#: PDFDocEncoding where it isn't Latin-1.
_DOC = {0x18: "˘ˇˆ˙˝˛˚˜", 0x80: "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", 0xA0: "€"}
DOC_ENCODING = {start + i: ord(c) for start, chars in _DOC.items() for i, c in enumerate(chars)}


def text_of(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else PDFDocEncoding."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "ignore")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "ignore")
    return raw.decode("latin-1").translate(DOC_ENCODING)


def name_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def shown_bytes(raw: bytes) -> str:
    """Bytes as JSON text: UTF-16 with its mark, else ASCII, else base64."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        try:
            return raw.decode("utf-16")
        except UnicodeDecodeError:
            pass
    try:
        return raw.decode("ascii")
    except UnicodeDecodeError:
        return "base64:" + base64.b64encode(raw).decode()


#: Types with a JSON form of their own, the latest first.
_FORMS: list[tuple[type, Callable[[Any], Any]]] = []


def register_form(kind: type, form: Callable[[Any], Any]) -> None:
    """Values of a type, and of those derived from it, are written as form(value) in JSON; a worker registers its own."""
    _FORMS.insert(0, (kind, form))


def plain(value: Value, depth: int = 0) -> Any:
    """A value in the terms of JSON; a reference as "<ref:N>"."""
    for kind, form in _FORMS:
        if isinstance(value, kind):
            return form(value)
    if value is None or isinstance(value, bool | int | float):
        return value
    if isinstance(value, str):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return shown_bytes(bytes(value))
    if isinstance(value, Ref):
        return f"<ref:{value.objid}>"
    if depth > 60:
        return "..."
    if isinstance(value, Stream):
        return {"stream": plain(value.attrs, depth + 1), "length": len(value.raw)}
    if isinstance(value, dict):
        return {str(k): plain(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v, depth + 1) for v in value]
    return repr(value)


def kind_of(value: Value) -> str:
    for kinds, said in ((bool, "boolean"), (int, "integer"), (float, "real"), (Name, "name"), (Keyword, "keyword"), (bytes, "string"), (list, "array"), (Stream, "stream"), (dict, "dict"), (Ref, "reference")):
        if isinstance(value, kinds):
            return said
    return "null" if value is None else type(value).__name__


def number(value: Value, default: float = 0.0) -> float:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else default


def numbers(value: Value, count: int) -> list[float] | None:
    """The numbers of an array of exactly that many; None for anything else."""
    if isinstance(value, list) and len(value) == count and all(isinstance(x, int | float) and not isinstance(x, bool) for x in value):
        return [float(x) for x in value]
    return None
