"""Stream filters: bytes to bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np

from .ccitt import decode_fax
from .values import PdfError

_LONG = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Left as they are: the bytes are an image file of their own.
OPAQUE = {"DCTDecode", "JPXDecode", "JBIG2Decode"}


def flate(data: bytes) -> bytes:
    """Inflated; of a damaged stream, as much as can be had."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        pass
    for start, window in ((data, 15), (data[2:], -15)):
        z, out = zlib.decompressobj(window), bytearray()
        try:
            for k in range(0, len(start), 256):
                out += z.decompress(start[k : k + 256])
        except zlib.error:
            pass
        if out:
            return bytes(out)
    return b""


def _lzw_ends(early: int) -> tuple[np.ndarray, np.ndarray]:
    """(widths, bits up to the end) of the codes after a clear code, as far as widths grow: the first adds no entry, each other one."""
    sizes = [0, *range(258 + early, 4096 + early)]
    widths = np.array([min(12, max(9, n.bit_length())) for n in sizes], np.int64)
    return widths, np.cumsum(widths)


_LZW = {early: _lzw_ends(early) for early in (0, 1)}
#: Codes that are cut from the bits at once.
_CODES = 512
#: Bytes of text up to which every byte is followed to its source at once.
_SPREAD = 1 << 18


def lzw(data: bytes, early: int = 1) -> bytes:
    """Stops at the end mark or at a code that no table entry has."""
    widths, ends = _LZW[early] if early in _LZW else _lzw_ends(early)
    padded = np.frombuffer(bytes(data) + bytes(3), np.uint8).astype(np.int64)
    windows = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    out: list[bytes] = []
    at, stop = 0, 8 * len(data)
    while True:  # from one clear code to the next
        held: list[np.ndarray] = []
        done, after = 0, -1  # codes since the clear code, and the code that ends them
        while after < 0:
            cut = ends[done : done + _CODES]
            if len(cut):
                own = widths[done : done + len(cut)]
                cut = cut - (ends[done - 1] if done else 0) + at
            else:
                own = np.full(_CODES, 12)
                cut = at + np.cumsum(own)
            count = int(np.searchsorted(cut, stop, "right"))
            own, cut = own[:count], cut[:count]
            starts = cut - own
            codes = windows[starts >> 3] >> (24 - (starts & 7) - own) & ((1 << own) - 1)
            marks = np.flatnonzero(codes >> 1 == 128)  # 256 and 257
            if len(marks):
                after, at = int(codes[marks[0]]), int(cut[marks[0]])
                codes = codes[: marks[0]]
            elif count < len(ends[done : done + _CODES]) or not count:
                after = 257
            else:
                at = int(cut[-1])
            held.append(codes)
            done += len(codes)
        codes = np.concatenate(held)
        wrong = np.flatnonzero(codes - 258 >= np.arange(len(codes)))
        if len(wrong):
            codes, after = codes[: wrong[0]], 257
        out.append(_lzw_text(codes))
        if after == 257:
            return b"".join(out)


def _lzw_text(codes: np.ndarray) -> bytes:
    """What the codes after a clear code stand for: entry 258 + n is the text of code n with the byte that follows it."""
    n = len(codes)
    if not n:
        return b""
    up = np.where(codes >= 258, codes - 258, n)
    far = np.append(up < n, False).astype(np.int64)
    jump = np.append(up, n)
    while (jump < n).any():
        far += far[jump]
        jump = jump[jump]
    sizes = far[:n] + 1
    starts = np.cumsum(sizes) - sizes
    if int(sizes.sum()) > _SPREAD:  # long repeats: text by text
        text = bytearray()
        for code, start, size in zip(codes.tolist(), np.append(starts, 0)[up].tolist(), sizes.tolist(), strict=True):
            if code < 256:
                text.append(code)
            elif start + size > len(text):
                text += text[start:] + text[start : start + 1]
            else:
                text += text[start : start + size]
        return bytes(text)
    own = np.repeat(np.arange(n), sizes)
    places = np.arange(len(own))
    source = np.where(up[own] < n, np.append(starts, 0)[up[own]] + places - starts[own], places)
    while not np.array_equal(source, before := source[source]):
        source = before
    return codes[own[source]].astype(np.uint8).tobytes()


def ascii85(data: bytes) -> bytes:
    body = re.sub(rb"\s", b"", data)
    body = body.removeprefix(b"<~").split(b"~")[0]
    out, group = bytearray(), []
    whole = len(body) // 5 * 5 if re.fullmatch(rb"[!-u]*", body) else 0  # groups that can be taken together
    if whole:
        digits = np.frombuffer(body, np.uint8, whole).reshape(-1, 5).astype(np.int64) - 33
        out += (digits @ np.array([85**k for k in (4, 3, 2, 1, 0)]) & 0xFFFFFFFF).astype(">u4").tobytes()
    for c in body[whole:]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                n = 0
                for d in group:
                    n = n * 85 + d
                out += (n & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = 0
        for d in group + [84] * (5 - len(group)):
            n = n * 85 + d
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def asciihex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def runlength(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data) and data[k] != 128:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def png_rows(data: bytes, colors: int, columns: int, bits: int) -> bytes:
    """Undoes the PNG predictors, each row by its own type."""
    size, back = (colors * columns * bits + 7) // 8, max(1, colors * bits // 8)
    above, out = bytearray(size), bytearray()
    for k in range(0, len(data), size + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + size])
        if kind == 1 and back == 1 and row:
            row = bytearray(np.add.accumulate(np.frombuffer(row, np.uint8), dtype=np.uint8).tobytes())
        elif kind == 1:
            for i in range(back, len(row)):
                row[i] = (row[i] + row[i - back]) & 255
        elif kind == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8, len(row))).tobytes())
        elif kind == 3 and back == 1:
            left = 0
            for i, (x, up) in enumerate(zip(row, above, strict=False)):
                row[i] = left = x + (left + up >> 1) & 255
        elif kind == 3:
            for i in range(len(row)):
                row[i] = (row[i] + ((row[i - back] if i >= back else 0) + above[i]) // 2) & 255
        elif kind == 4 and back == 1:
            left = corner = 0
            for i, (x, up) in enumerate(zip(row, above, strict=False)):
                dl, du, dc = up - corner, left - corner, left + up - corner - corner
                dl, du, dc = dl if dl >= 0 else -dl, du if du >= 0 else -du, dc if dc >= 0 else -dc
                row[i] = left = x + (left if dl <= du and dl <= dc else up if du <= dc else corner) & 255
                corner = up
        elif kind == 4:
            for i in range(len(row)):
                left, up, corner = (row[i - back] if i >= back else 0), above[i], (above[i - back] if i >= back else 0)
                guess = left + up - corner
                dl, du, dc = abs(guess - left), abs(guess - up), abs(guess - corner)
                row[i] = (row[i] + (left if dl <= du and dl <= dc else up if du <= dc else corner)) & 255
        out += row
        above = row + bytes(size - len(row))
    return bytes(out)


def tiff_rows(data: bytes, colors: int, columns: int, bits: int) -> bytes:
    if bits != 8:
        raise PdfError(f"a TIFF predictor over {bits} bits")
    out, size = bytearray(data), colors * columns
    for start in range(0, len(out), size):
        for i in range(start + colors, min(start + size, len(out))):
            out[i] = (out[i] + out[i - colors]) & 255
    return bytes(out)


def unpredicted(data: bytes, params: dict[str, Any]) -> bytes:
    predictor = params.get("Predictor", 1)
    if not isinstance(predictor, int) or predictor < 2:
        return data
    shape = (int(params.get("Colors", 1)), int(params.get("Columns", 1)), int(params.get("BitsPerComponent", 8)))
    return tiff_rows(data, *shape) if predictor == 2 else png_rows(data, *shape)


FILTERS: dict[str, Callable[[bytes, dict[str, Any]], bytes]] = {
    "FlateDecode": lambda d, p: flate(d),
    "LZWDecode": lambda d, p: lzw(d, p.get("EarlyChange", 1) if isinstance(p.get("EarlyChange", 1), int) else 1),
    "ASCII85Decode": lambda d, p: ascii85(d),
    "ASCIIHexDecode": lambda d, p: asciihex(d),
    "RunLengthDecode": lambda d, p: runlength(d),
    "CCITTFaxDecode": lambda d, p: decode_fax(d, p),
}


def filter_list(attrs: dict[str, Any]) -> list[tuple[str, dict[str, Any]]]:
    """(filter, parameters) in the order of decoding."""
    names, params = attrs.get("Filter", attrs.get("F")), attrs.get("DecodeParms", attrs.get("DP", attrs.get("FDecodeParms")))
    names = [] if names is None else names if isinstance(names, list) else [names]
    params = params if isinstance(params, list) else [params] * max(1, len(names))
    params += [None] * (len(names) - len(params))
    return [(_LONG.get(str(n), str(n)), p if isinstance(p, dict) else {}) for n, p in zip(names, params, strict=False)]


def decoded(data: bytes, filters: list[tuple[str, dict[str, Any]]]) -> bytes:
    """The bytes after all filters, up to the first that holds an image file."""
    for name, params in filters:
        if name in OPAQUE:
            break
        if name not in FILTERS:
            raise PdfError(f"unknown filter {name}")
        data = unpredicted(FILTERS[name](data, params), params)
    return data
