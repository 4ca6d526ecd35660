"""Image streams as files: JPEG, JPEG 2000 and JBIG2 as they are, samples as PBM, PGM, PPM or TIFF."""

from __future__ import annotations

import struct
from typing import Any

from .document import Document
from .values import PdfError, Stream


def samples(data: bytes, width: int, height: int, parts: int, bits: int) -> bytes:
    """One byte for each sample of 1, 2 or 4 bits, scaled up unless they are indices; rows end on a byte."""
    if bits == 8:
        return data
    per, mask = 8 // bits, (1 << bits) - 1
    size = -(-width * parts * bits // 8)
    out = bytearray()
    for y in range(height):
        row = data[y * size : (y + 1) * size]
        line = [(b >> (8 - bits * (k + 1))) & mask for b in row for k in range(per)]
        out += bytes(line[: width * parts])
    return bytes(out)


def tiff(data: bytes, width: int, height: int) -> bytes:
    """Four 8-bit inks, uncompressed."""
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 4, 8), (259, 3, 1, 1), (262, 3, 1, 5), (273, 4, 1, 8 + 2 + 12 * 9 + 4 + 8), (277, 3, 1, 4), (278, 4, 1, height), (279, 4, 1, len(data))]
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        if tag == 258:
            value = 8 + 2 + 12 * len(entries) + 4
        out += struct.pack("<HHII", tag, kind, count, value)
    return out + struct.pack("<I", 0) + struct.pack("<4H", 8, 8, 8, 8) + data


def jbig2(doc: Document, stream: Stream, data: bytes) -> bytes:
    """A file of the stream's segments, after the global ones, with the header and the end that files have."""
    params = next((p for f, p in doc.filters(stream) if f == "JBIG2Decode"), {})
    shared = doc.resolve(params.get("JBIG2Globals"))
    head = b"\x97JB2\r\n\x1a\n\x01" + struct.pack(">I", 1)
    return head + (doc.stream_bytes(shared) if isinstance(shared, Stream) else b"") + data + struct.pack(">IBBBI", 0xFFFF, 51, 0, 0, 0)


def companions(doc: Document, stream: Stream) -> list[tuple[str, Stream]]:
    """The masks and alternates of an image."""
    found = [(k.lower(), doc.resolve(stream.attrs.get(k))) for k in ("Mask", "SMask")]
    found += [(f"alternate{i}", doc.resolve(doc.dict_of(a).get("Image"))) for i, a in enumerate(doc.list_of(stream.attrs.get("Alternates")))]
    return [(k, v) for k, v in found if isinstance(v, Stream)]


def image_file(doc: Document, stream: Stream, attrs: dict[str, Any]) -> tuple[str, bytes]:
    """(suffix, bytes) of an image."""
    try:
        data = doc.stream_bytes(stream)
    except PdfError as e:
        doc.warnings.append(f"image {stream.objid}: {e}")
        return ".dat", stream.raw
    last = attrs["filters"][-1] if attrs["filters"] else None
    if last in ("DCTDecode", "JPXDecode", "JBIG2Decode"):
        suffix = {"DCTDecode": ".jpg", "JPXDecode": ".jp2", "JBIG2Decode": ".jb2"}[last]
        return suffix, jbig2(doc, stream, data) if suffix == ".jb2" else data
    w, h, bits, parts = attrs["width"], attrs["height"], attrs["bits"], attrs["components"]
    head = f"{w} {h}\n".encode()
    if attrs["colorspace"] == "Indexed":
        spec = doc.resolve_all(stream.attrs.get("ColorSpace"))
        table = spec[3] if isinstance(spec, list) and len(spec) > 3 else b""
        table = doc.stream_bytes(table) if isinstance(table, Stream) else table
        base = str(spec[1]) if isinstance(spec, list) and len(spec) > 1 and isinstance(spec[1], str) else "DeviceRGB"
        parts = {"DeviceGray": 1, "DeviceCMYK": 4}.get(base, 3)
        data = b"".join(table[parts * i : parts * i + parts].ljust(parts, b"\0") for i in samples(data, w, h, 1, bits))
        bits = 8
    elif bits == 1 and parts == 1:
        return ".pbm", b"P4\n" + head + bytes(255 - b for b in data)
    if bits in (1, 2, 4):
        scale = 255 // ((1 << bits) - 1)
        data = bytes(x * scale for x in samples(data, w, h, parts, bits))
    elif bits != 8:
        return ".dat", data
    if parts in (1, 3):
        return (".pgm", b"P5\n" + head + b"255\n" + data) if parts == 1 else (".ppm", b"P6\n" + head + b"255\n" + data)
    return (".tif", tiff(data, w, h)) if parts == 4 else (".dat", data)
