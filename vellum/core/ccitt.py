"""CCITT fax decoding: Group 4, Group 3 in one dimension, and Group 3 mixed."""

from __future__ import annotations

from typing import Any

_WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 "
    "00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 "
    "01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
)
_WHITE_UP = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 "
    "011011011 010011000 010011001 010011010 011000 010011011"
)
_BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 "
    "00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 "
    "000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 "
    "000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
)
_BLACK_UP = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 "
    "0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
_LONG_UP = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"


def _runs(short: str, up: str) -> dict[str, int]:
    table = {c: n for n, c in enumerate(short.split())}
    table |= {c: 64 * (n + 1) for n, c in enumerate(up.split())}
    return table | {c: 1792 + 64 * n for n, c in enumerate(_LONG_UP.split())}


RUNS = (_runs(_WHITE, _WHITE_UP), _runs(_BLACK, _BLACK_UP))
_MODES = {"0001": "pass", "001": "across", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


class _End(Exception):
    """No more lines, by an end mark, the end of the data or damage."""


class Bits:
    def __init__(self, data: bytes) -> None:
        self.all = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def code(self, table: dict[str, Any]) -> Any:
        for n in range(1, 14):
            if (found := table.get(self.all[self.at : self.at + n])) is not None:
                self.at += n
                return found
        raise _End

    def end_mark(self) -> bool:
        """Whether an EOL stands here, after fill; it is consumed."""
        one = self.all.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        return False

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.code(RUNS[color])
            total += n
            if n < 64:
                return total


def _line_1d(bits: Bits, columns: int) -> list[int]:
    """The positions at which the color changes, white first."""
    changes, at, color = [], 0, 0
    while at < columns:
        at = min(columns, at + bits.run(color))
        changes.append(at)
        color ^= 1
    return changes


def _line_2d(bits: Bits, above: list[int], columns: int) -> list[int]:
    changes: list[int] = []
    at, color = -1, 0
    while at < columns:
        # b1: the first change of the line above right of `at`, to the color opposite to ours
        k = next((k for k, x in enumerate(above) if x > at and k % 2 == color and x < columns), None)
        b1 = above[k] if k is not None else columns
        b2 = above[k + 1] if k is not None and k + 1 < len(above) else columns
        mode = bits.code(_MODES)
        if mode == "pass":
            at = b2
        elif mode == "across":
            first = bits.run(color)
            second = bits.run(color ^ 1)
            start = max(at, 0)
            changes += [min(columns, start + first), min(columns, start + first + second)]
            at = changes[-1]
        else:
            at = min(columns, max(0, b1 + mode))
            changes.append(at)
            color ^= 1
        if at >= columns:
            break
    return changes


def _packed(changes: list[int], columns: int, black_is_1: bool) -> bytes:
    line = bytearray(columns)
    for k in range(0, len(changes), 2):
        end = changes[k + 1] if k + 1 < len(changes) else columns
        line[changes[k] : end] = b"\1" * max(0, end - changes[k])
    flip = 0 if black_is_1 else 1
    text = "".join(str(x ^ flip) for x in line[:columns])
    text += "0" * (-len(text) % 8)
    return int(text or "0", 2).to_bytes(len(text) // 8, "big") if text else b""


def decode_fax(data: bytes, params: dict[str, Any]) -> bytes:
    """Lines of packed pixels; damage ends the image with the lines before it."""
    k, columns, rows = params.get("K", 0), params.get("Columns", 1728), params.get("Rows", 0)
    align, black = bool(params.get("EncodedByteAlign", False)), bool(params.get("BlackIs1", False))
    bits, out, above, done = Bits(data), bytearray(), [columns], 0
    try:
        while (not rows or done < rows) and bits.at < len(bits.all):
            if align:
                bits.at = -(-bits.at // 8) * 8
            if k == -1:
                if bits.end_mark():
                    break
                above = _line_2d(bits, above, columns)
            else:
                marks = 0
                while bits.end_mark():
                    marks += 1
                    tag = bits.all[bits.at : bits.at + 1] if k else "1"
                    bits.at += 1 if k else 0
                if marks > 1:
                    break
                if not marks and k:
                    tag = bits.all[bits.at : bits.at + 1]
                    bits.at += 1
                one = k == 0 or tag == "1"
                above = _line_1d(bits, columns) if one else _line_2d(bits, above, columns)
            out += _packed(above, columns, black)
            done += 1
    except _End:
        pass
    return bytes(out)
