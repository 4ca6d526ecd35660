"""Standard security handlers: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import stringprep
import struct
import unicodedata
from hashlib import md5, sha256, sha384, sha512
from itertools import cycle
from typing import Any

import numpy as np

from .values import EncryptionProblem, Stream, WrongPassword

PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    box, at = bytearray(range(256)), 0
    for place, byte in zip(range(256), cycle(key), strict=False):
        mine = box[place]
        at = (at + mine + byte) & 255
        box[place], box[at] = box[at], mine
    out, at = bytearray(data), 0
    for k in range(len(out)):
        place = (k + 1) & 255
        mine = box[place]
        at = (at + mine) & 255
        other = box[at]
        box[place], box[at] = other, mine
        out[k] ^= box[(mine + other) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _tables() -> tuple[list[int], list[int], list[list[int]]]:
    """The S-box, its inverse, and products by 2, 3, 9, 11, 13 and 14."""
    powers = [1]
    for _ in range(254):
        powers.append(powers[-1] ^ _double(powers[-1]))
    logs = {p: k for k, p in enumerate(powers)}
    box = []
    for x in range(256):
        y = powers[-logs[x] % 255] if x else 0
        box.append(y ^ 0x63)
        for turn in range(1, 5):
            box[-1] ^= ((y << turn) | (y >> (8 - turn))) & 255
    inverse = [0] * 256
    for x, y in enumerate(box):
        inverse[y] = x
    times = [[powers[(logs[x] + logs[m]) % 255] if x else 0 for x in range(256)] for m in (2, 3, 9, 11, 13, 14)]
    return box, inverse, times


_BOX, _UNBOX, (_X2, _X3, _X9, _X11, _X13, _X14) = _tables()
#: For each place of a byte in its column, the column it adds to a round of encryption, by the byte before substitution.
_COLUMNS = [[int.from_bytes(bytes([_X2[x], x, x, _X3[x]][(i - k) % 4] for i in range(4)), "big") for x in _BOX] for k in range(4)]
_NUMPY = {k: np.array(t, np.uint8) for k, t in (("box", _UNBOX), (9, _X9), (11, _X11), (13, _X13), (14, _X14))}
#: Where each byte of a block comes from when its rows are moved back.
_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


class Aes:
    """One key's block cipher; CBC over it."""

    def __init__(self, key: bytes) -> None:
        n = len(key) // 4
        words = [list(key[k : k + 4]) for k in range(0, len(key), 4)]
        turn = 1
        while len(words) < 4 * (n + 7):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [_BOX[x] for x in w[1:] + w[:1]]
                w[0] ^= turn
                turn = _double(turn)
            elif n > 6 and len(words) % n == 4:
                w = [_BOX[x] for x in w]
            words.append([x ^ y for x, y in zip(w, words[-n], strict=True)])
        self.rounds = [sum(words[k : k + 4], []) for k in range(0, len(words), 4)]
        self.keys = np.array(self.rounds, np.uint8)

    def encrypt(self, block: bytes) -> bytes:
        s = [x ^ k for x, k in zip(block, self.rounds[0], strict=True)]
        for key in self.rounds[1:-1]:
            t = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            s = []
            for c in range(0, 16, 4):
                a, b, d, e = t[c : c + 4]
                s += [_X2[a] ^ _X3[b] ^ d ^ e, a ^ _X2[b] ^ _X3[d] ^ e, a ^ b ^ _X2[d] ^ _X3[e], _X3[a] ^ b ^ d ^ _X2[e]]
            s = [x ^ k for x, k in zip(s, key, strict=True)]
        return bytes(_BOX[s[(i + 4 * (i % 4)) % 16]] ^ self.rounds[-1][i] for i in range(16))

    def decrypt(self, block: bytes) -> bytes:
        s = [x ^ k for x, k in zip(block, self.rounds[-1], strict=True)]
        for key in self.rounds[-2:0:-1]:
            t = [_UNBOX[s[(i - 4 * (i % 4)) % 16]] ^ key[i] for i in range(16)]
            s = []
            for c in range(0, 16, 4):
                a, b, d, e = t[c : c + 4]
                s += [
                    _X14[a] ^ _X11[b] ^ _X13[d] ^ _X9[e], _X9[a] ^ _X14[b] ^ _X11[d] ^ _X13[e],
                    _X13[a] ^ _X9[b] ^ _X14[d] ^ _X11[e], _X11[a] ^ _X13[b] ^ _X9[d] ^ _X14[e],
                ]
        return bytes(_UNBOX[s[(i - 4 * (i % 4)) % 16]] ^ self.rounds[0][i] for i in range(16))

    def cbc_decrypt(self, data: bytes, iv: bytes) -> bytes:
        """All blocks at once: each needs only the one before it as it was written."""
        n = len(data) // 16
        if not n:
            return b""
        blocks = np.frombuffer(data, np.uint8, 16 * n).reshape(n, 16)
        s = blocks ^ self.keys[-1]
        for key in self.keys[-2:0:-1]:
            a, b, d, e = ((_NUMPY["box"][s[:, _BACK]] ^ key).reshape(n, 4, 4)[:, :, k] for k in range(4))
            s = np.stack([_NUMPY[x][a] ^ _NUMPY[y][b] ^ _NUMPY[z][d] ^ _NUMPY[w][e] for x, y, z, w in ((14, 11, 13, 9), (9, 14, 11, 13), (13, 9, 14, 11), (11, 13, 9, 14))], axis=2).reshape(n, 16)
        s = _NUMPY["box"][s[:, _BACK]] ^ self.keys[0]
        s[0] ^= np.frombuffer(iv, np.uint8, 16)
        s[1:] ^= blocks[:-1]
        return s.tobytes()

    def cbc_encrypt(self, data: bytes, iv: bytes) -> bytes:
        """Column by column as 32-bit words, whose sums the tables hold."""
        if len(data) % 16 or len(iv) != 16:
            raise ValueError("no whole blocks")
        t0, t1, t2, t3 = _COLUMNS
        box, (first, *middle, last) = _BOX, [struct.unpack(">4I", bytes(r)) for r in self.rounds]
        a, b, c, d = struct.unpack(">4I", iv)
        out = []
        for p, q, r, s in struct.iter_unpack(">4I", data):
            a, b, c, d = a ^ p ^ first[0], b ^ q ^ first[1], c ^ r ^ first[2], d ^ s ^ first[3]
            for j, k, m, n in middle:
                a, b, c, d = (
                    t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ j, t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k,
                    t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ m, t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ n,
                )
            a, b, c, d = (
                (box[x >> 24] << 24 | box[y >> 16 & 255] << 16 | box[z >> 8 & 255] << 8 | box[w & 255]) ^ k
                for (x, y, z, w), k in zip(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)), last, strict=True)
            )
            out += a, b, c, d
        return struct.pack(f">{len(out)}I", *out)


def unpadded(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data.endswith(bytes([n]) * n) else data


def prepared(password: str) -> str:
    """SASLprep: mapped, normalised; a password with forbidden characters, or with both directions of writing, is wrong."""
    mapped = "".join(" " if stringprep.in_table_c12(c) else "" if stringprep.in_table_b1(c) else c for c in password)
    said = unicodedata.normalize("NFKC", mapped)
    forbidden = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9)
    if any(f(c) for c in said for f in forbidden):
        raise WrongPassword("the password has characters that aren't allowed")
    if any(map(stringprep.in_table_d1, said)) and not (stringprep.in_table_d1(said[0]) and stringprep.in_table_d1(said[-1]) and not any(map(stringprep.in_table_d2, said))):
        raise WrongPassword("the password mixes directions of writing")
    return said


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    k = sha256(password + salt + user).digest()
    turn = 0
    while True:
        e = Aes(k[:16]).cbc_encrypt((password + k + user) * 64, k[16:32])
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        turn += 1
        if turn >= 64 and e[-1] <= turn - 32:
            return k[:32]


class Security:
    """The decipherer of one file. Raises WrongPassword where neither password fits."""

    def __init__(self, encrypt: dict[str, Any], file_id: bytes, password: str = "") -> None:
        self.v, self.r = encrypt.get("V", 0), encrypt.get("R", 2)
        if encrypt.get("Filter") != "Standard" or self.v not in (1, 2, 4, 5) or self.r not in (2, 3, 4, 5, 6):
            raise EncryptionProblem(f"encryption {encrypt.get('Filter')} V {self.v} R {self.r}")
        self.p = int(encrypt.get("P", -1)) & 0xFFFFFFFF
        self.o, self.u, self.id = bytes(encrypt.get("O", b"")), bytes(encrypt.get("U", b"")), file_id
        self.metadata = encrypt.get("EncryptMetadata", True)
        self.size = 5 if self.r == 2 else int(encrypt.get("Length", 40)) // 8
        self.method = "V2"
        if self.v in (4, 5):
            filters = encrypt.get("CF") or {}
            names = encrypt.get("StmF", "Identity"), encrypt.get("StrF", "Identity")
            if names[0] != names[1]:
                raise EncryptionProblem("strings and streams under different filters")
            self.method = "Identity" if names[0] == "Identity" else str((filters.get(names[0]) or {}).get("CFM", "None"))
            if self.method not in ("V2", "AESV2", "AESV3", "Identity"):
                raise EncryptionProblem(f"crypt filter method {self.method}")
            if self.v == 4:
                self.size = 16
        key = self._key_v5(encrypt, password) if self.v == 5 else self._key(password)
        if key is None:
            raise WrongPassword("the password fits neither user nor owner")
        self.key = key

    def _file_key(self, password: bytes) -> bytes:
        h = md5((password + PAD)[:32] + self.o + struct.pack("<I", self.p) + self.id)
        if self.r >= 4 and not self.metadata:
            h.update(b"\xff" * 4)
        return self._rehashed(h.digest(), self.size)[: self.size]

    def _rehashed(self, key: bytes, n: int) -> bytes:
        """From revision 3 on, fifty times more."""
        for _ in range(50 * (self.r > 2)):
            key = md5(key[:n]).digest()
        return key

    def _proof(self, key: bytes) -> bytes:
        """What a file has as U, from its key."""
        out = PAD if self.r < 3 else md5(PAD + self.id).digest()
        for turn in range(1 if self.r < 3 else 20):
            out = rc4(bytes(turn ^ x for x in key), out)
        return out

    def _user(self, password: bytes) -> bytes | None:
        key = self._file_key(password)
        n = 32 if self.r == 2 else 16
        return key if self._proof(key)[:n] == self.u[:n] else None

    def _key(self, password: str) -> bytes | None:
        raw = password.encode("latin-1", "replace")
        if (key := self._user(raw)) is not None:
            return key
        own = self._rehashed(md5((raw + PAD)[:32]).digest(), 16)
        own, user = own[: self.size], self.o
        for i in reversed(range(20 if self.r > 2 else 1)):
            user = rc4(bytes(x ^ i for x in own), user)
        return self._user(user)

    def _key_v5(self, encrypt: dict[str, Any], password: str) -> bytes | None:
        raw = (prepared(password) if self.r == 6 else password).encode()[:127]
        for stored, wrapped, extra in ((self.o, encrypt.get("OE"), self.u[:48]), (self.u, encrypt.get("UE"), b"")):
            digest = (lambda salt, e=extra: hash_r6(raw, salt, e)) if self.r == 6 else (lambda salt, e=extra: sha256(raw + salt + e).digest())
            if digest(stored[32:40]) == stored[:32]:
                return Aes(digest(stored[40:48])).cbc_decrypt(bytes(wrapped)[:32], bytes(16))
        return None

    def decipher(self, objid: int, revision: int, data: bytes) -> bytes:
        if self.method == "Identity":
            return data
        if self.method == "AESV3":
            return unpadded(Aes(self.key).cbc_decrypt(data[16:], data[:16])) if len(data) >= 16 else data
        salted = self.key + struct.pack("<I", objid)[:3] + struct.pack("<I", revision)[:2] + (b"sAlT" if self.method == "AESV2" else b"")
        key = md5(salted).digest()[: min(len(self.key) + 5, 16)]
        if self.method == "AESV2":
            return unpadded(Aes(key).cbc_decrypt(data[16:], data[:16])) if len(data) >= 16 else data
        return rc4(key, data)

    def decipher_strings(self, objid: int, genno: int, value: Any) -> Any:
        if isinstance(value, bytes):
            return self.decipher(objid, genno, value)
        if isinstance(value, list):
            return [self.decipher_strings(objid, genno, v) for v in value]
        if isinstance(value, dict):
            return {k: self.decipher_strings(objid, genno, v) for k, v in value.items()}
        if isinstance(value, Stream):
            value.attrs = self.decipher_strings(objid, genno, value.attrs)
            if not (value.attrs.get("Type") == "XRef" or value.attrs.get("Type") == "Metadata" and not self.metadata):
                value.decipher = self
        return value

    @property
    def permissions(self) -> tuple[bool, bool, bool]:
        """Whether one may print, modify and extract."""
        return bool(self.p & 4), bool(self.p & 8), bool(self.p & 16)
