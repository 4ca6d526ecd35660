"""Secret scan by token efficiency.

A public vocabulary spells words in few tokens and random strings in many: a run of key
characters with a low ratio of characters to tokens is reported. The ratio is the better
one of the run and its lower case, so that capitals alone don't make a word random. Runs of
``min_length`` characters are tested wherever they are; a value that a name introduces
(``password = ...``) from ``LEAST_VALUE`` on, if it mixes letters and digits or both cases.
In ``NAME=value`` the value is tested by itself.

Before the test, known digests and identifiers are set aside: UUIDs; runs of digits, or
of one repeated character; hosts and mail addresses; digests with their algorithm or commit
named before them, and hexadecimal runs of a digest's exact length that nothing introduces
as a secret (``token = "..."`` does). Of a URL the password, the values of its query and
each part of its path are tested, the latter if they mix letters and digits.

Defined results: null and empty texts have no findings; a null doc_id is reported as null;
repeated rows are scanned each; where two readings overlap, the longer run counts, else the
earlier; an empty table gives an empty result. Whole texts are scanned. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TOKENIZERS, encoding

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_LENGTH = 20
#: The shortest introduced value that a ratio of characters to tokens says something about.
LEAST_VALUE = 8
MAX_RATIO = 2.1
COLUMNS = "doc_id bigint, start bigint, stop bigint, n_tokens bigint, chars_per_token double, introduced_by string"
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile("[A-Fa-f0-9]{8}(?:-[A-Fa-f0-9]{4}){3}-[A-Fa-f0-9]{12}")
HEX = re.compile("[A-Fa-f0-9]+")
WORDS = r"token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth\w*|bearer|credential\w*|key"
#: A name that has such a word in it, then a sign; or the word itself, then white space.
SECRET_WORD = re.compile(rf"(?i)({WORDS})(?:[\w.-]{{0,40}}[\"']?\s{{0,3}}(?:=>|:=|[=:])|[\"']?\s)\s{{0,3}}[\"'`]?$")
DIGEST_WORD = re.compile(r"(?i)(?:md5|sha-?\d{1,3}(?:[-/]\d{3})?|digest|checksum|commit|revision|etag|integrity|hash|blake\w*)[\"']?[\s=:\-(]{1,4}[\"'`]?$")
INTRODUCED = re.compile(rf"(?i)({WORDS})[\w.-]{{0,40}}[\"']?\s{{0,3}}(?:=>|:=|[=:])\s{{0,3}}[\"'`]?([A-Za-z0-9_+/!#$%^&*.~-]{{{LEAST_VALUE},}}=*)")
#: A run in a URL: what stands between its "://" and the run.
IN_URL = re.compile(r"://(\S*)$")
ADDRESS = re.compile(r"(?i)(?:www\.\S*|@\S*|[\w.]/)$")
#: Texts that neither pattern can match are left out in the JVM.
TRIGGER = f"[A-Za-z0-9_+/-]{{{MIN_LENGTH}}}|(?i)token|secret|passw|passphrase|pwd|auth|bearer|credential|key"
REACH = 60


def mixed(run: str) -> bool:
    """Whether a run has letters of both cases, or letters and digits."""
    return any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run) > 1


def known(run: str, before: str, introduced: bool) -> bool:
    """Whether a run is an identifier or digest rather than a secret."""
    core = run.strip("=-_/+")
    if UUID.fullmatch(core) or core.isdigit() or len(set(core)) < 5 or DIGEST_WORD.search(before):
        return True
    return not introduced and len(core) in DIGEST_LENGTHS and HEX.fullmatch(core) is not None


def runs(text: str, min_length: int) -> Iterator[tuple[int, int, str | None]]:
    """(start, stop, introducing word) of what is to be tested."""
    for m in re.finditer(r"[A-Za-z0-9_+/-]{%d,}={0,2}" % min_length, text):
        start, stop = m.span()
        before = text[max(0, start - REACH) : start]
        url = IN_URL.search(before)
        if "//" in m.group() and not url:
            continue
        if not url:
            if text[stop : stop + 1] != "@" and not ADDRESS.search(before):
                word = SECRET_WORD.search(before)
                yield start, stop, word.group(1).lower() if word else None
            continue
        where = url.group(1)
        if text[stop : stop + 1] == "@":  # user:password@
            yield start, stop, "url"
            continue
        in_query = "?" in where or "#" in where
        for p in re.finditer("[^/]+" if not in_query else ".+", m.group()):
            a, z = start + p.start(), start + p.end()
            if a == start and not where:
                continue  # the host
            word = SECRET_WORD.search(text[max(0, a - REACH) : a]) if in_query else None
            if z - a >= min_length and mixed(text[a:z]):
                yield a, z, word.group(1).lower() if word else None
    for m in INTRODUCED.finditer(text):
        value = m.group(2).rstrip(".!*")
        if len(value) >= LEAST_VALUE and mixed(value) and "//" not in value:
            yield m.start(2), m.start(2) + len(value), m.group(1).lower()


def findings(text: str, encode: Callable[[str], list[int]], min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int, float, str | None]]:
    """(start, stop, tokens, characters per token, word that introduces it) of every suspect run."""
    out: list[tuple[int, int, int, float, str | None]] = []
    end = -1
    for start, stop, word in sorted(runs(text, min_length), key=lambda r: (r[0], -r[1], r[2] is None)):
        if stop <= end:
            continue
        run = text[start:stop]
        if known(run, text[max(0, start - REACH) : start], word is not None):
            continue
        n, lower = len(encode(run)), len(encode(run.lower()))
        ratio = len(run) / min(n, lower)
        if ratio <= max_ratio:
            if start < end:  # overlaps a finding that ends within it
                if stop - start <= out[-1][1] - out[-1][0]:
                    continue
                out.pop()
            out.append((start, stop, n, ratio, word))
            end = stop
    return out


def scan_secrets(docs: DataFrame, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row a finding. Rows with nothing to test are left out in the JVM; no shuffle."""
    path = f"{tokenizers}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in findings(t, encode, min_length, max_ratio)]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    wanted = TRIGGER.replace(f"{{{MIN_LENGTH}}}", f"{{{min_length}}}", 1)
    return docs.select("doc_id", "text").where(docs["text"].rlike(wanted)).mapInArrow(run, COLUMNS)
