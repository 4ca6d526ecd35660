"""Quality rules by tokeniser fertility.

A public byte-level vocabulary measures each text: characters per token, the entropy of
its tokens, and the share of characters that a byte-fallback vocabulary could only spell
as bytes. Each language, else each script, has a band of admissible values.

Defined results: a null text, an empty text and one of white space alone are rejected
(reason "empty"); the ratios of a short text scatter, so below ``short`` tokens its band is
wider, the more so the fewer they are; a measure that equals a bound is within it; texts are measured whole, in any length;
repeated rows are judged one by one; a null or unknown language
takes the band of the text's script, and a script without a band the default band. An
empty table gives an empty table. Only doc_id, text and lang are read, so other columns
may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TOKENIZERS, encoding, strings

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FALLBACK_VOCABULARY = "piece_bpe_32k.model"


@dataclass(frozen=True)
class Band:
    """Inclusive bounds; entropy as in entropy(), over 1 only in long texts."""

    min_chars: float = 1.2
    max_chars: float = 9.0
    max_fallback: float = 0.10
    min_entropy: float = 0.6
    max_entropy: float = 1.5

    def widened(self, n: int, short: int) -> Band:
        """The band for a text of n tokens. Below ``short`` it is wider: one name, number or address of up to
        ``FOREIGN`` tokens of a character each may be in it, and the other ratios scatter."""
        if not 0 < n < short:
            return self
        own, more = max(0, n - FOREIGN), 1.6 * (n**-0.5 - short**-0.5)
        least = (self.min_chars * own + min(1.0, self.min_chars) * (n - own)) / n
        return Band(least, self.max_chars * (1 + more), self.max_fallback + more / 2, self.min_entropy * max(0.0, 1 - more), self.max_entropy * (1 + more))


#: By language, else by script ("Latin", ...), else "".
BANDS: dict[str, Band] = {
    "": Band(min_chars=0.25, max_chars=12.0, max_fallback=0.6),
    "en": Band(min_chars=2.0),
    "de": Band(min_chars=2.0),
    "fr": Band(min_chars=1.9),
    "es": Band(min_chars=1.9),
    "Latin": Band(min_chars=1.5),
    "Greek": Band(min_chars=0.6),
    "Cyrillic": Band(min_chars=0.8),
    "Arabic": Band(min_chars=0.5, max_fallback=0.3),
    "Hebrew": Band(min_chars=0.5, max_fallback=0.3),
    "Devanagari": Band(min_chars=0.3, max_fallback=0.6),
    "Han": Band(min_chars=0.3, max_fallback=0.6),
    "Kana": Band(min_chars=0.3, max_fallback=0.6),
    "Hangul": Band(min_chars=0.3, max_fallback=0.6),
}
#: Tokens below which a band is widened.
SHORT = 64
FOREIGN = 32

SCRIPTS = [
    ("Greek", "Ͱ-Ͽἀ-῿"),
    ("Cyrillic", "Ѐ-ԯ"),
    ("Hebrew", "֐-׿"),
    ("Arabic", "؀-ۿݐ-ݿ"),
    ("Devanagari", "ऀ-ॿ"),
    ("Kana", "぀-ヿ"),
    ("Han", "㐀-鿿"),
    ("Hangul", "가-힯"),
]
OTHERS = re.compile("[Ͱ-\U0010ffff]")
BY_SCRIPT = [(name, re.compile(f"[{chars}]")) for name, chars in SCRIPTS]

COLUMNS = "doc_id bigint, script string, n_chars bigint, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, keep boolean, reason string"


def script_of(text: str) -> str:
    """The script that most letters outside Latin have, if they are over a fifth of the text."""
    if text.isascii() or 5 * len(OTHERS.findall(text)) <= len(text):
        return "Latin"
    counts = [(len(rx.findall(text)), name) for name, rx in BY_SCRIPT]
    most, name = max(counts, key=lambda x: x[0])
    return name if most else "Latin"


@lru_cache(maxsize=4)
def unspelled(path: str) -> re.Pattern[str]:
    """Matches each character that the vocabulary has no piece for, so that it falls back to bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {p for i in range(sp.get_piece_size()) if len(p := sp.id_to_piece(i)) == 1 and not sp.is_unknown(i)}

    return re.compile("[^" + "".join(map(re.escape, sorted(known | {" "}))) + "]")


def entropy(tokens: np.ndarray) -> float:
    """Bits of the token distribution over the most that so many tokens, or 1,024, can have; 1 for fewer than two tokens."""
    n = len(tokens)
    if n < 2:
        return 1.0
    t = np.sort(tokens)
    ends = np.flatnonzero(np.append(t[1:] != t[:-1], True)) + 1
    counts = np.diff(ends, prepend=0).astype(float)
    return float((np.log2(n) - (counts * np.log2(counts)).sum() / n) / np.log2(min(n, 1024)))


def measure(text: str, path: str, fallback: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, token entropy."""
    tokens = encoding(path).encode_to_numpy(text)
    return len(tokens), len(text) / max(1, len(tokens)), len(unspelled(fallback).findall(text)) / max(1, len(text)), entropy(tokens)


def verdict(n: int, chars: float, share: float, ent: float, band: Band, short: int = SHORT) -> str | None:
    """Why a text goes; None: it stays."""
    band = band.widened(n, short)
    if chars < band.min_chars:
        return "few characters per token"
    if chars > band.max_chars:
        return "many characters per token"
    if share > band.max_fallback:
        return "byte fallback"
    if ent < band.min_entropy:
        return "low entropy"
    return "high entropy" if ent > band.max_entropy else None


def score_fertility(docs: DataFrame, bands: dict[str, Band] = BANDS, short: int = SHORT, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row of measures and a verdict for every row of docs; no shuffle."""
    path, fallback = f"{tokenizers}/{VOCABULARY}", f"{tokenizers}/{FALLBACK_VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, lang in zip(strings(b, "doc_id"), strings(b, "text"), strings(b, "lang"), strict=True):
                text = text or ""
                if not text.strip():
                    rows.append((doc_id, None, len(text), 0, None, None, None, False, "empty"))
                    continue
                script = script_of(text)
                found = measure(text, path, fallback)
                why = verdict(*found, bands.get(lang or "-") or bands.get(script) or bands.get("") or Band(), short)
                rows.append((doc_id, script, len(text), *found, why is None, why))
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, TYPES, strict=True)], names)

    return docs.select("doc_id", "text", "lang").mapInArrow(run, COLUMNS)


TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]


def keep_good(docs: DataFrame, bands: dict[str, Band] = BANDS, short: int = SHORT, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The rows of docs that score_fertility keeps, whole and in place: a filter without shuffle or join.

    A row with a language of a dialect ("en-GB") takes the band of its script.
    """
    path, fallback = f"{tokenizers}/{VOCABULARY}", f"{tokenizers}/{FALLBACK_VOCABULARY}"
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = []
            for text, lang in zip(b.column(text_at).to_pylist(), b.column(lang_at).to_pylist(), strict=True):
                if not text or not text.strip():
                    mask.append(False)
                    continue
                band = bands.get(lang or "-") or bands.get(script_of(text)) or bands.get("") or Band()
                mask.append(verdict(*measure(text, path, fallback), band, short) is None)
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
