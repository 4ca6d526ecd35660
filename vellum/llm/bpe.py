"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds
the longest token at every position of a piece. The encoder takes the longest token that
is compatible with the token before it (the pair would survive BPE's own merges), tries
that token's own longest proper prefix next, and steps back where none fits; compatibility
of two adjacent tokens is memoised and positions once given up are never tried again, so
the work is linear. The result is the merges' result, token for token.

Defined results: a null text has null tokens; an empty text has none; repeated rows are
encoded each; no two merges have one rank, so there are no ties; an empty table gives an empty table. Texts are taken whole, in any length.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import PATTERN, TOKENIZERS, load_ranks

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose tokens a process keeps; beyond it the memo starts anew.
MEMO = 300_000
#: Characters of texts whose tokens are gathered at once, and stretches whose places are.
TOGETHER = 1 << 20
STRETCHES = 1 << 17
#: Cuts a text where the pattern always cuts it, for texts with runs of white space.
CHUNKS = regex.compile(r"\s+(?!\S)| ?\S+|\s+")
COLUMNS = "doc_id bigint, tokens array<int>, n_tokens bigint, roundtrip boolean"


class Memo(dict):
    """The numbers, in a codec's pool, of words, each with an optional space before it."""

    def __init__(self, codec: Codec, before: str) -> None:
        self.codec, self.before = codec, before

    def __missing__(self, word: str) -> int:
        found = self.codec.keep(self.codec.encode_chunk(self.before + word))
        if len(word) < 100:
            self[word] = found
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pattern = regex.compile(PATTERN)
        self.word, self.spaced, self.chunk = Memo(self, ""), Memo(self, " "), Memo(self, "")
        # the tokens of the words that are known: where they start, and how many there are
        self.pool, self.starts, self.sizes = array("i"), array("q"), array("q")
        self.token_sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.token_sizes[list(self.length)] = list(self.length.values())
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.blob = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token last; None for one that no merge makes."""
        if token not in self.parts:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], token), k) for k in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: undoing merges from the latest back, no pair across the border merges earlier."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= 4 * MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        bound = 1 << 60  # merges from here on happen too late to matter
        while True:
            merged = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if merged is not None and merged < bound:
                return False
            pa_, pb = self.split(a), self.split(b)
            if pa_ and (a > b or not pb):
                # a ends the left side until it is made; a merge across would have come before
                bound, a = a, pa_[1]
            elif pb:
                bound, b = b + 1, pb[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        best = [0] * len(piece)
        for end, (n, token) in self.automaton.iter(piece.decode("latin-1")):
            at = end - n + 1
            if n > best[at]:
                best[at], longest[at] = n, token
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token, size = 0, longest[0], len(piece)
        length, compatible = self.length, self.compatible
        while True:
            last = out[-1] if out else -1
            candidate: int | None = token
            while candidate is not None:
                end = at + length[candidate]
                if not dead[end] and (last < 0 or compatible(last, candidate)):
                    break
                candidate = self.prefix(candidate)
            if candidate is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                continue
            out.append(candidate)
            at = end
            if at == size:
                return out
            token = longest[at]

    def encode_chunk(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            found = self.pieces.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode())
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                if len(piece) < 100:
                    self.pieces[piece] = found
            out += found
        return out

    def keep(self, tokens: Sequence[int]) -> int:
        self.starts.append(len(self.pool))
        self.sizes.append(len(tokens))
        self.pool.extend(tokens)
        return len(self.starts) - 1

    def words(self, text: str) -> list[int]:
        """The numbers of a text's words."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n":
            return list(map(self.chunk.__getitem__, CHUNKS.findall(text)))
        out: list[int] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append(self.word["\n"])
            out.append(self.word[words[0]])
            out += map(self.spaced.__getitem__, words[1:])
        return out

    def encode(self, text: str) -> Iterator[int]:
        return iter(self.encode_all([text])[0].tolist())

    def encode_all(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of several texts, one after the other, and how many each has."""
        if len(self.starts) >= MEMO:  # never while a number is in use
            for known in (self.word, self.spaced, self.chunk):
                known.clear()
            self.pool, self.starts, self.sizes = array("i"), array("q"), array("q")
        found: list[int] = []
        ends = [0]
        for t in texts:
            found += self.words(t)
            ends.append(len(found))
        own = np.array(found, np.int64)
        sizes = np.array(self.sizes, np.int64)[own]
        tokens = gathered(np.array(self.pool, np.int32), np.array(self.starts, np.int64)[own], sizes)
        return tokens, np.diff(np.append(0, np.cumsum(sizes))[ends])

    def decode_all(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens, and how many each has."""
        sizes = self.token_sizes[tokens]
        return gathered(self.blob, self.token_starts[tokens], sizes), sizes

    def decode(self, tokens: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of values, one after the other; their places are computed for some at a time."""
    out = [values[:0]]
    for k in range(0, len(starts), STRETCHES):
        first, n = starts[k : k + STRETCHES], sizes[k : k + STRETCHES]
        ends = np.cumsum(n)
        out.append(values[np.arange(ends[-1]) + np.repeat(first - (ends - n), n)])
    return np.concatenate(out)


def same_bytes(raw: Sequence[bytes], found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text, whether the bytes found for it, so many, are its own."""
    lengths = np.array(list(map(len, raw)), np.int64)
    if not (lengths == sizes).all():
        ends = np.cumsum(sizes)
        return np.array([found[e - n : e].tobytes() == r for r, e, n in zip(raw, ends, sizes, strict=True)], bool)
    out = np.ones(len(raw), bool)
    wrong = np.flatnonzero(found != np.frombuffer(b"".join(raw), np.uint8))
    out[np.searchsorted(np.cumsum(lengths), wrong, side="right")] = False
    return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(load_ranks(path))


def encode_documents(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The tokens of every row, and whether decoding them gave its bytes back; no shuffle."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            sizes = np.cumsum([len(t or "") for t in whole.column(1).to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // TOGETHER)) + 1).tolist(), whole.num_rows]
            for k, end in zip(cuts, cuts[1:], strict=False):
                b = whole.slice(k, end - k)
                null = b.column(1).is_null().to_numpy(zero_copy_only=False)
                texts = [t or "" for t in b.column(1).to_pylist()]
                tokens, counts = c.encode_all(texts)
                found, lengths = c.decode_all(tokens)
                ends = np.append(0, np.cumsum(counts))
                back = np.diff(np.append(0, np.cumsum(lengths))[ends])
                same = same_bytes([t.encode() for t in texts], found, back)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(null, False)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(counts, mask=null), pa.array(same, mask=null)], ["doc_id", "tokens", "n_tokens", "roundtrip"])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def decode_documents(rows: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give a null text, invalid UTF-8 becomes U+FFFD."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if t is None else c.decode(t).decode(errors="replace") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")
