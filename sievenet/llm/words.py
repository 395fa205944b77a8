"""Words and word n-grams of whole texts as 64-bit hashes, computed on UTF-8 bytes.

All separators are ASCII, so bytes of a multi-byte character never split a word
and byte classes equal the classes on code points.  Hashes are sums of a random
number per byte times powers of an odd number, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes handled at once; a longer text makes a chunk of its own
U64 = np.uint64


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


class Alphabet:
    """What parts words and what letters count as equal.  separators: byte values; fold: lower-case A-Z."""

    def __init__(self, separators: bytes, fold: bool):
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        values = _byte_values(20_011)
        if fold:
            values[65:91] = values[97:123]
        self.values = values


SPACES = bytes([0x20, *range(0x09, 0x0E)])
FOLDED_WORDS = Alphabet(SPACES, True)
PLAIN_WORDS = Alphabet(SPACES, False)

_STEP = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, U64)
_INVERSES = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number, and of its inverse."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            row = np.full(size, base, U64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=U64))
        _POWERS, _INVERSES = made
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Chunk:
    """Words of a run of texts.

    first: index of the first text; offsets: byte at which each text starts, and the end; bounds:
    its word index; inside: bytes of words; starts, ends: byte positions in data; hashes: one per word.
    """

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        self.first, self.data, self.offsets = first, data, offsets
        n = len(data)
        self.inside = inside = alphabet.word[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cut = offsets[1:-1]
            before[cut[cut < n]] = False
            after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(alphabet.values[data] * power[:n], out=total[1:])
        lengths = (self.ends - self.starts).astype(U64)
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + lengths * U64(0xD6E8FEB86659FD93))

    def texts(self) -> Iterator[tuple[int, int, int]]:
        """Index of each text, and its first and end word."""
        for i in range(len(self.bounds) - 1):
            yield self.first + i, int(self.bounds[i]), int(self.bounds[i + 1])

    def owners(self) -> np.ndarray:
        """For each word, the place of its text in the chunk."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that cross into the next text must be left out by the caller."""
        return grams(self.hashes, n)

    def whole(self, n: int) -> np.ndarray:
        """For each word, whether n words from it on lie in its text."""
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return np.arange(len(self.hashes)) + n <= last

    def joined(self, kept: np.ndarray) -> pa.StringArray:
        """Each text's kept words, joined by one space."""
        out, taken = self.data.copy(), self.inside.copy()
        words = np.flatnonzero(kept)
        if len(words) < len(kept):
            change = np.zeros(len(out) + 1, np.int8)
            change[self.starts[~kept]] += 1
            change[self.ends[~kept]] -= 1
            taken &= np.cumsum(change[:-1], dtype=np.int8) == 0
        owners = self.owners()[words]
        # before a word that isn't the first of its text a separator makes room for the space
        spaces = self.starts[words[1:][owners[1:] == owners[:-1]]] - 1
        out[spaces], taken[spaces] = 0x20, True
        ends = np.concatenate([[0], np.cumsum(taken)])[self.offsets].astype(np.int32)
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(out[taken]))

    def string(self, start: int, end: int) -> list[bytes]:
        raw = self.data
        return [raw[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end], strict=True)]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; as long as hashes, the last n - 1 are of no use."""
    out = np.zeros(len(hashes), U64)
    whole = len(hashes) - n + 1
    if whole > 0:
        factor = 1
        for k in range(n):
            out[:whole] += hashes[k : k + whole] * U64(factor)
            factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    return mix(out)


def chunks(column: pa.Array, alphabet: Alphabet, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of an Arrow string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    count = len(column)
    if not count:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + count + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < count:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        yield Chunk(at, raw[low:high], offsets[at : end + 1] - low, alphabet)
        at = end
