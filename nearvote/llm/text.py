"""Vectorised tokenising and hashing of batches of texts, shared by the operators in this folder.

A batch is joined into one UTF-8 buffer with a separator between texts, and every step is a numpy
operation over that buffer, so the cost a byte stays at a few nanoseconds whatever the text lengths.
Hashes are 64-bit polynomials over random byte values, finished with an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 19
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def byte_values(separators: bytes, lower: bool) -> np.ndarray:
    """A table from a byte to a random 64-bit value; separators map to 0, A-Z like a-z if asked."""
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


#: Words are runs of ASCII letters and digits and of all that is not ASCII; A-Z count as a-z.
ALNUM = byte_values(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), lower=True)
#: Words are runs of anything but ASCII white space, as they stand.
SPACED = byte_values(ASCII_SPACE, lower=False)


def mix(x: np.ndarray) -> np.ndarray:
    """An avalanche step: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2**64."""
    got = _cache.get(base)
    if got is None or len(got) < n:
        got = _cache[base] = _powers(base, 1 << max(16, (n - 1).bit_length()))
        if len(got) > 4 * CHUNK_BYTES:  # of one very long text: not worth keeping
            _cache.pop(base)
    return got[:n]


class Words:
    """The words of a chunk of texts: hashes, byte spans in `data`, and each text's range of words."""

    def __init__(self, texts: list[str | None], values: np.ndarray):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n" + b"\n".join(raw) + b"\n"
        self.text_starts = np.cumsum([1] + [len(r) + 1 for r in raw])[: len(raw)].astype(np.int64)
        codes = np.frombuffer(self.data, np.uint8)
        value = values[codes]
        inside = value != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        value *= powers(_MULTIPLIER, len(value))
        total = np.cumsum(value, dtype=np.uint64)
        hashes = (total[self.ends - 1] - total[self.starts - 1]) * powers(_INVERSE, len(value))[self.starts]
        self.hashes = mix(hashes)
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.last = np.append(self.first[1:], len(self.starts))
        self.counts = self.last - self.first

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def rolling(hashes: np.ndarray, n: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The hash of every n words in a row, by the place of the first; the ends of texts don't matter."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = multiplier | 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(m, len(hashes)), dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * powers(pow(m, -1, 1 << 64), len(hashes))[: len(hashes) - n + 1])


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes in all."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
