"""Vectorised words, lines and range hashes over Arrow batches of texts.

Everything works on the UTF-8 bytes of a slice of rows at a time, so a task holds a few megabytes
whatever the batch holds; one document is never split here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 18

#: Two primes' worth of one: arithmetic modulo 2^31 - 1 in two lanes with bases of their own.
_PRIME, _BITS = np.uint64((1 << 31) - 1), np.uint64(31)
_BASES = (1_171_520_617, 1_894_369_053)
_powers: list[list[np.ndarray]] = []


def byte_table(members: str) -> np.ndarray:
    """A 256-entry truth table of the ASCII characters in ``members``."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in members]] = True
    return table


#: Bytes that separate words of ``[^\x20\x09-\x0D]+``.
SPACE = byte_table(" \t\n\x0b\x0c\r")
#: Bytes that separate words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z are lower-cased.
NOT_ALNUM = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: Lower-cases A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _fold(x: np.ndarray, times: int = 2) -> np.ndarray:
    """``x`` modulo the prime in place, but for a multiple of it: once leaves less than 2^33, twice at most the prime and 4."""
    for _ in range(times):
        high = x >> _BITS
        x &= _PRIME
        x += high
    return x


def _series(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo the prime, by doubling."""
    out, size = np.ones(n, np.uint64), 1
    while size < n:
        step = out[: min(size, n - size)] * np.uint64(pow(base, size, int(_PRIME)))
        out[size : size + len(step)] = _canonical(step)
        size *= 2
    return out


def powers(n: int) -> list[list[np.ndarray]]:
    """For each lane the powers of its base and of the base's inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [[_series(b, size), _series(pow(b, -1, int(_PRIME)), size)] for b in _BASES]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hashes of near values differ everywhere."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """62-bit polynomial hashes of any ranges of a sequence of 64-bit units, from prefix sums.

    Two lanes modulo a prime, one from each half of a unit. Modulo a power of two an odd base gives ordinary
    sequences of two symbols one hash (Thue-Morse); a prime has no such family. Equal hashes are still only
    likely equal: what counts or removes by them compares the bytes, or their digests.
    """

    def __init__(self, units: np.ndarray, small: bool = False):
        """``small``: all units are below 2^31, and either lane takes them whole."""
        n = len(units)
        self.lanes = []
        for k, (power, inverse) in enumerate(powers(n + 1)):
            prefix = np.zeros(n + 1, np.uint64)
            own = units * power[:n] if small else (units >> _BITS if k else units) & _PRIME
            if not small:
                own += np.uint64(1)
                own *= power[:n]
            np.cumsum(_fold(own, 1), out=prefix[1:])
            self.lanes.append((prefix, inverse))
        self.n = n

    def _joined(self, parts: list[np.ndarray], size: np.ndarray | np.uint64) -> np.ndarray:
        one, two = parts
        two <<= _BITS
        two ^= one
        return mix(two ^ (size << np.uint64(40)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = [_canonical(_fold(p[end] - p[start]) * q[start]) for p, q in self.lanes]
        return self._joined(parts, (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """``of`` for every range of ``size`` units."""
        n = self.n + 1 - size
        parts = [_canonical(_fold(p[size:] - p[:n]) * q[:n]) for p, q in self.lanes]
        return self._joined(parts, np.uint64(size))


def _canonical(x: np.ndarray) -> np.ndarray:
    _fold(x)
    x -= _PRIME * (x >= _PRIME)
    return x


def byte_hash(raw: np.ndarray) -> RangeHash:
    return RangeHash(raw.astype(np.uint64) + np.uint64(1), small=True)


def equal_ranges(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which ranges of ``size`` bytes from ``a`` and from ``b`` hold the same bytes."""
    out = np.ones(len(a), bool)
    full = np.flatnonzero((size > 0) & (a != b))
    if len(full):
        n = size[full]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        out[full] = np.logical_and.reduceat(raw[np.repeat(a[full], n) + step] == raw[np.repeat(b[full], n) + step], begin)
    return out


def interned(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal exactly where the byte ranges are: the hashes propose, the bytes decide."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lead = first[number]
    if ((end - start) == (end - start)[lead]).all() and equal_ranges(raw, start, start[lead], end - start).all():
        return number
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(raw[a:b].tobytes(), len(names)) for a, b in zip(start, end, strict=True)], np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal exactly where the pairs of numbers (from 0, below 2^31) are."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row boundaries in them) for slices of a batch; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offset_buffer, data = texts.buffers()
    width = np.int64 if wide else np.int32
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(offset_buffer, width, n + 1, texts.offset * width().itemsize).astype(np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, bytes(raw[bounds[at] : bounds[end]]), bounds[at : end + 1] - bounds[at]
        at = end


class Words:
    """Words of a slice of texts: where they start and end, and which row each belongs to.

    ``first[r]`` and ``first[r + 1]`` bound the words of row ``r``.
    """

    def __init__(self, data: bytes, bounds: np.ndarray, separators: np.ndarray):
        self.bytes = np.frombuffer(data, np.uint8)
        inside = ~separators[self.bytes]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        marks = bounds[1:-1]
        marks = marks[marks < len(inside)]
        before[marks] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
        ends = bounds[1:-1]
        after[ends[ends > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds).astype(np.int64)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    @property
    def ranges(self) -> RangeHash:
        """Hashes of any ranges of the slice's bytes."""
        if not hasattr(self, "_ranges"):
            self._ranges = byte_hash(self.bytes)
        return self._ranges

    def hashes(self) -> np.ndarray:
        return self.ranges.of(self.start, self.end)


def run_starts(rows: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Indices of the words at which ``length`` words of the same row start."""
    at = np.arange(len(rows))
    return at[at + length <= first[1:][rows]] if len(rows) else at


def covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places the given runs cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def row_sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between the bounds of each row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
