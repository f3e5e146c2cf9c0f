"""Vectorised text primitives over Arrow string columns.

A column of texts is one byte buffer with offsets, so words, lines and shingles of thousands of
documents are found with a few NumPy passes and no loop over documents or characters. Work goes in
blocks of a quarter of a megabyte to stay in cache and to bound a task's memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_COMBINE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Hashes of spans are values of two polynomials modulo this prime, so they hang on no property of its binary digits.
PRIME = (1 << 31) - 1
_P = np.uint64(PRIME)
_BASES = tuple(int(x) for x in _rng.integers(1 << 20, PRIME - 1, 2))
#: A multiple of the prime above all running sums.
_ABOVE = np.uint64(PRIME << 30)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes whose powers a worker keeps; longer texts are summed in runs of so many.
RUN = BLOCK_BYTES + (1 << 16)
_tables: list[tuple[np.ndarray, np.ndarray]] | None = None


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, in place, by folding its bits over twice."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= _P
        x += high
    return np.subtract(x, _P, out=x, where=x >= _P)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), PRIME)))])
    return out[:n]


def tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each polynomial the powers 0..RUN of its base and of the inverse."""
    global _tables
    if _tables is None:
        _tables = [tuple(_powers(x, RUN + 1).astype(np.uint32) for x in (b, pow(b, -1, PRIME))) for b in _BASES]
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Texts ``data[ptr[i]:ptr[i + 1]]``; ``row`` is the first text's place in its batch."""

    data: np.ndarray
    ptr: np.ndarray
    row: int

    def __len__(self) -> int:
        return len(self.ptr) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ptr = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ptr


#: The C library's own call that returns freed memory to the system, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what Arrow and NumPy have freed: a worker lives on between tasks, and its executor counts its memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of whole texts of about ``limit`` bytes; one longer text is a block of its own."""
    data, ptr = buffers(column)
    i, n = 0, len(ptr) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + limit, "right")) - 1)
        yield Block(data[ptr[i] : ptr[j]], ptr[i : j + 1] - ptr[i], i)
        i = j
    give_back()


def spans(inside: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, also broken where a text begins."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = ptr[:-1][ptr[:-1] < ptr[1:]]
    before[first] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[first[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each text's words begin in them (one more entry than texts)."""
    starts, ends = spans(~SPACE[block.data], block.ptr)
    return starts, ends, np.searchsorted(starts, block.ptr)


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts between line feeds, empty ones included, and each text's first."""
    breaks = np.flatnonzero(block.data == 10)
    n = len(block)
    doc = np.concatenate([np.searchsorted(block.ptr, breaks, "right") - 1, np.arange(n)])
    starts = np.concatenate([breaks + 1, block.ptr[:-1]])
    ends = np.concatenate([breaks, block.ptr[1:]])
    starts, ends = starts[np.lexsort((starts, doc))], ends[np.lexsort((ends, doc))]
    return starts, ends, np.searchsorted(np.sort(doc), np.arange(n + 1))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums, one row for each polynomial, from which ``hashes`` takes the hash of any span."""
    n = len(data)
    out = np.zeros((2, n + 1), np.uint64)
    for sums, base, (up, _) in zip(out, _BASES, tables(), strict=True):
        for lo in range(0, n, RUN):
            values = data[lo : lo + RUN].astype(np.uint64)
            values += np.uint64(1)
            values *= up[: len(values)]
            part = sums[lo + 1 : lo + 1 + len(values)]
            np.cumsum(values, out=part)
            if lo:
                part[:] = _mod(_mod(part) * np.uint64(pow(base, lo, PRIME))) + np.uint64(int(sums[lo]) % PRIME)
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they stand."""
    far = bool(len(starts)) and int(starts.max()) > RUN
    halves = []
    for s, base, (_, down) in zip(sums, _BASES, tables(), strict=True):
        whole = s[ends]
        whole += _ABOVE
        whole -= s[starts]
        whole = _mod(whole)
        if far:
            runs = _powers(pow(pow(base, RUN, PRIME), -1, PRIME), int(starts.max()) // RUN + 1)
            whole *= runs[starts // RUN]
            whole = _mod(whole)
        whole *= down[starts % RUN if far else starts]
        halves.append(_mod(whole))
    halves[0] <<= np.uint64(32)
    halves[0] |= halves[1]
    return mix(halves[0])


def polynomial(sums: np.ndarray, size: int) -> np.ndarray:
    """The first polynomial's value of each span of ``size`` bytes, in order; equal bytes give equal values wherever they stand."""
    s, down = sums[0], tables()[0][1]
    whole = s[size:] + _ABOVE
    whole -= s[:-size]
    whole = _mod(whole)
    for lo in range(0, len(whole), RUN):
        part = whole[lo : lo + RUN]
        part *= np.uint64(pow(pow(_BASES[0], lo, PRIME), -1, PRIME))
        part[:] = _mod(part)
        part *= down[: len(part)]
        part[:] = _mod(part)
    return whole


def shingles(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the text of each; a text of fewer words gives one run of all."""
    n_words = np.diff(first)
    parts, owners = [], []
    if len(word_hashes) >= k:
        total = np.zeros(len(word_hashes) - k + 1, np.uint64)
        for t in range(k):
            total += word_hashes[t : len(word_hashes) - k + 1 + t] * _COMBINE[t]
        doc = np.repeat(np.arange(len(n_words)), n_words)
        whole = doc[: len(total)] == doc[k - 1 :]
        parts.append(mix(total[whole]))
        owners.append(doc[: len(total)][whole])
    for size in range(1, k):
        short = np.flatnonzero(n_words == size)
        if len(short):
            total = np.full(len(short), _COMBINE[32 + size], np.uint64)
            for t in range(size):
                total += word_hashes[first[short] + t] * _COMBINE[t]
            parts.append(mix(total))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    ptr = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ptr[1:])
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), values)
