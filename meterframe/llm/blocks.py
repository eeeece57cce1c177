"""Texts of an Arrow batch as numpy blocks of words.

A block holds whole texts, or one part of a very long text, of about ``BLOCK_BYTES`` bytes together, so that the
arrays derived from it stay small however long a text is. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

BLOCK_BYTES = 1 << 20
_U = np.uint64
_FOLD = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Block:
    """``text``: words divided by one space each; word i is text[starts[i]:ends[i]]; row r has words first[r]:first[r + 1]."""

    rows: np.ndarray
    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(np.frombuffer(self.text, np.uint8), self.starts, self.ends)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _lanes(windows: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each span, or as many as are left of it."""
    return windows[starts] & (~_U(0) >> (_U(64) - _U(8) * np.minimum(left, 8).astype(_U)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes after eight are mixed into a state that begins with the length.

    Spans of up to eight bytes collide with none of their length. Very long ones are hashed by XXH64.
    """
    lengths = ends - starts
    state = mix(lengths.astype(_U) * _U(_BASE) + _U(1))
    windows, at, k = _windows(data), np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN)), 0
    while len(at):
        state[at] = mix((state[at] ^ _lanes(windows, starts[at] + k, lengths[at] - k)) * _U(_BASE))
        k += 8
        at = at[lengths[at] > k]
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        state[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], int(state[i]))
    return state


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct span, the number of each span's distinct one), told apart by their bytes.

    Spans of equal hashes are compared with their first one; should one differ, all are told apart by a dictionary.
    """
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths, other = ends - starts, starts[first][number]
    windows, same = _windows(data), np.array_equal(lengths, lengths[first][number])
    at, k = np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN) & (other != starts)), 0
    while same and len(at):
        same = np.array_equal(_lanes(windows, starts[at] + k, lengths[at] - k), _lanes(windows, other[at] + k, lengths[at] - k))
        k += 8
        at = at[lengths[at] > k]
    for i in np.flatnonzero((lengths > LONG_SPAN) & (other != starts)).tolist() if same else ():
        same = same and np.array_equal(data[starts[i] : ends[i]], data[other[i] : other[i] + lengths[i]])
    if same:
        return first, number
    names: dict[bytes, int] = {}
    raw = data.tobytes()
    number = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(number, return_index=True)[1], number


def _parts(texts: Iterable[tuple[int, bytes]], overlap: int) -> Iterator[tuple[int, bytes]]:
    """Each text folded; very long ones in parts cut at white space, a part repeating the last ``overlap`` words before it."""
    for row, text in texts:
        text = text.translate(_FOLD)
        while len(text) > 2 * BLOCK_BYTES and (cut := text.find(b" ", BLOCK_BYTES)) > 0:
            head = text[:cut]
            words = head.split()
            yield row, head
            rest = text[cut:].lstrip(b" ")
            if not rest:
                text = b""
                break
            text = b" ".join([*words[max(0, len(words) - overlap) :], rest]) if overlap else rest
        else:
            yield row, text


def blocks(texts: Iterable[tuple[int, bytes]], overlap: int = 0) -> Iterator[Block]:
    """Blocks of (row, UTF-8 bytes). A row that is cut into parts is in more than one block."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for row, text in _parts(texts, overlap):
        if size and size + len(text) > BLOCK_BYTES:
            yield _block(rows, held)
            rows, held, size = [], [], 0
        rows.append(row)
        held.append(text)
        size += len(text) + 1
    if rows:
        yield _block(rows, held)


def _block(rows: list[int], texts: list[bytes]) -> Block:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = data != 32
    after = np.zeros(len(data), bool)
    after[1:] = solid[:-1]
    ends_before = np.cumsum(after & ~solid)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.zeros(len(texts) + 1, np.int64)
    first[1:] = ends_before[np.cumsum(lengths) - 1]
    kept = data[solid | after]
    ends = np.flatnonzero(kept == 32)
    starts = np.zeros(len(ends), np.int64)
    if len(ends):
        starts[1:] = ends[:-1] + 1
    return Block(np.asarray(rows, np.int64), kept.tobytes(), starts, ends, first)


def shingle_spans(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, row bounds) of all runs of ``size`` words; a shorter row is one run; an empty row has none."""
    counts = block.counts
    each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(each, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], each) + np.repeat(block.first[:-1], each)
    last = at + np.repeat(np.minimum(counts, size), each) - 1
    return at, last, bounds


def shingle_hashes(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle, and the row bounds."""
    first, last, bounds = shingle_spans(block, size)
    words = block.hashes()
    out = np.zeros(len(first), _U)
    short = last - first + 1
    for k in range(size):
        here = np.minimum(first + k, last)
        step = mix(words[here] + _U(k + 1))
        if short.size and short.min() < size:
            step = np.where(k < short, step, _U(0))
        out = (out ^ step) * _U(0xD6E8FEB86659FD93)
    return mix(out), bounds


def sliced(run, rows: int = 1024):
    """A function of batches, each handled on its own, fed with slices of them; unused Arrow memory is given back at the end."""
    import pyarrow as pa

    def fed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from run(iter([batch.slice(at, rows)]))
        pa.default_memory_pool().release_unused()

    return fed


def column_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
