"""Hashed byte trigrams of whole texts, and sums of a weight table over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20


def buckets(texts: list[bytes], count: int, table: bytes | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (row, bucket) of each trigram; ``table`` translates bytes first. A text has a blank
    before and after it; trigrams with two blanks side by side are left out."""
    shift = np.uint32(32 - (count.bit_length() - 1))

    def block(rows: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        row = np.repeat(np.asarray(rows, np.int64), [len(p) for p in parts])
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        same = (part[:-2] == part[2:]) & ((data[:-2] != 32) | (data[1:-1] != 32)) & ((data[1:-1] != 32) | (data[2:] != 32))
        return row[:-2][same], ((code * np.uint32(2654435769)) >> shift)[same].astype(np.int64)

    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = b" " + (text.translate(table) if table else text) + b" "
        for at in range(0, max(1, len(text) - 2), BLOCK_BYTES):
            if size > BLOCK_BYTES:
                yield block(rows, parts)
                rows, parts, size = [], [], 0
            piece = text[at : at + BLOCK_BYTES + 2]
            rows.append(i)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield block(rows, parts)


def counts(texts: list[bytes], groups: np.ndarray, n_groups: int, count: int, table: bytes | None = None) -> np.ndarray:
    """Trigram counts by (group of the text, bucket); texts of group -1 are left out."""
    out = np.zeros(n_groups * count, np.int64)
    for row, bucket in buckets(texts, count, table):
        group = groups[row]
        out += np.bincount((group * count + bucket)[group >= 0], minlength=len(out))
    return out.reshape(n_groups, count)


def sums(texts: list[bytes], weights: np.ndarray, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of trigrams, sum of each row of ``weights`` over the trigrams) by text."""
    total = np.zeros(len(texts))
    out = np.zeros((len(texts), len(weights)))
    for row, bucket in buckets(texts, weights.shape[1], table):
        total += np.bincount(row, minlength=len(texts))
        for k, w in enumerate(weights):
            out[:, k] += np.bincount(row, w[bucket], len(texts))
    return total, out
