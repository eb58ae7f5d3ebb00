"""Vectorised hashing of words and word windows over Arrow string batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd multipliers (any odd number has an inverse modulo 2**64).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
WORD_RE = r"[^\x20\x09-\x0D]+"
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (n grows by doubling)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(n, b, U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        _POWERS[base] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), bijective."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[s:e] for each span; equal spans have equal hashes anywhere."""
    p, inv = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * p[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U))


def text_blocks(column: pa.Array, size: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a string column (nulls count as empty) into runs of rows of about `size` bytes.

    Yields (first row, end row, bytes of those rows, row bounds in these bytes).
    """
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs without white space, within rows; and the first word of each row.

    Returns (starts, ends, word bounds of rows).
    """
    n = len(raw)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    begin[cuts] = solid[cuts]
    stop = np.zeros(n + 1, bool)
    stop[1:n] = solid[: n - 1] & ~solid[1:]
    stop[cuts] = solid[cuts - 1]
    if n:
        stop[n] = solid[n - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, bounds)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Groups of rows with equal first n_keys columns, over batches sorted by them; the other columns as arrays."""
    held: list[list[np.ndarray]] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.zeros(batch.num_rows, bool)
        for c in cols[:n_keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[s] for c in cols[:n_keys])
            if key != now and now is not None:
                yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = key
            held.append([c[s:e] for c in cols[n_keys:]])
    if now is not None:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
