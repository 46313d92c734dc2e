"""Vectorised helpers over Arrow string batches, used inside Spark tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these
byte values inside a multi-byte character, so words can be cut on raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and number of texts handled at once, whatever the size of a batch; a
#: single longer text is handled alone.
STEP_BYTES = 2_000_000
STEP_TEXTS = 8192

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.default_rng(20240131)
_BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_KEYS_LOWER = _BYTE_KEYS[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd number, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _STEP, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """Some texts of a batch: their bytes end to end and where each begins."""

    first: int  # row in the batch of the first text
    data: np.ndarray
    offsets: np.ndarray  # int64, one more than there are texts

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts(column: pa.Array, step: int = STEP_BYTES) -> Iterator[Texts]:
    """Cuts a string column into runs of about step bytes and at most STEP_TEXTS
    texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1
        to = min(max(to, at + 1), at + STEP_TEXTS, n)
        yield Texts(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def spans(t: Texts, breaks: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of bytes that are not breaks."""
    inside = ~breaks[t.data]
    full = t.offsets[:-1] < t.offsets[1:]
    opens = np.empty(len(inside), dtype=bool)
    closes = np.empty(len(inside), dtype=bool)
    if len(inside):
        opens[0], closes[-1] = True, True
        opens[1:] = ~inside[:-1]
        closes[:-1] = ~inside[1:]
        opens[t.offsets[:-1][full]] = True
        closes[t.offsets[1:][full] - 1] = True
    starts = np.flatnonzero(inside & opens)
    ends = np.flatnonzero(inside & closes) + 1
    return starts, ends, np.searchsorted(t.offsets, starts, side="right") - 1


def span_hashes(t: Texts, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and apart."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    keys = (_BYTE_KEYS_LOWER if lower else _BYTE_KEYS)[t.data]
    nth = np.arange(len(t.data), dtype=np.int64)
    base = np.zeros(len(t.data), dtype=np.int64)
    base[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(t.data))))
    nth -= base
    inside = nth < np.repeat(np.concatenate([[0], lengths]), np.diff(np.concatenate([[0], starts, [len(t.data)]])))
    nth[~inside] = 0
    keys = keys * powers(int(lengths.max()) + 1)[nth]
    keys[~inside] = 0
    return mix(np.add.reduceat(keys, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by text."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of width words that lies in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashes[first + k] + _STEP)
    return out, first
