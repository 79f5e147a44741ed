"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow text
columns, for use inside ``mapInArrow`` tasks.

Texts are processed in chunks of whole documents of about ``CHUNK`` bytes, so
the temporary arrays stay small whatever the batch size is (a single longer
document is a chunk of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Random 64-bit value of each byte.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256)
FOLD[ord("A"):ord("Z") + 1] += 32
BYTE_VALUE_FOLDED = BYTE_VALUE[FOLD]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE


#: glibc's malloc_trim, where there is one
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory, and the tables of powers, to the system.  Arrays of
    some megabytes come and go with every batch, and a worker that serves many
    tasks would otherwise keep the most that any of them ever held."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Chunk(NamedTuple):
    first: int  # row of the batch at which it begins
    buf: np.ndarray  # uint8, the texts one after another
    offs: np.ndarray  # int64, n + 1 offsets of the documents in buf


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Whole documents of a string column, about ``limit`` bytes at a time;
    a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j
    if offs[-1] - offs[0] > limit:
        give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    if n > 4 * CHUNK:  # one very long document: do not keep its tables
        out = _powers[0], _powers[1]
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        return out
    return _powers[0], _powers[1]


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True, never across documents."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    padded = np.zeros(n + 2, bool)
    padded[1:-1] = member
    before, at = padded[:-1], padded[1:]
    return np.flatnonzero(at & (~before | edge)), np.flatnonzero(before & (~at | edge))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, from one running sum over the buffer."""
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value[buf] * power[:len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k values in a row (order counts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        factor = (factor * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF | 1
        g += h[j:j + n] * np.uint64(factor)
    return mix(g)


def per_document(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n + 1 indexes: document i has the spans from [i] to [i + 1]."""
    return np.searchsorted(starts, offs[:-1], "left").tolist() + [len(starts)]
