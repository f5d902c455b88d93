"""Vectorised words and fingerprints over Arrow string columns.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}. Every byte of a multi-byte UTF-8 character is above 0x7F,
so byte runs and code-point runs agree. A word's name hashes its length and its bytes in lanes of eight, each lane mixed
into the state by a multiplication and a bijective finaliser, so a byte's place counts non-linearly; words longer than LONG
bytes are named by BLAKE2b. A name is 64 bits wide; `wide` gives a second one by other constants, independent of the first,
for whoever needs 128 bits. Words of at most eight bytes and equal length never share a name.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: For words of letters and digits alone: every other ASCII character separates.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Byte maps: as they are, and with A-Z lower-cased.
BYTE = np.arange(256, dtype=np.uint8)
LOWER = BYTE.copy()
LOWER[65:91] += 32
LONG = 128
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Start, factor and step of the first name and of the second.
_KEYS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0x2545F4914F6CDD1D))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Fingerprint of an ordered pair."""
    return mix(a * U(0xD6E8FEB86659FD93) + mix(b + U((salt * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))


def column(c: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    if pa.types.is_null(c.type):
        c = c.cast(pa.string())
    if c.null_count:
        c = c.fill_null("" if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else b"")
    c = c.cast(pa.large_binary())
    buf = c.buffers()
    off = np.frombuffer(buf[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - (off[0] if len(off) else 0)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Names of the byte strings data[starts[i]:ends[i]]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))
    size = ends - starts
    seed, factor, step = map(U, _KEYS[key])
    out = mix(size.astype(np.uint64) * factor + seed)
    lane, left = lanes[starts] & _MASKS[np.minimum(size, 8)], None
    out = mix((out ^ lane * factor) + step)
    at = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(at):
        left = size[at] - done
        lane = lanes[starts[at] + done] & _MASKS[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ lane * factor) + step)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest()[8 * key : 8 * key + 8], "little")
    return out


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray, space: np.ndarray = SPACE, wide: bool = False) -> tuple:
    """Of texts data[off[i]:off[i+1]]: each word's start, end (bytes), name, and where each text's words begin (n + 1); with
    `wide`, the second name too. `table` maps bytes before they are named."""
    n = len(data)
    if not n:
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return (z, z, h, np.zeros(len(off), np.int64), *[h] * wide)
    edge = np.empty(n + 1, bool)
    ink = ~space[data]
    edge[0], edge[n] = True, True
    edge[1:n] = ~ink[:-1]
    edge[off[(off > 0) & (off < n)]] = True
    starts = np.flatnonzero(ink & edge[:n])
    edge[1:n] = ~ink[1:]
    edge[off[(off > 0) & (off < n)]] = True
    ends = np.flatnonzero(ink & edge[1:]) + 1
    seen = data if table is BYTE else table[data]
    return (starts, ends, names(seen, starts, ends), np.searchsorted(starts, off), *([names(seen, starts, ends, 1)] * wide if wide else []))


def chunks(off: np.ndarray, most: int = 1 << 19):
    """Ranges of whole texts of about `most` bytes, one text at least; what they took goes back to the system at the end,
    as the worker lives on beside others."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j
    tidy()


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per owner: owner of each element, and its rank within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
