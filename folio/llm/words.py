"""Vectorised word splitting and hashing of UTF-8 text for the batch functions of this package.

A batch of texts is joined into one byte buffer, cut at separator bytes and hashed word by word
with NumPy, so the cost per byte is a few array operations and memory is bounded by the slice
size (``slices``).  Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(members: bytes) -> np.ndarray:
    """Boolean table of 256 entries that is true for ``members``."""
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: Everything that is not ASCII white space belongs to a word.
NOT_WHITE = ~byte_table(WHITE)
#: ASCII letters and digits and all bytes of non-ASCII characters belong to a word.
ALNUM = byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


#: Calls that drop what an operator keeps in a worker from one of its tasks to the next.
KEPT: list[Callable[[], None]] = []


def release(drop: bool = True) -> None:
    """Gives memory that a worker has freed back to the system.  Workers live on between the stages
    of a job, and what each stage leaves in the allocators adds up.  What other operators ``KEPT`` is
    dropped before; an operator that keeps something itself says so with ``drop=False``."""
    for forget in KEPT if drop else ():
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def clean(texts) -> list[str]:
    """Null texts become empty texts."""
    return [t if isinstance(t, str) else "" for t in texts]


def slices(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters (one text at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[str], member: np.ndarray = NOT_WHITE, lower: bool = True):
    """``(buffer, starts, ends, owner)``: byte spans of all words and the text each is from."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raw) + b" "
    buf = np.frombuffer(joined.translate(LOWER) if lower else joined, dtype=np.uint8)
    edge = np.diff(member[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum([len(r) + 1 for r in raw])
    return buf, starts, ends, np.searchsorted(stops, starts, side="right")


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans are not empty), eight bytes at a time."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), np.dtype("<u8"), buffer=padded, strides=(1,))
    h = mix(size.astype(np.uint64) * _LENGTH ^ (eight[starts] & _FIRST[np.minimum(size, 8)]))
    left, at = np.flatnonzero(size > 8), 8
    while len(left):
        part = eight[starts[left] + at] & _FIRST[np.minimum(size[left] - at, 8)]
        h[left] = mix(h[left] * _BASE + part)
        at += 8
        left = left[size[left] > at]
    return h


def word_hashes(texts: list[str], member: np.ndarray = NOT_WHITE, lower: bool = True):
    """``(hash, owner)`` of every word of every text, in order."""
    buf, starts, ends, owner = word_spans(texts, member, lower)
    return hash_spans(buf, starts, ends), owner


def chain(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; ``len(words) - n + 1`` values."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : len(words) - n + 1 + j]
    return mix(h + np.uint64(n))


def shingle_sets(texts: list[str], width: int = 5):
    """``(hash, owner, n)``: the distinct word shingles of each text, ascending by (owner, hash).

    A text with 1 to ``width - 1`` words has one shingle, its whole word sequence; a text
    without words has none.
    """
    words, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    h = chain(words, width)
    own = owner[: len(h)]
    inside = own == owner[width - 1 :] if len(h) else np.zeros(0, dtype=bool)
    parts, owners = [h[inside]], [own[inside]]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            g = np.zeros(len(short), dtype=np.uint64)
            for j in range(size):
                g = g * np.uint64(0xC2B2AE3D27D4EB4F) + words[first[short] + j]
            parts.append(mix(g + np.uint64(size)))
            owners.append(short)
    h, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[keep], own[keep]
    return h, own, np.bincount(own, minlength=len(texts))
