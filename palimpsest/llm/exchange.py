"""Packed exchange: brings equal 64-bit hashes of many records together at a few bytes each.

A map task packs its hashes by bucket into compressed columns; a bucket is one row a flush instead of one row a hash. Only
the low 48 bits travel, the upper 16 choose the bucket.
"""

from __future__ import annotations

import numpy as np
import zstandard

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW48 = np.uint64((1 << 48) - 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64) if buckets <= 1 << 16 else (h % np.uint64(buckets)).astype(np.int64)


def pack(h: np.ndarray, owner: np.ndarray, place: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """One bucket's hashes: ``owner`` (int64, equal ones together), ``place`` (uint32) within it; ``extra``: bytes an owner."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(owner))).astype(np.uint32)
    step = np.diff(place.astype(np.int64), prepend=0).astype(np.int32)
    step[starts] = place[starts]
    low = h & LOW48
    parts = [
        np.array([len(h), len(starts)], np.uint32).tobytes(),
        (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
        (low >> np.uint64(32)).astype(np.uint16).tobytes(),
        owner[starts].astype(np.int64).tobytes(),
        b"" if extra is None else extra[starts].tobytes(),
    ]
    # counts and steps are small numbers: by byte planes they shrink to little
    small = np.concatenate([counts, step.view(np.uint32)]).view(np.uint8).reshape(-1, 4).T.tobytes()
    return b"".join(parts) + zstandard.ZstdCompressor(level=1).compress(small)


def unpack(blob: bytes, extra_bytes: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h48, owner index, place, owners) of ``pack``; with ``extra_bytes`` the owners come as (owners, extra)."""
    n, m = np.frombuffer(blob, np.uint32, 2)
    at = 8
    low = np.frombuffer(blob, np.uint32, n, at).astype(np.uint64)
    at += 4 * int(n)
    h = low | np.frombuffer(blob, np.uint16, n, at).astype(np.uint64) << np.uint64(32)
    at += 2 * int(n)
    owners = np.frombuffer(blob, np.int64, m, at)
    at += 8 * int(m)
    extra = None
    if extra_bytes:
        extra = np.frombuffer(blob, np.uint8, int(m) * extra_bytes, at).reshape(int(m), extra_bytes)
        at += int(m) * extra_bytes
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at:]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
    counts, step = small[:m].astype(np.int64), small[m:].view(np.int32).astype(np.int64)
    index = np.repeat(np.arange(int(m)), counts)
    total = np.cumsum(step)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if m else np.zeros(0, np.int64)
    place = total - np.repeat(total[first] - step[first], counts) if n else step
    return h, index, place, owners if extra is None else (owners, extra)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.diff(np.append(start, len(sorted_keys)))
