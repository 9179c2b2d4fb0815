"""Compressed bitmaps over ordinals: 2^16-wide containers, sorted array when sparse and bit field when dense."""

from __future__ import annotations

import numpy as np

_SPARSE = 4096
_WIDTH = 1 << 16


class Bitmap:
    """Immutable set of non-negative ordinals; containers by the high bits of the ordinal."""

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray]):
        self.parts = parts

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """From ordinals in any order, repeats allowed."""
        values = np.unique(np.asarray(ordinals, dtype=np.int64))
        high = values >> 16
        parts = {}
        for key, start, stop in _runs(high):
            parts[key] = _packed((values[start:stop] & 0xFFFF).astype(np.uint16))
        return cls(parts)

    def minus(self, other: Bitmap) -> Bitmap:
        """AND-NOT."""
        return Bitmap({k: left for k, p in self.parts.items() if len(left := _minus(p, other.parts.get(k)))})

    def both(self, other: Bitmap) -> Bitmap:
        """AND."""
        return Bitmap({k: left for k, p in self.parts.items() if k in other.parts and len(left := _both(p, other.parts[k]))})

    def ordinals(self) -> np.ndarray:
        """Members, ascending."""
        if not self.parts:
            return np.empty(0, np.int64)
        return np.concatenate([_members(self.parts[k]).astype(np.int64) + (k << 16) for k in sorted(self.parts)])

    def __len__(self) -> int:
        return sum(len(_members(p)) for p in self.parts.values())


def _runs(sorted_keys: np.ndarray):
    edges = np.flatnonzero(np.diff(sorted_keys)) + 1
    bounds = [0, *edges.tolist(), len(sorted_keys)]
    for start, stop in zip(bounds, bounds[1:]):
        if stop > start:
            yield int(sorted_keys[start]), start, stop


def _packed(low: np.ndarray) -> np.ndarray:
    if len(low) <= _SPARSE:
        return low
    bits = np.zeros(_WIDTH, np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _members(part: np.ndarray) -> np.ndarray:
    return part if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part)).astype(np.uint16)


def _minus(left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    if right is None:
        return left
    if left.dtype == np.uint8 and right.dtype == np.uint8:
        return _packed(np.flatnonzero(np.unpackbits(left & ~right)).astype(np.uint16))
    return _packed(np.setdiff1d(_members(left), _members(right), assume_unique=True))


def _both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if left.dtype == np.uint8 and right.dtype == np.uint8:
        return _packed(np.flatnonzero(np.unpackbits(left & right)).astype(np.uint16))
    return _packed(np.intersect1d(_members(left), _members(right), assume_unique=True))
