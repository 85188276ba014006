"""Columns of geometries as flat numpy arrays, and back: what lets a whole Arrow batch be measured or cut at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, ``count`` of them, one span after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def offsets(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def _lengths(col: pa.Array) -> np.ndarray:
    return np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)


@dataclass
class Flat:
    """Points of all rings, and the offsets of rings in points, polygons in rings, rows in polygons."""

    x: np.ndarray
    y: np.ndarray
    ring: np.ndarray
    polygon: np.ndarray
    row: np.ndarray

    @staticmethod
    def read(col: pa.Array) -> Flat:
        """A column of array<array<array<struct<x, y>>>>; null geometries have no polygons."""
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        polygons = col.flatten()
        rings = polygons.flatten()
        points = rings.flatten()
        x, y = (np.asarray(points.flatten()[points.type.get_field_index(c)], dtype=float) for c in "xy")
        return Flat(x, y, *(offsets(_lengths(v)) for v in (rings, polygons, col)))

    def arrow(self) -> pa.Array:
        out = pa.StructArray.from_arrays([pa.array(self.x), pa.array(self.y)], fields=list(POINT))
        for off in (self.ring, self.polygon, self.row):
            out = pa.ListArray.from_arrays(pa.array(off, pa.int32()), out)
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the first and second points of edges, rings as they are, and the edges' offsets by polygon."""
        count = np.maximum(np.diff(self.ring) - 1, 0)
        at = spans(self.ring[:-1], count)
        return at, at + 1, offsets(count)[self.polygon]


def chunks(count: np.ndarray, most: int):
    """Ranges of items with ``most`` in all at most, or one item."""
    ends, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of stretches that begin at ``first``; none may be empty."""
    return np.add.reduceat(values, first) if len(first) else np.zeros(0)
