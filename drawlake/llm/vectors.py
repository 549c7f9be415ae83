"""Integer vectors out of Arrow columns, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LEAST_EXACT = float(1 << 53)
MOST_DIMENSIONS = 1 << 14


def scaled(column: pa.Array, scale: int, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of every component as int64, a row for each usable vector, and the
    places of those vectors in the column. A vector is usable if it is neither null nor holds a
    null or non-finite component, and has so many dimensions, where they are given; else shorter
    vectors are filled with zeros up to the longest of the column.

    Components from 2^27 after scaling raise an error: sums of their products leave 64 bits.
    """
    lengths = np.asarray(column.value_lengths().fill_null(-1)).astype(np.int64)
    flat = column.flatten()  # without what null vectors hide
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.flatnonzero(~np.isfinite(values))
    usable = lengths >= 0
    if len(bad):
        usable[np.searchsorted(ends, bad, side="right")] = False
    usable &= lengths == dimensions if dimensions is not None else lengths <= MOST_DIMENSIONS
    if dimensions is None and (lengths > MOST_DIMENSIONS).any():
        raise ValueError(f"a vector has more than {MOST_DIMENSIONS} components")
    at = np.flatnonzero(usable)
    width = dimensions if dimensions is not None else int(lengths[at].max(initial=0))
    if len(at) == len(lengths) and (lengths == width).all():
        out = values.reshape(len(at), width)
    else:
        out = np.zeros((len(at), width))
        size = lengths[at]
        row = np.repeat(np.arange(len(at)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[row, place] = values[np.repeat(ends[at] - size, size) + place]
    out = np.floor(scale * out)
    if len(out) and max(out.max(initial=0), -out.min(initial=0)) >= 1 << 27:
        raise ArithmeticError("a component is too large for scores of 64 bits")
    return out.astype(np.int64), at


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """The rows with zeros up to `width` columns."""
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices. Floating point does it where
    no sum can leave its exact integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = widened(a, width), widened(b, width)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < LEAST_EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2.0**63:
        raise ArithmeticError("inner products leave 64 bits")
    return a @ b.T


def lists(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A matrix as a column of lists."""
    offsets = np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind or pa.int32()))
