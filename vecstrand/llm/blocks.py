"""The vector arithmetic shared by the search operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of equal width, without nulls, as a float32 matrix. Products of two int8 vectors of up to 1,000 values are exact in it."""
    if not len(column):
        return np.zeros((0, width), np.float32)
    data = np.frombuffer(column.buffers()[2], np.int8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return data[start : start + len(column) * width].reshape(len(column), width).astype(np.float32)


def directions(x: np.ndarray) -> np.ndarray:
    """Each int8 vector over the greatest common divisor of its values: vectors of cosine 1 become equal."""
    x = x.astype(np.int16)
    return (x // np.maximum(np.gcd.reduce(np.abs(x), axis=1), 1)[:, None]).astype(np.int8)
