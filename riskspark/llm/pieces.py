"""Distinct byte strings of a chunk, told apart by their bytes and not by a hash.

A chunk's pieces are an Arrow binary array over its own buffer (no copy); Arrow's dictionary
encoding and index_in then compare whole pieces in native code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The pieces data[bounds[i]:bounds[i + 1]]."""
    bounds = np.ascontiguousarray(bounds, np.int64)
    n = max(0, len(bounds) - 1)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]) if n else pa.array([], pa.large_binary())


def coded(pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each piece the number of its value, and the distinct values."""
    got = pieces.dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.dictionary


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each span the number of its value, and the distinct values (which also hold the
    gaps between spans). Spans are in order and don't overlap."""
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    codes, values = coded(binary(data, bounds))
    return codes[::2], values
