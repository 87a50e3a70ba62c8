"""Numpy views of Arrow string columns, and byte hashes, shared by the operators that work on whole buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    wide = pa.types.is_large_string(column.type)
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives freed memory back to the system when it ends: workers stay for later stages, which need it."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def byte_table(seed: int) -> np.ndarray:
    """256 fixed random 64-bit values."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(MULTIPLIER)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, for hashes of any substring from one running sum."""

    def __init__(self, length: int, base: int = MULTIPLIER):
        self.up = self._row(length, base)
        self.down = self._row(length, pow(base, -1, 2**64))

    @staticmethod
    def _row(length: int, base: int) -> np.ndarray:
        row = np.full(length + 1, base, np.uint64)
        row[0] = 1
        return np.cumprod(row, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]
