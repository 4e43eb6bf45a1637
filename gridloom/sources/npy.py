"""``.npy`` files: a root group with one dataset, ``array``, read by ranges of rows."""

from __future__ import annotations

import ast
import os
from dataclasses import dataclass

import numpy as np

from gridloom.functions.dtypes import dtype_of
from gridloom.sources.chunked import Stored
from gridloom.sources.node import Node

#: Bytes of a chunk: the first axis is cut so that a chunk has about as many.
CHUNK = 8 << 20


@dataclass
class NpyArray(Stored):
    path: str = ""
    offset: int = 0

    def read(self, place: tuple[int, ...]) -> np.ndarray:
        if not self.shape:
            return np.fromfile(self.path, self.dtype, 1, offset=self.offset).reshape(())
        row = int(np.prod(self.shape[1:], dtype=np.int64))
        low = place[0] * self.chunks[0]
        n = min(self.chunks[0], self.shape[0] - low)
        got = np.fromfile(self.path, self.dtype, n * row, offset=self.offset + low * row * self.dtype.itemsize)
        if got.size != n * row:
            raise OSError(f"{self.path} is shorter than its header says")
        return got.reshape(n, *self.shape[1:])


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    with open(path, "rb") as f:
        start = f.read(8)
        if start[:6] != b"\x93NUMPY" or start[6] not in (1, 2, 3):
            raise ValueError(f"{path} is not an npy file")
        size = int.from_bytes(f.read(2 if start[6] == 1 else 4), "little")
        spec = ast.literal_eval(f.read(size).decode("latin1" if start[6] < 3 else "utf-8"))
        offset = f.tell()
    if spec["fortran_order"] and len(spec["shape"]) > 1:
        raise ValueError("arrays in Fortran order are not supported")
    dtype = dtype_of(spec["descr"]) if isinstance(spec["descr"], str) else dtype_of("V1")
    shape = tuple(spec["shape"])
    if os.path.getsize(path) < offset + int(np.prod(shape, dtype=object)) * dtype.itemsize:
        raise OSError(f"{path} is shorter than its header says")
    return shape, dtype, offset


def open_item(path: str, item: str):
    if not item:
        return Node({})
    if item != "array":
        return None
    shape, dtype, offset = header(path)
    row = max(1, int(np.prod(shape[1:], dtype=object)) * dtype.itemsize)
    chunks = (max(1, min(shape[0], CHUNK // row)), *(max(1, n) for n in shape[1:])) if shape else ()
    return NpyArray(shape, dtype, chunks, {}, path, offset)


def children(path: str, item: str) -> list[str]:
    return [] if item else ["array"]
