"""Arrays without a file: ``dtype:AxBxC[@period]``, where the byte at place p is p modulo the period (256 by default)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridloom.functions.dtypes import dtype_of
from gridloom.sources.chunked import Stored
from gridloom.sources.node import Node

CELLS = 1 << 20


@dataclass
class Pattern(Stored):
    period: int = 256

    def read(self, place: tuple[int, ...]) -> np.ndarray:
        size = self.dtype.itemsize
        low = place[0] * self.chunks[0] if place else 0
        shape = (min(self.chunks[0], self.shape[0] - low), *self.shape[1:]) if self.shape else ()
        row = int(np.prod(self.shape[1:], dtype=np.int64)) if self.shape else 1
        n = int(np.prod(shape, dtype=np.int64)) * size
        raw = ((np.arange(n, dtype=np.int64) + low * row * size) % self.period % 256).astype(np.uint8)
        return (raw != 0).reshape(shape) if self.dtype == bool else raw.view(self.dtype).reshape(shape)


def open_item(path: str, item: str):
    if not item:
        return Node({})
    if item != "array":
        return None
    kind, _, rest = path.partition(":")
    sizes, _, period = rest.partition("@")
    try:
        shape = tuple(int(n) for n in sizes.split("x")) if sizes else ()
        every = int(period) if period else 256
    except ValueError:
        raise ValueError(f"{path!r} is not dtype:AxB[@period]") from None
    if any(n < 0 for n in shape) or every < 1:
        raise ValueError(f"{path!r} is not dtype:AxB[@period]")
    row = max(1, int(np.prod(shape[1:], dtype=object)))
    chunks = (max(1, min(shape[0], CELLS // row)), *(max(1, n) for n in shape[1:])) if shape else ()
    return Pattern(shape, dtype_of(kind), chunks, {}, every)


def children(path: str, item: str) -> list[str]:
    return [] if item else ["array"]
