"""A cache of selections that answers those contained in an earlier one.

Only selections without index arrays are kept. A later one is contained if on
each axis its places are among the kept ones; the smallest kept selection that
contains it is asked by a rewritten key, so axes come out as the key itself says.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark import StorageLevel

from gridloom.operators.frame import ArrayFrame
from gridloom.operators.resolve import Pick, Point, Range, Resolved


@dataclass
class Entry:
    item: str
    quality: tuple
    axes: tuple
    frame: ArrayFrame

    @property
    def nbytes(self) -> int:
        return self.frame.nbytes


def places_in(inner, outer) -> Point | Range | Pick | None:
    """``inner`` counted in the places of ``outer``, or None if some are not among them."""
    start, step, length = (outer.at, 1, 1) if isinstance(outer, Point) else (outer.start, outer.step, outer.length)

    def one(x: int) -> int | None:
        at, rest = divmod(x - start, step)
        return at if not rest and 0 <= at < length else None

    if isinstance(inner, Point):
        at = one(inner.at)
        return None if at is None else Point(at)
    if isinstance(inner, Pick):
        found = [one(x) for x in inner.at]
        return None if None in found else Pick(tuple(found))
    if not inner.length:
        return Range(0, 1, 0)
    first, last = one(inner.start), one(inner.start + inner.step * (inner.length - 1))
    if first is None or last is None:
        return None
    if inner.length == 1:
        return Range(first, 1, 1)
    return None if inner.step % step else Range(first, inner.step // step, inner.length)


class SelectionCache:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.entries: OrderedDict[int, Entry] = OrderedDict()
        self.hits = self.misses = self.evictions = 0
        self._next = 0

    @property
    def nbytes(self) -> int:
        return sum(e.nbytes for e in self.entries.values())

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions, "entries": len(self.entries), "bytes": self.nbytes}

    def select(self, item: str, array: ArrayFrame, key) -> ArrayFrame:
        from gridloom.operators.frame import _select

        found = array.resolve(key)
        quality = tuple(sorted(array.applied_quality.items()))
        best = None
        for name, e in self.entries.items():
            if e.item == item and e.quality == quality and (best is None or e.nbytes < self.entries[best].nbytes):
                inner = [places_in(i, o) for i, o in zip(found.axes, e.axes)]
                if None not in inner:
                    best, axes = name, tuple(inner)
        if best is not None:
            self.hits += 1
            self.entries.move_to_end(best)
            return ArrayFrame(_select(self.entries[best].frame.df, Resolved(axes, found.out, found.shape, found.picked)), found.shape, array.dtype, array.attrs, quality=array.applied_quality)
        self.misses += 1
        out = array[key]
        if not any(isinstance(a, Pick) for a in found.axes) and out.nbytes <= self.capacity:
            self._store(item, quality, array, found)
        return out

    def _store(self, item: str, quality: tuple, array: ArrayFrame, found: Resolved) -> None:
        for name, e in list(self.entries.items()):
            if e.item == item and e.quality == quality and all(places_in(i, o) is not None for i, o in zip(e.axes, found.axes)):
                self._remove(name)  # the new one answers all that this one does
        whole = tuple(Range(a.at, 1, 1) if isinstance(a, Point) else a for a in found.axes)
        shape = tuple(a.length for a in whole)
        key = tuple(slice(a.at, a.at + 1) if isinstance(a, Point) else _slice(a) for a in found.axes)
        kept = ArrayFrame(array[key].df.persist(StorageLevel.MEMORY_AND_DISK), shape, array.dtype)
        self.entries[self._next] = Entry(item, quality, whole, kept)
        self._next += 1
        while self.nbytes > self.capacity and len(self.entries) > 1:
            self._remove(next(iter(self.entries)))
            self.evictions += 1

    def _remove(self, name: int) -> None:
        self.entries.pop(name).frame.df.unpersist()

    def drop(self) -> None:
        for name in list(self.entries):
            self._remove(name)


def _slice(a: Range) -> slice:
    stop = a.start + a.step * a.length
    return slice(a.start, stop if stop >= 0 else None, a.step)
