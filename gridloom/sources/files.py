"""Opening array files: formats, paths that may be opened, and the tree of groups and datasets."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.operators.cache import SelectionCache
from gridloom.operators.frame import ArrayFrame
from gridloom.sources import chunked, hdf5, npy, synthetic, zarr

#: File name endings of the formats.
ENDINGS = {"npy": ("npy",), "hdf5": ("h5", "hdf5", "he5", "nc", "netcdf4"), "zarr": ("zarr",)}
_FORMATS = {"npy": npy, "hdf5": hdf5, "zarr": zarr, "null": synthetic}


class NotFound(KeyError):
    """No such item or file."""


class NotAllowed(OSError):
    """A path outside the roots."""


def format_of(path: str, explicit: str | None = None) -> str:
    """The format named, or else the one of the path's ending."""
    if explicit is not None:
        if explicit not in _FORMATS:
            raise ValueError(f"no format {explicit!r}")
        return explicit
    ending = os.path.splitext(path.rstrip("/"))[1].removeprefix(".").lower()
    for name, endings in ENDINGS.items():
        if ending in endings:
            return name
    raise ValueError(f"{path!r} has no ending of a known format; name one")


def allowed(path: str, roots: list[str] | None) -> str:
    """The real path of ``path``, which must lie in one of ``roots``; a relative one is tried under each. None allows all."""
    if roots is None:
        return os.path.realpath(path)
    for root in roots:
        real_root = os.path.realpath(root)
        real = os.path.realpath(path if os.path.isabs(path) else os.path.join(root, path))
        if os.path.commonpath([real, real_root]) == real_root and os.path.exists(real):
            return real
    raise NotAllowed(f"{path!r} is in none of the folders that may be read")


def trimmed(item: str) -> str:
    return "/".join(p for p in item.split("/") if p)


def find(path: str, item: str, explicit: str | None = None) -> chunked.Stored:
    """The dataset at ``item``; ``NotFound`` or ``TypeError`` where there is none."""
    module = _FORMATS[format_of(path, explicit)]
    found = module.open_item(path, trimmed(item))
    if found is None:
        raise NotFound(item)
    if not isinstance(found, chunked.Stored):
        raise TypeError(f"{item!r} is a group")
    return found


class Group(Mapping):
    """Children by name, sorted; what can't be served is left out of listings and explains itself when asked for."""

    def __init__(self, file: ArrayFile, item: str, attrs: dict):
        self.file, self.path, self.attrs = file, item, attrs

    def __getitem__(self, name: str):
        return self.file.item(name if name.startswith("/") else f"{self.path}/{name}")

    def __contains__(self, name: object) -> bool:
        try:
            self[name]
        except (KeyError, TypeError, ValueError):
            return False
        return True

    def __iter__(self) -> Iterator[str]:
        return iter(self.file.module.children(self.file.real, self.path))

    def __len__(self) -> int:
        return len(self.file.module.children(self.file.real, self.path))


class ArrayFile(Group):
    """An open file. ``cache`` keeps whole selections whose parts are asked for later."""

    def __init__(self, spark: SparkSession, path: str, format: str | None = None, roots: list[str] | None = None, cache_bytes: int = 0):
        self.spark, self.format = spark, format_of(path, format)
        self.real = path if self.format == "null" else allowed(path, roots)
        if self.format != "null" and not os.path.exists(self.real):
            raise FileNotFoundError(path)
        self.module, self.closed = _FORMATS[self.format], False
        self.cache = SelectionCache(cache_bytes)
        self._seen: dict[str, object] = {}
        root = self.module.open_item(self.real, "")
        super().__init__(self, "", root.attrs if root is not None else {})

    def item(self, path: str):
        """A group or an array; paths with and without slashes at the ends are equal."""
        if self.closed:
            raise ValueError("the file is closed")
        path = trimmed(path)
        if path not in self._seen:
            found = self.module.open_item(self.real, path)
            if found is None:
                raise NotFound(path)
            self._seen[path] = chunked.frame(self.spark, found, self.real, path, self.format) if isinstance(found, chunked.Stored) else Group(self, path, found.attrs)
        return self._seen[path]

    def select(self, path: str, key) -> ArrayFrame:
        """A selection of an array, from the cache where an earlier one contains it."""
        return self.cache.select(trimmed(path), self.item(path), key)

    def listing(self) -> DataFrame:
        """(path, kind, dtype, shape) of every item below the root."""
        rows, todo = [], [""]
        while todo:
            at = todo.pop()
            for name in self.module.children(self.real, at):
                path = trimmed(f"{at}/{name}")
                found = self.module.open_item(self.real, path)
                if isinstance(found, chunked.Stored):
                    rows.append((path, "array", found.dtype.name, list(found.shape)))
                else:
                    rows.append((path, "group", None, None))
                    todo.append(path)
        return self.spark.createDataFrame(sorted(rows), "path string, kind string, dtype string, shape array<long>")

    def close(self) -> None:
        self.cache.drop()
        self._seen.clear()
        self.closed = True

    def __enter__(self) -> ArrayFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_array(spark: SparkSession, path: str, format: str | None = None, roots: list[str] | None = None, cache_bytes: int = 0) -> ArrayFile:
    """Opens an array file."""
    return ArrayFile(spark, path, format, roots, cache_bytes)


def attribute(value):
    """Attributes of files as text, NumPy scalars or arrays; None for what has no such form."""
    if isinstance(value, str):
        return value
    if isinstance(value, (bool, int, float)):
        return np.array(value)[()]
    if isinstance(value, list) and value and all(isinstance(x, (bool, int, float)) for x in value):
        return np.array(value)
    return None
