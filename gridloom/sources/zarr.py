"""Zarr v3 stores in a folder: regular grids, the bytes, gzip, zstd and crc32c codecs, and shards."""

from __future__ import annotations

import gzip
import json
import math
import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from gridloom.functions.dtypes import NAMES, dtype_of
from gridloom.sources.chunked import Stored
from gridloom.sources.node import Node

_ABSENT = (1 << 64) - 1


class Unsupported(ValueError):
    """A store that uses what isn't read here; the message names it."""


def _crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _crc32c_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def _checked(data: bytes) -> bytes:
    if len(data) < 4 or crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise OSError("a chunk's checksum is wrong")
    return data[:-4]


def _metadata(path: str) -> dict | None:
    try:
        with open(os.path.join(path, "zarr.json"), encoding="utf-8") as f:
            spec = json.load(f)
    except FileNotFoundError:
        if os.path.exists(os.path.join(path, ".zarray")) or os.path.exists(os.path.join(path, ".zgroup")):
            raise Unsupported("Zarr v2 stores are not supported") from None
        return None
    if spec.get("zarr_format") != 3:
        raise Unsupported(f"zarr_format {spec.get('zarr_format')} is not supported")
    return spec


def fill_value(value, dtype: np.dtype):
    """A fill value of the metadata; TypeError where it doesn't suit the type."""
    if dtype.kind == "b":
        if not isinstance(value, bool):
            raise TypeError(f"fill value {value!r} is no bool")
        return np.bool_(value)
    if dtype.kind in "iu":
        if isinstance(value, bool) or not isinstance(value, int) or not np.iinfo(dtype).min <= value <= np.iinfo(dtype).max:
            raise TypeError(f"fill value {value!r} is no {dtype.name}")
        return dtype.type(value)
    if dtype.kind == "c":
        if not isinstance(value, list) or len(value) != 2:
            raise TypeError(f"fill value {value!r} is no pair")
        part = np.dtype(f"f{dtype.itemsize // 2}")
        return dtype.type(complex(fill_value(value[0], part), fill_value(value[1], part)))
    named = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
    if isinstance(value, str):
        if value in named:
            return dtype.type(named[value])
        if value.startswith("0x"):
            return np.array(int(value, 16), f"u{dtype.itemsize}").view(dtype)[()]
        raise TypeError(f"fill value {value!r} is no number")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"fill value {value!r} is no number")
    return dtype.type(value)


def _chain(codecs: list[dict], ndim: int) -> list[str]:
    """Names of the codecs after ``bytes``, in the order of writing."""
    out, seen = [], False
    for c in codecs:
        name, conf = c.get("name"), c.get("configuration", {})
        if name == "transpose" and not seen:
            if list(conf.get("order", [])) != list(range(ndim)):
                raise Unsupported("transposed chunks are not supported")
        elif name == "bytes" and not seen:
            if conf.get("endian", "little") != "little":
                raise Unsupported("big-endian chunks are not supported")
            seen = True
        elif name in ("gzip", "zstd", "crc32c") and seen:
            out.append(name)
        else:
            raise Unsupported(f"codec {name!r} is not supported here")
    if not seen:
        raise Unsupported("the codecs lack 'bytes'")
    return out


def _decoded(raw: bytes, chain: list[str], size: int) -> bytes:
    for name in reversed(chain):
        if name == "gzip":
            raw = gzip.decompress(raw)
        elif name == "zstd":
            raw = pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read()
        else:
            raw = _checked(raw)
    if len(raw) != size:
        raise OSError("a chunk has the wrong size")
    return raw


@dataclass
class ZarrArray(Stored):
    path: str = ""
    fill: object = 0
    key: tuple[str, str] = ("default", "/")
    chain: list[str] = field(default_factory=list)
    inner: tuple[int, ...] | None = None
    index: list[str] = field(default_factory=list)
    index_first: bool = False

    def _name(self, place: tuple[int, ...]) -> str:
        kind, sep = self.key
        at = sep.join(map(str, place))
        return (f"c{sep}{at}" if at else "c") if kind == "default" else at or "0"

    def read(self, place: tuple[int, ...]) -> np.ndarray:
        out = np.full(self.chunks, self.fill, self.dtype)
        path = os.path.join(self.path, self._name(place))
        if not os.path.exists(path):
            return out
        with open(path, "rb") as f:
            raw = f.read()
        if self.inner is None:
            size = math.prod(self.chunks) * self.dtype.itemsize
            return np.frombuffer(_decoded(raw, self.chain, size), self.dtype.newbyteorder("<")).reshape(self.chunks).astype(self.dtype)
        grid = tuple(c // i for c, i in zip(self.chunks, self.inner))
        n = 16 * math.prod(grid)
        whole = n + 4 * self.index.count("crc32c")
        table = np.frombuffer(_decoded(raw[:whole] if self.index_first else raw[-whole:], self.index, n), "<u8").reshape(*grid, 2)
        size = math.prod(self.inner) * self.dtype.itemsize
        for at in np.ndindex(*grid):
            start, length = (int(x) for x in table[at])
            if start == _ABSENT:
                continue
            if start + length > len(raw):
                raise OSError("a shard's index points beyond it")
            part = np.frombuffer(_decoded(raw[start : start + length], self.chain, size), self.dtype.newbyteorder("<")).reshape(self.inner)
            out[tuple(slice(k * i, (k + 1) * i) for k, i in zip(at, self.inner))] = part
        return out


def _array(path: str, spec: dict) -> ZarrArray:
    from gridloom.sources.files import attribute

    name = spec.get("data_type")
    if name not in NAMES:
        raise Unsupported(f"data type {name!r} is not supported")
    if spec.get("storage_transformers"):
        raise Unsupported("storage transformers are not supported")
    dtype, shape = dtype_of(name), tuple(spec["shape"])
    grid = spec["chunk_grid"]
    if grid.get("name") != "regular":
        raise Unsupported(f"chunk grid {grid.get('name')!r} is not supported")
    chunks = tuple(grid["configuration"]["chunk_shape"])
    encoding = spec["chunk_key_encoding"]
    if encoding["name"] not in ("default", "v2"):
        raise Unsupported(f"chunk keys {encoding['name']!r} are not supported")
    sep = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
    out = ZarrArray(shape, dtype, chunks, {k: a for k, v in spec.get("attributes", {}).items() if (a := attribute(v)) is not None}, path, fill_value(spec["fill_value"], dtype), (encoding["name"], sep))
    codecs = spec["codecs"]
    shards = [c for c in codecs if c.get("name") == "sharding_indexed"]
    if not shards:
        out.chain = _chain(codecs, len(shape))
        return out
    if len(codecs) > 1:
        raise Unsupported("sharding_indexed must be the only codec")
    conf = shards[0]["configuration"]
    out.inner = tuple(conf["chunk_shape"])
    if len(out.inner) != len(chunks) or any(c % i for c, i in zip(chunks, out.inner)):
        raise ValueError("inner chunks must divide their shard")
    if any(c.get("name") == "sharding_indexed" for c in conf["codecs"]):
        raise Unsupported("nested shards are not supported")
    out.chain, out.index = _chain(conf["codecs"], len(shape)), _chain(conf["index_codecs"], len(shape) + 1)
    if set(out.index) - {"crc32c"}:
        raise Unsupported("a shard's index may only have a checksum")
    out.index_first = conf.get("index_location", "end") == "start"
    return out


def open_item(path: str, item: str):
    from gridloom.sources.files import attribute

    if ".." in item.split("/"):
        return None
    here = os.path.join(path, item)
    if not os.path.realpath(here).startswith(os.path.realpath(path)):
        return None
    spec = _metadata(here)
    if spec is None:
        return None
    if spec.get("node_type") == "group":
        return Node({k: a for k, v in spec.get("attributes", {}).items() if (a := attribute(v)) is not None})
    return _array(here, spec)


def children(path: str, item: str) -> list[str]:
    here, out = os.path.join(path, item), []
    spec = _metadata(here)
    if spec is None or spec.get("node_type") != "group":
        return []
    for name in sorted(os.listdir(here)):
        if os.path.isdir(os.path.join(here, name)):
            try:
                if open_item(path, f"{item}/{name}".strip("/")) is not None:
                    out.append(name)
            except (ValueError, TypeError, KeyError):
                continue
    return out
