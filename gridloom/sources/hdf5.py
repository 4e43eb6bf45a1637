"""HDF5 and netCDF-4 files, read without a library: groups, attributes, and contiguous, compact or chunked datasets.

Follows the public file format specification for superblocks 0 to 3, both object
headers, symbol tables and compact links, and chunks under a version 1 B-tree.
deflate, shuffle and fletcher32 are undone. Whatever else a file may use is
refused by name.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from gridloom.functions.dtypes import dtype_of
from gridloom.sources.chunked import Stored
from gridloom.sources.node import Node

_MAGIC = b"\x89HDF\r\n\x1a\n"
_NOWHERE = (1 << 64) - 1
_CONTIGUOUS_CHUNK = 8 << 20


class Unsupported(ValueError):
    """What a file uses that isn't read here."""


class _File:
    def __init__(self, path: str):
        self.f = open(path, "rb")  # noqa: SIM115
        head = self.at(0, 96)
        if head[:8] != _MAGIC:
            raise ValueError(f"{path} is not an HDF5 file")
        version = head[8]
        if version in (0, 1):
            if head[13] != 8 or head[14] != 8:
                raise Unsupported("addresses of other than 8 bytes")
            entry = 24 + (4 if version else 0) + 32
            self.root = struct.unpack_from("<Q", head, entry + 8)[0]
        elif version in (2, 3):
            if head[9] != 8 or head[10] != 8:
                raise Unsupported("addresses of other than 8 bytes")
            self.root = struct.unpack_from("<Q", head, 36)[0]
        else:
            raise Unsupported(f"superblock version {version}")

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return self.f.read(n)

    def messages(self, place: int) -> list[tuple[int, int, bytes]]:
        """(type, flags, body) of an object header, continuations included."""
        out: list[tuple[int, int, bytes]] = []
        if self.at(place, 4) == b"OHDR":
            flags = self.at(place + 5, 1)[0]
            here = place + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            todo = [(here + width, int.from_bytes(self.at(here, width), "little"))]
            head = 6 if flags & 4 else 4
            while todo:
                start, size = todo.pop(0)
                block, k = self.at(start, size), 0
                while k + head <= len(block):
                    kind, n, f = block[k], struct.unpack_from("<H", block, k + 1)[0], block[k + 3]
                    body = block[k + head : k + head + n]
                    k += head + n
                    if kind == 0x10:
                        next_at, length = struct.unpack_from("<QQ", body)
                        todo.append((next_at + 4, length - 8))  # without signature and checksum
                    else:
                        out.append((kind, f, body))
            return out
        version, _, count, _, size = struct.unpack("<BBHII", self.at(place, 12))
        if version != 1:
            raise Unsupported(f"object header version {version}")
        todo = [(place + 16, size)]
        while todo and count > 0:
            start, size = todo.pop(0)
            block, k = self.at(start, size), 0
            while k + 8 <= len(block) and count > 0:
                kind, n, f = struct.unpack_from("<HHB", block, k)
                body = block[k + 8 : k + 8 + n]
                k, count = k + 8 + n, count - 1
                if kind == 0x10:
                    todo.append(struct.unpack_from("<QQ", body))
                else:
                    out.append((kind, f, body))
        return out

    def links(self, messages: list[tuple[int, int, bytes]]) -> dict[str, int]:
        """Hard links of a group by name."""
        out: dict[str, int] = {}
        for kind, _, body in messages:
            if kind == 0x11:
                tree, heap = struct.unpack_from("<QQ", body)
                data = struct.unpack("<Q", self.at(heap + 24, 8))[0]
                for name_at, header in self._symbols(tree):
                    name = self.at(data + name_at, 1024).split(b"\0", 1)[0]
                    out[name.decode()] = header
            elif kind == 0x06:
                flags, k = body[1], 2
                link = 0
                if flags & 8:
                    link, k = body[k], k + 1
                k += 8 if flags & 4 else 0
                k += 1 if flags & 16 else 0
                width = 1 << (flags & 3)
                n = int.from_bytes(body[k : k + width], "little")
                name = body[k + width : k + width + n].decode()
                if link == 0:  # soft and external links are not followed
                    out[name] = struct.unpack_from("<Q", body, k + width + n)[0]
            elif kind == 0x02:
                heap = struct.unpack_from("<Q", body, 2 + (8 if body[1] & 1 else 0))[0]
                if heap != _NOWHERE:
                    raise Unsupported("groups with dense links")
        return out

    def _symbols(self, node: int) -> Iterator[tuple[int, int]]:
        head = self.at(node, 24)
        if head[:4] == b"SNOD":
            n = struct.unpack_from("<H", head, 6)[0]
            block = self.at(node + 8, 40 * n)
            yield from (struct.unpack_from("<QQ", block, 40 * k) for k in range(n))
        elif head[:4] == b"TREE":
            n = struct.unpack_from("<H", head, 6)[0]
            block = self.at(node + 24, 16 * n + 8)
            for k in range(n):
                yield from self._symbols(struct.unpack_from("<Q", block, 16 * k + 8)[0])
        else:
            raise OSError("a group's tree is broken")

    def chunks(self, node: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, bytes, filter mask) of the chunks under a version 1 B-tree."""
        if node == _NOWHERE:
            return
        head = self.at(node, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise OSError("a dataset's tree of chunks is broken")
        n, width = struct.unpack_from("<H", head, 6)[0], 8 + 8 * (rank + 1)
        block = self.at(node + 24, n * (width + 8) + width)
        for k in range(n):
            size, mask = struct.unpack_from("<II", block, k * (width + 8))
            offsets = struct.unpack_from(f"<{rank}Q", block, k * (width + 8) + 8)
            child = struct.unpack_from("<Q", block, k * (width + 8) + width)[0]
            if head[5]:
                yield from self.chunks(child, rank)
            else:
                yield offsets, child, size, mask

    def global_object(self, place: int, index: int) -> bytes:
        size = struct.unpack("<Q", self.at(place + 8, 8))[0]
        block, k = self.at(place, size), 16
        while k + 16 <= len(block):
            number, _, _, n = struct.unpack_from("<HHIQ", block, k)
            if number == index:
                return block[k + 16 : k + 16 + n]
            if number == 0:
                break
            k += 16 + (n + 7) // 8 * 8
        raise OSError("a text of the file is missing")


def _datatype(body: bytes) -> np.dtype | str:
    """A NumPy type, or ``text`` or ``long text`` for strings of fixed and variable length."""
    kind, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    if kind == 0:
        if bits & 1 and size > 1:
            raise Unsupported("big-endian numbers")
        return dtype_of(f"{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        if bits & 1:
            raise Unsupported("big-endian numbers")
        return dtype_of(f"f{size}")
    if kind == 3:
        return "text"
    if kind == 9 and bits & 15 == 1:
        return "long text"
    if kind == 8 and size == 1:
        return np.dtype(bool)
    if kind == 6:
        version, n, k, parts = body[0] >> 4, struct.unpack_from("<H", body, 1)[0], 8, []
        for _ in range(n):
            end = body.index(b"\0", k)
            name = body[k:end].decode()
            if version < 3:
                k += (end - k + 8) // 8 * 8
                k += 4 + (28 if version == 1 else 0)
            else:
                k = end + 1 + max(1, (size.bit_length() + 7) // 8)
            part = _datatype(body[k:])
            k += 8 + {0: 4, 1: 12}.get(body[k] & 15, 0)
            parts.append((name, part))
        if [x for x, _ in parts] in (["r", "i"], ["real", "imag"]) and parts[0][1] == parts[1][1] and parts[0][1] in (np.dtype("f4"), np.dtype("f8")):
            return np.dtype(f"c{size}")
    raise Unsupported(f"type class {kind}")


def _dataspace(body: bytes) -> tuple[int, ...] | None:
    rank, at = body[1], 8 if body[0] == 1 else 4
    if body[0] == 2 and body[3] == 2:
        return None
    return struct.unpack_from(f"<{rank}Q", body, at)


def _fill(kind: int, body: bytes, dtype: np.dtype):
    if kind == 0x04:
        data = body[4 : 4 + struct.unpack_from("<I", body)[0]]
    elif body[0] == 3:
        data = body[6 : 6 + struct.unpack_from("<I", body, 2)[0]] if body[1] & 0x20 else b""
    else:
        data = body[8 : 8 + struct.unpack_from("<I", body, 4)[0]] if body[0] == 1 or body[3] else b""
    return np.frombuffer(data, dtype)[0] if len(data) == dtype.itemsize else dtype.type(0)


def _filters(body: bytes) -> list[int]:
    version, n, k, out = body[0], body[1], 8 if body[0] == 1 else 2, []
    for _ in range(n):
        name_size = 0
        number = struct.unpack_from("<H", body, k)[0]
        k += 2
        if version == 1 or number >= 256:
            name_size = struct.unpack_from("<H", body, k)[0]
            k += 2
        values = struct.unpack_from("<H", body, k + 2)[0]
        k += 4 + ((name_size + 7) // 8 * 8 if version == 1 else name_size) + 4 * values
        k += 4 if version == 1 and values % 2 else 0
        if number not in (1, 2, 3):
            raise Unsupported(f"filter {number}")
        out.append(number)
    return out


def fletcher32(data: bytes) -> int:
    words = np.frombuffer(data[: len(data) // 2 * 2], ">u2").astype(object if len(data) > 1 << 24 else np.int64)
    if len(data) % 2:
        words = np.append(words, data[-1] << 8)
    one = int(words.sum()) % 65535
    two = int((words * np.arange(len(words), 0, -1)).sum()) % 65535
    return two << 16 | one


def undone(raw: bytes, filters: list[int], mask: int, itemsize: int) -> bytes:
    for k in range(len(filters) - 1, -1, -1):
        if mask >> k & 1:
            continue
        if filters[k] == 1:
            raw = zlib.decompress(raw)
        elif filters[k] == 2:
            n = len(raw) // itemsize
            raw = np.frombuffer(raw[: n * itemsize], np.uint8).reshape(itemsize, n).T.tobytes() + raw[n * itemsize :]
        else:
            want = struct.unpack("<I", raw[-4:])[0]
            raw = raw[:-4]
            if fletcher32(raw) != want:
                raise OSError("a chunk's checksum is wrong")
    return raw


@dataclass
class Hdf5Array(Stored):
    path: str = ""
    fill: object = 0
    kind: int = 1
    address: int = _NOWHERE
    data: bytes = b""
    filters: list[int] = field(default_factory=list)
    _index: dict | None = None

    def read(self, place: tuple[int, ...]) -> np.ndarray:
        if self.kind == 2:
            return self._chunk(place)
        low = place[0] * self.chunks[0] if place else 0
        shape = (min(self.chunks[0], self.shape[0] - low), *self.shape[1:]) if self.shape else ()
        row = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize if self.shape else self.dtype.itemsize
        n = int(np.prod(shape, dtype=np.int64)) * self.dtype.itemsize
        if self.kind == 0:
            raw = self.data[low * row : low * row + n]
        elif self.address == _NOWHERE:
            return np.full(shape, self.fill, self.dtype)
        else:
            with open(self.path, "rb") as f:
                f.seek(self.address + low * row)
                raw = f.read(n)
        return np.frombuffer(raw, np.uint8 if self.dtype == bool else self.dtype).astype(self.dtype).reshape(shape)

    def _chunk(self, place: tuple[int, ...]) -> np.ndarray:
        with _File(self.path) as f:
            if self._index is None:
                self._index = {tuple(o // c for o, c in zip(offsets, self.chunks)): rest for offsets, *rest in f.chunks(self.address, len(self.shape))}
            if place not in self._index:
                return np.full(self.chunks, self.fill, self.dtype)
            address, size, mask = self._index[place]
            raw = undone(f.at(address, size), self.filters, mask, self.dtype.itemsize)
        return np.frombuffer(raw, np.uint8 if self.dtype == bool else self.dtype).astype(self.dtype).reshape(self.chunks)


def _attributes(f: _File, messages: list[tuple[int, int, bytes]]) -> dict:
    out = {}
    for kind, _, body in messages:
        if kind != 0x0C:
            continue
        version = body[0]
        name_size, type_size, space_size = struct.unpack_from("<HHH", body, 2)
        pad = (lambda n: (n + 7) // 8 * 8) if version == 1 else (lambda n: n)
        k = 9 if version == 3 else 8
        name = body[k : k + name_size].split(b"\0", 1)[0].decode()
        k += pad(name_size)
        try:
            dtype, shape = _datatype(body[k : k + type_size]), _dataspace(body[k + pad(type_size) :][:space_size])
        except (Unsupported, TypeError):
            continue
        data = body[k + pad(type_size) + pad(space_size) :]
        if shape is None or (isinstance(dtype, str) and shape not in ((), (1,))):
            continue
        if dtype == "text":
            out[name] = data.split(b"\0", 1)[0].decode("utf-8", "replace")
        elif dtype == "long text":
            n, place, index = struct.unpack_from("<IQI", data)
            out[name] = f.global_object(place, index)[:n].decode("utf-8", "replace")
        else:
            value = np.frombuffer(data, dtype, int(np.prod(shape, dtype=np.int64))).reshape(shape)
            out[name] = value[()] if shape == () else value
    return out


def _dataset(f: _File, path: str, messages: list[tuple[int, int, bytes]]) -> Hdf5Array:
    by = {kind: body for kind, _, body in messages}
    if 0x07 in by:
        raise Unsupported("external data files")
    dtype = _datatype(by[0x03])
    if isinstance(dtype, str):
        raise Unsupported("arrays of text")
    shape = _dataspace(by[0x01])
    if shape is None:
        raise Unsupported("datasets without a dataspace")
    out = Hdf5Array(shape, dtype, (), _attributes(f, messages), path)
    for kind in (0x04, 0x05):
        if kind in by:
            out.fill = _fill(kind, by[kind], dtype)
    layout = by[0x08]
    if layout[0] not in (3, 4) or layout[1] > 2 or (layout[0] == 4 and layout[1] == 2):
        raise Unsupported(f"data layout {layout[0]}.{layout[1]}")
    out.kind = layout[1]
    if out.kind == 2:
        rank = layout[2] - 1
        out.address = struct.unpack_from("<Q", layout, 3)[0]
        out.chunks = struct.unpack_from(f"<{rank}I", layout, 11)
        out.filters = _filters(by[0x0B]) if 0x0B in by else []
        return out
    if out.kind == 1:
        out.address = struct.unpack_from("<Q", layout, 2)[0]
    else:
        out.data = layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]]
    row = max(1, int(np.prod(shape[1:], dtype=object)) * dtype.itemsize)
    out.chunks = (max(1, min(shape[0], _CONTIGUOUS_CHUNK // row)), *(max(1, n) for n in shape[1:])) if shape else ()
    return out


def open_item(path: str, item: str):
    if not os.path.isfile(path):
        return None
    with _File(path) as f:
        at = f.root
        for name in filter(None, item.split("/")):
            links = f.links(f.messages(at))
            if name not in links:
                return None
            at = links[name]
        messages = f.messages(at)
        kinds = {kind for kind, _, _ in messages}
        return _dataset(f, path, messages) if 0x08 in kinds else Node(_attributes(f, messages))


def children(path: str, item: str) -> list[str]:
    with _File(path) as f:
        at = f.root
        for name in filter(None, item.split("/")):
            at = f.links(f.messages(at))[name]
        names, out = f.links(f.messages(at)), []
        for name in sorted(names):
            messages = f.messages(names[name])
            try:
                if any(kind == 0x08 for kind, _, _ in messages):
                    _dataset(f, path, messages)
                out.append(name)
            except (ValueError, TypeError):
                continue
        return out
