"""Small writers of the formats, for trying out and testing the readers; arrays themselves are never written by queries."""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa

from gridloom.sources.hdf5 import fletcher32
from gridloom.sources.zarr import crc32c


def zarr_group(path: str, attrs: dict | None = None) -> None:
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "zarr.json"), "w", encoding="utf-8") as f:
        json.dump({"zarr_format": 3, "node_type": "group", "attributes": attrs or {}}, f)


def _json_fill(value, dtype: np.dtype):
    if dtype.kind == "c":
        return [_json_fill(value.real, np.dtype("f8")), _json_fill(value.imag, np.dtype("f8"))]
    if dtype.kind == "f" and not np.isfinite(value):
        return "NaN" if np.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return np.asarray(value, dtype)[()].item()


def zarr_array(path: str, a: np.ndarray, chunks: tuple[int, ...], codecs: tuple[str, ...] = (), fill=0, inner: tuple[int, ...] | None = None, skip=(), keys: str = "default", attrs: dict | None = None) -> None:
    """``codecs`` are names after ``bytes``; chunks in ``skip`` stay unwritten; ``inner`` makes each chunk a shard."""
    os.makedirs(path, exist_ok=True)
    spelled = [{"name": "bytes", "configuration": {"endian": "little"}}, *({"name": c, "configuration": {"level": 3} if c in ("gzip", "zstd") else {}} for c in codecs)]
    if inner is not None:
        index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        spelled = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(inner), "codecs": spelled, "index_codecs": index}}]
    with open(os.path.join(path, "zarr.json"), "w", encoding="utf-8") as f:
        json.dump({"zarr_format": 3, "node_type": "array", "shape": list(a.shape), "data_type": a.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": keys}, "fill_value": _json_fill(fill, a.dtype), "codecs": spelled, "attributes": attrs or {}}, f)

    def encoded(block: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(block).tobytes()
        for c in codecs:
            if c == "gzip":
                raw = gzip.compress(raw, 3)
            elif c == "zstd":
                raw = pa.Codec("zstd").compress(raw, asbytes=True)
            else:
                raw += struct.pack("<I", crc32c(raw))
        return raw

    grid = tuple(-(-n // c) for n, c in zip(a.shape, chunks))
    for place in np.ndindex(*grid):
        if place in skip:
            continue
        block = np.full(chunks, fill, a.dtype)
        part = a[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        if inner is None:
            raw = encoded(block)
        else:
            raw, table = b"", []
            for at in np.ndindex(*(c // i for c, i in zip(chunks, inner))):
                cell = block[tuple(slice(k * i, (k + 1) * i) for k, i in zip(at, inner))]
                if (cell == fill).all():
                    table += [(1 << 64) - 1] * 2
                    continue
                own = encoded(cell)
                table += [len(raw), len(own)]
                raw += own
            index = np.array(table, "<u8").tobytes()
            raw += index + struct.pack("<I", crc32c(index))
        name = os.path.join(path, "c", *map(str, place)) if keys == "default" else os.path.join(path, ".".join(map(str, place)) or "0")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "wb") as f:
            f.write(raw)


class Hdf5Writer:
    """Superblock 0, symbol tables, version 1 headers: what old and common libraries write.

    ``tree`` maps names to dicts (groups) or to (array, options); options are
    chunks, filters (numbers), fill, skip and attrs. What is put goes to the file
    at once, so arrays mapped from a file are never held.
    """

    def put(self, raw) -> int:
        self.file.write(b"\0" * (-self.file.tell() % 8))
        at = self.file.tell()
        self.file.write(raw)
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, raw in messages:
            raw += b"\0" * (-len(raw) % 8)
            body += struct.pack("<HHB3x", kind, len(raw), 0) + raw
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    @staticmethod
    def datatype(dtype: np.dtype) -> bytes:
        n = dtype.itemsize
        if dtype.kind in "iu":
            return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, n, 0, 8 * n)
        if dtype.kind == "f":
            exponent, mantissa, bias = {2: (5, 10, 15), 4: (8, 23, 127), 8: (11, 52, 1023)}[n]
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * n - 1, 0, n, 0, 8 * n, mantissa, exponent, 0, mantissa, bias)
        if dtype.kind == "b":
            base = Hdf5Writer.datatype(np.dtype("i1"))
            return struct.pack("<BBBBI", 0x18, 2, 0, 0, 1) + base + b"FALSE\0\0\0TRUE\0\0\0\0" + b"\0\1"
        part = Hdf5Writer.datatype(np.dtype(f"f{n // 2}"))
        member = lambda name, at: name + b"\0" * (8 - len(name)) + struct.pack("<IB3xII16x", at, 0, 0, 0) + part
        return struct.pack("<BBBBI", 0x16, 2, 0, 0, n) + member(b"r", 0) + member(b"i", n // 2)

    @staticmethod
    def dataspace(shape: tuple[int, ...]) -> bytes:
        return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + b"".join(struct.pack("<Q", n) for n in shape)

    def attributes(self, attrs: dict) -> list[tuple[int, bytes]]:
        out, pad = [], lambda b: b + b"\0" * (-len(b) % 8)
        for name, value in attrs.items():
            if isinstance(value, str):
                raw = value.encode() + b"\0"
                kind, shape = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(raw)), ()
            else:
                value = np.asarray(value)
                kind, shape, raw = self.datatype(value.dtype), value.shape, value.tobytes()
            space, named = self.dataspace(shape), name.encode() + b"\0"
            out.append((0x0C, struct.pack("<BxHHH", 1, len(named), len(kind), len(space)) + pad(named) + pad(kind) + pad(space) + raw))
        return out

    def dataset(self, a: np.ndarray, chunks=None, filters=(), fill=None, skip=(), attrs=None) -> int:
        messages = [(0x01, self.dataspace(a.shape)), (0x03, self.datatype(a.dtype))]
        if fill is not None:
            raw = np.asarray(fill, a.dtype).tobytes()
            messages.append((0x05, struct.pack("<BBBBI", 2, 2, 0, 1, len(raw)) + raw))
        if chunks is None:
            at = self.put(np.ascontiguousarray(a)) if not skip else (1 << 64) - 1
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, at, a.nbytes)))
        else:
            keys = []
            for place in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunks))):
                if place in skip:
                    continue
                block = np.full(chunks, fill or 0, a.dtype)
                part = a[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                raw = block.tobytes()
                for f in filters:
                    raw = zlib.compress(raw) if f == 1 else np.frombuffer(raw, np.uint8).reshape(-1, a.itemsize).T.tobytes() if f == 2 else raw + struct.pack("<I", fletcher32(raw))
                keys.append((struct.pack("<II", len(raw), 0) + struct.pack(f"<{a.ndim + 1}Q", *(p * c for p, c in zip(place, chunks)), 0), self.put(raw)))
            last = struct.pack("<II", 0, 0) + struct.pack(f"<{a.ndim + 1}Q", *a.shape, 0)
            tree = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(keys), (1 << 64) - 1, (1 << 64) - 1) + b"".join(k + struct.pack("<Q", at) for k, at in keys) + last) if keys else (1 << 64) - 1
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, a.ndim + 1, tree) + b"".join(struct.pack("<I", c) for c in (*chunks, a.itemsize))))
            if filters:
                messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", f, 0, 0, n) + struct.pack("<I4x", v) * n for f, n, v in ((f, f != 3, a.itemsize if f == 2 else 6) for f in filters))))
        return self.header(messages + self.attributes(attrs or {}))

    def group(self, tree: dict, attrs: dict | None = None) -> int:
        names, heap, entries = sorted(tree), b"\0" * 8, []
        for name in names:
            value = tree[name]
            at = self.group(value) if isinstance(value, dict) else self.dataset(value[0], **value[1])
            entries.append((len(heap), at))
            raw = name.encode() + b"\0"
            heap += raw + b"\0" * (-len(raw) % 8)
        data = self.put(heap)
        heap_at = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, data))
        node = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(entries)) + b"".join(struct.pack("<QQII16x", n, at, 0, 0) for n, at in entries))
        tree_at = self.put(b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, (1 << 64) - 1, (1 << 64) - 1, 0, node, 0))
        return self.header([(0x11, struct.pack("<QQ", tree_at, heap_at)), *self.attributes(attrs or {})])

    def save(self, path: str, tree: dict, attrs: dict | None = None) -> None:
        with open(path, "wb") as self.file:
            self.put(bytes(96))
            root = self.group(tree, attrs)
            end = self.file.tell()
            self.file.seek(0)
            self.file.write(b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, (1 << 64) - 1, end, (1 << 64) - 1) + struct.pack("<QQII16x", 0, root, 0, 0))
