"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the products of one random codeword for each block of a
random rotation of the coordinates. A vector is list-decoded to its best
directions: partial sums over the blocks are extended codeword by codeword and
dropped as soon as the rest can't reach the vector's own height, the score of its
last direction, so that no vector is without one. How many each takes is chosen
by the recall of random pairs at the threshold under the very code.
Vectors that share a filter are compared in double precision, in blocks of
bounded size; a linked pair counts only in the least filter that both exceed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import connected_components
from .store import Store, grouped, in_groups, join_by_size
from .text import mix

THRESHOLD = 0.95
#: Filters that a random vector exceeds, and vectors that a filter then holds, on average: each vector is sent once for each of its filters, so they are few and wide.
PASSED, HELD = 4, 2048
#: Codewords of a block at most; more filters take more blocks.
WORDS = 256
#: Share of random pairs at the threshold that have to share a filter, pairs that are tried, and filters of a vector, as a multiple of PASSED, before a coarser code is taken.
RECALL, PAIRS, MOST = 0.995, 1000, 16
#: Vectors of a filter that are compared in one group, with as many others at most, and rows of a matrix at a time.
BLOCK, TILE = 4096, 512
#: Filters of more than a block that are sent to all tasks (16 bytes each); were there more, they would be joined by shuffle.
WIDE = 1 << 20


def clean(value) -> np.ndarray | None:
    """The vector in double precision, or None for null, empty, zero, or with null or non-finite components."""
    if value is None:
        return None
    v = np.array([np.nan if x is None else x for x in value], np.float64)
    return v if len(v) and np.isfinite(v).all() and v.any() else None


def _units(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, embedding) to (vec_id, unit): the components' bytes, null where the vector links with nothing."""
        for batch in batches:
            column = batch.column(1)
            flat, n = column.flatten(), batch.num_rows
            size = len(flat) // n if n else 0
            if n and not column.null_count and not flat.null_count and size and len(flat) == size * n and (np.diff(column.offsets.to_numpy()) == size).all():
                v = flat.to_numpy().astype(kind).reshape(n, size) + 0  # -0.0 becomes 0.0
                own = [row.tobytes() if ok else None for row, ok in zip(v, np.isfinite(v).all(axis=1) & v.any(axis=1))]
            else:
                own = [None if x is None else (x.astype(kind) + 0).tobytes() for x in map(clean, column.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["vec_id", "unit"])

    return run


def scaled(values: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length in double precision, at length 1."""
    v = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Caps:
    """Filters for about ``n`` vectors of ``dim`` coordinates; the same for the same arguments everywhere."""

    def __init__(self, dim: int, n: int, passed: float = PASSED, held: float = HELD):
        want = max(4 * passed, n * passed / held)
        self.blocks = min(max(1, dim // 2), max(2, math.ceil(math.log(want) / math.log(WORDS))))
        self.words = max(2, min(WORDS, math.ceil(want ** (1 / self.blocks)))) if dim > 1 else 2
        self.cuts = [round(dim * k / self.blocks) for k in range(self.blocks + 1)]
        while True:
            self._draw(dim, passed)
            self.taken = self._enough(passed)
            if self.taken:
                break
            self.words = max(2, self.words * 3 // 4)

    def _draw(self, dim: int, passed: float) -> None:
        self.height = NormalDist().inv_cdf(1 - min(0.5, passed / self.words**self.blocks)) / math.sqrt(dim)
        rng = np.random.default_rng(dim)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            code = rng.standard_normal((self.words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * math.sqrt((b - a) / dim))

    def _enough(self, passed: float) -> int:
        """Filters that each vector takes for ``RECALL``; 0 where a sensible number doesn't do."""
        most, taken = self.words**self.blocks, math.ceil(passed)
        if most <= 2 * taken or len(self.rotation) == 1:
            return most  # few enough to take them all
        rng = np.random.default_rng(len(self.rotation) + 1)
        x, y = rng.standard_normal((2, PAIRS, len(self.rotation)))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = THRESHOLD * x + math.sqrt(1 - THRESHOLD**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        while taken <= MOST * passed:
            row, code = self.decode(np.concatenate([x, y]), self.heights(np.concatenate([x, y]), taken))
            seen = np.unique(np.stack([row % PAIRS, code, row // PAIRS]), axis=1)
            both = (seen[:2, 1:] == seen[:2, :-1]).all(axis=0) if seen.shape[1] > 1 else np.zeros(0, bool)
            if len(np.unique(seen[0, 1:][both])) >= RECALL * PAIRS:
                return taken
            taken = math.ceil(taken * 1.5)
        return 0

    def _parts(self, units: np.ndarray) -> list[np.ndarray]:
        turned = units @ self.rotation
        return [turned[:, a:b] @ code.T for (a, b), code in zip(zip(self.cuts, self.cuts[1:]), self.codes)]

    def heights(self, units: np.ndarray, taken: int | None = None) -> np.ndarray:
        """The score of each row's last filter of ``taken``, less what rounding may take."""
        taken, parts, out = min(taken or self.taken, self.words**self.blocks), self._parts(units), []
        size = max(1, (1 << 20) // taken**2)
        for low in range(0, len(units), size):
            best = np.zeros((len(units[low : low + size]), 1))
            for part in parts:  # a total among the best has a partial sum among the best
                k = min(taken, self.words)
                own = -np.partition(-part[low : low + size], k - 1, axis=1)[:, :k]
                best = (best[:, :, None] + own[:, None, :]).reshape(len(best), -1)
                k = min(taken, best.shape[1])
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
            out.append(best.min(axis=1))
        return np.concatenate([np.zeros(0), *out]) - 1e-12

    def decode(self, units: np.ndarray, height: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each row exceeds, at ``height`` or each row's own, in order."""
        parts = self._parts(units)
        height = np.full(len(units), self.height) if height is None else height
        rest = np.zeros((self.blocks + 1, len(units)))
        for k in range(self.blocks - 1, -1, -1):
            rest[k] = rest[k + 1] + parts[k].max(axis=1)
        row, code, total = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for k, part in enumerate(parts):
            found = []
            for low in range(0, len(row), 4096):
                cut = slice(low, low + 4096)
                sums = total[cut, None] + part[row[cut]]
                i, w = np.nonzero(sums + rest[k + 1][row[cut], None] >= height[row[cut], None])
                found.append((row[cut][i], code[cut][i] * self.words + w, sums[i, w]))
            row, code, total = (np.concatenate(x) for x in zip(*found)) if found else (row, code, total)
        return row, code


_caps: dict[tuple, Caps] = {}


def _caps_for(dim: int, n: int) -> Caps:
    if (dim, n) not in _caps:
        _caps[dim, n] = Caps(dim, n)
    return _caps[dim, n]


def _filters(n: int, whole: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(2).to_pylist()
            sizes = np.array([len(u) // np.dtype(kind).itemsize for u in units], np.int64)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for low in range(0, len(at), 2048):
                    some = at[low : low + 2048]
                    caps, v = _caps_for(dim, n), scaled([units[i] for i in some], kind)
                    row, code = caps.decode(v, caps.heights(v))
                    code = mix(code.astype(np.uint64) + np.uint64(dim << 48)).view(np.int64)  # no filter of another length is the same
                    if not whole:
                        key, count = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count.astype(np.int64))], ["filter", "n"])
                        continue
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    ends = np.searchsorted(row, np.arange(len(some) + 1))
                    lists = [code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                    take = pa.array(some[row])
                    yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(lists, pa.binary()).take(pa.array(row))], ["filter", "id", "copies", "unit", "filters"])

    return run


def _share_less(filters: list[np.ndarray], than: int) -> np.ndarray:
    """Marks of the filters less than ``than`` by row: two vectors share one where the product of their marks isn't 0."""
    less = [f[f < than] for f in filters]
    every, which = np.unique(np.concatenate(less), return_inverse=True)
    marks = np.zeros((len(filters), len(every)), np.float32)
    marks[np.repeat(np.arange(len(filters)), [len(f) for f in less]), which] = 1
    return marks


def _compare(v: np.ndarray, block: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which rows are linked, a tile of the product at a time; with ``block`` only rows of different blocks."""
    linked = np.empty((len(v), len(v)), bool)
    for a in range(0, len(v), TILE):
        linked[a : a + TILE] = v[a : a + TILE] @ v.T >= threshold
        if block is not None:
            linked[a : a + TILE] &= block[a : a + TILE, None] != block[None, :]
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least number that each row of a symmetric matrix reaches."""
    root = np.arange(len(linked))
    while True:
        new = np.concatenate([np.zeros(0, np.int64), *(np.where(linked[a : a + TILE], root[None, :], len(linked)).min(axis=1) for a in range(0, len(linked), TILE))])
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in in_groups(batches, ["filter", "low", "high"]):
            of, ids, copies, block, low, high = (table.column(c).to_numpy() for c in ("filter", "id", "copies", "block", "low", "high"))
            units, lists = table.column("unit"), table.column("filters")
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a < 2:
                    continue
                linked = _compare(scaled(units.slice(a, b - a).to_pylist(), kind), block[a:b] if low[a] != high[a] else None, threshold)
                some = np.flatnonzero(linked.any(axis=1))
                if not len(some):
                    continue
                linked = linked[np.ix_(some, some)]
                marks = _share_less([np.frombuffer(lists[a + s].as_buffer(), np.int64) for s in some.tolist()], int(of[a]))
                weight = copies[a:b][some].astype(np.float64)
                links = np.concatenate([(linked[t : t + TILE] & ~(marks[t : t + TILE] @ marks.T > 0)) @ weight for t in range(0, len(some), TILE)])
                found = ids[a:b][some], links.astype(np.int64), ids[a:b][some[_roots(linked)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, store: Store, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Pairs found with cosine ``threshold`` or more are linked. Vectors that are
    null, empty, zero, or have null or non-finite components link with nothing,
    and vectors of different lengths never link. Equal vectors are compared as
    one and count as linked with each other. Ids tell vectors apart. A null id has component_id
    null and is never kept.
    """
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    units = store.keep(vectors.select("vec_id", "embedding").mapInArrow(_units(kind), "vec_id long, unit binary").withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")}), "units")
    fine = units.where(F.col("unit").isNotNull())
    every = store.keep(fine.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    same = every.where(F.col("id").isNotNull())
    n = same.count()
    own = store.keep(same.join(fine.select(F.col("vec_id").alias("id"), "h1", "h2", "unit"), ["id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "copies", "unit"), "own")
    counts = own.mapInArrow(_filters(n, False, kind), "filter long, n long").groupBy("filter").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"))
    wide = store.keep(counts.where("blocks > 1"), "wide")
    rows = own.mapInArrow(_filters(n, True, kind), "filter long, id long, copies long, unit binary, filters binary")
    rows = rows.join(F.broadcast(wide) if wide.count() <= WIDE else wide.hint("shuffle_hash"), "filter", "left")
    blocks, zero = F.coalesce("blocks", F.lit(1).cast("long")), F.lit(0).cast("long")
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("id"), blocks), "other": F.explode(F.sequence(zero, blocks - 1))}).select(
        "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "copies", "block", "unit", "filters"
    )
    verified = store.keep(grouped(dealt, ["filter", "low", "high"], _verify(threshold, kind), "id long, links long, root long"), "verified")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    found = connected_components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")), store)
    by_class = every.join(links.join(found, "id", "left"), "id", "left").select(
        "h1", "h2", "copies", F.when(F.col("id").isNull(), zero).otherwise(F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")
    )
    total = every.agg(F.coalesce(F.sum("copies"), zero)).first()[0]
    joined = join_by_size(fine.select("vec_id", "h1", "h2"), by_class, ["h1", "h2"], "copies", total).select("vec_id", "n_links", "component_id")
    bare = units.where(F.col("unit").isNull()).select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(bare).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_capjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Store(spark))
