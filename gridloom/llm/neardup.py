"""N-gram Jaccard join of texts by a MinHash LSH forest with exact verification.

Texts with the same words in the same order form a class that is joined as one.
Each class has ``TREES`` labels of ``DEPTH`` MinHash values. A tree is its sorted
labels; classes with a common prefix stand side by side in it. The forest is
asked with whole labels first. From the signatures of what it matches, the share
of near pairs that it finds at this depth is estimated; while that is less than
``RECALL``, matched prefixes are shortened by one value, at the most to where a
pair just at the threshold is found that surely.

Within a matched prefix, leaders gather all that their signatures can't tell from
being near them. Gathered classes are dealt to blocks of bounded size, those of a
prefix to the same one, and exactly the blocks that share a matched prefix are
verified with each other, by counting common shingles. Pairs are never written
out: a block yields sums of links and the roots of its linked classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import connected_components
from .store import Store, documents, grouped, in_groups, join_by_size
from .text import _power_tables, chunks, mix, shingles, words

SIZE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9995
#: Classes of a block on average, which is compared with itself and with one other at a time.
BLOCK = 1024
#: Classes of a matched prefix beyond which all are gathered, without looking at signatures.
LARGE = 1 << 14
#: Signatures alike in ``TIGHT`` of their values stand for each other; those alike in ``LOOSE`` may be near the same third.
TIGHT, LOOSE = 0.9, 0.48
_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)) | np.uint32(1)
_B = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def found_at(depth: int, similarity: float) -> float:
    """Probability that a pair of this similarity shares a prefix of so many values in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The depth that prefixes are shortened to at the most: the longest of ``DEPTH`` or fewer values that finds a pair at the threshold with probability ``recall``."""
    depth = DEPTH
    while depth > 1 and found_at(depth, threshold) < recall:
        depth -= 1
    return depth


def estimated_recall(depth: int, alike: dict[int, int], threshold: float) -> float:
    """Share of near pairs that prefixes of this depth find, from the numbers of found pairs by equal MinHash values; 0 where there are none."""
    weights = [(n, found_at(depth, max(threshold, k / (TREES * DEPTH)))) for k, n in alike.items()]
    return sum(n for n, _ in weights) / sum(n / p for n, p in weights) if weights else 0.0


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value of each text; texts without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, TREES * DEPTH), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        x, at = (h >> np.uint64(32)).astype(np.uint32), offsets[some]
        for k in range(TREES * DEPTH):
            out[some, k] = np.minimum.reduceat(x * _A[k] + _B[k], at) & np.uint32(0xFFFF)
    return out


def sequence_hashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's sequence of words."""
    up, down = _power_tables(len(h) + 1)
    size = np.diff(offsets).astype(np.uint64)
    found = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)) * up[: len(h)])]
        found.append(mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[np.minimum(offsets[:-1], len(h))] + size))
    return mix(found[0] ^ (found[1] * np.uint64(3))).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(2)):
            h, _, _, at = words(data, offsets)
            found = signatures(*shingles(h, at, SIZE))
            own = [row.tobytes() if n else None for row, n in zip(found, np.diff(at).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sequence_hashes(h, at)), pa.array(own, pa.binary())], ["doc_id", "whole", "id", "signature"])


def _labels(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, TREES, DEPTH).astype(np.uint64)
            key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (n, TREES)).copy()
            for k in range(depth):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, :, k] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], ["key", "id"])

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to (grp, id, n, least) of the keys that several ids have: n ids, the least among them; equal sets of ids give equal groups."""
    for table, at in in_groups(batches, ["key"]):
        ids = table.column("id").to_numpy()
        size = np.diff(at)
        group = np.add.reduceat(mix(ids.astype(np.uint64) + np.uint64(0x51ED2701)), at[:-1]).view(np.int64) if len(size) else size
        least = np.minimum.reduceat(ids, at[:-1]) if len(size) else size
        several = np.repeat(size > 1, size)
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, size)[several]) for x in (group,)] + [pa.array(ids[several])] + [pa.array(np.repeat(x, size)[several]) for x in (size, least)], ["grp", "id", "n", "least"])


def _gather(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (grp, id, signature) sorted by grp to edges (a, b, alike): of what leaders gather together, each with the first.

        alike: of the leaders that b may be near to the threshold with, the least number of equal values.
        """
        for table, at in in_groups(batches, ["grp"]):
            ids = table.column("id").to_numpy()
            own = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(ids), -1)
            first, least = np.arange(len(ids)), np.full(len(ids), 2.0)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                part, label = own[i:j], np.arange(j - i)
                left = label
                while len(left):
                    lead = left[0]
                    alike = np.concatenate([(part[k : k + 4096] == part[lead]).mean(axis=1) for k in range(0, j - i, 4096)])
                    met = np.zeros(j - i, bool)
                    met[label[alike >= LOOSE]] = True
                    label = np.where(met[label], np.flatnonzero(met)[0], label)
                    least[i:j] = np.minimum(least[i:j], np.where((alike >= threshold - 0.05) & (np.arange(j - i) != lead), alike, 2))
                    left = left[(alike[left] < TIGHT) & (left != lead)]
                first[i:j] = label + i
            joined = np.flatnonzero(first != np.arange(len(ids)))
            if len(joined):
                alike = np.rint(least[joined] * TREES * DEPTH).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first[joined]]), pa.array(ids[joined]), pa.array(alike, mask=least[joined] > 1)], ["a", "b", "alike"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, text, becomes the sorted distinct shingles."""
    for batch in batches:
        at_text = batch.num_columns - 1
        for a, b, data, offsets in chunks(batch.column(at_text)):
            h, _, _, at = words(data, offsets)
            found, at = shingles(h, at, SIZE)
            own = [np.unique(found[i:j]).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:at_text]), pa.array(own, pa.binary())], [*batch.schema.names[:at_text], "shingles"])


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The least number that each row of a symmetric matrix reaches."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all sets with each other."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1  # the rest add to no pair
    column = (np.cumsum(several) - 1)[which]
    row = np.repeat(np.arange(n), size)
    kept = several[which]
    row, column = row[kept], column[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    total, step = int(several.sum()), max(256, (4 << 20) // n)
    for low in range(0, total, step):
        i, j = np.searchsorted(column, (low, low + step))
        part = np.zeros((n, min(step, total - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += part @ part.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in in_groups(batches, ["root", "low", "high"]):
            ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
            low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
            values = table.column("shingles").to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if j - i < 2:
                    continue
                sets = [np.frombuffer(v, np.uint64) for v in values[i:j]]
                size = np.array([len(s) for s in sets], np.float64)
                both = common(sets)
                linked = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
                np.fill_diagonal(linked, False)
                if low[i] != high[i]:
                    linked &= block[i:j][:, None] != block[i:j][None, :]
                some = linked.any(axis=1)
                out.append((ids[i:j][some], (linked @ copies[i:j])[some], ids[i:j][roots_of(linked)][some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["id", "links", "root"])

    return run


def _forest(classes: DataFrame, store: Store, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Matched prefixes (grp, id, n, least) and the edges (a, b) of what they gather, at the depth that the recall asks for."""
    for depth in range(DEPTH, prefix_depth(threshold) - 1, -1):
        labels = classes.select("id", "signature").mapInArrow(_labels(depth), "key long, id long")
        matched = store.keep(grouped(labels, ["key"], _matched, "grp long, id long, n long, least long").distinct(), "matched")
        small = matched.where(F.col("n") <= LARGE).join(classes.select("id", "signature"), "id").select("grp", "id", "signature")
        edges = store.keep(grouped(small, ["grp"], _gather(threshold), "a long, b long, alike long"), "edges")
        alike = {r.alike: r.n for r in edges.where("alike is not null").groupBy("alike").agg(F.count("*").alias("n")).collect()}
        if estimated_recall(depth, alike, threshold) >= RECALL:
            break
        if depth > prefix_depth(threshold):
            store.drop(matched)
            store.drop(edges)
    whole = matched.where((F.col("n") > LARGE) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    return matched, edges.select("a", "b").unionByName(whole)


def _dealt(matched: DataFrame, members: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, root, ...) with their block, and the pairs (root, low, high) of blocks that share a matched prefix.

    Components of one block have block 0. In larger ones the block comes from the
    least prefix that a class is matched in, so that classes of one prefix mostly
    share it; prefixes of more than a block are dealt to several.
    """
    large = members.groupBy("root").agg(F.ceil(2 * F.count("*") / BLOCK).cast("long").alias("blocks"), F.count("*").alias("n")).where(F.col("n") > BLOCK).drop("n")
    some = members.select("id", "root").join(large, "root")
    anchors = matched.groupBy("id").agg(F.min("grp").alias("anchor")).join(some, "id")
    wide = anchors.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")).where("parts > 1")
    own = store.keep(
        anchors.join(wide, "anchor", "left").select(
            "id", "root",
            F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("anchor"), F.col("blocks")) + 1)
            .otherwise(-1 - F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("id"), F.col("parts"))), F.lit(1 << 62))).alias("block"),
        ),
        "blocks",
    )
    met = matched.select("grp", "id").join(own, "id").select("grp", "root", "block").distinct()
    pairs = met.join(met.select("grp", F.col("block").alias("other")), "grp").where("block <= other").select("root", F.col("block").alias("low"), F.col("other").alias("high"))
    itself = own.select("root", F.col("block").alias("low"), F.col("block").alias("high"))
    return own, pairs.unionByName(itself).distinct()


def near_duplicates(docs: DataFrame, store: Store, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, kept) of each row of ``docs`` (doc_id, text).

    Two texts are linked if the sets of their runs of five words have a Jaccard
    similarity of ``threshold`` or more; words are runs of ASCII letters and
    digits and of all characters beyond ASCII, in small letters. A text of one to
    four words has one run, all of them; a text without words or null links with
    nothing. n_links counts other rows linked directly, class_id is the least
    doc_id reachable over links, kept says doc_id = class_id. Rows of one id stay
    apart, each with the links of its own text. A null id has class_id null and is
    never kept; a class of rows without ids links with nothing. Classes are told
    apart by 64 bits.
    """
    signed = store.keep(
        docs.select("doc_id", F.xxhash64("text").alias("whole"), "text").mapInArrow(_sign, "doc_id long, whole long, id long, signature binary"), "signed"
    )
    worded = signed.where(F.col("signature").isNotNull())
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "whole"))
    same = store.keep(
        worded.groupBy("id").agg(F.min(named).alias("of"), F.count("*").alias("copies"), F.min("signature").alias("signature"))
        .select("id", F.col("of.doc_id").alias("doc_id"), F.col("of.whole").alias("whole"), "copies", "signature"),
        "classes",
    )
    every, same = same, same.where(F.col("doc_id").isNotNull())
    matched, edges = _forest(same, store, threshold)
    members = store.keep(store.keep(connected_components(edges, store), "components").join(same.select("id", "doc_id", "whole", "copies"), "id"), "members")
    blocks, pairs = _dealt(matched, members, store)
    placed = members.join(blocks.select("id", "block"), "id", "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    texts = (
        docs.select("doc_id", F.xxhash64("text").alias("whole"), "text").join(placed.hint("shuffle_hash"), ["doc_id", "whole"])
        .groupBy("doc_id", "whole", "id", "root", "copies", "block").agg(F.max("text").alias("text"))  # repeated rows
    )
    sets = store.keep(texts.select("id", "root", "copies", "block", "text").mapInArrow(_sets, "id long, root long, copies long, block long, shingles binary"), "sets")
    partners = pairs.select("root", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"), "low", "high")
    zero = F.lit(0).cast("long")
    asked = sets.where("block = 0").withColumns({"low": zero, "high": zero}).unionByName(sets.where("block <> 0").join(partners, ["root", "block"]))
    verified = store.keep(
        grouped(asked.select("root", "low", "high", "id", "copies", "block", "shingles"), ["root", "low", "high"], _verify(threshold), "id long, links long, root long"), "verified"
    )
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    found = store.keep(connected_components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")), store), "linked")
    least = found.join(same.select("id", "doc_id"), "id").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_class = every.select("id", "doc_id", "copies").join(links, "id", "left").join(found.join(least, "root").select("id", "class_id"), "id", "left").select(
        "id", "copies", F.when(F.col("doc_id").isNull(), zero).otherwise(F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id")
    )
    joined = join_by_size(worded.select("doc_id", "id"), by_class, ["id"], "copies", every.agg(F.coalesce(F.sum("copies"), zero)).first()[0]).select("doc_id", "class_id", "n_links")
    wordless = signed.where(F.col("signature").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"))
    return joined.unionByName(wordless).select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.col("n_links").cast("long").alias("n_links"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), Store(spark))
