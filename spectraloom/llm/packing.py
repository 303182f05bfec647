"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A document longer than the capacity gives full pieces, which are bins of their own, and a tail. Tails and shorter documents
are packed by best fit, longest first. A bin carries a bitmap of the sources and one of the duplicate clusters it holds; a piece
may enter a bin only if neither its source nor its cluster is there. Bins are kept in the order of their residual: the search starts
at the piece's successor (the least residual that holds it) and goes on until the first, so the tightest, compatible bin is found; without
one a new bin is opened.

Packing runs in windows of ``window_rows`` pieces dealt by a hash of the id, so a source or cluster with a third of all rows is
spread over all windows and no task holds more than a window. Only (id, size, source, cluster) are shuffled, never the text.

Defined results. Null or empty text has size 0 and takes a place in a bin (the tightest compatible one, which may be full). A null source or
cluster never conflicts. Repeated rows are packed separately and conflict through their cluster. Ties between pieces go by id, then piece number. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import byte_length, whole

SCHEMA = "doc_id long, piece int, size long, source string, cluster long, bin string, offset long"


class Bins:
    """Open bins in order of residual, ties by age, with one row of bitmap words each."""

    def __init__(self, capacity: int, words: int):
        self.capacity = capacity
        self.residual = np.empty(0, np.int64)
        self.number = np.empty(0, np.int64)
        self.bitmap = np.empty((0, words), np.uint64)
        self.opened = 0

    def place(self, size: int, own: np.ndarray) -> tuple[int, int]:
        """Bin number and offset for a piece whose bits are ``own``."""
        at = int(np.searchsorted(self.residual, size))  # successor: the tightest that holds the piece
        step = 64
        while at < len(self.residual):
            clash = (self.bitmap[at : at + step] & own).any(axis=1)
            free = int(clash.argmin())
            if not clash[free]:
                at += free
                break
            at += len(clash)
            step *= 2
        if at >= len(self.residual):
            number, residual, bitmap = self.opened, self.capacity, own
            self.opened += 1
        else:
            number, residual, bitmap = int(self.number[at]), int(self.residual[at]), self.bitmap[at] | own
            self._cut(at)
        offset = self.capacity - residual
        low, high = (int(np.searchsorted(self.residual, residual - size, side=side)) for side in ("left", "right"))
        to = low + int(np.searchsorted(self.number[low:high], number))
        self.residual = np.insert(self.residual, to, residual - size)
        self.number = np.insert(self.number, to, number)
        self.bitmap = np.insert(self.bitmap, to, bitmap, axis=0)
        return number, offset

    def _cut(self, at: int) -> None:
        self.residual = np.delete(self.residual, at)
        self.number = np.delete(self.number, at)
        self.bitmap = np.delete(self.bitmap, at, axis=0)


def _bits(keys: list, repeated_only: bool) -> tuple[dict, int]:
    """A bit number per key that can clash inside the window."""
    seen: dict = {}
    for k in keys:
        if k is not None:
            seen[k] = seen.get(k, 0) + 1
    clashing = [k for k, n in seen.items() if n > 1 or not repeated_only]
    return {k: i for i, k in enumerate(clashing)}, len(clashing)


def pack_window(sizes: list[int], sources: list, clusters: list, order: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each piece of one window, packed in ``order``."""
    source_bit, n_sources = _bits(sources, True)
    cluster_bit, n_clusters = _bits(clusters, True)
    source_words = -(-n_sources // 64)
    words = max(1, source_words + -(-n_clusters // 64))
    bins = Bins(capacity, words)
    number, offset = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        own = np.zeros(words, np.uint64)
        if sources[i] in source_bit:
            b = source_bit[sources[i]]
            own[b // 64] |= np.uint64(1 << (b % 64))
        if clusters[i] in cluster_bit:
            b = cluster_bit[clusters[i]]
            own[source_words + b // 64] |= np.uint64(1 << (b % 64))
        number[i], offset[i] = bins.place(sizes[i], own)
    return number, offset


def _pack(capacity: int, window_rows: int):
    def close(group: int, window: int, held: list[tuple]) -> pa.RecordBatch:
        ids, sizes, sources, clusters = (list(x) for x in zip(*held))
        out: list[tuple] = []
        tails = [s % capacity if s > capacity else s for s in sizes]
        order = sorted(range(len(ids)), key=lambda i: (-tails[i], ids[i] is None, ids[i] or 0))
        number, offset = pack_window(tails, sources, clusters, order, capacity)
        for i, (doc, size) in enumerate(zip(ids, sizes)):
            full = (size - tails[i]) // capacity
            for p in range(full):
                out.append((doc, p, capacity, sources[i], clusters[i], f"{group}-{window}-f{i}.{p}", 0))
            if tails[i] or not full:
                out.append((doc, full, tails[i], sources[i], clusters[i], f"{group}-{window}-{number[i]}", offset[i]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["doc_id", "piece", "size", "source", "cluster", "bin", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window, held = None, 0, []
        for batch in batches:
            for g, *row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if g != group or len(held) >= window_rows:
                    if held:
                        yield close(group, window, held)
                    window, held = (window + 1 if g == group else 0), []
                    group = g
                held.append(tuple(row))
        if held:
            yield close(group, window, held)

    return run


def best_fit(sized: DataFrame, capacity: int, window_rows: int = 4096) -> DataFrame:
    """``sized``: doc_id, size, source, cluster. One row per piece: doc_id, piece, size, source, cluster, bin, offset.

    Every bin's pieces fill [offset, offset + size) without gaps.
    """
    rows = sized.count()
    groups = max(1, -(-rows // window_rows))
    dealt = sized.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("group"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("size").cast("long").alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"),
    )
    ordered = dealt.repartition("group").sortWithinPartitions("group", "doc_id", "size", "source", "cluster")
    return ordered.mapInArrow(_pack(capacity, window_rows), SCHEMA)


def pack_documents(
    docs: DataFrame, capacity: int = 8192, window_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Documents measured in UTF-8 bytes (one byte-level token each); equal texts are one duplicate cluster."""
    text = whole(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), byte_length(text).alias("size"), F.col(source_col).alias("source"), F.xxhash64(text).alias("cluster"),
    )
    return best_fit(sized, capacity, window_rows)
