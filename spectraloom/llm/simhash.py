"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints. Words of the lower-cased (A-Z) text, shingles of three words with repeats, XXH64 per shingle; a bit is 1 when more
than half of the hashes have it.

Linking within ``max_bits`` bits. Two fingerprints that close agree on at least one of max_bits + 1 bit blocks, so
every distinct fingerprint goes to one bucket per block (equal fingerprints are one row before this shuffle). A bucket with more than
``bucket_rows`` fingerprints is split the same way on its remaining bits, as often as needed. Inside buckets the fingerprints are
sorted by Gray rank, so that neighbours share most bits, and grouped into a tree: a node keeps the mask and pattern of the bits all
its members share, without those its parent already holds. A search goes down with the differences found so far and leaves out
a whole group once they exceed the limit. Only a spanning set of each bucket's links leaves the task.

Defined results. Null or empty text has no words: fingerprint 0, linked like any other. Fewer than three words: the sequence is the only
shingle. Repeated rows share a component; a null id never names a component that has another id. Empty table: empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import stored, unused, whole
from spectraloom.llm.components import connected_components

FANOUT = 8
ROWS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 4_000_000


def simhash64(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(words_per_shingle)])))
    n = len(shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.zeros(-(-n // 255) * 255, np.uint64)
    hashes[:n] = np.fromiter([digest(s, seed) for s in shingles], np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """Signed 64-bit form of the fingerprint."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out = np.fromiter((simhash64(t) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return run(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Buckets of Gray-ordered codes as one forest; level 0 are the codes, each upper level groups FANOUT nodes."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.codes = codes
        ones = zeros = codes  # AND and OR of each node's members
        first = np.arange(len(codes))  # first node of each node on the level below
        last_code = first
        self.levels = [(first, np.ones(len(codes), np.int64), codes, np.full(len(codes), ~np.uint64(0)), last_code)]
        while True:
            heads = np.r_[True, bucket[1:] != bucket[:-1]]
            starts = np.flatnonzero(heads)
            place = np.arange(len(bucket)) - starts[np.cumsum(heads) - 1]
            if len(self.levels) > 1 and place.max() == 0:
                break
            first = np.flatnonzero(place % FANOUT == 0)
            count = np.diff(np.r_[first, len(bucket)])
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(zeros, first)
            last_code = last_code[first + count - 1]
            bucket = bucket[first]
            shared = ~(ones ^ zeros)
            self.levels.append((first, count, ones & shared, shared, last_code))
        self.roots = bucket

    def pairs(self, bucket: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs i < j of the same bucket with at most ``limit`` differing bits."""
        root_of = np.searchsorted(self.roots, bucket)
        for begin in range(0, len(bucket), ROWS_AT_ONCE):
            query = np.arange(begin, min(begin + ROWS_AT_ONCE, len(bucket)))
            top = self.levels[-1]
            node = root_of[query]
            diff = np.bitwise_count((self.codes[query] ^ top[2][node]) & top[3][node]).astype(np.int64)
            yield from self._descend(len(self.levels) - 1, query, node, diff, limit)

    def _descend(self, level: int, query, node, diff, limit: int):
        keep = (diff <= limit) & (self.levels[level][4][node] > query)
        query, node, diff = query[keep], node[keep], diff[keep]
        if not len(query):
            return
        if level == 0:
            yield query, node
            return
        first, count, _, shared, _ = self.levels[level]
        _, _, pattern, mask, _ = self.levels[level - 1]
        fan = count[node]
        for part in np.array_split(np.arange(len(query)), max(1, int(fan.sum()) // PAIRS_AT_ONCE)):
            n = fan[part]
            child = np.repeat(first[node[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = np.repeat(query[part], n)
            own = mask[child] & ~np.repeat(shared[node[part]], n)  # bits not yet counted above
            more = np.bitwise_count((self.codes[q] ^ pattern[child]) & own)
            yield from self._descend(level - 1, q, child, np.repeat(diff[part], n) + more, limit)


def _spanning(n: int, pairs) -> np.ndarray:
    """Least index reachable through the pairs, for each of n indices."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (deeper := root[root] != root).any():
                root[deeper] = root[root[deeper]]
            if (root[a] == root[b]).all():
                break
    return root


def _links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, codes in _whole_buckets(batches):
            change = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
            bucket = np.r_[0, np.cumsum(change)]
            order = np.lexsort((gray_rank(codes), bucket))
            codes, bucket = codes[order], bucket[order]
            many = np.bincount(bucket)[bucket] > 1
            codes, bucket = codes[many], bucket[many]
            if not len(codes):
                continue
            root = _spanning(len(codes), GrayTree(bucket, codes).pairs(bucket, limit))
            linked = np.flatnonzero(root != np.arange(len(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(codes[linked].view(np.int64)), pa.array(codes[root[linked]].view(np.int64))], ["u", "v"])

    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch]):
    """Sorted batches regrouped so that no bucket is cut, about ROWS_AT_ONCE rows at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(cols[0]):
            continue
        held.append((cols[0], cols[1], cols[2].view(np.uint64)))
        size += len(cols[0])
        if size >= ROWS_AT_ONCE:
            mask, value, codes = (np.concatenate(x) for x in zip(*held))
            before = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield mask[:cut], value[:cut], codes[:cut]
            held, size = [(mask[cut:], value[cut:], codes[cut:])], len(mask) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of ``free`` in ``parts`` runs of near-equal length, as signed masks."""
    bits = [i for i in range(64) if free >> i & 1]
    size = len(bits)
    out = []
    for k in range(parts):
        mask = sum(1 << i for i in bits[k * size // parts : (k + 1) * size // parts])
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _bucketed(codes: DataFrame, max_bits: int, bucket_rows: int, levels: int = 3) -> DataFrame:
    """Rows (mask, value, code): the buckets of every code; large ones are split on the bits outside their mask."""
    def keys(masks: list[int]) -> Column:
        return F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))

    placed = codes.select(keys(_blocks((1 << 64) - 1, max_bits + 1)).alias("mask"), "code").select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code")
    for _ in range(levels - 1):
        large = placed.groupBy("mask", "value").count().where(F.col("count") > bucket_rows).select("mask", "value")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most (max_bits + 1) ** level values
        if not masks:
            break
        finer = {m: [m | b for b in _blocks(~m & ((1 << 64) - 1), max_bits + 1)] for m in masks}
        split = F.lit(None).cast("array<long>")
        for m, subs in finer.items():
            split = F.when(F.col("mask") == m, F.array(*[F.lit(s).cast("long") for s in subs])).otherwise(split)
        marked = placed.join(large.withColumn("large", F.lit(True)), ["mask", "value"], "left")
        target = F.when(F.col("large"), split).otherwise(F.array("mask"))
        placed = stored(
            marked.select(F.explode(target).alias("mask"), "code").select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code"), "simhash-buckets"
        )
    return placed


def link_codes(codes: DataFrame, max_bits: int = 3, bucket_rows: int = 50_000) -> DataFrame:
    """Links (u, v) that connect all distinct ``code`` values (long) within ``max_bits`` bits of each other."""
    placed = _bucketed(codes, max_bits, bucket_rows)
    return placed.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_links(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, bucket_rows: int = 50_000) -> DataFrame:
    """doc_id, code (long), component_id: the least id reachable through links."""
    prints = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(whole(text_col)).alias("code")), "simhash")
    codes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-codes")
    members = connected_components(link_codes(codes.select("code"), max_bits, bucket_rows))
    linked = codes.join(members, F.col("code") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    of_code = linked.join(lowest, "root").select(F.col("code").alias("c"), "lowest")
    named = codes.join(of_code, F.col("code") == F.col("c"), "left").select(F.col("code").alias("k"), F.coalesce("lowest", "least").alias("component_id"))
    return prints.join(named, F.col("code") == F.col("k")).select("doc_id", "code", "component_id")


def hex_code(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """One document of each group, the one with the least id, with all its columns.

    Documents without an id all stay; documents that share an id stay or go together.
    """
    named = docs.where(F.col(id_col).isNotNull())
    groups = near_duplicates(named, id_col, text_col, max_bits)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(unused(docs, "first_id")))
    kept = named.join(first, F.col(id_col).cast("long") == F.col(first.columns[0]), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
