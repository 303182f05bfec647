"""Removal of long repeated byte strings by suffix sorting of content-defined shards.

Every string of ``length`` bytes is assigned to the least hash of its ``gram``-byte pieces. That value depends on the string alone, so all equal strings meet
under one key, and neighbouring strings mostly share it: a document falls into runs, each a key, a start and a text of about 270 bytes. Only (key, hash of
the run's text, place) is shuffled for all runs. A key with one run repeats nothing, unless the run holds its least piece twice. Runs with equal texts are counted before the shuffle and are removed
as a whole. For keys with several different texts, one copy of each text is fetched, dealt by key and sorted, so that Spark's external sort feeds tasks
with whole keys in order, whatever the size of a shard. There ``suffix_order`` orders the suffixes by recursive induction with common-prefix values,
block after block of about ``block_bytes``; a string repeats when a neighbour shares ``length`` bytes. A key with more than ``hot_texts`` different texts
is taken apart instead into its single strings, whose hashes are counted with map-side combination.

Runs and texts are compared by 128 bits of hash (key and text); strings of ordinary keys by their bytes.

Defined results. Null text is empty; texts shorter than ``length`` keep all bytes. Matches never cross documents; overlapping matches count. Rows with the
same id and text are separate documents, so all of their (long enough) text goes. Null ids are allowed. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import stored, whole
from spectraloom.llm.suffix_order import repeated_places

BYTES_AT_ONCE = 1 << 20
LONGEST_RUN = 2048


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of every ``gram``-byte piece, by doubling."""
    factor = 0x9E3779B97F4A7C15
    step, size = raw.astype(np.uint64) + np.uint64(0x51), 1
    out, done, rest = None, 0, gram
    while True:
        if rest & 1:
            if out is None:
                out, done = step, size
            else:
                n = len(raw) - (done + size) + 1
                out = out[:n] * np.uint64(factor) + step[done : done + n]
                done += size
        rest >>= 1
        if not rest:
            break
        n = len(raw) - 2 * size + 1
        step, size = step[:n] * np.uint64(factor) + step[size : size + n], 2 * size
        factor = factor * factor % (1 << 64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def find_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, start in the text, number of strings, key and a flag (may repeat a string in itself) of every run.

    All texts have at least ``length`` bytes. A string's key is the hash of its leftmost least piece. A string repeated inside a run makes a string
    of the run hold its least piece twice, or the run longer than the pieces of a string.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size) - size
    hashes, pieces = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram), length - gram + 1
    bits = np.uint64(max(16, int(size.sum()).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    place, upper = np.arange(len(hashes), dtype=np.uint64), hashes & ~low
    left = sliding_least(upper | place, pieces) & low
    right = low - (sliding_least(upper | (low - place), pieces) & low)
    strings = size - length + 1
    own = np.repeat(first - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())  # places whose string ends in its text
    left, right = left[own].astype(np.int64), right[own].astype(np.int64)
    key = hashes[left]
    begins = np.r_[True, key[1:] != key[:-1]]
    begins[np.cumsum(strings)[:-1]] = True
    heads = np.flatnonzero(begins)
    count = np.diff(np.r_[heads, len(key)])
    twice = np.add.reduceat(left != right, heads, dtype=np.int64) + (count > pieces) > 0
    parts = -(-count // LONGEST_RUN)
    if (parts > 1).any():
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads, twice = np.repeat(heads, parts) + inner * LONGEST_RUN, np.repeat(twice, parts)
        count = np.diff(np.r_[heads, len(key)])
    text = np.searchsorted(np.cumsum(strings), heads, side="right")
    return text, own[heads] - first[text], count, key[heads], twice


def _runs(length: int, gram: int):
    names = ["did", "th", "start", "n", "key", "body", "twice"]

    def close(ids, marks, texts) -> pa.RecordBatch:
        text, start, count, key, twice = find_runs(texts, length, gram)
        digest, tail = xxhash.xxh3_64_intdigest, length - 1
        body = np.fromiter((digest(texts[t][s : s + c + tail]) for t, s, c in zip(text.tolist(), start.tolist(), count.tolist())), np.uint64, len(text))
        cols = [np.array(ids, np.int64)[text], np.array(marks, np.int64)[text], start.astype(np.int32), count.astype(np.int32), key.view(np.int64), body.view(np.int64), twice]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts, size = [], [], [], 0
        for batch in batches:
            for did, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py()
                if len(raw) < length:
                    continue
                ids.append(did)
                marks.append(th)
                texts.append(raw)
                size += len(raw)
                if size >= BYTES_AT_ONCE:
                    yield close(ids, marks, texts)
                    ids, marks, texts, size = [], [], [], 0
        if texts:
            yield close(ids, marks, texts)

    return run


def _slices(length: int):
    """(did, th, text, runs) -> one row per run with its text."""
    names = ["key", "body", "n", "copies", "did", "th", "start", "hot", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for did, th, text, runs in zip(*[c.to_pylist() for c in batch.columns]):
                for r in runs:
                    out.append((r["key"], r["body"], r["n"], r["copies"], did, th, r["start"], r["hot"], text[r["start"] : r["start"] + r["n"] + length - 1]))
                    if len(out) >= 20_000:
                        yield _batch(out, names)
                        out = []
            if out:
                yield _batch(out, names)

    return run


_TYPES = {"key": pa.int64(), "body": pa.int64(), "n": pa.int32(), "copies": pa.int64(), "did": pa.int64(), "th": pa.int64(), "start": pa.int32(), "hot": pa.bool_(), "text": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for c, n in zip(zip(*rows), names)], names)


def _merged(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans [a, b) that the strings at the sorted starts cover."""
    new = np.r_[True, np.diff(starts) > length]
    return starts[new], np.r_[starts[np.flatnonzero(new)[1:] - 1], starts[-1:]] + length


def _sort_blocks(length: int, block_bytes: int):
    """Rows in order of key -> spans of the single-copy runs' documents that repeat under the key."""

    def close(rows: list[tuple]) -> pa.RecordBatch | None:
        repeated, first = repeated_places([r[-1] for r in rows], length)
        out: list[tuple[np.ndarray, ...]] = []
        for (_, _, n, copies, did, th, start, _), at in zip(rows, first.tolist()):
            if copies == 1 and len(hits := np.flatnonzero(repeated[at : at + n])):
                a, b = _merged(hits + start, length)
                out.append((np.full(len(a), did), np.full(len(a), th), a, b))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["did", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] == last:
                    continue  # the same run of a repeated row
                if size >= block_bytes and row[0] != last[0]:
                    if (out := close(held)) is not None:
                        yield out
                    held, size = [], 0
                last = row[:3]
                held.append(row[:7] + (row[8],))
                size += len(row[8])
        if held and (out := close(held)) is not None:
            yield out

    return run


def _strings(length: int):
    """Runs of hot keys -> one row per string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for key, _, n, copies, did, th, start, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.fromiter((digest(text[i : i + length]) for i in range(n)), np.uint64, n)
                cols = [np.full(n, key), own.view(np.int64), np.full(n, copies), np.full(n, did), np.full(n, th), np.arange(start, start + n)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["key", "string", "copies", "did", "th", "a"])

    return run


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 64, block_bytes: int = 2 << 20, hot_texts: int = 20_000) -> DataFrame:
    """``docs``: did, th, text (binary). Spans did, th, a, b of repeated bytes, overlapping ones included."""
    runs = stored(docs.mapInArrow(_runs(length, gram), "did long, th long, start int, n int, key long, body long, twice boolean"), "suffix-runs")
    where = F.struct("did", "th", "start")
    bodies = runs.groupBy("key", "body", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(where).alias("at"), F.max("twice").alias("twice"))
    keys = bodies.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("all"), F.max("twice").alias("any"))
    keys = keys.where((F.col("all") > 1) | F.col("any"))
    shared = stored(bodies.join(keys, F.col("key") == F.col("k")).select("key", "body", "n", "copies", "at", "twice", "texts"), "suffix-shared")

    copied = shared.where("copies > 1").select("key", "body", "n")
    spans = runs.join(copied, ["key", "body", "n"]).select("did", "th", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("n") + (length - 1)).cast("long").alias("b"))
    found = [stored(spans, "suffix-copied")]

    several = shared.where((F.col("texts") > 1) | F.col("twice")).select(
        "at.did", "at.th", F.struct("key", "body", "n", "copies", "at.start", (F.col("texts") > hot_texts).alias("hot")).alias("run")
    )
    per_doc = several.groupBy("did", "th").agg(F.collect_list("run").alias("runs"))  # at most the runs of one document
    slices = docs.join(per_doc, ["did", "th"]).select("did", "th", "text", "runs").mapInArrow(
        _slices(length), "key long, body long, n int, copies long, did long, th long, start int, hot boolean, text binary"
    )
    slices = stored(slices, "suffix-texts")
    dealt = slices.where("not hot").repartition("key").sortWithinPartitions("key", "body", "n")
    found.append(stored(dealt.mapInArrow(_sort_blocks(length, block_bytes), "did long, th long, a long, b long"), "suffix-spans"))
    if not (hot := slices.where("hot").dropDuplicates(["key", "body", "n"])).isEmpty():
        strings = stored(hot.mapInArrow(_strings(length), "key long, string long, copies long, did long, th long, a long"), "suffix-strings")
        often = strings.groupBy("key", "string").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("key", "string")
        single = strings.where("copies = 1").join(often, ["key", "string"])
        found.append(stored(single.select("did", "th", "a", (F.col("a") + length).alias("b")), "suffix-spans"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _cut(with_text: bool):
    """(doc_id, text, spans) -> what is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, spans in zip(*[c.to_pylist() for c in batch.columns]):
                kept, at, removed, n_spans, stop = [], 0, 0, 0, -1
                for span in sorted((s["a"], s["b"]) for s in spans or ()):
                    a, b = max(span[0], at), span[1]
                    n_spans += span[0] > stop
                    stop = max(stop, b)
                    if b > a:
                        kept.append(raw[at:a])
                        removed += b - a
                        at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((doc, len(raw), removed, n_spans, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every document."""
    text = whole(text_col)
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"),
    )
    spans = repeated_spans(keyed.select("did", "th", "text"), length, **options)
    per_doc = spans.groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most the runs of one document
    joined = keyed.join(per_doc, ["did", "th"], "left").select("doc_id", "text", "spans")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return joined.mapInArrow(_cut(with_text), shape)
