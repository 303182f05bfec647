"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts are lower-cased and every run of characters other than letters and digits becomes one space. Any ``window`` characters in a row of a
benchmark item are a window (shorter items are one window). A window of m characters has an edit budget
e = ``rate`` x m. By the q-gram lemma a region within e edits shares at least m - q + 1 - q e of the window's q-grams, all of them on
diagonals (text place minus item place) that span at most e + 1. Hits are therefore gathered per item and band, bands being twice
as wide as that and overlapping by half; only windows whose hits in a band reach the bound are aligned, inside the band, and of these only those whose
hits allow fewer edits than the best window of the item in the document. A document is contaminated when an alignment stays within the budget.

The benchmark is shipped in blocks of at most ``block_bytes``; a larger benchmark takes several passes over the documents, so what is
broadcast stays bounded. Documents are never shuffled; only found leaks are.

Defined results. Null or empty documents and null items have no leaks. Items of fewer than ``min_chars`` normalised
characters must stand in the text as they are, between ends or gaps of the text. Where rate x m would leave the lemma's bound under ``min_hits``, the budget is lowered until it holds. Repeated rows
are reported once per id and item with their least edits; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import whole

GAP = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
CHARS_AT_ONCE = 4_000_000
BLOOM_BITS = 22


def normalise(text: str) -> str:
    return GAP.sub(" ", text.lower()).strip()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    if len(points) < q:
        return np.empty(0, np.uint64)
    out = np.zeros(len(points) - q + 1, np.uint64)
    for i in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += points[i : len(points) - q + 1 + i]
        out ^= out >> np.uint64(32)
    return out


class Windows:
    """The characters of every window of ``window`` characters, by window number."""

    def __init__(self, index: Index):
        self.index = index

    def __getitem__(self, unit: int) -> np.ndarray:
        item, place = self.index._window(np.array([unit]))
        first = self.index.at[item[0]] + place[0]
        return self.index.points[first : first + self.index.chars[item[0]]]


class Index:
    """Benchmark items with the places of their q-grams; a unit is one window of an item, at any of its places."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, rate: float, min_chars: int, min_hits: int):
        self.q = q
        ids, texts, brief = [], [], {}
        for item, text in items:
            points = _points(normalise(text or ""))
            if len(points) >= max(min_chars, q):
                ids.append(item)
                texts.append(points)
            elif len(points):
                brief.setdefault(len(points), []).append((_qgram_hashes(points, len(points))[0], item, points))
        self.ids = np.array(ids, object)
        self.size = np.array([len(p) for p in texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.points = np.concatenate([*texts, np.zeros(1, np.uint32)])
        self.chars = np.minimum(self.size, window)  # of each window
        self.units = self.size - self.chars + 1
        self.first_unit = np.cumsum(self.units) - self.units
        most = (self.chars - q + 1 - min_hits) // q
        self.edits = np.maximum(0, np.minimum((self.chars * rate).astype(np.int64), most))
        self.need = np.maximum(1, self.chars - q + 1 - q * self.edits)
        self.band = int(self.edits.max(initial=0)) + 1
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        grams = [_qgram_hashes(p, q) for p in texts]
        hashes, owner = cat(grams, np.uint64), cat([np.full(len(h), k) for k, h in enumerate(grams)], np.int32)
        place = cat([np.arange(len(h)) for h in grams], np.int32)
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << BLOOM_BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] = True
        self.brief = {}
        for n, rows in brief.items():
            rows.sort(key=lambda r: r[0])
            self.brief[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], object), np.array([r[2] for r in rows])

    def _window(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item number and place of each unit."""
        item = np.searchsorted(self.first_unit, unit, side="right") - 1
        return item, unit - self.first_unit[item]

    item = property(lambda self: np.repeat(self.ids, self.units), doc="Item id of every unit.")
    length = property(lambda self: np.repeat(self.chars, self.units), doc="Characters of every unit.")
    budget = property(lambda self: np.repeat(self.edits, self.units), doc="Edits allowed for every unit.")
    text = property(Windows, doc="Characters of the units.")

    def search(self, points: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, text place and edits of verified regions, among them one of the least edits for each item and document.

        The text may hold several documents with ``band`` zeros between; ``starts`` are their first places.
        """
        none = (np.empty(0, np.int64),) * 3
        starts = np.zeros(1, np.int64) if starts is None else starts
        hashes = _qgram_hashes(points, self.q)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return none
        row = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[row] == hashes[at]
        at, row = at[same], row[same]
        n = self.count[row]
        post = np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place, at = self.owner[post].astype(np.int64), self.place[post].astype(np.int64), np.repeat(at, n)
        shift = int(self.size.max())  # diagonals may be negative
        low = (at - place + shift) // self.band
        span = (len(points) + shift) // self.band + 3
        owner = item * len(starts) + np.searchsorted(starts, at, side="right") - 1  # item and document
        keys = np.concatenate([owner * span + low + 1, owner * span + low])
        place = np.concatenate([place, place])
        _, group, hits = np.unique(keys, return_inverse=True, return_counts=True)
        many = hits[group] >= self.need[keys // span // len(starts)]
        keys, place = keys[many], place[many]
        if not len(keys):
            return none
        order = np.lexsort((place, keys))
        keys, place = keys[order], place[order]
        return self._verified(points, starts, keys, place, span, shift)

    def _verified(self, points: np.ndarray, starts: np.ndarray, keys: np.ndarray, place: np.ndarray, span: int, shift: int):
        """Windows whose hits (sorted by key and place) reach the bound, aligned where they can have the least edits."""
        item = keys // span // len(starts)
        need, reach = self.need[item], self.chars[item] - self.q
        end = np.arange(len(keys)) + need - 1
        fits = end < len(keys)
        last = np.minimum(end, len(keys) - 1)
        fits &= (keys[last] == keys) & (place[last] - place <= reach)
        key, item, reach = keys[fits], item[fits], reach[fits]
        from_, to = np.maximum(0, place[last][fits] - reach), np.minimum(place[fits], self.size[item] - self.chars[item])
        if not len(key):
            return (np.empty(0, np.int64),) * 3
        again = np.r_[False, key[1:] == key[:-1]]  # both ends grow inside a key: leave out what the interval before has
        from_ = np.where(again, np.maximum(from_, np.r_[0, to[:-1]] + 1), from_)
        n = np.maximum(0, to - from_ + 1)
        window = np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, item = np.repeat(key, n), np.repeat(item, n)
        _, group = np.unique(keys, return_inverse=True)
        wide = shift + 1
        line = group * wide + place
        mine = group[np.searchsorted(keys, key)] * wide + window
        hits = np.searchsorted(line, mine + self.chars[item] - self.q, side="right") - np.searchsorted(line, mine)
        least = np.maximum(0, -(-(self.chars[item] - self.q + 1 - hits) // self.q))  # edits the window has at least
        owner, start = key // span, (key % span - 1) * self.band - shift + window
        edits = np.full(len(key), 1 << 20, np.int64)

        def align(at: np.ndarray) -> None:
            for i in range(0, len(at), 20_000):
                part = at[i : i + 20_000]
                edits[part] = self._align(points, item[part], window[part], start[part])

        order = np.lexsort((least, owner))
        heads = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        align(heads)  # the most promising window of each item and document
        _, which = np.unique(owner, return_inverse=True)
        best = np.minimum(edits[heads], self.edits[item[heads]] + 1)
        rest = least < best[which]
        rest[heads] = False
        align(np.flatnonzero(rest))
        found = edits <= self.edits[item]
        doc = owner[found] % len(starts)
        middle = start[found] + self.chars[item[found]] // 2 + self.band
        place = np.clip(middle, starts[doc], np.r_[starts[1:], len(points)][doc] - 1)
        return self.first_unit[item[found]] + window[found], place, edits[found]

    def _align(self, points: np.ndarray, item: np.ndarray, window: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Least edits between each window and any text on the diagonals of its band."""
        most = self.band - 1
        width = 2 * self.band + 2 * most
        first = start - most
        padded = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
        columns = np.arange(width)
        cost = np.zeros((len(item), width), np.int32)
        length, best = self.chars[item], np.full(len(item), 1 << 20, np.int32)
        begin = self.at[item] + window
        for i in range(int(length.max())):
            text = padded[np.clip(first[:, None] + i + columns + 1, 0, len(padded) - 1)]
            step = cost + (text != self.points[np.minimum(begin + i, len(self.points) - 1)][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the unit left out
            cost = np.minimum.accumulate(step - columns, axis=1) + columns  # a character of the text left out
            ended = length == i + 1
            best[ended] = cost[ended].min(axis=1)
        return best

    def search_brief(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item id and text place of every item under the least length that stands as it is between word boundaries."""
        ids, places = [np.empty(0, object)], [np.empty(0, np.int64)]
        if self.brief:
            gap = np.concatenate([(points == 0) | (points == 32), [True]])
            begins = np.flatnonzero(np.r_[True, gap[:-1]] & ~gap)
            for n, (hashes, items, texts) in self.brief.items():
                at = begins[begins + n <= len(points)]
                at = at[gap[at + n]]
                spelled = points[at[:, None] + np.arange(n)]
                h = np.zeros(len(at), np.uint64)
                for i in range(n):
                    h *= np.uint64(0x9E3779B97F4A7C15)
                    h += spelled[:, i]
                    h ^= h >> np.uint64(32)
                low = np.searchsorted(hashes, h)
                m = np.searchsorted(hashes, h, side="right") - low
                post, row = np.repeat(low - (np.cumsum(m) - m), m) + np.arange(m.sum()), np.repeat(np.arange(len(at)), m)
                same = (texts[post] == spelled[row]).all(axis=1)
                ids.append(items[post[same]])
                places.append(at[row[same]])
        return np.concatenate(ids), np.concatenate(places)


def _gathered(batch: pa.RecordBatch, text_at: int, zeros: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Row numbers, their first places and the joined normalised texts, about CHARS_AT_ONCE characters at a time."""
    gap = np.zeros(zeros, np.uint32)
    rows, starts, texts, size = [], [], [], 0
    for i, text in enumerate(batch.column(text_at)):
        points = _points(normalise(text.as_py() or ""))
        rows.append(i)
        starts.append(size)
        texts += [points, gap]
        size += len(points) + zeros
        if size >= CHARS_AT_ONCE:
            yield rows, np.array(starts), np.concatenate(texts)
            rows, starts, texts, size = [], [], [], 0
    if rows:
        yield rows, np.array(starts), np.concatenate(texts)


def _found(index: Index, batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, item ids and edits of the leaks in a batch."""
    for rows, starts, points in _gathered(batch, text_at, index.band):
        unit, place, edits = index.search(points, starts)
        items, at = index.search_brief(points)
        if len(unit) or len(items):
            place, edits = np.concatenate([place, at]), np.concatenate([edits, np.zeros(len(at), np.int64)])
            yield np.array(rows)[np.searchsorted(starts, place, side="right") - 1], np.concatenate([index.ids[index._window(unit)[0]], items]), edits


def _scan(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, item, edits in _found(index, batch, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(edits.astype(np.int32))], ["doc_id", "item_id", "edits"])


def _drop(index: Index, batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean = np.ones(batch.num_rows, bool)
        for row, _, _ in _found(index, batch, text_at):
            clean[row] = False
        yield batch.filter(pa.array(clean))


def _indexes(benchmark: DataFrame, q: int, window: int, rate: float, min_chars: int, min_hits: int, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's index in broadcast blocks of about ``block_bytes`` of text."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)  # bounded by the block size
        yield context.broadcast(Index([tuple(r) for r in part.collect()], q, window, rate, min_chars, min_hits))


#: q-gram size, window and error rate of the search.
SEARCH = {"q": 10, "window": 120, "rate": 0.08, "min_chars": 20, "min_hits": 10, "block_bytes": 8 << 20}


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """doc_id, item_id, edits (least over the item's windows) of every leak; ``search`` overrides SEARCH."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = [
        texts.mapInArrow(lambda batches, index=index: _scan(index.value, batches), "doc_id long, item_id long, edits int")
        for index in _indexes(benchmark, **(SEARCH | search))
    ]
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, item_ids (sorted), edits (least)."""
    leaks = find_leaks(docs, benchmark, **options)
    return leaks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("edits"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **search) -> DataFrame:
    """The documents without leaks, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, **(SEARCH | search)):
        docs = docs.mapInArrow(lambda batches, index=index: _drop(index.value, batches, at), docs.schema)
    return docs
