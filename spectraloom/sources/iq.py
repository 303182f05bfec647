"""I/Q recordings as a Spark data source, CSV and image readers.

Recordings are interleaved float32 pairs. One input partition covers one byte range of one file, so
a huge recording is read by many tasks; each range also reads the samples a segment that starts in
it needs beyond its end.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLE_BYTES = 8
RANGE_SAMPLES = 4 << 20
TEXT_RANGE_BYTES = 32 << 20
# Suffixes that hold raw interleaved pairs, text pairs.
RAW_SUFFIXES = (".dat", ".bin", ".iq", ".cf32", ".complex64", ".sigmf-data")
CSV_SUFFIXES = (".csv", ".txt")
CSV_PATTERN, CSV_GLOB = r"\.(csv|txt)$", "*.{[cC][sS][vV],[tT][xX][tT]}"

IQ_SCHEMA = "recording_id string, chunk_no long, start_sample long, i array<float>, q array<float>"


def open_file(uri: str):
    """Random-access file at a URI of any file system that Arrow knows."""
    system, path = FileSystem.from_uri(_uri(uri))
    return system.open_input_file(path)


def _uri(path: str) -> str:
    """``file:/x`` and plain paths as ``file:///x``."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def _arrow_reads(uri: str) -> bool:
    try:
        FileSystem.from_uri(_uri(uri.split("*")[0]))
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False
    return True


BATCH_BYTES = 1 << 20  # read at once
TASK_BYTES = 4 << 20  # ranges below this share a task
OPEN_BYTES = 64 << 10  # what opening a file counts as


def read_range(uri: str, name: str, first: int, last: int, total: int, chunk: int, halo: int) -> Iterator[pa.RecordBatch]:
    """Chunks that start in samples [first, last) of a file, read by seeking; a batch holds chunks of a bounded number of bytes."""
    step = max(1, BATCH_BYTES // (SAMPLE_BYTES * (chunk + halo))) * chunk
    with open_file(uri) as fh:
        for start in range(first, last, step):
            want = min(min(start + step, last) + halo, total)
            yield _chunk_batch(name, start, min(start + step, last), last, chunk, halo, fh.read_at((want - start) * SAMPLE_BYTES, start * SAMPLE_BYTES))


def packed(ranges: Iterator[tuple], most: int = TASK_BYTES) -> list[list[tuple]]:
    """Ranges (file, first, last, ...) in order, dealt to as few tasks as hold ``most`` bytes each; ranges that follow each other become one."""
    tasks, size = [[]], 0
    for file, first, last, *rest in ranges:
        if tasks[-1] and size + (last - first) * SAMPLE_BYTES > most:
            tasks.append([])
            size = 0
        before = tasks[-1][-1] if tasks[-1] else (None, 0, 0)
        if before[0] == file and before[2] == first:
            tasks[-1][-1] = (file, before[1], last, *rest)
        else:
            tasks[-1].append((file, first, last, *rest))
            size += OPEN_BYTES
        size += (last - first) * SAMPLE_BYTES
    return tasks


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple]):
        self.ranges = ranges


class IqDataSource(DataSource):
    """``spark.read.format("iq").option("chunk", n).option("halo", n).load(folder or file)``.

    A partition is one byte range, or several where they are small. The listing is made on the driver, as for any source; ``read_iq`` keeps it distributed.
    """

    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> str:
        return IQ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _IqReader(self.options)


class _IqReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.chunk = int(options.get("chunk", "65536"))
        self.halo = int(options.get("halo", "0"))
        limit = options.get("maxsamples")
        self.limit = int(limit) if limit else None
        self.span = _span(int(options.get("rangesamples", str(RANGE_SAMPLES))), self.chunk)

    def partitions(self):
        system, path = FileSystem.from_uri(_uri(self.root))
        info = system.get_file_info(path)
        files = [info] if info.is_file else [f for f in system.get_file_info(FileSelector(path, recursive=True)) if f.is_file]
        scheme = _uri(self.root).split("://")[0]
        ranges = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.base_name.lower().endswith(RAW_SUFFIXES):
                continue
            total = _limited(f.size // SAMPLE_BYTES, self.limit)
            uri = f"{scheme}://{f.path}"
            ranges += [(uri, first, min(first + self.span, total), total) for first in range(0, total, self.span)]
        return [_Ranges(task) for task in packed(ranges)]

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        for path, first, last, total in part.ranges:
            yield from read_range(path, _recording_name(path, self.root), first, last, total, self.chunk, self.halo)


def _span(range_samples: int, chunk: int) -> int:
    return max(chunk, range_samples // chunk * chunk)


def _chunk_batch(name: str, begin: int, end: int, last: int, chunk: int, halo: int, data: bytes) -> pa.RecordBatch:
    """The chunks that start in samples [begin, end), whose bytes and those of their halo are ``data``; none goes on behind ``last`` and halo."""
    pairs = np.frombuffer(data[: len(data) // SAMPLE_BYTES * SAMPLE_BYTES], dtype="<f4").reshape(-1, 2)
    starts = np.arange(begin, end, chunk)
    stops = np.minimum(np.minimum(starts + chunk, last) + halo, begin + len(pairs))
    at = np.concatenate([np.arange(a - begin, b - begin) for a, b in zip(starts, stops)]) if halo else slice(None)
    offsets = pa.array(np.r_[0, np.cumsum(stops - starts)].astype(np.int32))
    sides = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(pairs[at, k]))) for k in (0, 1)]
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(starts), np.int32)), pa.array([name])).cast(pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(starts // chunk), pa.array(starts), *sides], ["recording_id", "chunk_no", "start_sample", "i", "q"])


def read_raw(files: DataFrame, chunk: int, halo: int, max_samples: int | None, range_samples: int) -> DataFrame:
    """``files`` (path, name, length): byte ranges are rows of a DataFrame, dealt to tasks that seek and read them."""
    total = F.floor(F.col("length") / SAMPLE_BYTES)
    total = total if max_samples is None else F.least(total, F.lit(max_samples))
    span = _span(range_samples, chunk)
    ranges = files.withColumn("total", total.cast("long")).where("total > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(span).cast("long"))))
    dealt = ranges.select("path", "name", "first", "total").repartition("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, first, total in zip(*[c.to_pylist() for c in batch.columns]):
                yield from read_range(path, name, first, min(first + span, total), total, chunk, halo)

    return dealt.mapInArrow(run, IQ_SCHEMA)


def read_through_spark(spark: SparkSession, root: str, name: Column, chunk: int, halo: int, max_samples: int | None) -> DataFrame:
    """For stores that only Spark's file access knows: one task reads one file, 2 GB at most."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.where(~F.lower("path").rlike(CSV_PATTERN)).select(name.alias("name"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                total = len(content) // SAMPLE_BYTES
                total = total if max_samples is None else min(total, max_samples)
                for start in range(0, total, chunk):
                    stop = min(start + chunk + halo, total)
                    yield _chunk_batch(name, start, start + 1, total, chunk, halo, content[start * SAMPLE_BYTES : stop * SAMPLE_BYTES])

    return rows.mapInArrow(cut, IQ_SCHEMA)


def list_recordings(spark: SparkSession, root: str, suffixes: tuple[str, ...] = RAW_SUFFIXES + CSV_SUFFIXES) -> DataFrame:
    """Data files below a folder, sorted by path; only paths and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1)))
    return files.select("path", "length", suffix.alias("suffix")).where(F.col("suffix").isin(*suffixes)).orderBy("path")


def read_iq(
    spark: SparkSession, path: str, chunk: int = 65_536, halo: int = 0, max_samples: int | None = None, format: str = "auto",
    range_samples: int = RANGE_SAMPLES,
) -> DataFrame:
    """Chunks of every recording at a path. ``auto`` picks the reader by suffix, raw pairs otherwise.

    The listing stays a DataFrame; its byte ranges are opened on the executors.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    is_text = F.lit(True) if format == "csv" else F.lower("path").rlike(CSV_PATTERN) if format == "auto" else F.lit(False)
    name = recording_name(F.col("path"), path)
    if format != "csv" and not _arrow_reads(path):
        raw = read_through_spark(spark, path, name, chunk, halo, max_samples)
    else:
        raw = read_raw(listing.where(~is_text).select("path", name.alias("name"), "length"), chunk, halo, max_samples, range_samples)
    if listing.where(is_text).isEmpty():
        return raw
    return raw.unionByName(read_iq_csv(spark, path, chunk, max_samples, halo, root=path, only=None if format == "csv" else CSV_GLOB))


def _base(root: str) -> str:
    """The folder that names are relative to."""
    base = root.split("*")[0].rstrip("/") if "*" not in root else root.split("*")[0].rsplit("/", 1)[0]
    return base.removeprefix("file:").rstrip("/") + "/"


def _recording_name(file: str, root: str) -> str:
    """Path below the folder that was read, so equal names in different folders stay apart."""
    at = file.find(_base(root))
    return file[at + len(_base(root)) :] if at >= 0 else os.path.basename(file)


def recording_name(file: Column, root: str) -> Column:
    """Column form of the same."""
    at = F.locate(_base(root), file)
    return F.when(at > 0, F.substring(file, at + len(_base(root)), F.length(file))).otherwise(F.element_at(F.split(file, "/"), -1))


TEXT_BLOCK = 1 << 20  # bytes of a text recording that are taken apart at once
PACKED_GLOB = "*.{gz,bz2,zst,lz4,snappy,deflate}"
_IS_GAP = np.isin(np.arange(256), list(b",; \t\n\x0b\f\r"))
TEXT_SCHEMA = "recording_id string, start_sample long, i array<string>, q array<string>"


def _numbers(data: bytes) -> pa.StringArray:
    """The numbers of a text, as text."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_IS_GAP[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    ends = np.r_[0, np.cumsum(edges[1::2] - edges[::2])].astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw[inside]))


def _numbers_from(fh, first: int) -> Iterator[pa.StringArray]:
    """The numbers that begin at byte ``first`` or behind it, block after block."""
    at, rest, before = max(first - 1, 0), b"", first > 0
    while data := fh.read_at(TEXT_BLOCK, at):
        at += len(data)
        gaps = np.flatnonzero(_IS_GAP[np.frombuffer(data, np.uint8)])
        if not len(gaps):
            rest = b"" if before else rest + data
            continue
        data, cut = (data[gaps[0] :], gaps[-1] - gaps[0] + 1) if before else (rest + data, len(rest) + gaps[-1] + 1)
        before, rest = False, data[cut:]  # the last number may go on
        yield _numbers(data[:cut])
    yield _numbers(rest)


def _count_numbers(fh, first: int, last: int) -> int:
    """How many numbers begin in bytes [first, last)."""
    n, gap = 0, first == 0 or _IS_GAP[fh.read_at(1, first - 1)[0]]
    for at in range(first, last, TEXT_BLOCK):
        gaps = _IS_GAP[np.frombuffer(fh.read_at(min(TEXT_BLOCK, last - at), at), np.uint8)]
        n += int(np.count_nonzero(~gaps & np.r_[gap, gaps[:-1]]))
        gap = gaps[-1]
    return n


def _text_chunks(fh, name: str, first: int, before: int, begin: int, total: int, chunk: int, halo: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the text recording whose first number is one of ``begin`` that begin from byte ``first`` on, ``before`` lying in front of them."""
    at = -(-before // (2 * chunk)) * chunk  # start of the next chunk, in samples
    held, known, source = [], before, _numbers_from(fh, first)  # ``known``: number of the first one held
    while 2 * at < before + begin and at < total:
        stop = min(at + chunk + halo, total)
        have = sum(map(len, held))
        while known + have < 2 * stop:
            held.append(next(source))
            have += len(held[-1])
        flat = pa.concat_arrays(held)
        while 2 * stop <= known + have and 2 * at < before + begin and at < total:
            part = flat.slice(2 * at - known, 2 * (stop - at))
            even = pa.array(np.arange(0, len(part), 2))
            sides = [pa.ListArray.from_arrays(pa.array([0, len(even)], pa.int32()), part.take(k)) for k in (even, pa.array(np.arange(1, len(part), 2)))]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), *sides], ["recording_id", "start_sample", "i", "q"])
            at += chunk
            stop = min(at + chunk + halo, total)
        gone = min(2 * at - known, len(flat))
        held, known = [flat.slice(gone)], known + gone


def _as_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    numbers = [F.col(c).cast("array<float>").alias(c) for c in "iq"]
    return rows.select("recording_id", F.floor(F.col("start_sample") / chunk).cast("long").alias("chunk_no"), "start_sample", *numbers)


def read_text(files: DataFrame, chunk: int, halo: int, max_samples: int | None, range_bytes: int) -> DataFrame:
    """``files`` (path, name, length) of numbers as text: byte ranges are counted first, so that each knows the place of its numbers, then read."""
    spans = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "name", "length", F.explode(spans).alias("first")).repartition("path", "first")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, _, length, first in zip(*[c.to_pylist() for c in batch.columns]):
                with open_file(path) as fh:
                    found.append(_count_numbers(fh, first, min(first + range_bytes, length)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "n"])

    counted = ranges.mapInArrow(count, "path string, name string, length long, first long, n long")
    of_file = Window.partitionBy("path")  # one narrow row per range
    placed = counted.select(
        "path", "name", "first", "n", (F.sum("n").over(of_file.orderBy("first")) - F.col("n")).alias("before"), F.sum("n").over(of_file).alias("total")
    ).repartition("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, first, n, before, total in zip(*[c.to_pylist() for c in batch.columns]):
                with open_file(path) as fh:
                    yield from _text_chunks(fh, name, first, before, n, _limited(total // 2, max_samples), chunk, halo)

    return _as_chunks(placed.mapInArrow(run, TEXT_SCHEMA), chunk)


def _limited(total: int, max_samples: int | None) -> int:
    return total if max_samples is None else min(total, max_samples)


def read_text_through_spark(texts: DataFrame, chunk: int, halo: int, max_samples: int | None) -> DataFrame:
    """``texts`` (recording_id, value): whole texts as Spark reads and unpacks them, one task a file, 2 GB at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                fh = pa.BufferReader(text.as_buffer())
                n = _count_numbers(fh, 0, fh.size())
                yield from _text_chunks(fh, name, 0, 0, n, _limited(n // 2, max_samples), chunk, halo)

    return _as_chunks(texts.select("recording_id", "value").mapInArrow(cut, TEXT_SCHEMA), chunk)


def read_iq_csv(
    spark: SparkSession, path: str, chunk: int = 65_536, max_samples: int | None = None, halo: int = 0, root: str | None = None, only: str | None = None,
    range_bytes: int = TEXT_RANGE_BYTES,
) -> DataFrame:
    """Text of numbers between commas, semicolons or white space, even positions I and odd positions Q, as chunk rows.

    Files are read by byte ranges. Packed files, and those of stores that only Spark's file access knows, are one task each.
    """

    def name(file: Column) -> Column:
        return F.element_at(F.split(file, "/"), -1) if root is None else recording_name(file, root)

    def through_spark(glob: str | None) -> DataFrame:
        reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
        texts = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
        return read_text_through_spark(texts.withColumn("recording_id", name(F.col("_metadata.file_path"))), chunk, halo, max_samples)

    if not _arrow_reads(path):
        return through_spark(only)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", only) if only else files).load(path).select("path", name(F.col("path")).alias("name"), "length")
    if only:
        return read_text(files, chunk, halo, max_samples, range_bytes)
    plain = files.where(~F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$"))
    return read_text(plain, chunk, halo, max_samples, range_bytes).unionByName(through_spark(PACKED_GLOB))


def write_iq(df: DataFrame, path: str) -> None:
    """Chunks as Parquet: the splittable, compressed home of recordings once ingested."""
    df.write.mode("append").partitionBy("recording_id").parquet(path)


def chunk_segments(chunks: DataFrame, chunk: int, length: int, stride: int | None = None) -> DataFrame:
    """Segments that start inside each chunk; needs chunks read with ``halo >= length - 1``.

    Starts are counted over the whole recording (multiples of the stride), so segment numbers do not
    depend on the chunk size and no shuffle is needed.
    """
    stride = stride or length // 2
    begin, have = F.col("start_sample"), F.size("i")
    first = F.ceil(begin / stride) * stride
    last = F.least(begin + have - length, begin + F.lit(chunk - 1))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long")))
    out = chunks.withColumn("_at", F.explode(starts))
    offset = (F.col("_at") - begin + 1).cast("int")
    return out.select(
        "recording_id", (F.col("_at") / stride).cast("long").alias("segment_idx"), F.col("_at").alias("start_sample"),
        F.slice("i", offset, F.lit(length)).alias("i"), F.slice("q", offset, F.lit(length)).alias("q"),
    )


def read_spectrogram_images(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """Images as three-channel spectrogram rows: RGB, bilinear resize, /255, standardised per channel."""
    from spectraloom.operators.signal import resize_bilinear, standardize_array

    def decode(data: pa.Array, h: pa.Array, w: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for raw, hh, ww, nn in zip(data.to_pylist(), h.to_pylist(), w.to_pylist(), n.to_pylist()):
            x = np.frombuffer(raw, dtype=np.uint8).reshape(hh, ww, nn).astype(np.float64)
            rgb = np.repeat(x, 3, axis=2) if nn == 1 else x[:, :, 2::-1]
            x = resize_bilinear(rgb.transpose(2, 0, 1), size, size) / 255.0
            out.append(standardize_array(x, (1, 2), 0, 1e-6).ravel().astype(np.float32))
        return pa.array(out, type=pa.list_(pa.float32()))

    image = F.arrow_udf(decode, "array<float>")
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path)
    return rows.select(
        F.col("image.origin").alias("path"),
        image("image.data", "image.height", "image.width", "image.nChannels").alias("spec"),
        F.lit(3).alias("c"), F.lit(size).alias("h"), F.lit(size).alias("w"),
    )
