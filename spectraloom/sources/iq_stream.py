"""Growing I/Q recordings as a stream: ``spark.readStream.format("iq_stream").option("chunk", n).load(folder)``.

An offset says how many samples of each file have been handed out, in whole chunks, so a micro-batch is a set of (file, sample range) and
a range that is asked for again gives the same rows. A file that grows goes on where it stopped; its unfinished last chunk waits.
The offset has one entry per file; ranges of ``rangesamples`` samples are the tasks, small ones together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from spectraloom.sources import iq


class IqStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iq_stream"

    def schema(self) -> str:
        return iq.IQ_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return IqStreamReader(self.options)


class IqStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.chunk = int(options.get("chunk", "65536"))
        self.span = iq._span(int(options.get("rangesamples", str(iq.RANGE_SAMPLES))), self.chunk)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Samples in whole chunks per recording, by name."""
        system, path = FileSystem.from_uri(iq._uri(self.root))
        found = {}
        for f in system.get_file_info(FileSelector(path, recursive=True, allow_not_found=True)):
            if f.is_file and f.base_name.lower().endswith(iq.RAW_SUFFIXES):
                found[f.path[len(path) :].lstrip("/")] = f.size // iq.SAMPLE_BYTES // self.chunk * self.chunk
        return found

    def partitions(self, start: dict, end: dict) -> list[iq._Ranges]:
        ranges = (
            (name, first, min(first + self.span, last))
            for name, last in sorted(end.items())
            for first in range(start.get(name, 0), last, self.span)
        )
        return [iq._Ranges(task) for task in iq.packed(ranges)]

    def read(self, partition: iq._Ranges) -> Iterator[pa.RecordBatch]:
        for name, first, last in partition.ranges:
            for batch in iq.read_range(f"{self.root}/{name}", name, first, last, last, self.chunk, 0):
                yield from (batch.slice(k, 1) for k in range(batch.num_rows))  # a chunk each

    def commit(self, end: dict) -> None:
        """Recordings stay where they are."""


def read_iq_stream(spark, path: str, chunk: int, range_samples: int = iq.RANGE_SAMPLES):
    """Chunks of all recordings below a folder as they grow."""
    spark.dataSource.register(IqStreamSource)
    return spark.readStream.format("iq_stream").option("chunk", chunk).option("rangesamples", range_samples).load(path)
