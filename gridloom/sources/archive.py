"""Band archives: a binary format for decoded raster bands, read by the band.

A file holds the pixels of its bands one after the other (little-endian 32-bit floats) and ends with an index: a row of
four 64-bit integers for each band (year, ordinal, offset, bytes), their number and a mark. A scan is planned from the
indices: bands that the pushed filters or the work list rule out are in no partition, and only the byte ranges of the others
are read, neighbours together. Sets of files are published whole (``gridloom.sources.published``).

An archive is a stream source, too: band after band, version after version, in batches of a stated size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from gridloom.session import qualified
from gridloom.sources.published import PublishingWriter, manifest, versions

SCHEMA = "year INT, band INT, pixels ARRAY<FLOAT>, nbytes BIGINT"
MARK = b"BANDIDX1"
#: Bytes of pixels in a partition of a scan (a larger band is a partition of its own).
PARTITION_BYTES = 64 << 20
#: Bytes of pixels in a micro-batch of a stream.
BATCH_BYTES = 16 << 30
#: Longest work list that is sent along with a scan (16 MB); a longer one is joined after the filters.
WORK_ROWS = 1 << 20


def read_index(store: fs.FileSystem, path: str, size: int) -> np.ndarray:
    """``[band, (year, ordinal, offset, bytes)]`` of one file."""
    with store.open_input_file(path) as f:
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MARK:
            raise ValueError(f"{path} is no band archive")
        n = int.from_bytes(tail[:8], "little")
        f.seek(size - 16 - 32 * n)
        return np.frombuffer(f.read(32 * n), "<i8").reshape(n, 4)


class ArchiveWriter(PublishingWriter):
    def write_file(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
        index = []
        for batch in batches:
            years, bands = batch.column("year").to_pylist(), batch.column("band").to_pylist()
            for year, band, pixels in zip(years, bands, batch.column("pixels")):
                if year is None or band is None or pixels.values is None:
                    raise ValueError("a band needs a year, an ordinal and pixels")
                data = pixels.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()  # a null pixel is stored as NaN
                index.append((year, band, out.tell(), len(data)))
                out.write(data)
        out.write(np.array(index, "<i8").tobytes() + len(index).to_bytes(8, "little") + MARK)
        self.first = min(index)[:2]
        return len(index)

    def facts(self) -> dict:
        return {"first": list(self.first)}


@dataclass
class Ranges(InputPartition):
    """Bands of one file: rows of its index."""

    path: str
    rows: list[tuple[int, int, int, int]]


def ranges(name: str, rows: np.ndarray) -> list[Ranges]:
    """Partitions of one file: its wanted rows of the index, by offset, cut by bytes."""
    cuts = np.flatnonzero(np.diff(np.cumsum(rows[:, 3]) // PARTITION_BYTES)) + 1
    return [Ranges(name, [tuple(r) for r in part.tolist()]) for part in np.split(rows, cuts) if len(part)]


def read_ranges(uri: str, partition: Ranges) -> Iterator[pa.RecordBatch]:
    if not partition.rows:
        return
    store, root = fs.FileSystem.from_uri(uri)
    rows = np.array(partition.rows, np.int64)
    runs = np.split(rows, np.flatnonzero(rows[1:, 2] != rows[:-1, 2] + rows[:-1, 3]) + 1)
    with store.open_input_file(f"{root}/{partition.path}") as f:
        for run in runs:  # bands that are neighbours in the file are one read
            f.seek(int(run[0, 2]))
            data = np.frombuffer(f.read(int(run[:, 3].sum())), "<f4").astype(np.float32)
            ends = np.append(0, np.cumsum(run[:, 3] // 4)).astype(np.int32)
            pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(data))
            columns = [pa.array(run[:, 0].astype(np.int32)), pa.array(run[:, 1].astype(np.int32)), pixels, pa.array(run[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["year", "band", "pixels", "nbytes"])


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, version: int | None, work: str | None):
        self.uri, self.version = uri, version
        self.work = None if work is None else [tuple(x) for x in json.loads(work)]
        self.tests: list[tuple[int, str, list[int]]] = []  # column of the index, operation, values

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ``year`` and ``band`` with constants; gives the others back to Spark."""
        kinds = {EqualTo: "in", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            column = {("year",): 0, ("band",): 1}.get(getattr(f, "attribute", None))
            if column is None or type(f) not in kinds:
                yield f
                continue
            values = list(f.value) if isinstance(f, In) else [f.value]
            self.tests.append((column, kinds[type(f)], [v for v in values if v is not None]))

    def _wanted(self, index: np.ndarray) -> np.ndarray:
        keep = np.ones(len(index), bool)
        for column, kind, values in self.tests:
            x = index[:, column]
            if kind == "in":
                keep &= np.isin(x, values)
            elif not values:  # compared with a null
                keep[:] = False
            else:
                v = values[0]
                keep &= {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[kind]
        if self.work is not None:
            pairs = np.array([y << 32 | b for y, b in self.work], np.int64)
            keep &= np.isin(index[:, 0] << 32 | index[:, 1], pairs)
        return index[keep]

    def partitions(self) -> list[Ranges]:
        store, root = fs.FileSystem.from_uri(self.uri)
        out = []
        for file in manifest(self.uri, self.version)["files"]:
            rows = self._wanted(read_index(store, f"{root}/{file['name']}", file["bytes"]))
            out += ranges(file["name"], rows[np.argsort(rows[:, 2], kind="stable")])
        return out or [Ranges("", [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from read_ranges(self.uri, partition)


class BandStream(DataSourceStreamReader):
    """Bands in the order of versions, and of (year, ordinal) within a version.

    An offset is a place: version, number of the file in its order, number of the band in the file. Files of a version
    never change, so a batch that is repeated after a failure reads the same bands. A batch takes at most
    ``batch_bytes`` of pixels, and one band at least. A version that replaces others brings only its own files.
    """

    def __init__(self, uri: str, batch_bytes: int):
        self.uri, self.batch_bytes = uri, batch_bytes
        self.at = (0, 0, 0)

    def _added(self, version: int) -> list[dict]:
        """Files that are new in ``version``, in the order of their first bands (their bands don't interleave)."""
        known = [v for v in versions(self.uri) if v < version]
        old = {f["name"] for f in manifest(self.uri, known[-1])["files"]} if known else set()
        new = [f for f in manifest(self.uri, version)["files"] if f["name"] not in old]
        return sorted(new, key=lambda f: (f["first"], f["name"]))

    def _pieces(self, start: tuple, end: tuple | None) -> Iterator[tuple[tuple, str, np.ndarray]]:
        """Per file between two places: the place of its first band taken, its name and the rows of its index. Only files
        that are asked for are opened."""
        store, root = fs.FileSystem.from_uri(self.uri)
        for version in versions(self.uri):
            if version < start[0] or end is not None and version > end[0]:
                continue
            files = self._added(version)
            for number in range(start[1] if version == start[0] else 0, len(files)):
                place = (version, number, start[2] if (version, number) == start[:2] else 0)
                if end is not None and place >= end:
                    return
                rows = read_index(store, f"{root}/{files[number]['name']}", files[number]["bytes"])
                yield place, files[number]["name"], rows[place[2] : end[2] if end is not None and place[:2] == end[:2] else None]

    def initialOffset(self) -> dict:
        return _offset((0, 0, 0))

    def latestOffset(self) -> dict:
        left, taken = self.batch_bytes, False
        for place, _, rows in self._pieces(self.at, None):
            fit = int(np.searchsorted(np.cumsum(rows[:, 3]), left, "right"))
            fit = fit if taken or fit or not len(rows) else 1
            self.at = (place[0], place[1], place[2] + fit) if fit < len(rows) else (place[0], place[1] + 1, 0)
            if fit < len(rows):
                break
            left, taken = left - int(rows[:, 3].sum()), True
        return _offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        # After a restart Spark asks for the empty range at the last place known, or for the batch that was not committed.
        self.at = _place(end)
        return [r for _, name, rows in self._pieces(_place(start), _place(end)) for r in ranges(name, rows)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from read_ranges(self.uri, partition)


def _offset(place: tuple) -> dict:
    return dict(zip(("version", "file", "band"), place))


def _place(offset: dict) -> tuple:
    return offset["version"], offset["file"], offset["band"]


class BandArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_bands"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        version = self.options.get("version")
        return ArchiveReader(self.options["uri"], None if version is None else int(version), self.options.get("work"))

    def streamReader(self, schema: StructType) -> BandStream:
        return BandStream(self.options["uri"], int(self.options.get("batch_bytes", BATCH_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["uri"], schema, overwrite)


def save(bands: DataFrame, path: str, replace: bool = True) -> None:
    """Publish ``year, band, pixels`` as an archive under ``path``. Files hold neighbouring bands; null pixels become NaN."""
    spark = bands.sparkSession
    spark.dataSource.register(BandArchive)
    sorted_bands = bands.select("year", "band", "pixels").repartitionByRange("year", "band").sortWithinPartitions("year", "band")
    writer = sorted_bands.write.format(BandArchive.name()).mode("overwrite" if replace else "append")
    writer.option("uri", qualified(spark, path)).save()


def read(spark: SparkSession, path: str, version: int | None = None, work: list[tuple[int, int]] | None = None) -> DataFrame:
    """``year, band, pixels, nbytes`` (bytes read for the band). Filters on ``year`` and ``band`` reach the index."""
    spark.dataSource.register(BandArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(BandArchive.name()).option("uri", qualified(spark, path))
    if version is not None:
        reader = reader.option("version", version)
    return (reader if work is None else reader.option("work", json.dumps(work))).load()


def stream(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``year, band, pixels, nbytes`` as a stream that follows the archive. Run it with a processing-time trigger
    (``gridloom.streaming.stats.drain`` ends it): a run with ``availableNow`` takes one batch."""
    spark.dataSource.register(BandArchive)
    reader = spark.readStream.format(BandArchive.name()).option("uri", qualified(spark, path))
    return reader.option("batch_bytes", batch_bytes).load()


def read_listed(spark: SparkSession, path: str, work: DataFrame, limit: int = WORK_ROWS) -> DataFrame:
    """The bands of the distinct ``year, band`` rows of ``work``; others are not read.

    A list of at most ``limit`` rows travels with the scan. A longer one limits the scan by its extent and is joined.
    """
    work = work.select("year", "band").where("year is not null and band is not null").distinct()
    facts = work.agg(F.count(F.lit(1)), F.min("year"), F.max("year"), F.min("band"), F.max("band")).first()
    if facts[0] <= limit:
        return read(spark, path, work=[(r["year"], r["band"]) for r in work.collect()])
    inside = (F.col("year") >= facts[1]) & (F.col("year") <= facts[2]) & (F.col("band") >= facts[3]) & (F.col("band") <= facts[4])
    return read(spark, path).where(inside).join(work, ["year", "band"])
