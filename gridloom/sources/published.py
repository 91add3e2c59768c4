"""Versioned sets of files that appear whole or not at all.

A writer puts the files of one write into a folder of its own. Only when every task has ended well, the driver writes a
manifest with their names, as the next numbered file of ``_versions``, by one rename. Readers take the manifest with the
highest number, so they see the set before or the set after, whatever happens to tasks, executors or the driver in
between; files of attempts that failed are in no manifest. A failed write removes its folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.session import qualified

VERSIONS = "_versions"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: ``name, rows, bytes`` of its file, or nothing."""

    files: list[dict]


def versions(uri: str) -> list[int]:
    store, root = fs.FileSystem.from_uri(uri)
    found = store.get_file_info(fs.FileSelector(f"{root}/{VERSIONS}", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def manifest(uri: str, version: int | None = None) -> dict:
    """The manifest of a version, by default the last: ``schema`` and ``files``."""
    known = versions(uri)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"nothing is published at {uri}")
    store, root = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{root}/{VERSIONS}/{known[-1] if version is None else version:012d}.json") as f:
        return json.loads(f.read())


class PublishingWriter(DataSourceArrowWriter):
    """Writes a file a task by ``write_file`` and publishes them together."""

    def __init__(self, uri: str, schema: StructType, replace: bool):
        self.uri, self.schema, self.replace = uri, schema.json(), replace
        self.folder = uuid.uuid4().hex
        # Made here and not by the tasks: one that is still running when the write is given up must not make it again.
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(f"{root}/{self.folder}", recursive=True)

    def write_file(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
        """Write the rows of a task and return their number."""
        raise NotImplementedError

    def facts(self) -> dict:
        """More about the file just written, for its entry in the manifest."""
        return {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written([])

        def rows() -> Iterator[pa.RecordBatch]:
            yield first
            yield from iterator

        store, root = fs.FileSystem.from_uri(self.uri)
        name = f"{self.folder}/part-{uuid.uuid4().hex}"  # another name for each attempt
        with store.open_output_stream(f"{root}/{name}") as out:
            n = self.write_file(out, rows())
            size = out.tell()
        return Written([{"name": name, "rows": n, "bytes": size, **self.facts()}])

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if not files:
            self.abort(messages)  # an empty table needs no folder
        known = versions(self.uri)
        if not self.replace and known:
            files = manifest(self.uri)["files"] + files
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(f"{root}/{VERSIONS}", recursive=True)
        draft, number = f"{root}/{VERSIONS}/draft-{self.folder}", (known[-1] if known else 0) + 1
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"schema": json.loads(self.schema), "files": sorted(files, key=lambda f: f["name"])}).encode())
        store.move(draft, f"{root}/{VERSIONS}/{number:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.folder}")


class ParquetWriter(PublishingWriter):
    def write_file(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
        first, n = next(batches), 0
        with pq.ParquetWriter(out, first.schema, compression="zstd") as file:
            for batch in (b for part in ([first], batches) for b in part):
                file.write_batch(batch)
                n += batch.num_rows
        return n


class ParquetSets(DataSource):
    """Write side of published tables; Spark's own reader reads them (``read``)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_published"

    def writer(self, schema: StructType, overwrite: bool) -> ParquetWriter:
        return ParquetWriter(self.options["uri"], schema, overwrite)


def publish(df: DataFrame, path: str, replace: bool = True) -> None:
    """Publish ``df`` under ``path``: as a new version in place of the last one, or (``replace`` false) next to its rows.

    One file a task. An empty table is a version without files.
    """
    spark = df.sparkSession
    spark.dataSource.register(ParquetSets)
    df.write.format(ParquetSets.name()).mode("overwrite" if replace else "append").option("uri", qualified(spark, path)).save()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a published table, of its last version or a stated one. Only files in its manifest are read."""
    uri = qualified(spark, path)
    found = manifest(uri, version)
    schema = StructType.fromJson(found["schema"])
    files = [f"{uri}/{f['name']}" for f in found["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
