"""Objects named by their hash in a folder of any file system that Arrow knows (local, ``hdfs://``, ``s3://``, ``gs://``), as a data source.

An object never changes, so a task that runs again, or runs twice at the same time, writes the same bytes under the same name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of one row's content, and of the rows that one task reads.
RANGE = 8 << 20
TASK = 64 << 20


def file_system(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def make_store(folder: str) -> None:
    system, name = file_system(folder)
    system.create_dir(name, recursive=True)


@dataclass
class Written(WriterCommitMessage):
    objects: int


class ObjectStore(DataSource):
    """Format ``object_store``. Reads every object in rows of at most ``range`` bytes, ``start`` being a row's place in its object; an empty
    object is one row. Like Spark's file sources it lists names and sizes on the driver. Appends rows (hash, alg, content), one a whole object."""

    @classmethod
    def name(cls) -> str:
        return "object_store"

    def schema(self) -> str:
        return "hash string, alg string, size bigint, start bigint, content binary"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)), int(self.options.get("task", TASK)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("objects of a store are only added")
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, folder: str, size: int, task: int):
        self.folder, self.range, self.task = folder, size, task

    def partitions(self) -> list[InputPartition]:
        """Ranges of objects, dealt so that a task reads about ``task`` bytes: large objects are read by many tasks."""
        from pyarrow import fs

        system, name = file_system(self.folder)
        tasks, own, room = [], [], self.task
        for f in system.get_file_info(fs.FileSelector(name)):
            if f.type != fs.FileType.File or f.base_name.startswith("."):
                continue
            for start in range(0, max(f.size, 1), self.range):
                own.append((f.base_name, f.size, start))
                room -= min(self.range, f.size - start) + 4096
                if room <= 0:
                    tasks.append(InputPartition(own))
                    own, room = [], self.task
        return [*tasks, InputPartition(own)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(self.folder)
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for name, size, start in partition.value:
            with system.open_input_file(f"{folder}/{name}") as f:
                f.seek(start)
                row = (name.partition(".")[0], name.rpartition(".")[2], size, start, f.read(min(self.range, size - start)))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["hash", "alg", "size", "start", "content"])


class _Writer(DataSourceArrowWriter):
    """Each object goes to a hidden name of this job, then to its own: no reader sees a part of one. What a failed job left hidden goes."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex
        make_store(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.folder)
        n = 0
        for batch in iterator:
            for h, a, content in zip(*[batch.column(c) for c in ("hash", "alg", "content")], strict=True):
                part = f"{folder}/.{self.job}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                system.move(part, f"{folder}/{h.as_py()}.{a.as_py()}")
                n += 1
        return Written(n)

    def _sweep(self) -> None:
        from pyarrow import fs

        system, folder = file_system(self.folder)
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(f".{self.job}."):
                system.delete_file(f.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Tasks that ran again may have left hidden parts behind."""
        self._sweep()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Whole objects stay, as they are right under their names; a later run skips them."""
        self._sweep()


def read_ranges(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """(hash, alg, size, start, content) of a store's objects in ranges of at most ``size`` bytes."""
    spark.dataSource.register(ObjectStore)
    return spark.read.format("object_store").option("range", str(size)).load(folder)


def write_objects(rows: DataFrame, folder: str) -> int:
    """Add (hash, alg, content) rows to a store, each key once. Returns how many keys there were."""
    rows.sparkSession.dataSource.register(ObjectStore)
    seen = Observation()
    unique = rows.dropDuplicates(["hash", "alg"]).select("hash", "alg", "content").observe(seen, F.count(F.lit(1)).alias("n"))
    unique.write.format("object_store").mode("append").save(folder)
    return seen.get["n"]
