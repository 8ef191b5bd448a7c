"""An append-only log of rows as a data source ("eventlog") that takes each batch once.

Tasks write files of JSON lines under names of their own and report them; the driver's commit lists them in
one new file of the folder ``_commits``, named by the batch, and readers see listed files only. A batch
that comes again finds its commit and its files go; tasks that fail or run twice leave files that
no commit lists, and an aborted batch removes what it knows of. Works wherever Arrow's file systems reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "eventlog"
COMMITS = "_commits"


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written."""

    files: list[str] = field(default_factory=list)


class _Folder:
    """The log's folder in whatever file system holds it."""

    def __init__(self, path: str):
        self.path = path

    def at(self, *names: str) -> tuple[fs.FileSystem, str]:
        system, top = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, "/".join([top.rstrip("/"), *names])

    def read(self, *names: str) -> str:
        system, p = self.at(*names)
        with system.open_input_stream(p) as f:
            return f.read().decode()

    def write(self, text: str, *names: str) -> None:
        system, p = self.at(*names)
        system.create_dir(p.rpartition("/")[0], recursive=True)
        with system.open_output_stream(p) as f:
            f.write(text.encode())

    def exists(self, *names: str) -> bool:
        system, p = self.at(*names)
        return system.get_file_info(p).type == fs.FileType.File

    def remove(self, files: list[str]) -> None:
        for name in files:
            system, p = self.at(name)
            if system.get_file_info(p).type == fs.FileType.File:
                system.delete_file(p)

    def commits(self) -> list[str]:
        system, p = self.at(COMMITS)
        found = system.get_file_info(fs.FileSelector(p, allow_not_found=True))
        return sorted(x.base_name for x in found if x.base_name.endswith(".json"))

    def commit(self, batch: str, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if self.exists(COMMITS, f"{batch}.json"):
            self.remove(files)
            return
        # written aside and moved, so that a commit is there whole or not at all
        self.write(json.dumps(files), COMMITS, f".{batch}-{uuid.uuid4().hex}")
        system, target = self.at(COMMITS, f"{batch}.json")
        aside = next(x.path for x in system.get_file_info(fs.FileSelector(target.rpartition("/")[0])) if x.base_name.startswith(f".{batch}-"))
        system.move(aside, target)


def _write(folder: _Folder, schema: T.StructType, rows: Iterator[Row]) -> Written:
    names = schema.fieldNames()
    lines = [json.dumps(dict(zip(names, r)), default=str, ensure_ascii=False) for r in rows]
    if not lines:
        return Written([])
    name = f"part-{uuid.uuid4().hex}.json"
    folder.write("\n".join(lines) + "\n", name)
    return Written([name])


class _BatchWriter(DataSourceWriter):
    def __init__(self, folder: _Folder, schema: T.StructType, batch: str):
        self.folder, self.schema, self.batch = folder, schema, batch

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return _write(self.folder, self.schema, iterator)

    def commit(self, messages: list) -> None:
        self.folder.commit(self.batch, messages)

    def abort(self, messages: list) -> None:
        self.folder.remove([f for m in messages if m is not None for f in m.files])


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: _Folder, schema: T.StructType, query: str):
        self.folder, self.schema, self.query = folder, schema, query

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return _write(self.folder, self.schema, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.folder.commit(f"{self.query}-{batchId:012d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.folder.remove([f for m in messages if m is not None for f in m.files])


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for c in self.folder.commits() for f in json.loads(self.folder.read(COMMITS, c))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = self.schema.fieldNames()
        for line in self.folder.read(partition.name).splitlines() if partition is not None else []:
            row = json.loads(line)
            yield tuple(row.get(n) for n in names)


class EventLog(DataSource):
    """Options: ``path``; for batches ``batch``, a name by which a repeated one is known (else each is new); for streams ``query``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("the log is read with a schema")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return _BatchWriter(_Folder(self.options["path"]), schema, self.options.get("batch", uuid.uuid4().hex))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(_Folder(self.options["path"]), schema, self.options.get("query", "stream"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(_Folder(self.options["path"]), schema)


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Rows appended to a log, once for each name of a batch; values are numbers, strings, booleans or null."""
    df.sparkSession.dataSource.register(EventLog)
    writer = df.write.format(NAME).option("path", path).mode("append")
    (writer.option("batch", batch) if batch else writer).save()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's committed rows."""
    spark.dataSource.register(EventLog)
    return spark.read.format(NAME).schema(schema).option("path", path).load()
