"""Archives as a data source: ``spark.read.format("archives")`` and ``df.write.format("archives")``.

Reading makes one task per archive, small ones together, and streams entry
after entry; whatever cannot be read comes out as a row with an error. Writing
puts each task's rows into one archive under a hidden name, and the commit
makes all of them visible. Paths are opened by pyarrow's file systems (local,
hdfs, s3, gs), on the executors too, so the files need not fit into memory.
"""

from __future__ import annotations

import io
import re
import tarfile
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from inkspan.functions import ids

SCHEMA = "archive string, path string, content binary, error string"
ARROW = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
KINDS = {b"PK\x03\x04": "zip", b"PK\x05\x06": "zip", b"\x1f\x8b": "tar.gz"}
BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


def open_at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local, and Hadoop writes local ones with one slash."""
    local = re.fullmatch(r"(?:file:)?/+(.*)", uri, re.S)
    return (fs.LocalFileSystem(), "/" + local.group(1).rstrip("/")) if local else fs.FileSystem.from_uri(uri)


def kind_of(head: bytes) -> str | None:
    """By the first bytes; None for a file that is no archive."""
    return next((kind for magic, kind in KINDS.items() if head.startswith(magic)), None)


def entries(file, kind: str):
    """(path, content, error) of the entries of an open archive, one at a time.

    A damaged entry of a zip is one row with an error; a damaged tar or table of
    contents ends in such a row, after the entries before the damage.
    """
    try:
        if kind == "zip":
            with zipfile.ZipFile(file) as archive:
                for info in archive.infolist():
                    if info.is_dir():
                        continue
                    try:
                        yield info.filename, archive.read(info), None
                    except BROKEN as failure:
                        yield info.filename, None, f"{type(failure).__name__}: {failure}"
        else:
            with tarfile.open(fileobj=file, mode="r|gz") as archive:
                for member in archive:
                    if member.isfile():
                        yield member.name, archive.extractfile(member).read(), None
    except BROKEN as failure:
        yield None, None, f"{type(failure).__name__}: {failure}"


@dataclass
class Archives(InputPartition):
    """Archives that one task reads."""

    paths: tuple[str, ...]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        system, root = open_at(self.path)
        found = system.get_file_info(root)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
        hidden = lambda p: any(part[:1] in "._" for part in p[len(root) :].split("/") if part)
        made, held, size = [], [], 0
        for f in sorted((f for f in files if f.is_file and not hidden(f.path)), key=lambda f: f.path):
            if held and size + f.size > self.task_bytes:
                made.append(Archives(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return made + ([Archives(tuple(held))] if held else [])

    def read(self, partition: Archives):
        if not isinstance(partition, Archives):  # an empty folder has no partition
            return
        system, _ = open_at(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                kind = kind_of(file.read(4))
                file.seek(0)
                for name, content, error in entries(file, kind) if kind else ():
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, name, content, error), ARROW)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    shown: str


class ArchiveWriter(DataSourceWriter):
    """Rows of (path, content): one archive per task that has rows."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = options["path"], options.get("kind", "zip"), overwrite, uuid.uuid4().hex
        if self.kind not in KINDS.values():
            raise ValueError(f"kind of archive is one of {sorted(set(KINDS.values()))}")

    def write(self, rows) -> WriterCommitMessage:
        system, root = open_at(self.path)
        name = f"{self.job}-{uuid.uuid4().hex}.{self.kind}"
        first = next(rows, None)
        if first is None:
            return Written("", "")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_{name}", compression=None) as out:
            self._fill(out, first, rows)
        return Written(f"{root}/_{name}", f"{root}/{name}")

    def _fill(self, out, first, rows) -> None:
        def every():
            yield first
            yield from rows

        if self.kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for row in every():
                    archive.writestr(zipfile.ZipInfo(row.path), bytes(row.content or b""))
        else:
            with tarfile.open(fileobj=out, mode="w|gz") as archive:
                for row in every():
                    info, content = tarfile.TarInfo(row.path), bytes(row.content or b"")
                    info.size = len(content)
                    archive.addfile(info, io.BytesIO(content))

    def commit(self, messages) -> None:
        system, root = open_at(self.path)
        system.create_dir(root, recursive=True)
        written = [m for m in messages if m and m.shown]
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))] if self.overwrite else []
        for m in written:
            system.move(m.hidden, m.shown)
        for path in old:
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, root = open_at(self.path)
        if system.get_file_info(root).is_file is False and system.get_file_info(root).type != fs.FileType.NotFound:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith(f"_{self.job}"):
                    system.delete_file(f.path)


class ArchiveSource(DataSource):
    """Options: ``path``; for reading ``taskBytes`` (small archives share a task up to it), for writing ``kind`` (zip or tar.gz)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, content, error)`` of all zip and tar.gz archives below a folder, told by their first bytes.

    Entries that would leave the archive's folder are dropped. An archive or
    entry that cannot be read is a row with an ``error`` and no content.
    """
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archives").load(path)
    return rows.filter(F.col("error").isNotNull() | ids.is_safe_path(F.coalesce("path", F.lit(""))))


def write(rows: DataFrame, path: str, kind: str = "zip", overwrite: bool = False) -> None:
    """``rows`` of (path, content) as archives in a folder. All become visible together, or none after a failure."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    made = rows.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    made.write.format("archives").option("kind", kind).mode("overwrite" if overwrite else "append").save(path)
