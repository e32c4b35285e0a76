"""Zip archives of JSON members as a data source: a partition for each member, or for small ones together.

The driver reads the central directories, which name the members and where they are.  A task reads
and inflates its own members only, one after another, and gives an element of a member's array as a row, so
its memory is bounded by a member, however large the archive is.  Paths are those of pyarrow's file systems (local or
mounted, s3, gs, hdfs); archives that only Spark can read go through dictionary_bank.read_archives.
"""

from __future__ import annotations

import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .dictionary_bank import ROWS

#: The fixed part of a member's own header, where the lengths of its name and extra field stand in it, and how members are packed.
_HEADER, _LENGTHS, _STORED, _DEFLATED = 30, 26, 0, 8
NAME = "json_zip"
#: Packed bytes up to which members share a task; a larger one has its own.
SPLIT = 4_000_000


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[str]:
    system, at = _filesystem(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".zip"))


@dataclass
class Member:
    archive: str
    name: str
    start: int
    packed: int
    method: int

    def read(self, path: str) -> bytes:
        system, _ = _filesystem(path)
        with system.open_input_file(self.archive) as f:
            f.seek(self.start)
            head = f.read(_HEADER)
            f.seek(self.start + _HEADER + sum(struct.unpack_from("<HH", head, _LENGTHS)))
            body = f.read(self.packed)
        return body if self.method == _STORED else zlib.decompress(body, -zlib.MAX_WBITS)


@dataclass
class Members(InputPartition):
    members: list[Member]


def elements(text: str) -> Iterator[tuple[int, str]]:
    """(at, JSON text) of an array's elements, or (-1, the text) of other JSON; nothing of what isn't JSON."""
    try:
        value = json.loads(text)
    except ValueError:
        return
    if not isinstance(value, list):
        yield -1, text
        return
    for at, x in enumerate(value):
        yield at, json.dumps(x, ensure_ascii=False, separators=(",", ":"))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split

    def partitions(self) -> list[Members]:
        parts, size = [], 0
        for member in self.members():
            size += member.packed
            if not parts or size > self.split:
                parts.append(Members([]))
                size = member.packed
            parts[-1].members.append(member)
        return parts or [Members([])]

    def members(self) -> list[Member]:
        system, _ = _filesystem(self.path)
        out = []
        for archive in _archives(self.path):
            with system.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                for x in z.infolist():
                    if not x.is_dir():
                        if x.compress_type not in (_STORED, _DEFLATED):
                            raise ValueError(f"{archive}: {x.filename} is packed by method {x.compress_type}")
                        out.append(Member(archive, x.filename, x.header_offset, x.compress_size, x.compress_type))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        for member in partition.members:
            for at, row in elements(member.read(self.path).decode("utf-8", "replace")):
                yield member.archive, member.name, at, row


class ArchiveSource(DataSource):
    """spark.read.format("json_zip").load(path): archive, name, at, row; the option "split" sets SPLIT."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_rows(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """archive, name, at, row of all members of the zip archives at or below a path."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("split", split).load(path)


def write_archives(files: DataFrame, path: str) -> int:
    """Writes (archive, name, body) as a zip archive for each `archive` below the path, and returns how many.

    Members come sorted and are packed one by one, so a task holds one of them.  An archive gets its name when
    it is whole; a task that runs again writes it again.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _filesystem(path)
        system.create_dir(at, recursive=True)
        done, now, out, z = [], None, None, None

        def close() -> None:
            z.close()
            out.close()
            system.move(f"{at}/{now}.part", f"{at}/{now}.zip")
            done.append(now)

        for batch in batches:
            for archive, name, body in zip(batch["archive"], batch["name"], batch["body"], strict=True):
                if archive != now:
                    if z is not None:
                        close()
                    now, out = archive, system.open_output_stream(f"{at}/{archive}.part")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(name, body)
        if z is not None:
            close()
        yield pd.DataFrame({"archive": done})

    placed = files.select("archive", "name", "body").repartition("archive").sortWithinPartitions("archive", "name")
    return placed.mapInPandas(work, "archive string").count()
