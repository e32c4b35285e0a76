"""Numbered commits in a folder: small JSON documents that say what a store consists of.

A commit appears as a whole or not at all: it is written under another name and renamed, and a
number that is taken stays as it is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer took the number first."""


def filesystem(spark: SparkSession, path: str):
    """The path for Hadoop, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    at, fs = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = filesystem(spark, path)
    fs.delete(at, True)


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return [int(name[:-5]) for name in children(self.spark, self.folder) if name.endswith(".json") and not name.startswith(".")]

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """(number, content), the newest by default; -1 and nothing before the first."""
        if number is None:
            number = max(self.numbers(), default=-1)
        if number < 0:
            return -1, {}
        return number, json.loads(self.spark.read.text(self.path(number), wholetext=True).first()[0])

    def write(self, number: int, content: dict) -> None:
        draft, fs = filesystem(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        final, _ = filesystem(self.spark, self.path(number))
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"commit {number} is taken")
