"""Dictionaries in files: imports that replace a title as a whole, and lookups that read few files.

A store is a folder.  `data/<version>` holds what one import or compaction wrote: terms sorted by term, the
same terms sorted by reading, and kanji, in files of key ranges.  `commits/<n>.json` names the titles that the
store has, each with its metadata and the version that holds its rows; the newest commit is the store.
An import writes its version first and its commit last, by a rename that fails if the number is
taken, so a failure in between leaves the last commit and all that it names as they were.  An import
touches no file of another title.  `vacuum` deletes versions that no commit names.

Each version has a directory of its files with the least and greatest key, so that lookups by term, prefix or
reading open only files whose range meets theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.commits import Commits, children, filesystem, remove
from ..plans.schemas import DICTIONARIES, KANJI, TERMS
from .dictionary import meta_for_titles, meta_table

_KINDS = {"terms": ("term", TERMS), "readings": ("reading", TERMS), "kanji": ("character", KANJI)}
_DIRECTORY = "kind string, file string, low string, high string, n long"
#: Bytes of a file at most, about, so that files of long rows are written and read by more tasks.
FILE_BYTES = 64_000_000
#: The greatest code point, which ends the range of a prefix.
_LAST = "\U0010ffff"


class DictionaryStore:
    """The dictionaries below a folder that all executors share; `rows_a_file` sets how fine key ranges are."""

    def __init__(self, spark: SparkSession, path: str, rows_a_file: int = 100_000):
        self.spark, self.path, self.rows_a_file = spark, path.rstrip("/"), rows_a_file
        self.commits = Commits(spark, f"{self.path}/commits")

    def state(self, number: int | None = None) -> tuple[int, dict[str, dict]]:
        """(number, title -> version and metadata) of a commit, the newest by default; -1 before the first."""
        return self.commits.read(number)

    # -------------------------------------------------------------- changes

    def _write_version(self, version: str, terms: DataFrame, kanji: DataFrame) -> None:
        """Counting, finding the ranges and writing, twice for terms, read rows that were worked out once."""
        folder = f"{self.path}/data/{version}"
        for kind, rows in (("terms", terms), ("kanji", kanji)):
            rows.select(self.spark.createDataFrame([], _KINDS[kind][1]).columns).write.parquet(f"{folder}/staged/{kind}")
        written = [self._write(version, kind, staged) for kind, staged in (("terms", "terms"), ("readings", "terms"), ("kanji", "kanji"))]
        reduce(DataFrame.unionByName, written).coalesce(1).write.parquet(f"{folder}/files")
        remove(self.spark, f"{folder}/staged")

    def _write(self, version: str, kind: str, staged: str) -> DataFrame:
        """Writes staged rows by ranges of the kind's key; the directory of the files."""
        key, schema = _KINDS[kind]
        where, source = f"{self.path}/data/{version}/{kind}", f"{self.path}/data/{version}/staged/{staged}"
        rows = self.spark.read.schema(schema).parquet(source)
        at, fs = filesystem(self.spark, source)
        files = max(1, -(-rows.count() // self.rows_a_file), -(-fs.getContentSummary(at).getLength() // FILE_BYTES))
        rows.repartitionByRange(files, key, "row_ord").sortWithinPartitions(key, "row_ord").write.parquet(where)
        back = self.spark.read.schema(rows.schema).parquet(where)
        found = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
        return found.select(F.lit(kind).alias("kind"), "file", "low", "high", "n")

    def import_dictionaries(self, terms: DataFrame, kanji: DataFrame, manifests: DataFrame, now_ms: int, before_commit: Callable[[], None] = lambda: None) -> int:
        """Replaces the titles of `manifests` (title, format, revision) by their rows of terms and kanji, all at once, and
        returns the commit's number.  Titles that no one knows get default metadata.  Rows of other titles are left
        out, and titles without rows are there, empty.  `before_commit` runs when all is written but nothing visible."""
        number, titles = self.state()
        version = uuid.uuid4().hex
        named = F.broadcast(manifests.select(F.col("title").alias("dictionary")))  # the commit lists them, so they are few
        self._write_version(version, terms.join(named, "dictionary", "left_semi"), kanji.join(named, "dictionary", "left_semi"))
        counts = self.spark.read.parquet(f"{self.path}/data/{version}/terms").groupBy("dictionary").agg(F.count(F.lit(1)).alias("term_count"))
        meta = meta_for_titles(manifests.select("title"), meta_table(self.spark))
        rows = manifests.join(meta, "title").join(counts.withColumnRenamed("dictionary", "title"), "title", "left")
        fresh = {}
        for r in rows.toLocalIterator():  # titles are what the commit lists, a line each
            fresh[r["title"]] = {"version": version, **r.asDict(), "term_count": r["term_count"] or 0, "imported_at": now_ms}
        before_commit()
        self.commits.write(number + 1, titles | fresh)
        return number + 1

    def delete(self, *titles: str) -> int:
        """Takes titles out, with their terms, kanji and metadata; unknown ones change nothing."""
        number, known = self.state()
        self.commits.write(number + 1, {t: x for t, x in known.items() if t not in titles})
        return number + 1

    def clear(self) -> int:
        return self.delete(*self.state()[1])

    def compact(self) -> int:
        """All titles in one version, with their old metadata."""
        number, titles = self.state()
        terms, kanji = self.table("terms"), self.table("kanji")
        version = uuid.uuid4().hex
        self._write_version(version, terms, kanji)
        self.commits.write(number + 1, {t: x | {"version": version} for t, x in titles.items()})
        return number + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the commits before the last `keep` and the versions that none of the rest names; returns how many versions."""
        numbers = self.commits.numbers()
        for number in numbers[:-keep]:
            remove(self.spark, self.commits.path(number))
        named = {x["version"] for number in numbers[-keep:] for x in self.state(number)[1].values()}
        gone = [version for version in children(self.spark, f"{self.path}/data") if version not in named]
        for version in gone:
            remove(self.spark, f"{self.path}/data/{version}")
        return len(gone)

    # -------------------------------------------------------------- reading

    def dictionaries(self) -> DataFrame:
        """The titles with their metadata."""
        columns = [c.split()[0] for c in DICTIONARIES.split(", ")]
        return self.spark.createDataFrame([tuple(x.get(c) for c in columns) for x in self.state()[1].values()], DICTIONARIES)

    def _live(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for title, x in self.state()[1].items():
            out.setdefault(x["version"], []).append(title)
        return out

    def _read(self, kind: str, files: dict[str, list[str]] | None) -> DataFrame:
        schema, parts = _KINDS[kind][1], []
        for version, titles in self._live().items():
            where = f"{self.path}/data/{version}/{kind}"
            paths = [where] if files is None else [f"{where}/{f}" for f in files.get(version, ())]
            if paths:
                rows = self.spark.read.schema(schema).parquet(*paths)
                live = self.spark.createDataFrame([(t,) for t in titles], "dictionary string")
                parts.append(rows.join(F.broadcast(live), "dictionary", "left_semi") if len(titles) > 1 else rows.where(F.col("dictionary") == titles[0]))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def table(self, kind: str = "terms") -> DataFrame:
        """All rows of terms or kanji."""
        return self._read(kind, None)

    def files(self, kind: str, low: str, high: str) -> dict[str, list[str]]:
        """version -> the files that may have keys from low to high."""
        out: dict[str, list[str]] = {}
        for version in self._live():
            met = self.spark.read.schema(_DIRECTORY).parquet(f"{self.path}/data/{version}/files").where((F.col("kind") == kind) & (F.col("low") <= high) & (F.col("high") >= low))
            out[version] = [r["file"] for r in met.select("file").collect()]
        return out

    def lookup(self, kind: str, key: str) -> DataFrame:
        """Rows whose term ("terms"), reading ("readings") or character ("kanji") is the key."""
        return self._read(kind, self.files(kind, key, key)).where(F.col(_KINDS[kind][0]) == key)

    def prefix(self, kind: str, prefix: str, limit: int | None = None) -> DataFrame:
        """Rows whose key starts with the prefix, the first `limit` in key order."""
        key = _KINDS[kind][0]
        rows = self._read(kind, self.files(kind, prefix, prefix + _LAST)).where(F.col(key).startswith(prefix)).orderBy(key, "row_ord")
        return rows if limit is None else rows.limit(limit)
