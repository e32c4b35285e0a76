"""Bookmarks and search history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY_LIMIT = 100


def add_bookmarks(bookmarks: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rows whose (term, dictionary) isn't there yet; of new rows with one key the first saved."""
    fresh = new.join(bookmarks.select("term", "dictionary"), ["term", "dictionary"], "left_anti").select(bookmarks.columns)
    first = fresh.groupBy("term", "dictionary").agg(F.min_by(F.struct(*bookmarks.columns), F.struct("saved_at", "id")).alias("b")).select("b.*")
    return bookmarks.unionByName(first)


def remove_bookmark(bookmarks: DataFrame, bookmark_id: str) -> DataFrame:
    return bookmarks.where(F.col("id") != bookmark_id)


def newest_bookmarks(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.orderBy(F.desc("saved_at"), "id")


def with_bookmark_flag(hits: DataFrame, bookmarks: DataFrame) -> DataFrame:
    keys = bookmarks.select("term", "dictionary").distinct().withColumn("bookmarked", F.lit(True))
    return hits.join(keys, ["term", "dictionary"], "left").withColumn("bookmarked", F.coalesce("bookmarked", F.lit(False)))


def history(log: DataFrame, limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """Most recent first, each query once, blanks ignored, of a log (query, ts, ord); without a limit, all."""
    last = log.where(F.trim("query") != "").groupBy("query").agg(F.max(F.struct("ts", "ord")).alias("last"))
    out = last.select("query", F.col("last.ts").alias("ts"), F.col("last.ord").alias("ord")).orderBy(F.desc("ts"), F.desc("ord"))
    return out if limit is None else out.limit(limit)
