"""Pages as the source of scraped entries: a queue of words joined with fetched pages.

Fetching over a network is not part of this engine; pages come as a table (word, page_id, html).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.parse import parse_pages


def work_queue(words: DataFrame) -> DataFrame:
    """ord, word: trimmed, blanks dropped, each word once at its first place."""
    clean = words.select("ord", F.trim("word").alias("word")).where("word <> ''")
    return clean.groupBy("word").agg(F.min("ord").alias("ord")).select("ord", "word")


def scrape(words: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, words without a page): a missing page stops nothing but its own word."""
    queue = work_queue(words)
    found = queue.join(pages, "word")
    entries = parse_pages(found.select("page_id", F.col("word").alias("headword"), "html"))
    nth = F.row_number().over(W.partitionBy("page_id").orderBy("row_no"))
    return entries.withColumn("nth", nth), queue.join(pages, "word", "left_anti")
