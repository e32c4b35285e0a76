"""Reading and writing lexicons, chunks and the small library tables as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.schemas import CHUNKS, LEXICON

#: A few entries to start with; a fuller seed is a parameter (a path to lexicon JSON).
SEED = (
    ("s001", "風", "かぜ", "が吹く", "風が吹く", "名詞", "動詞", "N+が+V", 95, ("自然", "天気")),
    ("s002", "雨", "あめ", "が降る", "雨が降る", "名詞", "動詞", "N+が+V", 98, ("自然", "天気")),
    ("s004", "夢", "ゆめ", "を見る", "夢を見る", "名詞", "動詞", "N+を+V", 92, ("心理",)),
    ("s010", "目", "め", "を閉じる", "目を閉じる", "名詞", "動詞", "N+を+V", 87, ("身体",)),
    ("s011", "目", "め", "を開ける", "目を開ける", "名詞", "動詞", "N+を+V", 87, ("身体",)),
)
SEED_TIME = 1_700_000_000_000


def seed(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The seed lexicon: the caller's, or the few built-in rows."""
    if path:
        return read_lexicon(spark, path)
    rows = [(i, h, r, c, p, hp, cp, pat, [], "hyogen.info", list(tags), "", f, SEED_TIME, SEED_TIME, n) for n, (i, h, r, c, p, hp, cp, pat, f, tags) in enumerate(SEED)]
    return spark.createDataFrame(rows, LEXICON)


def _other_name(column: str) -> str:
    """The name of a column in files of note-taking tools: headword_pos is headwordPOS there."""
    first, *rest = column.split("_")
    return first + "".join(x.upper() if x == "pos" else x.capitalize() for x in rest)


def _placed(df: DataFrame) -> DataFrame:
    """Gives rows without `ord` their place in the files, by file name and then by line, however Spark cuts the
    files: rows are numbered within their split, and splits start where those before them end."""
    split = ["file_", "block_"]
    rows = df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"))
    rows = rows.withColumn("nth_", F.row_number().over(W.partitionBy(*split).orderBy("at_")))
    before = F.coalesce(F.sum("n_").over(W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("n_")).select(*split, before.alias("before_"))  # a row a split
    place = F.col("before_") + F.col("nth_") - 1
    return rows.join(starts, split).withColumn("ord", F.coalesce("ord", place)).drop(*split, "at_", "nth_", "before_")


def _elements(lines: DataFrame, kinds: str) -> DataFrame | None:
    """The elements of arrays that have each on a line of its own and their places (`ord`), as export_json writes them: such
    files are read in splits.  None if a line is anything else, for then only the file as a whole is JSON."""
    body = F.regexp_replace("value", r"^[\[,]", "")
    one = body.startswith("{") & (F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1)
    start, close = one & F.col("value").startswith("["), F.col("value") == "]"
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    seen = lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), start.alias("start"), close.alias("close"), (one & F.col("value").startswith(",")).alias("more"))
    files = seen.groupBy("file").agg(
        F.count_if("start").alias("starts"), F.count_if("close").alias("closes"), F.count_if(~F.coalesce(F.col("start") | F.col("close") | F.col("more"), F.lit(False))).alias("others"),
        F.min(F.when(F.col("start"), F.col("at"))).alias("start"), F.min("at").alias("first"), F.max(F.when(F.col("close"), F.col("at"))).alias("close"), F.max("at").alias("last"),
    )
    if files.where("NOT (starts = 1 AND closes = 1 AND others = 0 AND start = first AND close = last) IS TRUE").head(1):
        return None
    rows = lines.where(~close).select(F.from_json(body, kinds, {"columnNameOfCorruptRecord": "_corrupt"}).alias("row")).select("row.*")
    return None if rows.where("_corrupt IS NULL AND ord IS NULL").head(1) else rows


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines under a fixed schema, in either naming; `ord` is the place
    in the file(s).  Broken records are left out."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    both = [*fields, *((_other_name(n), t) for n, t in fields if "_" in n), ("_corrupt", "string")]
    kinds = ", ".join(f"{n} {t}" for n, t in both)
    lines = spark.read.text(path)
    line = lines.where("trim(value) <> ''").head()
    array = bool(line and line[0].lstrip().startswith("["))
    df = _elements(lines, kinds) if array else None
    if df is None:
        df = spark.read.schema(kinds).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", array).json(path)
    # Spark reads no JSON for the corrupt records alone, so the filter looks at another column as well
    df = df.where(F.col("_corrupt").isNull() & (F.length(F.coalesce("id", F.lit(""))) >= 0))
    if df.where("ord IS NULL").head(1):
        df = _placed(df)
    return df.select(*[F.coalesce(n, _other_name(n)).alias(n) if "_" in n else F.col(n) for n, _ in fields])


def read_lexicon(spark: SparkSession, path: str, on_error: str = "raise", seed_path: str | None = None) -> DataFrame:
    """A lexicon; with on_error="seed" a missing file gives the seed instead of an error."""
    try:
        return _read(spark, path, LEXICON)
    except AnalysisException:
        if on_error != "seed":
            raise
        return seed(spark, seed_path)


def read_chunks(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    try:
        return _read(spark, path, CHUNKS)
    except AnalysisException:
        if on_error != "empty":
            raise
        return spark.createDataFrame([], CHUNKS)


def write_json(df: DataFrame, path: str) -> None:
    """A snapshot as JSON lines in insertion order, in as many files as there are range partitions."""
    (df.orderBy("ord") if "ord" in df.columns else df).write.mode("overwrite").json(path)


def export_json(df: DataFrame, path: str) -> None:
    """A snapshot as one file that holds one JSON array, in insertion order, for programs that read a document as a
    whole.  One task streams it, row by row."""

    def array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            lines = []
            for row in batch["value"]:
                lines.append(("[" if first else "," if row else "") + (row or "]"))
                first = False
            yield pd.DataFrame({"value": lines})

    place = F.col("ord") if "ord" in df.columns else F.lit(0)
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"), place.cast("long").alias("place"), F.lit(False).alias("last"))
    end = df.sparkSession.createDataFrame([(None, None, True)], "value string, place long, last boolean")  # closes the array, an empty one too
    rows.union(end).repartition(1).sortWithinPartitions("last", "place").select("value").mapInPandas(array, "value string").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
