"""Dictionary banks: zip archives (or name -> JSON rows) of positional arrays to nested rows.

Files come whole (archive, name, body) or in rows (archive, name, at, row), as the data source of
sources.archives reads them: an element of a member's JSON array each.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILES = "archive string, name string, body string"
ROWS = "archive string, name string, at int, row string"
#: Rows of a bank in archives that are written here.
BANK = 10_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, body of the JSON members of all zip archives under a path."""
    return unpack(spark.read.format("binaryFile").load(path))


def unpack(archives: DataFrame) -> DataFrame:
    """archive, name, body of the JSON members of zip archives (path, content)."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        body = None if member.endswith("/") else z.read(member).decode("utf-8", "replace")
                        if body is not None and _is_json(body):
                            yield pd.DataFrame({"archive": [archive], "name": [member], "body": [body]})

    return archives.select("path", "content").mapInPandas(unzip, FILES)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def from_map(spark: SparkSession, files: dict[str, str], archive: str = "") -> DataFrame:
    return spark.createDataFrame([(archive, k, v) for k, v in files.items()], FILES)


def rows_of(files: DataFrame) -> DataFrame:
    """archive, name, at, row: the elements of each file's JSON array, or the file itself, at -1, if it is none."""
    if "row" in files.columns:
        return files
    each = F.coalesce(F.from_json("body", "array<string>"), F.array().cast("array<string>"))
    listed = F.ltrim("body").startswith("[")
    return files.where(listed).select("archive", "name", F.posexplode(each).alias("at", "row")).union(files.where(~listed).select("archive", "name", F.lit(-1), "body"))


def manifests(files: DataFrame) -> DataFrame:
    """archive, title, format, revision of each index.json; archives without one are "unknown"."""
    body = "row" if "row" in files.columns else "body"
    index = F.from_json(body, "title string, format int, revision string")
    found = files.where("name = 'index.json'").select("archive", index.alias("i"))
    known = files.select("archive").distinct().join(found, "archive", "left")
    return known.select("archive", F.coalesce("i.title", F.lit("unknown")).alias("title"), "i.format", "i.revision")


def _bank_rows(files: DataFrame, kind: str) -> DataFrame:
    """title, row_ord, cells (JSON text of each) for the rows of root-level banks, in the
    lexicographic order of the banks' names."""
    rows = rows_of(files.where(F.col("name").rlike(rf"^{kind}_bank_\d+\.json$"))).where("at >= 0")
    rows = rows.join(manifests(files).select("archive", "title"), "archive")
    # a bank's first number follows from the sizes of the banks before it: only these are ordered
    before = W.partitionBy("title").orderBy("name", "archive").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("title", "archive", "name").agg((F.max("at") + 1).alias("n"))
    firsts = sizes.select("archive", "name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    each = rows.join(firsts, ["archive", "name"])
    return each.withColumn("cells", F.from_json("row", "array<string>")).withColumn("row_ord", (F.col("first") + F.col("at")).cast("long"))


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


def _is_text(i: int) -> Column:
    """Whether cell i of the row is a JSON string."""
    return F.expr(f"coalesce(schema_of_variant(try_variant_get(try_parse_json(row), '$[{i}]', 'variant')) = 'STRING', false)")


def _tags(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != "")


def parse_terms(files: DataFrame) -> DataFrame:
    """Term rows (see plans.schemas.TERMS).  Rows with fewer than six cells or without a text as
    term are left out; a reading that is no text is the term; rules and scores aren't kept."""
    rows = _bank_rows(files, "term").where((F.size("cells") >= 6) & _is_text(0))
    items = F.from_json(_cell(5), "array<variant>")
    content = F.transform(
        items,
        lambda x: F.when(F.schema_of_variant(x) == "STRING", _content("text", F.variant_get(x, "$", "string"), None))
        .when(F.schema_of_variant(x).startswith("OBJECT") & (F.try_variant_get(x, "$.type", "string") == "image"), _content("image", None, F.to_json(x)))
        .when(F.schema_of_variant(x).startswith("OBJECT") | F.schema_of_variant(x).startswith("ARRAY"), _content("structured-content", None, F.to_json(x)))
        .otherwise(_content("text", F.coalesce(F.to_json(x), F.lit("null")), None)),
    )
    definition = F.struct(
        F.lit("term").alias("type"),
        F.col("title").alias("dictionary"),
        F.concat(_tags(_cell(2)), F.when(_is_text(7), _tags(_cell(7))).otherwise(F.array().cast("array<string>"))).alias("tags"),
        F.coalesce(content, F.array().cast("array<struct<type:string,text:string,content:string>>")).alias("content"),
        _cell(6).try_cast("long").alias("sequence"),
    )
    return rows.select(
        F.col("title").alias("dictionary"),
        _cell(0).alias("term"),
        F.when(_is_text(1), _cell(1)).otherwise(_cell(0)).alias("reading"),
        F.array(definition).alias("definitions"),
        "row_ord",
    )


def _content(kind: str, text: Column | None, content: Column | None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (null if text is None else text).alias("text"), (null if content is None else content).alias("content"))


def parse_kanji(files: DataFrame) -> DataFrame:
    """Kanji rows (see plans.schemas.KANJI); rows need five cells and a text as character."""
    rows = _bank_rows(files, "kanji").where((F.size("cells") >= 5) & _is_text(0))
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("title").alias("dictionary"),
        _cell(0).alias("character"),
        *[F.when(_is_text(i), _tags(_cell(i))).otherwise(empty).alias(n) for i, n in ((1, "onyomi"), (2, "kunyomi"), (3, "tags"))],
        F.coalesce(F.from_json(_cell(4), "array<string>"), empty).alias("meanings"),
        F.coalesce(F.from_json(_cell(5), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("stats"),
        "row_ord",
    )


# ------------------------------------------------------------------ the other way


def term_cells(terms: DataFrame) -> DataFrame:
    """dictionary, row_ord, row: terms as the positional arrays that banks hold; a term's rules and score are blank."""
    first = F.col("definitions")[0]

    def bare(c: Column) -> Column:
        """A text as JSON: a list of it, without the brackets."""
        listed = F.to_json(F.array(c))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    item = F.transform(first["content"], lambda c: F.when(c["type"] == "text", bare(c["text"])).otherwise(c["content"]))
    cells = [bare(F.col("term")), bare(F.col("reading")), bare(F.array_join(first["tags"], " ")), F.lit('""'), F.lit("0"), F.concat(F.lit("["), F.array_join(item, ","), F.lit("]")), first["sequence"].cast("string"), F.lit('""')]
    return terms.select("dictionary", "row_ord", F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("row"))


def bank_files(cells: DataFrame, kind: str, size: int = BANK) -> DataFrame:
    """archive, name, body: banks of `size` places (dictionary, row_ord, row) each, a dictionary's in the archive of its name."""
    number = F.floor(F.col("row_ord") / size).alias("number")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "row"))), lambda x: x["row"]), ",")
    banks = cells.groupBy(F.col("dictionary").alias("archive"), number).agg(F.concat(F.lit("["), body, F.lit("]")).alias("body"))
    return banks.select("archive", F.concat(F.lit(f"{kind}_bank_"), F.col("number").cast("string"), F.lit(".json")).alias("name"), "body")


def index_files(dictionaries: DataFrame) -> DataFrame:
    """archive, name, body: the index of each title."""
    body = F.to_json(F.struct("title", F.lit(3).alias("format"), F.lit("1").alias("revision")))
    return dictionaries.select(F.col("title").alias("archive"), F.lit("index.json").alias("name"), body.alias("body"))
