"""Table schemas, and adapters that give the driver's tables these shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEXICON = (
    "id string, headword string, headword_reading string, collocate string, full_phrase string, headword_pos string, collocate_pos string, "
    "pattern string, example_sentences array<string>, source string, tags array<string>, notes string, frequency int, created_at bigint, "
    "updated_at bigint, ord bigint"
)
CHUNKS = (
    "id string, surface string, category string, functions array<string>, collocations array<string>, source string, timestamp string, "
    "bits array<string>, notes string, created_at bigint, updated_at bigint, ord bigint"
)
CONTENT = "struct<type: string, text: string, content: string>"
TERMS = (
    f"dictionary string, term string, reading string, "
    f"definitions array<struct<type: string, dictionary: string, tags: array<string>, content: array<{CONTENT}>, sequence: bigint>>, row_ord bigint"
)
KANJI = "dictionary string, character string, onyomi array<string>, kunyomi array<string>, tags array<string>, meanings array<string>, stats map<string,string>, row_ord bigint"
DICT_META = "abbreviation string, ja_title string, en_title string, color string, category string, language string, publisher string"
DICTIONARIES = f"title string, format int, revision string, term_count bigint, imported_at bigint, {DICT_META}"
BITS = "graph_id string, bit_idx int, text string, start_offset int, end_offset int"
EDGES = "graph_id string, edge_ord int, src_idx int, dst_idx int, relationship_type string, confidence double, direction string, bit_distance int, evidence array<string>"


def lexicon_from_part(part: DataFrame) -> DataFrame:
    """Parts as lexicon entries: a name's first word is the headword, the rest its collocate."""
    rest = F.regexp_replace("p_name", r"^[^ ]* ?", "")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.substring_index("p_name", " ", 1).alias("headword"),
        F.lit("").alias("headword_reading"),
        rest.alias("collocate"),
        F.col("p_name").alias("full_phrase"),
        F.col("p_type").alias("headword_pos"),
        F.col("p_brand").alias("collocate_pos"),
        F.concat_ws("+", "p_type", "p_brand").alias("pattern"),
        F.array().cast("array<string>").alias("example_sentences"),
        F.when(F.col("p_partkey") % 3 == 0, "import").otherwise("manual").alias("source"),
        F.array("p_brand", "p_type").alias("tags"),
        F.lit("").alias("notes"),
        F.col("p_size").cast("int").alias("frequency"),
        (F.lit(1_700_000_000_000) + F.col("p_partkey")).alias("created_at"),
        (F.lit(1_700_000_000_000) + F.col("p_partkey") * 7 % 1000).alias("updated_at"),
        F.col("p_partkey").cast("long").alias("ord"),
    )


def terms_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as dictionary terms: a source is a dictionary, a text's first word the term."""
    first = F.regexp_extract("text", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1)
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("content")))
    definition = F.struct(
        F.lit("term").alias("type"),
        F.col("source").alias("dictionary"),
        F.array("lang").alias("tags"),
        content.alias("content"),
        F.col("doc_id").cast("long").alias("sequence"),
    )
    return documents.where("text IS NOT NULL").select(
        F.col("source").alias("dictionary"),
        first.alias("term"),
        F.lower(first).alias("reading"),
        F.array(definition).alias("definitions"),
        F.col("doc_id").cast("long").alias("row_ord"),
    )


def dictionaries_from_documents(documents: DataFrame) -> DataFrame:
    """One dictionary per source; the language follows from the number in its name."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    language = F.when(number % 3 == 0, "en-ja").when(number % 3 == 1, "ja").otherwise("en")
    return (
        documents.where("source IS NOT NULL")
        .groupBy(F.col("source").alias("title"))
        .agg(F.count(F.lit(1)).alias("term_count"), F.first("source").alias("source"))
        .select("title", "term_count", F.substring("title", 1, 8).alias("abbreviation"), language.alias("language"))
    )


def bits_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("string").alias("graph_id"), F.col("text").alias("raw"))


def bits_from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns as bits: graph_id, bit_idx (turns from 0, in order), text, speaker."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return conversations.select(F.col("conv_id").cast("string").alias("graph_id"), nth.cast("int").alias("bit_idx"), "text", F.col("role").alias("speaker"))


def history_from_events(events: DataFrame) -> DataFrame:
    return events.select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("query"), F.col("ts").alias("ts"), F.col("event_id").alias("ord"))
