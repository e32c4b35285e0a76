"""Dictionary store and search: terms of many dictionaries, their metadata, ranked lookup."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..plans import known_dictionaries
from ..plans.schemas import DICT_META

#: Result caps, scores, shelf order, circled numbers.
LIMIT, SUGGEST_LIMIT, VIEW_LIMIT = 50, 10, 80
EQUAL, EQUAL_READING, PREFIX, PREFIX_READING, WITHIN, WITHIN_READING, IN_TEXT = 100, 95, 80, 75, 60, 55, 40
CATEGORY_ORDER = ("国語辞典", "漢和辞典", "古語辞典", "類語辞典", "アクセント", "漢字", "専門用語", "英和・和英")
DEFAULT_CATEGORY, DEFAULT_LANGUAGE, DEFAULT_COLOR = "専門用語", "ja", "#6B7280"
BILINGUAL = ("en-ja", "ja-en")
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


@dataclass(frozen=True)
class DictionaryOptions:
    query: str
    mode: str = "all"  # all, monolingual, bilingual
    dictionaries: tuple[str, ...] = ()
    max_results: int = LIMIT
    #: The per-scan limit before the filters, which can leave a restricted search short of rows.
    compat_scan_limit: bool = False


def is_english_query(query: str) -> bool:
    return bool(re.search("[a-zA-Z]", query)) and not re.search("[぀-ヿ一-鿿＀-￯]", query)


def english_query(c: Column) -> Column:
    """The same for a column of queries."""
    return c.rlike("[a-zA-Z]") & ~c.rlike("[぀-ヿ一-鿿＀-￯]")


def normal_text(text: str) -> str:
    return unicodedata.normalize("NFKC", text.lower().strip())


def lookup_term(terms: DataFrame, term: str) -> DataFrame:
    return terms.where(F.col("term") == term)


def lookup_reading(terms: DataFrame, reading: str) -> DataFrame:
    return terms.where(F.col("reading") == reading)


def lookup_kanji(kanji: DataFrame, character: str) -> DataFrame:
    return kanji.where(F.col("character") == character)


def prefix_search(terms: DataFrame, prefix: str, limit: int, column: str = "term") -> DataFrame:
    """The first rows in key order whose key starts with the prefix."""
    return terms.where(F.col(column).startswith(prefix)).orderBy(column, "row_ord").limit(limit)


def visible(terms: DataFrame, dictionaries: DataFrame, options: DictionaryOptions) -> DataFrame:
    """Terms of imported dictionaries that the options allow, with `language` and the other metadata.

    monolingual means not bilingual.  The dictionaries table is a dimension; Spark decides
    by its size whether to broadcast it.
    """
    shown = dictionaries
    if options.dictionaries:
        shown = shown.where(F.col("title").isin(*options.dictionaries))
        terms = terms.where(F.col("dictionary").isin(*options.dictionaries))
    bilingual = F.col("language").isin(*BILINGUAL)
    if options.mode != "all":
        shown = shown.where(bilingual if options.mode == "bilingual" else ~bilingual)
    return terms.join(shown.withColumnRenamed("title", "dictionary"), "dictionary")


def term_score(query: str, ascii_only: bool = False) -> Column:
    """Equal, prefix or containment of the normal forms of term and reading; for English
    queries also of the definitions' texts."""
    wanted = normal_text(query)
    form = (lambda c: T.trim(F.lower(c))) if ascii_only else (lambda c: T.normalize_japanese(T.trim(F.lower(c))))
    term, reading = form(F.col("term")), form(F.coalesce("reading", F.lit("")))
    out = (
        F.when(term == wanted, EQUAL)
        .when(reading == wanted, EQUAL_READING)
        .when(term.startswith(wanted), PREFIX)
        .when(reading.startswith(wanted), PREFIX_READING)
        .when(term.contains(wanted), WITHIN)
        .when(reading.contains(wanted), WITHIN_READING)
    )
    if is_english_query(query):
        texts = F.filter(F.flatten(F.transform("definitions", lambda d: d["content"])), lambda c: c["type"] == "text")
        whole = F.array_join(F.transform(texts, lambda c: F.trim(F.lower(F.coalesce(c["text"], F.lit(""))))), " ")
        out = out.when(whole.contains(wanted), IN_TEXT)
    return out.otherwise(0)


def search(terms: DataFrame, dictionaries: DataFrame, options: DictionaryOptions) -> DataFrame:
    """Exact and prefix hits on term and reading, once per (dictionary, term, reading), monolingual
    dictionaries first, then by score.  One scan with a disjunction; each row's source rank
    (exact, term, reading) keeps the order in which three scans would have found it."""
    query = options.query
    if not query.strip():
        return visible(terms, dictionaries, options).withColumn("score", F.lit(0)).limit(0)
    by_term, by_reading = F.col("term").startswith(query), F.col("reading").startswith(query)
    exact = F.lit(False) if is_english_query(query) else F.col("term") == query
    rank = F.when(exact, 0).when(by_term, 1).otherwise(2)
    if options.compat_scan_limit:
        n = 2 * options.max_results
        scans = [prefix_search(terms, query, n).withColumn("rank", F.lit(1)), prefix_search(terms, query, n, "reading").withColumn("rank", F.lit(2))]
        if not is_english_query(query):
            scans.append(lookup_term(terms, query).withColumn("rank", F.lit(0)))
        hits = visible(reduce(DataFrame.unionByName, scans), dictionaries, options)
    else:
        hits = visible(terms.where(by_term | by_reading), dictionaries, options).withColumn("rank", rank)
    key = F.when(F.col("rank") == 2, F.col("reading")).otherwise(F.col("term"))
    first = W.partitionBy("dictionary", "term", "reading").orderBy("rank", "row_ord")
    once = hits.withColumn("dup", F.row_number().over(first)).where("dup = 1").drop("dup")
    scored = once.withColumn("score", term_score(query)).withColumn("key", key)
    bilingual = F.coalesce(F.col("language").isin(*BILINGUAL), F.lit(False))
    return scored.orderBy(bilingual, F.desc("score"), "rank", "key", "row_ord").limit(options.max_results).drop("rank", "key")


def suggest(terms: DataFrame, dictionaries: DataFrame, query: str, max_results: int = SUGGEST_LIMIT) -> DataFrame:
    return search(terms, dictionaries, DictionaryOptions(query, max_results=max_results))


# ------------------------------------------------------------------ metadata

def meta_table(spark: SparkSession, more: tuple = ()) -> DataFrame:
    rows = [(*row, i) for i, row in enumerate((*known_dictionaries.ROWS, *more))]
    return spark.createDataFrame(rows, f"{DICT_META}, ord long")


def meta_by_abbreviation(meta: DataFrame, abbreviation: str) -> DataFrame:
    return meta.where(F.lower("abbreviation") == abbreviation.lower()).orderBy("ord").limit(1)


def meta_for_abbreviations(asked: DataFrame, meta: DataFrame, column: str = "abbreviation") -> DataFrame:
    """Rows of `asked` with the first registry row of that abbreviation, whatever its case; unknown ones have none."""
    first = meta.groupBy(F.lower("abbreviation").alias("key_")).agg(F.min_by(F.struct(*[c for c in meta.columns if c not in ("ord", column)]), "ord").alias("m"))
    return asked.join(first, F.lower(column) == F.col("key_")).select(asked["*"], "m.*")


def meta_for_titles(titles: DataFrame, meta: DataFrame) -> DataFrame:
    """title with the first registry row that fits: the abbreviation equals it or lies in it, a
    title contains it, or it contains the English title's first word.  The registry is a short
    list of fixed rows, so it is broadcast; titles without a row get default metadata."""
    t = F.lower("title")
    abbreviation, ja, en = F.lower("abbreviation"), F.lower("ja_title"), F.lower(F.coalesce("en_title", F.lit("")))
    fits = (abbreviation == t) | ja.contains(t) | t.contains(abbreviation)
    fits = fits | ((en != "") & (en.contains(t) | t.contains(F.substring_index(en, " ", 1))))
    pairs = titles.select("title").join(F.broadcast(meta), fits, "left")
    columns = ("abbreviation", "ja_title", "en_title", "color", "category", "language", "publisher")
    best = pairs.groupBy("title").agg(F.min_by(F.struct(*columns), "ord").alias("m"))
    return best.select(
        "title",
        F.coalesce("m.abbreviation", F.substring("title", 1, 8)).alias("abbreviation"),
        F.coalesce("m.ja_title", "title").alias("ja_title"),
        "m.en_title",
        F.coalesce("m.color", F.lit(DEFAULT_COLOR)).alias("color"),
        F.coalesce("m.category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("m.language", F.lit(DEFAULT_LANGUAGE)).alias("language"),
        "m.publisher",
    )


def shelf(dictionaries: DataFrame) -> DataFrame:
    """category, titles by shelf order; categories without a dictionary are left out."""
    order = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    titles = F.array_sort(F.collect_list("title"))
    return dictionaries.where(order > 0).groupBy("category", order.cast("int").alias("shelf")).agg(titles.alias("titles"))


def tile(dictionaries: DataFrame) -> DataFrame:
    """title, badge, label as a shelf tile shows them."""
    bilingual = F.col("language").isin(*BILINGUAL)
    long = F.concat(F.substring("ja_title", 1, 11), F.lit("…"))
    shown = F.when(bilingual & F.col("en_title").isNotNull(), F.col("abbreviation")).when(F.length("ja_title") > 12, long).otherwise(F.col("ja_title"))
    return dictionaries.select("title", F.when(bilingual, F.col("abbreviation")).otherwise(F.substring("ja_title", 1, 1)).alias("badge"), shown.alias("label"))


# ------------------------------------------------------------------ results


def grouped_results(hits: DataFrame, span: int | None = None) -> DataFrame:
    """dictionary, its place among the groups (by its best hit), its terms in order of rank;
    `hits` carries `rank`, the order of the results.

    With `span`, a dictionary's terms come in rows (dictionary, part, ..) of the ranks part * span up
    to the next, so that no row and no task grows with a large dictionary.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    by = ["dictionary"] if span is None else ["dictionary", F.floor(F.col("rank") / span).alias("part")]
    return hits.groupBy(*by).agg(F.min("rank").alias("first_rank"), listed.alias("terms"))


def sense_number(n: Column) -> Column:
    return F.when(n <= len(CIRCLED), F.substring(F.lit(CIRCLED), n, F.lit(1))).otherwise(F.concat(F.lit("("), n.cast("string"), F.lit(")")))


def senses(terms: DataFrame) -> DataFrame:
    """dictionary, term, row_ord, sense_no, label, type, text, is_example: every shown content item.
    Images take a number but aren't shown."""
    items = terms.select("dictionary", "term", "row_ord", F.posexplode(F.flatten(F.transform("definitions", lambda d: d["content"]))).alias("at", "item"))
    number = F.col("at") + 1
    return items.where("item.type <> 'image'").select(
        "dictionary", "term", "row_ord", number.alias("sense_no"), sense_number(number).alias("label"), "item.type", "item.text", F.col("item.text").rlike(r"▶|e\.g\.|例:").alias("is_example")
    )


def flatten_content(node) -> str:
    """The text of nested structured content (parsed JSON), in reading order."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(map(flatten_content, node))
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "structured-content" or node.get("tag"):
        inner = node.get("content")
        own = node.get("text") if node.get("tag") and isinstance(node.get("text"), str) else ""
        return (flatten_content(inner) if isinstance(inner, (str, list)) else "") + own
    text = node.get("text", node.get("data"))
    return text if isinstance(text, str) else ""


@F.pandas_udf(StringType())
def content_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """flatten_content of JSON texts: recursion of any depth, which columns can't express."""
    import json

    for s in batches:
        yield s.map(lambda x: flatten_content(json.loads(x)), na_action="ignore")


# ------------------------------------------------------------------ store


def import_dictionary(terms: DataFrame, dictionaries: DataFrame, new_terms: DataFrame, new_row: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces a dictionary: rows of the titles in `new_row` go, the new ones come."""
    titles = new_row.select(F.col("title").alias("dictionary"))
    kept = terms.join(titles, "dictionary", "left_anti").select(terms.columns)
    others = dictionaries.join(new_row.select("title"), "title", "left_anti").select(dictionaries.columns)
    return kept.unionByName(new_terms.select(terms.columns)), others.unionByName(new_row.select(dictionaries.columns))


def delete_dictionary(terms: DataFrame, kanji: DataFrame, dictionaries: DataFrame, title: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a title."""
    return terms.where(F.col("dictionary") != title), kanji.where(F.col("dictionary") != title), dictionaries.where(F.col("title") != title)
