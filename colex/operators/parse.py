"""Collocation candidates in running text, bits of marked text, and rows of scraped pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SPACE_SET, trim

_W = f"[^{SPACE_SET}。、！？]{{1,8}}"
#: Pattern names, expressions, the group that is the collocate.  The bracketed
#: lists are sets of characters.
CANDIDATES = (
    ("N+V", rf"({_W})(を|が|に|で|と)({_W}[うくぐすつぬぶむる])", 3),
    ("N+Adj", rf"({_W})(が|は|も)({_W}[いかった])", 3),
    ("V+N", rf"({_W}[てでいき])({_W}[名詞])", 2),
    ("A+N", rf"({_W}[いなな])({_W})", 2),
)


def parse_collocations(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, nth, headword, collocate, full_phrase, pattern: every candidate pair once per row
    of df, where the earlier pattern and the earlier match win.  Rows are dealt out by key before their texts are matched,
    which is what both windows ask for: short texts are few bytes, which a scan reads in a task or two, and much work."""

    def matches(name: str, regex: str, last: int, rank: int) -> Column:
        whole = F.regexp_extract_all(F.col(column), F.lit(regex), F.lit(0))
        # without anchors and look-around, an expression takes the same way through its own match as through the text
        groups = lambda x: [F.regexp_extract(x, regex, i).alias(n) for i, n in ((1, "headword"), (last, "collocate"))]
        zipped = F.transform(whole, lambda x: F.struct(*groups(x), x.alias("full_phrase")))
        return F.transform(
            zipped,
            lambda x, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("pos"), x["headword"].alias("headword"), x["collocate"].alias("collocate"),
                x["full_phrase"].alias("full_phrase"), F.lit(name).alias("pattern"),
            ),
        )

    found = F.concat(*[matches(n, r, g, i) for i, (n, r, g) in enumerate(CANDIDATES)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(parts, key).select(key, F.explode(found).alias("m")).select(key, "m.*")
    first = W.partitionBy(key, "headword", "collocate").orderBy("rank", "pos")
    kept = rows.withColumn("dup", F.row_number().over(first)).where("dup = 1")
    nth = F.row_number().over(W.partitionBy(key).orderBy("rank", "pos"))
    return kept.select(key, nth.alias("nth"), "headword", "collocate", "full_phrase", "pattern")


def extract_bits(text: Column, separator: str = r"\|\|") -> Column:
    """Trimmed non-blank parts between separators."""
    return F.filter(F.transform(F.split(text, separator), trim), lambda x: x != "")


# ------------------------------------------------------------------ page rows

#: The source of scraped entries; section labels, of which the first that a row contains decides.
PAGE_SOURCE = "hyogen.info"
SECTIONS = ("名詞", "動詞", "い形容詞", "な形容詞", "副詞")


def strip_tags(c: Column) -> Column:
    """Without tags, with the four named references decoded, & last, and trimmed.  One pass is
    enough: what is left has no < before a >."""
    bare = F.regexp_replace(c, "<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return trim(bare)


def page_rows(pages: DataFrame, row_tag: str = "tr", cell_tag: str = "td") -> DataFrame:
    """page_id, row_no, section, cells for every row element of a page; sections carry forward."""
    rows = F.regexp_extract_all("html", F.lit(rf"(?is)<{row_tag}[^>]*>.*?</{row_tag}>"), F.lit(0))

    def label(row: Column) -> Column:
        return reduce(lambda c, s: c.when(row.contains(s), s), SECTIONS[1:], F.when(row.contains(SECTIONS[0]), SECTIONS[0]))

    # a page is cut where a row names a section, so that sections need no look back over the rows
    named = F.filter(F.transform("rows", lambda r, i: F.struct(i.alias("at"), label(r).alias("section"))), lambda x: x["section"].isNotNull())
    first = F.array(F.struct(F.lit(0).alias("at"), F.lit(SECTIONS[0]).alias("section")))
    cuts = pages.select("page_id", rows.alias("rows")).withColumn("cuts", F.concat(first, named))
    ends = cuts.withColumn("parts", F.transform("cuts", lambda c, i: F.struct(c["at"].alias("at"), c["section"].alias("section"), F.coalesce(F.get("cuts", i + 1)["at"], F.size("rows")).alias("end"))))
    part = ends.select("page_id", "rows", F.explode("parts").alias("p")).where("p.end > p.at").select("page_id", "p.at", "p.section", F.expr("slice(rows, p.at + 1, p.end - p.at)").alias("rows"))
    each = part.select("page_id", "at", "section", F.posexplode("rows").alias("nth", "row")).withColumn("row_no", F.col("at") + F.col("nth"))
    cells = F.regexp_extract_all("row", F.lit(rf"(?is)<{cell_tag}[^>]*>.*?</{cell_tag}>"), F.lit(0))
    return each.select("page_id", "row_no", "section", F.transform(cells, lambda c: strip_tags(c)).alias("cells"))


def reading_of(html: Column) -> Column:
    first = F.regexp_extract(html, r"読み[：:\s　]*<[^>]*>([ぁ-ん]+)</[^>]*>", 1)
    second = F.regexp_extract(html, r"(?i)reading['\"]\s*[：:]\s*['\"]?([ぁ-ん]+)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), second)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Lexicon entries of pages (page_id, headword, html): one per row with two or more cells."""
    heads = pages.select("page_id", "headword", reading_of(F.col("html")).alias("headword_reading"))
    rows = page_rows(pages).where((F.size("cells") >= 2) & (F.col("cells")[0] != ""))
    collocate, example = F.col("cells")[0], F.col("cells")[1]
    pattern = F.concat(F.lit("N+"), F.substring(collocate, 1, 1), F.when(F.col("section") == "動詞", "+V").otherwise("+Adj"))
    return rows.join(heads, "page_id").select(
        "page_id",
        "row_no",
        "headword",
        "headword_reading",
        collocate.alias("collocate"),
        F.concat("headword", collocate).alias("full_phrase"),
        F.lit("名詞").alias("headword_pos"),
        F.col("section").alias("collocate_pos"),
        pattern.alias("pattern"),
        F.when(example == "", F.array().cast("array<string>")).otherwise(F.array(example)).alias("example_sentences"),
        F.lit(PAGE_SOURCE).alias("source"),
        F.lit(50).alias("frequency"),
    )
