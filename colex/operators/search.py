"""Lexicon search: filters, query expansion, best-of-fields scoring, ordering, limit.

The query is a scalar, so its terms are worked out on the driver and become literals; the
table side is one lazy plan that ends in TakeOrderedAndProject.  Filters come first and
reach the scan; edit distances are computed only where they can still raise a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Scores, thresholds and result caps.
WILDCARD, CONTAINS, BOOST, CONTAINS_KANA = 90, 80, 20, 75
WHOLE_OVER, WHOLE_WEIGHT = 0.5, 60
WINDOW_OVER, WINDOW_WEIGHT = 0.7, 65
DEFAULT_LIMIT, QUICK_LIMIT = 100, 20


@dataclass(frozen=True)
class SearchOptions:
    query: str = ""
    pos: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    pattern: str = ""
    fuzzy: bool = True
    max_results: int | None = DEFAULT_LIMIT
    sort_by: str = "frequency"
    sort_dir: str = "desc"


@dataclass(frozen=True)
class QueryTerms:
    """What a query becomes: its three forms, all terms to look for, its wildcard expression."""

    normalised: str
    hiragana: str
    romaji: str
    terms: tuple[str, ...] = field(default=())
    wildcard: str | None = None


def query_terms(query: str) -> QueryTerms:
    """Width- and case-preserving normal form, its hiragana, and the kana of a romaji query.

    Conjugations are added for the first two.  In a wildcard query * is any text and ? any
    character; all other characters stand for themselves.
    """
    normal = unicodedata.normalize("NFKC", query.strip())
    kana = normal.translate(str.maketrans(T.KATAKANA, T.HIRAGANA))
    japanese = re.search(r"[　-鿿＀-￯]", normal)
    romaji = kana if japanese or not normal else T.romaji_to_hiragana_text(normal)
    terms = dict.fromkeys([normal, kana, romaji, *T.expand_search_text(normal), *T.expand_search_text(kana)])
    wildcard = None
    if "*" in normal or "?" in normal:
        parts = {"*": ".*", "?": "."}
        wildcard = r"(?iu)\A" + "".join(parts.get(ch) or (rf"\{ch}" if ch in r"\.[]{}()^$+|" else ch) for ch in normal) + r"\z"
    return QueryTerms(normal, kana, romaji, tuple(t for t in terms if t), wildcard)


def filtered(lexicon: DataFrame, o: SearchOptions) -> DataFrame:
    if o.pos:
        lexicon = lexicon.where(F.col("headword_pos").isin(*o.pos) | F.col("collocate_pos").isin(*o.pos))
    if o.tags:
        lexicon = lexicon.where(F.arrays_overlap("tags", F.array(*map(F.lit, o.tags))))
    if o.sources:
        lexicon = lexicon.where(F.col("source").isin(*o.sources))
    if o.pattern:
        lexicon = lexicon.where(F.col("pattern").contains(o.pattern))
    return lexicon


def spread(lexicon: DataFrame) -> DataFrame:
    """Entries dealt out over the cluster: they are few bytes, which a scan reads in a task or two, and much work."""
    return lexicon.repartition(int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "ord")


def with_fields(lexicon: DataFrame) -> DataFrame:
    """Adds `fields`: (raw, norm) of every non-empty field.  Texts that are plain ASCII are their
    own normal form: Python gets a null for such rows, and the table is read once.  A lexicon that
    was stored with its `fields` is taken as it is, so that its searches need no Python."""
    if "fields" in lexicon.columns:
        return lexicon
    single = F.array("headword", "headword_reading", "collocate", "full_phrase", "pattern")
    empty = F.array().cast("array<string>")
    raw = F.concat(single, F.coalesce("tags", empty), F.coalesce("example_sentences", empty))
    known = spread(lexicon).withColumn("raw_fields", F.filter(raw, lambda x: F.length(x) > 0))
    wide = F.exists("raw_fields", lambda x: x.rlike(r"[^\x00-\x7f]"))
    # not deterministic for Spark, so that no filter on what follows from it goes back to where the entries aren't dealt out
    normal = T.nfkc_all.asNondeterministic()(F.when(wide, F.col("raw_fields")))
    both = known.withColumn("norm_fields", normal).withColumn("norm_fields", F.coalesce("norm_fields", "raw_fields"))
    return both.withColumn("fields", F.arrays_zip(F.col("raw_fields").alias("raw"), F.col("norm_fields").alias("norm"))).drop("raw_fields", "norm_fields")


def write_with_fields(lexicon: DataFrame, path: str) -> None:
    """Stores a lexicon with its `fields`, which are worked out once, at ingest: searches over what is
    read back from `path` are JVM plans without a Python worker.  An empty lexicon gives an empty store."""
    with_fields(lexicon).write.mode("overwrite").parquet(path)


def _rounded(similarity: Column, over: float, weight: int) -> Column:
    return F.when(similarity > over, F.floor(similarity * weight + 0.5)).otherwise(0).cast("int")


def pieces(term: str) -> list[str]:
    """Pieces of the term of which any window that scores has one unchanged; the whole term if no window does."""
    n = len(term)
    edits = max(e for e in range(n + 1) if 1 - e / n > WINDOW_OVER) if n >= 4 else 0
    cuts = [i * n // (edits + 1) for i in range(edits + 2)]
    return [term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _fuzzy(norm: Column, term: str) -> Column:
    """Whole-field similarity, and for terms of 4 or more the best window of the term's length
    (below that a window over the threshold is equal, which containment has scored higher), which
    only fields with a piece of the term have."""
    n, wanted = len(term), F.lit(term)
    # over the threshold only if the shorter is longer than half the longer
    whole = F.when((F.length(norm) * 2 > n) & (F.length(norm) < 2 * n), _rounded(T.similarity(norm, wanted), WHOLE_OVER, WHOLE_WEIGHT)).otherwise(0)
    if n < 4:
        return whole
    # beyond `most` edits a window scores nothing: the distance stops there and is -1
    most = math.ceil(n * (1 - WINDOW_OVER))
    windows = F.transform(F.sequence(F.lit(1), F.length(norm) - n + 1), lambda i: F.levenshtein(F.substring(norm, i, F.lit(n)), wanted, most))
    least = F.array_min(F.filter(windows, lambda d: d >= 0))
    may = reduce(Column.__or__, [norm.contains(p) for p in pieces(term)])
    near = F.when((F.length(norm) >= n) & may, F.coalesce(_rounded(1 - least / F.lit(n), WINDOW_OVER, WINDOW_WEIGHT), F.lit(0))).otherwise(0)
    return F.greatest(whole, near)


def score(q: QueryTerms, fuzzy: bool = True) -> Column:
    """The best score over an entry's fields (see with_fields)."""

    def any_term(c: Column) -> Column:
        return reduce(Column.__or__, [c.contains(t) for t in q.terms])

    def direct(f: Column) -> Column:
        norm, kana = f["norm"], T.to_hiragana(f["norm"])
        boost = F.when((f["raw"] == F.col("headword")) | (f["raw"] == F.col("full_phrase")), CONTAINS + BOOST).otherwise(CONTAINS)
        found = F.when(any_term(norm), boost).when(any_term(kana), CONTAINS_KANA).otherwise(0)
        return F.when(norm.rlike(q.wildcard) | kana.rlike(q.wildcard), WILDCARD).otherwise(found) if q.wildcard else found

    best = F.coalesce(F.array_max(F.transform("fields", direct)), F.lit(0))
    close = [t for t in dict.fromkeys([q.normalised, q.hiragana, q.romaji]) if len(t) >= 2]
    if not fuzzy or len(q.normalised) < 2 or not close:
        return best

    def similar(f: Column) -> Column:
        near = F.greatest(F.lit(0), F.lit(0), *[_fuzzy(f["norm"], t) for t in close])
        kana = T.to_hiragana(f["norm"])
        return F.when(f["norm"].rlike(q.wildcard) | kana.rlike(q.wildcard), 0).otherwise(near) if q.wildcard else near

    # a window scores below WINDOW_WEIGHT, a whole field below WHOLE_WEIGHT: no better than this
    return F.when(best >= WINDOW_WEIGHT, best).otherwise(F.greatest(best, F.coalesce(F.array_max(F.transform("fields", similar)), F.lit(0))))


def order(sort_by: str = "frequency", sort_dir: str = "desc") -> list[Column]:
    """frequency and score: largest first; created_at, updated_at: newest first; headword: A first, in Japanese collation.
    sort_dir="asc" turns all of it but the last tie-break around, which is the insertion order."""
    key = F.col({"frequency": "frequency", "created_at": "created_at", "updated_at": "updated_at", "headword": "headword", "score": "score"}[sort_by])
    if sort_by == "headword":
        key = F.collate(key, "ja")
    rising = (sort_by == "headword") != (sort_dir == "asc")
    keys = [key.asc() if rising else key.desc(), F.col("score").asc() if sort_dir == "asc" else F.col("score").desc()]
    return [*keys, F.col("ord").asc()]


def sort_and_limit(hits: DataFrame, sort_by: str = "frequency", sort_dir: str = "desc", max_results: int | None = DEFAULT_LIMIT) -> DataFrame:
    if max_results is None:
        return hits.repartition("id", "ord").orderBy(*order(sort_by, sort_dir))  # a sort samples its input first: hits are worked out once
    return hits.orderBy(*order(sort_by, sort_dir)).limit(max_results)


def search(lexicon: DataFrame, options: SearchOptions) -> DataFrame:
    """Lexicon rows with `score`.  A blank query gives all filtered rows, scored by frequency."""
    rows = filtered(lexicon, options)
    q = query_terms(options.query)
    if not q.normalised:
        hits = rows.drop("fields").withColumn("score", F.col("frequency").cast("int"))
    else:
        hits = with_fields(rows).withColumn("score", score(q, options.fuzzy).cast("int")).drop("fields").where("score > 0")
    return sort_and_limit(hits, options.sort_by, options.sort_dir, options.max_results)


def quick_search(lexicon: DataFrame, query: str, max_results: int = QUICK_LIMIT) -> DataFrame:
    return search(lexicon, SearchOptions(query=query, max_results=max_results))
