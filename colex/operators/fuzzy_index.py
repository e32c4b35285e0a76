"""An index for fuzzy search: candidates by pigeonhole and by common characters, then the exact score.

Fields repeat, so what is indexed are their distinct forms (the normal form, and its hiragana), with the entries
that use them.  A form can score for a term in three ways, and each leaves a trace:

- it contains the term, and so all grams of it;
- a window of it lies within e edits of the term: of e + 1 pieces of the term one stands in it unchanged, with
  all the piece's grams;
- as a whole it is similar enough: then more than half the characters of the longer one match, so the two have
  that many in common, whatever their order.

The first two are lookups in the grams, the third compares lengths and counts characters of the forms.  Only entries
that use a form with a trace are scored, by the same score as without an index, so the rows are the same.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S

GRAM = 2


@dataclass(frozen=True)
class FuzzyIndex:
    """uses: form, id; grams: gram, form; forms: form, size."""

    uses: DataFrame
    grams: DataFrame
    forms: DataFrame


def build(lexicon: DataFrame) -> FuzzyIndex:
    """The index of a lexicon: three tables to be written, or to be worked out anew by each search."""
    rows = S.with_fields(lexicon)
    both = F.array_distinct(F.flatten(F.transform("fields", lambda f: F.array(f["norm"], T.to_hiragana(f["norm"])))))
    uses = rows.select(F.explode(both).alias("form"), "id")
    forms = uses.select("form").distinct().withColumn("size", F.length("form"))
    cut = F.transform(F.sequence(F.lit(1), F.length("form") - GRAM + 1), lambda i: F.substring("form", i, F.lit(GRAM)))
    grams = forms.where(F.col("size") >= GRAM).select(F.explode(F.array_distinct(cut)).alias("gram"), "form")
    return FuzzyIndex(uses, grams, forms)


def _common(term: str) -> Column:
    """How many characters form and term have in common, counted with their repetitions."""
    times = [F.least(F.lit(n), F.col("size") - F.length(F.replace("form", F.lit(ch)))) for ch, n in Counter(term).items()]
    return reduce(Column.__add__, times)


def _whole(term: str) -> Column:
    """Whether the form may be similar to the term as a whole."""
    n = len(term)
    longer = F.greatest(F.col("size"), F.lit(n))
    return (F.col("size") * 2 > n) & (F.col("size") < 2 * n) & (_common(term) > longer * S.WHOLE_OVER)


def candidates(index: FuzzyIndex, query: str, fuzzy: bool = True) -> DataFrame | None:
    """id of the entries that may score; None if the query is blank, has a wildcard or a piece without a gram."""
    q = S.query_terms(query)
    close = [t for t in dict.fromkeys([q.normalised, q.hiragana, q.romaji]) if len(t) >= 2] if fuzzy and len(q.normalised) >= 2 else []
    ways = list(dict.fromkeys([*q.terms, *(p for t in close for p in S.pieces(t))]))
    if not q.normalised or q.wildcard or any(len(w) < GRAM for w in ways):
        return None
    grams = {w: sorted({w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}) for w in ways}
    met = index.grams.where(F.col("gram").isin(*sorted({g for some in grams.values() for g in some})))
    has = met.groupBy("form").agg(F.collect_set("gram").alias("has"))  # of the query's grams only
    traced = has.where(reduce(Column.__or__, [F.size(F.array_except(F.array(*map(F.lit, some)), "has")) == 0 for some in grams.values()])).select("form")
    if close:
        traced = traced.union(index.forms.where(reduce(Column.__or__, map(_whole, close))).select("form"))
    return index.uses.join(traced.distinct(), "form", "left_semi").select("id").distinct()


def search(lexicon: DataFrame, index: FuzzyIndex, options: S.SearchOptions) -> DataFrame:
    """The rows of search.search(), scored only where the index has a trace."""
    found = candidates(index, options.query, options.fuzzy)
    rows = lexicon if found is None else lexicon.join(found, "id", "left_semi").select(lexicon.columns)
    return S.search(rows, options)
