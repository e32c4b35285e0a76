"""One object over the tables of a workspace: the calls other programs need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.classify import classify
from .operators import discourse, library, parse, search, store
from .operators.dictionary import DictionaryOptions
from .operators.dictionary import search as search_terms
from .plans.schemas import CHUNKS, LEXICON
from .sources import lexicon as source


@dataclass
class Workspace:
    """Snapshots of the lexicon and the chunks, and the rules that analyse texts."""

    spark: SparkSession
    lexicon: DataFrame
    chunks: DataFrame
    rules: discourse.Rules = field(default_factory=discourse.seed_rules)
    #: Queries of the dictionary view, the last one first, and the context records so far.
    asked: list[str] = field(default_factory=list)
    contexts: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, lexicon_path: str | None = None, chunks_path: str | None = None, on_error: str = "raise") -> Workspace:
        words = source.read_lexicon(spark, lexicon_path, on_error) if lexicon_path else source.seed(spark)
        chunks = source.read_chunks(spark, chunks_path, "empty" if on_error == "seed" else "raise") if chunks_path else spark.createDataFrame([], CHUNKS)
        return cls(spark, words, chunks)

    def search(self, query: str = "", **options) -> DataFrame:
        return search.search(self.lexicon, search.SearchOptions(query, **options))

    def suggest(self, query: str = "") -> DataFrame:
        return search.quick_search(self.lexicon, query)

    def add(self, entries: DataFrame) -> None:
        self.lexicon = store.upsert(self.lexicon, entries)

    def delete(self, ids: list[str]) -> None:
        self.lexicon = store.delete(self.lexicon, self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def reset(self, seed_path: str | None = None) -> None:
        self.lexicon = source.seed(self.spark, seed_path)

    def clear(self) -> None:
        self.lexicon = self.spark.createDataFrame([], LEXICON)

    def stats(self) -> DataFrame:
        return store.stats(self.lexicon)

    def classify(self, texts: DataFrame) -> DataFrame:
        return classify(texts)

    def parse(self, texts: DataFrame, key: str) -> DataFrame:
        return parse.parse_collocations(texts, key)

    def analyze(self, graphs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        return discourse.analyze(graphs, self.rules)

    def query_chunks(self, **options) -> DataFrame:
        return store.query_chunks(self.chunks, **options)

    def chunk_counts(self) -> DataFrame:
        return store.count_by_category(self.chunks)

    def register_rule(self, rule: discourse.Rule) -> None:
        self.rules.register(rule)

    def save(self, lexicon_path: str, chunks_path: str) -> None:
        source.write_json(self.lexicon, lexicon_path)
        source.write_json(self.chunks, chunks_path)

    def dictionary_view(self, terms: DataFrame, dictionaries: DataFrame, bookmarks: DataFrame, options: DictionaryOptions) -> DataFrame:
        """Dictionary hits, each with whether it is bookmarked; a query that isn't blank goes to the front of the history."""
        if options.query.strip():
            self.asked = [options.query, *(q for q in self.asked if q != options.query)][: library.HISTORY_LIMIT]
        return library.with_bookmark_flag(search_terms(terms, dictionaries, options), bookmarks)

    def clear_history(self) -> None:
        self.asked = []

    def clear_contexts(self) -> None:
        self.contexts = None

    def ingest(self, graphs: DataFrame, source: str, group: str = "") -> None:
        """Adds the labelled bits of graphs to the context records, under ids of their own content."""
        labelled, _, _ = self.analyze(graphs)
        records = discourse.context_records(labelled, source, group).withColumn("id", store.content_id("source", "graph_id", "bit_idx"))
        self.contexts = records if self.contexts is None else self.contexts.join(records, "id", "left_anti").unionByName(records)

    def totals(self, hits: DataFrame) -> DataFrame:
        """n_hits, n_all: what a result list shows above itself."""
        everything = self.lexicon.agg(F.count(F.lit(1))).scalar()
        return hits.agg(F.count(F.lit(1)).alias("n_hits")).withColumn("n_all", everything)
