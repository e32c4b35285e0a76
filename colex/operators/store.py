"""The lexicon and chunk stores: immutable snapshots, upserts, lookups, counts, index tables.

A store is a DataFrame with `id` and `ord` (its place in insertion order).  Changes give
new snapshots; nothing is de-indexed because lookups are predicates that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_id(*columns: str) -> Column:
    """A reproducible id from a row's natural key."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of `batch` replace rows of the same id; within the batch the last (by ord) wins.

    A replaced row keeps its place; new rows follow in the order of their first appearance.
    """
    both = store.withColumn("is_new", F.lit(False)).unionByName(batch.withColumn("is_new", F.lit(True)))
    ranked = both.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy(F.col("is_new").desc(), F.col("ord").desc())))
    whole = W.partitionBy("id")
    place = F.struct(F.min("is_new").over(whole).alias("appended"), F.coalesce(F.min(F.when(~F.col("is_new"), F.col("ord"))).over(whole), F.min("ord").over(whole)).alias("at"))
    kept = ranked.withColumn("place", place).where("nth = 1")
    top = store.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
    return kept.withColumn("ord", F.when(F.col("place.appended"), top + 1 + F.col("place.at")).otherwise(F.col("place.at"))).select(store.columns)


def bulk_import(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, int]:
    """The new snapshot, and the number of rows handed in, repeats included."""
    return upsert(store, batch), batch.count()


def update(store: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    """upsert with a new time of change."""
    return upsert(store, batch.withColumn("updated_at", F.lit(now_ms).cast("long")))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows whose id is in `ids` (unknown ids change nothing)."""
    return store.join(ids.select("id").distinct(), "id", "left_anti").select(store.columns)


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def all_rows(store: DataFrame) -> DataFrame:
    return store.orderBy("ord")


def by_id(store: DataFrame, value: str) -> DataFrame:
    return store.where(F.col("id") == value)


def by_headword(store: DataFrame, value: str) -> DataFrame:
    return store.where(F.col("headword") == value)


def by_pos(store: DataFrame, value: str) -> DataFrame:
    """By the headword's part of speech only (the search filter also takes the collocate's)."""
    return store.where(F.col("headword_pos") == value)


def by_pattern(store: DataFrame, value: str) -> DataFrame:
    return store.where(F.col("pattern") == value)


def by_tag(store: DataFrame, value: str) -> DataFrame:
    return store.where(F.array_contains("tags", value))


def has_source(store: DataFrame, value: str) -> bool:
    return bool(store.where(F.col("source") == value).head(1))


def size(store: DataFrame) -> int:
    return store.count()


def stats(store: DataFrame) -> DataFrame:
    """kind (total, pos, source), key, n in one pass."""
    sets = store.groupingSets([["headword_pos"], ["source"], []], "headword_pos", "source").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )
    kind = F.when(F.col("gid") == 1, "pos").when(F.col("gid") == 2, "source").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("headword_pos", "source", F.lit("")).alias("key"), "n")


def all_tags(store: DataFrame) -> DataFrame:
    return store.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def all_patterns(store: DataFrame) -> DataFrame:
    return store.select("pattern").distinct().orderBy("pattern")


def inverted_index(store: DataFrame, key: str, span: int | None = None) -> DataFrame:
    """key, ids in insertion order once each; an array column is indexed by its elements.

    With `span`, a key's list comes in rows (key, part, ids) of the places part * span up to
    the next, so that no row and no task grows with a frequent key.
    """
    column = F.explode(key) if store.schema[key].dataType.typeName() == "array" else F.col(key)
    entries = store.select(column.alias("key"), "id", "ord").groupBy("key", "id").agg(F.min("ord").alias("ord"))
    by = ["key"] if span is None else ["key", F.floor(F.col("ord") / span).alias("part")]
    listed = F.array_sort(F.collect_list(F.struct("ord", "id")))
    return entries.groupBy(*by).agg(F.transform(listed, lambda x: x["id"]).alias("ids"))


# chunks and context bits


def chunks_by_marker(chunks: DataFrame, surface: str) -> DataFrame:
    return chunks.where(F.col("surface") == surface)


def chunks_by_category(chunks: DataFrame, category: str) -> DataFrame:
    return chunks.where(F.col("category") == category)


def chunks_by_collocation(chunks: DataFrame, collocation: str) -> DataFrame:
    return chunks.where(F.array_contains("collocations", collocation))


def query_chunks(chunks: DataFrame, category: str | None = None, marker: str | None = None, collocation: str | None = None) -> DataFrame:
    """The first option that is given decides alone; without any, all chunks."""
    if category:
        return chunks_by_category(chunks, category)
    if marker:
        return chunks_by_marker(chunks, marker)
    return chunks_by_collocation(chunks, collocation) if collocation else chunks


def count_by_category(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def chunk_collocations(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Chunks with the lexicon rows they name, one row per pair."""
    pairs = chunks.select(F.col("id").alias("chunk_id"), "surface", F.explode("collocations").alias("id"))
    return pairs.join(lexicon, "id")


def form_entry(form: DataFrame, *keys: str) -> DataFrame:
    """Form rows (headword, collocate, full_phrase, tags, examples as typed) as clean fields, beside the keys.

    Texts are trimmed, tags split at commas, examples at newlines, blanks dropped; a row
    needs a headword and a collocate, and its phrase defaults to both together.
    """
    from ..functions.text import trim

    def split(column: str, at: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), at), trim), lambda x: x != "")

    clean = form.select(*keys, *[trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("headword", "collocate", "full_phrase")], split("tags", ",").alias("tags"), split("examples", "\n").alias("examples"))
    phrase = F.coalesce(F.nullif("full_phrase", F.lit("")), F.concat("headword", "collocate"))
    return clean.where("headword <> '' AND collocate <> ''").withColumn("full_phrase", phrase)


def word_list(spark: SparkSession, text: str) -> DataFrame:
    """Words of a comma-separated list, trimmed, blanks dropped, in order, once each."""
    words = dict.fromkeys(w.strip() for w in text.split(",") if w.strip())
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "ord long, word string")


def word_lists(lists: DataFrame, *keys: str) -> DataFrame:
    """keys, ord, word: the words of comma-separated lists (`text`), trimmed, blanks dropped, in order, once each."""
    from ..functions.text import trim

    words = F.array_distinct(F.filter(F.transform(F.split("text", ","), trim), lambda x: x != ""))
    return lists.select(*keys, F.posexplode(words).alias("ord", "word"))


def context_by(records: DataFrame, category: str | None = None, function: str | None = None, speaker: str | None = None, group: str | None = None) -> DataFrame:
    """Context records by each given criterion.  `functions` is empty at ingest, so a search by
    function finds only records that got one later."""
    if category is not None:
        records = records.where(F.col("category") == category)
    if function is not None:
        records = records.where(F.array_contains("functions", function))
    if speaker is not None:
        records = records.where(F.col("speaker") == speaker)
    return records if group is None else records.where(F.col("connection_group") == group)


#: Fixed value: the order in which a listing of all categories goes through them.
CATEGORIES = ("hedging", "epistemic", "interactional", "causal-logical", "enumerative", "referential", "stance", "structural")


def by_all_categories(records: DataFrame, order_by: tuple[str, ...] = ("graph_id", "bit_idx")) -> DataFrame:
    """All records, category after category in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return records.orderBy(place, *order_by)
