"""The corpus pipeline: five stages, each over all that its predecessor kept.

Stages but the last return the columns of documents.  run() writes every stage's rows to
the shared folder and rereads them, so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colex.llm import classifier, jaccard, mixture, packing, secrets
from colex.llm.common import discard, materialise, mix, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The near-duplicate stage's own link: a similarity of 0.8 or more of five-word shingles (op5's contract has other values).
SHINGLE = 5
THRESHOLD = 80
#: Verdicts (17 bytes each, packed) up to which they are broadcast; beyond, texts are shuffled to them once.
BROADCAST_ROWS = 4_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good, each row by its own text.

    Repeated rows and rows without an id are judged each; null and empty texts are scored like any
    other.  Without labels all documents stay (an undecided score is no rejection)."""
    docs = docs.select(COLUMNS)
    vectors, model = classifier.train(docs, table(spark, sf_dir, "labels"))
    discard(vectors)
    return classifier.keep(docs, model)


def with_verdicts(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """keyed (doc_id, key_, ..) with `stays` of its verdict (id, key, stays), or null.

    Up to BROADCAST_ROWS verdicts go to the texts, packed and sorted by a hash of id and key, and texts stay where they
    are; more of them are met in a shuffle whose smaller side is hashed, so that texts needn't be sorted."""
    if verdict.count() <= BROADCAST_ROWS:
        rows = verdict.toArrow()
        ids, keys, stays = rows["id"], rows["key"].to_numpy(), rows["stays"].to_numpy()
        null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        places = mix(ids.astype(np.int64).view(np.uint64)) ^ keys.view(np.uint64) ^ null
        order = np.argsort(places)
        places = places[order]
        if not (places[1:] == places[:-1]).any():  # else two verdicts would be one, and the join tells them apart
            sent = keyed.sparkSession.sparkContext.broadcast((places, ids[order], (2 * null + stays).astype(np.uint8)[order]))

            def found(ids: pa.Array, keys: pa.Array) -> pa.Array:
                places, known, flags = sent.value
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                place = mix(ids.astype(np.int64).view(np.uint64)) ^ keys.to_numpy().view(np.uint64) ^ null
                if not len(places):
                    return pa.nulls(len(ids), pa.bool_())
                at = np.minimum(np.searchsorted(places, place), len(places) - 1)
                own = (places[at] == place) & (known[at] == ids) & (flags[at] // 2 == null)
                return pa.array(flags[at] % 2 == 1, mask=~own)

            return keyed.withColumn("stays", F.arrow_udf(found, "boolean")("doc_id", "key_"))
    return keyed.join(verdict.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(verdict["id"]) & (keyed["key_"] == verdict["key"]), "left")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, null ids last.

    Texts link from a Jaccard similarity of THRESHOLD hundredths of their SHINGLE-word shingles on.
    Rows are judged by their texts: of rows that share an id but not a group each group keeps its own,
    and of repeated rows one stays, the same on every rerun.  Documents without words link with
    nothing and stay, every row of them.
    """
    found = materialise(jaccard.join_components(docs, k=SHINGLE, threshold=THRESHOLD), "near-components")
    words = found.where("n_shingles > 0")
    keys = [F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"]
    chosen = materialise(words.groupBy("component").agg(F.min(F.struct(*keys)).alias("chosen")), "near-chosen")
    others = words.join(chosen, "component").where(F.struct(*keys) != F.col("chosen")).select("doc_id", "text_key")
    repeated = words.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_key")
    verdict = others.select("*", F.lit(False).alias("stays")).union(repeated.select("*", F.lit(True).alias("stays")))
    verdict = verdict.groupBy("doc_id", "text_key").agg(F.min("stays").alias("stays"))
    verdict = materialise(verdict.withColumnsRenamed({"doc_id": "id", "text_key": "key"}), "near-verdicts")
    discard(found, chosen)
    keyed = docs.select(COLUMNS).withColumn("key_", F.xxhash64(F.coalesce("text", F.lit(""))))
    judged = with_verdicts(keyed, verdict).where("coalesce(stays, true)")
    kept = judged.where("stays IS NULL").select(COLUMNS)
    if not verdict.where("stays").head(1):
        return kept
    # rows with one id and text: map-side aggregation leaves one, however many they are
    one = judged.where("stays").groupBy("doc_id", "key_").agg(F.min(F.struct([c for c in COLUMNS if c != "doc_id"])).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(one.select(COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; n_chars follows the text.

    Null texts stay null (and so does their n_chars), empty ones empty; repeated rows are masked each,
    and a very long text is scanned in time linear in its length."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([secrets.redact(v.as_py()) for v in batch.column(at)], type=pa.string())
            yield batch.set_column(at, "text", texts)

    schema = T.StructType([docs.schema[c] for c in COLUMNS])
    cleaned = docs.select(COLUMNS).mapInArrow(work, schema)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most twice.  A document without
    words weighs nothing and is taken once.  Texts meet their source's plan where they are."""
    docs = docs.select(COLUMNS)
    sizes, plan, small = mixture.thresholds(docs)
    discard(sizes)
    rows = mixture.taken(docs.withColumn("place", mixture.place(F.col("doc_id"), F.col("text"))), plan, small)
    times = F.when(mixture.word_count() == 0, 1).otherwise(F.col("times")).cast("int")
    return rows.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens: every row, repeated ones each; a null
    or empty text is one token, and a very long one as many pieces as it takes."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Tokenising and the classifier are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.  A stage's table goes when its successor is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        last = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written
    discard(last)
    return packed
