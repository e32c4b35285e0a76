"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a place on a hash line.  Word sums by source and hash bucket show
where a source's budget ends; only the bucket in which it ends is split further, level
after level, until one place is left.  The mix is then the filter ``place < threshold``:
nothing is sorted, no document list leaves the executors, and thresholds are nested, so
a smaller budget always takes a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, table

#: Fixed by the contract: weights in source order, share of all words, most repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hash bits a level resolves, and levels.  60 bits tell 10^9 documents of one source apart.
LEVEL_BITS = 12
LEVELS = 5
#: Sources are a dimension.  Beyond this many, their table is joined by shuffle.
BROADCAST_SOURCES = 20_000


def place(doc_id: Column, text: Column) -> Column:
    """The 60-bit place of a document, by its id and text: rows that share an id, or have none, have places of
    their own unless their texts are equal.  Null ids and texts count as empty."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for each source of (source, size).

    The budget is `share` of all words, split by weight; a source stops at `most` times
    its own words and the excess goes to the others by weight.  A source is stopped iff
    its ratio most*size/weight is at most the common level.  In order of that ratio the
    stopped sources are a prefix, and the first source that isn't stopped sets the level.
    Sources are ranked in one task, a row of some 50 bytes each: a dimension, up to some 10^8 of them.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(rising))
    free = levels.withColumn("free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("nth")))
    found = free.withColumn("first", F.min("free").over(whole)).withColumn("common", F.min_by("level", "free").over(whole))
    return found.select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("nth") < F.col("first")), F.col("cap"))
        .otherwise(F.col("common") * F.col("weight"))
        .alias("target"),
    )


def _by_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Join on the null-safe source; the hot source is no problem for a broadcast."""
    right = right.withColumnRenamed("source", "source_r")
    return left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["source_r"]), how).drop("source_r")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def thresholds(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame, bool]:
    """(sizes, plan, small): doc_id, source, size, place of every row of `docs`; source,
    source_size, target, whole, threshold, some of every source (`some`: how many of the rows at the
    threshold itself are in); whether the plan may be broadcast.
    """
    sizes = materialise(docs.select("doc_id", "source", word_count().alias("size"), place(F.col("doc_id"), F.col("text")).alias("place")), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    plan = targets.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(None).cast("double").alias("each"))
    top = LEVEL_BITS * LEVELS
    for level in range(LEVELS):
        shift = top - LEVEL_BITS * (level + 1)
        inside = _by_source(sizes, state, small).where(
            (F.shiftright("place", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)) & (F.col("rest") > 0)
        )
        bucket = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("low").alias("low")
        )
        running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        bucket = bucket.withColumn("upto", running)
        # the last level decides on one place: its rows are all in if the sum comes nearer with the last of them
        each = F.col("words") / F.col("n")
        fits = (F.col("upto") if level < LEVELS - 1 else F.col("upto") - each / 2) <= F.col("rest")
        full = bucket.groupBy("source").agg(
            F.coalesce(F.min(F.when(~fits, F.col("bucket"))), F.max("bucket") + 1).alias("end"),
            F.max(F.when(fits, F.col("upto"))).alias("used"),
            F.min_by(each, F.when(~fits, F.col("bucket"))).alias("each_"),
        )
        last, state = state, materialise(
            _by_source(state, full, small, "left").select(
                "source",
                (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
                F.coalesce(F.shiftleft(F.col("end"), shift), F.col("low")).alias("low"),
                F.col("each_").alias("each"),
            ),
            "mix-level",
        )
        if level:
            discard(last)
    # of equal rows at the threshold as many as bring the sum nearest
    some = F.coalesce(F.when(F.col("each") > 0, F.floor(F.col("rest") / F.col("each") + 0.5)), F.lit(0)).cast("long")
    plan = _by_source(plan.drop("rest"), state.select("source", F.col("low").alias("threshold"), F.greatest(some, F.lit(0)).alias("some")), small)
    return sizes, materialise(plan, "mix-plan"), small


def taken(rows: DataFrame, plan: DataFrame, small: bool, most: float = MOST) -> DataFrame:
    """rows (with source and place) with their source's plan and `times`, how often each is taken.  Of equal rows
    at the threshold `some` are in; only these rows are numbered, if there are any."""
    planned = _by_source(rows, plan, small)
    extra = F.when((F.col("place") < F.col("threshold")) & (F.col("whole") < most), 1).otherwise(0)
    if not plan.where((F.col("some") > 0) & (F.col("whole") < most)).head(1):
        return planned.withColumn("times", F.col("whole") + extra)
    tied = (F.col("place") == F.col("threshold")) & (F.col("some") > 0) & (F.col("whole") < most)
    nth = F.row_number().over(W.partitionBy("source", "place").orderBy("place"))
    ties = planned.where(tied).withColumn("nth_", nth).withColumn("times", F.col("whole") + F.when(F.col("nth_") <= F.col("some"), 1).otherwise(0)).drop("nth_")
    return planned.where(~tied).withColumn("times", F.col("whole") + extra).unionByName(ties)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, place, times for every row of `docs`.

    A source's sum ends nearest to its target, at most half a document away.
    Whole repeats come first: every document of a source is taken floor(target / source_size)
    times.  What is left of the target is filled with the documents whose place lies below
    the source's threshold.  Null and empty texts have size 0 and are taken as 0 words.
    Rows with one doc_id, or without any, are judged each; equal rows share a place, and as many of them are
    taken as fit.  A very long text is one document like any other and counts its own words.
    Only `doc_id`, `text` and `source` are read; an empty table gives an empty result.
    """
    sizes, plan, small = thresholds(docs, weights, share, most)
    columns = ["doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source", "place", "times"]
    return taken(sizes, plan, small, most).select(*columns)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole documents table."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting: running word sums in hash order, row after row.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap FROM t),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0::DOUBLE))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0::DOUBLE)) AS level
      FROM r WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM l),
f AS (SELECT *, CASE WHEN cap > level * weight THEN nth END AS free FROM s),
c AS (SELECT *, min(free) OVER () AS first_free FROM f),
e AS (SELECT *, max(CASE WHEN nth = first_free THEN level END) OVER () AS common FROM c),
p AS (SELECT source, source_size, CASE WHEN first_free IS NULL OR nth < first_free THEN cap ELSE common * weight END AS target FROM e),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
u AS (SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN rest > 0 AND upto - size / 2 <= rest AND whole < 2 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM u
"""
