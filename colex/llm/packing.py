"""Packing by cutting-stock column generation.

Documents are tokenised once; all that travels on is a row per piece (at most 1,024
tokens each).  The lengths of the pieces form a histogram of at most CLASSES classes, a
linear program over patterns (how many pieces of each class share a sequence) is solved
on the driver by column generation, with a knapsack dynamic program that prices new
patterns, and the rounded patterns are handed out: the k-th piece of a class knows its
sequence from k alone.  Ranks come from bucket counts, so no class is sorted as a whole.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, partitions, table

SEQUENCE = 1024
#: Lengths are rounded up to this many tokens for the linear program only.
STEP = 4
CLASSES = SEQUENCE // STEP
TOKENIZER = "byte_bpe_50k"
#: Stop when the patterns' total is within this share of the linear program's bound.
GAP = 1e-4
MOST_ROUNDS = 5_000

# ------------------------------------------------------------------ tokens

_ENCODERS: dict[str, object] = {}


def encoder(name: str = TOKENIZER):
    """text -> ids.  The ranks file holds the vocabulary of the tokenizer's .json, and gives
    the same ids several times faster; a text that holds one of the tokenizer's added tokens
    (<|endoftext|>, an id of its own) or that its regular expression can't take goes to the
    tokenizer itself."""
    if name not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as whole:
            added = [t["content"] for t in json.load(whole)["added_tokens"]]
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        slow: list = []

        def encode(text: str) -> list[int]:
            if not any(token in text for token in added):
                try:
                    return fast.encode_ordinary(text)
                except (KeyboardInterrupt, SystemExit):
                    raise
                except BaseException:  # its regular expression engine gave up: a panic, which is no Exception
                    pass
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[name] = encode
    return _ENCODERS[name]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Cuts every document (its ids, then id 0) into pieces of `sequence` tokens and a rest.

    A null text is empty: one piece that is only the id 0.  Repeated rows give repeated pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, out = [], ([], [], [], [])
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py() or ""), 0], dtype="<u4").tobytes()
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    at.append(i)
                    for column, x in zip(out, (start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(x)
            columns = [batch.column(0).take(pa.array(at, type=pa.int64())), *[pa.array(c, type=pa.int64()) for c in out]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {key}, {PIECE}")


# ------------------------------------------------------------------ patterns


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The knapsack: how many pieces of each size are worth most within `room`."""
    best, chosen = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = np.searchsorted(sizes, w, side="right")
        best[w] = best[w - 1]
        if fits:
            worth = best[w - sizes[:fits]] + values[:fits]
            k = int(worth.argmax())
            if worth[k] > best[w] + 1e-12:
                best[w], chosen[w] = worth[k], k
    counts, w = np.zeros(len(sizes)), room
    while w > 0:
        k = chosen[w]
        if k < 0:
            w -= 1
        else:
            counts[k] += 1
            w -= sizes[k]
    return float(best[room]), counts


def _times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A vector-matrix or matrix-vector product without BLAS, whose threads would fight
    with Spark's for the driver's cores (and have been seen to hang there)."""
    return (left[:, None] * right).sum(axis=0) if left.ndim == 1 else (left * right[None, :]).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting."""
    m = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        k = i + int(np.abs(both[i:, i]).argmax())
        both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i][None, :]
    return both[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often the linear program uses each, by revised simplex.

    The first basis has one pattern per class, filled with that class alone.  Each round
    prices with the knapsack; a class whose dual went negative lets its surplus in.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    costs = np.ones(m)
    use = demand / np.diag(columns)
    inverse = np.diag(1 / np.diag(columns))
    for turn in range(MOST_ROUNDS):
        if turn % 128 == 127:  # shed rounding errors
            inverse = _inverse(columns)
            use = np.maximum(_times(inverse, demand), 0)
        duals = _times(costs, inverse)
        low = int(duals.argmin())
        if duals[low] < -1e-9:
            entering, cost = np.zeros(m), 0.0
            entering[low] = -1
        else:
            value, entering = best_pattern(np.maximum(duals, 0), sizes, room)
            cost, total = 1.0, float((costs * use).sum())
            if value <= 1 + 1e-9 or total / value >= total * (1 - GAP):
                break
        step = _times(inverse, entering)
        up = np.flatnonzero(step > 1e-10)
        if not len(up):
            break
        ratio = use[up] / step[up]
        out = up[int(ratio.argmin())]
        move = use[out] / step[out]
        use = np.maximum(use - move * step, 0)
        use[out] = move
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out], costs[out] = entering, cost
    real = costs > 0
    return columns.T[real].astype(int), use[real]


def first_fit(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """Bins for what rounding left over, the largest pieces first.

    Rounding leaves at most one sequence's worth per pattern, so this stays small however
    many documents there are.
    """
    bins: list[np.ndarray] = []
    space: list[int] = []
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(demand[k])):
            at = next((i for i, s in enumerate(space) if s >= sizes[k]), None)
            if at is None:
                bins.append(np.zeros(len(sizes), dtype=int))
                space.append(room)
                at = len(bins) - 1
            bins[at][k] += 1
            space[at] -= int(sizes[k])
    return bins


@dataclass(frozen=True)
class Slots:
    """Pieces [low, high) of a class go to sequences from `base` on, `each` to a sequence."""

    kind: int
    low: int
    high: int
    base: int
    each: int


def plan(histogram: dict[int, int], room: int = CLASSES) -> list[Slots]:
    """Where the pieces of each class go.  `room` is the class of a whole sequence."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n and k < room), dtype=int)
    left = np.array([histogram[k] for k in sizes], dtype=float)
    patterns: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        rows, use = column_generation(sizes, left, room)
        for k in np.argsort(-use, kind="stable"):
            pattern = rows[k]
            held = pattern > 0
            times = int(min(np.floor(use[k] + 1e-9), (left[held] // pattern[held]).min()))
            if times > 0:
                patterns.append((pattern, times))
                left = left - times * pattern
        patterns += [(b, 1) for b in first_fit(sizes, left, room)]
    slots: list[Slots] = []
    given = dict.fromkeys(histogram, 0)
    base = 0
    for pattern, times in patterns:
        for k, each in zip(sizes.tolist(), pattern.tolist(), strict=True):
            if each:
                slots.append(Slots(k, given[k], given[k] + times * each, base, each))
                given[k] += times * each
        base += times
    if histogram.get(room):
        slots.append(Slots(room, 0, histogram[room], base, 1))
    return slots


# ------------------------------------------------------------------ packing


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """Adds `rank`, 0-based and gapless within `kind`, without sorting any kind as a whole:
    the place in (kind, bucket), plus the counts of the kind's earlier buckets."""
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    cut = cut.withColumn("bucket", spread)
    counts = cut.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("kind").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("kind", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    placed = cut.withColumn("inside", inside)
    return placed.join(starts, ["kind", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "bucket")


def pack(docs: DataFrame, sequence: int = SEQUENCE, step: int = STEP, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only doc_id and text are read.  An empty table has no pieces; a null or empty text is
    one piece of one token; repeated rows and rows without an id are packed once each.  A very
    long text is tokenised as a whole in one task and cut into as many pieces as it takes.
    Sequences are at most `sequence` tokens, and padding is what their pieces leave.
    """
    spark = docs.sparkSession
    kind = F.ceil(F.col("length") / F.lit(step)).cast("int")
    cut = materialise(pieces(docs, sequence, tokenizer).withColumn("kind", F.when(F.col("length") == sequence, sequence // step).otherwise(kind)), "pieces")
    # a rest that only rounding makes as large as a sequence is a sequence of its own
    histogram = {r["kind"]: r["n"] for r in cut.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(histogram, sequence // step)
    # bounded: at most the classes that fit in a pattern, times patterns, whatever the corpus
    where = spark.createDataFrame([(s.kind, s.low, s.high, s.base, s.each) for s in slots], "kind_s int, low long, high long, base long, each long")
    found = ranked(cut, partitions(spark)).join(
        F.broadcast(where), (F.col("kind") == F.col("kind_s")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    place = F.col("rank") - F.col("low")
    found = found.withColumn("sequence_id", F.col("base") + F.floor(place / F.col("each"))).withColumn("nth", place % F.col("each"))
    before = W.partitionBy("sequence_id").orderBy(F.desc("kind"), "nth").rowsBetween(W.unboundedPreceding, -1)
    return found.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's pieces over the whole documents table."""
    return pack(table(spark, sf_dir, "documents"))
