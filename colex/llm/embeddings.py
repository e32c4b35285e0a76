"""Near-duplicate embeddings: sign hashing in several tables, exact verification, components.

Equal vectors of one label form a class.  A table hashes a class by the signs of its
vector against random hyperplanes; classes of one label that share a bucket in any table
are compared.  Bits grow with the largest label, so buckets stay small, and tables follow
from the bits so that a pair right at the threshold is found with probability RECALL.

What first meets in a bucket are 64 more sign bits of each class, not its vector: a class
that differs in more than FAR bits from all others of its bucket has no near one there.
Only the others' vectors are fetched, for the exact cosine in double precision.  A bucket
larger than a block is compared block against block in as many tasks as there are pairs of
blocks; pairs are counted, not written.  A cosine that rounding leaves open is worked out anew
with twice the digits, so a pair right at the threshold links however its vectors are scaled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, input_bytes, materialise, partitions, table
from .components import connect

THRESHOLD = 0.98
RECALL = 0.9999
#: Vectors of random directions that a bucket holds on average, at most.
BUCKET = 32
BITS = (8, 30)
#: Classes in a block: a task compares two blocks at a time, ROWS rows of the products at once.
BLOCK = 8192
ROWS = 512
#: Sign bits that meet before vectors do, and the chance that a pair at the threshold differs in more than the bits allowed.
SKETCH = 64
MISSED = 1e-7
#: Roundings per component within which a product is open, and pairs whose products are worked out anew at once.
ROUNDINGS, PAIRS = 8, 1 << 16
#: Bytes of vectors and places that meet in a slot (a frame of buckets), on average, at most.
SLOT_BYTES = 16_000_000
SEED = 20_011


def shape(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for labels of at most `largest` classes."""
    bits = min(max(math.ceil(math.log2(max(largest, 1) / BUCKET + 1)), BITS[0]), BITS[1])
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def far(threshold: float = THRESHOLD) -> int:
    """The sketch bits in which a pair at the threshold differs at most, but for a chance of MISSED."""
    p = math.acos(threshold) / math.pi
    tail, k = 1.0, -1
    while tail > MISSED and k < SKETCH:
        k += 1
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


@functools.lru_cache(16)
def _planes(seed: int, dimension: int, count: int) -> np.ndarray:
    """The first planes of a dimension, a row each."""
    return np.random.default_rng([seed, dimension]).standard_normal((count, dimension))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket numbers; a table's hyperplanes depend on the dimension and its number only."""
    planes = _planes(SEED, x.shape[1], tables * bits)
    signs = (x @ planes.T >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def sketches(x: np.ndarray) -> np.ndarray:
    """64 sign bits of each vector, against other hyperplanes than those of the tables."""
    return np.packbits(x @ _planes(SEED + 1, x.shape[1], SKETCH).T >= 0, axis=1).view(np.int64).ravel()


def unit(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1, in double precision, however small or large their components are."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b as a rounded product and what rounding lost (Dekker)."""
    p, parts = a * b, []
    for x in (a, b):
        c = x * 134_217_729.0  # 2**27 + 1 halves the digits
        high = c - (c - x)
        parts.append((high, x - high))
    (ah, al), (bh, bl) = parts
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _plus(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _dot(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' scalar products with twice the digits of a double."""
    high = low = np.zeros(len(a))
    for k in range(a.shape[1]):
        p, lost = _product(a[:, k], b[:, k])
        high, more = _plus(high, p)
        low = low + (more + lost)
    return _plus(high, low)


def _times(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    p, lost = _product(a[0], b[0])
    return _plus(p, lost + (a[0] * b[1] + a[1] * b[0]))


def meets(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of a with that of b is at least the threshold, by the squares with twice the digits."""
    scaled = [np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a.astype(np.float64), b.astype(np.float64))]
    a, b = scaled  # by powers of two, which lose nothing
    dot = _dot(a, b)
    wanted = _times(_times(_dot(a, a), _dot(b, b)), _product(np.float64(threshold), np.float64(abs(threshold))))
    square = _times(dot, (np.abs(dot[0]), dot[1] * np.where(dot[0] < 0, -1, 1)))
    return (square[0] - wanted[0]) + (square[1] - wanted[1]) >= 0


def _matrices(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) of an array of lists, by dimension."""
    import pyarrow.compute as pc

    length = np.asarray(pc.list_value_length(values))
    flat = np.asarray(values.flatten()).astype(np.float64)
    ends = np.cumsum(length)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, unit(flat[(ends - length)[at][:, None] + np.arange(d)])


def _hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """cls, tab, bucket, sketch: a row per class and table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                rows = pa.array(np.repeat(at, tables))
                columns = [
                    *[batch.column(i).take(rows) for i in (2, 0)],
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                    pa.array(signatures(x, bits, tables).ravel() + (x.shape[1] << 32)),  # vectors of other lengths never meet
                    pa.array(np.repeat(sketches(x), tables)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "cls", "tab", "bucket", "sketch"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("cls", "embedding", "label").mapInArrow(work, f"label {label}, cls long, tab int, bucket long, sketch long")


def _groups(pdf: pd.DataFrame, columns: list[str]) -> Iterator[np.ndarray]:
    """The row numbers of each group of two rows or more."""
    codes = [pd.factorize(pdf[c])[0] for c in columns]
    order = np.lexsort(codes)
    change = np.zeros(len(order), bool)
    change[:1] = True
    for c in codes:
        change[1:] |= c[order][1:] != c[order][:-1]
    start = np.flatnonzero(change)
    for a, b in zip(start, np.append(start[1:], len(order)), strict=True):
        if b - a > 1:
            yield order[a:b]


def _not_alone(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """label, tab, bucket, cls of the classes with another one within `most` sketch bits in their bucket."""
    sketch, keep = pdf["sketch"].to_numpy().view(np.uint64), np.zeros(len(pdf), bool)
    for at in _groups(pdf, ["label", "tab", "bucket"]):
        s = sketch[at]
        for a in range(0, len(s), ROWS):
            close = np.bitwise_count(s[a : a + ROWS, None] ^ s[None, :]) <= most
            keep[at[a : a + ROWS]] = close.sum(axis=1) > 1  # itself included
    return pdf.loc[keep, ["label", "tab", "bucket", "cls"]]


def _places(some: np.ndarray, tab: int) -> np.ndarray:
    """(classes, tab) buckets of the first tables in which the classes were kept, from their tables and buckets in turn; where one
    wasn't, a number that no other has."""
    out = np.repeat(-1 - np.arange(len(some), dtype=np.int64)[:, None], tab, axis=1)
    for row, kept in zip(out, some, strict=True):
        tabs, buckets = kept[::2], kept[1::2]
        row[tabs[tabs < tab]] = buckets[tabs < tab]
    return out


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """cls, links, root of the classes of some pairs of blocks that have a link there; root is the
    least class that it links with, or itself.

    A pair is counted in the first table in which both were kept in one bucket.
    """
    out = [pd.DataFrame({"cls": [], "links": [], "root": []}, dtype="int64")]
    values, classes, weights, blocks, kept = (pdf[c].to_numpy() for c in ("embedding", "cls", "weight", "block", "kept"))
    tabs, ones, others = (pdf[c].to_numpy() for c in ("tab", "one", "other"))
    for at in _groups(pdf, ["label", "tab", "bucket", "one", "other"]):
        cls, weight, tab, one, other = classes[at], weights[at], int(tabs[at[0]]), ones[at[0]], others[at[0]]
        side = blocks[at] == one
        raw = np.stack(values[at])
        x, buckets = unit(raw), None
        links, root = np.zeros(len(cls), np.int64), cls.copy()
        open_ = ROUNDINGS * (x.shape[1] + 8) * np.finfo(np.float64).eps
        for a in range(0, len(cls), ROWS):
            rows = slice(a, a + ROWS)
            product = x[rows] @ x.T
            pairs = product >= threshold - open_
            pairs[np.arange(len(pairs)), np.arange(a, a + len(pairs))] = False
            if one != other:
                pairs &= side[rows, None] != side[None, :]
            if not pairs.any():
                continue
            i, j = np.nonzero(pairs & (product <= threshold + open_))
            for k in range(0, len(i), PAIRS):
                some, with_ = i[k : k + PAIRS], j[k : k + PAIRS]
                pairs[some, with_] = meets(raw[a + some], raw[with_], threshold)
            root[rows] = np.minimum(root[rows], np.where(pairs, cls[None, :], np.iinfo(np.int64).max).min(axis=1))
            buckets = _places(kept[at], tab) if buckets is None else buckets
            for t in range(tab):
                pairs &= buckets[rows, t, None] != buckets[None, :, t]
            links[rows] = pairs @ weight
        some = (root != cls) | (links > 0)
        out.append(pd.DataFrame({"cls": cls[some], "links": links[some], "root": root[some]}))
    return pd.concat(out)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors link within a label when their cosine, in double precision, is at least `threshold`.
    Null labels, null or zero vectors, null or non-finite components link with nothing and are
    their own component; vectors of different lengths never link.  Repeated rows are equal
    vectors and link.  Rows are told apart by their vectors and labels, not by vec_id: rows that share an id
    link and count like any others, and rows without one link too, and have the smallest id that their component
    has, or null.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", embedding.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    keys = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding", "label").alias("k2")]
    keyed = rows.select("*", *keys)
    classes = keyed.where("sound").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "embedding-classes")  # numbers of their own
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, threshold, recall)
    hashed = _hashed(classes, bits, tables)  # cheaper to hash twice than to write
    place = ["label", "tab", "bucket"]
    split = hashed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = materialise(split.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "embedding-split")
    met = hashed.join(split, place)
    slots = max(8 * partitions(spark), -(-tables * input_bytes(classes) // SLOT_BYTES))
    slot = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(slots))
    most, found_at = far(threshold), f"label {classes.schema['label'].dataType.simpleString()}, tab int, bucket long, cls long"
    small = met.where("blocks = 1").withColumn("slot", slot(*place)).drop("blocks")
    small = small.groupBy("slot").applyInPandas(lambda pdf: _not_alone(pdf, most), found_at).withColumn("blocks", F.lit(1))
    suspects = materialise(small.unionByName(met.where("blocks > 1").select(*small.columns)), "embedding-suspects")
    kept = suspects.groupBy("cls").agg(F.flatten(F.collect_list(F.array(F.col("tab").cast("long"), "bucket"))).alias("kept"))
    vectors_of = classes.select("cls", "label", "weight", "embedding").join(kept, "cls")
    fetched = suspects.drop("label").join(vectors_of, "cls")
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    fetched = fetched.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fetched = fetched.withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with"))
    fetched = fetched.withColumn("slot", slot(*place, "one", "other"))
    found = fetched.groupBy("slot").applyInPandas(lambda pdf: _compare(pdf, threshold), "cls long, links long, root long")
    found = materialise(found, "embedding-links")
    discard(split, suspects)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    label = connect(found.where("cls <> root").select("cls", "root")).toDF("node", "component")
    # the least vec_id of each component, written first so that Spark may split a large one's side of the join
    named = label.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    named = materialise(named, "embedding-components")
    known = classes.select("k1", "k2", "cls", "weight", "least").join(links, "cls", "left").join(label, F.col("cls") == F.col("node"), "left").join(named, "component", "left")
    first = F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("first"))
    known = known.select("k1", "k2", "weight", F.coalesce("links", F.lit(0)).alias("links"), first.alias("component"))
    out = keyed.select("vec_id", "sound", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(F.col("sound"), F.col("links") + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole embeddings table."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
