"""N-gram Jaccard join by multiple-global-order filtering.

Equal shingle sets form classes (by 128 bits); only classes are compared.  Shingles are
ordered globally in several ways.  All put first what only one class holds; then the first
order goes by the number of classes that hold a shingle, rarest first, and each other one by
a hash of its own, whatever the number.  In any one global order, two sets with a Jaccard
similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each, so a
pair must share such a prefix shingle in every order.  A shingle that only one class
holds joins with nothing, so most classes have no shingle left to join on.

Components are what is asked for, so pairs that are already connected need no look:
first every class of a posting list is compared with the list's hubs; then only pairs of
classes from different components are compared, all of them.  A posting list of the first
order that would make too many such pairs is split by the prefix shingles of the second, and
then of the third: who can link shares these too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Rolling, discard, hash_words, input_bytes, materialise, mix, partitions, table
from .components import connect
from .exchange import SCHEMA, blocks, by_part, part_of, runs

SHINGLE = 4
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
ORDERS = 3
#: Shingles that more classes hold count as held by this many: they come last in any case,
#: and a block of texts need not send more of them than this.
COMMON = 33
#: Hubs of a posting list.
HUBS = 6
#: Words of the parity sketch of a set (64 bits each).
SKETCH = 8

#: Bytes of text of a block, and of input for each key partition.
BLOCK_BYTES, PART_BYTES = 4_000_000, 4_000_000

#: Pairs of a posting list above which it is split by the next order.
LIST_PAIRS = 1_000_000

#: A class as one posting list knows it: 64 bits of its digest, its place in the block, and how many
#: of the shingles that follow are its.
_TAG = np.dtype([("tag", "<u8"), ("doc", "<u2"), ("n", "<u4")])
_SETS = np.dtype([("digest", "<u8", 2), ("size", "<u4")])
_BACK = np.dtype([("hash", "<u8"), ("doc", "<u2"), ("held", "u1")])


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash and text of every distinct shingle (sorted by text, then hash), and set sizes.

    Words are lower-cased (A-Z); a text of fewer than k words has its words as one shingle.
    """
    h, _, counts = hash_words(texts, lower=True)
    ends = np.cumsum(counts)
    width = np.minimum(counts, k)
    per_text = np.where(counts > 0, counts - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), per_text)
    first = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + np.repeat(ends - counts, per_text)
    value = Rolling(h).of(first, first + width[text])
    order = np.argsort(value)  # equal ones of a text are one, so ties don't matter
    value, text = value.take(order), text.take(order)
    order = np.argsort(text.astype(np.uint16) if len(texts) <= 1 << 16 else text, kind="stable")  # 16 bits are sorted by radix
    value, text = value.take(order), text.take(order)
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, text, np.bincount(text, minlength=len(texts))


def block_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets() of a block's texts, a chunk at a time, which a processor's caches hold."""
    chunk = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
    found = [shingle_sets(texts[a:b], k) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.concatenate([v for v, _, _ in found]), np.concatenate([t + a for a, (_, t, _) in zip(cuts, found, strict=False)]), np.concatenate([n for _, _, n in found])


def digests(value: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A digest of two 64-bit words of each set of hashes; empty sets have zeros."""
    out = np.zeros((len(sizes), 2), np.uint64)
    if len(value):
        start, _ = runs(text)
        with np.errstate(over="ignore"):
            for i, salt in enumerate((0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B)):
                out[text[start], i] = mix(np.add.reduceat(mix(value ^ np.uint64(salt)), start) + sizes[text[start]].astype(np.uint64))
    return out


def key_parts(docs: DataFrame) -> int:
    """Key partitions, by the input's bytes: a block sends a row to each, so rows grow with the product of both."""
    return max(partitions(docs.sparkSession), -(-input_bytes(docs) // PART_BYTES))


def packed_by_part(value: np.ndarray, owner: np.ndarray, digest: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, payload): the tags of the part's classes, then their shingles; entries come sorted by owner, then value."""
    part = part_of(value, parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # 16 bits are sorted by radix
    value, owner, part = value.take(order), owner.take(order), part.take(order)
    start, end = runs(part * (len(digest) + 1) + owner)
    tags = np.empty(len(start), _TAG)
    tags["doc"], tags["n"] = owner.take(start), end - start
    tags["tag"] = digest.take(owner.take(start))
    first, last = runs(part.take(start))
    values, tagged = value.tobytes(), tags.tobytes()
    lists = zip(part.take(start.take(first)).tolist(), first.tolist(), last.tolist(), start.take(first).tolist(), end.take(last - 1).tolist(), strict=True)
    for p, a, b, i, j in lists:
        yield p, (b - a).to_bytes(8, "little") + tagged[a * _TAG.itemsize : b * _TAG.itemsize] + values[8 * i : 8 * j]


def _sent(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """Of (doc_id, text_key, text), in one pass over the texts: every block's classes (payload 0) and rows
    (payload 2: doc_id, text_key, digest, n_shingles), by block, and its packed shingles (by shingle)."""

    def send(batch: pa.RecordBatch, first: int, texts: list[bytes], block: int) -> Iterator[tuple[int, int, bytes]]:
        value, text, sizes = block_sets(texts, k)
        digest = digests(value, text, sizes)
        own = batch.slice(first, len(texts))
        columns = [own.column(0), own.column(1), pa.array([d.tobytes() for d in digest], type=pa.binary()), pa.array(sizes.astype(np.int64))]
        yield block % parts, block, b"\2" + ipc_bytes(pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "digest", "n_shingles"]))
        _, lead = np.unique(digest, axis=0, return_index=True)
        lead = np.sort(lead[sizes[lead] > 0])  # of equal sets one is enough
        if not len(lead):
            return
        place = np.full(len(sizes), -1)
        place[lead] = np.arange(len(lead))
        sets = np.empty(len(lead), _SETS)
        sets["digest"], sets["size"] = digest[lead], sizes[lead]
        owner = place[text]
        own = owner >= 0
        value, owner = value[own], owner[own]
        # a shingle that COMMON classes of the block hold is known to be common: the others
        # needn't hear of more, and its holders need no answer
        order = np.argsort(value)
        start, end = runs(value.take(order))
        often = np.flatnonzero(end - start >= COMMON)
        n = (end - start).take(often)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        known = order.take(nth + np.repeat(start.take(often), n))
        back = np.empty(len(known), _BACK)
        back["hash"], back["doc"], back["held"] = value[known], owner[known], COMMON
        head = np.array([len(sets), len(back)], "<u8").tobytes()
        yield block % parts, block, b"\0" + head + sets.tobytes() + back.tobytes()
        travels = np.ones(len(value), bool)
        travels[known[nth >= COMMON]] = False
        for part, payload in packed_by_part(value[travels], owner[travels], sets["digest"][:, 0], parts):
            yield part, block, b"\1" + payload

    return docs.mapInArrow(lambda batches: blocks(batches, send, BLOCK_BYTES), SCHEMA)


def ipc_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(raw: DataFrame, key: str) -> DataFrame:
    """doc_id, text_key, digest, n_shingles of every row, from the blocks' packed ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                yield from pa.ipc.open_stream(rows.as_py())

    return raw.where("rows IS NOT NULL").select("rows").mapInArrow(work, f"doc_id {key}, text_key long, digest binary, n_shingles long")


def _count(sent: pd.DataFrame) -> pd.DataFrame:
    """For one key partition: to each block, the shingles of its classes that other classes hold
    too, and by how many.  Of a class in several blocks only the first block counts and hears (where COMMON
    classes of that block hold a shingle, its holders know, and enough of them travel)."""
    out, shorts, tags, numbers = [], [], [], []
    for number, payload in sorted(zip(sent["block"], sent["payload"], strict=True), key=lambda row: row[0]):
        if payload[0] != 1:
            out.append((number, payload))
            continue
        n = int(np.frombuffer(payload, "<u8", 1, 1)[0])
        tags.append(np.frombuffer(payload, _TAG, n, 9))
        shorts.append(np.frombuffer(payload, "<u8", offset=9 + n * _TAG.itemsize))
        numbers.append(number)
    if shorts:
        block = np.repeat(np.arange(len(tags)), list(map(len, tags)))
        tags, short = np.concatenate(tags), np.concatenate(shorts)
        first = np.zeros(len(tags), bool)
        first[np.unique(tags["tag"], return_index=True)[1]] = True
        if not first.all():
            short = short[np.repeat(first, tags["n"])]
            tags, block = tags[first], block[first]
        order = np.argsort(short)
        start, end = runs(short.take(order))
        held = np.empty(len(short), np.uint8)
        held[order] = np.repeat(np.minimum(end - start, COMMON).astype(np.uint8), end - start)
        several = np.flatnonzero(held > 1)
        tag = np.repeat(np.arange(len(tags)), tags["n"]).take(several)
        back = np.empty(len(several), _BACK)
        back["hash"], back["doc"], back["held"] = short.take(several), tags["doc"].take(tag), held.take(several)
        start, end = runs(block.take(tag))
        out += [(numbers[block[tag[a]]], b"\1" + back[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    return pd.DataFrame(out, columns=["block", "payload"])


SKETCHES = [f"s{i}" for i in range(SKETCH)]


def parity(hashes: np.ndarray) -> np.ndarray:
    """A set's parity sketch: each element flips one of 64 * SKETCH bits.  Two sketches differ
    in at most as many bits as the sets differ in elements."""
    bit = mix(hashes ^ np.uint64(0x5BD1E995)) % np.uint64(64 * SKETCH)
    odd = (np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def may_link(a: str, b: str, threshold: int) -> Column:
    """False only for pairs that can't link.  With n elements in both sets together, a link
    has at most n * (100 - t) / (100 + t) elements in one set only; at least those no other
    class holds are, and one for every bit in which the sketches differ."""
    part = lambda c: (F.col(f"{c}_{a}"), F.col(f"{c}_{b}"))
    (size_a, size_b), (alone_a, alone_b) = part("size"), part("alone")
    differ = reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in map(part, SKETCHES)], alone_a + alone_b)
    return (100 * F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)) & ((100 + threshold) * differ <= (100 - threshold) * (size_a + size_b))


def _prefixes(sent: pd.DataFrame, threshold: int, orders: int) -> pd.DataFrame:
    """For one block: its packed rows, as a row of their own, and each class with a joinable prefix, its shared
    shingles, its prefixes."""
    sets, backs, rows = None, [np.empty(0, _BACK)], []
    for payload in sent["payload"]:
        if payload[0] == 2:
            rows.append({"rows": payload[1:], "size": 0} | dict.fromkeys(SKETCHES, 0))
        elif payload[0] == 0:
            n, m = (int(x) for x in np.frombuffer(payload, "<u8", 2, 1))
            sets = np.frombuffer(payload, _SETS, n, 17)
            backs.append(np.frombuffer(payload, _BACK, m, 17 + n * _SETS.itemsize))
        else:
            backs.append(np.frombuffer(payload, _BACK, offset=1))
    back = np.concatenate(backs)
    back = back[np.lexsort((-back["held"].astype(int), back["hash"], back["doc"]))]
    fresh = np.ones(len(back), bool)  # a block's common shingles may be answered as well
    fresh[1:] = (back["hash"][1:] != back["hash"][:-1]) | (back["doc"][1:] != back["doc"][:-1])
    back = back[fresh]
    for a, b in zip(*runs(back["doc"]), strict=True):
        size = int(sets["size"][back["doc"][a]])
        prefix = size - (threshold * size + 99) // 100 + 1 - (size - (b - a))
        if prefix <= 0:
            continue
        hashes, held = back["hash"][a:b], back["held"][a:b]
        row = {"digest": sets["digest"][back["doc"][a]].tobytes(), "size": size, "shared": hashes.astype(np.int64)}
        row |= dict(zip(SKETCHES, parity(hashes).tolist(), strict=True))
        for k in range(orders):
            with np.errstate(over="ignore"):
                own = mix(hashes + np.uint64(k * 0x1000193))
            order = np.argsort(own) if k else np.lexsort((own, held))
            row[f"prefix{k}"] = hashes[order[:prefix]].astype(np.int64)
        rows.append(row)
    columns = ["rows", "digest", "size", "shared", *SKETCHES, *[f"prefix{k}" for k in range(orders)]]
    return pd.DataFrame([tuple(map(row.get, columns)) for row in rows], columns=columns)


def _verified(pairs: DataFrame, active: DataFrame, threshold: int, orders: int) -> DataFrame:
    """The pairs (a, b) that link: filters first, then the exact intersection.

    Shingles that only one class holds are in no intersection, so the shared ones suffice.
    """
    side = active.select("digest", "size", "alone", "shared", *SKETCHES, *[f"prefix{k}" for k in range(1, orders)])
    left = side.select([F.col(c).alias(f"{c}_a") for c in side.columns])
    right = side.select([F.col(c).alias(f"{c}_b") for c in side.columns])
    both = pairs.join(left, pairs["a"] == left["digest_a"]).join(right, pairs["b"] == right["digest_b"])
    may = reduce(Column.__and__, [F.arrays_overlap(f"prefix{k}_a", f"prefix{k}_b") for k in range(1, orders)], may_link("a", "b", threshold))
    shared = F.size(F.array_intersect("shared_a", "shared_b"))
    return both.where(may).where(100 * shared >= threshold * (F.col("size_a") + F.col("size_b") - shared)).select("a", "b")


def _pairs_of_list() -> tuple[Column, Column]:
    """Of a list, from (n, component) rows: its components, and at least half the pairs of classes that it costs."""
    return F.count(F.lit(1)).alias("components"), (F.sum("n").cast("double") * (F.sum("n") - F.max("n"))).alias("pairs")


def _open_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs of classes with one key, from different components, that may link."""
    own = ("digest", "component", "size", "alone", *SKETCHES)
    x = rows.where("component <> main").select("key", *[F.col(c).alias(f"{c}_x") for c in own])
    y = rows.select("key", "main", *[F.col(c).alias(f"{c}_y") for c in own])
    once = (F.col("component_y") == F.col("main")) | (F.col("digest_x") < F.col("digest_y"))
    met = x.join(y, "key").where("component_x <> component_y").where(once & may_link("x", "y", threshold))
    return met.select(F.least("digest_x", "digest_y").alias("a"), F.greatest("digest_x", "digest_y").alias("b"))


def class_links(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, digest, n_shingles of every row of (doc_id, text_key, text); and digest, component: the
    classes that link with another one and the least digest of their component."""
    heard = by_part(_sent(docs, k, key_parts(docs)), _count, "block long, payload binary")
    arrays = ", ".join(f"prefix{i} array<long>" for i in range(orders))
    schema = f"rows binary, digest binary, size int, shared array<long>, {', '.join(f'{c} long' for c in SKETCHES)}, {arrays}"
    raw = materialise(heard.groupBy("block").applyInPandas(lambda sent: _prefixes(sent, threshold, orders), schema), "jaccard-blocks")
    known = materialise(_rows(raw, docs.schema["doc_id"].dataType.simpleString()), "jaccard-documents")
    active = raw.where("rows IS NULL").drop("rows")
    # a class whose texts lie in several blocks may come from each; the first heard of all its shingles
    whole = F.max_by(F.struct(*active.columns), F.size("shared"))
    active = materialise(active.groupBy("digest").agg(whole.alias("c")).select("c.*", (F.col("c.size") - F.size("c.shared")).alias("alone")), "jaccard-classes")
    discard(raw)
    posting = materialise(active.select("digest", "alone", F.explode("prefix0").alias("token")), "jaccard-postings")
    # classes with few shingles of their own are near the middle of their group; chance makes the hubs differ
    distance = [(F.col("alone") + 1) * (1000 + F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(1000))) for i in range(HUBS)]
    least = [F.min(F.struct(x, "digest")) for x in distance]
    hubs = F.array_distinct(F.transform(F.array(*least), lambda x: x["digest"]))
    # written before the join, so that Spark may split a hot token's side of it
    hub = posting.groupBy("token").agg(hubs.alias("hubs"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hub = materialise(hub.drop("n"), "jaccard-hubs")
    pairs = posting.join(hub, "token").select("digest", F.explode("hubs").alias("hub")).where("digest <> hub")
    pairs = pairs.select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct()
    links = materialise(_verified(pairs, active, threshold, orders), "jaccard-links")
    label = materialise(_labels(active, links), "jaccard-components")
    # the rest: pairs from different components.  Of a list's components the one with most
    # classes isn't joined with itself, so a list costs (classes outside it) * (classes).
    held = posting.drop("alone").join(label, "digest")
    parted = held.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = parted.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), *_pairs_of_list()).where("components > 1")
    lists = materialise(lists, "jaccard-lists")
    # filters stand in the join itself, so that only pairs that may link are ever rows
    sketch = active.select("digest", "size", "alone", *SKETCHES)
    rows = held.join(lists.drop("components"), "token").withColumn("key", F.xxhash64("token"))
    rows = materialise(rows.join(sketch, "digest"), "jaccard-open")
    ready, written = [], [lists, rows]
    for k in range(1, orders):
        hot = rows.where(f"pairs > {LIST_PAIRS}")
        ready.append(rows.where(f"pairs <= {LIST_PAIRS}"))
        if not hot.head(1):
            break
        # who can link shares a prefix shingle of the next order as well
        prefix = active.select("digest", F.explode(f"prefix{k}").alias("next"))
        hot = hot.drop("pairs").join(prefix, "digest").withColumn("key", F.xxhash64("key", "next")).drop("next")
        parted = hot.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        lists = parted.groupBy("key").agg(*_pairs_of_list()).where("components > 1").drop("components")
        rows = materialise(hot.join(lists, "key").select(ready[0].columns), "jaccard-open")
        written.append(rows)
    else:
        ready.append(rows)
    pairs = reduce(DataFrame.unionByName, [_open_pairs(r, threshold) for r in ready]).distinct()
    more = materialise(_verified(pairs, active, threshold, orders), "jaccard-links")
    # components of components: the first ones' labels stand for their classes
    a, b = label.toDF("a", "ca"), label.toDF("b", "cb")
    joined = connect(more.join(a, "a").join(b, "b").select("ca", "cb")).toDF("component", "c")
    final = label.join(joined, "component", "left").select("digest", F.coalesce("c", "component").alias("component"))
    final = materialise(final, "jaccard-components")
    discard(active, posting, hub, links, label, *written, more)
    return known, final


def _labels(active: DataFrame, links: DataFrame) -> DataFrame:
    """digest, component of every class; a class without links is its own component."""
    found = connect(links).toDF("digest", "c")
    return active.select("digest").join(found, "digest", "left").select("digest", F.coalesce("c", "digest").alias("component"))


def join_components(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, component for every row of (doc_id, text).

    component_id is the smallest doc_id reachable by links.  Texts without words, null texts
    included, link with nothing: their component is themselves.  Rows with equal sets link
    with each other; rows that share a doc_id are compared like any others, and rows without
    one take their component's smallest id.  Further columns tell rows apart that share an id:
    text_key hashes the text, and component (null without words) is the same for linked rows.
    An empty table gives an empty result; a very long text takes memory in proportion to its
    own length.  Other columns are ignored.
    """
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    known, label = class_links(docs, k, threshold)
    linked = label.where("component <> digest").withColumnRenamed("digest", "d")
    full = known.join(linked, known["digest"] == linked["d"], "left")
    full = full.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "digest")))
    least = full.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = materialise(least, "jaccard-least")
    out = full.join(least.withColumnRenamed("component", "c"), F.col("component") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "text_key", "component")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole documents table."""
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
