"""Substring deduplication by recompression, in Spark rounds.

Symbols of the recompressed texts (see recompress) have global names: equal substrings have
equal interior symbols wherever they are.  Each round asks, of all texts that are still in
question, which symbols have another place too, and only what is shared goes on:

1. Low symbols.  Every window has an anchor, the least low symbol in it.  Equal windows have
   equal anchors, so windows whose anchor has no other place can't repeat.  What stays are
   the zones of a text whose anchors are shared.
2. High symbols of the zones, of all levels, from twice the window up.  Two places of one name
   (128 bits: the name and a hash of its words) verify a repeat of the symbol's whole length:
   all windows inside are removed at every place but the first.
3. Windows at the edges: those of the zones that no repeat of round 2 covers are compared by
   128 bits each (anchor and hash), and all but the first place of each are removed.

A text whose words are those of a smaller doc_id is a copy: all of it is removed before.  All
rounds send a key at most twice per block of texts, so a passage that a third of all documents
share is a few entries per block, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, chunks, discard, hash_words, materialise, mix, table
from .exchange import HIT, LAST, SPAN, ask, hits, ids_of
from .recompress import anchors, high_symbols

WINDOW = 20

_LOW = np.dtype([("key", "<u8"), ("tag", "<u4"), ("tag2", "<u2"), ("doc", "<u2"), ("at", "<u4")])
_HIGH = np.dtype([("key", "<u8"), ("hash", "<u8"), ("id", "<i8"), ("at", "<u4"), ("size", "<u4"), ("doc", "<u2")])
_WIN = np.dtype([("key", "<u8"), ("hash", "<u8"), ("id", "<i8"), ("at", "<u4"), ("doc", "<u2")])
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _info(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, kept_sha256 (of all words) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for _, texts in chunks(batch.column(2)):
                for text in texts:
                    words = text.split()
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, type=pa.int64()), pa.array(sha, type=pa.string())],
                names=["doc_id", "text_key", "n_words", "kept_sha256"],
            )

    return docs.mapInArrow(work, "doc_id long, text_key long, n_words long, kept_sha256 string")


# ------------------------------------------------------------------ round 1: low symbols


def _shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, spans (of size 0): the anchors' places of each document that are shared,
    where the same place of two copies counts once."""

    def entries(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, other, counts = hash_words(texts)
        doc = np.repeat(np.arange(len(texts)), counts)
        roll = Rolling(other)
        starts, key, place = anchors(h, doc, roll, window)
        if not len(starts):
            return np.empty(0, _LOW), np.empty(0, HIT)
        ends = np.cumsum(counts)
        whole = roll.of(ends - counts, ends)
        _, one = np.unique(place, return_index=True)  # one entry per anchor
        key, place, owner = key[one], place[one], doc[starts[one]]
        at = place - (ends - counts)[owner]
        with np.errstate(over="ignore"):  # the same at one place of equal texts
            tag = mix(whole[owner] + at.astype(np.uint64) * _GOLD)
        ids = ids_of(batch, first, len(texts))[owner]
        order = np.lexsort((ids, tag, key))
        key, tag, owner, ids, at = key[order], tag[order], owner[order], ids[order], at[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        fresh = new | np.concatenate(([True], tag[1:] != tag[:-1]))
        nth = np.cumsum(fresh)
        shared = (np.bincount(group, weights=fresh) > 1)[group]
        # a key known to be shared sends two different tags, so that other blocks learn it and needs
        # no answer; else of copies the first asks for all
        leads = ids == ids[np.flatnonzero(fresh)[nth - 1]]
        send = np.where(shared, fresh & (nth - nth[np.flatnonzero(new)][group] < 2), leads)
        out = np.empty(int(send.sum()), _LOW)
        out["key"], out["tag"], out["tag2"] = key[send], tag[send] >> np.uint64(32), (tag[send] >> np.uint64(16)) & np.uint64(0xFFFF)
        out["doc"], out["at"] = owner[send], at[send]
        return out, hits(owner[shared], at[shared], 0)

    def judge(found: np.ndarray) -> np.ndarray:
        order = np.argsort(found["key"], kind="stable")
        key, at = found["key"][order], found["at"][order]
        tag = found["tag"][order].astype(np.uint64) << np.uint64(16) | found["tag2"][order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        differ = np.zeros(len(start), bool)
        for x in (tag, at):
            differ |= np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start)
        out = np.empty(len(found), bool)
        out[order] = np.repeat(differ, np.diff(np.append(start, len(found))))
        return out

    return ask(docs, entries, judge, _LOW)


# ------------------------------------------------------------------ rounds 2 and 3


def _later(found: np.ndarray) -> np.ndarray:
    """Which entries have the name of one at an earlier place."""
    order = np.lexsort((found["at"], found["id"], found["hash"], found["key"]))
    some = found[order]
    new = np.ones(len(some), bool)
    new[1:] = (some["key"][1:] != some["key"][:-1]) | (some["hash"][1:] != some["hash"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(found), bool)
    out[order] = (some["id"] != some["id"][head]) | (some["at"] != some["at"][head])
    return out


def _settled(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that a block can't settle by itself (one per name and place), and its hits."""
    later = _later(found)
    return found[~later], hits(found["doc"][later], found["at"][later], found["size"][later] if "size" in found.dtype.names else 0)


def _spans(column: pa.Array, first: int, count: int) -> list[np.ndarray]:
    """The spans of each text of a block; the column holds lists of packed SPANs, or null."""
    return [np.frombuffer(b"".join(v.as_py() or ()), SPAN) for v in column.slice(first, count)]


class Zones:
    """The windows of a block of texts whose anchors are shared: `starts` (in the block), their
    anchors' keys, and `doc`; `inside(a, b)` says whether all windows of the words [a, b) are."""

    def __init__(self, batch: pa.RecordBatch, first: int, texts: list[bytes], window: int):
        self.window = window
        self.h, other, counts = hash_words(texts)
        self.begin = np.cumsum(counts) - counts
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.roll = Rolling(other)
        starts, key, place = anchors(self.h, self.doc, self.roll, window)
        shared = np.zeros(len(self.h) + 1, bool)
        for i, span in enumerate(_spans(batch.column(2), first, len(texts))):
            shared[self.begin[i] + span["at"].astype(np.int64)] = True
        some = shared[place]
        self.starts, self.key = starts[some], key[some]
        self.outside = np.ones(len(self.h) + 1, np.int64)
        self.outside[self.starts] = 0
        self.outside = np.concatenate(([0], np.cumsum(self.outside)))

    def inside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.outside[b - self.window + 1] == self.outside[a]


def _long_repeats(texts_: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, spans: high symbols that also have an earlier place; rows (doc_id, text_key, zones, text)."""

    def entries(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        zones = Zones(batch, first, texts, window)
        ids = ids_of(batch, first, len(texts))
        out = [np.empty(0, _HIGH)]
        for name, start, end in high_symbols(zones.h, zones.doc, 2 * window):
            some = zones.inside(start, end)
            name, start, end = name[some], start[some], end[some]
            owner = zones.doc[start]
            entry = np.empty(len(name), _HIGH)
            entry["key"], entry["hash"], entry["id"], entry["doc"] = name, zones.roll.of(start, end), ids[owner], owner
            entry["at"], entry["size"] = start - zones.begin[owner], end - start
            out.append(entry)
        return _settled(np.concatenate(out))

    return ask(texts_, entries, _later, _HIGH)


def _edge_repeats(texts_: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, spans (of size 0): starts of windows outside the long repeats that also
    have an earlier place; rows (doc_id, text_key, zones, long, text)."""

    def entries(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        zones = Zones(batch, first, texts, window)
        ids = ids_of(batch, first, len(texts))
        step = np.zeros(len(zones.h) + 1, np.int64)
        for i, span in enumerate(_spans(batch.column(3), first, len(texts))):
            at = zones.begin[i] + span["at"].astype(np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + span["size"].astype(np.int64) - window + 1, -1)
        some = np.cumsum(step)[zones.starts] == 0
        start = zones.starts[some]
        owner = zones.doc[start]
        out = np.empty(len(start), _WIN)
        out["key"], out["hash"], out["id"], out["doc"] = zones.key[some], zones.roll.of(start, start + window), ids[owner], owner
        out["at"] = start - zones.begin[owner]
        return _settled(out)

    return ask(texts_, entries, _later, _WIN)


# ------------------------------------------------------------------ the cut


def kept_words(text: bytes, spans: np.ndarray, window: int) -> tuple[list[bytes], int]:
    """The words that no removed span covers, and how many are covered; a span of size 0 is a window."""
    words = text.split()
    step = np.zeros(len(words) + 1, dtype=np.int64)
    at, size = spans["at"].astype(np.int64), spans["size"].astype(np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + np.where(size == 0, window, size), -1)
    covered = np.cumsum(step[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c], int(covered.sum())


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, n_removed, cut_sha256 for rows (doc_id, text_key, spans, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for spans, text in zip(batch.column(2), batch.column(3), strict=True):
                kept, n = kept_words((text.as_py() or "").encode(), np.frombuffer(b"".join(spans.as_py()), SPAN), window)
                removed.append(n)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, type=pa.int64()), pa.array(sha, type=pa.string())],
                names=["doc_id", "text_key", "n_removed", "cut_sha256"],
            )

    return docs.mapInArrow(work, "doc_id long, text_key long, n_removed long, cut_sha256 string")


KEYS = ["doc_id", "text_key"]


def _listed(found: DataFrame, name: str) -> DataFrame:
    """A row per document with all its spans; only repeated rows and rounds bring more than one list."""
    return found.groupBy(*KEYS).agg(F.collect_list("spans").alias(name))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of (doc_id, text).

    A window is removed if its words also start earlier, by (doc_id, start); a null doc_id
    comes last, and rows that share a doc_id count as one document.  Texts of fewer words
    than a window, empty and null texts lose nothing; an empty table gives an empty result.
    A very long text takes memory in proportion to its own length, in the task that reads it.
    Other columns are ignored.
    """
    whole = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"
    )
    info = materialise(_info(whole), "substring-documents")
    long = info.where(F.col("n_words") >= window)
    firsts = long.groupBy("kept_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = materialise(firsts, "substring-firsts")  # written first, so that Spark may split a hot group's side of the join
    copies = materialise(long.join(firsts, "kept_sha256").where("doc_id > first").select(*KEYS).distinct(), "substring-copies")
    zones = _listed(_shared_anchors(whole, window).join(copies, KEYS, "left_anti"), "zones")
    zones = materialise(zones, "substring-zones")
    texts = materialise(whole.join(zones, KEYS).select(*KEYS, "zones", "text"), "substring-texts")
    repeats = materialise(_long_repeats(texts, window), "substring-long")
    rest = texts.join(_listed(repeats, "long"), KEYS, "left").select(*KEYS, "zones", "long", "text")
    edges = materialise(_edge_repeats(rest, window), "substring-edges")
    spans = _listed(repeats.union(edges), "spans")
    cut = _cut(texts.join(spans, KEYS).select(*KEYS, "spans", "text"), window).dropDuplicates(KEYS)
    cut = materialise(cut, "substring-cut")
    discard(firsts, zones, texts, repeats, edges)
    empty = hashlib.sha256(b"").hexdigest()
    out = info.join(cut, KEYS, "left").join(copies.withColumn("copy", F.lit(True)), KEYS, "left")
    return out.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
    )


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole documents table."""
    return dedup(table(spark, sf_dir, "documents"))
