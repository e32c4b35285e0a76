"""Packed exchanges: many small keyed entries of a block of texts travel as a few binary rows.

A block is a chunk of a scan partition; its number comes from the partition's and the
chunk's, so a task that runs again gives the same blocks.  A block sends each key
partition one row with its entries as packed numpy records (10 to 34 bytes an entry,
where a row of its own would take two to three times that), and at most a bounded number
of entries per key: what a block can settle by itself never travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, chunks, input_bytes, partitions

SCHEMA = "part int, block long, payload binary"
#: Key partitions per shuffle partition, so that hashing them evens out, and bytes of input per key
#: partition at most, so that a key partition (one frame in a task) doesn't grow with the input.
PARTS = 4
PART_BYTES = 16_000_000


def parts_of(docs: DataFrame) -> int:
    return max(PARTS * partitions(docs.sparkSession), -(-input_bytes(docs) // PART_BYTES))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The key partition, by the upper half of the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def blocks(
    batches: Iterator[pa.RecordBatch], block_texts: Callable[[pa.RecordBatch, int, list[bytes], int], Iterator[tuple[int, int, bytes]]], limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Runs `block_texts(batch, first row, texts, block number)` over the chunks of all batches
    (text is the last column) and yields its (part, block, payload) rows."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, texts in chunks(batch.column(batch.num_columns - 1), limit):
            rows = list(block_texts(batch, first, texts, number))
            number += 1
            for i in range(0, len(rows), 4096):
                columns = list(zip(*rows[i : i + 4096], strict=True))
                types = (pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["part", "block", "payload"])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return start, np.append(start[1:], len(values))


def split(keys: np.ndarray, entries: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed entries) for entries with these keys."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    part, entries = part[order], entries[order]
    for a, b in zip(*runs(part), strict=True):
        yield int(part[a]), entries[a:b].tobytes()


def by_part(sent: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Brings the rows of each key partition together."""
    return sent.groupBy("part").applyInPandas(work, schema)


# ------------------------------------------------------------------ asking about places

#: A place of a text of a block: from word `at` on, `size` words.
HIT = np.dtype([("doc", "<u2"), ("at", "<u4"), ("size", "<u4")])
SPAN = np.dtype([("at", "<u4"), ("size", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("text", "<i8")])
LAST = np.iinfo(np.int64).max  # a null doc_id comes after all others


def hits(doc: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(doc), HIT)
    out["doc"], out["at"], out["size"] = doc, at, size
    return out


def ids_of(batch: pa.RecordBatch, first: int, count: int) -> np.ndarray:
    return batch.column(0).slice(first, count).fill_null(LAST).to_numpy(zero_copy_only=False)


def ask(
    docs: DataFrame,
    entries: Callable[[pa.RecordBatch, int, list[bytes]], tuple[np.ndarray, np.ndarray]],
    judge: Callable[[np.ndarray], np.ndarray],
    kind: np.dtype,
) -> DataFrame:
    """doc_id, text_key, spans (packed SPANs, never empty) of the rows of docs (doc_id, text_key, .., text).

    `entries(batch, first row, texts)` gives a block's entries (records of `kind`, with fields key,
    doc, at and perhaps size) and the hits that it could settle by itself.  All entries of one key
    meet in a frame, of which `judge` says which entries are hits.  Answers go back to their block,
    which knows its documents, so an entry needn't name its document to others.
    """
    parts = parts_of(docs)
    sized = "size" in kind.names

    def send(batch: pa.RecordBatch, first: int, texts: list[bytes], block: int) -> Iterator[tuple[int, int, bytes]]:
        asked, known = entries(batch, first, texts)
        if not len(asked) and not len(known):
            return
        own = np.empty(len(texts), _DOC)
        own["id"], own["text"] = ids_of(batch, first, len(texts)), batch.column(1).slice(first, len(texts)).to_numpy(zero_copy_only=False)
        yield block % parts, block, b"\0" + own.tobytes()
        if len(known):
            yield block % parts, block, b"\2" + known.tobytes()
        for part, packed in split(asked["key"], asked, parts):
            yield part, block, b"\1" + packed

    def answer(sent: pd.DataFrame) -> pd.DataFrame:
        out, found, owner, numbers = [], [], [], []
        for number, payload in zip(sent["block"], sent["payload"], strict=True):
            if payload[0] != 1:
                out.append((number, payload))
                continue
            found.append(np.frombuffer(payload, kind, offset=1))
            owner.append(np.full(len(found[-1]), len(numbers)))
            numbers.append(number)
        if found:
            found, owner = np.concatenate(found), np.concatenate(owner)
            yes = judge(found)
            found, owner = found[yes], owner[yes]
            order = np.argsort(owner, kind="stable")
            found, owner = found[order], owner[order]
            hit = hits(found["doc"], found["at"], found["size"] if sized else 0)
            out += [(numbers[owner[a]], b"\2" + hit[a:b].tobytes()) for a, b in zip(*runs(owner), strict=True)]
        return pd.DataFrame(out, columns=["block", "payload"])

    def resolve(sent: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([np.frombuffer(p, _DOC, offset=1) for p in sent["payload"] if p[0] == 0])
        some = [np.frombuffer(p, HIT, offset=1) for p in sent["payload"] if p[0] == 2]
        some = np.concatenate(some) if some else np.empty(0, HIT)
        some = some[np.lexsort((some["size"], some["at"], some["doc"]))]
        span = np.empty(len(some), SPAN)
        span["at"], span["size"] = some["at"], some["size"]
        start, end = runs(some["doc"])
        who = own[some["doc"][start]]
        packed = [span[a:b].tobytes() for a, b in zip(start, end, strict=True)]
        return pd.DataFrame({"doc_id": who["id"], "text_key": who["text"], "spans": packed})

    sent = docs.mapInArrow(lambda batches: blocks(batches, send), SCHEMA)
    back = by_part(sent, answer, "block long, payload binary")
    return back.groupBy("block").applyInPandas(resolve, "doc_id long, text_key long, spans binary")
