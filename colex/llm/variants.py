"""Spelling variant grouping by Bloom-guided neighbourhoods.

A vocabulary is counted over all texts.  Its words go into blocked Bloom filters, sharded by
length.  Each word then generates its neighbours and probes the filters with them: the words with one
letter less, and those with one letter replaced by a greater one.  That finds every pair of near words
once, an insertion from the longer word and a replacement from the lesser letter, so nothing need be
inserted.  Only neighbours that the filters know travel, to an exact join with the vocabulary
that removes the false positives.

Filters are broadcast in rounds of at most ROUND_BYTES, whatever the vocabulary: a round holds some
shards, and the neighbours that fall into others wait for theirs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, _splitmix, crc32_sql, discard, materialise, table

#: A run of letters in UTF-8 with A-Z lower-cased: a-z, and U+00C0 to U+00FF, whose bytes are C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: The letters of lower-cased runs; all of them are one byte in Latin-1.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.uint8)
#: The contract: a run whose checksum this divides loses a letter.
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10

#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: A filter's bits per word, blocks (of 64 bits, four of them set by a word) of a shard, and bytes of a round's broadcast.
BITS, SHARD, ROUND_BYTES = 24, 1 << 18, 64 << 20
#: Neighbours probed at once.
PROBES = 1 << 18

_LETTER = _splitmix(41, 256)
_PLACE = int(_splitmix(43, 1)[0])
_UNPLACE = np.uint64(pow(_PLACE, -1, 1 << 64))
_BLOCK, _BITS = _splitmix(47, 2)


def runs_of(doc_id: object, text: bytes) -> list[bytes]:
    """The runs of a text in UTF-8, lower-cased, and damaged where the checksum with the document's id says so."""
    found, seed = RUN.findall(text.lower()), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for i, run in enumerate(found):
        h = zlib.crc32(run, seed)
        if h % DAMAGED == 0:
            letters = run.decode()
            at = h % len(letters)
            found[i] = (letters[:at] + letters[at + 1 :]).encode()
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words of LEAST_LENGTH letters and LEAST_COUNT occurrences and more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            words = [(w.decode(), n) for w, n in counts.items() if len(w) >= LEAST_LENGTH]
            words = [(w, n) for w, n in words if len(w) >= LEAST_LENGTH]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                if text.is_valid:
                    counts.update(runs_of(doc_id.as_py(), text.as_py()))
                    if len(counts) > COUNTED:
                        yield counted()
                        counts.clear()
        yield counted()

    found = docs.select("doc_id", "text").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------ filters


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PLACE, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters as a matrix) for the words of each length."""
    latin = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(w) for w in latin], dtype=np.int64)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, np.frombuffer(b"".join(latin[i] for i in rows), dtype=np.uint8).reshape(len(rows), length)


def marks(key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key among so many, and its four bits there."""
    with np.errstate(over="ignore"):
        block = ((key * _BLOCK) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        x = (key * _BITS) >> np.uint64(40)
    one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
    mask = one << (x & low)
    for _ in range(3):
        x = x >> six
        mask |= one << (x & low)
    return block.astype(np.int64), mask


def blocks_of(words: int) -> int:
    return -(-words * BITS // 64)


def filters(words: DataFrame, counts: dict[int, int], size: int = SHARD) -> DataFrame:
    """length, shard, bits: the filters of all words, `size` blocks a row at most."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, letters in by_length(batch.column(0)):
                length = letters.shape[1]
                with np.errstate(over="ignore"):
                    key = (_LETTER[letters] * _powers(length)).sum(axis=1, dtype=np.uint64)
                block, mask = marks(key, blocks_of(counts[length]))
                for shard in np.unique(block // size):
                    some = block // size == shard
                    out.append((length, int(shard), np.concatenate([block[some].astype(np.uint64), mask[some]]).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("length", "shard", "bits"), r, strict=True)) for r in out], schema=schema)

    def build(sent: pd.DataFrame) -> pd.DataFrame:
        length, shard = int(sent["length"][0]), int(sent["shard"][0])
        bits = np.zeros(min(size, blocks_of(counts[length]) - shard * size), dtype=np.uint64)
        for packed in sent["bits"]:
            block, mask = np.frombuffer(packed, dtype=np.uint64).reshape(2, -1)
            np.bitwise_or.at(bits, block.astype(np.int64) - shard * size, mask)
        return pd.DataFrame({"length": [length], "shard": [shard], "bits": [bits.tobytes()]})

    schema = pa.schema([("length", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary())])
    kinds = "length long, shard long, bits binary"
    return words.select("word").mapInArrow(send, kinds).groupBy("length", "shard").applyInPandas(build, kinds)


class Round:
    """The shards of one broadcast: which keys of words of a length they know."""

    def __init__(self, shards: dict[tuple[int, int], bytes], counts: dict[int, int], size: int = SHARD):
        self.blocks = {length: blocks_of(n) for length, n in counts.items()}
        self.bits, self.first = {}, {}
        for length in {length for length, _ in shards}:
            own = sorted(s for at, s in shards if at == length)
            self.bits[length] = np.frombuffer(b"".join(shards[length, s] for s in own), dtype=np.uint64)
            self.first[length] = own[0] * size

    def known(self, key: np.ndarray, length: int) -> np.ndarray:
        """Which keys may be words; rounds hold neighbouring shards of a length."""
        block, mask = marks(key, self.blocks[length])
        bits = self.bits[length]
        at = block - self.first[length]
        if len(bits) == self.blocks[length]:
            return np.flatnonzero((bits[at] & mask) == mask)
        inside = np.flatnonzero((at >= 0) & (at < len(bits)))
        return inside[(bits[at[inside]] & mask[inside]) == mask[inside]]


def neighbours(letters: np.ndarray, filters: Round) -> Iterator[tuple[int, bytes]]:
    """(row, neighbour in Latin-1) of the neighbours that the filters know, each once, of words of one length."""
    n, length = letters.shape
    shorter, same = length - 1 in filters.bits, length in filters.bits
    if not (shorter or same):
        return
    power = _powers(length)
    with np.errstate(over="ignore"):
        parts = _LETTER[letters] * power
        sums = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(parts, axis=1, dtype=np.uint64)], axis=1)
    if shorter:  # of a run of one letter the first is deleted: the others give the same word
        first = np.concatenate([np.ones((n, 1), bool), letters[:, 1:] != letters[:, :-1]], axis=1)
        row, at = np.nonzero(first)
        with np.errstate(over="ignore"):
            key = sums[row, at] + (sums[row, length] - sums[row, at + 1]) * _UNPLACE
        for i in filters.known(key, length - 1):
            word = letters[row[i]].tobytes()
            yield int(row[i]), word[: at[i]] + word[at[i] + 1 :]
    if not same:
        return
    with np.errstate(over="ignore"):
        rest = (sums[:, length, None] - parts).ravel()
    flat, place = letters.ravel(), np.tile(power, n)
    for begin in range(0, len(flat), PROBES):
        cut = slice(begin, begin + PROBES)
        for letter in LETTERS:
            cell = np.flatnonzero(flat[cut] < letter)
            with np.errstate(over="ignore"):
                key = rest[cut][cell] + _LETTER[letter] * place[cut][cell]
            for i in cell[filters.known(key, length)]:
                row, at = divmod(begin + int(i), length)
                word = letters[row].tobytes()
                yield row, word[:at] + bytes([letter]) + word[at + 1 :]


def _rounds(shards: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """(length, shard, bytes), sorted, in rounds of neighbouring ones of so many bytes at most, one shard at least."""
    out, size = [], most + 1
    for length, shard, n in shards:
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append((length, shard))
        size += n
    return out


def near_pairs(words: DataFrame, size: int = SHARD, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """a, n_a, b, n_b: every two near words of (word, n), once.  `words` is a written table."""
    spark = words.sparkSession
    counts = {r["length"]: r["words"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()}
    shards = materialise(filters(words, counts, size), "variant-filters")
    found_shards = sorted((r["length"], r["shard"], r["size"]) for r in shards.select("length", "shard", F.length("bits").alias("size")).collect())
    found = None
    for some in _rounds(found_shards, round_bytes):
        first, last = (F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(("length", "shard"), at, strict=True))) for at in (some[0], some[-1]))
        wanted = shards.where(F.struct("length", "shard").between(first, last))
        sent = spark.sparkContext.broadcast({(r["length"], r["shard"]): bytes(r["bits"]) for r in wanted.toLocalIterator()})

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Round(sent.value, counts, size)
            for batch in batches:
                n = batch.column(1).to_pylist()
                words_ = batch.column(0).to_pylist()
                for rows, letters in by_length(batch.column(0)):
                    step = max(1, PROBES // letters.shape[1])
                    for begin in range(0, len(rows), step):
                        hits = list(neighbours(letters[begin : begin + step], known))
                        if hits:
                            own = [int(rows[begin + row]) for row, _ in hits]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([words_[i] for i in own]), pa.array([n[i] for i in own], pa.int64()), pa.array([w.decode("latin-1") for _, w in hits])], names=["a", "n_a", "b"]
                            )

        some = words.select("word", "n").mapInArrow(work, "a string, n_a long, b string")
        found = some if found is None else found.union(some)
    discard(shards)
    if found is None:
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the end of each word's chain of forms.  Counts grow tenfold with each step, so
    chains are short, and pointers double."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        links = materialise(links, "variant-roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if not links.join(on, "root", "left_semi").head(1):
            return links
        links = links.join(on, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary of (doc_id, text).

    A null text has no words, nor has an empty one; a null doc_id is an empty one in the checksum; repeated rows count
    each; of near words with equal counts the form is the smallest by code points.  A very long text is
    held by its task once; a very long word probes its neighbours piece by piece.  An empty table gives no
    rows; other columns are ignored.
    """
    words = materialise(vocabulary(docs), "variant-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(n).alias("n")) for w, o, n in (("a", "b", "n_b"), ("b", "a", "n_a"))))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    formed = F.col("best.less") * -1 >= FORM_RATIO * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")
    )
    out = materialise(out, "variants")
    found = roots(out.where("form IS NOT NULL"))
    discard(words)
    return out.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole documents table."""
    return group(table(spark, sf_dir, "documents"))


#: A plain statement: near words share what is left of them without one letter.
OP13_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY 1, 2), h AS (SELECT run, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM g, {CRC_TABLE_SQL}),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM p),
s AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
x AS (SELECT DISTINCT d.word AS long, d.n AS long_n, v.word AS short, v.n AS short_n FROM d JOIN v ON v.word = d.rest),
a AS (SELECT word, near, near_n FROM s UNION ALL SELECT long, short, short_n FROM x UNION ALL SELECT short, long, long_n FROM x),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM a GROUP BY 1), c AS (SELECT a.word, min(near) AS near FROM a JOIN b ON a.word = b.word AND near_n = most GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN near END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN b ON b.word = v.word LEFT JOIN c ON c.word = v.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f AS e ON e.word = r.root AND e.form IS NULL"""
