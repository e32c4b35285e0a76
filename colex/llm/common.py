"""Shared plumbing: reading tables, cutting lineage, and splitting texts into words.

Words are the maximal runs of characters other than space and U+0009..U+000D, the
six bytes that ``bytes.split()`` splits on, so every kernel works on UTF-8 bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one word separator class, for Java and for DuckDB regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as a literal, for translate() and trim().
SPACE_CHARS = " \t\n\x0b\f\r"

#: Texts are cut into chunks of about this many bytes before numpy sees them, so
#: memory follows the chunk (or the longest single text), not the Arrow batch.
CHUNK_BYTES = 1_000_000
#: Texts in a chunk at most, so that 16 bits number them.
CHUNK_TEXTS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where none is set and executors are threads of this
    machine (tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster executors need a folder they share")
        folder = "file://" + tempfile.mkdtemp(prefix="colex-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark drops a query's shuffle files at its end if this is set (4.1 on; unknown before, and harmless).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back.  A lost executor costs
    only the tasks it ran; everything behind the written table stays done, so the shuffle
    files that led to it are dropped."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads, through Hadoop's file system."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, by Spark's statistics; those it knows nothing of count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    unknown = int(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())
    return sum(size for size in sizes if size < unknown)


def let(value, body):
    """Bind a column to a name inside an expression, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


#: A DuckDB table of one row, crc_table: what eight steps of the reflected polynomial make of each byte.
_STEP_SQL = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
CRC_TABLE_SQL = f"(SELECT list_transform(CAST(range(256) AS BIGINT[]), lambda i: list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])), {_STEP_SQL})) AS crc_table)"


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 in DuckDB, which has no such function, beside the table CRC_TABLE_SQL."""
    code = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {code}), lambda c, b: xor(c >> 8, crc_table[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"


# --------------------------------------------------------------------------- words

_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, most: int = CHUNK_TEXTS) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) for slices of about `limit` bytes; a null text is empty."""
    first, size, out = 0, 0, []
    for i, text in enumerate(texts.cast(pa.large_binary())):
        value = text.as_py() or b""
        if out and (size + len(value) > limit or len(out) == most):
            yield first, out
            first, size, out = i, 0, []
        out.append(value)
        size += len(value)
    if out:
        yield first, out


def word_keys(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, as columns: the halves of one 128-bit hash that isn't a polynomial."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of all words of the texts, in order, and the words of each text."""
    ids: dict[bytes, int] = {}
    place, counts = [], []
    for text in texts:
        found = [ids.setdefault(w, len(ids)) for w in (text.lower() if lower else text).split()]
        place += found
        counts.append(len(found))
    key = word_keys(list(ids))[np.array(place, dtype=np.int64)]
    return np.ascontiguousarray(key[:, 0]), np.ascontiguousarray(key[:, 1]), np.array(counts, dtype=np.int64)


#: A prime modulus: modulo a power of two, polynomials of Thue-Morse sequences are equal for every base.
PRIME = np.uint64((1 << 61) - 1)
_LOW32, _LOW29, _LOW30, _LOW31 = (np.uint64((1 << n) - 1) for n in (32, 29, 30, 31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it: 2**61 is 1 and 2**64 is 8."""
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    return _reduced((ah * bh << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & _LOW29) << np.uint64(32)) + (low >> np.uint64(61)) + (low & PRIME))


class _Powers:
    """The powers of a base modulo PRIME, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), int(PRIME)))
            self.known = np.concatenate([self.known, times(self.known, np.full(len(self.known), step))])
        return self.known[:n]


_BASE = int(_splitmix(37, 1)[0]) % int(PRIME)
_POWERS, _BACK = _Powers(_BASE), _Powers(pow(_BASE, -1, int(PRIME)))


class Rolling:
    """Hashes of any run of words of a chunk, from prefix sums modulo a prime: the sum of h[i] * base**i,
    scaled back by the run's start, so that equal runs hash alike wherever they are."""

    def __init__(self, h: np.ndarray):
        term = times(_reduced(h), _POWERS.upto(len(h)))
        # halves are summed apart, so that no sum leaves 64 bits
        high, low = np.cumsum(term >> np.uint64(31), dtype=np.uint64), np.cumsum(term & _LOW31, dtype=np.uint64)
        sums = _reduced((high >> np.uint64(30)) + ((high & _LOW30) << np.uint64(31)) + _reduced(low))
        self.sums = np.concatenate((np.zeros(1, np.uint64), sums))
        self.back = _BACK.upto(len(h) + 1)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = times(_reduced(self.sums[end] + (PRIME - self.sums[first])), self.back[first])
        with np.errstate(over="ignore"):
            return mix(h + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
