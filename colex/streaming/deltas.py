"""Upserts and deletes as deltas by hashed bucket, merged when they are read.

A batch writes its own rows only, to the buckets of their ids; nothing that is there is read or written
again.  A reader merges: of an id the newest batch wins, and its place is where it first came, or came again
after a delete.  Compaction folds the deltas of the buckets that have any into a new base of these buckets;
the others keep theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.commits import Commits, children, remove
from ..plans.schemas import LEXICON

BUCKETS = 64
#: What a written row has besides its own columns: its batch, whether it is a delete, and the batch and place where its id came in.
_MORE = "batch_ long, deleted_ boolean, born_ long, at_ long"


class DeltaStore:
    """Rows with `id` and `ord` below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str = LEXICON, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        self.commits = Commits(spark, f"{self.path}/commits")

    def _bucket(self, column: str = "id"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    @property
    def _stored(self) -> T.StructType:
        more = self.spark.createDataFrame([], _MORE).schema
        return T.StructType([*self.schema.fields, *more.fields, T.StructField("bucket", T.IntegerType())])

    # -------------------------------------------------------------- writing

    def _write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/{number:012d}")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Writes a batch as delta `number`; of rows with one id the last (by ord) counts, in the place of the first."""
        own = F.struct(*self.columns)
        once = batch.groupBy("id").agg(F.max_by(own, "ord").alias("row_"), F.min("ord").alias("at_")).select("row_.*", "at_")
        marks = once.select(*self.columns, F.lit(number).cast("long").alias("batch_"), F.lit(False).alias("deleted_"), F.lit(number).cast("long").alias("born_"), "at_", self._bucket().alias("bucket"))
        self._write(marks, number)

    def delete(self, ids: DataFrame, number: int) -> None:
        """Writes the deletes of these ids as delta `number`."""
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != "id"]
        marks = ids.select("id").distinct().select("id", *blank).select(*self.columns, F.lit(number).cast("long").alias("batch_"), F.lit(True).alias("deleted_"), F.lit(number).cast("long").alias("born_"), F.lit(0).cast("long").alias("at_"), self._bucket().alias("bucket"))
        self._write(marks, number)

    def follow(self, entries: DataFrame, checkpoint: str) -> StreamingQuery:
        """Upserts each micro-batch of a stream as the delta of its number; one that is run again writes it again."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id())), batch_id)

        return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # -------------------------------------------------------------- reading

    def state(self) -> dict:
        """base: bucket -> its compaction; through: the last delta that is in the base."""
        return {"base": {}, "through": -1} | self.commits.read()[1]

    def deltas(self) -> list[int]:
        """The deltas that are complete and not in the base."""
        through = self.state()["through"]
        numbers = [int(name) for name in children(self.spark, f"{self.path}/deltas")]
        return [n for n in numbers if n > through and "_SUCCESS" in children(self.spark, f"{self.path}/deltas/{n:012d}")]

    def touched(self, number: int) -> list[int]:
        """The buckets that a delta has rows in."""
        return sorted(int(name[len("bucket=") :]) for name in children(self.spark, f"{self.path}/deltas/{number:012d}") if name.startswith("bucket="))

    def _versions(self, buckets: set[int] | None = None) -> DataFrame:
        """All stored rows (of some buckets): the base's and the deltas'."""
        base = self.state()["base"]
        paths = [f"{self.path}/base/{n:012d}/bucket={b}" for b, n in base.items() if buckets is None or int(b) in buckets]
        by_base: dict[str, list[str]] = {}
        for p in paths:
            by_base.setdefault(p.rsplit("/", 1)[0], []).append(p)
        by_base |= {f"{self.path}/deltas/{n:012d}": [p for b in self.touched(n) if (buckets is None or b in buckets) and (p := f"{self.path}/deltas/{n:012d}/bucket={b}")] for n in self.deltas()}
        parts = [self.spark.read.schema(self._stored).option("basePath", root).parquet(*some) for root, some in by_base.items() if some]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._stored)

    @staticmethod
    def _merged(versions: DataFrame) -> DataFrame:
        """The newest row of each id that isn't deleted, born where it came in since its last delete."""
        gone = F.max(F.when(F.col("deleted_"), F.col("batch_"))).over(W.partitionBy("bucket", "id"))
        alive = versions.withColumn("gone_", gone).where("gone_ IS NULL OR batch_ > gone_")
        row = F.struct(*[c for c in versions.columns if c not in ("bucket", "id", "born_", "at_")])
        best = alive.groupBy("bucket", "id").agg(F.max_by(row, "batch_").alias("row_"), F.min(F.struct("born_", "at_")).alias("place_"))
        return best.select("bucket", "id", "row_.*", "place_.*")

    def read(self, ids: DataFrame | None = None) -> DataFrame:
        """The rows of the store, or of some ids, whose buckets alone are opened.  `ord` rises with the place of insertion."""
        buckets = None if ids is None else {r[0] for r in ids.select(self._bucket()).distinct().collect()}  # at most `buckets` rows
        rows = self._merged(self._versions(buckets))
        if ids is not None:
            rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
        place = F.shiftleft("born_", 40) + F.col("at_")
        return rows.select([place.alias("ord") if c == "ord" else F.col(c) for c in self.columns])

    # -------------------------------------------------------------- compaction

    def compact(self) -> list[int]:
        """Folds all deltas into a new base of the buckets that they touch, which it returns."""
        number, _ = self.commits.read()
        state, deltas = self.state(), self.deltas()
        if not deltas:
            return []
        buckets = sorted({b for n in deltas for b in self.touched(n)})
        where = f"{self.path}/base/{number + 1:012d}"
        self._merged(self._versions(set(buckets))).select(self._stored.names).write.mode("overwrite").partitionBy("bucket").parquet(where)
        there = {int(name[len("bucket=") :]) for name in children(self.spark, where) if name.startswith("bucket=")}
        base = {b: n for b, n in state["base"].items() if int(b) not in buckets} | {str(b): number + 1 for b in buckets if b in there}
        self.commits.write(number + 1, {"base": base, "through": max(deltas)})
        return buckets

    def vacuum(self) -> None:
        """Deletes deltas that are in the base, and bases that no bucket has any more."""
        state = self.state()
        for name in children(self.spark, f"{self.path}/deltas"):
            if int(name) <= state["through"]:
                remove(self.spark, f"{self.path}/deltas/{name}")
        for name in children(self.spark, f"{self.path}/base"):
            if int(name) not in state["base"].values():
                remove(self.spark, f"{self.path}/base/{name}")
