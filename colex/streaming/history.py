"""The search history as a stream: the most recent queries, each once, in bounded state.

Queries are dealt to slots by a hash.  A slot's state is its own most recent list, of at most `limit`
queries, so the state has at most slots * limit entries however long the stream; the last `limit` of all are among
them, for a query has one slot.  An event that comes late counts with its own time.  With
`retention`, a timer takes queries out that weren't asked again for so long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.library import HISTORY_LIMIT

SLOTS = 16
LIST = "slot int, query string, ts timestamp, ord long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class MostRecent(StatefulProcessor):
    """Of each slot, the `limit` queries asked last; gives the whole list of a slot that changed, after a row
    without a query that says so."""

    def __init__(self, limit: int, retention_ms: int | None):
        self.limit, self.retention_ms = limit, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "query string", "ts timestamp, ord long")

    def _held(self) -> dict[str, tuple]:
        return {key[0]: (pd.Timestamp(value[0]), value[1]) for key, value in self.last.iterator()}

    def _list(self, slot: int, held: dict[str, tuple]) -> pd.DataFrame:
        rows = [(slot, None, None, None), *((slot, q, ts, o) for q, (ts, o) in held.items())]
        return pd.DataFrame(rows, columns=["slot", "query", "ts", "ord"]).astype({"slot": "int32", "ts": "datetime64[us]", "ord": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = before = self._held()
        held = dict(held)
        for batch in rows:
            best = batch.sort_values(["ts", "ord"]).drop_duplicates("query", keep="last")
            for query, ts, o in zip(best["query"], best["ts"], best["ord"], strict=True):
                new = (pd.Timestamp(ts), int(o))
                if query not in held or held[query] < new:
                    held[query] = new
            if len(held) > self.limit:
                held = dict(sorted(held.items(), key=lambda x: x[1], reverse=True)[: self.limit])
        for query in before.keys() - held.keys():
            self.last.removeKey((query,))
        for query, value in held.items():
            if before.get(query) != value:
                self.last.updateValue((query,), (value[0].to_pydatetime(), value[1]))
        if self.retention_ms is not None and held:
            self.handle.registerTimer(int(min(v[0] for v in held.values()).timestamp() * 1000) + self.retention_ms)
        yield self._list(key[0], held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        stays = {q: v for q, v in held.items() if v[0].timestamp() * 1000 + self.retention_ms > now}
        for query in held.keys() - stays.keys():
            self.last.removeKey((query,))
        if stays:
            self.handle.registerTimer(int(min(v[0] for v in stays.values()).timestamp() * 1000) + self.retention_ms)
        yield self._list(key[0], stays)

    def close(self) -> None:
        pass


def most_recent(log: DataFrame, limit: int = HISTORY_LIMIT, slots: int = SLOTS, retention: str | None = None, late: str = "1 hour") -> DataFrame:
    """slot, query, ts, ord: the lists of the slots that a micro-batch of the stream (query, ts, ord) changes.  Blank queries
    and those without a time aren't kept; a null ord is 0."""
    asked = log.where((F.trim("query") != "") & F.col("ts").isNotNull())
    asked = asked.select(F.pmod(F.xxhash64("query"), F.lit(slots)).cast("int").alias("slot"), "query", "ts", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"))
    retention_ms = None
    if retention is not None:
        asked = asked.withWatermark("ts", late)
        retention_ms = int(pd.Timedelta(retention).total_seconds() * 1000)
    processor = MostRecent(limit, retention_ms)
    return asked.groupBy("slot").transformWithStateInPandas(processor, LIST, outputMode="update", timeMode="None" if retention is None else "EventTime")


def keep_history(lists: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest list of each slot below `target`; a batch that is run again writes the same lists."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(target)

    spark = lists.sparkSession
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return lists.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(spark: SparkSession, target: str, limit: int = HISTORY_LIMIT) -> DataFrame:
    """query, ts, ord: the last queries of all slots, newest first."""
    rows = spark.read.schema("query string, ts timestamp, ord long, slot int").parquet(target).where("query IS NOT NULL")
    return rows.select("query", "ts", "ord").orderBy(F.desc("ts"), F.desc("ord")).limit(limit)


def clear_history(spark: SparkSession, target: str) -> None:
    """Empties the lists; the stream's own state goes with its checkpoint."""
    empty = spark.range(SLOTS).select(F.lit(None).cast("string").alias("query"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("ord"), F.col("id").cast("int").alias("slot"))
    empty.write.mode("overwrite").partitionBy("slot").parquet(target)
