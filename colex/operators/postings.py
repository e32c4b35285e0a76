"""An inverted index in blocks of bounded size, kept up to date by what changes.

A posting block holds the ids of one key whose places in the store (`ord`) fall into one span, at most
`span` of them, in order.  An upsert or a delete touches the blocks of the keys that its rows had and have, and no
others: these are worked out anew from their own ids, the removed and the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1000


def entries(store: DataFrame, key: str) -> DataFrame:
    """key, id, ord, each once: an array column is indexed by its elements, and nulls aren't."""
    column = F.explode(key) if store.schema[key].dataType.typeName() == "array" else F.col(key)
    return store.select(column.alias("key"), "id", "ord").where("key IS NOT NULL").groupBy("key", "id").agg(F.min("ord").alias("ord"))


def _block(span: int) -> Column:
    return F.floor(F.col("ord") / span).alias("block")


def _packed(rows: DataFrame) -> DataFrame:
    """key, block, postings of (key, block, id, ord)."""
    return rows.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("postings"))


def build(store: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """key, block, postings: arrays of (ord, id), `span` at most, in order."""
    return _packed(entries(store, key).select("key", _block(span), "id", "ord"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, id, ord, added: what an index of `before` lacks of one of `after`, and what it has too much.  The two
    are the rows that a batch replaces or deletes, and those that it puts in their place; what is in both falls out."""
    signed = entries(before, key).withColumn("sign", F.lit(-1)).unionByName(entries(after, key).withColumn("sign", F.lit(1)))
    net = signed.groupBy("key", "id", "ord").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return net.select("key", "id", "ord", (F.col("sign") > 0).alias("added"))


def touched(delta: DataFrame, span: int = SPAN) -> DataFrame:
    """key, block: the blocks that changes fall into."""
    return delta.select("key", _block(span)).distinct()


def maintain(blocks: DataFrame, delta: DataFrame, span: int = SPAN) -> DataFrame:
    """The index after the changes.  Blocks that they don't touch pass as they are; the others lose what is
    removed and get what is added, and go if nothing is left."""
    met = touched(delta, span)
    same = blocks.join(met, ["key", "block"], "left_anti")
    old = blocks.join(met, ["key", "block"], "left_semi").select("key", "block", F.explode("postings").alias("p")).select("key", "block", "p.id", "p.ord")
    gone = delta.where(~F.col("added")).select("key", "id", "ord")
    left = old.join(gone, ["key", "id", "ord"], "left_anti").select("key", "block", "id", "ord")
    new = delta.where("added").select("key", _block(span), "id", "ord")
    return same.unionByName(_packed(left.unionByName(new).distinct()))


def lookup(blocks: DataFrame, key: str) -> DataFrame:
    """id, ord of a key, block by block."""
    return blocks.where(F.col("key") == key).select(F.explode("postings").alias("p")).select("p.id", "p.ord").orderBy("ord")
