"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records uniformly into buckets by a seeded hash of id and text, as many as keep a bucket near
``bucket_bytes``. Rows whose id and text repeat so often that they would fill a good part of a bucket are
salted with the row's number, so that copies spread as well. Pass two orders each bucket by a second seeded hash, so that its order
no longer depends on arrival, applies a Fisher-Yates shuffle and writes it. The buckets' counts then place every
record in one global order, which is cut into shards whose row counts differ by at most one.

Defined results: a null text has size 1 and the checksum of the empty text; rows that repeat an id are
rows like any other, null ids too. Columns besides doc_id and text travel along; those named like a result column are
replaced; names that begin with _sharding are its own. A single text is never split: a bucket holds at least one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, store

BUCKET_BYTES, ROW_BYTES, BLOCK, SEED = 16 << 20, 64, 4096, 20_240_607


def fisher_yates(count: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: each place from the last swaps with a random one not after it."""
    order = np.arange(count)
    swaps = (rng.random(count) * np.arange(1, count + 1)).astype(np.int64)
    for i in range(count - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return order


def size_of(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _key() -> Column:
    return F.xxhash64(F.lit("key"), "doc_id", "text")


def _weight() -> Column:
    """What a row takes in memory, at least."""
    return size_of("text") + ROW_BYTES


def hot_keys(documents: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(_sharding_hot): keys whose rows weigh over a quarter of a bucket, so four a bucket at most; and the weight of all rows."""
    keys = store(documents.groupBy(_key().alias("_sharding_hot")).agg(F.sum(_weight()).alias("weight"), F.count("*").alias("n")).groupBy(F.when((F.col("weight") * 4 > bucket_bytes) & (F.col("n") > 1), F.col("_sharding_hot")).alias("_sharding_hot")).agg(F.sum("weight").alias("weight")), "keys")
    total = keys.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return keys.where("_sharding_hot is not null").select("_sharding_hot"), total


def shuffled(documents: DataFrame, buckets: int, hot: DataFrame, seed: int = SEED) -> DataFrame:
    """documents with bucket and place, the row's position in its bucket after the shuffle."""
    # The row's number is made before the join moves rows, and files are read alike each time.
    rows = documents.withColumns({"_sharding_row": F.monotonically_increasing_id(), "_sharding_key": _key()}).join(small(hot, 16), F.col("_sharding_key") == F.col("_sharding_hot"), "left")
    salt = F.when(F.col("_sharding_hot").isNotNull(), F.col("_sharding_row")).otherwise(0)
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64(F.lit(seed), "_sharding_key", salt), F.lit(buckets)).cast("long"), "place": F.xxhash64(F.lit(seed + 1), "_sharding_key", salt)}).drop("_sharding_row", "_sharding_key", "_sharding_hot")

    def shuffle(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        bucket = table.column("bucket")[0].as_py()
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, bucket]))
        table = table.take(pa.array(order))
        return table.set_column(table.schema.get_field_index("place"), "place", pa.array(np.arange(table.num_rows)))

    return rows.groupBy("bucket").applyInArrow(shuffle, rows.schema)


def offsets(counts: DataFrame) -> DataFrame:
    """counts(bucket, n) -> (bucket, _sharding_before): the rows of earlier buckets, by sums of blocks of buckets and within them."""
    blocked = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocked.groupBy("block").agg(F.sum("n").alias("n"))
    starts = blocks.select("block", earlier(Window.orderBy("block")).alias("start"))  # a row for BLOCK buckets
    return blocked.withColumn("within", earlier(Window.partitionBy("block").orderBy("bucket"))).join(F.broadcast(starts), "block").select("bucket", (F.col("start") + F.col("within")).alias("_sharding_before"))


def shard(documents: DataFrame, shards: int = 8, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """documents in their new order: with bucket, place, shard and slot, read back from the written buckets."""
    documents = documents.drop("bucket", "place", "shard", "slot")
    hot, total = hot_keys(documents, bucket_bytes)
    buckets = max(1, -(-total // bucket_bytes))
    written = store(shuffled(documents, buckets, hot, seed), "buckets")
    counts = store(written.groupBy("bucket").agg(F.count("*").alias("n")), "bucket_counts")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = written.join(small(offsets(counts), 32, buckets), "bucket").withColumn("_sharding_at", F.col("_sharding_before") + F.col("place"))
    # Shard s holds the places from s * rows div shards up to that of s + 1.
    placed = placed.withColumn("shard", F.expr(f"cast(((_sharding_at + 1) * {shards} - 1) div {max(rows, 1)} as int)"))
    return placed.withColumn("slot", F.col("_sharding_at") - F.expr(f"(shard * {rows}L) div {shards}")).drop("_sharding_at", "_sharding_before")


def write_shards(documents: DataFrame, path: str, **options) -> None:
    """The shards as Parquet, a folder each, whose files are in slot order."""
    placed = shard(documents, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
