"""Sharding along a Hilbert curve through metadata.

Language, source and size are quantised to ``BITS`` bits each; the place of that cell on the Hilbert curve,
then the text's checksum and the doc_id, give one order of all rows. The order is cut into
runs of near equal bytes (law ``bytes``), so that each shard covers a compact part of the metadata
space and readers can skip files by any of the dimensions. Equal texts of equal metadata stand together.

Ranges of the order are sorted and summed by many tasks (repartitionByRange); only one total for
each range meets, in a broadcast of at most RANGES rows.

Defined cases: null lang or source is a cell of its own (0), a null text has size 1; repeated rows each
get a slot; an empty table gives an empty result; a shard may be empty when there are fewer rows than shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import kept

SHARDS = 16
BITS = 8
RANGES = 4096  # most ranges of the order, and so most rows of the broadcast totals


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row's cell (columns: dimensions), by the usual two passes: undo the
    rotations from the top bit down, then take the Gray code and interleave its bits."""
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | (x[i] >> b & 1)
    return out


def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1)), index=a.index)


def cells(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the place on the curve."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    named = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1 + F.crc32(F.col(c).cast("string")) % ((1 << BITS) - 1)).cast("long")
    step = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(size.cast("double")) * 8)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"), F.pandas_udf(_hilbert, "long")(named("lang"), named("source"), step).alias("hilbert"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = size = 0
        for b in batches:
            s = b.column(1).to_numpy()
            before = size + np.cumsum(s) - s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), TaskContext.get().partitionId(), dtype=np.int32)), pa.array(rows + np.arange(len(s))), pa.array(before)], names=[*b.schema.names, "part", "row", "before"])
            rows, size = rows + len(s), size + int(s.sum())

    spark = docs.sparkSession
    parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    order = ["hilbert", "text_crc32", "doc_id"]
    sorted_ = cells(docs).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, size long, text_crc32 long, hilbert long, part int, row long, before long")
    sorted_ = kept(sorted_, "curve")
    sums = sorted_.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))  # one row for each range
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("rows0"), F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("bytes0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    placed = sorted_.join(F.broadcast(sums), "part").withColumn("rank", F.col("row") + F.col("rows0"))
    middle = F.col("before") + F.col("bytes0") + F.expr("size div 2")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), (middle * shards / F.col("total")).cast("int")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # as many rows as shards
    out = placed.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
