"""What the training-data operators share: reading tables, shared tables that cut lineage, text batches, rolling hashes.

``kept`` writes a table into the folder the cluster names in
``spark.checkpoint.dir`` (all executors see it), so a lost executor costs no recomputation of what
came before and no stage is run twice.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.plans.shared import new_folder

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 8 << 20  # of an Arrow batch: a task holds some copies of one, on both sides of the pipe to Python


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most MOST_BYTES (and a row), or what the session asks for if that is less."""
    before = spark.conf.get(BATCH_BYTES)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(BATCH_BYTES, str(min(size, MOST_BYTES) if size > 0 else MOST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder, and read from there."""
    path = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as kept_by() makes buckets, by a key: what comes of joins by that key is not dealt out again there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, dealt() by that key, written as kept() does but in buckets: joins by the key shuffle the other side only, however often the table is joined.
    The catalog knows it only while it is written."""
    spark = df.sparkSession
    path, known = new_folder(spark, name), f"docspark_{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(known, format="parquet")
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")
    return out


def give_back() -> None:
    """What this process has freed goes back to the system: Arrow's pool and glibc keep it for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # other C libraries have none
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and when a task is through with it, what its worker has freed goes back to the system.

    Workers are kept for later tasks, and each would hold the most that any task of any stage before has taken."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_rows(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow batch; None for a null. One text at a time in memory.

    Workers serve one stage after another: what Arrow holds of batches that are gone goes back to the system first."""
    pa.default_memory_pool().release_unused()
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


def text_bytes(name: str = "text") -> Column:
    return F.col(f"`{name}`").cast("string").cast("binary")


def text_hash(name: str = "text") -> Column:
    """With doc_id it tells rows apart whose doc_id is null or stands in several rows; equal in rows that are equal."""
    return F.xxhash64(text_bytes(name))


def documents_of(docs: DataFrame) -> DataFrame:
    """Only doc_id and the text's UTF-8 bytes, so that the scan prunes the rest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def keyed_documents_of(docs: DataFrame) -> DataFrame:
    """doc_id, the text's UTF-8 bytes, and text_hash."""
    return documents_of(docs).withColumn("text_hash", F.xxhash64("text"))


BUCKETS = 1 << 19


def bucket_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def by_bucket(rows: DataFrame, columns: list[str], found: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows semi- or anti-joined with found by a bucket of their keys: at most BUCKETS numbers are broadcast, whatever the size of found.
    Rows of no bucket of found match none of it, so they need no shuffle; those of one may match, which a join of keys tells."""
    buckets = F.broadcast(found.select(bucket_of(*keys).alias("found_bucket")).distinct())
    return rows.join(buckets, bucket_of(*columns) == F.col("found_bucket"), how)


def rows_of(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with found (doc_id, text_hash). The caller's columns travel in one struct, so no name can clash.

    docs is read twice for left_anti, but only rows whose bucket is among those of found are shuffled."""
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"))
    other = found.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
    buckets = ["doc_id", "text_hash"], found, ["doc_id", "text_hash"]
    out = by_bucket(whole, *buckets, "left_semi").join(other, same, how)
    if how == "left_anti":
        out = by_bucket(whole, *buckets, "left_anti").unionByName(out)
    return out.select("row.*")


def is_held_out() -> Column:
    """crc32 of the decimal doc_id modulo 3 is 1. A null doc_id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


# --- rolling hashes -----------------------------------------------------------------------------

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (or more) powers of BASE, and of its inverse, modulo 2^64."""
    size = 1 << max(16, n.bit_length())
    if size not in _tables:
        both = np.full(size, BASE, dtype=_U), np.full(size, INVERSE, dtype=_U)
        for p in both:
            p[0] = 1
        _tables[size] = np.multiply.accumulate(both[0]), np.multiply.accumulate(both[1])
    return _tables[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def run_hashes(length: int, units: Callable[[int, int], np.ndarray], piece: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of units between zeros, and where it begins. units(i, j) gives the units from i to j, 0 where
    none belongs to a run; ``piece`` of them are held at a time."""
    hashes, begins, start, open_ = [], [], _U(0), 0  # start, open_: hash and length of the run that goes on from the last piece
    for at in range(0, length, piece):
        c = units(at, min(at + piece, length))
        inside = np.zeros(len(c) + 2, dtype=bool)
        np.not_equal(c, 0, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        up, down = powers(len(c))
        p = np.zeros(len(c) + 1, dtype=_U)
        np.cumsum(c * up[: len(c)], out=p[1:])
        h, place = (p[end] - p[begin]) * down[begin], begin + at
        if open_ and len(begin) and begin[0] == 0:
            h[:1] = start + h[:1] * _U(pow(int(up[1]), open_, 1 << 64))
            place[0] -= open_
        elif open_:
            h, place = np.r_[start, h], np.r_[at - open_, place]
        open_ = 0
        if len(place) and at + piece < length and inside[len(c)]:
            start, open_ = h[-1], at + len(c) - int(place[-1])
            h, place = h[:-1], place[:-1]
        hashes.append(h)
        begins.append(place)
    if not hashes:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    return mixed(np.concatenate(hashes)), np.concatenate(begins)


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n of the words, by the place of its first word."""
    m = max(len(w) - n + 1, 0)
    h = np.zeros(m, dtype=_U)
    for k in range(n):
        h = mixed(h * BASE + w[k : k + m])
    return h
