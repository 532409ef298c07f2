"""Exact duplicates by content sort: equal normalised texts end up side by side, and neighbours are compared in full.

* Normalised bytes: the text without its ASCII white space, as UTF-8.
* Splitters. Rows are range-partitioned by splitters that Spark samples of (the first PREFIX bytes, a hash of all bytes, the order
  in which rows of one group are preferred). A splitter is small whatever the texts are, many texts with one long
  beginning are told apart by the hash, and a group of any size is cut over as many partitions as its rows fill.
* External sort. Each partition is sorted by (prefix, hash, bytes, preference) by Spark, which spills; so equal texts are neighbours
  and the first row of a group is the one to keep. Where prefix and hash agree, the bytes of both neighbours are compared in full.
* Edges. Only the first and the last key of a partition can go on in another one. Their groups are told as one row each, with the bytes,
  and meet by these bytes: about two rows for each partition, whatever the groups' sizes.

A task holds one Arrow batch and, of the key it is in, the doc_ids of the rows its partition has (not their texts).

Defined cases: a null text is an empty one, and all texts without a character left form one group; of equal rows any one is kept, exactly one;
a null doc_id comes last in the order of preference and is carried; long texts are whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import kept, text_bytes, text_rows

SPACES = b" \t\n\v\f\r"
PREFIX = 32
NO_ID = (1 << 63) - 1

_ROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("group_id", pa.int64()), ("group_size", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("points", pa.int64()), ("text_sha256", pa.string()), ("edge", pa.binary())])
_DDL = "doc_id long, row long, group_id long, group_size long, keep_id long, keep_row long, points long, text_sha256 string, edge binary"


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), row, less (minus the code points of the text), norm, prefix, hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [(t or b"").translate(None, SPACES) for t in text_rows(b)]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, norm), dtype=np.uint64, count=len(norm))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(norm, pa.binary()), pa.array([x[:PREFIX] for x in norm], pa.binary()), pa.array(hashes.view(np.int64))], names=["doc_id", "row", "less", "norm", "prefix", "hash"])

    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.monotonically_increasing_id().alias("row"), (-F.coalesce(F.length(text), F.lit(0))).cast("long").alias("less"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, less long, norm binary, prefix binary, hash long")


class _Neighbours:
    """Reads a sorted partition. A group is closed when a row of other bytes comes, told when a row of another key comes."""

    def __init__(self, partition: int) -> None:
        self.next_id, self.key, self.norm = partition << 40, None, b""
        self.first = True  # the key being read is the partition's first
        self.groups: list[tuple[bytes, list[np.ndarray]]] = []  # of the key: bytes, and (doc_id, row, less) arrays
        self.out: list[pa.RecordBatch] = []

    def tell(self, edge: bool) -> None:
        for norm, parts in self.groups:
            doc, row, less = np.concatenate(parts, axis=1)
            n = len(doc)
            same = lambda x: np.full(n, x, dtype=np.int64)
            sha = hashlib.sha256(norm).hexdigest()
            marks = pa.array([norm if edge else None] + [None] * (n - 1), pa.binary())
            ids = [pa.array(x) for x in (doc, row, same(self.next_id), same(-1 if edge else n), same(doc[0]), same(row[0]), -less)]
            self.out.append(pa.RecordBatch.from_arrays([*ids, pa.array([sha] * n), marks], schema=_ROW))
            self.next_id += 1
        self.groups = []

    def lone(self, at: np.ndarray, ids: tuple[np.ndarray, ...], norms: pa.Array) -> None:
        """Rows whose key no other row has."""
        if not len(at):
            return
        doc, row, less = (x[at] for x in ids)
        n = len(at)
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in norms.take(pa.array(at))]
        self.out.append(pa.RecordBatch.from_arrays([*map(pa.array, (doc, row, self.next_id + np.arange(n), np.ones(n, dtype=np.int64), doc, row, -less)), pa.array(sha), pa.nulls(n, pa.binary())], schema=_ROW))
        self.next_id += n

    def read(self, b: pa.RecordBatch) -> None:
        ids = tuple(b.column(i).to_numpy() for i in (0, 1, 2))
        norms, prefix, hashes = b.column(3), b.column(4), b.column(5).to_numpy()
        fresh = np.r_[True, hashes[1:] != hashes[:-1]]
        for i in np.flatnonzero(~fresh).tolist():
            fresh[i] = prefix[i] != prefix[i - 1]
        first_key = (prefix[0].as_py(), int(hashes[0]))
        fresh[0] = first_key != self.key
        heads = np.flatnonzero(fresh)
        ends = np.r_[heads[1:], len(hashes)]
        self._more(ids, norms, 0, int(heads[0]) if len(heads) else len(hashes))
        if not len(heads):
            return
        self._close()
        middle = heads[(ends - heads == 1) & (heads != heads[-1]) & (heads != (heads[0] if self.first else -1))]
        self.lone(middle, ids, norms)
        lone = set(middle.tolist())
        for i, j in zip(heads.tolist(), ends.tolist(), strict=True):
            if i not in lone:
                self._close()
                self.key = (prefix[i].as_py(), int(hashes[i]))
                self._more(ids, norms, i, j)

    def _more(self, ids: tuple[np.ndarray, ...], norms: pa.Array, i: int, j: int) -> None:
        while i < j:  # neighbours of one key, compared in full
            k, norm = i + 1, norms[i].as_py()
            while k < j and norms[k].as_buffer() == norm:
                k += 1
            part = np.stack([x[i:k] for x in ids])
            if self.groups and self.groups[-1][0] == norm:
                self.groups[-1][1].append(part)
            else:
                self.groups.append((norm, [part]))
            i = k

    def _close(self) -> None:
        if self.key is not None and self.groups:
            self.tell(self.first)
            self.first = False

    def taken(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        if out:
            yield from pa.Table.from_batches(out, _ROW).combine_chunks().to_batches()


def grouped(rows: DataFrame) -> DataFrame:
    """Each row with its group: size and the row to keep, or for groups at a partition's edge what this partition knows (size -1, and the bytes once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader = _Neighbours(TaskContext.get().partitionId())
        for b in batches:
            if b.num_rows:
                reader.read(b)
                yield from reader.taken()
        reader.tell(True)
        yield from reader.taken()

    preference = ["less", "doc_id", "row"]
    dealt = rows.repartitionByRange("prefix", "hash", *preference).sortWithinPartitions("prefix", "hash", "norm", *preference)
    return dealt.mapInArrow(run, _DDL)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    found = kept(grouped(normalised(docs)), "sorted")
    edges = found.where("group_size < 0")
    of = kept(edges.groupBy("group_id").agg(F.count("*").alias("n"), F.max("edge").alias("norm"), F.max("points").alias("points"), F.first("keep_id").alias("keep_id"), F.first("keep_row").alias("keep_row")), "edges")
    best = Window.partitionBy("norm")  # one row for each partition that has some of the group
    first = F.min(F.struct((-F.col("points")).alias("less"), "keep_id", "keep_row")).over(best)
    named = of.select("group_id", F.sum("n").over(best).alias("n"), first.alias("f"))
    named = named.select("group_id", F.col("n").alias("whole_size"), F.col("f.keep_id").alias("whole_id"), F.col("f.keep_row").alias("whole_row"))
    closed = edges.join(named, "group_id").withColumns({"group_size": F.col("whole_size"), "keep_id": F.col("whole_id"), "keep_row": F.col("whole_row")})
    out = found.where("group_size >= 0").unionByName(closed.select(*found.columns))
    given = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select(given("doc_id"), given("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
