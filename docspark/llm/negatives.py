"""Hard negatives by exact inner products, found in an STR-packed R-tree.

Components are whole numbers (floor(SCALE * x)), so scores are exact. A score window of each (anchor, positive) is given by the
positive's score; the best rows of other labels inside it are the hard negatives.

* Packing (sort-tile-recursive). The two coordinates that vary most cut the table in Spark: a range partitioning (sampled splitters)
  by the first, a sort by the second, and each TILE rows become a tile. In its tile a task goes on over the next coordinates
  down to leaves of LEAF rows, and gives each leaf, each FAN leaves and the tile a minimum bounding box. A tile is one row of a table in the shared
  folder: numbers as bytes, in the order of the leaves.
* Bounds. With a box lo, hi the inner products with an anchor lie between the sums over the coordinates of the lesser and of the
  greater of a * lo and a * hi.
* Search. Anchors come in blocks of about BLOCK (a stated bound: only one block is on the driver and broadcast at a time), each against all tiles. In a
  tile a best-first queue holds boxes by their upper bound; a box goes if its interval misses all score windows, if its bound is
  strictly below the k-th best of each window that it meets, or equal to it with no smaller vec_id. The k-th best is that of all tiles the task has read before, so that
  a task gives at most k rows for each window, and a Spark window keeps the first k of these.

Positives are found by the same search, with one window without an end over the anchor's own label. The work is that of a stated query set
(a hundredth of the rows) against all rows.

Defined cases: rows with a null label or vector, or with a null, NaN or infinite component take no part; a shorter vector counts as filled up with
zeros; of rows with equal vec_id each is a row of its own (each an anchor if the id says so, and one another's "other rows"); a null vec_id
comes last among equals and is no anchor; numbers so large that 64-bit floats would not be exact are multiplied as Python integers, and scores beyond 64 bits are told as the greatest (least) one; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import kept
from docspark.plans.shared import new_folder

SCALE = 256
EVERY = 100  # anchors are rows whose vec_id is divisible by it
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
TILE, LEAF, FAN = 4096, 64, 8
BLOCK = 2048  # anchors
NO_ID = (1 << 63) - 1
EXACT = 1 << 53


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id (NO_ID for null), label, q (array of long), row."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    q = F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long"))
    out = rows.where(fine).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    return out.withColumn("row", F.monotonically_increasing_id())


def _shape(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Greatest length and size of a component, and the coordinates by falling variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[float, float, float, int]] = {}
        for b in batches:
            q = b.column(0)
            sizes, flat = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy().astype(float)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for k in range(int(sizes.max(initial=0))):
                v = flat[at == k]
                n, s, ss, most = total.get(k, (0.0, 0.0, 0.0, 0))
                total[k] = (n + len(v), s + v.sum(), ss + (v * v).sum(), max(most, int(np.abs(v).max(initial=0))))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([total[k][i] for k in keys], pa.float64()) for i in range(4))], names=["k", "n", "s", "ss", "most"])

    parts = rows.select("q").mapInArrow(run, "k long, n double, s double, ss double, most double")
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("most").alias("most")).collect()  # one row a coordinate
    spread = {r["k"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in found}
    return len(found), int(max((r["most"] for r in found), default=0)), sorted(spread, key=lambda k: (-spread[k], k))


def _matrix(q: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(q), width), dtype=np.int64)
    row = np.repeat(np.arange(len(q)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = q.flatten().to_numpy()
    return out


def str_order(q: np.ndarray, axes: list[int], leaf: int = LEAF) -> np.ndarray:
    """Rows in the order of their leaves: sorted by one coordinate, cut into slabs, each slab by the next coordinate."""
    parts = [np.arange(len(q))]
    for depth, axis in enumerate(axes):
        left = max(len(p) for p in parts)
        if left <= leaf:
            break
        slabs = max(2, round((left / leaf) ** (1 / min(len(axes) - depth, 3))))
        cut = []
        for p in parts:
            p = p[np.argsort(q[p, axis], kind="stable")]
            size = -(-len(p) // slabs // leaf) * leaf if len(p) > leaf else len(p)
            cut += [p[i : i + max(size, leaf)] for i in range(0, len(p), max(size, leaf))]
        parts = cut
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def packed(rows: DataFrame, width: int, axes: list[int], tile: int = TILE) -> DataFrame:
    """tile rows: n, and vec_id, label, row, q as bytes of 64-bit numbers, in the order of their leaves."""
    first, second = (axes * 2)[:2] if axes else (None, None)

    def made(vec_id: np.ndarray, label: np.ndarray, row: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        order = str_order(q, axes[2:] or axes)
        return pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64()), *(pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary()) for x in (vec_id, label, row, q))], names=["n", "vec_id", "label", "row", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            held.append((*(b.column(i).to_numpy() for i in range(3)), _matrix(b.column(3), width)))
            size += b.num_rows
            while size >= tile:
                whole = [np.concatenate([h[i] for h in held]) for i in range(4)]
                yield made(*(x[:tile] for x in whole))
                held, size = [tuple(x[tile:] for x in whole)], size - tile
        if size:
            yield made(*(np.concatenate([h[i] for h in held]) for i in range(4)))

    at = lambda k: F.coalesce(F.get("q", F.lit(k)), F.lit(0)) if k is not None else F.lit(0)
    keyed = rows.select("vec_id", "label", "row", "q", at(first).alias("x"), at(second).alias("y"))
    dealt = keyed.repartitionByRange("x", "y", "row").sortWithinPartitions("y", "x", "row")  # row: many equal vectors are cut, too
    return dealt.select("vec_id", "label", "row", "q").mapInArrow(run, "n long, vec_id binary, label binary, row binary, q binary")


@dataclass
class Tile:
    """Rows of a tile by leaf; boxes: node 0 is the tile, then its inner nodes, then the leaves."""

    vec_id: np.ndarray
    label: np.ndarray
    row: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least_id: list[int]
    inner: int
    leaves: int

    @classmethod
    def of(cls, vec_id: bytes, label: bytes, row: bytes, q: bytes, width: int, kind: type) -> Tile:
        ids, labels, rows = (np.frombuffer(x, dtype=np.int64) for x in (vec_id, label, row))
        v = np.frombuffer(q, dtype=np.int64).reshape(len(ids), width)
        heads = np.arange(0, len(ids), LEAF)
        lo, hi, least = np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads), np.minimum.reduceat(ids, heads)
        up = np.arange(0, len(heads), FAN)
        both = [(lo, hi, least), (np.minimum.reduceat(lo, up), np.maximum.reduceat(hi, up), np.minimum.reduceat(least, up))]
        whole = (lo.min(axis=0)[None], hi.max(axis=0)[None], np.array([least.min()]))
        low, high, least = (np.concatenate([whole[i], both[1][i], both[0][i]]) for i in range(3))
        return cls(ids, labels, rows, v.astype(kind), low.astype(kind), high.astype(kind), least.tolist(), len(up), len(heads))

    def below(self, node: int) -> range:
        if node == 0:
            return range(1, 1 + self.inner)
        first = (node - 1) * FAN
        return range(1 + self.inner + first, 1 + self.inner + min(first + FAN, self.leaves))


@dataclass
class Anchors:
    """A block of anchors, each with its windows: (number, least score, greatest score); same: whether rows of the anchor's label are looked for, or all others."""

    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    windows: list[list[tuple[int, float, float]]]
    same: bool
    k: int


def _search(tile: Tile, block: Anchors, best: list[list[list[tuple]]], positive: np.ndarray, negative: np.ndarray) -> None:
    """best[anchor][window]: ascending (-score, vec_id, row) of the first k so far."""
    upper = positive @ tile.high.T + negative @ tile.low.T
    lower = positive @ tile.low.T + negative @ tile.high.T
    leaf_at = 1 + tile.inner
    for a, windows in enumerate(block.windows):
        if not windows:
            continue
        up, lo, mine = upper[a].tolist(), lower[a].tolist(), best[a]
        vector, label, own = block.q[a], block.label[a], block.row[a]

        def wanted(node: int) -> list[int]:
            u, l_, least = up[node], lo[node], tile.least_id[node]
            out = []
            for w, (_, least_score, most_score) in enumerate(windows):
                if u < least_score or l_ > most_score:
                    continue
                found = mine[w]
                if len(found) == block.k and (u < -found[-1][0] or u == -found[-1][0] and least > found[-1][1]):
                    continue
                out.append(w)
            return out

        queue = [(-up[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            meets = wanted(node)
            if not meets:
                continue
            if node < leaf_at:
                for child in tile.below(node):
                    if wanted(child):
                        heapq.heappush(queue, (-up[child], child))
                continue
            i = (node - leaf_at) * LEAF
            j = min(i + LEAF, len(tile.row))
            score = tile.q[i:j] @ vector
            fits = (tile.label[i:j] == label) & (tile.row[i:j] != own) if block.same else tile.label[i:j] != label
            for w in meets:
                _, least_score, most_score = windows[w]
                found = mine[w]
                if len(found) == block.k:
                    least_score = max(least_score, -found[-1][0])
                hit = np.flatnonzero(fits & (score >= least_score) & (score <= most_score))
                if len(hit):
                    if len(hit) > block.k:
                        hit = hit[np.lexsort((tile.row[i:j][hit], tile.vec_id[i:j][hit], -score[hit]))[: block.k]]
                    new = zip((-score[hit]).tolist(), tile.vec_id[i:j][hit].tolist(), tile.row[i:j][hit].tolist(), strict=True)
                    mine[w] = sorted([*found, *new])[: block.k]


def _long(x: int) -> int:
    return max(-(1 << 63), min(x, (1 << 63) - 1))


def _best(tiles: DataFrame, shared: Broadcast[Anchors], width: int, kind: type) -> DataFrame:
    """anchor (number in the block), window, vec_id, row, score: of each task its first k for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        zero = np.zeros(1, dtype=kind)
        positive, negative = np.maximum(block.q, zero), np.minimum(block.q, zero)
        best: list[list[list[tuple]]] = [[[] for _ in w] for w in block.windows]
        for b in batches:
            for i in range(b.num_rows):
                _search(Tile.of(*(b.column(c)[i].as_py() for c in range(1, 5)), width, kind), block, best, positive, negative)
        out = [(a, block.windows[a][w][0], r[1], r[2], _long(-int(r[0]))) for a, ws in enumerate(best) for w, rows in enumerate(ws) for r in rows]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "window", "vec_id", "row", "score"])

    found = tiles.mapInArrow(run, "anchor long, window long, vec_id long, row long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= shared.value.k)


def hard_negatives(rows: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """rows: vec_id, label, embedding. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    vectors = kept(whole_vectors(rows), "vectors")
    width, most, axes = _shape(vectors)
    kind = float if width * most * most < EXACT else object
    tiles = kept(packed(vectors, width, axes, tile), "tiles")
    is_anchor = (F.col("vec_id") % EVERY == 0) & (F.col("vec_id") != NO_ID) if anchors is None else anchors
    chosen = vectors.where(is_anchor)
    blocks = max(1, -(-chosen.count() // block))
    path = new_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for k in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).orderBy("row").toArrow()  # about `block` rows
        if not part.num_rows:
            continue
        part = part.combine_chunks().to_batches()[0]
        column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
        ids, own = column("vec_id").to_numpy(), column("row").to_numpy()
        data = Anchors(own, column("label").to_numpy(), _matrix(column("q"), width).astype(kind), [[(0, -math.inf, math.inf)] for _ in ids], True, positives)
        shared = spark.sparkContext.broadcast(data)
        found = _best(tiles, shared, width, kind).orderBy("anchor", "rank").collect()  # at most `positives` for each anchor of the block
        shared.unpersist()
        windows: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        for n, r in enumerate(found):
            windows[r["anchor"]].append((n, -(-low * r["score"] // 100), high * r["score"] // 100))
        shared = spark.sparkContext.broadcast(Anchors(data.row, data.label, data.q, windows, False, negatives))
        named = spark.createDataFrame([(n, int(ids[r["anchor"]]), r["vec_id"], r["score"]) for n, r in enumerate(found)], "window long, anchor_id long, positive_id long, positive_score long")
        hit = _best(tiles, shared, width, kind).select("window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = hit.join(F.broadcast(named), "window")
        given = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
        out.select("anchor_id", given("positive_id"), F.col("rank").cast("int").alias("rank"), given("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path)


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 get the next label of ten, so that labels and clusters do not agree everywhere."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), "embedding")
