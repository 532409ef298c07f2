"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

Fingerprints: 64 bits over 3-word shingles hashed with XXH64. Two texts are linked when their
fingerprints differ in at most ``distance`` bits; classes are the connected components.

How the links are found, exactly:

* Equal fingerprints collapse first (each distinct fingerprint is one node; its class gets the smallest doc_id of all its rows at the end).
* Every fingerprint goes once under each of ``distance + 1`` top nodes. A top node is a masked bit
  pattern: a block of bits and its value. Of two fingerprints that differ in at most ``distance``
  bits at least one block is equal, so each link meets under some top node.
* A top node with more than ``group_limit`` fingerprints is split in the same way over its free bits,
  again and again. With 11 free bits left it has 2,048 distinct members at most, so every group has
  a proven bound and none is cut.
* Inside a group the fingerprints are sorted by Gray rank; runs of ``FAN`` become nodes that hold the
  bits all members share (pattern and mask), runs of nodes become upper nodes. Two nodes whose
  shared bits already differ in more than ``distance`` places are pruned with all that is below.
* A group gives a star to its smallest node for each class it finds, never all pairs. The stars meet
  in a components job (alternating large-star and small-star) on tables in the shared folder.

``keep_one`` links texts by what they share, not by bits alone: two texts are near copies when their sets of five-word shingles
have a Jaccard similarity of 0.8 or more. The same index, over two fingerprints of single words (near copies differ in few bits of them:
NEAR at most, of either), puts texts into classes of candidates (crowds under one top node as a whole), and an exact set join finds the links within a class: of two such sets the
rarest fifth of the shingles (the prefix) share one, so texts meet by these in Spark joins and each pair that meets is compared by itself. No class is held in one task, and
no pair inside a class is left out: a family of near copies first meets its most central text, and only pairs still apart are compared after that.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is linked
like any other; a null doc_id takes part and gets the smallest doc_id of its class (null if the class
has none); repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import by_bucket, dealt, gram_hashes, kept, kept_by, keyed_documents_of, mixed, released, rows_of, run_hashes, text_rows

SEED = 42
FAN = 8
SHINGLE, SIMILARITY = 5, 0.8  # of near copies that keep_one finds
NEAR = 5  # bits in which the word fingerprints of candidates may differ
SHARE = 16  # a word counts for at most a 16th of its text in such a fingerprint
NO_ID = (1 << 63) - 1  # stands for a null doc_id
LOADS, CHUNK = 1 << 19, 1 << 13  # buckets in which shingles are counted, for an order from rare to common


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # on bytes: lower-cases A-Z only, splits at the six ASCII spaces only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t or b"") for t in text_rows(b)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_hash"])

    return keyed_documents_of(docs).mapInArrow(released(run), "doc_id long, fp long, text_hash long")


# --- the index of a group ---------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _levels(fp: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the leaves up: first child, end of the children, pattern and mask of the shared bits of each node."""
    first, last, value, mask = np.arange(len(fp)), np.arange(len(fp)) + 1, fp, np.full(len(fp), ~np.uint64(0))
    out = [(first, last, value, mask)]
    while True:
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begins, len(group)])
        if (size == 1).all():
            return out
        place = np.arange(len(group)) - np.repeat(begins, size)
        heads = np.flatnonzero(place % FAN == 0)
        agree = np.bitwise_and.reduceat(mask, heads) & ~(np.bitwise_or.reduceat(value, heads) ^ np.bitwise_and.reduceat(value, heads))
        value, mask, group = value[heads], agree, group[heads]
        out.append((heads, np.r_[heads[1:], place.size], value, mask))


def linked(fp: np.ndarray, group: np.ndarray, distance: int = 3, at_once: int = 1 << 14) -> np.ndarray:
    """For rows sorted by (group, Gray rank): the first row of each row's class within its group."""
    parent = np.arange(len(fp))
    if not len(fp):
        return parent
    levels = _levels(fp, group)
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    grid_i, grid_j = np.divmod(np.arange(FAN * FAN), FAN)
    while stack:
        level, a, b = stack.pop()
        if len(a) > at_once:
            stack += [(level, a[i : i + at_once], b[i : i + at_once]) for i in range(0, len(a), at_once)]
            continue
        if level == 0:
            _unite(parent, a, b)
            continue
        first, last = levels[level][:2]
        value, mask = levels[level - 1][2:]
        x, y = first[a][:, None] + grid_i, first[b][:, None] + grid_j
        ok = (x < last[a][:, None]) & (y < last[b][:, None]) & ((a != b)[:, None] | (x <= y))
        if level == 1:
            ok &= x != y
        x, y = x[ok], y[ok]
        near = np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y]) <= distance
        stack.append((level - 1, x[near], y[near]))
    return _roots(parent, np.arange(len(fp)))


# --- the job ----------------------------------------------------------------------------------


def _blocks(mask: int, parts: int) -> list[int]:
    """The free bits of a mask (those not in it) in ``parts`` runs; each, added to the mask, is a child."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[cut[k] : cut[k + 1]]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _under(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each row once under each child of its mask."""
    children = F.create_map(*[c for m, kids in masks.items() for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in kids]))])
    others = [c for c in rows.columns if c not in ("mask", "shared")]
    return rows.select(*others, F.explode(children[F.col("mask")]).alias("mask")).withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str], solve: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """solve() of whole groups of sorted rows, some at a time."""
    rest: list[pa.RecordBatch] = []  # the last group so far, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda b, k: b.column(b.schema.get_field_index(k)).to_numpy()
        apart = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            apart |= column(batch, k) != column(batch, k)[-1]
        cut = int(np.flatnonzero(apart)[-1]) + 1 if apart.any() else 0
        goes_on = bool(rest) and all(column(rest[-1], k)[-1] == column(batch, k)[0] for k in keys)
        if rest and (cut or not goes_on):
            yield solve(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks())
            rest = []
        elif cut:
            yield solve(pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks())
        rest.append(batch.slice(cut))
    if rest:
        yield solve(pa.Table.from_batches(rest).combine_chunks())


def _dealt(rows: DataFrame, distance: int, group_limit: int) -> Iterator[DataFrame]:
    """rows (fp and others) with mask, shared: under the top nodes, or where these have over group_limit of them under nodes of
    theirs; with the bits of a node's mask shared by all, a group has a bound."""
    level = {0: _blocks(0, distance + 1)}
    rows = rows.withColumn("mask", F.lit(0).cast("long"))
    while True:
        rows = _under(rows, level)
        level = {m: _blocks(m, distance + 1) for kids in level.values() for m in kids}
        if min(64 - m.bit_count() for m in level) <= 11:
            yield rows
            return
        large = rows.groupBy("mask", "shared").count().where(F.col("count") > group_limit)
        if large.isEmpty():
            yield rows
            return
        large = kept(large.drop("count"), "large-groups")
        yield rows.join(large, ["mask", "shared"], "left_anti")
        rows = rows.join(large, ["mask", "shared"], "left_semi")


def _in_groups(rows: DataFrame, distance: int) -> DataFrame:
    """rows: mask, shared, fp, node. A star (a, b), a > b, for each class that the tree of a group finds; repeats included."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        mask, shared, fp, node = (t.column(k).to_numpy() for k in ("mask", "shared", "fp", "node"))
        fp = fp.view(np.uint64)
        group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])])
        order = np.lexsort((gray_rank(fp), group))
        fp, node = fp[order], node[order]
        root = linked(fp, group[order], distance)
        least = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        a, b = node, least[root]
        other = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other])], names=["a", "b"])

    grouped = rows.select("mask", "shared", "fp", "node").repartition("mask", "shared").sortWithinPartitions("mask", "shared")
    return grouped.mapInArrow(released(lambda batches: _by_group(batches, ["mask", "shared"], solve)), "a long, b long")


def links(nodes: DataFrame, distance: int = 3, group_limit: int = 8192) -> DataFrame:
    """nodes: fp, node. Edges (a, b), a > b, whose components are those of all links."""
    edges = None
    for p in _dealt(nodes, distance, group_limit):
        found = _in_groups(p, distance)
        edges = found if edges is None else edges.unionByName(found)
    return edges.distinct()


def crowd_links(nodes: DataFrame, distance: int, group_limit: int = 8192) -> DataFrame:
    """nodes: fp, node. Edges (a, b), a > b, whose components hold those of links(), for what is told apart by an exact step afterwards.

    A top node with more than group_limit fingerprints is a crowd: all its members are linked, not split over their free bits, which
    makes distance + 1 rows of each again and again as the table grows. So each fingerprint goes under distance + 1 nodes, whatever their number."""
    rows = _under(nodes.withColumn("mask", F.lit(0).cast("long")), {0: _blocks(0, distance + 1)})
    crowds = rows.groupBy("mask", "shared").agg(F.count("*").alias("n"), F.min("node").alias("least")).where(F.col("n") > group_limit)
    crowds = kept(crowds.select("mask", "shared", "least"), "crowds")
    stars = rows.join(crowds, ["mask", "shared"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return _in_groups(rows.join(crowds, ["mask", "shared"], "left_anti"), distance).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) between numbers. For each number that is not the smallest of its component: node, component."""
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = kept(edges, "edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, distance: int = 3, group_limit: int = 8192) -> DataFrame:
    """doc_id, fp (long), text_hash, component_id: the smallest doc_id reachable over links."""
    prints = kept(fingerprints(docs), "fingerprints")
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    to = components(links(nodes.select("fp", F.col("fp").alias("node")), distance, group_limit))
    placed = kept(nodes.join(to.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(named, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "text_hash", "component_id")


# --- near copies by what texts share --------------------------------------------------------------


_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BYTE = np.where(_IS_SPACE, 0, mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _words(raw: bytes) -> np.ndarray:
    return run_hashes(len(raw), lambda i, j: _BYTE[np.frombuffer(raw[i:j].lower(), dtype=np.uint8)], 1 << 17)[0]


def word_prints(raw: bytes) -> list[int]:
    """Two fingerprints of single words (of other hashes), no word counted for more than a SHARE-th of them."""
    w = _words(raw)
    word, times = np.unique(w, return_counts=True)
    times = np.minimum(times, max(1, len(w) // SHARE))
    ones = np.zeros(128, dtype=np.int64)
    for i in range(0, len(word), 1 << 14):
        both = np.stack([word[i : i + (1 << 14)], mixed(word[i : i + (1 << 14)] + np.uint64(1))], axis=1)
        ones += times[i : i + (1 << 14)] @ np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    return np.packbits(2 * ones > times.sum(), bitorder="little").view("<u8").tolist()


def shingles_of(raw: bytes, shingle: int = SHINGLE) -> bytes:
    """The set of shingles, as sorted 32-bit hashes. Texts without words have one set, and are alike."""
    w = _words(raw)
    grams = gram_hashes(w, min(shingle, max(len(w), 1)))
    return np.unique((grams >> np.uint64(32)).astype("<u4") if len(w) else np.zeros(1, dtype="<u4")).tobytes()


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype="<u4")


def _loads(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of LOADS buckets: a stand-in for how common a shingle is. Counts travel in chunks of CHUNK buckets."""

    def told(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(LOADS, dtype=np.int64)
        for b in batches:
            for s in b.column(0):
                np.add.at(n, _set(s) % LOADS, 1)
        yield from told(dict(enumerate(n.reshape(-1, CHUNK))) if n.any() else {})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n.as_buffer(), dtype=np.int64)
        yield from told(total)

    schema = "chunk long, n binary"
    out = np.zeros((LOADS // CHUNK, CHUNK), dtype=np.int64)
    for r in sets.select("shingles").mapInArrow(released(count), schema).repartition("chunk").mapInArrow(released(add), schema).collect():  # LOADS numbers in all
        out[r["chunk"]] = np.frombuffer(r["n"], dtype=np.int64)
    return out.ravel()


def prefix(shingles: np.ndarray, loads: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets as alike as that share one of them."""
    order = np.lexsort((shingles, loads[shingles % LOADS]))
    return shingles[order[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]]


_POSTING = ["key", "node", "at", "size", "lead", "several"]


def _postings(sets: DataFrame, similarity: float) -> DataFrame:
    """key (of class and shingle), node, at (its place among the text's shingles, rarest first), size; place is at / size, the lower the more central the text is.

    Of the postings of one key in a batch all but the most central are told with it as their lead, and dealt out by their node; the others are dealt by the key. So a
    shingle that a third of all texts share sends one row a batch to its key."""
    shared = sets.sparkSession.sparkContext.broadcast(_loads(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = shared.value
        for b in batches:
            node, cls = (b.column(i).to_numpy() for i in (0, 1))
            for i in range(0, b.num_rows, 2048):
                some = [_set(x) for x in b.column(2).slice(i, 2048)]
                first = [prefix(s, loads, similarity) for s in some]
                n = np.array([len(x) for x in first])
                key = mixed(np.concatenate(first).astype(np.uint64) + mixed(np.repeat(cls[i : i + 2048], n).view(np.uint64)))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                size = np.repeat(np.array([len(x) for x in some]), n)
                own, place = np.repeat(node[i : i + 2048], n), (at / size).astype(np.float32)
                order = np.lexsort((own, place, key))
                key, at, size, own, place = (x[order] for x in (key, at, size, own, place))
                heads = np.r_[True, key[1:] != key[:-1]]
                lead = own[np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))]
                several = ~heads | np.r_[~heads[1:], False]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), own, at.astype(np.int32), size.astype(np.int32), lead, several)], names=_POSTING)

    return sets.select("node", "class", "shingles").mapInArrow(released(run), "key long, node long, at int, size int, lead long, several boolean")


def _met(postings: DataFrame) -> DataFrame:
    """key, node, at, size, lead: the postings of keys that two texts or more have; lead is the most central text of its batch or, of the leads of all batches, of all."""

    names = ["key", "node", "at", "size", "lead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the first row of the key being read: key, node, at, size, and whether it was told
        for b in batches:
            known = b.column(4).to_numpy() != b.column(1).to_numpy()
            if known.any():  # dealt out by node: they know their lead
                yield b.filter(pa.array(known)).select(names)
                b = b.filter(pa.array(~known))
            if not b.num_rows:
                continue
            key, node, at, size, _, several = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            fresh = np.r_[before is None or before[0] != key[0], key[1:] != key[:-1]]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))  # -1: the key goes on from the batch before
            follows = ~fresh
            tell = several | follows | np.r_[follows[1:], False]
            head = np.where(first >= 0, node[np.maximum(first, 0)], before[1] if before else 0)
            if follows[0] and not before[4]:
                yield pa.RecordBatch.from_arrays([pa.array([before[0]]), pa.array([before[1]]), pa.array([before[2]], pa.int32()), pa.array([before[3]], pa.int32()), pa.array([before[1]])], names=names)
            f = first[-1]
            before = (key[f], node[f], at[f], size[f], bool(tell[f])) if f >= 0 else (*before[:4], True)
            yield pa.RecordBatch.from_arrays([pa.array(x[tell]) for x in (key, node, at, size, head)], names=names)

    deal = F.when(F.col("lead") == F.col("node"), F.col("key")).otherwise(F.xxhash64("key", "node"))
    dealt = postings.repartition(deal).sortWithinPartitions("key", F.col("at") / F.col("size"), "node")
    return dealt.mapInArrow(released(run), "key long, node long, at int, size int, lead long")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many of a set fall into each of so many buckets that one or two do: a byte each, 255 for as many or more."""
    width = 1 << max(len(shingles) - 1, 1).bit_length() - 1
    return np.minimum(np.bincount(shingles & np.uint32(width - 1), minlength=width), 255).astype(np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """Two sets of these sketches share at most so many: the lesser count of each bucket."""
    a, b = (np.where(x == 255, 1 << 32, x.astype(np.int64)) for x in (a, b))
    a, b = (x.reshape(-1, min(len(a), len(b))).sum(axis=0) for x in (a, b))
    return int(np.minimum(a, b).sum())


def _sketches(sets: DataFrame) -> DataFrame:
    """node, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [_set(x) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in some], pa.int64()), pa.array([sketch(x).tobytes() for x in some], pa.binary())], names=["node", "size", "sketch"])

    return kept(sets.select("node", "shingles").mapInArrow(released(run), "node long, size long, sketch binary"), "sketches")


def _may_be_alike(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) without those whose sizes or sketches tell that their sets cannot be as alike as that: for these no set is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (batch.column(i).to_numpy() for i in (2, 3))
            least = similarity / (1 + similarity) * sum(size) - 1e-9
            most = [most_shared(*(np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in two)) for two in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(most, dtype=np.int64) >= least))

    of = lambda c, n, x: sketches.select(F.col("node").alias(c), F.col("size").alias(n), F.col("sketch").alias(x))
    near = F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n") - 1e-9
    both = pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b").where(near)
    return kept(both.select("a", "b", "m", "n", "x", "y").mapInArrow(released(run), "a long, b long"), "may-be-alike")


def _alike(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity, each compared on its own. The set of a goes to b's: a text of very many pairs should be a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = _set(x), _set(y)
                both = np.sort(np.concatenate([s, t]))
                n = int((both[1:] == both[:-1]).sum())
                keep.append(n >= similarity * (len(both) - n) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c, name: sets.select(F.col("node").alias(c), F.col("shingles").alias(name))
    pairs = _may_be_alike(pairs, sketches, similarity)
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long")


def _classes(nodes: DataFrame, distance: int) -> DataFrame:
    """node, row, class: the texts that the index puts together by either fingerprint, for classes of two texts and more."""
    placed = nodes
    for fp, name in (("fp", "one"), ("other", "two")):
        prints = kept(nodes.select(F.col(fp).alias("fp")).distinct(), "prints")
        to = kept(components(crowd_links(prints.withColumn("node", F.col("fp")), distance)), "print-classes").select(F.col("node").alias(fp), F.col("component").alias(name))
        placed = placed.join(to, fp, "left").withColumn(name, F.coalesce(name, fp))
        several = placed.groupBy(name).count().where("count > 1").select(F.col(name), F.lit(True).alias(f"{name}_several"))
        placed = placed.join(several, name, "left")
    placed = kept(placed.where("one_several or two_several"), "placed")
    # a class of the second fingerprint is named apart from those of the first; texts that are in both bring them together
    named = placed.select("node", "row", F.when(F.col("one_several"), F.xxhash64(F.lit(1), "one")).alias("one"), F.when(F.col("two_several"), F.xxhash64(F.lit(2), "two")).alias("two"))
    both = components(named.where("one is not null and two is not null").select(F.col("one").alias("a"), F.col("two").alias("b")))
    mine = named.select("node", "row", F.coalesce("one", "two").alias("named"))
    return mine.join(both.withColumnRenamed("node", "named"), "named", "left").select("node", "row", F.coalesce("component", "named").alias("class"))


def alike_links(sets: DataFrame, similarity: float) -> DataFrame:
    """sets: node, class, shingles. Edges (a, b) between texts of one class that are as alike as that: not all pairs, but enough that their components are those of all such pairs.

    Texts meet by the shingles of their prefixes. Of those that meet in one shingle the most central (it has the fewest rarer shingles) is compared
    with all others first; then only pairs that are not yet in one component are compared, if their sizes and places allow it."""
    met = kept(_met(_postings(sets, similarity)), "met")
    sketches = _sketches(sets)
    stars = kept(met.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    edges = kept(_alike(stars, sets, sketches, similarity), "star-links")
    to = kept(components(edges), "star-components")
    placed = met.join(to, "node", "left").select("key", "node", "at", "size", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    placed = kept(placed.join(apart, "key", "left_semi"), "apart")
    x, y = placed.alias("x"), placed.alias("y")
    shared = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))  # at most, where a pair meets first
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    may = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & (shared >= least)
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & may).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    compared = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = kept(rest.join(compared, ["a", "b"], "left_anti"), "pairs")
    return edges.unionByName(_alike(rest, sets, sketches, similarity))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int = NEAR) -> DataFrame:
    """doc_id, text_hash, copy_of: the text_hash of one text of the row's class."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.array([word_prints(t or b"") for t in text_rows(b)], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "node", "fp", "other"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.unique(b.column(2).to_numpy(), return_index=True)[1]))  # rows that repeat, once a batch
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([shingles_of(t or b"", shingle) for t in text_rows(b)], pa.binary())], names=["node", "shingles"])

    texts = keyed_documents_of(docs)
    rows = kept(texts.mapInArrow(released(prints), "doc_id long, node long, fp long, other long"), "prints")
    nodes = kept(rows.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("row"), F.first("fp").alias("fp"), F.first("other").alias("other")), "texts")
    members = kept(_classes(nodes, distance), "members")
    # the texts are read again, those of members only, and of equal texts one, told by its doc_id
    named = texts.withColumns({"doc_id": F.coalesce("doc_id", F.lit(NO_ID))})
    near = by_bucket(named, ["doc_id", "text_hash"], members, ["row", "node"], "left_semi").mapInArrow(released(shingles), "node long, shingles binary")
    sets = kept_by(members.select("node", "class").join(dealt(near, "node"), "node").dropDuplicates(["node"]), "sets", "node")
    to = components(alike_links(sets, similarity))
    return rows.select("doc_id", F.col("node").alias("text_hash")).join(to.withColumnRenamed("node", "text_hash"), "text_hash", "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("copy_of"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id (a null one comes last, ties go by text), a repeated row once. Columns as they came."""
    rows = kept(near_copies(docs, shingle, similarity), "copies")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    several = rows.groupBy("copy_of").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    of = rows.join(several, "copy_of")
    copies = kept(of.where(place != F.col("first")).select("doc_id", "text_hash").distinct(), "copies")
    repeated = of.where(place == F.col("first")).groupBy("copy_of").count().where("count > 1")
    out = rows_of(docs, copies, "left_anti")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
