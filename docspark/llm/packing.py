"""Best-fit packing of token pieces, with bounds that certify how good it is.

Texts are encoded once, each document's ids end in one ``END`` id; documents longer than a sequence are
cut into whole sequences and a last, shorter piece. Whole pieces are sequences of their own. The others are
dealt over partitions of about ``PARTITION`` pieces, and each partition is packed by best-fit decreasing. A
dual-feasible function u (any f on lengths with sum f <= 1 for lengths that fit one sequence)
gives the lower bound ceil(sum u); the largest over a family certifies a partition whose count it
meets. Partitions with a gap give their emptiest sequences up; the pieces of all of these are exchanged (dealt anew
over fewer partitions) and packed again, for at most ``ROUNDS`` rounds. As one round's pool is
a fraction of the one before, the last pool is small; a pool is never larger than its partitions can hold. The result says how many sequences there are and the bound
over all pieces, so that the gap that the rounds have left can be read.

Defined cases: a null text is an empty one (one piece: the END id alone); rows with the same doc_id are
packed each on its own; a null doc_id is carried; a long text goes to the tokenizer in stretches and is cut into sequences; with no rows there are none; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import documents_of, kept, released, text_rows

CAPACITY = 2048
END = 0
PARTITION = 40_000
ROUNDS = 3
CACHE = 3 << 16  # runs in each of the two generations that an encoder remembers
STRETCH = 1 << 16  # characters given to the tokenizer at once, and on to the next space between letters

# Latin texts: only here are white space, case and words the same to Python and to the tokenizer.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]|<\\|")


_BETWEEN = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")  # a space that a text may be cut at


_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


class Encoder:
    """Ids of a text as little-endian 32-bit bytes: what ``encode(text, add_special_tokens=False)`` gives.

    The vocabulary lower-cases, and no token reaches over white space, so the ids of each run between white
    space are looked up in a bounded cache. A text with anything outside plain Latin letters, or with
    what may be a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.runs: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}  # the generation before: what is met again moves to the new one, the rest goes with the next

    def whole(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            space = _BETWEEN.search(text, at + STRETCH)
            end = space.end() if space else len(text)
            out.append(np.array(self.tokenizer.encode(text[at:end], add_special_tokens=False).ids, dtype="<u4").tobytes())
            at = end
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.whole(text)
        if len(self.runs) > CACHE:
            self.old, self.runs = self.runs, {"": b""}
        runs, known = text.lower().split(), self.runs
        new = self._again(set(runs).difference(known))
        if new:
            self._learn(new)
        return b"".join(map(known.__getitem__, runs))

    def _again(self, runs: set[str]) -> set[str]:
        """Those that the old generation does not know, either; the others are taken over."""
        old = self.old
        found = {r for r in runs if r in old}
        self.runs.update(zip(found, map(old.__getitem__, found), strict=True))
        return runs - found

    def _learn(self, runs: set[str]) -> None:
        """Words of letters, bare or with marks behind them, are encoded together, each a token group of its own; all other runs together, told apart by the place of their tokens."""
        known = self.runs
        parts = {r: m.groups() for r in runs if (m := _PLAIN.fullmatch(r))}
        words = list(self._again({x for p in parts.values() for x in p}.difference(known)))
        if words:
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids, cut = np.array(found.ids, dtype="<u4").tobytes(), np.searchsorted(np.array(found.word_ids), np.arange(len(words) + 1)) * 4
            known.update(zip(words, (ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), strict=True))
        known.update({r: known[p[0]] + known[p[1]] for r, p in parts.items()})
        if others := [r for r in runs if r not in parts]:
            found = self.tokenizer.encode(" ".join(others), add_special_tokens=False)
            ids, at = np.array(found.ids, dtype="<u4").tobytes(), np.array([o[0] for o in found.offsets], dtype=np.int64)
            ends = np.cumsum([len(r) + 1 for r in others])
            cut = np.searchsorted(at, np.r_[0, ends]) * 4
            known.update(zip(others, (ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), strict=True))


_encoders: dict[str, Encoder] = {}  # of this worker process, so that later tasks find the cache filled


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([END], dtype="<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), text_rows(b), strict=True):
                ids = memoryview((encode(raw.decode("utf-8", "replace")) if raw else b"") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    return documents_of(docs).mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of ceil(sum u(length)) over two families of dual-feasible functions; count: how many pieces have each length.

    u_t: 1 above capacity - t, 0 below t, the share of the capacity between (t up to half of it).
    v_k: share x of the capacity times k + 1 if that is whole, else its floor, over k (k = 1 counts those over half).
    """
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    t = np.arange(0, capacity // 2 + 1)
    below = np.maximum(t - 1, 0)
    middle = total[capacity - t] - np.where(t > 0, total[below], 0)
    best = int((n[capacity] - n[capacity - t] + -(-middle // capacity)).max())
    x = np.flatnonzero(count)
    for k in range(1, 64):
        whole = (k + 1) * x % capacity == 0
        # whole multiples keep their share; the others are rounded down, over k
        scaled = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-int((scaled * count[x]).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence (from 0) of each piece: longest first, each into the fullest one that has room."""
    where = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by free room
    open_rooms: list[int] = []  # the sizes of room there are, sorted
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(open_rooms, size)
        if at == len(open_rooms):
            free, seq = capacity, made
            made += 1
        else:
            free = open_rooms[at]
            seq = room[free].pop()
            if not room[free]:
                del open_rooms[at]
        where[i] = seq
        free -= size
        if free:
            if not room[free]:
                insort(open_rooms, free)
            room[free].append(seq)
    return where


def _packed(rows: DataFrame, parts: int, round_: int, last: bool, capacity: int) -> DataFrame:
    """rows dealt over parts and packed: with sequence_id, offset, and whether the piece is given up for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(list(batches), _PIECE)
        length = t.column("length").to_numpy()
        seq = best_fit_decreasing(length, capacity)
        n, filled = (int(seq.max()) + 1 if len(seq) else 0), np.bincount(seq, weights=length).astype(np.int64)
        gap = n - lower_bound(length, capacity)
        given = np.zeros(n, dtype=bool)
        if gap > 0 and not last:  # the emptiest go, and a sixteenth of the others to mix with
            given[np.argsort(filled, kind="stable")[: gap + max(1, n // 16)]] = True
        order = np.lexsort((np.arange(len(seq)), seq))
        before = np.cumsum(length[order]) - length[order]
        begins = np.r_[True, seq[order][1:] != seq[order][:-1]] if len(seq) else np.zeros(0, dtype=bool)
        offset = before - np.maximum.accumulate(np.where(begins, before, 0)) if len(seq) else before
        task = (round_ << 56) + (TaskContext.get().partitionId() << 32)
        out = t.take(pa.array(order)).append_column("sequence_id", pa.array(seq[order] + task)).append_column("offset", pa.array(offset.astype(np.int64))).append_column("given_up", pa.array(given[seq[order]] if n else np.zeros(0, dtype=bool)))
        yield from out.to_batches()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, given_up boolean"
    dealt = rows.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())) if round_ == 0 else rows.repartition(parts)
    return dealt.mapInArrow(released(run), schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and in each row the certificate of the whole: n_sequences and the lower_bound that no packing can be under.

    ``rounds`` bounds the exchange; what gap is left is their difference."""
    cut = kept(pieces(docs, vocabulary, capacity), "pieces")
    names = cut.columns
    whole = cut.where(F.col("length") == capacity).select(*names, ((F.lit(rounds + 1).cast("long") * (1 << 56)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, pool = kept(whole, "whole"), cut.where(F.col("length") < capacity)
    for k in range(rounds):
        n = pool.count()
        if not n:
            break
        packed = kept(_packed(pool, -(-n // partition), k, k == rounds - 1, capacity), "packed")
        out = out.unionByName(packed.where("not given_up").drop("given_up"))
        pool = packed.where("given_up").select(*names)
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():  # a row for each length
        count[r["length"]] = r["count"]
    made = out.where("offset = 0").count()  # every sequence begins once
    return out.select("*", F.lit(made).cast("long").alias("n_sequences"), F.lit(bound_of(count, capacity)).cast("long").alias("lower_bound"))
