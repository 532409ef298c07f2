"""Benchmark decontamination: rare n-gram seeds join texts to test items, then Smith-Waterman alignment.

1. Items are cut into words and 3-grams (64-bit hashes), as a table of Spark's. A first pass over the texts counts in how many
   documents each n-gram of an item stands (sums only, added up in the tasks before they are shuffled).
2. The rare n-grams of each item are its seeds: those in at most 1 of 1,000 documents, or in at most RARE times as
   many as nine tenths of the item's n-grams that occur at all. So an item that is copied all over the corpus
   keeps its seeds, even when each copy is edited or a part.
3. A second pass gives the places of seeds in the texts, and Spark joins them to the items by n-gram. Where at least two
   distinct seeds of an item (one, if it has no more; an eighth of them, if that is more) stand close together, no further
   apart than a quarter of the item, the words from an item's length before to an item's length after are a passage.
4. Each passage is aligned to the whole item's words, whatever its length. Score: matches 2, mismatches and gaps -1, as a share
   of a perfect copy's; ``min_score`` and over is a leak.

Nothing of the benchmark is held whole by the driver or a task. Both passes first look n-grams up in a bit set of fixed size
(2^BITS bits); what it lets pass by chance falls away in the join. Only the alignment holds one item and one passage
at a time, and for them rows of the passage's length.

Defined cases: null or empty items and texts match nothing; an item shorter than three words has no
seed and matches nothing (any text may hold it by chance); equal items each match; rows with the same doc_id and item give the
best score once, and ``without_leaks`` judges each row by its own text, also where doc_id is null or repeated.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import gram_hashes, kept, keyed_documents_of, mixed, powers, released, rows_of, run_hashes, text_rows

N = 3
RARE = 8
BITS = 26
MATCH, MISS, GAP = 2, -1, -1
MIN_SCORE = 0.5
PIECE = 1 << 17  # code points of a text that are looked at together
CELLS = 200_000  # words of passages that are aligned together
_U = np.uint64
_points: list[np.ndarray] = []


def _code_points() -> np.ndarray:
    """Of each code point: a hash if it is part of a word (what \\w matches), else 0."""
    if not _points:
        every = mixed(np.arange(1, sys.maxunicode + 2, dtype=_U) * powers(1)[0][1])
        _points.append(np.where(np.fromiter((chr(i).isalnum() or i == 95 for i in range(len(every))), dtype=bool, count=len(every)), every, _U(0)))
    return _points[0]


def word_hashes(low: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (\\w+) of a lower-cased text, and where it begins."""
    points = _code_points()
    return run_hashes(len(low), lambda i, j: points[np.frombuffer(low[i:j].encode("utf-32-le", "surrogatepass"), dtype="<u4")], PIECE)


def _low(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace").lower()


def _words(raw: bytes | None) -> np.ndarray:
    return word_hashes(_low(raw))[0]


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and hash of every gram of the batch's texts, some texts at a time (short ones are hashed together)."""
    rows: list[int] = []
    some: list[str] = []
    size = 0
    for i, raw in enumerate(text_rows(batch)):
        rows.append(i)
        some.append(_low(raw))
        size += len(some[-1])
        if size < PIECE and i + 1 < batch.num_rows:
            continue
        w, begin = word_hashes("\n".join(some))
        of = np.searchsorted(np.cumsum([len(x) + 1 for x in some]), begin, side="right")
        place = np.arange(len(w)) - np.searchsorted(of, np.arange(len(some)))[of]
        h = gram_hashes(w, N)
        own = of[: len(h)] == of[N - 1 :][: len(h)]
        yield np.array(rows)[of[: len(h)][own]], place[: len(h)][own], h[own]
        rows, some, size = [], [], 0


def item_table(benchmark: DataFrame) -> DataFrame:
    """item (a number of each row), item_id, n (words), words, grams (distinct) of the items that have a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, w) for i, k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(_words, text_rows(b)), strict=True) if len(w) >= N]
            columns = [[x[0] for x in rows], [x[1] for x in rows], [len(x[2]) for x in rows], [x[2].view(np.int64) for x in rows], [np.unique(gram_hashes(x[2], N)).view(np.int64) for x in rows]]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "item_id", "n", "words", "grams"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(released(run), "item long, item_id long, n long, words array<long>, grams array<long>")


def _bit_set(grams: DataFrame) -> np.ndarray:
    """2^BITS bits, one set for each gram: at most 2^BITS / 8 bytes reach the driver."""
    bit = F.pmod("gram", F.lit(1 << BITS)) + 1
    bits = np.zeros(1 << BITS - 3, dtype=np.uint8)
    found = grams.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
    for row in found.collect():
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        bits[(row["k"] - 1) * 4096 :][: len(part)] = part[: len(bits) - (row["k"] - 1) * 4096]
    return bits


def _passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bit set knows."""
    k = h & _U((1 << BITS) - 1)
    return np.flatnonzero(bits[k >> _U(3)] >> (k & _U(7)).astype(np.uint8) & 1)


def _frequencies(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """gram, n: the documents that hold each gram of the bit set."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(met: list[np.ndarray]) -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(met), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

        met, size = [np.zeros(0, dtype=_U)], 0
        for b in batches:
            for row, _, h in _grams(b):
                at = _passing(h, shared.value)
                order = at[np.lexsort((h[at], row[at]))]
                first = np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])] if len(order) else order
                met.append(h[order][first])
                size += len(met[-1])
                if size > 1 << 20:
                    yield sums(met)
                    met, size = [np.zeros(0, dtype=_U)], 0
        yield sums(met)

    return texts.select("text").mapInArrow(released(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def seeds_of(items: DataFrame, frequency: DataFrame, documents: int) -> DataFrame:
    """gram, item, n (the item's words), enough (distinct seeds that a passage needs): the rare n-grams of each item that occur."""
    grams = items.select("item", F.col("n").alias("words"), F.explode("grams").alias("gram")).join(frequency, "gram")
    by = Window.partitionBy("item")
    usual = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").over(by)
    rare = grams.withColumn("usual", usual).where(F.col("n") <= F.greatest(RARE * F.col("usual"), F.lit(documents // 1000)))
    return rare.select("gram", "item", F.col("words").alias("n"), F.greatest(F.least(F.count("*").over(by), F.lit(2)), F.floor(F.count("*").over(by) / 8)).alias("enough"))


def _places(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, text_hash, gram, place: where grams of the bit set stand."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, place, h in _grams(b):
                at = _passing(h, shared.value)
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array(h[at].view(np.int64)), pa.array(place[at])], names=["doc_id", "text_hash", "gram", "place"])

    return texts.mapInArrow(released(run), "doc_id long, text_hash long, gram long, place long")


def passages(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, text_hash, item, first, last (exclusive, may reach beyond the text): where enough seeds of an item stand close together."""
    row = ["doc_id", "text_hash", "item"]
    by = Window.partitionBy(*row).orderBy("place")
    hits = places.join(seeds, "gram")  # rows that are there twice give their places twice, which changes nothing below
    begins = F.when(F.col("place") - F.lag("place").over(by) <= F.greatest(F.floor(F.col("n") / 4), F.lit(8)), 0).otherwise(1)
    runs = hits.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by)).groupBy(*row, "run")
    found = runs.agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("n").alias("n"), F.count_distinct("gram").alias("met"), F.max("enough").alias("enough"))
    return found.where("met >= enough").select(*row, F.greatest(F.col("a") - F.col("n"), F.lit(0)).alias("first"), (F.col("b") + N + F.col("n")).alias("last"))


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair, and the place in the window where (first) it ends, exclusive. Words are equal if their numbers are."""
    score, end = np.zeros(len(items), dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    size = np.array([max(len(x), len(y)) for x, y in zip(windows, items, strict=True)], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        width = int(size[order[at]])
        some = order[at : at + max(1, CELLS // max(width, 1))]
        some = some[size[some] <= 2 * width + 16]
        at += len(some)
        m, n = max(len(windows[i]) for i in some), max(len(items[i]) for i in some)
        x, y = np.zeros((len(some), m), dtype=_U), np.zeros((len(some), n), dtype=_U)
        in_x, in_y = np.zeros((len(some), m), dtype=bool), np.zeros((len(some), n), dtype=bool)
        for r, i in enumerate(some):
            x[r, : len(windows[i])], y[r, : len(items[i])] = windows[i], items[i]
            in_x[r, : len(windows[i])], in_y[r, : len(items[i])] = True, True
        ramp = -GAP * np.arange(m)
        h, best, last = np.zeros((len(some), m), dtype=np.int64), np.zeros(len(some), dtype=np.int64), np.zeros(len(some), dtype=np.int64)
        for j in range(n if m else 0):
            up = np.where((x == y[:, j : j + 1]) & in_x & in_y[:, j : j + 1], MATCH, MISS)
            up[:, 1:] += h[:, :-1]
            t = np.maximum(np.maximum(up, h + GAP), 0)
            h = np.maximum.accumulate(t + ramp, axis=1) - ramp
            top = h.argmax(axis=1)
            now = h[np.arange(len(some)), top]
            last, best = np.where(now > best, top, last), np.maximum(now, best)
        score[some], end[some] = best, last + 1
    return score, end


def _aligned(texts: DataFrame, wanted: DataFrame, items: DataFrame, min_score: float) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word, end_word of the passages that are leaks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (raw, runs) in enumerate(zip(text_rows(b), b.column(3).to_pylist(), strict=True)):
                w = _words(raw).view(np.int64)
                parts = [w[r["first"] : r["last"]] for r in runs]
                of = pa.array(np.full(len(runs), k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array([r["item"] for r in runs], pa.int64()), pa.array([r["first"] for r in runs], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "item", "first", "passage"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                windows, words = ([np.asarray(x.values, dtype=np.int64).view(_U) for x in b.column(k)] for k in (4, 5))
                score, end = smith_waterman(words, windows)
                share = score / np.array([MATCH * len(x) for x in words])
                leak = np.flatnonzero(share >= min_score)
                back, begin = smith_waterman([words[i][::-1] for i in leak], [windows[i][: end[i]][::-1] for i in leak])
                first, of = b.column(3).to_numpy()[leak], pa.array(leak)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), b.column(2).take(of), pa.array(share[leak]), pa.array(first + end[leak] - begin), pa.array(first + end[leak])], names=["doc_id", "text_hash", "item_id", "score", "first_word", "end_word"])

    runs = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "first", "last")).alias("runs"))  # of one text
    runs = runs.select(F.col("doc_id").alias("run_id"), F.col("text_hash").alias("run_hash"), "runs")
    both = texts.join(runs, F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("text_hash") == F.col("run_hash"))).select("doc_id", "text", "text_hash", "runs")
    # written, so that no task has two Python workers at once: an executor keeps as many as it ever needed
    cuts = kept(both.mapInArrow(released(cut), "doc_id long, text_hash long, item long, first long, passage array<long>"), "cuts")
    pairs = cuts.join(items.select("item", "item_id", "words"), "item").select("doc_id", "text_hash", "item_id", "first", "passage", "words")
    return pairs.select("doc_id", "text_hash", "item_id", "first", "passage", "words").mapInArrow(released(align), "doc_id long, text_hash long, item_id long, score double, first_word long, end_word long")


def _leaks(docs: DataFrame, benchmark: DataFrame, min_score: float) -> DataFrame:
    texts = keyed_documents_of(docs)
    items = kept(item_table(benchmark), "items")
    grams = items.select(F.explode("grams").alias("gram"))
    documents = texts.count()
    frequency = _frequencies(texts, _bit_set(grams)).join(grams.distinct(), "gram", "left_semi")
    seeds = kept(seeds_of(items, kept(frequency, "frequencies"), documents), "seeds")
    wanted = kept(passages(kept(_places(texts, _bit_set(seeds)), "places"), seeds), "passages")
    return _aligned(texts, wanted, items, min_score)


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word (words of the text, end exclusive): the best place of each pair."""
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "end_word")).alias("b")
    out = _leaks(docs, benchmark, min_score).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "b.score", (-F.col("b.at")).alias("first_word"), "b.end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents without a leak. Columns as they came."""
    bad = kept(_leaks(docs, benchmark, min_score).select("doc_id", "text_hash").distinct(), "leaks")
    return rows_of(docs, bad, "left_anti")
