"""Exact removal of repeated substrings of LENGTH bytes, by sorted suffixes of a sampled cover.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. To find these, suffixes are
sorted one bucket at a time, and only those of a cover that equal strings share:

* Cover. In every window of LENGTH bytes one place is its anchor: the start of the k-gram with the least hash
  (leftmost of equals). The choice depends on the window's bytes alone, so equal windows have the same
  anchor at the same offset: a difference cover whose period follows the content. It has one place in 35
  bytes; a difference cover of positions modulo 73 (nine of them) has one in 8 and was measured to shuffle 3.7 times as much.
* Buckets. Anchors meet by their k-gram. Each carries a precomputed rank for long ties: the hash of
  all bytes its windows span. Anchors of equal rank are equal over all of it: all but the first are repeats,
  whatever the group's size, in one streaming pass over the sorted bucket.
* A task that samples texts combines first: of the anchors it meets with equal k-gram and rank only the
  first place needs to be sorted, the others are known repeats. They are dealt out by their place, so a passage in a third
  of all texts sends one row a batch to its bucket.
* What remains are first anchors of different ranks in one bucket (the ends of repeated passages). Their
  bytes are fetched, and the windows compared: each bucket is streamed in order of place, and a window is a
  repeat if it was met before. A bucket that holds over LIMIT of them (and over an even share of all; the end of a passage that many
  texts share) is halved by the windows' offset to the anchor, again and again: windows of one half share
  more bytes around the anchor, equal ones all of them, so these bytes are the half's key. A run gives two rows a
  step, at most, in seven steps at most; of rows that are equal over all their windows only the first goes on, the others are repeats.

A task holds one batch of anchors and, for the bucket it is in, one number for each distinct window met.

Defined cases: a null text is an empty one (nothing to remove; the checksum is that of no bytes); rows with equal
doc_id and text are one document and get equal results; rows with equal (or null) doc_id and other texts are documents of their own; texts under LENGTH bytes lose nothing; ties of places
cannot be; other columns are ignored. Window hashes are 64 bits, and only windows with equal k-grams meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import by_bucket, kept, keyed_documents_of, mixed, powers, text_rows

LENGTH = 100
GRAM = 24
NO_ID = (1 << 63) - 1  # stands for a null doc_id
KEY = ["doc_id", "text_hash"]  # of a text: its place in the order, too
LIMIT, MOST = 256, 1 << 14  # runs of one bucket that are compared in one place, whatever the share of a task, and at most; larger buckets are halved
PIECE = 1 << 20  # windows looked at together: a longer text is read in such pieces
_U = np.uint64
_BYTE = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte * base^i, and the inverse powers: the hash of [i, j) is (p[j] - p[i]) * inverse[i]."""
    up, down = powers(len(data))
    p = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=p[1:])
    return p, down


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: texts put together; ends: where each ends. For each run of windows with one anchor:
    k-gram hash, hash of the run's bytes and offsets, text number, first and last window, anchor place."""
    empty = np.zeros(0, dtype=np.int64)
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return empty, empty, empty, empty, empty, empty
    p, down = _prefix(data)
    grams = len(data) - GRAM + 1
    key = mixed((p[GRAM:] - p[:grams]) * down[:grams])
    place = np.arange(grams, dtype=_U)
    ranked = (key & ~_U((1 << 24) - 1)) | place
    w = LENGTH - GRAM + 1
    pad = -len(ranked) % w
    blocks = np.r_[ranked, np.full(pad, ~_U(0))].reshape(-1, w)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(before[:windows], after[w - 1 : w - 1 + windows])
    anchor = (least & _U((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(windows), side="right")
    inside = np.arange(windows) + LENGTH <= ends[text]
    begins = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    # a run ends where the next one begins, or at the last window of its text
    starts = np.r_[0, ends[:-1]]
    first = begins
    last = np.minimum(np.r_[begins[1:], windows] - 1, ends[text[first]] - LENGTH)
    at = anchor[first]
    rank = (p[last + LENGTH] - p[first]) * down[first]
    rank = mixed(rank ^ mixed((at - first).astype(_U) * _U(257) + (last - first).astype(_U)))
    return key[at].view(np.int64), rank.view(np.int64), text[first], first - starts[text[first]], last - starts[text[first]], at - starts[text[first]]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, int]]:
    """(row, bytes, offset of the bytes in their text): long texts overlap by what a window needs."""
    for row, raw in enumerate(text_rows(batch)):
        for at in range(0, max(len(raw or b"") - LENGTH + 1, 0), PIECE):
            yield row, raw[at : at + PIECE + LENGTH - 1], at


def _grouped(batch: pa.RecordBatch) -> Iterator[list[tuple[int, bytes, int]]]:
    some: list[tuple[int, bytes, int]] = []
    size = 0
    for x in _pieces(batch):
        some.append(x)
        size += len(x[1])
        if size >= PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _sampled(texts: DataFrame) -> DataFrame:
    """gram, rank, doc_id, text_hash, first, span, known: for each run of windows with one anchor (span: last - first).
    known: an equal run with an earlier place was met in the same batch; gram then only deals the row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0), b.column(2)
            for some in _grouped(b):
                data = np.frombuffer(b"".join(x[1] for x in some), dtype=np.uint8)
                gram, rank, text, first, last, _ = anchors(data, np.cumsum([len(x[1]) for x in some]))
                row, shift = np.array([x[0] for x in some]), np.array([x[2] for x in some])
                of = pa.array(row[text])
                doc, own, place = ids.take(of).to_numpy(), hashes.take(of).to_numpy(), first + shift[text]
                order = np.lexsort((place, own, doc, rank, gram))
                same = np.r_[False, (gram[order][1:] == gram[order][:-1]) & (rank[order][1:] == rank[order][:-1])] if len(order) else np.zeros(0, dtype=bool)
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                known = np.zeros(len(order), dtype=bool)
                known[order] = same & ((doc[order] != doc[head]) | (own[order] != own[head]) | (place[order] != place[head]))
                gram = np.where(known, mixed((own * 31 + place).view(_U)).view(np.int64), gram)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(rank), pa.array(doc), pa.array(own), pa.array(place), pa.array((last - first).astype(np.int32)), pa.array(known)], names=["gram", "rank", "doc_id", "text_hash", "first", "span", "known"])

    return texts.mapInArrow(run, "gram long, rank long, doc_id long, text_hash long, first long, span int, known boolean")


def _sorted_out(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, span, unsure, gram: repeats (unsure is false, gram 0), and the first of its rank in a bucket of several ranks (true)."""
    names = ["doc_id", "text_hash", "first", "span", "unsure", "gram"]

    def told(doc: np.ndarray, own: np.ndarray, first: np.ndarray, span: np.ndarray, gram: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(own), pa.array(first), pa.array(span), pa.array(np.full(n, gram is not None)), pa.array(np.zeros(n, dtype=np.int64) if gram is None else gram)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: tuple | None = None  # gram, rank, doc_id, text_hash, first, span, told: the first row of the rank that is being read
        for b in batches:
            if not b.num_rows:
                continue
            gram, rank, doc, own, first, span, known = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if known.any():
                yield told(doc[known], own[known], first[known], span[known])
                gram, rank, doc, own, first, span = (c[~known] for c in (gram, rank, doc, own, first, span))
                if not len(gram):
                    continue
            fresh = np.r_[True, (gram[1:] != gram[:-1]) | (rank[1:] != rank[:-1])]
            if lead is not None and (lead[0], lead[1]) == (gram[0], rank[0]):
                fresh[0] = False
            heads = np.flatnonzero(fresh)
            of = np.cumsum(fresh) - 1  # which head a row is under; -1: the one from before
            repeat = np.zeros(len(gram), dtype=bool)
            for k, c in ((2, doc), (3, own), (4, first)):
                repeat |= c != np.r_[c[heads], lead[k] if lead else 0][of]
            yield told(doc[repeat], own[repeat], first[repeat], span[repeat])
            # heads that share their bucket with another head
            g, d, o, f, s = (np.r_[np.array([lead[k]] if lead else [], dtype=c.dtype), c[heads]] for k, c in ((0, gram), (2, doc), (3, own), (4, first), (5, span)))
            same = g[1:] == g[:-1]
            several = np.r_[False, same] | np.r_[same, False]
            tell = several.copy()
            if lead:
                tell[0] &= not lead[6]
            yield told(d[tell], o[tell], f[tell], s[tell], g[tell])
            if len(heads):
                h = heads[-1]
                lead = (gram[h], rank[h], doc[h], own[h], first[h], span[h], bool(several[-1]))
            elif lead:
                lead = (*lead[:6], bool(lead[6] or several[-1]))

    bucket = rows.repartition("gram").sortWithinPartitions("gram", "rank", "doc_id", "text_hash", "first")
    return bucket.mapInArrow(run, "doc_id long, text_hash long, first long, span int, unsure boolean, gram long")


def _fetched(texts: DataFrame, unsure: DataFrame) -> DataFrame:
    """key (the gram), lo, hi, doc_id, text_hash, first, data: the bytes that the windows of each unsure run span. lo, hi: least and greatest
    distance from a window's start to its anchor that the key stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, own, raw, runs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), text_rows(b), b.column(3).to_pylist(), strict=True):
                out += [(r["gram"], 0, LENGTH - GRAM, i, own, r["first"], (raw or b"")[r["first"] : r["first"] + r["span"] + LENGTH]) for r in runs]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values(), strict=True)], names=list(_TYPES))

    runs = unsure.groupBy(*KEY).agg(F.collect_set(F.struct("first", "span", "gram")).alias("runs"))  # of one text
    return texts.join(runs, KEY).select("doc_id", "text", "text_hash", "runs").mapInArrow(run, _ROW)


_TYPES = {"key": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "first": pa.int64(), "data": pa.binary()}
_ROW = "key long, lo int, hi int, doc_id long, text_hash long, first long, data binary"


def _halves(rows: DataFrame) -> DataFrame:
    """rows (as _fetched gives them) by the halves of lo to hi that have windows of theirs; key: a hash of the half and of the bytes that all its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):  # of under 2 * LENGTH bytes each
                some = batch.slice(k, 4096)
                key, lo, hi, doc, own, first = (some.column(i).to_numpy() for i in range(6))
                data = some.column(6).to_pylist()
                size = np.array([len(x) for x in data], dtype=np.int64)
                whole = np.frombuffer(b"".join(data), dtype=np.uint8)
                starts = np.cumsum(size) - size
                at = anchors(whole, starts + size)[5]  # all windows of a row have one anchor
                p, down = _prefix(whole)
                mid = (lo + hi) // 2
                for low, high in ((lo, mid), (mid + 1, hi)):
                    least, most = np.maximum(low, at - (size - LENGTH)), np.minimum(high, at)
                    i, j = starts + at - low, starts + at + LENGTH - high
                    ok = np.flatnonzero(least <= most)
                    i, j = i[ok], j[ok]
                    part = mixed(((p[j] - p[i]) * down[i]) ^ mixed(key[ok].view(_U) ^ mixed((low[ok] * LENGTH + high[ok] + 1).astype(_U))))
                    begin, end = (at - most)[ok], (at - least)[ok] + LENGTH
                    bytes_ = pa.array([data[r][x:y] for r, x, y in zip(ok, begin, end, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(low[ok]), pa.array(high[ok]), pa.array(doc[ok]), pa.array(own[ok]), pa.array(first[ok] + begin), bytes_], names=list(_TYPES))

    return rows.mapInArrow(run, _ROW)


def _dealt(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """rows in buckets of at most ``limit`` by their keys; and doc_id, text_hash, first, span of runs whose bytes stand at an earlier place as well."""
    settled, repeats = None, None
    place = F.struct(*KEY, "first")
    while True:
        hot = kept(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key"), "hot-buckets")  # a row for limit rows, at most
        rest = rows.join(F.broadcast(hot), "key", "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        if hot.isEmpty():
            return settled, repeats
        halves = kept(_halves(rows.join(F.broadcast(hot), "key", "left_semi")), "halves").withColumn("all", F.xxhash64("data"))
        # of rows that are equal over all their windows the first is compared with others
        leads = halves.groupBy("key", "all").agg(F.min(place).alias("lead"))
        led = kept(halves.join(leads, ["key", "all"]).withColumn("leads", place == F.col("lead")).drop("all", "lead"), "led")
        later = led.where("not leads").select(*KEY, "first", (F.octet_length("data") - LENGTH).alias("span"))
        repeats = later if repeats is None else repeats.unionByName(later)
        rows = led.where("leads").drop("leads")


def _resolved(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, span: runs of windows that were met before in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, met = None, np.zeros(0, dtype=_U)  # windows met before in the bucket that is being read
        before: tuple | None = None  # the last row: a document that is there twice gives each row twice
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                found = batch.slice(k, 4096).to_pydict()
                fresh = []
                for x in zip(found["key"], found["doc_id"], found["text_hash"], found["first"], found["data"], strict=True):
                    if x != before:
                        fresh.append(x)
                    before = x
                if not fresh:
                    continue
                data = [x[4] for x in fresh]
                key, doc, own, first = (np.array([x[i] for x in fresh], dtype=np.int64) for i in range(4))
                size = np.array([len(x) for x in data])
                whole = np.frombuffer(b"".join(data), dtype=np.uint8)
                starts = np.cumsum(size) - size
                n = size - LENGTH + 1
                row = np.repeat(np.arange(len(data)), n)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = starts[row] + offset
                p, down = _prefix(whole)
                h = mixed(((p[at + LENGTH] - p[at]) * down[at]) ^ mixed(key[row].view(_U)))
                order = np.lexsort((np.arange(len(h)), h))
                again = np.zeros(len(h), dtype=bool)
                again[order[1:]] = h[order[1:]] == h[order[:-1]]
                # equal places are no repeats of each other
                source = order[np.maximum.accumulate(np.where(again[order], 0, np.arange(len(h))))]
                same = np.zeros(len(h), dtype=bool)
                same[order] = (doc[row[order]] == doc[row[source]]) & (own[row[order]] == own[row[source]]) & (first[row[order]] + offset[order] == first[row[source]] + offset[source])
                again &= ~same
                if bucket is not None and len(met):
                    mine = key[row] == bucket
                    again[mine] |= np.isin(h[mine], met)
                mine = np.unique(h[key[row] == key[-1]])
                met = np.union1d(met, mine) if bucket == key[-1] else mine
                bucket = key[-1]
                hit = np.flatnonzero(again)
                if len(hit):
                    cut = np.r_[True, (row[hit][1:] != row[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1)]
                    heads = np.flatnonzero(cut)
                    ends = np.r_[heads[1:], len(hit)] - 1
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row[hit[heads]]]), pa.array(own[row[hit[heads]]]), pa.array(first[row[hit[heads]]] + offset[hit[heads]]), pa.array((offset[hit[ends]] - offset[hit[heads]]).astype(np.int32))], names=["doc_id", "text_hash", "first", "span"])

    bucket = rows.select("key", *KEY, "first", "data").repartition("key").sortWithinPartitions("key", "doc_id", "text_hash", "first")
    return bucket.mapInArrow(run, "doc_id long, text_hash long, first long, span int")


def _cut(texts: DataFrame, repeats: DataFrame, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, runs in zip(text_rows(b), b.column(3).to_pylist(), strict=True):
                raw = raw or b""
                spans: list[list[int]] = []
                for r in sorted(runs or [], key=lambda r: r["first"]):
                    end = r["first"] + r["span"] + LENGTH
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([r["first"], end])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                left = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    runs = repeats.groupBy(*KEY).agg(F.collect_set(F.struct("first", "span")).alias("runs"))  # of one text
    joined = texts.join(runs, KEY, "left").select("doc_id", "text", "text_hash", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _once(texts: DataFrame) -> DataFrame:
    """texts with one row for each doc_id and text. Only rows that repeat another one (and rows of their buckets) are shuffled, and combined before that."""
    several = kept(texts.groupBy(*KEY).count().where("count > 1").select(*KEY), "repeated-rows")
    if several.isEmpty():
        return texts
    return by_bucket(texts, KEY, several, KEY, "left_anti").unionByName(by_bucket(texts, KEY, several, KEY, "left_semi").dropDuplicates(KEY))


def _share(runs: DataFrame) -> int:
    """What a bucket may hold: an even share of the runs among partitions, between LIMIT and MOST. A larger one would make its task stand out."""
    return max(LIMIT, min(MOST, runs.count() // int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def without_repeats(docs: DataFrame, keep_text: bool = False, limit: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, if asked for). limit: of runs in a bucket, see _share.

    A null doc_id counts as the largest. Rows of one doc_id are told apart by their texts, in the order of the texts' hashes.
    """
    texts = keyed_documents_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    once = _once(texts)
    found = kept(_sorted_out(_sampled(once)), "anchors")
    runs = kept(_fetched(once, found.where("unsure")), "runs")
    settled, known = _dealt(runs, _share(runs) if limit is None else limit)
    repeats = found.where("not unsure").select(*KEY, "first", "span").unionByName(kept(_resolved(settled), "ends"))
    if known is not None:
        repeats = repeats.unionByName(known)
    return _cut(texts, repeats, keep_text).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
