"""Periodic runs of words, found on an enhanced suffix array, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``max(shortest, times * q)`` that no neighbouring word extends. For every text:

* Words become numbers, numbered apart for each text, so that some texts are put together and their suffixes sorted at once;
  no common prefix reaches over a text's end.
* Suffix array by prefix doubling; a round sorts only the suffixes that are still tied. The ranks of each round are kept,
  and give the common prefix of neighbours (LCP) by descending powers of two.
* LCP intervals are places and ranges of the LCP array (next and last smaller value by range minima), not tree nodes. An interval
  of depth d with its children is a node of the suffix tree; all suffixes i of its children but the largest are tested:
  if the suffix i + d (or i - d) lies in the same interval, by its rank (ISA), and in another child, then i (or i - d) begins
  a square of period d that the next word does not carry on: a branching tandem repeat. Each run of period q has exactly one of
  them with d = q, at its end.
* A square is rotated to the left as long as the words agree, which gives the run. Squares with one end are taken by ascending
  period; where a shorter period already covers one, it is no run of its own.

The work is a narrow pass over the texts, with no shuffle. A task holds one Arrow batch, and of the texts together (WORDS words, or
one longer text) some 8 bytes a word for each doubling of the longest common prefix.

Defined cases: a null or empty text has no words and no run, and collapses to an empty text; a null doc_id is carried; each row
is read by itself, so repeated rows get equal results; a long text is read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import documents_of, text_rows

SHORTEST, TIMES = 6, 4
WORDS = 1 << 16  # words whose suffixes are sorted together


def suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and LCP with the suffix before (0 for the first). symbols: no two texts share one; ends: where each word's text ends."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    levels, step = [], 1
    # rank: the place in sa of the first suffix of its class
    heads = np.r_[True, rank[sa][1:] != rank[sa][:-1]]
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    while True:
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
        size = np.diff(np.r_[np.flatnonzero(heads), n])
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in sa
        if not len(tied):
            break
        i = sa[tied]
        after = i + step
        second = np.where(after < ends[i], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(rank[i] * (n + 1) + second, kind="stable")
        i, second = i[order], second[order]
        sa[tied] = i
        first = rank[i]
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        heads[tied] = fresh
        rank[i] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))]
        step *= 2
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        at = np.flatnonzero(symbols[sa[1:]] == symbols[sa[:-1]]) + 1
        a, b = sa[at].copy(), sa[at - 1].copy()
        end_a, end_b = ends[a], ends[b]
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < end_a) & (b < end_b)
            same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            a += np.where(same, 1 << k, 0)
            b += np.where(same, 1 << k, 0)
        lcp[at] = a - sa[at]
    isa = np.empty(n, dtype=np.int64)
    isa[sa] = np.arange(n)
    return sa, isa, lcp


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Level k: the least of each 2^k values that begin here."""
    out = [x]
    while len(out[-1]) > 1 << (len(out) - 1):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _next_to(table: list[np.ndarray], at: np.ndarray, value: np.ndarray, equal: bool) -> np.ndarray:
    """From each place (itself included) the first one to the right whose value is smaller (or equal). The last value of all is the least."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        level = table[k]
        inside = at < len(level)
        least = level[np.minimum(at, len(level) - 1)]
        at += np.where(inside & ((least > value) if equal else (least >= value)), 1 << k, 0)
    return at


def squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, ends: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of the branching tandem repeats whose period is at most most[begin's text] (given by word)."""
    n = len(sa)
    at = np.flatnonzero(lcp > 0)
    at = at[lcp[at] <= most[sa[at]]]
    if not len(at):
        return at, at
    right, left = np.r_[lcp, -1], np.r_[lcp[::-1], -1]
    up, down = _minima(right), _minima(left)
    depth = lcp[at]
    high = _next_to(up, at + 1, depth, False)  # end of the interval
    cut = _next_to(up, at + 1, depth, True)  # end of the child that begins here
    low = n - 1 - _next_to(down, n - at, depth, False)  # begin of the interval; a place of the reversed array is n - 1 - place
    last = n - 1 - _next_to(down, n - at, depth, True)  # the last place before with as small a value
    heads = lcp[last] < depth  # the leftmost cut of its interval: the child before it begins the interval
    begin, end = np.r_[at, low[heads]], np.r_[cut, at[heads]]
    low, high, depth = np.r_[low, low[heads]], np.r_[high, high[heads]], np.r_[depth, depth[heads]]
    # all children but the largest of each interval
    order = np.lexsort((begin - end, low, high, depth))
    same = np.r_[False, (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1]) & (depth[order][1:] == depth[order][:-1])]
    small = order[same]
    begin, end, low, high, depth = (x[small] for x in (begin, end, low, high, depth))
    found_at, found_period = [], []
    size = end - begin
    for k in _chunks(size):
        count = size[k]
        of = np.repeat(np.arange(len(count)), count)
        place = np.repeat(begin[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        i, d = sa[place], depth[k][of]
        lo, hi, own, own_end = low[k][of], high[k][of], begin[k][of], end[k][of]
        for other, first in ((i + d, i), (i - d, i - d)):
            there = isa[np.clip(other, 0, n - 1)]
            ok = (other >= 0) & (other < n) & (there >= lo) & (there < hi) & ((there < own) | (there >= own_end))
            found_at.append(first[ok])
            found_period.append(d[ok])
    if not found_at:
        return at[:0], at[:0]
    both = np.unique(np.concatenate(found_at) * (n + 1) + np.concatenate(found_period))
    return both // (n + 1), both % (n + 1)


def _chunks(size: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")), at + 1)
        yield slice(at, to)
        at = to


def _leftmost(symbols: np.ndarray, at: int, period: int, floor: int) -> int:
    """The first place from which on words period apart agree up to at."""
    step = max(16, period)
    while at > floor:
        lo = max(floor, at - step)
        differ = np.flatnonzero(symbols[lo:at] != symbols[lo + period : at + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        at, step = lo, 2 * step
    return at


def runs(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, sorted by start, then period. begins, ends: of the text of each word."""
    if len(symbols) < shortest:
        return []
    sa, isa, lcp = suffixes(symbols, ends)
    at, period = squares(sa, isa, lcp, ends, (ends - begins) // max(times, 2))
    out: list[tuple[int, int, int]] = []
    end = at + 2 * period
    long = end - begins[at] >= np.maximum(shortest, times * period)
    at, period, end = at[long], period[long], end[long]
    before, covered = -1, []  # of one end: start and period of the runs so far
    for k in np.lexsort((period, end)).tolist():
        p, q, e = int(at[k]), int(period[k]), int(end[k])
        if e != before:
            before, covered = e, []
        if any(q % r == 0 and s <= p for s, r in covered):
            continue
        s = _leftmost(symbols, p, q, int(begins[p]))
        covered.append((s, q))
        if e - s >= max(shortest, times * q):
            out.append((s, e - s, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _together(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    some: list[list[bytes]] = []
    size = 0
    for raw in texts:
        some.append((raw or b"").split())  # on bytes: at the six ASCII spaces only
        size += len(some[-1])
        if size >= WORDS:
            yield some
            some, size = [], 0
    if some:
        yield some


def _found(some: list[list[bytes]], shortest: int, times: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    symbols, used = [], 0
    for words in some:
        ids: dict[bytes, int] = {}
        symbols.append(np.fromiter(map(ids.setdefault, words, range(len(words))), dtype=np.int64, count=len(words)) + used)  # where a word stands first
        used += len(words)
    size = np.array([len(w) for w in some])
    end = np.cumsum(size)
    every = runs(np.concatenate(symbols), np.repeat(end - size, size), np.repeat(end, size), shortest, times)
    of = np.searchsorted(end, np.array([r[0] for r in every], dtype=np.int64), side="right").tolist()
    each: list[list[tuple[int, int, int]]] = [[] for _ in some]
    for k, (start, length, period) in zip(of, every, strict=True):
        each[k].append((start - int(end[k] - size[k]), length, period))
    yield from zip(some, each, strict=True)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed: the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in _together(text_rows(b)):
                count, found, left = [], [], []
                for words, each in _found(some, shortest, times):
                    count.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in each])
                    stay = kept_words(len(words), each).tolist() if each else None
                    left.append(b" ".join([w for w, k in zip(words, stay, strict=True) if k] if stay else words))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(count, pa.int64()), pa.array(found, _RUN), pa.array(left, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(some)

    out = documents_of(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """Of periodic_runs: doc_id, n_runs, the run with the greatest exponent, and checksums of all runs and of the collapsed text."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a))  # runs come by start, then period: the first of equals stays
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * top.length) div top.period")
    return best.select("doc_id", "n_runs", F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of a tenth of the documents (by crc32 of doc_id) the words from one place on repeat with a period, both given by that crc32."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t-\r]+", -1), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    hit = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    rows = rows.select("doc_id", "text", "g", F.when(hit, words).alias("w"))
    n = F.size("w").cast("long")
    rows = rows.select("*", n.alias("n"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    rows = rows.withColumn("a", a).withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).otherwise(i)
    new = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))
