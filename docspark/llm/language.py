"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram (1 to 3 code points of the lower-cased text, bounded by a space on
either side) of every training document: each task gives its counts by language and bucket, which
are summed by Spark. The log-probability matrix (languages x buckets) is broadcast; a batch of
texts is scored sparsely, by summing the matrix rows of the n-grams that occur. The number of buckets is a parameter; more
languages than CELLS / buckets share fewer buckets, so that the matrix, and the sums that reach the driver, have at most CELLS cells
(up to CELLS / 256 values of lang; beyond that 256 cells for each).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no training rows
every document is ``und``; ties go to the language first in order; a null lang teaches nothing; a null
doc_id counts as held out; a long text is counted whole, in pieces; repeated rows teach and are scored each; other columns are ignored.
A letter is a code point of Unicode category L.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import documents_of, is_held_out, text_rows

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CELLS = 1 << 22
PIECE = 1 << 18  # code points hashed at a time
_LETTER = regex.compile(r"\p{L}")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))  # odd multipliers of the usual 32-bit mixers


def ngrams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the text, piece by piece; an n-gram belongs to the piece it starts in."""
    text = f" {text.lower()} "
    for i in range(0, len(text), PIECE):
        c = np.frombuffer(text[i : i + PIECE + ORDERS[-1] - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out = []
        for n in ORDERS:
            m = min(PIECE, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + m]) * _MIX[k]
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(buckets - 1))
        yield np.concatenate(out)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def count_ngrams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n over all rows with a lang. A task holds one row of buckets for each language it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, raw in zip(b.column(2).to_pylist(), text_rows(b), strict=True):
                row = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                for h in ngrams((raw or b"").decode("utf-8", "replace"), buckets):
                    row += np.bincount(h, minlength=buckets)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"])

    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string"))
    return pairs.where("lang is not null and text is not null").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (buckets x languages), log priors: from the rows that are not held out."""
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    buckets = max(256, min(BUCKETS, 1 << (CELLS // max(len(langs), 1)).bit_length() - 1))
    counts = np.zeros((buckets, len(langs)))
    sums = count_ngrams(rows, buckets).toPandas()  # a row for each cell at most
    if len(sums):
        counts[sums["bucket"].to_numpy(), np.searchsorted(langs, sums["lang"].to_numpy(dtype=str))] = sums["n"].to_numpy()
    counts += smoothing
    prior = np.array([sizes[k] for k in langs], dtype=float)
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else counts, np.log(prior / prior.sum()) if langs else prior


def predict_one(text: str | None, langs: list[str], weights: np.ndarray, prior: np.ndarray) -> tuple[str, float]:
    if not text or not langs or not has_letter(text):
        return "und", 0.0
    total = prior.copy()
    for h in ngrams(text, len(weights)):
        total += np.bincount(h, minlength=len(weights)).astype(np.float32) @ weights if len(h) > 2048 else weights[h].sum(axis=0, dtype=np.float64)
    best = int(np.argmax(total))
    return langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior probability of lang_pred)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, prior = shared.value
        for b in batches:
            found = [predict_one(t.decode("utf-8", "replace") if t else None, langs, weights, prior) for t in text_rows(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    shared = docs.sparkSession.sparkContext.broadcast(train(docs, smoothing))
    out = documents_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
