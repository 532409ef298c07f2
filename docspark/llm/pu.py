"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows with label 1; all other training texts, labelled or not, are the
unlabelled web text. With a class prior pi, the non-negative unbiased risk

    pi * mean_P l(g) + max(0, mean_U l(-g) - pi * mean_P l(-g)),      l(z) = 1 / (1 + e^z)

is minimised over a linear g with Adam. g reads the text: its words and pairs of words, and its characters
in runs of one to three, each hashed with a sign into WORDS and CHARS buckets (roots of counts, scaled to length 1), and the
rule statistics (see rules.features). Every step is one Spark job
over all unlabelled rows (their inputs, written once as bytes; PRIOR_STEPS + STEPS + 2 passes in all); only sums of gradients reach the driver. Where the
second term is negative its gradient is reversed, as non-negative PU learning does. The positives are those of at most
POSITIVES doc_ids, and rules.TEXTS different texts of each (a documented bound on labelled rows).

The class prior is estimated from positives and unlabelled rows alone (best bin estimation): a first g is fitted to tell half
of the positives from the unlabelled rows; of all thresholds c on it, with q the share of rows scored c or more among the
other half and among the unlabelled rows, the prior is q_U(c) / q_P(c) where that share plus its confidence bound is least.

Defined cases: a null text is an empty one and is scored; null labels are ignored; a doc_id with several
labels takes the largest; repeated rows are scored each and count each as unlabelled text; a long text is read whole, extra columns change nothing; with no positives every score is 0.5 less a hair (predicted 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import documents_of, is_held_out, kept, mixed, text_rows
from docspark.llm.decontaminate import word_hashes
from docspark.llm.language import ngrams
from docspark.llm.rules import COUNTS, FEATURES, bounded, features, few_texts, marks_of, text_counts

POSITIVES = 20_000
WORDS, CHARS = 128, 128
PRIOR_STEPS, STEPS, RATE, DECAY = 15, 25, 0.35, 1e-3
BINS = 1000
GATHER = 8
HASHED = WORDS + CHARS
INPUTS = 3 * FEATURES + HASHED + 1


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v / max(float(np.sqrt((v * v).sum())), 1e-9)


def hashed(raw: bytes) -> np.ndarray:
    """The text's signed sums of hashed words and word pairs, and of hashed characters, as bytes (127 is 1)."""
    text = raw.decode("utf-8", "replace")
    w, _ = word_hashes(text.lower())
    w = np.concatenate([w, mixed(w[:-1] * np.uint64(3) + w[1:])])
    words = np.bincount((w >> np.uint64(8)).astype(np.int64) % WORDS, np.where(w & np.uint64(1), 1.0, -1.0), WORDS)
    chars = np.zeros(2 * CHARS)
    for h in ngrams(text, 2 * CHARS):
        chars += np.bincount(h, minlength=2 * CHARS)
    return np.rint(127 * np.r_[_unit(words), _unit(chars[:CHARS] - chars[CHARS:])]).astype(np.int8)


def text_inputs(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS and the hashed bytes of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in text_rows(b)]
            counts = np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array([hashed(t).tobytes() for t in texts], pa.binary())], names=["doc_id", *COUNTS, "hashed"])

    return documents_of(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", hashed binary")


@dataclass
class Scale:
    mean: np.ndarray
    std: np.ndarray

    def inputs(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Standardised statistics, their sizes and squares, the hashed text, and a constant."""
        z = np.clip((x - self.mean) / self.std, -5, 5)
        return np.concatenate([z, np.abs(z), z * z / 5, text, np.ones((len(z), 1))], axis=1)


def _loss(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(z, -40, 40)))


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: b.column(b.schema.get_field_index(c))
    text = np.frombuffer(b"".join(column("hashed").to_pylist()), dtype=np.int8).reshape(-1, HASHED)
    return features(np.stack([column(c).to_numpy() for c in COUNTS], axis=1)), text.astype(np.float32) / 127


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of the vectors of(statistics, hashed text). Each task gives one vector; these are summed by GATHER tasks before they reach the driver."""

    def told(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += of(*_rows(b))
        yield from told(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_buffer())
        yield from told(total)

    found = rows.select(*COUNTS, "hashed").mapInArrow(run, "v binary").repartition(GATHER).mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in found), np.zeros(width))


def slope(v: np.ndarray, w: np.ndarray, sign: int) -> np.ndarray:
    """Sum of losses l(sign * g) over rows of inputs, then of their gradients."""
    q = _loss(sign * (v @ w))
    return np.r_[q.sum(), (-sign * q * (1 - q)) @ v]


def risk(good: np.ndarray, taken: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Non-negative risk and the gradient to follow, from the means of slope over positives (signs 1 and -1) and unlabelled rows (-1)."""
    rest = unlabelled - prior * taken
    return np.r_[prior * good[0] + max(0.0, rest[0]), (prior * good + rest if rest[0] >= 0 else -rest)[1:]]


def _descend(steps: int, gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    w, first, second = np.zeros(INPUTS), np.zeros(INPUTS), np.zeros(INPUTS)
    for step in range(1, steps + 1):
        g = gradient(w) + DECAY * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - RATE * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, error: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from counts of both by bin of score (ascending)."""
    p, u = positive.sum(), unlabelled.sum()
    q_p, q_u = np.cumsum(positive[::-1]) / p, np.cumsum(unlabelled[::-1]) / u
    some = np.flatnonzero(q_p > 0)
    bound = (1 + slack) * (np.sqrt(np.log(4 / error) / (2 * p)) + np.sqrt(np.log(4 / error) / (2 * u)))
    best = some[np.argmin((q_u[some] + bound) / q_p[some])]
    return float(min(q_u[best] / q_p[best], 1.0))


def fit(rows: DataFrame, labels: DataFrame) -> tuple[Scale, np.ndarray, float] | None:
    """Scale, weights and class prior; None without positives. rows: text_inputs."""
    training = rows.where(~is_held_out())
    marks = bounded(kept(marks_of(labels).where("quality = 1").where(~is_held_out()), "positives"), POSITIVES)
    found = few_texts(training.join(F.broadcast(marks), "doc_id", "left_semi"), [*COUNTS, "hashed"]).toPandas()  # at most POSITIVES doc_ids, TEXTS rows of each
    if not len(found):
        return None
    found = found.sort_values([*COUNTS, "hashed"])
    xp = features(found[COUNTS].to_numpy(dtype=np.int64))
    tp = np.frombuffer(b"".join(found["hashed"]), dtype=np.int8).reshape(-1, HASHED).astype(np.float32) / 127
    m = _sums(training, lambda x, _: np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)], 1 + 2 * FEATURES)
    n, mean = m[0], m[1 : 1 + FEATURES] / m[0]
    std = np.sqrt(np.maximum(m[1 + FEATURES :] / n - mean**2, 0))
    scale = Scale(mean, np.where(std > 1e-6, std, 1.0))
    p = scale.inputs(xp, tp)
    unlabelled = lambda w: _sums(training, lambda x, t: slope(scale.inputs(x, t), w, -1), 1 + INPUTS) / n
    seen, other = (p[::2], p[1::2]) if len(p) > 1 else (p, p)
    w0 = _descend(PRIOR_STEPS, lambda w: (slope(seen, w, 1) / len(seen) + unlabelled(w))[1:])
    bins = lambda v: np.bincount(np.minimum((BINS * _loss(-(v @ w0))).astype(np.int64), BINS - 1), minlength=BINS).astype(float)
    prior = best_bin(bins(other), _sums(training, lambda x, t: bins(scale.inputs(x, t)), BINS))
    return scale, _descend(STEPS, lambda w: risk(slope(p, w, 1) / len(p), slope(p, w, -1) / len(p), unlabelled(w), prior)[1:]), prior


def score(rows: DataFrame, model: tuple[Scale, np.ndarray, float] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, np.nextafter(0.5, 0))
            if shared.value:
                scale, w, _ = shared.value
                s = _loss(-(scale.inputs(*_rows(b)) @ w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = rows.select("doc_id", *COUNTS, "hashed").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = kept(text_inputs(docs), "inputs")
    return score(rows, fit(rows, labels))
