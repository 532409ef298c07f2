"""Quality rules: statistics of whole texts, and an isolation forest over them.

``rule_stats`` counts words, characters, symbols, repeated lines and repeated word windows of every
text in one narrow pass. The forest splits the box that the labelled rows span at random features and
places; the fewer splits it takes to part a document from the good labelled rows, the more anomalous
it is (score ``2^(-mean path / c(n))``). The threshold is calibrated from labelled rows: of all
thresholds that reject at most ``max_loss`` of the good rows, the one with the best sum of both rates.

Every labelled text takes part: the box is Spark's minimum and maximum over all of them, each tree draws its SAMPLE rows (the
method's own subsample) from all good ones by a hash of tree and row, and the threshold stands on how many of all labelled rows score
above each of GRID places. What reaches the driver is the box, the trees' rows and two histograms, whatever the number of labels.

Defined cases: a null text is an empty one (all counts 0, fails the base rules); a document whose
label is null or missing is only scored; texts of one doc_id are labelled alike, equal rows (by their counts) count once; with no labelled good rows no forest is fitted, scores are 0
and the base rules alone decide; each row is judged by its own text, whatever its doc_id; extra columns of any name change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import by_bucket, documents_of, kept, mixed, released, text_bytes, text_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LABELLED_ROWS, TEXTS = 20_000, 4  # bounds of labelled_counts: labelled doc_ids, and different texts (by their counts) of each
TREES, SAMPLE, DEPTH = 100, 256, 14
GRID = 1 << 16  # places between scores of 0 and 1 at which the threshold may stand
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_lines", "n_word_lines", "n_bars", "n_types"]


def text_counts(raw: bytes) -> list[int]:
    """The COUNTS of one text."""
    words = raw.split()
    n = len(words)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    repeated = 0
    if n >= 4:
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip(SPACES)]
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    points = byte[:0x80].sum() + byte[0xC0:].sum()  # every code point has one byte that is no continuation byte
    return [
        n,
        points - byte[list(SPACES)].sum(),
        byte[list(SYMBOLS)].sum(),
        len(full) - len(set(full)),
        repeated,
        byte[65:91].sum(),  # capitals: A-Z
        byte[65:91].sum() + byte[97:123].sum() + byte[0xC0:].sum(),  # letters: those of ASCII, and what is beyond it
        byte[48:58].sum(),
        len(lines),
        len(full),
        byte[ord("|")],
        len(ids),
    ]


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _counts(b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return documents_of(docs).mapInArrow(released(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios of the COUNTS that do not grow with the text's length, but for the first."""
    c = {k: counts[:, i].astype(float) for i, k in enumerate(COUNTS)}
    words, letters, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_letters", "n_word_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            np.minimum(c["n_symbols"] / words, 4),
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / letters,
            np.minimum(c["n_digits"] / words, 4),
            np.log1p(words / lines),
            np.minimum(c["n_bars"] / words, 2),
            c["n_letters"] / np.maximum(c["word_chars"], 1),
            np.log(words / np.maximum(c["n_types"], 1)) / np.log1p(words),
        ],
        axis=1,
    )


FEATURES = 11


def _usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path of a failed search in a random binary tree of n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Packed:
    """A forest as tasks get it: the nodes of all trees in one row, the first of each tree in ``roots``. A leaf has feature -1; a right child stands after its left one."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    left: np.ndarray
    sample: int
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.left[at] + (x[row, np.maximum(f, 0)] >= self.split[at]), at)
            total += self.path[at]
        return 2 ** (-(total / len(self.roots)) / max(float(_usual_path(self.sample)), 1e-9))


@dataclass
class Forest:
    """Trees as heaps: node i has children 2i+1 and 2i+2; a leaf has feature -1 and its path length."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    sample: int
    threshold: float

    def packed(self) -> Packed:
        roots, feature, split, path, left, size = [], [], [], [], [], 0
        for f, s, p in zip(self.feature, self.split, self.path, strict=True):
            inner = np.flatnonzero(f >= 0)
            used = np.r_[0, np.sort(np.r_[2 * inner + 1, 2 * inner + 2])]
            roots.append(size)
            for all_, one in ((feature, f), (split, s), (path, p)):
                all_.append(one[used])
            left.append(np.where(f[used] >= 0, size + np.searchsorted(used, 2 * used + 1), 0))
            size += len(used)
        return Packed(np.array(roots), *map(np.concatenate, (feature, split, path, left)), self.sample, self.threshold)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.packed().scores(x)


def grown(samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> Forest:
    """A tree for each sample, in the box from low to high."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, split, path = np.full((len(samples), nodes), -1, dtype=np.int16), np.zeros((len(samples), nodes)), np.zeros((len(samples), nodes))
    for t, rows in enumerate(samples):
        stack = [(0, rows, low.copy(), high.copy(), 0)]
        while stack:
            at, inside, lo, hi, depth = stack.pop()
            wide = np.flatnonzero(hi > lo)
            if len(inside) <= 1 or depth == DEPTH or not len(wide):
                path[t, at] = depth + _usual_path(len(inside))
                continue
            f = int(rng.choice(wide))
            s = float(rng.uniform(lo[f], hi[f]))
            feature[t, at], split[t, at] = f, s
            right = inside[:, f] >= s
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[f], right_lo[f] = s, s
            stack += [(2 * at + 1, inside[~right], lo, left_hi, depth + 1), (2 * at + 2, inside[right], right_lo, hi, depth + 1)]
    return Forest(feature, split, path, max(len(x) for x in samples), 1.0)


def places(scores: np.ndarray) -> np.ndarray:
    """The first place of the grid that is not below each score."""
    return np.ceil(scores * GRID).astype(np.int64)


def calibrated(good: np.ndarray, bad: np.ndarray, max_loss: float) -> float:
    """The threshold, from how many good and bad rows have each of the GRID + 1 places."""
    g, b = good.sum() - np.cumsum(good), bad.sum() - np.cumsum(bad)  # above each place
    k = int(np.argmax(g <= max_loss * good.sum()))
    if bad.sum():
        k += int(np.argmax(b[k:] / bad.sum() - g[k:] / good.sum()))
        if g[k] or b[k]:
            k = (k + int(np.flatnonzero((g == g[k]) & (b == b[k]))[-1])) // 2  # amid the places that decide alike
    return k / GRID


def fit_forest(good: np.ndarray, bad: np.ndarray, max_loss: float = 0.01, seed: int = 7) -> Forest | None:
    """Trees over samples of the good rows, in the box of all rows; threshold by both. For rows that are at hand; fitted() does the same in Spark."""
    if not len(good):
        return None
    rng = np.random.default_rng(seed)
    everything = np.concatenate([good, bad]) if len(bad) else good
    samples = [good[rng.choice(len(good), min(SAMPLE, len(good)), replace=False)] for _ in range(TREES)]
    forest = grown(samples, everything.min(axis=0), everything.max(axis=0), rng)
    counted = (np.bincount(places(forest.scores(x)), minlength=GRID + 1) if len(x) else np.zeros(GRID + 1, dtype=np.int64) for x in (good, bad))
    forest.threshold = calibrated(*counted, max_loss)
    return forest


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one row for each doc_id that has a label, the largest of several."""
    return labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("quality"))


def bounded(marks: DataFrame, limit: int) -> DataFrame:
    """The marks: all, or where there are more than ``limit`` those whose doc_id hashes low enough to expect nine tenths of it."""
    n = marks.count()
    return marks if n <= limit else marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * 0.9 * limit / n))


def few_texts(rows: DataFrame, columns: list[str], most: int = TEXTS) -> DataFrame:
    """Of rows (doc_id, columns) each different one once, and of one doc_id at most ``most``, the first by the columns. Repeated rows combine before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*columns))
    return rows.select("doc_id", *columns).distinct().withColumn("place", place).where(F.col("place") <= most).drop("place")


def labelled_counts(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A look at labelled texts from the driver: counts and quality of at most ``limit`` doc_ids and TEXTS texts of each. The forest is not fitted on it, see fitted()."""
    marks = F.broadcast(bounded(kept(marks_of(labels), "marks"), limit))
    rows = rule_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(marks.select("doc_id"), "doc_id", "left_semi"))
    rows = few_texts(rows, COUNTS).join(marks, "doc_id").toPandas().sort_values(["doc_id", *COUNTS])
    return rows[COUNTS].to_numpy(dtype=np.int64), rows["quality"].to_numpy(dtype=np.int64)


_FEATURES = [f"f{i}" for i in range(FEATURES)]


def labelled_features(stats: DataFrame, marks: DataFrame) -> DataFrame:
    """row (a hash of doc_id and counts), good, and the features of every labelled text that the base rules leave to the forest. stats: doc_id and COUNTS; a row that repeats stands once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(np.stack([c.to_numpy() for c in b.columns[2:]], axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *map(pa.array, x.T)], names=["row", "good", *_FEATURES])

    usual = ~((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = stats.where(usual).select("doc_id", *COUNTS).distinct().join(marks.where("quality in (0, 1)"), "doc_id")
    rows = rows.select(F.xxhash64("doc_id", *COUNTS).alias("row"), (F.col("quality") == 1).alias("good"), *COUNTS)
    return rows.mapInArrow(released(run), "row long, good boolean, " + ", ".join(f"{c} double" for c in _FEATURES))


def drawn(rows: DataFrame, n: int, seed: int) -> list[np.ndarray]:
    """For each tree the SAMPLE of the n good rows (all, if fewer) whose hash with the tree's number is least. Tasks give those that may be among them, twice as many as are needed in all."""
    most = np.uint64(min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = mixed(b.column(0).to_numpy().view(np.uint64) ^ np.uint64(seed))
            for t in range(TREES):
                h = mixed(row + mixed(np.array([t + 1], dtype=np.uint64)))
                if len(some := np.flatnonzero(h <= most)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t)), pa.array(h[some].view(np.int64)), *b.select(_FEATURES).take(pa.array(some)).columns], names=["tree", "h", *_FEATURES])

    found = rows.where("good").select("row", *_FEATURES).mapInArrow(released(run), "tree long, h long, " + ", ".join(f"{c} double" for c in _FEATURES)).toArrow()
    tree, h, x = found["tree"].to_numpy(), found["h"].to_numpy().view(np.uint64), np.stack([found[c].to_numpy() for c in _FEATURES], axis=1)
    order = np.lexsort((h, tree))
    cut = np.searchsorted(tree[order], np.arange(TREES + 1))
    return [x[order[i : min(i + SAMPLE, j)]] for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i]


def fitted(stats: DataFrame, marks: DataFrame, max_loss: float = 0.01, seed: int = 7) -> Packed | None:
    """The forest of all labelled rows among stats (doc_id and COUNTS of texts)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places(shared.value.scores(x)))], names=["good", "place"])

    rows = kept(labelled_features(stats, marks), "labelled")
    box = rows.agg(F.count_if("good"), *(f(c) for f in (F.min, F.max) for c in _FEATURES)).first()
    if not box[0]:
        return None
    low, high = np.array(box[1:]).reshape(2, FEATURES)
    forest = grown(drawn(rows, box[0], seed), low, high, np.random.default_rng(seed)).packed()
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    counted = np.zeros((2, GRID + 1), dtype=np.int64)  # bad, good
    for r in rows.select("good", *_FEATURES).mapInArrow(released(score), "good boolean, place long").groupBy("good", "place").count().collect():
        counted[int(r["good"]), r["place"]] = r["count"]
    forest.threshold = calibrated(counted[1], counted[0], max_loss)
    return forest


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeated = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def verdicts(counts: np.ndarray, forest: Forest | Packed | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, base_failed and kept of each row of counts."""
    score = forest.scores(features(counts)) if forest else np.zeros(len(counts))
    failed = base_failed(counts)
    return score, failed, ~failed & (score <= (forest.threshold if forest else 1.0))


def _counts(batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
    return np.array([text_counts(t or b"") for t in text_rows(batch, name)], dtype=np.int64).reshape(-1, len(COUNTS))


def quality_rules(docs: DataFrame, labels: DataFrame, max_loss: float = 0.01) -> DataFrame:
    """doc_id, COUNTS, score, base_failed, kept for each document. Texts are read once: the forest is fitted on their counts, and judges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, verdicts(counts, shared.value))], names=["doc_id", *COUNTS, "score", "base_failed", "kept"])

    stats = kept(rule_stats(docs), "rule-stats")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(stats, kept(marks_of(labels), "marks"), max_loss))
    return stats.mapInArrow(released(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, max_loss: float = 0.01) -> DataFrame:
    """The rows that the rules keep, each judged by its own text as it is read again. Columns as they came: only texts go to Python, and verdicts come back."""
    marks = kept(marks_of(labels), "marks")
    texts = documents_of(docs).where("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(rule_stats(by_bucket(texts, ["doc_id"], marks, ["doc_id"], "left_semi")), marks, max_loss))

    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(verdicts(_counts(pa.RecordBatch.from_arrays([t], names=["text"])), shared.value)[2])

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(judged)(texts)

    return kept(docs.where(good(text_bytes())), "good")  # else texts would go to Python in whatever batches the session has when the caller writes
