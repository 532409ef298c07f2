"""Periodic runs, hard negatives and exact duplicates against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import exactdup, negatives, queries, runs
from tests.llm.test_operators import CLASH, SCHEMA, awkward_texts, pairs
from tests.oracle import differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    clash = tuple(f"own {c}" for c in CLASH)
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t or ""), "clash", 1, 2, *clash) for i, t in enumerate(awkward_texts())]
    rows += [rows[6], rows[6], (None, "no id at all, " * 9, None, None, None, None, None, None, *clash), (None, rows[6][1], "en", "s", 1, "", 0, 0, *clash), (3, "o n\te", "en", "s", 1, "", 0, 0, *clash)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11


def plain_runs(w, shortest=6, times=4):
    """By every period and place; a stretch that a shorter period has is not told again."""
    out, seen = [], set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def words_with_runs(r):
    n, k = r.choice([0, 1, 5, 6, 7, 20, 60, 150]), r.choice([1, 2, 3, 5, 40])
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if n:
            a, p = r.randrange(n), r.randint(1, 12)
            e = r.randint(a, n)
            w[a:e] = [w[a + (i - a) % p] if a + (i - a) % p < n else w[i] for i in range(a, e)]
    return w


def test_runs_are_those_of_all_periods(monkeypatch):
    r = random.Random(1)
    for words in (1 << 16, 40):
        monkeypatch.setattr(runs, "WORDS", words)
        for _ in range(400):
            texts = [words_with_runs(r) for _ in range(r.randint(1, 7))]
            for shortest, times in ((6, 4),) if words == 40 else ((6, 4), (2, 2), (9, 3)):
                got = [found for some in runs._together(iter([" ".join(t).encode() or None for t in texts])) for _, found in runs._found(some, shortest, times)]
                assert got == [plain_runs(t, shortest, times) for t in texts], texts


def test_suffixes_are_sorted_with_their_common_prefixes():
    r = random.Random(2)
    for _ in range(200):
        texts = [[r.randrange(3) for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 4))]
        symbols = np.array([1000 * k + x for k, t in enumerate(texts) for x in t])
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        sa, isa, lcp = runs.suffixes(symbols, ends)
        suffix = [tuple(symbols[i : ends[i]]) for i in range(len(symbols))]
        assert sa.tolist() == sorted(range(len(symbols)), key=suffix.__getitem__) and (isa[sa] == np.arange(len(sa))).all()
        for k in range(1, len(sa)):
            a, b = suffix[sa[k - 1]], suffix[sa[k]]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_long_periodic_texts_take_no_square_of_their_length():
    for words in ([b"a"] * 300_000, [b"x%d" % (i % 7) for i in range(200_000)]):
        ((_, found),) = runs._found([words], 6, 4)
        assert found == [(0, len(words), len(set(words)))]


def test_periodic_runs_of_awkward_rows(docs, nothing):
    got = Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in runs.periodic_runs(docs).collect())
    want = Counter()
    for d, t in pairs(docs):
        w = WORD.findall(t or "")
        found = plain_runs(w)
        want[(d, len(w), tuple(found), plain_collapsed(w, found))] += 1
    assert got == want and sum(1 for x in want if x[2]) >= 3
    assert runs.digest(runs.periodic_runs(nothing)).count() == 0


def test_the_query_of_runs_equals_a_plain_one(spark, sf):
    got = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, sf).collect()}
    rows = pairs(spark.read.parquet(f"{sf}/documents.parquet"))
    assert len(got) == len(rows)
    for d, t in rows:
        w = WORD.findall(t or "")
        if len(w) > 3000:
            continue  # the plain version takes too long; these are covered above
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = {"doc_id": d, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2]}
        want |= {"runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(plain_collapsed(w, found).encode()).hexdigest()}
        assert got[d] == want


# --- 12


def plain_negatives(rows, every=100):
    """rows: vec_id, label, vector. By all inner products, as Python integers."""
    fine = [(i, v, lab, [math.floor(256 * x) for x in vec]) for i, (v, lab, vec) in enumerate(rows) if lab is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    last = lambda v: (v is None, v or 0)
    out = []
    for i, v, lab, q in fine:
        if v is None or v % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r, strict=False)), last(w), j, w, other) for j, w, other, r in fine if j != i]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == lab][:5]:
            inside = [s for s in scored if s[4] != lab and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]]
            out += [(v, p[3], k + 1, s[3], -p[0], -s[0]) for k, s in enumerate(inside[:10])]
    return Counter(out)


def vectors(seed, n, width=6, size=1.0):
    r = random.Random(seed)
    centers = [[r.gauss(0, size) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        lab = r.randrange(5)
        v = [c + r.gauss(0, size / 2) for c in centers[lab]]
        rows.append((i, lab, v))
    return rows


@pytest.mark.parametrize(("tile", "block"), [(4096, 2048), (70, 2)])
def test_hard_negatives_are_those_of_all_products(spark, tile, block):
    rows = vectors(1, 500)
    rows += [(i, 1, rows[3][2]) for i in range(500, 700)]  # a third of all rows are one vector
    rows += [(i, 2, rows[3][2]) for i in range(700, 800)]
    rows += [(800, None, rows[1][2]), (801, 1, None), (802, 1, [1.0, None]), (803, 1, [math.nan] * 6), (804, 1, [math.inf] * 6), (None, 1, rows[5][2]), (None, 3, rows[6][2]), (900, 1, []), (1000, 2, [0.5, -0.5]), (1100, 3, [0.0] * 6), (200, 2, rows[8][2]), (200, 2, rows[8][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, q string, row int").repartition(5)
    rows = [(v, lab, None if vec is None else [None if x is None else float(np.float32(x)) for x in vec]) for v, lab, vec in rows]
    got = Counter(tuple(r) for r in negatives.hard_negatives(df, tile=tile, block=block).collect())
    assert len(got) > 200 and got == plain_negatives(rows)


def test_vectors_too_large_for_floats_are_exact(spark):
    rows = vectors(2, 120, 3, 1e6)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = plain_negatives(rows)
    assert max(k[4] for k in want) > 1 << 53
    assert Counter(tuple(r) for r in negatives.hard_negatives(df).collect()) == want
    huge = spark.createDataFrame(vectors(2, 120, 3, 1e9), "vec_id long, label int, embedding array<double>")
    assert all(abs(x) < 1 << 63 for r in negatives.hard_negatives(huge).collect() for x in r[4:])


def test_no_vectors_give_no_negatives(spark):
    for rows in ([], [(0, None, [1.0])], [(0, 1, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        assert negatives.hard_negatives(df).collect() == []


def test_boxes_hold_their_rows_and_bound_their_products():
    r = np.random.default_rng(3)
    q = r.integers(-300, 300, (1000, 5))
    order = negatives.str_order(q, [2, 0, 4], 64)
    assert sorted(order.tolist()) == list(range(1000))
    ids = np.arange(1000)
    t = negatives.Tile.of(*(np.ascontiguousarray(x[order]).tobytes() for x in (ids, ids, ids, q)), 5, float)
    a = r.integers(-300, 300, 5).astype(float)
    up = np.maximum(a, 0) @ t.high.T + np.minimum(a, 0) @ t.low.T
    low = np.maximum(a, 0) @ t.low.T + np.minimum(a, 0) @ t.high.T
    leaf = 1 + t.inner
    for k in range(t.leaves):
        s = t.q[k * negatives.LEAF : (k + 1) * negatives.LEAF] @ a
        assert low[leaf + k] <= s.min() and s.max() <= up[leaf + k]
        above = 1 + k // negatives.FAN
        assert low[0] <= low[above] <= low[leaf + k] and up[leaf + k] <= up[above] <= up[0] and (leaf + k) in t.below(above)
    # leaves in the order of their packing are small: their boxes are far below the whole one
    volume = lambda i: np.log(t.high[i] - t.low[i] + 1).sum()
    assert np.mean([volume(leaf + k) for k in range(t.leaves)]) < volume(0) - 1


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_dedup"])
def test_queries_equal_their_sql(name, spark, sf):
    assert differences(spark, sf, queries.QUERIES[name], queries.ORACLE[name]) == ""


# --- 13


def plain_exact(rows):
    """doc_id, keep_id, group_size and text_sha256 of each row, and of each group how many rows stay."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out, stay = Counter(), Counter()
    for norm, members in groups.items():
        keep, sha = min(members)[3], hashlib.sha256(norm.encode()).hexdigest()
        for m in members:
            out[(m[3], keep, len(members), sha)] += 1
        stay[(keep, len(members), sha)] += 1
    return out, stay


def assert_exact(got, rows):
    want, stay = plain_exact(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter((r["doc_id"], r["group_size"], r["text_sha256"]) for r in got if r["kept"]) == stay


def test_exact_duplicates_of_awkward_rows(spark, docs, nothing):
    out = exactdup.exact_duplicates(docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert_exact(out.collect(), pairs(docs))
    assert exactdup.exact_duplicates(nothing).collect() == []


def test_groups_that_reach_over_many_partitions(spark):
    r = random.Random(7)
    head = "the same long beginning " * 20
    rows = [(r.choice([None, *range(900)]), head + r.choice("abc") + " " * r.randint(0, 3)) for _ in range(2500)] + [(i, head + str(i)) for i in range(500)] + [(i, None) for i in range(300)] + [(7, "equal rows")] * 400
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = exactdup.grouped(exactdup.normalised(df))
        assert found.where("group_size < 0").select("group_id").distinct().count() > 40  # the large groups lie at edges
        assert_exact(exactdup.exact_duplicates(df).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was[1])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_neighbours_of_one_hash_are_compared_in_full():
    r = random.Random(9)
    for _ in range(300):
        rows = sorted((r.randrange(3), r.choice([b"x", b"y", b"zz"]), -r.randrange(3), i) for i in range(r.randint(1, 30)))
        reader = exactdup._Neighbours(0)
        names = ["doc_id", "row", "less", "norm", "prefix", "hash"]
        at, told = 0, []
        while at < len(rows):
            some = rows[at : at + r.randint(1, 5)]
            at += len(some)
            reader.read(pa.RecordBatch.from_arrays([pa.array([x[3] for x in some]), pa.array([x[3] for x in some]), pa.array([x[2] for x in some]), pa.array([x[1] for x in some], pa.binary()), pa.array([b"p"] * len(some), pa.binary()), pa.array([x[0] for x in some])], names=names))
            told += [y for b in reader.taken() for y in b.to_pylist()]
        reader.tell(True)
        told += [y for b in reader.taken() for y in b.to_pylist()]
        key = {x[3]: x[:2] for x in rows}
        groups = defaultdict(list)
        for y in told:
            groups[y["group_id"]].append(y)
        assert len(told) == len(rows) and sorted(len(g) for g in groups.values()) == sorted(Counter(key.values()).values())
        edges = {rows[0][0], rows[-1][0]}
        for g in groups.values():
            (k,) = {key[y["doc_id"]] for y in g}
            members = [x for x in rows if x[:2] == k]
            assert {y["keep_id"] for y in g} == {members[0][3]} and {y["group_size"] for y in g} == {-1 if k[0] in edges else len(members)}
            assert [y["edge"] for y in g if y["edge"] is not None] == ([k[1]] if k[0] in edges else [])
