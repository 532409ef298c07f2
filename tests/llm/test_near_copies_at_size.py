"""Near copies: what the index and the set join may not do as a table grows."""

import random

import numpy as np

from docspark.llm import simhash
from docspark.llm.common import dealt, kept_by
from tests.llm.test_memory import plan


def test_crowds_are_not_split_again_and_again(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, i, simhash._signed(r.getrandbits(53) << 11), simhash._signed(r.getrandbits(64))) for i in range(9000)]  # all alike in the first block
    under, made = simhash._under, []
    monkeypatch.setattr(simhash, "_under", lambda *a: made.append(under(*a)) or made[-1])
    classes = {x["node"]: x["class"] for x in simhash._classes(spark.createDataFrame(rows, "node long, row long, fp long, other long"), 5).collect()}
    assert [x.count() for x in made] == [6 * len(rows)] * 2  # once for each fingerprint of a text
    assert len(classes) == len(rows) and len(set(classes.values())) == 1


def test_crowds_hold_all_links(spark):
    r = random.Random(1)
    center, fps = r.getrandbits(64), set()
    while len(fps) < 400:
        x = center if r.random() < 0.6 else r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(sorted(fps))], "fp long, node long")
    of = lambda edges: {x["node"]: x["component"] for x in simhash.components(edges).collect()}
    exact = of(simhash.links(nodes))
    assert of(simhash.crowd_links(nodes, 3)) == exact
    for limit in (40, 3):
        crowds = of(simhash.crowd_links(nodes, 3, limit))
        assert all(crowds.get(i, i) == crowds.get(c, c) for i, c in exact.items())


def test_sketches_leave_out_no_shared_shingle():
    r = np.random.default_rng(4)
    for _ in range(300):
        pool = np.unique(r.integers(0, 1 << 32, r.integers(2, 3000), dtype=np.uint32) << np.uint32(r.choice([0, 0, 0, 12])))  # shifted: all in one bucket
        a, b = (np.unique(r.choice(pool, r.integers(1, len(pool) + 1))) for _ in range(2))
        assert len(np.intersect1d(a, b)) <= simhash.most_shared(simhash.sketch(a), simhash.sketch(b))
    a, b = (np.unique(r.integers(0, 1 << 32, 1000, dtype=np.uint32)) for _ in range(2))
    assert simhash.most_shared(simhash.sketch(a), simhash.sketch(b)) < 700


def test_sets_are_not_shuffled_for_pairs(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        given = spark.createDataFrame([(i, bytearray(simhash.shingles_of(f"some words that stand in text {i % 5}".encode()))) for i in range(20)], "node long, shingles binary")
        sets = kept_by(dealt(given, "node"), "tested-sets", "node")
        pairs = spark.createDataFrame([(i, i - 5) for i in range(5, 20)] + [(2, 1)], "a long, b long")
        out = simhash._alike(pairs, sets, simhash._sketches(sets), 0.8)
        assert plan(out).count("Exchange") == 2  # pairs by a, pairs with the set of a by b
        assert sorted(map(tuple, out.collect())) == [(i, i - 5) for i in range(5, 20)]
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("docspark_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
