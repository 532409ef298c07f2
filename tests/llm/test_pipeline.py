"""The pipeline, stage by stage, against plain versions of what each stage must decide."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from docspark.llm import decontaminate, packing, queries, rules
from docspark.llm.common import kept, table
from tests.llm.test_operators import CLASH, SCHEMA, awkward_texts, plain_copies, plain_counts, plain_spans

STAGE = dict(corpus_pipeline.STAGES)


def plain_passes(text):
    words, _, _, _, repeated = plain_counts(text)
    return words >= 50 and 100 * repeated <= 50 * words


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts.items()}


@pytest.fixture(scope="module")
def tables(spark, sf):
    """What each stage is given, and the rows of the last."""
    out = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(kept(stage(spark, out[-1], sf), "tested-" + name.replace(" ", "-")))
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_rules_drop_what_they_reject_and_nothing_else(tables, spark, sf):
    before, after = texts_of(tables[0]), texts_of(tables[1])
    verdict = {r["doc_id"]: r["kept"] for r in rules.quality_rules(tables[0], table(spark, sf, "labels")).collect()}
    assert tables[1].columns == tables[0].columns
    assert after == {d: t for d, t in before.items() if verdict[d]}
    assert all(plain_passes(t) for t in after.values())
    good = {r["doc_id"] for r in table(spark, sf, "labels").where("quality = 1").collect()}
    assert np.mean([d in after for d in good if plain_passes(before[d])]) >= 0.98


def test_one_of_each_class_of_near_copies_stays(tables):
    before, after = texts_of(tables[1]), texts_of(tables[2])
    ids = sorted(before)
    first = plain_copies([before[d] for d in ids])
    assert after == {ids[k]: before[ids[k]] for k in set(first)} and tables[2].columns == tables[0].columns


def test_leaks_are_those_of_a_whole_alignment(tables, spark, sf):
    before, after = texts_of(tables[2]), texts_of(tables[3])
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"\w+", (t or "").lower())], dtype=np.int64)
    items = [x for x in (coded(r["text"]) for r in table(spark, sf, "benchmark").collect()) if len(x) >= 3]
    docs = {d: coded(t) for d, t in before.items()}
    share = {d: max(decontaminate.smith_waterman(items, [w] * len(items))[0] / [2 * len(x) for x in items]) for d, w in docs.items()}
    assert set(after) <= set(before) and tables[3].columns == tables[0].columns
    assert {d for d in before if share[d] >= 0.7} <= set(before) - set(after) <= {d for d in before if share[d] >= decontaminate.MIN_SCORE}
    assert all(after[d] == before[d] for d in after)


def test_private_data_is_gone_and_the_rest_is_as_it_was(tables):
    before, after = texts_of(tables[3]), texts_of(tables[4])
    assert set(before) == set(after) and tables[4].columns == tables[0].columns
    assert not [d for d, t in after.items() if plain_spans(t)]
    assert all(after[d] == before[d] for d in before if not plain_spans(before[d]))
    for d, t in before.items():
        marks = Counter(k for _, _, _, k in plain_spans(t))
        if sum(marks.values()) == 1:  # one span, which overlaps no other
            kind = next(iter(marks))
            assert f"[{kind.upper()}]" in after[d]
    assert {r["doc_id"]: r["n_chars"] for r in tables[4].collect()} == {d: len(t) for d, t in after.items()}


def test_packed_pieces_are_the_texts(tables):
    ids = plain_ids(texts_of(tables[4]))
    want = {(d, k): (at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], dtype="<u4").tobytes())) for d, x in ids.items() for k, at in enumerate(range(0, len(x), 2048))}
    rows = tables[5].collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(b)[0][0] == 0 and sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) <= packing.lower_bound(np.array([n for b in bins.values() for _, n in b])) + 1


def test_run_gives_the_rows_of_its_stages(tables, spark, sf):
    row = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(row, corpus_pipeline.run(spark, sf).collect())) == Counter(map(row, tables[5].collect()))


@pytest.mark.parametrize("name", STAGE)
def test_stages_take_awkward_and_empty_tables(name, spark, sf):
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t or ""), "clash", 1, 2, *CLASH) for i, t in enumerate(awkward_texts())]
    rows += [rows[6], rows[6], (None, "no id at all, " * 9, None, None, None, None, None, None, *CLASH), (None, rows[6][1], "en", "s", 1, "", 0, 0, *CLASH), (*[None] * 8, *CLASH)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out, none = STAGE[name](spark, docs, sf), STAGE[name](spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == out.columns
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in CLASH)  # columns that are named like the operators' own
        ids = Counter(r["doc_id"] for r in out.collect())
        assert ids and all(ids[d] <= n for d, n in Counter(r[0] for r in rows).items()) and not set(ids) - {r[0] for r in rows}
    else:
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
