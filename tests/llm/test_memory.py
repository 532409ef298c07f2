"""What Python workers hold of an executor's memory."""

from pathlib import Path

import numpy as np

from docspark.llm import decontaminate, rules
from docspark.llm.common import released, table


def resident_mb():
    return int(next(x for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmRSS")).split()[1]) / 1024


def test_a_task_gives_back_what_it_has_freed():
    last = []

    def run(batches):
        blocks = [np.ones(8000) for _ in range(4000)]  # 256 MB; the last one stays, so that the heap does not shrink by itself
        last.append(blocks[-1])
        yield from batches

    before = resident_mb()
    assert list(released(run)(iter([1, 2]))) == [1, 2]
    assert resident_mb() - before < 64


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_has_two_python_workers(spark, sf):
    docs, benchmark = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    assert plan(decontaminate._leaks(docs, benchmark, decontaminate.MIN_SCORE)).count("MapInArrow") == 1


def test_kept_rows_reach_the_caller_without_python(spark, sf):
    docs = table(spark, sf, "documents")
    out = rules.keep_good(docs, table(spark, sf, "labels"))
    assert "Python" not in plan(out) and 0 < out.count() < docs.count()
