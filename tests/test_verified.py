"""Diagnosis, verified writes, bundles, reports of steps, pagination and streams with timers, against plain versions and on purpose broken input."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.operators import diagnosis, layout, scans, web, workflows
from docspark.plans import recipes
from docspark.plans.views import view
from docspark.sources import files as sources
from docspark.streaming import queues


# --- diagnosis


def plain_errors(tokens):
    """Of (tag, closes) tokens without optional or void elements: how many are unclosed, stray and crossed. Each start is marked, and each end looks at all marks."""
    mark, stray, crossed = {}, 0, 0
    for j, (tag, closes) in enumerate(tokens):
        if not closes:
            mark[j] = "open"
            continue
        mine = [i for i in mark if tokens[i][0] == tag]
        if any(mark[i] == "open" for i in mine):
            last = max(i for i in mine if mark[i] == "open")
            for i in mark:
                mark[i] = "cut" if i > last and mark[i] == "open" else mark[i]
            mark[last] = "closed"
        elif any(mark[i] == "cut" for i in mine):
            mark[max(i for i in mine if mark[i] == "cut")] = "crossed"
            crossed += 1
        else:
            stray += 1
    return sum(m in ("open", "cut") for m in mark.values()), stray, crossed


def test_tolerant_parse_of_broken_pages_equals_a_plain_one():
    r = random.Random(4)
    for _ in range(3000):
        tokens = [(r.choice("bius"), r.random() < 0.5) for _ in range(r.randint(0, 9))]
        t = diagnosis.tolerant("".join(f"</{x}>" if c else f"<{x}>" for x, c in tokens))
        kinds = [e[1] for e in t.errors]
        unclosed, stray, crossed = plain_errors(tokens)
        assert (kinds.count("unclosed"), kinds.count("stray"), kinds.count("crossed")) == (unclosed, stray, crossed), tokens
        assert t.elements == sum(not c for _, c in tokens)


def test_reports_of_pages(spark):
    long = "<html lang='en'><head><title>t</title></head><body>" + "<p>x</p>" * 1200 + "<img src='a'></body></html>"
    pages = ["<a><b/></a>", "<p>one<p>two<div>x</div><img alt='' src=a><img alt=t src=b width=0>", "</div><b><i>x</b></i><script type='application/ld+json'>{</script>&#xD800;", None, "", "no tags", long, "<ul><li>1<li>2</ul><input name=signature>"]
    rows = {r["page_id"]: r for r in diagnosis.html_diagnose(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), deep=True).collect()}
    pick = lambda i, *names: tuple(rows[i][n] for n in names)
    assert pick(0, "strict", "tolerant", "consistent", "errors", "error") == (True, True, True, 0, None)
    assert pick(1, "strict", "figures", "missing", "boxes", "errors", "parts") == (False, 2, 1, 1, 0, 5)
    assert [(e["part"], e["kind"], e["what"]) for e in rows[2]["locations"]] == [(0, "stray", "div"), (1, "crossed", "i"), (2, "data", "json-ld"), (2, "text", "reference")]
    assert rows[2]["warnings"] == ["tolerant parse only", "counts differ", "parts not inspected"]
    assert pick(3, "strict", "tolerant", "tolerant_count") == pick(4, "strict", "tolerant", "tolerant_count") == pick(5, "strict", "tolerant", "tolerant_count") == (False, False, 0)
    assert pick(6, "truncated", "figures", "tolerant_count") == (True, 0, 1205) and "graph truncated" in rows[6]["warnings"]
    assert pick(7, "errors", "signatures") == (0, 1)
    one = diagnosis.part_errors(spark.createDataFrame([(1, pages[2])], "page_id long, html string"))
    assert one.count() == 4 and one.columns == ["page_id", "part", "kind", "what", "line"]


def test_canonical_pages_are_strict_and_keep_their_elements(spark, sf, tmp_path):
    pages = view(spark, sf, "pages").withColumns({"password": F.lit("x"), "locked": F.lit(True)})
    report = recipes.normalize_pages(pages, f"{tmp_path}/pages")
    assert report.count() == pages.count() and report.where("not accepted").count() == 0 and report.where("was_strict").count() < report.count()
    written = queues.current(spark, f"{tmp_path}/pages", view(spark, sf, "pages").schema)
    assert written.columns == ["page_id", "url", "html"] and diagnosis.html_diagnose(written).where("not consistent").count() == 0
    broken = spark.createDataFrame([(1, "u", "<p>two<p>roots"), (2, "u", "<html><b><i>x</b></i></html>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["accepted"] for r in recipes.normalize_pages(broken, f"{tmp_path}/broken").collect()}
    left = {r["page_id"]: r["html"] for r in queues.current(spark, f"{tmp_path}/broken", broken.schema).collect()}
    assert got == {1: False, 2: True} and left == {1: "<p>two<p>roots", 2: "<html><b><i>x</i></b></html>"}


def test_metadata_is_rewritten_whole_or_not_at_all(spark):
    html = "<head><title>Old</title><meta content='x' name=\"other\"><meta name=\"description\" content=\"d\"><script type='application/ld+json'>{\"@graph\":[{\"@type\":\"SoftwareApplication\",\"rank\":1.50,\"name\":\"n\"},{\"@type\":\"BreadcrumbList\",\"itemListElement\":[{},{\"k\":[null]}]}]}</script></head>"
    names = "page_id long, title string, description string, json_name string, json_description string, crumb_name string, home_name string, url string, home_url string"
    full = ["T", "D", "JN", "JD", "CN", "HN", "u", "h"]
    values = [(0, *full)] + [(i + 1, *[None if k == i else " " if (k, i) == (2, 2) else v for k, v in enumerate(full)]) for i in range(6)]
    pages = spark.createDataFrame([(i, html, "own") for i in range(8)], "page_id long, html string, title string")
    rows = {r["page_id"]: r for r in web.rewrite_meta(pages, spark.createDataFrame(values, names)).collect()}
    assert [rows[i]["changed"] for i in range(8)] == [True] + [False] * 7 and all(rows[i]["html"] == html for i in range(1, 8)) and rows[0]["title"] == "own"
    new = rows[0]["html"]
    assert "<title>T</title>" in new and 'content="D"' in new and "content='x'" in new
    assert '"rank":1.5' in new and '"k":[null]' in new and '"name":"CN"' in new and '"item":"h"' in new


# --- verified writes


def test_a_tampered_output_is_refused_and_the_old_one_stays(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", 1), (1, "b", "en", 2), (2, None, "de", None), (None, "c", None, 3)], "doc_id long, text string, lang string, n long")
    path = f"{tmp_path}/clean"
    ok = recipes.clean_and_verify(docs, ["lang"], path)
    assert [r["ok"] for r in ok.collect()] == [True] * 3
    was = sorted(map(str, queues.current(spark, path, docs.schema).collect()))
    for tamper in (
        lambda df: df.where("text <> 'a' or text is null"),
        lambda df: df.unionByName(df.where("doc_id = 2")),
        lambda df: df.withColumn("text", F.upper("text")),
        lambda df: df.withColumn("n", F.when(F.col("doc_id") == 2, 0).otherwise(F.col("n")).cast("long")),
        lambda df: df.withColumn("lang", F.when(F.col("doc_id").isNull(), "fr")),
        lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(9))),
    ):
        with pytest.raises(recipes.VerificationError):
            recipes.clean_and_verify(docs.limit(9), ["lang"], path, write=lambda df, to, t=tamper: t(df).write.parquet(to))
        assert sorted(map(str, queues.current(spark, path, docs.schema).collect())) == was
    pages = spark.createDataFrame([(1, 1, "x", "l"), (1, 2, "y", "l"), (1, None, "lost", "l")], "doc_id long, page_no long, text string, links string")
    assert recipes.rebuild(pages, ["text"], f"{tmp_path}/rebuilt").first()["ok"]
    with pytest.raises(recipes.VerificationError):
        recipes.rebuild(pages, ["text"], f"{tmp_path}/rebuilt", write=lambda df, to: df.withColumn("text", F.when(F.col("page_no") < 2, F.col("text"))).write.parquet(to))
    assert queues.current(spark, f"{tmp_path}/rebuilt", "doc_id long, page_no long, text string").count() == 2


def test_a_failing_and_a_racing_bundle_change_nothing(spark, tmp_path):
    path, w, f = f"{tmp_path}/bundle", "workflow_id long, name string", "workflow_id long, file_id long"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    read = lambda: [v if isinstance(v, int) else {k: sorted(map(tuple, d.collect())) for k, d in v.items()} for v in queues.read_bundle(spark, path, {"files": f, "workflows": w})]
    assert read() == [0, {"files": [], "workflows": []}]
    assert workflows.replace_bundle(spark, path, frame([(1, "a"), (2, "b")], w), frame([(1, 10), (1, 11), (2, 20), (3, 30)], f)) == 1
    assert workflows.replace_bundle(spark, path, frame([(1, "c")], w), frame([(1, 12), (1, 10)], f)) == 2
    now = [2, {"files": [(1, 10), (1, 12), (2, 20)], "workflows": [(1, "c"), (2, "b")]}]
    assert read() == now
    with pytest.raises(Exception, match="no such luck"):
        workflows.replace_bundle(spark, path, frame([(2, "d")], w).withColumn("name", F.expr("cast(raise_error('no such luck') as string)")), frame([(2, 21)], f))
    assert read() == now
    version, seen = queues.read_bundle(spark, path, {"files": f, "workflows": w})
    workflows.replace_bundle(spark, path, frame([(2, "e")], w), frame([(2, 22)], f))  # someone else, in between
    with pytest.raises(queues.Conflict):
        queues.commit_bundle(spark, path, version, {k: d for k, d in seen.items()})
    assert read() == [3, {"files": [(1, 10), (1, 12), (2, 22)], "workflows": [(1, "c"), (2, "e")]}]


def test_steps_report_from_the_job_that_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    pages = spark.range(40).select((F.col("id") % 4).alias("doc_id"), counted("id").alias("page_no"))
    out, reports = recipes.run_reported(pages, ["organize-pages-v1", "page-numbers-v1"], str(tmp_path), "a/b c.pdf", {"page-numbers-v1": {"start": 5}})
    assert seen.value == 40  # every row was made once
    assert [tuple(r) for r in reports.orderBy("step_no", "measure").collect()] == [(0, "organize-pages-v1", "rows", 40.0), (1, "page-numbers-v1", "last_number", 14.0), (1, "page-numbers-v1", "rows", 40.0)]
    assert out.count() == 40 and (tmp_path / "b-c-organize-pages+page-numbers").exists()
    assert len(recipes.output_name("x" * 300, ["page-numbers-v1"])) == 160
    with pytest.raises(ValueError, match="needs doc_id"):
        recipes.run_recipe(spark.range(3), ["page-numbers-v1"])
    with pytest.raises(ValueError, match="no version"):
        recipes.register_step(recipes.Step("x", lambda d: d))


# --- layout and sheets


def plain_pages(lines, height):
    page, at, out = 1, 0.0, []
    for kind, wrapped, _ in lines:
        tall, free = layout.HEIGHTS.get(kind, layout.HEIGHTS["text"])
        free = free if wrapped == 0 else 0.0
        if at and at + free + tall > height:
            page, at = page + 1, 0.0
        at += free if at else 0.0
        out.append((page, at))
        at += tall
    return out


def test_pagination_equals_a_plain_paginator_over_batches(spark):
    r = random.Random(6)
    docs = {d: [(r.choice([*layout.HEIGHTS, "other"]), w, b) for b in range(r.choice([0, 3, 60, 900])) for w in range(r.randint(1, 4))] for d in range(9)}
    rows = [(d, b, w, k, f"{d}.{b}.{w}") for d, lines in docs.items() for k, w, b in lines]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, block_no long, wrapped_no long, kind string, text string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for height in (20.0, 120.0, 660.0):
            got = {}
            for x in layout.paginate(df, height).collect():
                got.setdefault(x["doc_id"], []).append((x["block_no"], x["wrapped_no"], x["page_no"], x["y"]))
            assert {d: [g[2:] for g in sorted(v)] for d, v in got.items()} == {d: plain_pages(lines, height) for d, lines in docs.items() if lines}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_ragged_sheets_are_as_wide_as_their_widest_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x, ""y"", z"\n\n1,2,3,,\nlast\n')
    assert sources.sheet_width(spark, str(tmp_path)) == 5
    rows = sorted(tuple(r) for r in sources.read_sheet_rows(spark, str(tmp_path)).collect())
    assert rows == sorted([("1", 'x, "y", z', "", "", ""), ("1", "2", "3", "", ""), ("last", "", "", "", "")])


# --- streams


def hours(h):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)


def run_files(spark, tmp_path, schema, batches, transform, mode="append"):
    """The stream over one file a micro-batch: what each gave, and the progress."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = []
    q = transform(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: got.append([tuple(r) for r in df.collect()])).start()
    q.awaitTermination()
    return got, q.recentProgress


def test_a_record_that_is_never_read_leaves_the_state(spark, tmp_path):
    schema = "key long, ts timestamp, seq long, op string, value string"
    batches = [[(1, hours(0), 0, "write", "a"), (2, hours(0), 1, "write", "b"), (1, hours(1), 2, "read", None)], [(3, hours(25), 3, "write", "c")], [(3, hours(26), 4, "read", None)], [(4, hours(60), 5, "read", None)], [(4, hours(61), 6, "read", None)]]
    got, progress = run_files(spark, tmp_path, schema, batches, queues.expire_stream)
    assert [r for b in got for r in b] == [(1, hours(1), "a"), (3, hours(26), "c"), (4, hours(60), None), (4, hours(61), None)]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(rows) > 0 and rows[-1] == 0  # keys 1 and 2 were not read again


def test_findings_are_counted_on_a_stream(spark, sf, tmp_path):
    docs = view(spark, sf, "documents")
    batches = [[tuple(r) for r in docs.where(f"doc_id % 3 = {k}").collect()] for k in range(3)]
    for i, rows in enumerate(batches):  # a document's text comes in two batches
        spark.createDataFrame(rows + batches[0][:5], docs.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = queues.run_updates(scans.category_counts(scans.scan_sensitive(stream)), spark, str(tmp_path), "doc_id", "category")
    whole = spark.read.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    want = scans.category_counts(scans.scan_sensitive(whole))
    assert want.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_debounce_on_a_stream_equals_its_batch_twin(spark, tmp_path):
    r = random.Random(5)
    at, rows = 0.0, []
    for i in range(300):
        at += r.choice([0.0, 0.1, 0.5, 1.0, 1.01, 3.0])
        rows.append((i, r.randrange(4), hours(at)))
    batches = [rows[:40], rows[40:41], rows[41:200], rows[200:], [(999, 99, hours(at + 500))], [(1000, 99, hours(at + 1000))]]
    got, _ = run_files(spark, tmp_path, "event_id long, user_id long, ts timestamp", batches, lambda s: queues.debounce_stream(s, "1 HOUR", "user_id"))
    want = queues.debounce(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), "1 HOUR", "user_id")
    assert sorted(x[0] for b in got for x in b if x[0] < 900) == sorted(x["event_id"] for x in want.collect())


def test_stored_parameters_fall_back_to_defaults(spark):
    rows = [(1, "page-numbers-v1", {"start": "7", "password": "x"}), (2, "page-numbers-v1", {"start": "no"}), (3, "organize-pages-v1", {"order": "keep", "more": "1"}), (4, "organize-pages-v1", None), (5, "none-v1", {"a": "b"})]
    got = {r["id"]: r["params"] for r in queues.restore_parameters(spark.createDataFrame(rows, "id long, step string, params map<string,string>")).collect()}
    assert got == {1: {"start": "7"}, 2: {"start": "1"}, 3: {"order": "keep"}, 4: {"order": "reverse"}, 5: {}}


def test_offsets_of_many_matches_are_right(spark):
    text = " ".join(f"a{i}@b.org" for i in range(20_000))
    rows = scans.scan_sensitive(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("category = 'email'").collect()
    assert len(rows) == 20_000 and all(text[r["offset"] :].startswith(r["match"]) for r in rows[::997]) and re.fullmatch(r"a\d+@b\.org", rows[-1]["match"])
