"""Known answers, failure cases and the stateful stream."""

import datetime
import pathlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from docspark.operators import columns as C, diagnosis
from docspark.operators import layout, scans, web, workflows
from docspark.plans import recipes
from docspark.plans.shared import new_folder
from docspark.plans.views import view
from docspark.sources import files
from docspark.streaming import queues


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (999, "999 B"), (1000, "1.0 KB"), (1050, "1.1 KB"), (2_500_000, "2.5 MB")])
def test_bytes(spark, n, want):
    assert one(spark, C.format_bytes(F.lit(n))) == want


def test_crop_golden(spark):
    c = one(spark, C.crop_box(F.lit(612.0), F.lit(792.0), F.lit(0), 100, 0, 0, 50))
    assert (c["w"], c["h"]) == (562, 692)


def test_twelve_mails_capped_at_three(spark):
    d = spark.createDataFrame([(1, " ".join(f"p{i}@example.test" for i in range(12))), (2, None)], "doc_id long, text string")
    rows = scans.cap_findings(scans.scan_sensitive(d), 3).collect()
    assert len(rows) == 3 and all(r["truncated"] for r in rows) and [r["offset"] for r in rows] == [0, 16, 32]


def test_names(spark):
    d = spark.createDataFrame([(1, 1, "a.pdf"), (1, 2, "A.pdf"), (1, 3, "a-2.pdf"), (1, 4, "a.pdf"), (2, 1, "same.pdf"), (2, 2, "same.pdf"), (2, 3, "bad.pdf")], "workflow_id int, seq int, name string")
    got = {(r["workflow_id"], r["seq"]): r["unique_name"] for r in workflows.allocate_names(d).collect()}
    assert got == {(1, 1): "a.pdf", (1, 2): "A-2.pdf", (1, 3): "a-2-2.pdf", (1, 4): "a-3.pdf", (2, 1): "same.pdf", (2, 2): "same-2.pdf", (2, 3): "bad.pdf"}


def test_quota(spark):
    small = spark.createDataFrame([(1, i, 1, i) for i in range(24)], "workflow_id int, seq int, size long, file_id long")
    assert queues.reserve_quota(small).count() == 20
    large = spark.createDataFrame([(1, i, 140 * 2**20 if i < 2 else 5, i) for i in range(3)], "workflow_id int, seq int, size long, file_id long")
    assert sorted(r["file_id"] for r in queues.reserve_quota(large).collect()) == [0, 2]


def plain_lines(items):
    """The line fold of one page in plain Python."""
    lines = []
    for it in sorted(items, key=lambda i: (-i["y"], i["x"], i["item_no"])):
        line = lines[-1] if lines else None
        size = max(line["size"], it["font_size"]) if line else 0
        if line and abs(it["y"] - line["y"]) <= 0.4 * size:
            gap = it["x"] - line["endx"] > 0.28 * size and not line["text"].endswith(" ")
            line.update(text=line["text"] + (" " if gap else "") + it["str"], endx=it["x"] + it["width"], size=size)
        else:
            lines.append({"text": it["str"], "y": it["y"], "endx": it["x"] + it["width"], "size": it["font_size"]})
    return [x["text"] for x in lines]


def test_lines_equal_the_plain_fold(spark, sf):
    items = view(spark, sf, "text_items").where("doc_id < 20 and page_no < 3")
    got = {}
    for r in layout.cluster_lines(items).orderBy("line_no").collect():
        got.setdefault((r["doc_id"], r["page_no"]), []).append(r["text"])
    by = {}
    for r in items.where("trim(str) <> ''").collect():
        by.setdefault((r["doc_id"], r["page_no"]), []).append(r)
    assert got == {k: plain_lines(v) for k, v in by.items()}


def test_queue_stream_equals_its_batch_twin(spark, sf):
    folder = new_folder(spark, "queue")
    events = view(spark, sf, "queue_events")
    events.write.parquet(f"{folder}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    stream = queues.queue_state_stream(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    got = queues.run_available(stream, spark, folder, "update")
    want = queues.queue_state(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_steps_check_their_parameters():
    step = recipes.STEPS["page-numbers-v1"]
    assert recipes.validate_params(step, {}) == {"start": 1}
    for bad in ({"start": 0}, {"start": "1"}, {"start": True}, {"other": 1}):
        with pytest.raises(ValueError):
            recipes.validate_params(step, bad)
    with pytest.raises(ValueError):
        recipes.merge_v1([])


def test_markdown_of_html():
    assert web.markdown_of("<h1>A <b>b</b></h1><p>x <b>y</b> <i>z</i><br>w<script>no</script><ul><li>i <b>j</b></ul>") == "# A b\n\nx **y** *z*\nw\n\n- i j"


def test_files_by_kind(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.exe").write_bytes(b"MZ")
    (tmp_path / "c.md").write_text("# hi")
    found, skipped = files.scan_files(spark, str(tmp_path), ["pdf", "text"])
    assert {(r["name"], r["kind"], r["m"]) for r in found.withColumn("m", files.check_magic(F.col("content"))).collect()} == {("a.PDF", "pdf", "pdf"), ("c.md", "text", None)}
    assert [tuple(r) for r in skipped.collect()] == [("exe", 1)]


def test_order_of_rows_and_partitions_does_not_matter(spark, sf):
    d = view(spark, sf, "documents")
    a = scans.cap_findings(scans.scan_sensitive(d), 2)
    b = scans.cap_findings(scans.scan_sensitive(d.orderBy(F.rand(3)).repartition(5)), 2)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_everything_but_llm_imports_without_it():
    import subprocess
    import sys

    code = "import sys; sys.modules['docspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True)


def plain_wrap(text, width):
    """Greedy wrap, one word at a time."""
    lines = [""]
    for word in text.split(" "):
        if not word:
            continue
        if lines[-1] and len(lines[-1]) + 1 + len(word) > width:
            lines.append(word)
        else:
            lines[-1] = f"{lines[-1]} {word}".strip(" ")
    return lines


def test_wrapped_lines_equal_the_plain_wrap(spark, sf):
    blocks = layout.parse_blocks(view(spark, sf, "md_lines"))
    got = {}
    for r in layout.wrap_lines(blocks).orderBy("wrapped_no").collect():
        got.setdefault((r["doc_id"], r["block_no"]), []).append(r["text"])
    assert got == {(r["doc_id"], r["block_no"]): plain_wrap(r["text"], 60) for r in blocks.collect()}


def test_strict_parse_equals_another_parser(spark):
    from xml.etree import ElementTree

    pages = ["<a><b>x</b></a>", "<a><b>x</a>", "", None, "<html lang=\"en\"><title>t</title><br/></html>", "<p>&nbsp;</p>", "<a x=1></a>", "<a/><b/>"]
    d = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")

    def strict(html):
        try:
            ElementTree.fromstring(html or "")
        except ElementTree.ParseError:
            return False
        return True

    assert {r["page_id"]: r["strict"] for r in diagnosis.html_diagnose(d).collect()} == {i: strict(h) for i, h in enumerate(pages)}


def test_html_function_for_sql_equals_the_operator(spark, sf):
    recipes.register_sql(spark)
    d = view(spark, sf, "pages")
    got = spark.sql("SELECT page_id, html_markdown(html) AS markdown FROM pages")
    assert got.exceptAll(web.html_to_markdown(d)).isEmpty() and web.html_to_markdown(d).exceptAll(got).isEmpty()


def test_blocks_of_nothing_and_of_lists(spark):
    recipes.register_sql(spark)
    spark.createDataFrame([(1, None), (2, ""), (3, "1. a\n\n2) b\nplain\n3. c"), (4, "***\n# h #\n- \n* x")], "doc_id long, t string").createOrReplaceTempView("t")
    got = [tuple(r) for r in spark.sql("SELECT doc_id, b.kind, b.item_index, b.text FROM t, LATERAL blocks(t) b ORDER BY doc_id, block_no").collect()]
    assert got == [(3, "ordered", 1, "a"), (3, "ordered", 2, "b"), (3, "text", None, "plain"), (3, "ordered", 1, "c"), (4, "rule", None, ""), (4, "heading", None, "h #"), (4, "bullet", None, "-"), (4, "bullet", None, "x")]


def test_rows_of_a_page_keep_cells_by_x(spark):
    d = spark.createDataFrame([(1, 1, 1, "b", 50.0, 700.0, 5.0, 10.0), (1, 1, 2, "a", 5.0, 697.0, 5.0, 10.0), (1, 1, 3, "c", 5.0, 690.0, 5.0, 12.0), (1, 1, 4, " ", 1.0, 690.0, 5.0, 12.0)], "doc_id long, page_no long, item_no long, str string, x double, y double, width double, font_size double")
    assert [(r["row_no"], r["cell_no"], r["str"]) for r in layout.cluster_rows(d).orderBy("row_no", "cell_no").collect()] == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]
    assert [(r["row_no"], r["column_no"], r["value"]) for r in layout.table_cells(d).orderBy("row_no", "column_no").collect()] == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]
    assert layout.cluster_rows(d.limit(0)).isEmpty() and layout.table_cells(d.limit(0)).isEmpty()


def scans_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_a_sheet_reads_its_items_once(spark, sf):
    assert scans_of(layout.dense_rows(view(spark, sf, "text_items"), view(spark, sf, "doc_pages"))) == 2  # items and pages
    items = spark.createDataFrame([(1, 2, 1, "b", 90.0, 700.0, 5.0, 10.0), (1, 2, 2, "a", 5.0, 697.0, 5.0, 10.0), (1, 2, 3, "c", 5.0, 600.0, 5.0, 12.0), (1, 4, 1, " ", 1.0, 1.0, 1.0, 1.0)], "doc_id long, page_no long, item_no long, str string, x double, y double, width double, font_size double")
    pages = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 2), (2, 7)], "doc_id long, page_no long")
    got = [(r["doc_id"], r["sheet_row"], r["page_no"], r["cells"]) for r in layout.dense_rows(items, pages).orderBy("doc_id", "sheet_row").collect()]
    assert got == [(1, 1, 2, ["a", "b"]), (1, 2, 2, ["c", ""]), (1, 3, 3, []), (1, 4, 3, [""]), (1, 5, 4, []), (1, 6, 4, [""]), (2, 1, 7, [""])]


def test_cells_read_their_items_once(spark, sf):
    assert scans_of(layout.table_cells(view(spark, sf, "text_items"))) == 1
    d = spark.createDataFrame([(1, 1, k, w, x, y, 5.0, 10.0) for k, (w, x, y) in enumerate([("a", -50.0, 9.0), ("b ", 1.0, 9.0), (" c", 2.0, 9.0), ("d", None, 9.0), ("e", 90.0, 9.0)])] + [(1, None, 1, "z", 1.0, 1.0, 1.0, 1.0), (2, 1, 1, "only", None, None, None, None)], "doc_id long, page_no long, item_no long, str string, x double, y double, width double, font_size double")
    assert sorted(tuple(r) for r in layout.table_cells(d).collect()) == [(1, 1, 0, 1, "a"), (1, 1, 0, 2, "b   c"), (1, 1, 0, 3, "e"), (2, 1, 0, 1, "only")]


def test_a_page_of_many_rows(spark):
    """The fold ran once for each row: 191 s for 2,000 rows."""
    began = time.monotonic()
    d = spark.range(25_000).selectExpr("id % 2 as doc_id", "1L as page_no", "id as item_no", "'w' as str", "double(64 - id % 4) as x", "double(-30 * int(id / 4)) as y", "5D as width", "10D as font_size")
    got = layout.cluster_rows(d.repartition(4)).orderBy("doc_id", "row_no", "cell_no").collect()
    assert [(r["doc_id"], r["row_no"], r["cell_no"], r["item_no"]) for r in got] == [(k, r, c + 1, 4 * r + 2 - 2 * c + k) for k in range(2) for r in range(6250) for c in range(2)]
    assert time.monotonic() - began < 120


def test_markdown_reads_its_lines_once(spark, sf):
    items = view(spark, sf, "text_items")
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Generate") < plan.index("Exchange")  # texts are shuffled, not words
    assert scans_of(layout.render_markdown(layout.cluster_lines(items), layout.body_size(items))) == 2  # for the lines, and for the sizes


def test_lines_with_unknown_places_and_faces(spark):
    d = spark.createDataFrame([(1, 1, 1, "a", 5.0, 9.0, 5.0, 10.0, None), (1, 1, 2, "b ", 20.0, 9.0, None, None, "X-Bold"), (1, 1, 3, "c", 90.0, 9.0, 5.0, 12.0, "X-Oblique"), (1, 1, 4, "d", 5.0, None, 5.0, 10.0, None), (1, 2, 1, "e", -5.0, 0.0, 1.0, None, "X")], "doc_id long, page_no long, item_no long, str string, x double, y double, width double, font_size double, font_family string")
    got = layout.cluster_lines(d).orderBy("page_no", "line_no").collect()
    assert [tuple(r)[2:] for r in got] == [(0, "d", None, 10.0, 10.0, None, None), (1, "a b c", 9.0, 95.0, 12.0, True, False), (0, "e", 0.0, -4.0, None, False, False)]


def test_parameter_tables(spark):
    rows = [("page-numbers-v1", None), ("page-numbers-v1", {"start": "0"}), ("page-numbers-v1", {"start": "x"}), ("page-numbers-v1", {"to": "1"}), ("organize-pages-v1", {"order": "keep"}), ("organize-pages-v1", {"order": "up"}), ("none", {}), (None, None)]
    got = recipes.check_params(spark.createDataFrame(rows, "step string, params map<string,string>")).collect()
    assert [r["problem"] for r in got] == [None, "invalid start", "invalid start", "unknown parameter", None, "invalid order", "unknown step", "unknown step"]
    assert got[0]["params"] == {"start": "1"} and got[7]["params"] == {}


def test_written_documents_come_back(spark):
    folder = new_folder(spark, "texts")
    d = spark.createDataFrame([("a", "x\n\ny\n"), ("b", None), ("c", "é")], "name string, text string")
    files.write_text_docs(d, folder, "txt")
    assert sorted(tuple(r) for r in files.read_written_docs(spark, folder).collect()) == [("a.txt", "x\n\ny\n"), ("b.txt", ""), ("c.txt", "é")]


def test_each_document_is_one_file_of_its_name(spark):
    folder = new_folder(spark, "texts")
    rows = [("a", "1"), ("a", "2\n"), (None, "3"), ("", None), ("_x/y:%41é", "\n"), (".z", "4\r\n")] + [(f"n{i}", "m") for i in range(2500)]
    files.write_text_docs(spark.createDataFrame(rows, "name string, text string").coalesce(1), folder)
    want = sorted(((n or "document") + ".md", t or "") for n, t in rows)
    assert sorted(tuple(r) for r in files.read_written_docs(spark, folder).collect()) == want
    found = list(pathlib.Path(folder.removeprefix("file:")).rglob("*.md"))
    assert len(found) == len(rows) and sum(f.name == "a.md" and f.is_file() for f in found) == 2 and len({f.parent for f in found}) < 10
    assert files.read_text_docs(spark, folder).count() == len(rows)
    with pytest.raises(FileExistsError):
        files.write_text_docs(spark.createDataFrame(rows[:1], "name string, text string"), folder)
    with pytest.raises(Exception, match="no such luck"):
        files.write_text_docs(spark.range(9).selectExpr("cast(id as string) as name", "if(id = 8, raise_error('no such luck'), 'x') as text"), f"{folder}-2")
    assert not list(pathlib.Path(folder.removeprefix("file:")).parent.glob(f"*{folder[-12:]}-2*"))


def test_no_documents_are_written_and_read(spark):
    folder = new_folder(spark, "texts")
    files.write_text_docs(spark.createDataFrame([], "name string, text string"), folder)
    assert files.read_written_docs(spark, folder).collect() == []


def streamed(spark, folder, schema, batches, query):
    """What a query gives for each of some micro-batches, written as files before each run."""
    out, source = [], f"{folder}/in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(source)
        got = []
        q = query(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, _, got=got: got.extend(b.collect())).start()
        q.awaitTermination()
        out.append(sorted(map(tuple, got)))
    return out


def test_quota_is_kept_over_micro_batches(spark, tmp_path):
    rows = [[(1, 1, 10, 60, "reserve"), (1, 2, 11, 60, "reserve"), (1, 3, 12, 30, "reserve"), (2, 1, 20, 100, "reserve")], [(1, 4, 10, 60, "release"), (1, 5, 11, 60, "reserve"), (1, 6, 13, 5, "reserve"), (2, 2, 21, 1, "reserve")]]
    got = streamed(spark, tmp_path, "workflow_id long, seq long, file_id long, size long, op string", rows, lambda s: queues.reserve_quota_stream(s, 3, 100))
    assert got == [[(1, 10, True), (1, 11, False), (1, 12, True), (2, 20, True)], [(1, 11, True), (1, 13, True), (2, 21, False)]]
    first = spark.createDataFrame([r[:4] for r in rows[0]], "workflow_id long, seq long, file_id long, size long")
    assert sorted(map(tuple, queues.reserve_quota(first, 3, 100).collect())) == [x[:2] for x in got[0] if x[2]]  # the batch twin


def test_stale_generations_and_cleared_epochs_are_dropped(spark, tmp_path):
    rows = [[(1, 1, 5), (1, 2, 4), (1, 3, 6)], [(1, 4, 6), (1, 5, None), (1, 6, 6), (1, 7, 7), (2, 1, 1)]]
    got = streamed(spark, tmp_path, "key long, seq long, generation long", rows, queues.newest_stream)
    assert got == [[(1, 1, 5), (1, 3, 6)], [(1, 4, 6), (1, 7, 7), (2, 1, 1)]]


def test_expired_records_are_gone_when_read(spark, tmp_path):
    at = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    rows = [[(1, at(0), 0, "write", "a"), (1, at(5), 1, "read", None), (2, at(1), 2, "read", None)], [(1, at(23), 3, "read", None), (1, at(24), 4, "read", None), (1, at(25), 5, "read", None)], [(1, at(26), 6, "write", "b"), (1, at(49), 7, "read", None)]]
    got = streamed(spark, tmp_path, "key long, ts timestamp, seq long, op string, value string", rows, queues.expire_stream)
    assert [[x[2] for x in batch] for batch in got] == [["a", None], ["a", None, None], ["b"]]


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "k long, v string"
    queues.swap_in(spark.createDataFrame([(1, "a")], schema), path)
    queues.swap_in(spark.createDataFrame([(2, "b"), (3, "c")], schema), path)
    read = lambda: sorted(map(tuple, queues.current(spark, path, schema).collect()))
    assert read() == [(2, "b"), (3, "c")]
    with pytest.raises(Exception, match="no such luck"):
        queues.swap_in(spark.range(9).selectExpr("id as k", "cast(raise_error('no such luck') as string) as v"), path)
    assert read() == [(2, "b"), (3, "c")]


def test_columns_that_hold_what_others_replace(spark):
    row = spark.range(1).select(
        C.fill_template(F.lit("{a}-{b}-{c}-{"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("{a}"))).alias("filled"),
        C.encodable_text(F.lit("é中a"), latin=True).alias("latin"),
    ).first()
    assert row["filled"] == "{b}-{a}-{c}-{" and tuple(row["latin"]) == ("é?a", True)


def test_archives_have_checksums_and_pages_a_graph(spark):
    entries = spark.createDataFrame([(1, 1, "a", 3, b"abc"), (1, 2, "bb", 1, b"x")], "archive long, entry_no long, name string, size long, content binary")
    assert [(r["crc32"], r["offset"]) for r in workflows.archive_manifest(entries).orderBy("entry_no").collect()] == [(zlib.crc32(b"abc"), 0), (zlib.crc32(b"x"), 34)]
    html = '<meta content="d" property="og:description"><script type="application/ld+json">{"@graph":[{"@type":"A","n":1},{"@type":"B"}]}</script><script type="application/ld+json">{</script>'
    page = spark.createDataFrame([(7, html)], "page_id long, html string")
    assert [r["entry"] for r in web.graph_entries(page, "A").collect()] == ['{"@type":"A","n":1}']
    assert ("json-ld", 1) in [tuple(r)[1:] for r in web.audit_pages(page).collect()]
    assert web.extract_meta(page).first()["description"] == "d"
    twice = page.unionByName(page)
    assert diagnosis.html_diagnose(twice, deep=True).count() == 2 and diagnosis.html_diagnose(twice, deep=True).first()["error"]
