"""Tables of the document model, derived from the given tables: the same text in Spark SQL and, for checks, in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

# A line of more than 20 words takes as many visual rows as it needs; the rows of a page are numbered in reading order, blank lines included.
_ITEMS = """SELECT doc_id, page_no, CAST(r*20 + w % 20 AS BIGINT) AS item_no, str, CAST(64 + 60*(w % 20) AS DOUBLE) x,
 CAST(720 - 30*r - CASE WHEN k >= 5 THEN 30 ELSE 0 END + w % 2 AS DOUBLE) y, CAST(6*length(str) AS DOUBLE) width,
 CAST(CASE (doc_id + 3*page_no + k) % 17 WHEN 0 THEN 20 WHEN 1 THEN 17 WHEN 2 THEN 14 WHEN 3 THEN 12.5 ELSE 11 END AS DOUBLE) font_size,
 CASE WHEN (doc_id + k) % 5 = 0 THEN 'Helvetica-Bold' WHEN (doc_id + k) % 7 = 0 THEN 'Helvetica-Oblique' ELSE 'Helvetica' END font_family
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY k, v) - 1 AS r FROM
 (SELECT doc_id, CAST(floor(line_no/10)+1 AS BIGINT) page_no, line_no % 10 AS k, w, CAST(floor(w/20) AS BIGINT) v, str FROM words) a) t WHERE str <> ''"""
_BOXES = """SELECT doc_id, page_no, CAST(0 AS DOUBLE) media_x, CAST(0 AS DOUBLE) media_y, CAST(CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 612 END AS DOUBLE) media_w, CAST(792 AS DOUBLE) media_h,
 CAST(CASE WHEN doc_id % 31 = 0 THEN -5 ELSE 0 END AS DOUBLE) crop_x, CAST(0 AS DOUBLE) crop_y, CAST(612 AS DOUBLE) crop_w, CAST(CASE WHEN doc_id % 37 = 0 THEN 900 ELSE 792 END AS DOUBLE) crop_h,
 CAST(90 * ((doc_id + page_no) % 4) AS INT) rotation FROM doc_pages"""
_FILES = """SELECT o_custkey workflow_id, o_orderkey file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) seq,
 CASE WHEN o_orderkey % 2 = 0 THEN lower(concat(substr(o_orderpriority, 3), '.pdf')) ELSE concat(substr(o_orderpriority, 3), '.PDF') END name,
 CAST(floor(o_totalprice * 1000) AS BIGINT) size, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'success' ELSE 'error' END status,
 CAST(o_orderkey % 4 AS INT) step, o_orderdate updated_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END expires_at FROM orders"""
_QUEUE = """SELECT user_id workflow_id, event_id % 5 item_id, event_id seq, ts, CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error'
 ELSE CASE WHEN event_id % 2 = 0 THEN 'cancel' ELSE 'retry' END END op FROM events"""
_DICTIONARY = """SELECT locale, key, CASE WHEN (length(key) + idx) % 11 = 0 THEN '' ELSE concat(locale, ':', key) END value FROM
 (SELECT DISTINCT concat(p_brand, '.', p_type) AS key FROM part) k CROSS JOIN (SELECT * FROM (VALUES ('es',1),('fr',2),('de',3),('pt',4),('it',5),('ru',6),('ja',7),('ko',8),('zh',9),('zh-TW',10),('ar',11),('hi',12),('tr',13),('nl',14),('pl',15),('id',16),('vi',17),('th',18),('uk',19),('cs',20),('sv',21)) AS t(locale, idx)) l WHERE (length(key) + idx) % 7 <> 0"""
_MARKED = "CASE line_no % 12 WHEN 0 THEN concat('# ', line) WHEN 3 THEN concat('- ', line) WHEN 4 THEN concat('- **', line, '**') WHEN 6 THEN concat('1. ', line) WHEN 7 THEN '' WHEN 8 THEN concat('3. ', line) WHEN 9 THEN '---' WHEN 10 THEN concat('a `', line, '` b') ELSE line END"

#: name: (views it needs, Spark SQL, ANSI SQL)
VIEWS: dict[str, tuple[list[str], str, str]] = {
    "doc_lines": ([], r"SELECT doc_id, CAST(pos AS BIGINT) line_no, line FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM documents)", "SELECT doc_id, CAST(i-1 AS BIGINT) line_no, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY u(line, i)"),
    "doc_pages": (["doc_lines"], r"SELECT doc_id, page_no, page_no AS src_index, count(*) n_lines, array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), '\n') text FROM (SELECT *, CAST(floor(line_no/10)+1 AS BIGINT) page_no FROM doc_lines) GROUP BY doc_id, page_no", "SELECT doc_id, page_no, page_no AS src_index, count(*) n_lines, string_agg(line, chr(10) ORDER BY line_no) text FROM (SELECT *, CAST(floor(line_no/10)+1 AS BIGINT) page_no FROM doc_lines) GROUP BY doc_id, page_no"),
    "words": (["doc_lines"], "SELECT doc_id, line_no, CAST(pos AS BIGINT) w, str FROM (SELECT doc_id, line_no, posexplode(split(line, ' ')) AS (pos, str) FROM doc_lines)", "SELECT doc_id, line_no, CAST(i-1 AS BIGINT) w, str FROM doc_lines, unnest(string_split(line, ' ')) WITH ORDINALITY u(str, i)"),
    "text_items": (["doc_lines", "words"], _ITEMS, _ITEMS),
    "page_boxes": (["doc_lines", "doc_pages"], _BOXES, _BOXES),
    "files": ([], _FILES, _FILES),
    "workflows": ([], "SELECT o_custkey workflow_id, max(o_orderdate) + INTERVAL 1 DAY expires_at, array_sort(collect_list(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END)) file_refs FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey", "SELECT o_custkey workflow_id, max(o_orderdate) + INTERVAL 1 DAY expires_at, coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0)), []) file_refs FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey"),
    "queue_events": ([], _QUEUE, _QUEUE),
    "dictionary": ([], _DICTIONARY, _DICTIONARY),
    "md_docs": (["doc_lines"], rf"SELECT doc_id, array_join(transform(array_sort(collect_list(struct(line_no, {_MARKED} AS l))), x -> x.l), '\n') text FROM doc_lines GROUP BY doc_id", f"SELECT doc_id, string_agg({_MARKED}, chr(10) ORDER BY line_no) text FROM doc_lines GROUP BY doc_id"),
    "md_lines": (["doc_lines"], f"SELECT doc_id, line_no, {_MARKED} AS line FROM doc_lines", f"SELECT doc_id, line_no, {_MARKED} AS line FROM doc_lines"),
}


#: views whose documents are dealt to tasks by doc_id before their texts are cut: what a window puts together later lies together already, so texts are shuffled and not words
DEALT = {"text_items"}


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A given table or a view of the document model, over sf_dir."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if dealt and name == "documents":
            df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    else:
        needs, sql, _ = VIEWS[name]
        for t in [*[t for t in TABLES if t in sql], *needs]:
            view(spark, sf_dir, t, dealt or name in DEALT)
        df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    return df


def with_views(body: str, *names: str, more: str = "") -> str:
    """ANSI SQL of a query whose views become common table expressions; more: further ones, which may be recursive."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in VIEWS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ", ".join([*[f"{n} AS ({VIEWS[n][2]})" for n in order], *([more] if more else [])])
    return f"WITH {'RECURSIVE ' if more else ''}{ctes} {body}" if ctes else body
