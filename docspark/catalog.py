"""All registered queries and their SQL: each applies one operator of the package to the given tables or views of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators import columns as C
from docspark.operators import diagnosis, layout, pages, scans, web, workflows
from docspark.plans import recipes
from docspark.plans.shared import new_folder
from docspark.plans.views import view, with_views
from docspark.sources import files as sources
from docspark.streaming import queues

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "TIMESTAMP '1996-06-01 00:00:00'"


def query(name: str, needs: str, sql: str | None = None, *views: str) -> Callable:
    """Registers f(*tables) under a name: needs are the tables and views it is given; sql with its views is the check."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in needs.split()])
        if sql:
            ORACLE[name] = with_views(sql, *views)
        return f

    return register


# --- B: columns

query("b1_format_bytes", "files", "SELECT file_id, CASE WHEN size < 1000 THEN concat(size, ' B') WHEN size < 1000000 THEN concat(floor(size/1000.0*10+0.5)/10, ' KB') ELSE concat(floor(size/1000000.0*10+0.5)/10, ' MB') END AS label FROM files", "files")(lambda d: d.select("file_id", C.format_bytes(F.col("size")).alias("label")))
query("b2_base_name", "files", "SELECT file_id, coalesce(nullif(regexp_replace(name, '(?i)\\.pdf$', ''), ''), 'document') AS base FROM files", "files")(lambda d: d.select("file_id", C.base_name(F.col("name")).alias("base")))
query("b3_output_name", "files", "SELECT file_id, concat(regexp_replace(name, '(?i)\\.pdf$', ''), '-scan-clean.pdf') AS out_name FROM files", "files")(lambda d: d.select("file_id", C.output_name(F.col("name"), F.lit("scan_clean-v1")).alias("out_name")))
query("b4_safe_text", "documents", "SELECT doc_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS safe FROM documents")(lambda d: d.select("doc_id", C.safe_text(F.col("text"), 120).alias("safe")))
query("b5_clamp_count", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, greatest(0, least(20, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(l_quantity AS BIGINT) ELSE 0 END)) AS n FROM lineitem")(lambda d: d.select("l_orderkey", "l_linenumber", "l_quantity", C.clamp_count(F.col("l_quantity"), 0, 20).alias("n")))
query("b6_fill_template", "part", "SELECT p_partkey, concat(p_name, ' by ', p_brand, ' {unknown}') AS filled FROM part")(lambda d: d.select("p_partkey", C.fill_template(F.lit("{name} by {brand} {unknown}"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))).alias("filled")))
query("b7_page_label", "doc_pages", "SELECT doc_id, page_no, concat('Page ', page_no, ' of ', n_lines) AS label FROM doc_pages", "doc_pages")(lambda d: d.select("doc_id", "page_no", C.page_label(F.lit("of"), F.col("page_no"), F.col("n_lines")).alias("label")))
query("b8_rotate_angle", "page_boxes", "SELECT doc_id, page_no, ((rotation - 90) % 360 + 360) % 360 AS angle FROM page_boxes", "page_boxes")(lambda d: d.select("doc_id", "page_no", C.rotate_angle(F.col("rotation"), F.lit(-90)).alias("angle")))
query("b9_crop_box", "page_boxes", "SELECT doc_id, page_no, CASE rotation WHEN 0 THEN l WHEN 90 THEN t WHEN 180 THEN 0.0 ELSE 0.0 END AS x, CASE rotation WHEN 0 THEN 0.0 WHEN 90 THEN l WHEN 180 THEN t ELSE 0.0 END AS y, CASE WHEN turned THEN h ELSE w END AS w, CASE WHEN turned THEN w ELSE h END AS h FROM (SELECT *, greatest(10.0, sw - l) AS w, greatest(10.0, sh - t) AS h FROM (SELECT *, greatest(0.0, least(50.0, sw/2-5)) AS l, greatest(0.0, least(100.0, sh/2-5)) AS t FROM (SELECT doc_id, page_no, rotation, rotation % 180 <> 0 AS turned, CASE WHEN rotation % 180 <> 0 THEN media_h ELSE media_w END AS sw, CASE WHEN rotation % 180 <> 0 THEN media_w ELSE media_h END AS sh FROM page_boxes)))", "page_boxes")(lambda d: d.select("doc_id", "page_no", C.crop_box(F.col("media_w"), F.col("media_h"), F.col("rotation"), 100, 0, 0, 50).alias("c")).select("doc_id", "page_no", "c.*"))
query("b10_quality_level", "files", "SELECT file_id, CASE WHEN v <= 50 THEN 0.85 + v/50*0.45 ELSE 1.3 + (v-50)/50*0.7 END AS scale, CASE WHEN v <= 50 THEN 0.55 + v/50*0.23 ELSE 0.78 + (v-50)/50*0.12 END AS quality FROM (SELECT file_id, CAST(file_id % 101 AS DOUBLE) v FROM files)", "files")(lambda d: d.select("file_id", C.quality_level((F.col("file_id") % 101).cast("double")).alias("q")).select("file_id", "q.*"))
query("b11_quality_label", "files", "SELECT file_id, CASE WHEN v < 20 THEN 'Smallest file' WHEN v < 40 THEN 'Smaller file' WHEN v <= 60 THEN 'Balanced' WHEN v < 80 THEN 'Good quality' ELSE 'Highest quality' END AS label FROM (SELECT file_id, file_id % 101 v FROM files)", "files")(lambda d: d.select("file_id", C.quality_label(F.col("file_id") % 101).alias("label")))
query("b12_encodable_text", "documents", "SELECT doc_id, nullif(substring(trim(regexp_replace(text, '[^\\x20-\\x7e]', '', 'g')), 1, 40), '') AS text, regexp_replace(text, '[^\\x20-\\x7e]', '', 'g') <> text AS dropped FROM documents")(lambda d: d.select("doc_id", C.encodable_text(F.col("text")).alias("e")).select("doc_id", "e.*"))
_EMPH = "CASE WHEN trim(str) = '' THEN trim(str) WHEN b THEN concat('**', trim(str), '**') WHEN i THEN concat('*', trim(str), '*') ELSE trim(str) END"
query("b13_wrap_emphasis", "text_items", f"SELECT doc_id, page_no, item_no, {_EMPH} AS s FROM (SELECT *, font_family LIKE '%Bold%' b, font_family LIKE '%Oblique%' i FROM text_items)", "text_items")(lambda d: d.select("doc_id", "page_no", "item_no", C.wrap_emphasis(F.col("str"), F.contains("font_family", F.lit("Bold")), F.contains("font_family", F.lit("Oblique"))).alias("s")))
query("b14_escape_leading_token", "md_lines", "SELECT doc_id, line_no, regexp_replace(line, '^([#\\-*+>])', '\\\\\\1') AS line FROM md_lines", "md_lines")(lambda d: d.select("doc_id", "line_no", C.escape_leading_token(F.col("line")).alias("line")))
query("b15_markdown_to_plain", "md_docs", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6} ', '', 'g'), '\\*\\*\\*([^*\\n]+)\\*\\*\\*', '\\1', 'g'), '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '\\*([^*\\n]+)\\*', '\\1', 'g'), '`([^`\\n]+)`', '\\1', 'g') AS plain FROM md_docs", "md_docs")(lambda d: d.select("doc_id", C.markdown_to_plain(F.col("text")).alias("plain")))
query("b16_text_paragraphs", "md_docs", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n[\\x20\\t]*\\n'), lambda p: trim(regexp_replace(p, '\\s*\\n\\s*', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM md_docs", "md_docs")(lambda d: d.select("doc_id", C.text_paragraphs(F.col("text")).alias("text")))
query("b17_escape_html", "pages", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS attr, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM pages")(lambda d: d.select("page_id", C.escape_html(F.col("html")).alias("attr"), C.escape_xml(F.col("html")).alias("xml")))
query("b18_split_keywords", "part", "SELECT p_partkey, array_to_string(list_filter([trim(p_brand), trim(p_type), ''], lambda x: x <> ''), '|') AS keywords FROM part")(lambda d: d.select("p_partkey", F.array_join(C.split_keywords(F.concat_ws(" , ", "p_brand", "p_type", F.lit(" "))), "|").alias("keywords")))
query("b19_set_metadata", "documents", "SELECT doc_id, concat('Doc ', doc_id) AS title, source AS author, lang AS subject, source AS keywords, 'writer' AS creator, 'maker' AS producer, TIMESTAMP '2026-01-01 00:00:00' AS modified FROM documents")(lambda d: C.set_metadata(d.select("doc_id", F.col("source").alias("author"), F.col("lang").alias("subject"), "source"), {"title": F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), "keywords": F.col("source"), "creator": F.lit("writer"), "producer": F.lit("maker")}, F.expr("timestamp_ntz'2026-01-01 00:00:00'")).drop("source"))
query("b20_carry_metadata", "documents", "SELECT doc_id, coalesce(nullif(source, ''), lang) AS author, coalesce(TRY_CAST(source AS BIGINT), n_chars) AS n_chars FROM documents")(lambda d: C.carry_metadata(d.select("doc_id", F.col("lang").alias("author"), F.col("n_chars").cast("long").alias("n_chars"), F.struct(F.col("source").alias("author"), F.col("source").alias("n_chars")).alias("was")), "was", ["author", "n_chars"]).drop("was"))
_URL = "CASE page_id % 4 WHEN 0 THEN concat('https://www.example.org/', CASE WHEN page_id % 8 = 0 THEN 'fr/' ELSE 'tools/' END, '?q=1') WHEN 1 THEN url WHEN 2 THEN concat(url, '/') ELSE 'https://example.org/de/' END"
query("b21_canonical_url", "pages", f"SELECT page_id, concat(CASE WHEN regexp_extract(b, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '/' OR regexp_replace(regexp_extract(b, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/|/$', '', 'g') IN ({', '.join(repr(x) for x in C.LANGUAGES)}) THEN b ELSE regexp_replace(b, '/$', '') END, q) AS canonical FROM (SELECT page_id, split_part(u, '?', 1) b, CASE WHEN contains(u, '?') THEN concat('?', split_part(u, '?', 2)) ELSE '' END q FROM (SELECT page_id, regexp_replace({_URL}, '^([a-z]+://)www\\.', '\\1') u FROM pages))")(lambda d: d.select("page_id", C.canonical_url(F.expr(_URL)).alias("canonical")))
_PATH = "CASE page_id % 3 WHEN 0 THEN '/fr/tools' WHEN 1 THEN '/de' ELSE '/tools/merge' END"
query("b22_route_language", "pages", f"SELECT page_id, CASE p WHEN '/fr/tools' THEN 'fr' WHEN '/de' THEN 'de' ELSE 'en' END AS lang, CASE p WHEN '/fr/tools' THEN '/tools' WHEN '/de' THEN '/' ELSE p END AS page FROM (SELECT page_id, {_PATH} p FROM pages)")(lambda d: d.select("page_id", C.route_language(F.expr(_PATH)).alias("r")).select("page_id", "r.*"))
_LINKS = "SELECT page_id, CAST(i - 1 AS INT) AS link_no, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1) l FROM pages))"
query("b23_localize_href", "pages", f"SELECT page_id, link_no, href, CASE WHEN regexp_matches(href, '^(?:[a-z]+:|#|\\?|\\.|//)') OR split_part(href, '/', 2) IN ({', '.join(repr(x) for x in C.LANGUAGES)}) OR href = '' THEN href WHEN starts_with(href, '/') THEN concat('/fr', href) ELSE concat('/fr/', href) END AS localized FROM ({_LINKS})")(lambda d: web.localized_links(d, "fr"))
query("b24_detect_language", "pages", f"SELECT page_id, CASE WHEN p = '/fr/tools' THEN 'fr' WHEN p = '/de' THEN 'de' WHEN page_id % 5 = 0 THEN 'es' WHEN page_id % 5 = 1 THEN 'zh-TW' WHEN page_id % 5 = 2 THEN 'pt' ELSE 'en' END AS lang FROM (SELECT page_id, {_PATH} p FROM pages)")(lambda d: d.select("page_id", C.detect_language(F.expr(_PATH), F.expr("CASE WHEN page_id % 5 = 0 THEN 'es' END"), F.expr("CASE page_id % 5 WHEN 1 THEN 'zh-HK' WHEN 2 THEN 'pt-BR' ELSE 'xx' END")).alias("lang")))
query("b25_text_direction", "dictionary", "SELECT locale, key, CASE WHEN locale = 'ar' THEN 'rtl' ELSE 'ltr' END AS dir FROM dictionary", "dictionary")(lambda d: d.select("locale", "key", C.text_direction(F.col("locale")).alias("dir")))
query("b26_is_present", "dictionary", "SELECT locale, key, value IS NOT NULL AND trim(value) <> '' AS present FROM dictionary", "dictionary")(lambda d: d.select("locale", "key", C.is_present(F.col("value")).alias("present")))
query("b27_search_rows", "part", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")(lambda d: workflows.search_rows(d, "Brand#1", "p_name", "p_brand", "p_type").select("p_partkey"))
query("b28_select_pages", "doc_pages", "SELECT doc_id, page_no, n_lines FROM doc_pages WHERE page_no IN (1, 3)", "doc_pages")(lambda d: pages.select_pages(d, d.where("page_no in (1, 3)").select("doc_id", "page_no")).select("doc_id", "page_no", "n_lines"))
query("b29_map_permissions", "files", "SELECT file_id, CASE status WHEN 'queued' THEN 'none' WHEN 'error' THEN 'lowResolution' ELSE 'highResolution' END AS printing, step > 1 AS copying, size > 100000000 AS modifying, true AS accessibility FROM files", "files")(lambda d: d.select("file_id", C.map_permissions(F.replace(F.replace("status", F.lit("queued"), F.lit("none")), F.lit("error"), F.lit("low")), F.col("step") > 1, F.col("size") > 100_000_000).alias("p")).select("file_id", "p.*"))
query("b30_classify_line", "text_items", "SELECT doc_id, page_no, item_no, CASE WHEN font_size/11 >= 1.8 THEN 'heading1' WHEN font_size/11 >= 1.5 THEN 'heading2' WHEN font_size/11 >= 1.25 THEN 'heading3' WHEN font_size/11 >= 1.1 THEN 'heading4' WHEN regexp_matches(str, '^[-*•] +') THEN 'bullet' WHEN regexp_matches(str, '^[0-9]{1,3}[.)] +') THEN 'ordered' ELSE 'paragraph' END AS kind FROM text_items", "text_items")(lambda d: d.select("doc_id", "page_no", "item_no", C.classify_line(F.col("font_size"), F.lit(11.0), F.col("str"))["kind"].alias("kind")))
query("b31_is_locked_error", "events", "SELECT event_id, regexp_matches(m, '(?i)password|encrypted') AS locked FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'File is Encrypted' WHEN 1 THEN 'no PASSWORD given' ELSE 'broken' END m FROM events)")(lambda d: d.select("event_id", C.is_locked_error(F.lit("Error"), F.expr("CASE event_id % 3 WHEN 0 THEN 'File is Encrypted' WHEN 1 THEN 'no PASSWORD given' ELSE 'broken' END")).alias("locked")))
query("b32_needs_ocr", "text_items page_boxes", "SELECT b.doc_id, b.page_no, CASE WHEN b.rotation <> 0 THEN 'skip' WHEN coalesce(n, 0) < 6 OR coalesce(c, 0) < 25 THEN 'recognise' ELSE 'keep' END AS action FROM page_boxes b LEFT JOIN (SELECT doc_id, page_no, count(*) FILTER (WHERE trim(str) <> '') n, sum(length(trim(str))) c FROM text_items GROUP BY ALL) s ON b.doc_id = s.doc_id AND b.page_no = s.page_no", "text_items", "page_boxes")(layout.needs_ocr)
query("b33_filter_confidence", "text_items", "SELECT doc_id, page_no, item_no FROM text_items WHERE CASE WHEN item_no % 7 = 0 THEN 100 ELSE (item_no * 13) % 100 END >= 30", "text_items")(lambda d: layout.filter_confidence(d.withColumn("conf", F.when(F.col("item_no") % 7 != 0, F.col("item_no") * 13 % 100))).select("doc_id", "page_no", "item_no"))
query("b34_available_actions", "files", "SELECT workflow_id, array_to_string(list_filter([CASE WHEN max(status = 'queued') THEN 'cancel' END, CASE WHEN max(status = 'error') THEN 'retry' END, CASE WHEN NOT workflow_id % 7 = 0 THEN 'normalise' END], lambda x: x IS NOT NULL), ',') AS actions FROM files GROUP BY workflow_id", "files")(lambda d: d.groupBy("workflow_id").agg(F.max(F.col("status") == "queued").alias("q"), F.max(F.col("status") == "error").alias("e")).select("workflow_id", F.array_join(C.available_actions(F.col("q"), F.lit(False), F.col("e"), F.col("workflow_id") % 7 == 0), ",").alias("actions")))

_ASKED_URL = "CASE page_id % 6 WHEN 0 THEN concat('https://www.example.org/fr/tools/merge.html?q=', page_id) WHEN 1 THEN url WHEN 2 THEN concat(url, '//') WHEN 3 THEN 'https://example.org/de' WHEN 4 THEN 'https://example.org/ar/index.html' ELSE 'https://example.org/tools/?a=b' END"
query("b21_redirect", "pages", f"""WITH u AS (SELECT page_id, {_ASKED_URL} AS u FROM pages), p AS (SELECT *, regexp_replace(regexp_extract(u, '^([a-z]+://[^/?#]*)', 1), '^([a-z]+://)www\\.', '\\1') AS origin, coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) AS query FROM u),
 l AS (SELECT *, split_part(path, '/', 2) IN ({', '.join(repr(x) for x in C.LANGUAGES)}) AS known FROM p), b AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN known THEN coalesce(nullif(substring(path, length(split_part(path, '/', 2)) + 2), ''), '/') ELSE path END, '(/index)?\\.html$', ''), '/+$', '') AS bare FROM l)
 SELECT page_id, location, CASE WHEN location = u THEN 200 ELSE 301 END AS status FROM (SELECT page_id, u, origin || CASE WHEN known THEN '/' || split_part(path, '/', 2) ELSE '' END || CASE WHEN bare = '' THEN '/' ELSE bare END || query AS location FROM b)""")(lambda d: d.select("page_id", C.redirect(F.expr(_ASKED_URL)).alias("r")).select("page_id", "r.*"))
query("b34_document_actions", "files", "SELECT file_id, array_to_string(list_filter([CASE WHEN status IN ('queued', 'running') THEN 'cancel' END, CASE WHEN status = 'error' THEN 'retry' END, CASE WHEN step > 0 AND file_id % 7 <> 0 THEN 'normalise' END, CASE WHEN step > 1 AND file_id % 7 <> 0 THEN 'rebuild' END], lambda x: x IS NOT NULL), ',') AS actions FROM files", "files")(lambda d: d.select("file_id", F.array_join(C.document_actions(F.col("status") == "queued", F.col("status") == "running", F.col("status") == "error", F.col("step") > 1, F.col("step") > 0, F.col("file_id") % 7 == 0), ",").alias("actions")))
query("b16_ocr_markdown", "md_docs", "SELECT doc_id, CASE WHEN t = '' THEN '' ELSE '*(Page scanned via OCR)*' || chr(10) || chr(10) || t END AS text FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n[\\x20\\t]*\\n'), lambda p: trim(regexp_replace(p, '\\s*\\n\\s*', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS t FROM md_docs)", "md_docs")(lambda d: d.select("doc_id", C.ocr_markdown(F.col("text")).alias("text")))
query("b15_ocr_note", "part", "SELECT p_partkey, '[Page scanned via OCR]' || chr(10) || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN ' *(Page scanned via OCR)'  ELSE '' END AS plain FROM part")(lambda d: d.select("p_partkey", C.markdown_to_plain(F.concat(C.ocr_markdown(F.concat(F.lit("**"), "p_name", F.lit("**"))), F.when(F.col("p_size") % 2 == 0, " *(Page scanned via OCR)").otherwise(""))).alias("plain")))

# --- H1, E6, D1 and what follows from findings

_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{c}' AS category, '{conf}' AS confidence, unnest(l) AS match, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') l FROM documents)" for i, (c, conf, p) in enumerate(scans.SENSITIVE)) + ")"
query("h1_scan_sensitive", "documents", f"WITH {_FOUND} SELECT doc_id, category, confidence, substring(match, 1, 120) AS match FROM found")(lambda d: scans.scan_sensitive(d).select("doc_id", "category", "confidence", "match"))
query("e6_cap_findings", "documents", f"WITH {_FOUND} SELECT doc_id, category, substring(match, 1, 120) AS match, CAST(position AS INT) AS position, truncated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) position, count(*) OVER (PARTITION BY doc_id) >= 3 truncated FROM found) WHERE position <= 3")(lambda d: scans.cap_findings(scans.scan_sensitive(d), 3).select("doc_id", "category", "match", "position", "truncated"))
query("d1_category_counts", "documents", f"WITH {_FOUND} SELECT doc_id, category, count(*) AS n FROM found GROUP BY ALL")(lambda d: scans.category_counts(scans.scan_sensitive(d)))
query("k15_public_summary", "documents", f"WITH {_FOUND} SELECT category, confidence, count(*) AS n, count(DISTINCT doc_id) AS documents FROM found GROUP BY ALL")(lambda d: scans.public_summary(scans.scan_sensitive(d)))
query("d2_privacy_summary", "documents", f"WITH {_FOUND} SELECT doc_id, least(count(*), 100) AS findings, count(*) >= 100 AS truncated, count(DISTINCT category) AS categories, count(*) FILTER (WHERE category = 'email') AS n_email, count(*) FILTER (WHERE category = 'us-ssn') AS n_us_ssn, count(*) FILTER (WHERE category = 'payment-card') AS n_payment_card, count(*) FILTER (WHERE category = 'phone') AS n_phone FROM found GROUP BY doc_id")(lambda d: scans.privacy_summary(scans.scan_sensitive(d)))
query("d4_metadata_scan", "documents", "SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(lang) <> '' THEN 'lang' END, CASE WHEN trim(source) <> '' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS fields, 2 - CAST(lang IS NULL OR trim(lang) = '' AS INT) - CAST(source IS NULL OR trim(source) = '' AS INT) AS n_fields FROM documents")(lambda d: scans.metadata_scan(d, ["lang", "source"]))
query("k2_clean_metadata", "documents", "SELECT doc_id, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS source, n_chars FROM documents")(lambda d: scans.clean_metadata(d, ["lang", "source"]).select("doc_id", "lang", "source", "n_chars"))
query("k9_banned_phrases", "documents benchmark", "SELECT doc_id, phrase FROM documents, (SELECT DISTINCT text AS phrase FROM benchmark UNION ALL SELECT 'the end' UNION ALL SELECT 'license') p WHERE contains(lower(text), lower(phrase))")(lambda d, b: scans.banned_phrases(d, b.select(F.col("text").alias("phrase")).distinct().unionByName(b.select(F.explode(F.array(F.lit("the end"), F.lit("license"))).alias("phrase")).distinct())))
query("k14_leak_check", "documents benchmark", "SELECT needle, count(*) AS n FROM documents, (SELECT DISTINCT text AS needle FROM benchmark) WHERE contains(text, needle) GROUP BY needle")(lambda d, b: scans.leak_check(d.select(F.col("text").alias("value")), b.select(F.col("text").alias("needle")).distinct()))
query("d15_error_rollup", "events", "SELECT key, least(sum(n), 100000) AS errors, sum(n) >= 100000 AS truncated, string_agg(category, ',' ORDER BY first) AS categories, any_value(locations) AS locations FROM (SELECT user_id AS key, concat('c', event_id % 7) AS category, count(*) n, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY ALL) JOIN (SELECT user_id AS key, string_agg(event_id, ',' ORDER BY event_id) AS locations FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events WHERE event_type = 'error') WHERE k <= 100 GROUP BY 1) USING (key) GROUP BY key")(lambda d: scans.error_rollup(d.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("category"), F.col("event_id").alias("seq"))))
query("d16_invisible_ops", "events", "SELECT user_id, count(*) FILTER (WHERE (event_id % 8) & 3 = 3) AS n FROM events GROUP BY user_id")(lambda d: scans.invisible_ops(d, "user_id", F.col("event_id") % 8))

# --- pages

query("c2_apply_order", "doc_pages", "SELECT doc_id, page_no, CASE WHEN doc_id % 5 <> 0 THEN CAST(n_pages - page_no + 1 AS BIGINT) END AS position, CASE WHEN doc_id % 5 = 0 THEN 'order is no permutation' END AS problem FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) n_pages FROM doc_pages)", "doc_pages")(lambda d: pages.apply_order(d.select("doc_id", "page_no"), d.where(~((F.col("doc_id") % 5 == 0) & (F.col("page_no") == 1))).select("doc_id", "page_no").withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page_no"))).cast("long"))))
query("c13_merge_documents", "conversations", "SELECT conv_id // 3 AS target, conv_id AS input_no, turn AS page_no, row_number() OVER (PARTITION BY conv_id // 3 ORDER BY conv_id, turn) AS new_page FROM conversations WHERE conv_id // 3 IN (SELECT conv_id // 3 FROM conversations GROUP BY 1 HAVING count(DISTINCT conv_id) > 1)")(lambda d: pages.merge_documents(d.select(F.expr("conv_id div 3").alias("target"), F.col("conv_id").alias("input_no"), F.col("turn").alias("page_no"))))
query("d8_estimate_size", "doc_pages", "SELECT *, CAST(floor((estimate - exact) * 100.0::DOUBLE / nullif(exact, 0) + 0.5) AS BIGINT) AS percent FROM (SELECT doc_id, CAST(floor(CASE WHEN max(n) <= 5 THEN sum(size) ELSE sum(size) FILTER (WHERE page_no = 1) + avg(size) FILTER (WHERE page_no > 1) * (max(n) - 1) END + 300 * max(n) + 1000 + 0.5) AS BIGINT) AS estimate, CAST(max(exact) AS BIGINT) AS exact FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) n, sum(size) OVER (PARTITION BY doc_id) exact FROM (SELECT doc_id, page_no, CAST(length(text) AS BIGINT) AS size FROM doc_pages)) WHERE n <= 5 OR page_no IN (1, 1 + floor((n-1)/4.0 + 0.5), 1 + floor(2*(n-1)/4.0 + 0.5), 1 + floor(3*(n-1)/4.0 + 0.5), n) GROUP BY doc_id)", "doc_pages")(lambda d: pages.estimate_size(d.select("doc_id", "page_no", F.length("text").cast("long").alias("size"))))
query("d11_rotation_hint", "page_boxes", "SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE page_no % 3 <> 0) AS kept, count(*) FILTER (WHERE page_no % 3 = 0) AS removed, count(*) FILTER (WHERE page_no % 3 <> 0 AND rotation <> 0) AS rotated FROM page_boxes GROUP BY doc_id", "page_boxes")(lambda d: pages.rotation_hint(d, F.col("page_no") % 3 != 0))
query("d13_box_issues", "page_boxes", "SELECT doc_id, least(count(*) FILTER (WHERE bad), 100) AS issues, count(*) FILTER (WHERE bad) >= 100 AS truncated FROM (SELECT doc_id, media_w <= 0 OR media_h <= 0 OR crop_w <= 0 OR crop_h <= 0 OR crop_x < media_x OR crop_y < media_y OR crop_x + crop_w > media_x + media_w OR crop_y + crop_h > media_y + media_h AS bad FROM page_boxes) GROUP BY doc_id", "page_boxes")(pages.box_issues)
query("e1_renumber", "lineitem", "SELECT l_orderkey AS doc_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS page_no FROM lineitem")(lambda d: pages.renumber(d.withColumnRenamed("l_orderkey", "doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax").select("doc_id", "l_partkey", "page_no"))
query("e2_number_pages", "doc_pages", "SELECT doc_id, page_no, CASE WHEN k > s THEN CAST(k - s + 4 AS BIGINT) END AS number, CAST(n - s + 4 AS BIGINT) AS total FROM (SELECT *, CASE WHEN n > 1 THEN 1 ELSE 0 END s FROM (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) n, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) k FROM doc_pages))", "doc_pages")(lambda d: pages.number_pages(d.select("doc_id", "page_no"), 5))
query("e3_reverse_pages", "conversations", "SELECT conv_id AS doc_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS page_no FROM conversations")(lambda d: pages.reverse_pages(d.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")))
query("f3_sample_pages", "doc_pages", "SELECT doc_id, page_no FROM (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) n FROM doc_pages) WHERE n <= 5 OR page_no IN (1, 1 + floor((n-1)/4.0 + 0.5), 1 + floor(2*(n-1)/4.0 + 0.5), 1 + floor(3*(n-1)/4.0 + 0.5), n)", "doc_pages")(lambda d: pages.sample_pages(d.select("doc_id", "page_no")))
query("f4_first_last", "doc_pages", "SELECT doc_id, page_no FROM (SELECT doc_id, page_no, min(page_no) OVER w a, max(page_no) OVER w b FROM doc_pages WINDOW w AS (PARTITION BY doc_id)) WHERE page_no IN (a, b)", "doc_pages")(lambda d: pages.first_last(d.select("doc_id", "page_no")))
query("f8_page_at", "doc_pages", "SELECT doc_id, page_no FROM (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) n FROM doc_pages) WHERE page_no = least(greatest(3, 1), n)", "doc_pages")(lambda d: pages.page_at(d.select("doc_id", "page_no"), 3))
query("g1_delete_pages", "doc_pages", "SELECT doc_id, page_no, NULL::VARCHAR AS problem FROM doc_pages WHERE page_no % 2 = 1 AND doc_id % 5 <> 0 UNION ALL SELECT DISTINCT doc_id, NULL, 'nothing is left' FROM doc_pages WHERE doc_id % 5 = 0", "doc_pages")(lambda d: pages.delete_pages(d, d.where("page_no % 2 = 0 or doc_id % 5 = 0").select("doc_id", "page_no")).select("doc_id", "page_no", "problem"))
query("g3_append_documents", "doc_pages", "SELECT doc_id, src_index, row_number() OVER (PARTITION BY doc_id ORDER BY part, src_index) AS page_no FROM (SELECT doc_id, src_index, 0 part FROM doc_pages UNION ALL SELECT doc_id, src_index, 1 part FROM doc_pages WHERE src_index = 1)", "doc_pages")(lambda d: pages.append_documents(d.select("doc_id", "page_no", "src_index"), d.where("src_index = 1").select("doc_id", "page_no", "src_index")))
query("h6_document_text", "doc_pages", "SELECT doc_id, concat(trim(string_agg(text, chr(10) || chr(10) ORDER BY page_no)), chr(10)) AS text FROM doc_pages WHERE trim(text) <> '' GROUP BY doc_id", "doc_pages")(pages.document_text)
query("h15_split_each", "doc_pages", "SELECT doc_id, page_no, concat('doc', doc_id, '-page-', page_no) AS name FROM doc_pages", "doc_pages")(lambda d: pages.split_each(d.select("doc_id", "page_no")))
query("h16_organize", "page_boxes", "SELECT doc_id, page_no, (rotation + 90) % 360 AS rotation, row_number() OVER (PARTITION BY doc_id ORDER BY -page_no, page_no) AS new_page, NULL::VARCHAR AS problem FROM page_boxes WHERE page_no % 3 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, 'nothing is kept' FROM page_boxes WHERE doc_id % 7 = 0", "page_boxes")(lambda d: pages.organize(d.select("doc_id", "page_no", "rotation"), d.select("doc_id", "page_no", ((F.col("page_no") % 3 != 0) & (F.col("doc_id") % 7 != 0)).alias("keep"), (-F.col("page_no")).alias("position"), F.lit(90).alias("turn"))).select("doc_id", "page_no", "rotation", "new_page", "problem"))
query("k5_verify_counts", "doc_pages", "SELECT doc_id, count(*) AS expected, count(*) FILTER (WHERE page_no <= 5) AS found, count(*) = count(*) FILTER (WHERE page_no <= 5) AS ok FROM doc_pages GROUP BY doc_id", "doc_pages")(lambda d: pages.verify_counts(d, d.where("page_no <= 5")))
query("k5_verify_written", "doc_pages", "SELECT doc_id, count(*) AS expected, count(*) FILTER (WHERE page_no <= 5) AS found, CAST(0 AS BIGINT) AS \"left\", CASE WHEN count(*) > 5 THEN 4 ELSE 0 END AS altered, true AS readable, count(*) <= 5 AS ok FROM doc_pages GROUP BY doc_id", "doc_pages")(lambda d: recipes.verify_written(d, d.where("page_no <= 5"), "doc_id", [], samples=("text",)).withColumn("altered", F.when(F.col("altered") > 0, 4).otherwise(0)))
query("c8_compare_parsers", "pages", "SELECT page_id AS doc_id, n AS n_a, CASE WHEN page_id % 4 <> 0 THEN n END AS n_b, page_id % 4 <> 0 AND n > 0 AS consistent FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p>')) AS BIGINT) n FROM pages)")(lambda d: pages.compare_parsers(d.select(F.col("page_id").alias("doc_id"), F.regexp_count("html", F.lit("(?i)<p>")).cast("long").alias("n")), d.where("page_id % 4 <> 0").select(F.col("page_id").alias("doc_id"), F.regexp_count("html", F.lit("(?i)<p>")).cast("long").alias("n"))))

# --- files, workflows, dictionaries

query("c1_resolve_refs", "workflows files", "SELECT w.workflow_id, CAST(w.position - 1 AS INT) AS position, w.file_id, CASE WHEN f.status = 'running' THEN 'canceled' ELSE f.status END AS status FROM (SELECT workflow_id, unnest(file_refs) file_id, generate_subscripts(file_refs, 1) position FROM workflows) w JOIN files f ON f.file_id = w.file_id", "workflows", "files")(lambda w, f: workflows.resolve_refs(w, f).select("workflow_id", "position", "file_id", "status"))
query("c3_orphan_files", "workflows files", f"SELECT * FROM (SELECT f.file_id, f.workflow_id, CASE WHEN w.expires_at <= {NOW} THEN 'owner expired' WHEN w.workflow_id IS NULL AND coalesce(f.expires_at, f.updated_at + INTERVAL 1 DAY) <= {NOW} THEN 'no owner' WHEN w.workflow_id IS NOT NULL AND NOT list_contains(w.file_refs, f.file_id) AND coalesce(f.expires_at, f.updated_at + INTERVAL 1 DAY) <= {NOW} THEN 'unreferenced' END AS reason FROM files f LEFT JOIN workflows w ON f.workflow_id = w.workflow_id) WHERE reason IS NOT NULL", "workflows", "files")(lambda w, f: workflows.orphan_files(w, f, F.expr(NOW)))
query("a11_take_handoff", "workflows files", f"SELECT f.workflow_id, f.file_id, f.name FROM files f JOIN workflows w ON f.workflow_id = w.workflow_id WHERE w.expires_at > {NOW} AND list_contains(w.file_refs, f.file_id)", "workflows", "files")(lambda w, f: workflows.take_handoff(w, f, F.expr(NOW)).select("workflow_id", "file_id", "name"))
query("a9_archive_manifest", "files", "SELECT archive, entry_no, name, size, CAST(coalesce(sum(30 + octet_length(encode(name)) + size) OVER (PARTITION BY archive ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT workflow_id AS archive, seq AS entry_no, name, size FROM files)", "files")(lambda d: workflows.archive_manifest(d.select(F.col("workflow_id").alias("archive"), F.col("seq").cast("long").alias("entry_no"), "name", "size")))
def _a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every workflow and its files, then a tenth of the workflows anew, each in one commit."""
    files, path = view(spark, sf_dir, "files"), new_folder(spark, "a10_replace_bundle")
    owners = files.groupBy("workflow_id").agg(F.count("*").alias("n"))
    workflows.replace_bundle(spark, path, owners, files.select("workflow_id", "file_id", "size"))
    tenth = "workflow_id % 10 = 1"
    workflows.replace_bundle(spark, path, owners.where(tenth).withColumn("n", F.lit(2).cast("long")), files.where(f"{tenth} and seq <= 2").select("workflow_id", "file_id", (F.col("size") + 1).alias("size")))
    version, now = queues.read_bundle(spark, path, {"files": files.select("workflow_id", "file_id", "size").schema, "workflows": owners.schema})
    return now["files"].join(now["workflows"], "workflow_id").withColumn("version", F.lit(version))


QUERIES["a10_replace_bundle"] = _a10
ORACLE["a10_replace_bundle"] = with_views("SELECT workflow_id, file_id, CASE WHEN workflow_id % 10 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN workflow_id % 10 = 1 THEN 2 ELSE count(*) OVER (PARTITION BY workflow_id) END AS n, 2 AS version FROM files WHERE workflow_id % 10 <> 1 OR seq <= 2", "files")
query("a10_upsert_bundle", "files", "SELECT workflow_id, file_id, size FROM files WHERE workflow_id % 10 <> 1 UNION ALL SELECT workflow_id, file_id, size + 1 FROM files WHERE workflow_id % 10 = 1 AND seq <= 2", "files")(lambda d: workflows.upsert_bundle(d.select("workflow_id", "file_id", "size"), d.where("workflow_id % 10 = 1 and seq <= 2").select("workflow_id", "file_id", (F.col("size") + 1).alias("size"))))
query("d5_page_totals", "files", "SELECT workflow_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY workflow_id", "files")(lambda d: workflows.page_totals(d, "workflow_id"))
query("d9_before_after", "files", "SELECT file_id, CAST(floor((1 - after / size) * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN floor((1 - after / size) * 100 + 0.5) <= 0 THEN 'did not shrink' END AS note FROM (SELECT file_id, CAST(size AS DOUBLE) size, CAST(size AS DOUBLE) * (file_id % 13) / 10 AS after FROM files)", "files")(lambda d: workflows.before_after(d.select("file_id", F.col("size").cast("double").alias("size"), (F.col("size").cast("double") * (F.col("file_id") % 13) / 10).alias("after")), "size", "after").select("file_id", "percent", "note"))
query("d10_status_rollup", "files", "SELECT *, bool_or(coalesce(status = 'queued', false)) OVER w AS has_queued, bool_or(coalesce(status = 'running', false)) OVER w AS has_running, bool_or(coalesce(status = 'success', false)) OVER w AS has_success FROM (SELECT workflow_id, status, count(*) AS n FROM files GROUP BY workflow_id, status UNION ALL SELECT workflow_id, NULL, count(*) FROM files GROUP BY workflow_id) WINDOW w AS (PARTITION BY workflow_id)", "files")(workflows.status_rollup)
query("d22_current_step", "files", "SELECT workflow_id, greatest(max(step), 0) AS step FROM files GROUP BY workflow_id", "files")(workflows.current_step)
query("e5_allocate_names", "files", "SELECT workflow_id, file_id, CASE WHEN k = 1 THEN name ELSE concat(regexp_replace(name, '\\.[^.]*$', ''), '-', k, regexp_extract(name, '(\\.[^.]*)$', 1)) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id, lower(name) ORDER BY seq) k FROM files)", "files")(lambda d: workflows.allocate_names(d).select("workflow_id", "file_id", "unique_name"))
query("e10_swap_neighbour", "files", "SELECT workflow_id, file_id, CAST(CASE WHEN seq = 6 THEN coalesce(after, seq) WHEN before = 6 THEN before ELSE seq END AS BIGINT) AS new_seq FROM (SELECT workflow_id, file_id, seq * 3 AS seq, lead(seq * 3) OVER w AS after, lag(seq * 3) OVER w AS before FROM files WHERE seq <> 3 WINDOW w AS (PARTITION BY workflow_id ORDER BY seq))", "files")(lambda d: workflows.swap_neighbour(d.where("seq <> 3").withColumn("seq", F.col("seq") * 3), F.col("seq") == 6, 1).select("workflow_id", "file_id", "new_seq"))
query("e12_latest_generation", "events", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")(lambda d: workflows.latest_generation(d.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id"))
query("e13_position_labels", "files", "SELECT workflow_id, file_id, row_number() OVER (PARTITION BY workflow_id ORDER BY seq) AS position, count(*) OVER (PARTITION BY workflow_id) AS total FROM files", "files")(lambda d: workflows.position_labels(d.select("workflow_id", "file_id", "seq"), "workflow_id", "seq").drop("seq"))
query("f2_search_top", "part", "SELECT p_partkey, matches, matches > 6 AS truncated FROM (SELECT p_partkey, count(*) OVER () AS matches FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'brand#2') ORDER BY p_partkey LIMIT 6)")(lambda d: workflows.search_top(d, "brand#2", "p_partkey", 6, "p_name", "p_brand").select("p_partkey", "matches", "truncated"))
query("f5_popular_first", "part", "SELECT p_partkey, p_brand, CAST(position AS BIGINT) AS position FROM part JOIN (VALUES ('Brand#3', 1), ('Brand#99', 2), ('Brand#1', 3)) v(name, position) ON p_brand = name")(lambda d: workflows.popular_first(d, "p_brand", ["Brand#3", "Brand#99", "Brand#1"]).select("p_partkey", "p_brand", "position"))
query("f6_bounded_list", "files", "SELECT workflow_id, file_id, total > 4 AS truncated FROM (SELECT workflow_id, file_id, row_number() OVER (PARTITION BY workflow_id ORDER BY seq) p, count(*) OVER (PARTITION BY workflow_id) total FROM files) WHERE p <= 4", "files")(lambda d: workflows.bounded_list(d, "workflow_id", "seq", 4).select("workflow_id", "file_id", "truncated"))
query("f7_next_queued", "files", "SELECT workflow_id, arg_min(file_id, seq) AS file_id FROM files WHERE status = 'queued' GROUP BY workflow_id", "files")(workflows.next_queued)
query("c4_lookup_translation", "dictionary", "SELECT d.locale, d.key, d.key AS english, CASE WHEN d.value <> '' THEN d.value ELSE d.key END AS text FROM dictionary d", "dictionary")(lambda d: workflows.lookup_translation(d.select("locale", "key", F.col("key").alias("english")), d))
query("c5_missing_keys", "dictionary", "SELECT l.locale, k.key FROM (SELECT DISTINCT key FROM dictionary) k CROSS JOIN (SELECT DISTINCT locale FROM dictionary) l WHERE NOT EXISTS (SELECT 1 FROM dictionary d WHERE d.value <> '' AND d.locale = l.locale AND d.key = k.key)", "dictionary")(lambda d: workflows.missing_keys(d, d, d.select("locale").distinct()).select("locale", "key"))
query("c6_add_missing", "dictionary", "SELECT locale, key, value FROM dictionary UNION ALL SELECT 'eo', key, concat('eo:', key) FROM (SELECT DISTINCT key FROM dictionary)", "dictionary")(lambda d: workflows.add_missing(d, d.select(F.lit("eo").alias("locale"), "key").distinct().withColumn("value", F.concat(F.lit("eo:"), F.col("key"))).unionByName(d.select("locale", "key", F.lit("never").alias("value")))))
query("c7_expand_locales", "part dictionary", "SELECT slug, locale, url, count(*) OVER (PARTITION BY slug) + 1 AS n_alternates, concat('https://example.org/', slug) AS x_default FROM (SELECT DISTINCT slug, locale, concat('https://example.org', CASE WHEN locale = 'en' THEN '' ELSE concat('/', locale) END, '/', slug) AS url FROM (SELECT DISTINCT lower(p_brand) slug FROM part WHERE p_brand <> 'Brand#1') CROSS JOIN (SELECT DISTINCT locale FROM dictionary UNION ALL SELECT 'en'))", "dictionary")(lambda p, d: workflows.expand_locales(p.select(F.lower("p_brand").alias("slug")).distinct(), d.select("locale").distinct().unionByName(d.select(F.lit("en").alias("locale")).distinct()), "https://example.org", p.where("p_brand = 'Brand#1'").select(F.lower("p_brand").alias("slug"))).select("slug", "locale", "url", F.size("alternates").cast("long").alias("n_alternates"), F.element_at("alternates", -1)["url"].alias("x_default")))
query("g2_same_keys", "dictionary", "SELECT key, 'extra' AS side FROM (SELECT key FROM dictionary WHERE locale = 'es' EXCEPT ALL SELECT key FROM dictionary WHERE locale = 'fr') UNION ALL SELECT key, 'missing' FROM (SELECT key FROM dictionary WHERE locale = 'fr' EXCEPT ALL SELECT key FROM dictionary WHERE locale = 'es')", "dictionary")(lambda d: workflows.same_keys(d.where("locale = 'es'").select("key"), d.where("locale = 'fr'").select("key")))
query("g5_toggle_set", "events", "SELECT user_id, event_id % 9 AS item FROM events GROUP BY ALL HAVING count(*) % 2 = 1")(lambda d: workflows.toggle_set(d.select("user_id", (F.col("event_id") % 9).alias("item")), "user_id", "item"))
query("g6_subset_check", "files", "SELECT workflow_id, list(status ORDER BY seq) = ['queued', 'success'] AS matches FROM files GROUP BY workflow_id", "files")(lambda d: workflows.matches_list(d, "workflow_id", "seq", "status", ["queued", "success"]))
RECIPES = {"smaller-shareable-secure": "compress-watermark-protect-v1", "reorder-and-number": "organize-page-numbers-v1", "remove-standard-metadata": "privacy-scan-cleanup-v1"}  # fixed values
_GOAL = "CASE event_id % 4 WHEN 0 THEN 'smaller-shareable-secure' WHEN 1 THEN 'reorder-and-number' WHEN 2 THEN 'remove-standard-metadata' ELSE 'other' END"
query("c14_recommend_recipe", "events", f"SELECT event_id, goal, CASE goal WHEN 'smaller-shareable-secure' THEN 'compress-watermark-protect-v1' WHEN 'reorder-and-number' THEN 'organize-page-numbers-v1' WHEN 'remove-standard-metadata' THEN 'privacy-scan-cleanup-v1' END AS recipe, goal <> 'other' AS known FROM (SELECT event_id, {_GOAL} AS goal FROM events)")(lambda d: workflows.recommend(d.select("event_id", F.expr(_GOAL).alias("goal")), RECIPES))
query("c9_changed_categories", "pages", "SELECT page_id, 'url' AS category FROM pages WHERE page_id % 10 = 0")(lambda d: workflows.changed_categories(d, d.withColumn("url", F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url"))).withColumn("html", F.lit("cleaned")), ["url", "html"], ["html"]))
query("k10_migration_check", "pages", "SELECT page_id FROM pages WHERE replace(html, '<b>', '<strong>') <> html")(lambda d: workflows.migration_check(d, "html", [("<b>", "<strong>")]).select("page_id"))
query("k11_replace_all", "pages", "SELECT page_id, replace(replace(html, '<b>', '<strong>'), '</b>', '</strong>') AS html FROM pages")(lambda d: workflows.replace_all(d, "html", [("<b>", "<strong>"), ("</b>", "</strong>")]).select("page_id", "html"))
query("k12_compose_copy", "dictionary", "SELECT locale, trim(concat_ws(' ', a, b)) AS value FROM (SELECT locale, max(value) FILTER (WHERE length(key) % 2 = 0) a, max(value) FILTER (WHERE length(key) % 2 = 1) b FROM dictionary GROUP BY locale)", "dictionary")(lambda d: workflows.compose_copy(d, F.length("key") % 2 == 0, F.length("key") % 2 == 1))
query("k17_budget_check", "lineitem", "SELECT route, bytes, requests FROM (SELECT route, sum(bytes) AS bytes FROM (SELECT DISTINCT l_suppkey AS route, l_partkey AS asset, CAST(l_extendedprice AS BIGINT) AS bytes FROM lineitem) GROUP BY route) JOIN (SELECT l_suppkey AS route, max(l_linenumber) AS requests FROM lineitem GROUP BY 1) USING (route) WHERE bytes >= 15000000 OR requests > 16")(lambda d: workflows.budget_check(d.select(F.col("l_suppkey").alias("route"), F.col("l_partkey").alias("asset"), F.rint("l_extendedprice").cast("long").alias("bytes"), F.col("l_linenumber").alias("requests")), 15_000_000))
query("k18_allowlist_check", "documents", "SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'unexpected' WHEN a.name IS NULL THEN 'missing' ELSE 'stale' END AS problem FROM (SELECT doc_id AS name, text FROM documents WHERE doc_id % 10 <> 0) a FULL JOIN (SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0) b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.text <> b.text")(lambda d: workflows.allowlist_check(d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("name"), F.col("text").alias("content")), d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("name"), F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END").alias("content"))))

# --- layout and Markdown

query("d6_median_size", "text_items", "SELECT doc_id, coalesce(nullif(median(font_size), 0), 10) AS body FROM text_items WHERE trim(str) <> '' GROUP BY doc_id", "text_items")(layout.body_size)
query("d7_upper_median", "text_items", "SELECT doc_id, page_no, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS size FROM text_items GROUP BY doc_id, page_no", "text_items")(layout.upper_median)
query("d18_text_stats", "text_items", "SELECT doc_id, page_no, count(*) FILTER (WHERE trim(str) <> '') AS n_items, CAST(sum(length(trim(str))) AS BIGINT) AS n_chars FROM text_items GROUP BY ALL", "text_items")(layout.text_stats)
query("d21_words_added", "doc_lines", "SELECT doc_id, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS words FROM doc_lines GROUP BY doc_id", "doc_lines")(lambda d: d.groupBy("doc_id").agg(C.words_added(F.col("line")).alias("words")))
query("f1_reading_order", "text_items", "SELECT doc_id, page_no, item_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, item_no) AS place FROM text_items", "text_items")(lambda d: layout.reading_order(d).select("doc_id", "page_no", "item_no", "place"))
query("c10_redact_pages", "text_items", "SELECT doc_id, page_no, item_no FROM text_items WHERE NOT (page_no = 1 AND doc_id % 3 = 0)", "text_items")(lambda d: layout.redact_pages(d, d.where("page_no = 1 and doc_id % 3 = 0").select("doc_id", "page_no")).select("doc_id", "page_no", "item_no"))
query("c11_items_in_rects", "text_items page_boxes", "SELECT DISTINCT i.doc_id, i.page_no, i.item_no FROM text_items i JOIN page_boxes b USING (doc_id, page_no) WHERE x < 300 AND x + width > 100 AND y < 700 AND y + font_size > 600 AND doc_id % 2 = 0", "text_items", "page_boxes")(lambda d, b: layout.items_in_rects(d, b.where("doc_id % 2 = 0").select("doc_id", "page_no", F.lit(300.0).alias("x1"), F.lit(100.0).alias("x2"), F.lit(600.0).alias("y1"), F.lit(700.0).alias("y2"))))
#: the line fold of layout.cluster_lines, one item a step: the items of a page in reading order, then the line each has come to
_FOLD = """items AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, item_no) AS i, contains(font_family, 'Bold') AS b, contains(font_family, 'Oblique') AS o FROM text_items WHERE trim(str) <> ''),
 fold AS (SELECT doc_id, page_no, i, item_no, x, y AS item_y, str, CAST(0 AS BIGINT) AS line_no, str AS text, y, x + width AS endx, font_size AS size, b AS bold, o AS italic FROM items WHERE i = 1
 UNION ALL SELECT doc_id, page_no, i, item_no, x, item_y, str, CASE WHEN joins THEN line_no ELSE line_no + 1 END, CASE WHEN joins THEN text || CASE WHEN x - endx > 0.28 * greatest(size, font_size) AND text NOT LIKE '% ' THEN ' ' ELSE '' END || str ELSE str END,
 CASE WHEN joins THEN y ELSE item_y END, x + width, CASE WHEN joins THEN greatest(size, font_size) ELSE font_size END, CASE WHEN joins THEN bold OR b ELSE b END, CASE WHEN joins THEN italic AND o ELSE o END
 FROM (SELECT n.*, f.line_no, f.text, f.y AS line_y, f.endx, f.size, f.bold, f.italic, abs(n.y - f.y) <= 0.4 * greatest(f.size, n.font_size) AS joins FROM fold f JOIN items n ON n.doc_id = f.doc_id AND n.page_no = f.page_no AND n.i = f.i + 1) AS t(doc_id, page_no, item_no, str, x, item_y, width, font_size, font_family, i, b, o, line_no, text, y, endx, size, bold, italic, joins))"""
_LINES = _FOLD + ", lines AS (SELECT doc_id, page_no, line_no, arg_max(text, i) AS text, any_value(y) AS y, arg_max(endx, i) AS endx, max(size) AS size, bool_or(bold) AS bold, arg_max(italic, i) AS italic FROM fold GROUP BY ALL)"
_GAPS = _LINES + ", gaps AS (SELECT * FROM (SELECT *, y - lead(y) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS gap FROM lines) WHERE trim(text) <> '')"
_PARAS = _GAPS + ", paras AS (SELECT * EXCLUDE (ends), coalesce(sum(ends) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph FROM (SELECT g.*, CAST(gap IS NULL OR gap > 1.6 * usual AS INT) AS ends FROM gaps g JOIN (SELECT doc_id, page_no, coalesce(median(gap) FILTER (WHERE gap > 0), 10) AS usual FROM gaps GROUP BY ALL) USING (doc_id, page_no)))"
_RENDERED = _PARAS + r""", kinds AS (SELECT *, CASE WHEN size / body >= 1.8 THEN 'heading1' WHEN size / body >= 1.5 THEN 'heading2' WHEN size / body >= 1.25 THEN 'heading3' WHEN size / body >= 1.1 THEN 'heading4' WHEN regexp_matches(trim(text), '^[-*•] +') THEN 'bullet' WHEN regexp_matches(trim(text), '^[0-9]{1,3}[.)] +') THEN 'ordered' ELSE 'paragraph' END AS kind
 FROM paras JOIN (SELECT doc_id, coalesce(nullif(median(font_size), 0), 10) AS body FROM text_items WHERE trim(str) <> '' GROUP BY doc_id) USING (doc_id)),
 bare AS (SELECT *, trim(regexp_replace(CASE kind WHEN 'bullet' THEN regexp_replace(trim(text), '^[-*•] +', '') WHEN 'ordered' THEN regexp_replace(trim(text), '^[0-9]{1,3}[.)] +', '') ELSE text END, '\s+', ' ', 'g')) AS t, CASE WHEN bold AND italic THEN '***' WHEN bold THEN '**' WHEN italic THEN '*' ELSE '' END AS mark FROM kinds),
 styled AS (SELECT *, CASE WHEN t = '' THEN t WHEN kind = 'paragraph' THEN mark || regexp_replace(t, '^([#\-*+>])', '\\\1') || mark WHEN kind LIKE 'heading%' THEN CASE WHEN italic THEN '*' || t || '*' ELSE t END ELSE mark || t || mark END AS s, sum(CASE WHEN kind = 'paragraph' AND was = 'paragraph' AND paragraph = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS block FROM (SELECT *, lag(kind) OVER w AS was, lag(paragraph) OVER w AS before FROM bare WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no))),
 blocks AS (SELECT doc_id, page_no, block, any_value(kind) AS kind, string_agg(s, ' ' ORDER BY line_no) AS s FROM styled GROUP BY ALL),
 runs AS (SELECT *, sum(CASE WHEN kind = was THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY block) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id, page_no ORDER BY block) AS was FROM blocks)),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, run ORDER BY block) AS n FROM runs)"""
_RENDER = "SELECT doc_id, page_no, ltrim(string_agg(CASE WHEN kind IN ('bullet', 'ordered') AND n > 1 THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN kind LIKE 'heading%' THEN repeat('#', CAST(kind[8:] AS INT)) || ' ' || s WHEN kind = 'bullet' THEN '- ' || s WHEN kind = 'ordered' THEN n || '. ' || s ELSE s END, '' ORDER BY block), chr(10)) AS text FROM numbered GROUP BY ALL"
query("h4_cluster_lines", "text_items", with_views("SELECT * FROM lines", "text_items", more=_LINES))(layout.cluster_lines)
query("e4_gap_to_next", "text_items", with_views("SELECT * FROM gaps", "text_items", more=_GAPS))(lambda d: layout.gap_to_next(layout.cluster_lines(d)))
query("e9_paragraph_break", "text_items", with_views("SELECT * FROM paras", "text_items", more=_PARAS))(lambda d: layout.paragraph_break(layout.gap_to_next(layout.cluster_lines(d))))
query("h5_render_markdown", "text_items", with_views(_RENDER, "text_items", more=_RENDERED))(lambda d: layout.render_markdown(layout.cluster_lines(d), layout.body_size(d)))
_COLUMNS = "SELECT doc_id, page_no, begins, row_number() OVER w AS column_no, lead(begins) OVER w AS ends FROM (SELECT DISTINCT doc_id, page_no, 0.0::DOUBLE AS begins FROM text_items UNION ALL SELECT doc_id, page_no, (x + before) / 2 FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id, page_no ORDER BY x) before FROM (SELECT DISTINCT doc_id, page_no, x FROM text_items)) JOIN (SELECT doc_id, page_no, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS size FROM text_items GROUP BY ALL) USING (doc_id, page_no) WHERE x - before > 2 * size) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY begins)"
query("e11_column_breaks", "text_items", _COLUMNS, "text_items")(layout.column_breaks)
_CELLS = "SELECT doc_id, page_no, line_no AS row_no, row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY x, item_y DESC, item_no) AS cell_no, x, item_no, str FROM fold"
query("h7_cluster_rows", "text_items", with_views(_CELLS, "text_items", more=_FOLD))(layout.cluster_rows)
query("h8_table_cells", "text_items", with_views("SELECT doc_id, page_no, row_no, column_no, trim(string_agg(str, ' ' ORDER BY cell_no)) AS value FROM cells JOIN columns USING (doc_id, page_no) WHERE (x >= begins OR column_no = 1) AND (ends IS NULL OR x < ends) GROUP BY ALL", "text_items", more=f"{_FOLD}, cells AS ({_CELLS}), columns AS ({_COLUMNS.replace('text_items', 'items')})"))(layout.table_cells)
_KIND = "CASE WHEN regexp_replace(line, '\\s+', '', 'g') = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*(?:-{3,}|\\*{3,}|_{3,})\\s*$') THEN 'rule' WHEN regexp_matches(line, '^#{1,4} +') THEN 'heading' WHEN regexp_matches(line, '^[-*+] +') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]{1,3}[.)] +') THEN 'ordered' ELSE 'text' END"
_BLOCKS = f"k AS (SELECT *, {_KIND} AS kind FROM md_lines), i AS (SELECT *, sum(CASE WHEN kind = 'text' AND p = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) island FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) p FROM k)), b AS (SELECT doc_id, island, any_value(kind) AS kind, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM i WHERE kind <> 'blank' GROUP BY doc_id, island), c AS (SELECT *, sum(CASE WHEN kind = 'ordered' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY island) cut FROM b)"
query("h3_parse_blocks", "md_lines", with_views("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS block_no, kind, CASE WHEN kind = 'heading' THEN CAST(length(regexp_extract(text, '^(#+)', 1)) AS INT) END AS level, CASE WHEN kind = 'ordered' THEN count(*) FILTER (WHERE kind = 'ordered') OVER (PARTITION BY doc_id, cut ORDER BY island) END AS item_index, CASE kind WHEN 'heading' THEN regexp_replace(text, '^#{1,4} +', '') WHEN 'bullet' THEN regexp_replace(text, '^[-*+] +', '') WHEN 'ordered' THEN regexp_replace(text, '^[0-9]{1,3}[.)] +', '') WHEN 'rule' THEN '' ELSE text END AS text FROM c", "md_lines").replace(") SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS block_no", f"), {_BLOCKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS block_no"))(layout.parse_blocks)
query("e14_list_groups", "md_lines", f"SELECT doc_id, kind, count(*) AS items, min(line_no) AS first_line FROM (SELECT *, sum(CASE WHEN kind = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) p FROM (SELECT *, {_KIND} AS kind FROM md_lines))) WHERE kind IN ('bullet', 'ordered') GROUP BY doc_id, run, kind", "md_lines")(layout.list_groups)
query("e7_ordered_index", "md_lines", f"SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, cut ORDER BY line_no) AS item_index FROM (SELECT *, sum(CASE WHEN kind = 'ordered' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS cut FROM (SELECT *, {_KIND} AS kind FROM md_lines) WHERE kind <> 'blank') WHERE kind = 'ordered'", "md_lines")(layout.ordered_index)
query("e8_paragraph_islands", "md_lines", f"SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM (SELECT *, sum(CASE WHEN kind = 'text' AND p = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM (SELECT *, {_KIND} AS kind FROM md_lines))) WHERE kind = 'text' GROUP BY doc_id, island", "md_lines")(layout.paragraph_islands)
_INLINE = layout.INLINE.replace("'", "''")
_RUNS = f"""SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) - 1 AS INT) AS run_no, text, style FROM (SELECT doc_id, line_no, 2 * j AS k, text, 'plain' AS style FROM md_lines, unnest(regexp_split_to_array(line, '{_INLINE}')) WITH ORDINALITY u(text, j)
 UNION ALL SELECT doc_id, line_no, 2 * j + 1, trim(m, '*`'), CASE WHEN m LIKE '***%' THEN 'bold-italic' WHEN m LIKE '**%' THEN 'bold' WHEN m LIKE '*%' THEN 'italic' ELSE 'code' END FROM md_lines, unnest(regexp_extract_all(line, '{_INLINE}')) WITH ORDINALITY v(m, j)) WHERE text <> ''"""
query("h2_parse_inline", "md_lines", _RUNS, "md_lines")(lambda d: d.select("doc_id", "line_no", F.posexplode(layout.parse_inline(F.col("line"))).alias("run_no", "r")).select("doc_id", "line_no", "run_no", "r.*"))
_DENSE = f"""{_FOLD}, cells AS ({_CELLS}), columns AS ({_COLUMNS.replace('text_items', 'items')}), vals AS (SELECT doc_id, page_no, row_no, column_no, trim(string_agg(str, ' ' ORDER BY cell_no)) AS value FROM cells JOIN columns USING (doc_id, page_no) WHERE (x >= begins OR column_no = 1) AND (ends IS NULL OR x < ends) GROUP BY ALL),
 width AS (SELECT doc_id, page_no, count(*) AS w FROM columns GROUP BY ALL), grid AS (SELECT doc_id, page_no, row_no, unnest(range(1, w + 1)) AS column_no FROM (SELECT DISTINCT doc_id, page_no, row_no FROM vals) JOIN width USING (doc_id, page_no)),
 sheet AS (SELECT doc_id, page_no, row_no, string_agg(coalesce(value, ''), '|' ORDER BY column_no) AS cells, count(*) AS n FROM grid LEFT JOIN vals USING (doc_id, page_no, row_no, column_no) GROUP BY ALL
 UNION ALL SELECT doc_id, page_no, 0, '', 1 FROM doc_pages ANTI JOIN vals USING (doc_id, page_no) UNION ALL SELECT doc_id, page_no, -1, '', 0 FROM doc_pages WHERE page_no > 1)"""
query("h8_dense_rows", "text_items doc_pages", with_views("SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, row_no) AS sheet_row, cells, n FROM sheet", "text_items", "doc_pages", more=_DENSE))(lambda i, p: layout.dense_rows(i, p).select("doc_id", "page_no", "sheet_row", F.array_join("cells", "|").alias("cells"), F.size("cells").cast("long").alias("n")))
query("h18_paginate", "md_lines")(lambda d: (lambda b: layout.paginate(layout.wrap_lines(b).join(b.select("doc_id", "block_no", "kind"), ["doc_id", "block_no"])))(layout.parse_blocks(d)))
query("h18_wrap_lines", "md_lines")(lambda d: layout.wrap_lines(layout.parse_blocks(d)))
query("h17_image_page_size", "page_boxes", "SELECT doc_id, page_no, media_w * (842 / greatest(media_w, media_h)) AS w, media_h * (842 / greatest(media_w, media_h)) AS h FROM page_boxes", "page_boxes")(lambda d: d.select("doc_id", "page_no", C.image_page_size(F.col("media_w"), F.col("media_h")).alias("s")).select("doc_id", "page_no", "s.*"))
query("h19_clip_cell", "part", "SELECT p_partkey, substring(p_name, 1, greatest(1, p_size % 9)) AS clipped FROM part")(lambda d: d.select("p_partkey", C.clip_cell(F.col("p_name"), F.col("p_size") % 9).alias("clipped")))
query("d17_column_count", "part", "SELECT max(len(string_split(p_name, ' '))) AS columns FROM part")(lambda d: d.agg(C.column_count(F.split("p_name", " ")).alias("columns")))

# --- web pages

_TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '')"
_META = lambda a, n: f"nullif(regexp_extract(regexp_extract(html, '(?i)(<meta\\b[^>]*\\b{a}=\"{n}\"[^>]*>)', 1), '(?i)\\bcontent=\"([^\"]*)\"', 1), '')"
query("h10_extract_meta", "pages", f"SELECT page_id, {_TITLE} AS title, coalesce({_META('name', 'description')}, {_META('property', 'og:description')}) AS description, coalesce({_META('name', 'twitter:title')}, {_META('property', 'og:title')}, {_TITLE}, '') AS twitter_title, coalesce({_META('name', 'twitter:description')}, {_META('property', 'og:description')}, {_META('name', 'description')}, '') AS twitter_description FROM pages")(web.extract_meta)
query("h12_rewrite_title", "pages", "SELECT page_id, html LIKE '%<title>%' AND page_id % 2 = 0 AS changed, CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '(?is)(<title[^>]*>).*?(</title>)', concat('\\1New ', page_id, '\\2')) ELSE html END AS html FROM pages")(lambda d: web.rewrite_title(d, d.where("page_id % 2 = 0").select("page_id", F.concat(F.lit("New "), F.col("page_id").cast("string")).alias("new_title"))).select("page_id", "changed", "html"))
query("h20_link_table", "pages", _LINKS)(web.link_table)
query("d19_distinct_hashes", "pages", "SELECT DISTINCT base64(unhex(sha256(s))) AS hash FROM (SELECT unnest(regexp_extract_all(html, '(?is)<script([^>]*)>(.*?)</script>', 1)) AS a, unnest(regexp_extract_all(html, '(?is)<script([^>]*)>(.*?)</script>', 2)) AS s FROM pages) WHERE trim(s) <> '' AND NOT regexp_matches(a, '(?i)\\bsrc\\b')")(web.inline_scripts)
query("h13_html_inspect", "pages", " UNION ALL ".join(f"SELECT page_id, '{c}' AS category, CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT) AS n FROM pages" for c, p in web.CATEGORIES.items()))(web.html_inspect)
_FIG = "SELECT page_id, figures, figures - described AS missing, has_lang, has_title FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<img\\b')) AS BIGINT) figures, CAST(len(regexp_extract_all(html, '(?i)<img\\b[^>]*\\salt=\"[^\"]+\"')) AS BIGINT) described, regexp_matches(html, '(?i)<html[^>]*\\slang=\"[^\"]+\"') AS has_lang, " + _TITLE + " IS NOT NULL AS has_title FROM pages)"
query("d14_figure_readiness", "pages", _FIG)(web.figure_readiness)
query("d3_page_readiness", "pages", f"SELECT page_id, least(figures, 100000) AS figures, least(missing, 100000) AS missing, has_lang, has_title, missing = 0 AND has_lang AND has_title AS ready FROM ({_FIG})")(web.doctor_summary)
query("d12_action_count", "pages", "SELECT page_id, CAST(len(regexp_extract_all(html, 'href=')) + len(regexp_extract_all(html, 'src=')) AS BIGINT) AS actions FROM pages")(lambda d: d.select("page_id", C.action_count(F.create_map(*[x for a in ("href", "src") for x in (F.lit(a), F.regexp_extract_all("html", F.lit(a + "="), F.lit(0)))])).alias("actions")))
query("d20_page_rules", "pages", f"SELECT page_id, array_to_string(list_filter([CASE WHEN missing > 0 THEN 'figures without text' END, CASE WHEN NOT has_lang THEN 'no language' END, CASE WHEN NOT has_title THEN 'no title' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ({_FIG})")(web.warnings)
query("k8_audit_pages", "pages", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT page_id, '{t}' AS rule, CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT) AS n FROM pages" for t, p in web.PARTS.items()) + """) WHERE n <> 1 UNION ALL SELECT page_id, 'json-ld', CAST(len(list_filter(regexp_extract_all(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1), lambda x: NOT json_valid(x))) AS BIGINT) AS n FROM pages WHERE n > 0""")(web.audit_pages)
_LD = """SELECT page_id, CAST(j - 1 AS INT) AS block_no, json_valid(json) AS valid, CASE WHEN json_valid(json) THEN json_extract_string(json, '$."@type"') END AS type FROM (SELECT page_id, html || '<script type="application/ld+json">' || CASE WHEN page_id % 3 = 0 THEN '{broken' ELSE '{"@type":"WebPage"}' END || '</script>' AS html FROM pages), unnest(regexp_extract_all(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1)) WITH ORDINALITY u(json, j)"""
query("h11_extract_jsonld", "pages", _LD)(lambda d: web.extract_jsonld(d.withColumn("html", F.concat("html", F.lit('<script type="application/ld+json">'), F.when(F.col("page_id") % 3 == 0, "{broken").otherwise('{"@type":"WebPage"}'), F.lit("</script>")))))
_GRAPH = """SELECT slug, '{"@context":"https://schema.org","@graph":[{"@type":"SoftwareApplication","name":' || to_json(name) || ',"url":"' || url || '"},{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"https://example.org"},{"@type":"ListItem","position":2,"name":' || to_json(name) || ',"item":"' || url || '"}]}]}' AS jsonld FROM (SELECT lower(p_name) AS slug, p_name AS name, 'https://example.org/' || lower(p_name) AS url FROM part)"""
query("h21_build_jsonld", "part", _GRAPH)(lambda d: web.build_jsonld(d.select(F.lower("p_name").alias("slug"), F.col("p_name").alias("name")), "https://example.org"))
query("a5_read_url_list", "pages", "SELECT url FROM pages WHERE url LIKE 'https://%'")(lambda d: web.read_url_list(d.select(F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>")).alias("text"))))
query("g4_duplicate_urls", "pages", "WITH u AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/?[^/]*') AS url FROM pages), h AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS value, count(*) AS n FROM u GROUP BY 1) SELECT 'duplicate' AS problem, url AS value, count(*) AS n FROM u GROUP BY url HAVING count(*) > 1 UNION ALL SELECT 'host', value, n FROM h WHERE (SELECT count(*) FROM h) > 1 UNION ALL SELECT 'count', NULL, count(*) FROM u HAVING count(*) NOT BETWEEN 1 AND 10000")(lambda d: web.check_url_list(d.select(F.regexp_extract("url", "^([a-z]+://[^/]+/?[^/]*)", 1).alias("url"))))
query("k13_set_block", "pages", "SELECT page_id, page_id % 2 = 0 AS matched, CASE WHEN page_id % 2 = 0 THEN concat('<head>', chr(10), '<!-- images -->', chr(10), html) ELSE html END AS html FROM pages")(lambda d: web.set_block(d.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<head>\n<meta property="og:image" content="a">\n <meta property="og:image:width" content="b">\n'), F.col("html"))).otherwise(F.col("html"))), "<!-- images -->\n").select("page_id", "matched", "html"))
query("h9_html_to_markdown", "pages")(web.html_to_markdown)
query("h14_html_diagnose", "pages")(lambda d: diagnosis.html_diagnose(d).drop("locations", "error"))
query("h14_part_errors", "pages")(lambda d: diagnosis.part_errors(d.withColumn("html", F.concat("html", F.when(F.col("page_id") % 2 == 0, "<div><b>open<i>crossed</b></i>").otherwise("</span>")))))
_COUNTED = lambda p: f"CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT)"
_OPENED, _CLOSED, _BOXED, _SIGNED = "<[a-z][^>]*>", "</[a-z][^>]*>", '(?i)\\swidth="0"', "(?i)track"
#: the columns of a report, from what patterns count in a page
_REPORTED = f"""SELECT page_id, opened = closed AS strict, opened > 0 AS tolerant, closed AS strict_count, opened AS tolerant_count, greatest(opened - closed, 0) AS unclosed, greatest(closed - opened, 0) AS stray, page_id % 2 AS crossed, boxes, signed % 2 AS signatures,
 figures, missing, has_lang, has_title, opened % 3 AS parts, page_id % 5 AS errors, opened > 30 AS truncated FROM (SELECT *, {_COUNTED(_OPENED)} AS opened, {_COUNTED(_CLOSED)} AS closed, {_COUNTED(_BOXED)} AS boxes, {_COUNTED(_SIGNED)} AS signed FROM pages) JOIN ({_FIG}) USING (page_id)"""


def _reports(d: DataFrame) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    seen = d.join(web.figure_readiness(d), "page_id").withColumns({"opened": n(_OPENED), "closed": n(_CLOSED), "boxes": n(_BOXED), "signatures": n(_SIGNED) % 2, "crossed": F.col("page_id") % 2, "errors": F.col("page_id") % 5})
    return seen.withColumns({"strict": F.expr("opened = closed"), "tolerant": F.expr("opened > 0"), "strict_count": F.col("closed"), "tolerant_count": F.col("opened"), "unclosed": F.expr("greatest(opened - closed, 0)"), "stray": F.expr("greatest(closed - opened, 0)"), "parts": F.expr("opened % 3"), "truncated": F.expr("opened > 30")})


_WARNED = "list_filter([CASE WHEN tolerant AND NOT strict THEN 'tolerant parse only' END, CASE WHEN strict_count = 0 OR strict_count <> tolerant_count THEN 'counts differ' END, CASE WHEN boxes > 0 THEN 'box without a size' END, CASE WHEN signatures > 0 THEN 'signature field' END, CASE WHEN errors > 0 THEN 'parts not inspected' END, CASE WHEN truncated THEN 'graph truncated' END], lambda x: x IS NOT NULL)"
query("d20_warnings", "pages", f"SELECT page_id, array_to_string({_WARNED}, '; ') AS warnings FROM ({_REPORTED})")(lambda d: diagnosis.warnings(_reports(d)))
query("d3_doctor_summary", "pages", f"SELECT page_id, strict, tolerant, has_lang, has_title, truncated, strict_count, tolerant_count, unclosed, stray, crossed, boxes, signatures, figures, missing, parts, errors, CAST(len({_WARNED}) AS BIGINT) AS n_warnings, missing = 0 AND has_lang AND has_title AS ready FROM ({_REPORTED})")(lambda d: diagnosis.doctor_summary(_reports(d)))
_PAGES_FOUND = _FOUND.replace("FROM documents", "FROM (SELECT page_id AS doc_id, html AS text FROM pages)")
query("d2_privacy_counts", "pages", f"""WITH {_PAGES_FOUND}, k AS (SELECT doc_id AS page_id, sum(n) AS total, string_agg(category || '=' || n, ',' ORDER BY category) AS kinds FROM (SELECT doc_id, category, count(*) AS n FROM found GROUP BY ALL) GROUP BY doc_id),
 c AS (SELECT page_id, regexp_matches(html, '{diagnosis.ENCRYPTED}') AS encrypted, regexp_matches(html, '{diagnosis.LOCKED}') AS locked, {', '.join(f"{_COUNTED(p)} AS {k}" for k, p in diagnosis.PRIVACY.items())} FROM pages)
 SELECT page_id, encrypted, locked, {', '.join(f"CASE WHEN locked THEN 0 ELSE {f'least({k}, 1)' if k == 'xmp' else k} END AS {k}" for k in diagnosis.PRIVACY)}, CAST(CASE WHEN locked THEN 0 ELSE least(coalesce(total, 0), 100) END AS BIGINT) AS sensitive,
 CASE WHEN locked THEN '' ELSE coalesce(kinds, '') END AS by_category, NOT locked AND coalesce(total, 0) >= 100 AS truncated, CAST(encrypted AS BIGINT) + CAST(locked AS BIGINT) AS n_warnings FROM c LEFT JOIN k USING (page_id)""")(diagnosis.privacy_summary)
_OLD_LD = '{"@context":"c","@graph":[{"@type":"WebPage","n":1},{"@type":"SoftwareApplication","name":"old","offers":{"price":1.5,"tags":[1,"2",null]}},{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"a"},{"position":2,"name":"b","item":"x"}]}],"more":true}'
_OLD_META = '<meta property="og:title" content="old"><meta content="old" name="description">'


def _with_graph(d: DataFrame) -> DataFrame:
    return d.withColumn("html", F.concat(F.lit(f'{_OLD_META}<script type="application/ld+json">'), F.when(F.col("page_id") % 5 == 0, "{broken").otherwise(_OLD_LD), F.lit("</script>"), "html"))


def _h12(d: DataFrame) -> DataFrame:
    of = lambda t: F.concat(F.lit(t + " "), F.col("page_id").cast("string"))
    values = d.select("page_id", F.concat(of("T"), F.lit(' "q" & $1')).alias("title"), F.when(F.col("page_id") % 3 > 0, of("D")).alias("description"), of("App").alias("json_name"), of("About").alias("json_description"), of("Here").alias("crumb_name"), F.lit("Home").alias("home_name"), F.concat(F.lit("https://e.org/"), F.col("page_id").cast("string")).alias("url"), F.lit("https://e.org/").alias("home_url"))
    new = web.rewrite_meta(_with_graph(d), values)
    block = F.regexp_extract("html", r"(?s)<script type=.application/ld.json.>(.*?)</script>", 1)
    json = lambda p: F.get_json_object("block", "$['@graph']" + p)
    return new.withColumn("block", block).select("page_id", "changed", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", 'og:title" content="([^"]*)"', 1).alias("og_title"), F.regexp_extract("html", 'content="([^"]*)" name="description"', 1).alias("description"), json("[1].name").alias("name"), json("[1].url").alias("url"), json("[1].offers.tags[1]").alias("tag"), json("[0].n").alias("other"), json("[2].itemListElement[0].item").alias("home"), json("[2].itemListElement[1].name").alias("crumb"), F.get_json_object("block", "$.more").alias("more"))


query("h12_rewrite_meta", "pages", """SELECT page_id, c AS changed, CASE WHEN c THEN 'T ' || page_id || ' &quot;q&quot; &amp; $1' ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS title, CASE WHEN c THEN 'T ' || page_id || ' &quot;q&quot; &amp; $1' ELSE 'old' END AS og_title,
 CASE WHEN c THEN 'D ' || page_id ELSE 'old' END AS description, CASE WHEN ok THEN CASE WHEN c THEN 'App ' || page_id ELSE 'old' END END AS name, CASE WHEN ok AND c THEN 'https://e.org/' || page_id END AS url, CASE WHEN ok THEN '2' END AS tag, CASE WHEN ok THEN '1' END AS other,
 CASE WHEN ok AND c THEN 'https://e.org/' END AS home, CASE WHEN ok THEN CASE WHEN c THEN 'Here ' || page_id ELSE 'b' END END AS crumb, CASE WHEN ok THEN 'true' END AS more FROM (SELECT *, page_id % 3 > 0 AS c, page_id % 5 > 0 AS ok FROM pages)""")(_h12)
_GRAPH_FAQ = _GRAPH.replace("""]}]}' AS jsonld FROM""", """]}' || CASE WHEN length(name) % 2 = 0 THEN ',{"@type":"FAQPage","mainEntity":[' || length(name) || ']}' ELSE '' END || ']}' AS jsonld FROM""")
query("h21_faq_carried", "part", _GRAPH_FAQ)(lambda d: web.build_jsonld(d.select(F.lower("p_name").alias("slug"), F.col("p_name").alias("name"), F.when(F.length("p_name") % 2 == 0, F.concat(F.lit('{"@type":"FAQPage","mainEntity":['), F.length("p_name").cast("string"), F.lit("]}"))).alias("faq")), "https://example.org"))
query("a7_page_source", "pages", "SELECT page_id, url, nullif(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '') AS name, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS content FROM pages")(lambda d: web.page_source(d).withColumn("content", F.sha2("content", 256)))

# --- sources and sinks: written to the shared folder and read back


def _written(name: str) -> Callable:
    def register(f: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, new_folder(spark, name))
        return f

    return register


@_written("a3_read_text_docs")
def _a3(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    sources.write_text_docs(view(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), "text"), folder)
    return sources.read_text_docs(spark, folder).select("text")


ORACLE["a3_read_text_docs"] = "SELECT text || chr(10) AS text FROM benchmark"


@_written("a8_write_text_docs")
def _a8(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    sources.write_text_docs(view(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text"), folder)
    return sources.read_written_docs(spark, folder)


ORACLE["a8_write_text_docs"] = "SELECT 'doc' || doc_id || '.md' AS name, coalesce(text, '') AS text FROM documents"


@_written("a1_scan_files")
def _a1(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A file for each source and language of the documents, some of another kind: a row for each that is read, and how many are skipped."""
    docs = view(spark, sf_dir, "documents").select(F.concat(F.lit("%PDF-1.7 "), F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")).alias("value"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    text = docs.where("lang in ('en', 'de')")
    text.repartition("source", "lang").write.partitionBy("source", "lang").text(folder)
    docs.where("lang not in ('en', 'de')").repartition("source", "lang").write.mode("append").partitionBy("source", "lang").json(folder)
    found, skipped = sources.scan_files(spark, folder, ["text"])
    place = F.concat_ws("/", *[F.regexp_extract("path", f"/{k}=([^/]*)/", 1) for k in ("source", "lang")]).alias("place")
    told = found.select(place, "kind", sources.check_magic(F.col("content")).alias("detected"))
    return told.unionByName(skipped.select(F.col("extension").alias("place"), F.lit("skipped").alias("kind"), F.col("n").cast("string").alias("detected")))


ORACLE["a1_scan_files"] = "WITH f AS (SELECT DISTINCT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang FROM documents) SELECT source || '/' || lang AS place, 'text' AS kind, 'pdf' AS detected FROM f WHERE lang IN ('en', 'de') UNION ALL SELECT 'json', 'skipped', CAST(count(*) AS VARCHAR) FROM f WHERE lang NOT IN ('en', 'de')"


@_written("a4_read_sheet_rows")
def _a4(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    view(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("b")).write.csv(folder, escape='"')
    return sources.read_sheet_rows(spark, folder, ["a", "b", "c"])


ORACLE["a4_read_sheet_rows"] = "SELECT CAST(p_partkey AS VARCHAR) AS a, p_name AS b, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS c FROM part"



@_written("a4_ragged_rows")
def _a4_ragged(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    cells = F.array(F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit(', and ""more"""')), F.col("p_brand"), F.lit(""), F.lit("last"))
    view(spark, sf_dir, "part").select(F.array_join(F.slice(cells, F.lit(1), F.col("p_size") % 5 + 1), ",")).write.text(folder)
    return sources.read_sheet_rows(spark, folder)


ORACLE["a4_ragged_rows"] = "SELECT CAST(p_partkey AS VARCHAR) AS c1, CASE WHEN n > 1 THEN p_name || ', and \"more\"' ELSE '' END AS c2, CASE WHEN n > 2 THEN p_brand ELSE '' END AS c3, '' AS c4, CASE WHEN n > 4 THEN 'last' ELSE '' END AS c5 FROM (SELECT *, p_size % 5 + 1 AS n FROM part)"

query("a6_read_dictionary", "part", "SELECT DISTINCT p_brand AS locale, p_type AS key, p_type AS value FROM part")(lambda d: sources.read_dictionary(d.select(F.to_json(F.create_map(F.col("p_brand"), F.create_map(F.col("p_type"), F.col("p_type")))).alias("text"))).distinct())
query("a2_check_magic", "documents", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' END AS kind FROM documents")(lambda d: d.select("doc_id", sources.check_magic(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-").cast("binary"), F.col("text").cast("binary"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("89504E470D0A"))).otherwise(F.col("text").cast("binary"))).alias("kind")))

# --- queues and streams

_MOVED = "CASE op || ':' || state " + " ".join(f"WHEN '{op}:{a}' THEN '{b}'" for op, m in queues.MOVES.items() for a, b in m.items()) + " END"
_STATES = f"""e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY workflow_id, item_id ORDER BY seq) AS i FROM queue_events),
 s AS (SELECT DISTINCT workflow_id, item_id, CAST(0 AS BIGINT) AS i, '' AS state, CAST(0 AS BIGINT) AS moves FROM e
 UNION ALL SELECT workflow_id, item_id, i, coalesce(moved, state), moves + CASE WHEN moved IS NULL THEN 0 ELSE 1 END FROM (SELECT e.workflow_id, e.item_id, e.i, state, moves, {_MOVED} AS moved FROM s JOIN e ON e.workflow_id = s.workflow_id AND e.item_id = s.item_id AND e.i = s.i + 1))"""
query("i1_queue_state", "queue_events", with_views("SELECT workflow_id, item_id, arg_max(state, i) AS state, max(moves) AS moves FROM s GROUP BY ALL", "queue_events", more=_STATES))(queues.queue_state)
query("i2_expire_state", "files", f"SELECT file_id, coalesce(expires_at, updated_at + INTERVAL 1 DAY) > {NOW} AS alive FROM files", "files")(lambda d: queues.expire_state(d, F.expr(NOW)).select("file_id", "alive"))
query("i3_drop_stale", "events", "SELECT event_id, user_id FROM (SELECT *, max(g) OVER (PARTITION BY user_id ORDER BY event_id) m FROM (SELECT event_id, user_id, event_id % 17 AS g FROM events)) WHERE g = m")(lambda d: queues.drop_stale(d.select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 17).alias("g")), "user_id", "g").select(F.col("seq").alias("event_id"), "user_id"))
query("i4_reserve_quota", "files", "WITH RECURSIVE files AS (SELECT o_custkey workflow_id, o_orderkey file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) seq, CAST(floor(o_totalprice * 1000) AS BIGINT) size FROM orders), r AS (SELECT workflow_id, CAST(0 AS BIGINT) AS seq, 0 AS n, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS file_id FROM files WHERE seq = 1 UNION ALL SELECT f.workflow_id, f.seq, r.n + CASE WHEN r.n < 5 AND r.bytes + f.size <= 400000000 THEN 1 ELSE 0 END, r.bytes + CASE WHEN r.n < 5 AND r.bytes + f.size <= 400000000 THEN f.size ELSE 0 END, CASE WHEN r.n < 5 AND r.bytes + f.size <= 400000000 THEN f.file_id END FROM r JOIN files f ON f.workflow_id = r.workflow_id AND f.seq = r.seq + 1) SELECT workflow_id, file_id FROM r WHERE file_id IS NOT NULL")(lambda d: queues.reserve_quota(d, 5, 400_000_000))
query("i5_progress_windows", "events", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS begins, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")(queues.progress_windows)
query("i5_sliding_windows", "events", "SELECT begins, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS begins, event_type FROM events, (VALUES (0), (1)) w(k)) GROUP BY 1")(lambda d: queues.progress_windows(d, slide="30 minutes"))
query("i5_sessions", "events", "SELECT user_id, min(ts) AS begins, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT *, sum(CASE WHEN ts < was + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)) GROUP BY user_id, s")(lambda d: queues.progress_sessions(d, "user_id"))
query("i5_percent", "doc_pages", "SELECT doc_id, max(CAST(floor(100.0::DOUBLE * page_no / page_count + 0.5) AS BIGINT)) AS percent FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) + 2 AS page_count FROM doc_pages) GROUP BY doc_id", "doc_pages")(lambda d: queues.progress_percent(d.select("doc_id", F.col("page_no").alias("page"), (F.count("*").over(Window.partitionBy("doc_id")) + 2).alias("page_count")), "doc_id"))
query("i6_debounce", "events", "SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR after > ts + INTERVAL 10 MINUTE")(lambda d: queues.debounce(d, "10 MINUTES", "user_id").select("event_id"))
query("i7_restore", "files", "SELECT file_id, status, greatest(0, least(2, step)) AS step FROM files", "files")(lambda d: queues.restore(d, 2).select("file_id", "status", "step"))


@_written("i9_stream_scan")
def _i9(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    schema = view(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may name a file or a folder
    return queues.run_available(scans.scan_sensitive(stream).select("doc_id", "category", "match"), spark, folder)


ORACLE["i9_stream_scan"] = f"WITH {_FOUND} SELECT doc_id, category, substring(match, 1, 120) AS match FROM found"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(view(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@_written("i9_category_counts")
def _i9_counts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Findings by document and category as a running aggregation, through the idempotent sink."""
    return queues.run_updates(scans.category_counts(scans.scan_sensitive(_stream(spark, sf_dir, "documents"))), spark, folder, "doc_id", "category")


ORACLE["i9_category_counts"] = f"WITH {_FOUND} SELECT doc_id, category, count(*) AS n FROM found GROUP BY ALL"


@_written("i6_debounce_stream")
def _i6(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    return queues.run_available(queues.debounce_stream(_stream(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), "10 MINUTES", "user_id"), spark, folder).select("event_id")


# a burst is told once the newest event of all is past its end
ORACLE["i6_debounce_stream"] = "SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE (after IS NULL OR after > ts + INTERVAL 10 MINUTE) AND ts + INTERVAL 10 MINUTE < (SELECT max(ts) FROM events)"


@_written("i2_expire_stream")
def _i2(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Sign-ups and purchases write the record of their user, all other events read it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    op = F.when(F.coalesce("event_type", F.lit("")).isin("signup", "purchase"), "write").otherwise("read")
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("value"))
    out = queues.run_available(queues.expire_stream(events, hours=6), spark, folder)
    return out.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


ORACLE["i2_expire_stream"] = """WITH e AS (SELECT user_id AS key, ts, event_id, coalesce(event_type, '') IN ('signup', 'purchase') AS w FROM events),
 l AS (SELECT *, last_value(CASE WHEN w THEN event_id END IGNORE NULLS) OVER o AS v, last_value(CASE WHEN w THEN ts END IGNORE NULLS) OVER o AS since FROM e WINDOW o AS (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT key, ts, CASE WHEN ts < since + INTERVAL 6 HOUR THEN CAST(v AS VARCHAR) END AS value FROM l WHERE NOT w"""


@_written("i8_idempotent_sink")
def _i8(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    sink, orders = queues.idempotent_sink(folder), view(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for batch in (0, 1, 1):  # the second batch runs twice
        sink(orders.where(F.col("o_orderkey") % 2 == batch), batch)
    return queues.current(spark, folder, orders.schema)


ORACLE["i8_idempotent_sink"] = "SELECT o_orderkey, o_orderstatus FROM orders"

# --- recipes

query("j2_run_recipe", "doc_pages", "SELECT doc_id, src_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC) AS page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC) + 2 AS number, count(*) OVER (PARTITION BY doc_id) + 2 AS total FROM doc_pages", "doc_pages")(lambda d: recipes.run_recipe(d.select("doc_id", "page_no", "src_index"), ["organize-pages-v1", "page-numbers-v1"], {"page-numbers-v1": {"start": 3}}))
query("k4_loss_manifest", "documents", "SELECT doc_id, s.* FROM documents, (VALUES (0, 'organize-pages-v1', 'changes the reading order'), (1, 'page-numbers-v1', 'adds numbers to every page')) s(step_no, step, loss)")(lambda d: recipes.loss_manifest(d.select("doc_id"), ["organize-pages-v1", "page-numbers-v1"]))


@_written("k3_clean_and_verify")
def _k3(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents")
    report = recipes.clean_and_verify(docs, ["lang", "source"], folder)
    return queues.current(spark, folder, docs.schema).join(report, "doc_id").select("doc_id", "lang", "source", "ok")


ORACLE["k3_clean_and_verify"] = "SELECT doc_id, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS source, true AS ok FROM documents"


@_written("k7_rebuild")
def _k7(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    parts = view(spark, sf_dir, "doc_pages")
    report = recipes.rebuild(parts, ["text"], folder)
    return queues.current(spark, folder, parts.select("doc_id", "page_no", "text").schema).join(report, "doc_id").select("doc_id", "page_no", "text", F.col("ok").alias("verified"))


ORACLE["k7_rebuild"] = with_views("SELECT doc_id, page_no, text, true AS verified FROM doc_pages", "doc_pages")


@_written("k6_normalize_pages")
def _k6(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    return recipes.normalize_pages(view(spark, sf_dir, "pages"), folder)


@_written("j2_step_reports")
def _j2(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    parts = view(spark, sf_dir, "doc_pages").select("doc_id", "page_no", "src_index")
    return recipes.run_reported(parts, ["organize-pages-v1", "page-numbers-v1"], folder, "corpus/all.parquet", {"page-numbers-v1": {"start": 3}})[1]


ORACLE["j2_step_reports"] = with_views("SELECT 0 AS step_no, 'organize-pages-v1' AS step, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM doc_pages UNION ALL SELECT 1, 'page-numbers-v1', 'rows', count(*) FROM doc_pages UNION ALL SELECT 1, 'page-numbers-v1', 'last_number', max(page_no) + 2 FROM doc_pages", "doc_pages")
query("k4_manifest", "documents", "SELECT doc_id, s.* FROM documents, (VALUES (0, 'organize-pages-v1', 'change', 'puts the pages into another order'), (0, 'organize-pages-v1', 'loss', 'changes the reading order'), (1, 'metadata-cleanup-v1', 'change', 'standard fields become empty'), (1, 'metadata-cleanup-v1', 'loss', 'clears standard fields only'), (1, 'metadata-cleanup-v1', 'risk', 'what the text itself tells stays')) s(step_no, step, kind, text)")(lambda d: recipes.manifest(d.select("doc_id"), ["organize-pages-v1", "metadata-cleanup-v1"]))
query("i7_restore_parameters", "events", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN given BETWEEN 1 AND 100000 THEN CAST(given AS VARCHAR) ELSE '1' END WHEN 1 THEN CASE WHEN event_type = 'view' THEN 'keep' ELSE 'reverse' END END AS value, event_id % 3 < 2 AS one FROM (SELECT event_id, event_type, user_id * event_id % 150 * 1000 - 2000 AS given FROM events)""")(
    lambda d: queues.restore_parameters(d.select("event_id", F.expr("CASE event_id % 3 WHEN 0 THEN 'page-numbers-v1' WHEN 1 THEN 'organize-pages-v1' ELSE 'other-v1' END").alias("step"), F.expr("CASE event_id % 3 WHEN 0 THEN map('start', CAST(user_id * event_id % 150 * 1000 - 2000 AS STRING), 'password', 'x') WHEN 1 THEN map('order', CASE event_type WHEN 'view' THEN 'keep' ELSE event_type END) ELSE map('a', 'b') END").alias("params"))).select("event_id", F.get(F.map_values("params"), F.lit(0)).alias("value"), (F.size("params") == 1).alias("one")))

_SPACES = "[" + recipes.SPACES + "]"
query("k6_normalize", "documents", rf"SELECT doc_id, normal, trim(regexp_replace(text, '[\s{recipes.SPACES}]+', ' ', 'g')) = trim(regexp_replace(normal, '[\s{recipes.SPACES}]+', ' ', 'g')) AS accepted FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{_SPACES}', ' ', 'g'), '(?m)[ \t]+$', '', 'g') AS normal FROM documents)")(recipes.normalize)
_STEP = "CASE event_id % 4 WHEN 0 THEN 'page-numbers-v1' WHEN 1 THEN 'organize-pages-v1' WHEN 2 THEN 'metadata-cleanup-v1' ELSE 'other-v1' END"
query("j1_registered_steps", "events", f"SELECT event_id, step, step <> 'other-v1' AS known, CASE step WHEN 'page-numbers-v1' THEN 'adds numbers to every page' WHEN 'organize-pages-v1' THEN 'changes the reading order' WHEN 'metadata-cleanup-v1' THEN 'clears standard fields only' END AS loss FROM (SELECT event_id, {_STEP} AS step FROM events)")(lambda d: recipes.describe_steps(d.select("event_id", F.expr(_STEP).alias("step"))))
_ASKED = "CASE event_id % 4 WHEN 0 THEN map('start', CAST(user_id * event_id % 150 * 1000 - 2000 AS STRING)) WHEN 1 THEN map('order', event_type) WHEN 2 THEN map('start', '1') END"
query("k1_check_params", "events", f"""SELECT event_id, step, CASE WHEN step = 'other-v1' THEN 'unknown step' WHEN step = 'metadata-cleanup-v1' THEN 'unknown parameter' WHEN step = 'organize-pages-v1' AND given <> 'reverse' AND given <> 'keep' THEN 'invalid order' WHEN step = 'page-numbers-v1' AND CAST(given AS BIGINT) NOT BETWEEN 1 AND 100000 THEN 'invalid start' END AS problem,
 CASE WHEN step = 'organize-pages-v1' THEN given END AS "order", CASE WHEN step IN ('page-numbers-v1', 'metadata-cleanup-v1') THEN given END AS start
 FROM (SELECT event_id, {_STEP} AS step, CASE event_id % 4 WHEN 0 THEN CAST(user_id * event_id % 150 * 1000 - 2000 AS VARCHAR) WHEN 1 THEN CASE event_type WHEN 'view' THEN 'keep' WHEN 'error' THEN 'reverse' ELSE coalesce(event_type, 'reverse') END WHEN 2 THEN '1' END AS given FROM events)""")(lambda d: recipes.check_params(d.replace({"view": "keep", "error": "reverse"}, subset=["event_type"]).select("event_id", F.expr(_STEP).alias("step"), F.expr(_ASKED).alias("params"))).select("event_id", "step", "problem", F.try_element_at("params", F.lit("order")).alias("order"), F.try_element_at("params", F.lit("start")).alias("start")))
query("k16_stamp_ttl", "files", f"SELECT file_id, updated_at AS created_at, {NOW} AS updated_at, coalesce(expires_at, {NOW} + INTERVAL 1 DAY) AS expires_at, 1 AS version FROM files", "files")(lambda d: workflows.stamp_ttl(d.withColumn("created_at", F.col("updated_at")), F.expr(NOW)).select("file_id", "created_at", "updated_at", "expires_at", "version"))
query("j6_merge_v1", "conversations", "SELECT conv_id, turn AS page_no, input_no, row_number() OVER (PARTITION BY conv_id ORDER BY input_no, turn) AS new_page FROM (SELECT *, max(input_no) OVER (PARTITION BY conv_id) > min(input_no) OVER (PARTITION BY conv_id) AS several FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS input_no FROM conversations)) WHERE several")(lambda d: recipes.merge_v1([d.where(r).select("conv_id", F.col("turn").alias("page_no")) for r in ("coalesce(role <> 'assistant', true)", "role = 'assistant'")], "conv_id"))


def _sql(name: str, text: str, needs: str, sql: str | None = None, *views: str) -> None:
    """A query in SQL that uses the package's own functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        recipes.register_sql(spark)
        for n in needs.split():
            view(spark, sf_dir, n)
        return spark.sql(text)

    QUERIES[name] = run
    if sql:
        ORACLE[name] = with_views(sql, *views)


_sql("j3_blocks", "SELECT doc_id, b.* FROM md_docs, LATERAL blocks(text) b", "md_docs", ORACLE["h3_parse_blocks"])
_sql("j4_html_markdown", "SELECT page_id, html_markdown(html) AS markdown FROM pages", "pages")
_sql("j5_size_estimate", "SELECT doc_id, CAST(floor(size_estimate(page_no, CAST(length(text) AS DOUBLE)) + 0.5) AS BIGINT) AS estimate FROM doc_pages GROUP BY doc_id", "doc_pages", "SELECT doc_id, CAST(floor(CASE WHEN max(n) <= 5 THEN sum(size) ELSE sum(size) FILTER (WHERE page_no = 1) + avg(size) FILTER (WHERE page_no > 1) * (max(n) - 1) END + 300 * max(n) + 1000 + 0.5) AS BIGINT) AS estimate FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) n FROM (SELECT doc_id, page_no, CAST(length(text) AS BIGINT) AS size FROM doc_pages)) WHERE n <= 5 OR page_no IN (1, 1 + floor((n-1)/4.0 + 0.5), 1 + floor(2*(n-1)/4.0 + 0.5), 1 + floor(3*(n-1)/4.0 + 0.5), n) GROUP BY doc_id", "doc_pages")
query("c12_fill_form", "part", "SELECT p_partkey AS name, CASE p_size % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'dropdown' WHEN 2 THEN 'radio' ELSE 'signature' END AS kind, CASE WHEN p_size % 4 = 3 THEN 'unknown kind' WHEN p_partkey % 5 = 0 THEN 'empty' WHEN p_size % 4 = 0 OR p_brand IN ('Brand#1', 'Brand#2') THEN 'filled' ELSE 'rejected' END AS state, CASE WHEN p_size % 4 <> 3 AND p_partkey % 5 <> 0 AND (p_size % 4 = 0 OR p_brand IN ('Brand#1', 'Brand#2')) THEN p_brand END AS filled FROM part")(lambda d: workflows.fill_form(d.select(F.col("p_partkey").alias("name"), F.expr("CASE p_size % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'dropdown' WHEN 2 THEN 'radio' ELSE 'signature' END").alias("kind"), F.array(F.lit("Brand#1"), F.lit("Brand#2")).alias("options")), d.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("value"))))
