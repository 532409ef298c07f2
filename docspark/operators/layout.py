"""From positioned text and Markdown to lines, blocks and tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.columns import classify_line, escape_leading_token, squeezed, wrap_emphasis

PAGE = ["doc_id", "page_no"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # functions travel to tasks whole, so workers need no docspark


def text_stats(items: DataFrame) -> DataFrame:
    t = F.trim("str")
    return items.groupBy(*PAGE).agg(F.count_if(t != "").alias("n_items"), F.sum(F.length(t)).alias("n_chars"))


def needs_ocr(items: DataFrame, boxes: DataFrame, force_all: bool = False) -> DataFrame:
    """Pages and what to do with them: rotated pages are skipped, pages with little text are recognised."""
    stats = boxes.select(*PAGE, "rotation").join(text_stats(items), PAGE, "left")
    poor = (F.coalesce("n_items", F.lit(0)) < 6) | (F.coalesce("n_chars", F.lit(0)) < 25)
    action = F.when(F.col("rotation") != 0, "skip").when(F.lit(force_all) | poor, "recognise").otherwise("keep")
    return stats.select(*PAGE, action.alias("action"))


def filter_confidence(lines: DataFrame, least: int = 30) -> DataFrame:
    return lines.where(F.coalesce("conf", F.lit(100)) >= least)


def body_size(items: DataFrame, default: float = 10.0) -> DataFrame:
    """Median font size of each document's non-blank items. Items are counted by size first, so a document brings a row for each of its sizes."""
    sizes = items.where("trim(str) <> ''").groupBy("doc_id", "font_size").agg(F.count("*").alias("n"))
    return sizes.groupBy("doc_id").agg(F.coalesce(F.nullif(F.expr("percentile(font_size, 0.5, n)"), F.lit(0.0)), F.lit(default)).alias("body"))


def upper_median(items: DataFrame) -> DataFrame:
    """The upper of the two middle sizes of each page."""
    return items.groupBy(*PAGE).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY font_size DESC)").alias("size"))


def reading_order(items: DataFrame) -> DataFrame:
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "item_no")).cast("long"))


def redact_pages(items: DataFrame, rects: DataFrame) -> DataFrame:
    """Text of the pages without a rectangle; pages with one lose all of theirs."""
    return items.join(rects.select(*PAGE).distinct(), PAGE, "left_anti")


def items_in_rects(items: DataFrame, rects: DataFrame, least: float = 4) -> DataFrame:
    """Items that a rectangle covers. Corners in any order; smaller drags than ``least`` points are dropped."""
    r = rects.select(*PAGE, F.least("x1", "x2").alias("ra"), F.greatest("x1", "x2").alias("rb"), F.least("y1", "y2").alias("rc"), F.greatest("y1", "y2").alias("rd"))
    r = r.where((F.col("rb") - F.col("ra") >= least) & (F.col("rd") - F.col("rc") >= least))
    over = (items["x"] < F.col("rb")) & (items["x"] + items["width"] > F.col("ra")) & (items["y"] < F.col("rd")) & (items["y"] + items["font_size"] > F.col("rc"))
    return items.join(r, PAGE).where(over).select(*PAGE, "item_no").distinct()


def _floats(column: pa.Array, null: float) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(null).to_numpy(zero_copy_only=False)


def _by_pages(items: DataFrame, more: list[str | Column], run: Callable[[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """Gives run the non-blank items of some whole pages at a time, each page in reading order: their columns, where pages begin, and for each item the number of its row in its page and the row's largest size so far.

    A window puts the items of a page behind each other in one task; they stream by there, and a task holds no more than a batch and one page. run gives columns of the schema behind doc_id, page_no.
    Rows: an item joins the row whose first item's y is within 0.4 of the row's largest size with its own; the row keeps its first y, which no window can."""
    by = Window.partitionBy(*PAGE).orderBy("ny", "x", "item_no", "str", "font_size")
    placed = items.where("trim(str) <> ''").select(*PAGE, (-F.col("y")).alias("ny"), "x", "item_no", "str", "font_size", *more).withColumn("place", F.row_number().over(by))
    placed = placed.withColumn("item_no", F.col("item_no").cast("long"))

    def pages(b: pa.RecordBatch) -> pa.RecordBatch:
        begins = b.column("place").to_numpy() == 1
        row_of, size_of, row, top, most = [], [], 0, 0.0, 0.0
        for first, ny, size in zip(begins.tolist(), _floats(b.column("ny"), np.nan).tolist(), _floats(b.column("font_size"), -np.inf).tolist(), strict=True):
            if first:
                row, top, most = 0, ny, size
            elif abs(ny - top) <= 0.4 * (larger := most if most >= size else size):
                most = larger
            else:
                row, top, most = row + 1, ny, size
            row_of.append(row)
            size_of.append(most)
        out = run({n: b.column(n) for n in b.schema.names}, begins, np.array(row_of, np.int64), np.array(size_of))
        return pa.RecordBatch.from_arrays(out, names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("place").to_numpy() == 1)
            if len(starts):
                last = int(starts[-1])
                if held or last:
                    yield pages(pa.concat_batches([*held, b.slice(0, last)]))
                b, held = b.slice(last), []
            if b.num_rows:
                held.append(b)
        if held:
            yield pages(pa.concat_batches(held))

    kinds = dict(items.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in PAGE], schema])
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return placed.mapInArrow(stream, schema)


def _row_ids(begins: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each item's page and of its row, over all pages of a batch."""
    return np.cumsum(begins) - 1, np.cumsum(begins | np.append(True, row[1:] != row[:-1])) - 1


def _place_in(group: np.ndarray) -> np.ndarray:
    """For a sorted array of group numbers, each one's place in its group, from 0."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


def cluster_lines(items: DataFrame) -> DataFrame:
    """Lines of each page: an item joins the line whose first item's y is within 0.4 of the larger size; a gap over 0.28 of that size stands for a space."""

    def run(c: dict[str, pa.Array], begins: np.ndarray, row: np.ndarray, most: np.ndarray) -> list[pa.Array]:
        starts = np.flatnonzero(np.append(True, np.diff(_row_ids(begins, row)[1]) > 0))
        first, last = pa.array(starts), pa.array(np.append(starts[1:], len(row)) - 1)
        x, end = c["x"].cast(pa.float64()), pc.add(c["x"].cast(pa.float64()), c["width"].cast(pa.float64()))
        known = (x.is_valid().to_numpy(zero_copy_only=False) & (most > -np.inf))[1:] & end.is_valid().to_numpy(zero_copy_only=False)[:-1]
        apart = np.append(False, known & ~(_floats(x, 0.0)[1:] - _floats(end, 0.0)[:-1] <= 0.28 * most[1:]) & ~pc.ends_with(c["str"], " ").to_numpy(zero_copy_only=False)[:-1])
        apart[starts] = False
        pieces = pc.if_else(pa.array(apart), pc.binary_join_element_wise(" ", c["str"], ""), c["str"])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pieces), "")
        any_of = lambda flag: np.logical_or.reduceat(flag.to_numpy(zero_copy_only=False), starts)
        bold, roman = any_of(c["b"].fill_null(False)), any_of(pc.invert(c["i"]).fill_null(False))
        size = most[last]
        return [*(c[k].take(first) for k in PAGE), pa.array(row[starts]), text, pc.negate(c["ny"].take(first)).cast(pa.float64()), end.take(last), pa.array(size, mask=size == -np.inf), pa.array(bold, mask=~bold & any_of(c["b"].is_null())), pa.array(~roman, mask=~roman & any_of(c["i"].is_null()))]

    more = ["width", F.contains("font_family", F.lit("Bold")).alias("b"), F.contains("font_family", F.lit("Oblique")).alias("i")]
    return _by_pages(items, more, run, "line_no long, text string, y double, endx double, size double, bold boolean, italic boolean")


def gap_to_next(lines: DataFrame) -> DataFrame:
    """y less the next line's y; null for a page's last. Blank lines are dropped after."""
    gap = F.col("y") - F.lead("y").over(Window.partitionBy(*PAGE).orderBy("line_no"))
    return lines.withColumn("gap", gap).where("trim(text) <> ''")


def _keyed(items: DataFrame) -> DataFrame:
    return items.where(" and ".join(f"{c} is not null" for c in PAGE))


def paragraph_break(lines: DataFrame, default: float = 10.0) -> DataFrame:
    """Lines with their paragraph number: a new one after a gap over 1.6 of the page's median positive gap, or unknown."""
    usual = F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(Window.partitionBy(*PAGE)), F.lit(default))
    by = Window.partitionBy(*PAGE).orderBy("line_no")
    both = _keyed(lines).withColumn("usual", usual).withColumn("ends", (F.col("gap").isNull() | (F.col("gap") > 1.6 * F.col("usual"))).cast("int"))
    return both.withColumn("paragraph", F.coalesce(F.sum("ends").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("usual", "ends")


def column_breaks(items: DataFrame) -> DataFrame:
    """Columns of each page: a gap over twice the upper median size between sorted x starts a new one, at its middle."""
    xs = items.select(*PAGE, "x").distinct().join(upper_median(items), PAGE)
    by = Window.partitionBy(*PAGE).orderBy("x")
    gap = xs.withColumn("before", F.lag("x").over(by)).where(F.col("x") - F.col("before") > 2 * F.col("size"))
    edges = gap.select(*PAGE, ((F.col("x") + F.col("before")) / 2).alias("begins")).unionByName(items.select(*PAGE).distinct().withColumn("begins", F.lit(0.0)))
    return edges.withColumn("column_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("begins")).cast("long")).withColumn("ends", F.lead("begins").over(Window.partitionBy(*PAGE).orderBy("begins")))


def cluster_rows(items: DataFrame) -> DataFrame:
    """Each item with its row and its place in it: rows as in cluster_lines, cells of a row by x."""

    def run(c: dict[str, pa.Array], begins: np.ndarray, row: np.ndarray, most: np.ndarray) -> list[pa.Array]:
        ids = _row_ids(begins, row)[1]
        order = np.lexsort((_floats(c["x"], -np.inf), ids))  # stable: items of one x stay by y and item_no
        cell = np.empty(len(ids), np.int64)
        cell[order] = _place_in(ids) + 1
        return [c["doc_id"], c["page_no"], pa.array(row), pa.array(cell), c["x"], c["item_no"], c["str"]]

    return _by_pages(items, [], run, f"row_no long, cell_no long, x {dict(items.dtypes)['x']}, item_no long, str string")


def _cells(c: dict[str, pa.Array], begins: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Cells of some pages: the first item of each, its row (over all pages) and column, its text; and how many columns each page has. Columns as in column_breaks."""
    page, ids = _row_ids(begins, row)
    n, x = int(page[-1]) + 1, _floats(c["x"], -np.inf)
    none = c["x"].is_null().to_numpy(zero_copy_only=False)
    # the upper median of each page's sizes
    told = np.flatnonzero(c["font_size"].is_valid().to_numpy(zero_copy_only=False))
    sizes = _floats(c["font_size"], np.nan)[told]
    count = np.bincount(page[told], minlength=n)
    first = np.cumsum(count) - count
    median = np.full(n, np.nan)
    median[count > 0] = sizes[np.lexsort((sizes, page[told]))][(first + count // 2)[count > 0]]
    # edges: 0 and the middle of each wide gap
    known = np.flatnonzero(~none)
    by_x = known[np.lexsort((x[known], page[known]))]
    a, b = by_x[:-1], by_x[1:]
    wide = np.flatnonzero((page[a] == page[b]) & (x[b] > x[a]) & (x[b] - x[a] > 2 * median[page[b]]))
    edge_page = np.concatenate([np.arange(n), page[b][wide]])
    edges = np.concatenate([np.zeros(n), (x[b][wide] + x[a][wide]) / 2])
    width = np.bincount(edge_page, minlength=n)
    # an item's column: how many edges of its page are not beyond it
    pages, e = np.concatenate([edge_page, page[known]]), len(edges)
    merged = np.lexsort((np.concatenate([edges, x[known]]), pages))
    passed = np.empty(len(pages), np.int64)
    passed[merged] = np.cumsum(merged < e) - (np.cumsum(width) - width)[pages[merged]]
    column = np.where(width[page] == 1, 1, 0)
    column[known] = np.maximum(1, passed[e:])
    # without x an item is in the only column or in none
    order = np.lexsort((x, ids))
    order = order[column[order] > 0]
    key, at = ids[order], column[order]
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])))[: len(order)]
    texts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), c["str"].take(pa.array(order)))
    return order[starts], key[starts], at[starts], pc.ascii_trim(pc.binary_join(texts, " "), " "), width


def table_cells(items: DataFrame) -> DataFrame:
    """Cells of each page: its rows, cut at the column breaks; the texts of a cell joined by a space. What is left of
    the first column belongs to it; cells without text give no row. Rows and columns are found in one pass over a page."""

    def run(c: dict[str, pa.Array], begins: np.ndarray, row: np.ndarray, most: np.ndarray) -> list[pa.Array]:
        first, _, column, value, _ = _cells(c, begins, row)
        at = pa.array(first)
        return [c["doc_id"].take(at), c["page_no"].take(at), pa.array(row[first]), pa.array(column), value]

    return _by_pages(_keyed(items), [], run, "row_no long, column_no long, value string")


def _row_cells(items: DataFrame) -> DataFrame:
    """doc_id, page_no, row_no, cells: the cells of each row, one for each column of its page."""

    def run(c: dict[str, pa.Array], begins: np.ndarray, row: np.ndarray, most: np.ndarray) -> list[pa.Array]:
        first, key, column, value, width = _cells(c, begins, row)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        wide = width[_row_ids(begins, row)[0][first[heads]]]
        ends = np.cumsum(wide)
        source = np.full(int(wide.sum()), -1, np.int64)
        source[np.repeat(ends - wide, np.diff(np.append(heads, len(key)))) + column - 1] = np.arange(len(key))
        flat = value.take(pa.array(source, mask=source < 0)).fill_null("")
        at = pa.array(first[heads])
        return [c["doc_id"].take(at), c["page_no"].take(at), pa.array(row[first[heads]]), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), flat)]

    return _by_pages(_keyed(items), [], run, "row_no long, cells array<string>")


def dense_rows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """The sheet of each document: doc_id, sheet_row (from 1), page_no, cells. A page's rows have a cell for each of its columns, empty where it has no text; a page without text is
    one row of one empty cell; between two pages stands a row without cells (its page_no is that of the page after it). pages: doc_id, page_no of all pages.

    Each page comes with two rows more, before and behind its own: the one before it stands unless the page is its document's first, the one behind it if nothing is between the two."""
    before, behind = -1, (1 << 63) - 1
    more = pages.select(*PAGE).distinct().select(*PAGE, F.explode(F.array(F.lit(before).cast("long"), F.lit(behind).cast("long"))).alias("row_no"))
    more = more.withColumn("cells", F.when(F.col("row_no") == before, F.array().cast("array<string>")).otherwise(F.array(F.lit(""))))
    by = Window.partitionBy("doc_id").orderBy("page_no", "row_no")
    whole = _row_cells(items).unionByName(more)
    whole = whole.withColumn("first", F.min(F.when(F.col("row_no") == before, F.col("page_no"))).over(by)).withColumn("last", F.lag("row_no").over(by))
    whole = whole.where(F.when(F.col("row_no") == before, F.col("page_no") > F.col("first")).when(F.col("row_no") == behind, F.col("last") == before).otherwise(F.lit(True)))
    return whole.select("doc_id", F.row_number().over(by).cast("long").alias("sheet_row"), "page_no", "cells")


def render_markdown(lines: DataFrame, body: DataFrame) -> DataFrame:
    """doc_id, page_no, text: headings (italics stay), lists numbered anew, list items and paragraphs with emphasis."""
    df = paragraph_break(gap_to_next(lines.join(body, "doc_id")))  # joined first: the windows find each document in one place
    df = df.withColumn("c", classify_line(F.col("size"), F.col("body"), F.trim("text"))).withColumn("kind", F.col("c.kind")).withColumn("t", squeezed(F.col("c.text")))
    by = Window.partitionBy(*PAGE).orderBy("line_no")
    plain = F.col("kind") == "paragraph"
    begins = F.when(~plain | (F.lag("kind").over(by) != "paragraph") | F.lag("kind").over(by).isNull() | (F.col("paragraph") != F.lag("paragraph").over(by)), 1).otherwise(0)
    df = df.withColumn("block", F.sum(begins).over(by))
    no = F.lit(False)  # headings are bold as they are
    styled = F.when(plain, wrap_emphasis(escape_leading_token(F.col("t")), F.col("bold"), F.col("italic"))).when(F.col("kind").startswith("heading"), wrap_emphasis(F.col("t"), no, F.col("italic"))).otherwise(wrap_emphasis(F.col("t"), F.col("bold"), F.col("italic")))
    blocks = df.withColumn("s", styled).groupBy(*PAGE, "block").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " ").alias("s"))
    by = Window.partitionBy(*PAGE).orderBy("block")
    run = F.sum(F.when(F.col("kind") == F.lag("kind").over(by), 0).otherwise(1)).over(by)
    blocks = blocks.withColumn("run", run)
    blocks = blocks.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("block")))
    level = F.regexp_extract("kind", "heading([1-4])", 1)
    out = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.col("s"))).when(F.col("kind") == "bullet", F.concat(F.lit("- "), F.col("s"))).when(F.col("kind") == "ordered", F.concat(F.col("n").cast("string"), F.lit(". "), F.col("s"))).otherwise(F.col("s"))
    glue = F.when(F.col("kind").isin("bullet", "ordered") & (F.col("n") > 1), "\n").otherwise("\n\n")
    blocks = blocks.withColumn("o", F.concat(glue, out))
    return blocks.groupBy(*PAGE).agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "o"))), lambda x: x["o"]), ""), r"\A\n+", "").alias("text"))


# --- Markdown


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) with kind: blank, rule, heading, bullet, ordered, text."""
    t = F.col("line")
    kind = F.when(F.regexp_replace(t, r"\s+", "") == "", "blank").when(t.rlike(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*\z"), "rule").when(t.rlike("^#{1,4} +"), "heading").when(t.rlike("^[-*+] +"), "bullet").when(t.rlike(r"^[0-9]{1,3}[.)] +"), "ordered").otherwise("text")
    return lines.withColumn("kind", kind)


def parse_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block_no, kind, level, item_index, text. Plain lines that follow each other are one paragraph; the index of
    an ordered list restarts after any block but a blank line."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    df = line_kinds(lines)
    begins = F.when((F.col("kind") == "text") & (F.lag("kind").over(by) == "text"), 0).otherwise(1)
    df = df.withColumn("island", F.sum(begins).over(by)).where("kind <> 'blank'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ")
    blocks = df.groupBy("doc_id", "island").agg(F.first("kind").alias("kind"), text.alias("text"))
    by = Window.partitionBy("doc_id").orderBy("island")
    blocks = blocks.withColumn("cut", F.sum(F.when(F.col("kind") == "ordered", 0).otherwise(1)).over(by))
    index = F.when(F.col("kind") == "ordered", F.count_if(F.col("kind") == "ordered").over(Window.partitionBy("doc_id", "cut").orderBy("island")))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", "^(#+)", 1)))
    bare = F.when(F.col("kind") == "heading", F.regexp_replace("text", "^#{1,4} +", "")).when(F.col("kind") == "bullet", F.regexp_replace("text", "^[-*+] +", "")).when(F.col("kind") == "ordered", F.regexp_replace("text", r"^[0-9]{1,3}[.)] +", "")).when(F.col("kind") == "rule", "").otherwise(F.col("text"))
    return blocks.select("doc_id", F.row_number().over(by).cast("long").alias("block_no"), "kind", level.cast("int").alias("level"), index.cast("long").alias("item_index"), bare.alias("text"))


def ordered_index(lines: DataFrame) -> DataFrame:
    """Number of each line of an ordered list; it restarts after any line but a blank one or another of the list."""
    df = line_kinds(lines).where("kind <> 'blank'")
    cut = F.sum(F.when(F.col("kind") == "ordered", 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("line_no"))
    df = df.withColumn("cut", cut).where("kind = 'ordered'")
    return df.select("doc_id", "line_no", F.row_number().over(Window.partitionBy("doc_id", "cut").orderBy("line_no")).cast("long").alias("item_index"))


def paragraph_islands(lines: DataFrame) -> DataFrame:
    """Paragraphs: runs of plain lines, joined by a space."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    begins = F.when((F.col("kind") == "text") & (F.lag("kind").over(by) == "text"), 0).otherwise(1)
    df = line_kinds(lines).withColumn("island", F.sum(begins).over(by)).where("kind = 'text'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ")
    return df.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), text.alias("text")).drop("island")


def list_groups(lines: DataFrame) -> DataFrame:
    """Lists: runs of lines of one list kind; a blank line, another kind or any other block closes one."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    df = line_kinds(lines).withColumn("run", F.sum(F.when(F.col("kind") == F.lag("kind").over(by), 0).otherwise(1)).over(by))
    return df.where("kind in ('bullet', 'ordered')").groupBy("doc_id", "run", "kind").agg(F.count("*").alias("items"), F.min("line_no").alias("first_line")).drop("run")


INLINE = r"\*\*\*[^*`\n]+\*\*\*|\*\*[^*`\n]+\*\*|\*[^*`\n]+\*|`[^*`\n]+`"


def parse_inline(s: Column) -> Column:
    """array of (text, style) of a line: bold-italic, bold, italic, code, plain; empty plain runs are left out."""
    found, gaps = F.regexp_extract_all(s, F.lit(INLINE), F.lit(0)), F.split(s, INLINE, -1)
    style = lambda m: F.when(F.startswith(m, F.lit("***")), "bold-italic").when(F.startswith(m, F.lit("**")), "bold").when(F.startswith(m, F.lit("*")), "italic").otherwise("code")
    runs = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: F.array(F.struct(z["g"].alias("text"), F.lit("plain").alias("style")), F.struct(F.regexp_replace(z["m"], r"^(?:\*+|`)|(?:\*+|`)\z", "").alias("text"), style(z["m"]).alias("style"))))
    return F.filter(F.flatten(runs), lambda r: r["text"].isNotNull() & (r["text"] != ""))


def wrap_lines(blocks: DataFrame, width: int = 60) -> DataFrame:
    """Greedy wrap of each block's words to a width in characters: doc_id, block_no, wrapped_no, text."""
    start = F.struct(F.lit("").alias("line"), F.array().cast("array<string>").alias("done"))

    def add(acc: Column, w: Column) -> Column:
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        fits = (F.length(longer) <= width) | (acc["line"] == "")
        return F.struct(F.when(fits, longer).otherwise(w).alias("line"), F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["line"])).alias("done"))

    words = F.filter(F.split("text", " "), lambda w: w != "")
    folded = blocks.select("doc_id", "block_no", F.aggregate(words, start, add, lambda a: F.array_append(a["done"], a["line"])).alias("l"))
    return folded.select("doc_id", "block_no", F.posexplode("l").alias("wrapped_no", "text"))


#: height of a line of each kind of block, and what stands free above the block (fixed values)
HEIGHTS = {"heading": (26.0, 10.0), "bullet": (16.0, 2.0), "ordered": (16.0, 2.0), "rule": (12.0, 6.0), "text": (16.0, 8.0)}


def paginate(lines: DataFrame, height: float = 660.0, heights: dict[str, tuple[float, float]] = HEIGHTS) -> DataFrame:
    """Wrapped lines (doc_id, block_no, wrapped_no, kind, text) laid out on pages of that height: with page_no (from 1) and y, the line's distance from the top.

    A line that does not fit begins the next page, without the free space above it; one that is higher than a page has a page of its own. The documents of a task stream by in order,
    with the height reached carried from row to row and from batch to batch, so a document of any length needs no more than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, page, at = None, 1, 0.0
        for b in batches:
            ids, tall, free = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "tall", "free"))
            page_no, y = [], []
            for i, h, f in zip(ids, tall, free, strict=True):
                if i != doc:
                    doc, page, at = i, 1, 0.0
                if at > 0 and at + f + h > height:
                    page, at = page + 1, 0.0
                if at > 0:
                    at += f
                page_no.append(page)
                y.append(at)
                at += h
            rest = b.select(["doc_id", "block_no", "wrapped_no", "kind", "text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(page_no, pa.int64()), pa.array(y, pa.float64())], names=[*rest.schema.names, "page_no", "y"])

    of = lambda k: F.coalesce(*[F.when(F.col("kind") == name, F.lit(float(h[k]))) for name, h in heights.items()], F.lit(float(heights["text"][k])))
    above = F.when(F.col("wrapped_no") == 0, of(1)).otherwise(F.lit(0.0))
    rows = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("block_no").cast("long").alias("block_no"), F.col("wrapped_no").cast("long").alias("wrapped_no"), "kind", "text", of(0).alias("tall"), above.alias("free"))
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "block_no", "wrapped_no")
    return dealt.mapInArrow(run, "doc_id long, block_no long, wrapped_no long, kind string, text string, page_no long, y double")
