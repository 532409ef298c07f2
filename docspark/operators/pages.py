"""Page algebra on (doc_id, page_no) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.columns import rotate_angle


def select_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    return pages.join(wanted, ["doc_id", "page_no"], "left_semi")


def delete_pages(pages: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The other pages. A document of which nothing is left has one row, with page_no null and a problem."""
    left = pages.join(unwanted, ["doc_id", "page_no"], "left_anti")
    return _told(left, pages, "nothing is left")


def _told(left: DataFrame, before: DataFrame, problem: str) -> DataFrame:
    """left with a column problem (null), and for each document of before that it lacks one row with the problem and nothing else."""
    gone = before.select("doc_id").distinct().join(left.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("problem", F.lit(problem))
    return left.withColumn("problem", F.lit(None).cast("string")).unionByName(gone, allowMissingColumns=True)


def renumber(pages: DataFrame, *order: str) -> DataFrame:
    """Dense new page numbers in the given order."""
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long"))


def number_pages(pages: DataFrame, start: int = 1, skip_first: bool = True) -> DataFrame:
    """number (null for a skipped first page) and total; a single page is never skipped."""
    n, k = F.count("*").over(Window.partitionBy("doc_id")), F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    first = F.when(n > 1, 1 if skip_first else 0).otherwise(0)
    begin = max(1, start)
    numbered = pages.withColumn("k", k).withColumn("skip", first).withColumn("n", n)
    return numbered.withColumn("number", F.when(F.col("k") > F.col("skip"), F.col("k") - F.col("skip") + begin - 1).cast("long")).withColumn("total", (F.col("n") - F.col("skip") + begin - 1).cast("long")).drop("k", "skip", "n")


def reverse_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page_no"))).cast("long"))


def apply_order(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items at their new positions; where a group's order is no permutation of its ids, its items have none, and a problem."""
    both = items.withColumn("here", F.lit(1)).join(order.withColumn("there", F.lit(1)), ["doc_id", "page_no"], "full")
    by = Window.partitionBy("doc_id")
    bad = F.sum(F.when(F.col("here").isNull() | F.col("there").isNull(), 1).otherwise(0)).over(by)
    told = both.withColumn("bad", bad > 0).where("here is not null")
    told = told.withColumn("problem", F.when(F.col("bad"), "order is no permutation"))
    return told.withColumns({c: F.when(~F.col("bad"), F.col(c)) for c in order.columns if c not in ("doc_id", "page_no")}).drop("bad", "here", "there")


def merge_documents(inputs: DataFrame) -> DataFrame:
    """inputs: target, input_no, page_no, ...: one document a target, pages in input order then page order; two inputs at least."""
    several = F.max("input_no").over(Window.partitionBy("target")) > F.min("input_no").over(Window.partitionBy("target"))
    merged = inputs.withColumn("several", several).where("several").drop("several")
    return merged.withColumn("new_page", F.row_number().over(Window.partitionBy("target").orderBy("input_no", "page_no")).cast("long"))


def sample_pages(pages: DataFrame) -> DataFrame:
    """All pages up to five, else five evenly spaced ones."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    k = lambda i: 1 + F.floor(F.lit(i) * (F.col("n") - 1) / 4 + 0.5)
    return pages.withColumn("n", n).where((F.col("n") <= 5) | (F.col("page_no") == k(0)) | (F.col("page_no") == k(1)) | (F.col("page_no") == k(2)) | (F.col("page_no") == k(3)) | (F.col("page_no") == k(4))).drop("n")


def first_last(pages: DataFrame) -> DataFrame:
    ends = pages.groupBy("doc_id").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    return pages.join(ends, "doc_id").where("page_no = a or page_no = b").drop("a", "b")


def page_at(pages: DataFrame, n: int) -> DataFrame:
    """The nth page of each document, n clamped to what there is."""
    count = F.count("*").over(Window.partitionBy("doc_id"))
    return pages.withColumn("n", count).where(F.col("page_no") == F.least(F.greatest(F.lit(n), F.lit(1)), F.col("n"))).drop("n")


def append_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages of a, then of b, of each document, renumbered."""
    both = a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))
    return renumber(both, "part", "page_no").drop("part")


def split_each(pages: DataFrame) -> DataFrame:
    """A document for each page."""
    return pages.withColumn("name", F.format_string("%s-page-%d", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("page_no")))


def organize(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: doc_id, page_no, keep, position, turn. Kept pages at their new places with their rotation turned; a document of which
    nothing is kept has one row with a problem."""
    kept = pages.join(edits, ["doc_id", "page_no"]).where("keep")
    kept = kept.withColumn("rotation", rotate_angle(F.col("rotation"), F.col("turn")))
    placed = kept.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "page_no")).cast("long"))
    return _told(placed, pages, "nothing is kept")


def rotation_hint(boxes: DataFrame, keep: Column | None = None) -> DataFrame:
    """Pages, those kept, removed, and those kept that are rotated, of each document."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    return boxes.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"), F.count_if(kept & (F.col("rotation") != 0)).alias("rotated"))


def box_issues(boxes: DataFrame, limit: int = 100) -> DataFrame:
    """Per document: pages whose boxes are not usable (up to the limit), and whether the limit was reached."""
    bad = (F.col("media_w") <= 0) | (F.col("media_h") <= 0) | (F.col("crop_w") <= 0) | (F.col("crop_h") <= 0) | (F.col("crop_x") < F.col("media_x")) | (F.col("crop_y") < F.col("media_y")) | (F.col("crop_x") + F.col("crop_w") > F.col("media_x") + F.col("media_w")) | (F.col("crop_y") + F.col("crop_h") > F.col("media_y") + F.col("media_h"))
    n = F.count_if(bad)
    return boxes.groupBy("doc_id").agg(F.least(n, F.lit(limit)).alias("issues"), (n >= limit).alias("truncated"))


def estimate_size(pages: DataFrame) -> DataFrame:
    """doc_id, bytes estimated from at most five sampled pages, the exact sum, and the change in percent. pages: doc_id, page_no, size."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    sampled = sample_pages(pages.withColumn("all", n).withColumn("exact", F.sum("size").over(Window.partitionBy("doc_id"))))
    one, rest = F.sum(F.when(F.col("page_no") == 1, F.col("size"))), F.avg(F.when(F.col("page_no") > 1, F.col("size")))
    body = F.when(F.max("all") <= 5, F.sum("size")).otherwise(one + rest * (F.max("all") - 1))
    sizes = sampled.groupBy("doc_id").agg(F.floor(body + 300 * F.max("all") + 1000 + 0.5).alias("estimate"), F.max("exact").alias("exact"))
    change = F.floor((F.col("estimate") - F.col("exact")) * 100.0 / F.nullif(F.col("exact"), F.lit(0)) + 0.5)
    return sizes.withColumn("percent", change.cast("long"))


def document_text(pages: DataFrame, rule: bool = False) -> DataFrame:
    """Texts of the pages that have any, in order, joined by a blank line or a rule."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return pages.where("trim(text) <> ''").groupBy("doc_id").agg(F.concat(F.trim(F.array_join(parts, "\n\n---\n\n" if rule else "\n\n")), F.lit("\n")).alias("text"))


def verify_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: pages before and after, and whether they agree."""
    a, b = before.groupBy("doc_id").agg(F.count("*").alias("expected")), after.groupBy("doc_id").agg(F.count("*").alias("found"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("expected", F.lit(0)) == F.coalesce("found", F.lit(0))).alias("ok"))


def compare_parsers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two parsers' counts by document; consistent if equal and over zero."""
    both = a.select("doc_id", F.col("n").alias("n_a")).join(b.select("doc_id", F.col("n").alias("n_b")), "doc_id", "full")
    return both.withColumn("consistent", F.coalesce((F.col("n_a") == F.col("n_b")) & (F.col("n_a") > 0), F.lit(False)))
