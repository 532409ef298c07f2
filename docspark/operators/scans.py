"""Pattern scans over texts, capped findings and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.columns import added, running

#: category, confidence, pattern, in scan order (fixed values)
SENSITIVE = [
    ("email", "high", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("us-ssn", "high", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("payment-card", "medium", r"\b(?:[0-9][ -]*?){13,19}\b"),
    ("phone", "medium", r"(?:\+?[0-9][0-9 .()-]{7,}[0-9])"),
]
MATCH_LENGTH = 120


#: category: what a text without can hold no finding of (fixed values)
NEEDS = {"email": "@", "us-ssn": "-"}


def advances(found: Column, gaps: Column) -> Column:
    """How far each match reaches from the end of the one before; gaps is the text split at the matches. Their running sums are the matches' ends."""
    return F.slice(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), F.lit(1), F.size(found))


def scan_sensitive(docs: DataFrame, patterns: list[tuple[str, str, str]] = SENSITIVE) -> DataFrame:
    """doc_id, rank, category, confidence, offset, match: one row a finding; categories may overlap.

    Only texts that have a finding of a category are split at its pattern, which tells the offsets."""
    none = F.from_json(F.lit("[]"), "array<string>")

    def found(category: str, pattern: str) -> Column:
        every = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        return F.when(F.contains("t", F.lit(NEEDS[category])), every).otherwise(none) if category in NEEDS else every

    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("category"), F.lit(conf).alias("confidence"), found(c, p).alias("m")) for i, (c, conf, p) in enumerate(patterns)])
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).select("doc_id", "t", F.explode(kinds).alias("k")).where(F.size("k.m") > 0)
    gaps = F.coalesce(*[F.when(F.col("k.rank") == i, F.split("t", p, -1)) for i, (_, _, p) in enumerate(patterns)])
    rows = rows.select("doc_id", "k.rank", "k.category", "k.confidence", "k.m", gaps.alias("gaps")).withColumn("ends", advances(F.col("m"), F.col("gaps"))).drop("gaps")
    each = F.zip_with("ends", "m", lambda e, m: F.struct((e - F.length(m)).alias("offset"), m.alias("match")))
    rows = running(rows, ["ends"], added).select("doc_id", "rank", "category", "confidence", F.explode(each).alias("f"))
    return rows.select("doc_id", "rank", "category", "confidence", F.col("f.offset").cast("long").alias("offset"), F.substring("f.match", 1, MATCH_LENGTH).alias("match"))


def cap_findings(findings: DataFrame, limit: int = 100) -> DataFrame:
    """The first findings of each document, and whether its total reaches the limit."""
    by = Window.partitionBy("doc_id").orderBy("rank", "offset")
    kept = findings.withColumn("position", F.row_number().over(by)).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return kept.where(F.col("position") <= limit).withColumn("truncated", F.col("total") >= limit).drop("total")


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings by document and category. On a stream a running aggregation (update mode): a row that comes late still counts."""
    return findings.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def privacy_summary(findings: DataFrame, cap: int = 100) -> DataFrame:
    """One row a document: findings (at most cap), whether the cap was reached, how many categories, and the findings of each."""
    n = F.count("*")
    each = [F.count_if(F.col("category") == c).alias("n_" + c.replace("-", "_")) for c, _, _ in SENSITIVE]
    return findings.groupBy("doc_id").agg(F.least(n, F.lit(cap)).cast("long").alias("findings"), (n >= cap).alias("truncated"), F.count_distinct("category").alias("categories"), *each)


def metadata_scan(df: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, the names of the fields that are present, and how many."""
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.lit(c)) for c in fields]))
    return df.select("doc_id", F.array_join(present, ",").alias("fields"), F.size(present).alias("n_fields"))


def clean_metadata(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in fields})


_TOKEN = r"[^\p{L}\p{N}]+"


def _containing(rows: DataFrame, value: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """rows joined with the phrases that their value contains.

    A word inside a phrase, with others on both sides, is a whole word of every text that contains it. So each phrase meets the texts by its longest
    such word, in an equi-join, and only these are searched. Phrases of fewer than three words meet all texts."""
    words = F.split(phrase, _TOKEN, -1)
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = phrases.withColumn("word", longest)
    keyed_rows = rows.withColumn("row", F.xxhash64(value))  # equal values are searched as one
    words = keyed_rows.select("row", F.explode(F.array_distinct(F.split(value, _TOKEN, -1))).alias("word"))
    met = words.join(keyed.where("word is not null"), "word").drop("word").distinct()
    long = keyed_rows.join(met, "row").where(F.contains(value, phrase))
    short = keyed_rows.join(keyed.where("word is null"), F.contains(value, phrase))
    columns = [*rows.columns, *phrases.columns]
    return long.select(*columns).unionByName(short.select(*columns))


def banned_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase) for each forbidden phrase in a text, regardless of case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))  # once a text, not once a phrase
    return _containing(low, "low", phrases.select("phrase", F.lower("phrase").alias("low_phrase")), "low_phrase").select("doc_id", "phrase")


def leak_check(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """Needles found in outgoing rows, with how often."""
    return _containing(rows.select("value"), "value", needles, "needle").groupBy("needle").agg(F.count("*").alias("n"))


def invisible_ops(ops: DataFrame, by: str, mode: Column) -> DataFrame:
    """by, n: operations whose text mode draws nothing (both low bits set)."""
    return ops.groupBy(by).agg(F.count_if(mode.bitwiseAND(3) == 3).alias("n"))


def public_summary(findings: DataFrame) -> DataFrame:
    """What may leave: counts by category and confidence; never matches or text."""
    return findings.groupBy("category", "confidence").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def error_rollup(events: DataFrame, cap: int = 100_000, categories: int = 30, locations: int = 100) -> DataFrame:
    """Per key: errors counted up to the cap (truncated: it was reached), its categories in first-seen order, and where the first ones are."""
    each = events.groupBy("key", "category").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    seen = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "category"))), 1, categories), lambda x: x["category"])
    sums = each.groupBy("key").agg(F.least(F.sum("n"), F.lit(cap)).alias("errors"), (F.sum("n") >= cap).alias("truncated"), F.array_join(seen, ",").alias("categories"))
    ranked = events.select("key", "seq", F.row_number().over(Window.partitionBy("key").orderBy("seq")).alias("k")).where(F.col("k") <= locations)
    return sums.join(ranked.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("locations")), "key")
