"""Private data: pattern spans, and terms that give protected entities away. DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers (leftmost, not overlapping within
a kind). Each distinct value is a protected entity. The terms (runs of three letters or more outside of spans) of a
document that holds an entity are its context. Over the whole corpus, with p(e) the share of documents that hold entity
e, n(t) the documents that hold term t and n(e, t) those that hold both:

    information IC(e) = -log2 p(e),   disclosure PMI(e; t) = log2 ((n(e, t) + PRIOR p(e)) / (n(t) + PRIOR) / p(e))

that is, p(e | t) with PRIOR documents added in which t tells nothing. No pair is left out for its count: chance meetings
are held down by the prior, most where e itself tells little. A term discloses e if PMI >= IC / ALPHA, that is, if
knowing t leaves little of what e tells. It is removed where n(e, t) = n(t) (t occurs with e only), else generalised,
wherever it stands in the documents that hold e.

Offsets are code points, from the lengths between and of the matches. The patterns use possessive repeats and
start only where a run starts (or the last match ended), so that no text makes them go back; they match what
the plain patterns match.

A term with n(t) > (n(e) + PRIOR p(e)) / 2^(-IC (1 - 1 / ALPHA)) - PRIOR cannot disclose e and is paired with it nowhere.
All entities that occur in the same documents have equal counts with every term; one stands for them (documents are compared by two 64-bit
hashes of their set), so that copies of a page with many values add no pairs of values. Counts are pre-aggregated before they are shuffled, and nothing is broadcast by hand.

Defined cases: a null text is an empty one (no spans); equal spans of different kinds all stay; repeated rows are
each scanned and count as documents; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import kept
from docspark.operators.columns import added, running
from docspark.operators.scans import advances

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "phone": "+"}  # a text without it has no such span
TERM = r"\p{L}{3,}"
BLOCK = 1024
PRIOR = 1.0
ALPHA = 1.1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")), F.lit(999)) <= 255)
    if kind == "card":
        reversed_ = F.split(F.reverse(_digits(value)), "")
        luhn = F.aggregate(
            F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
            F.lit(0),
            lambda a, x: a + F.coalesce(x, F.lit(0)),
        )
        return F.length(_digits(value)).between(12, 19) & (luhn % 10 == 0)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def with_spans(rows: DataFrame) -> DataFrame:
    """rows (t: the text, not null, and others) with spans, the sorted base spans: array of (start, rank, end, kind, value)."""
    names = rows.columns
    none = F.from_json(F.lit("[]"), "array<string>")
    found = lambda k: F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0))
    df = rows.withColumns({k: F.when(F.contains("t", F.lit(MARKS[k])), found(k)).otherwise(none) if k in MARKS else found(k) for k in KINDS})
    ends = [f"{k}_ends" for k in KINDS]
    gaps = lambda k: F.when(F.size(k) > 0, F.split("t", PATTERNS[k], -1)).otherwise(none)
    df = running(df.withColumns({e: advances(F.col(k), gaps(k)) for k, e in zip(KINDS, ends, strict=True)}), ends, added)

    def of(rank: int, kind: str) -> Column:
        made = F.zip_with(f"{kind}_ends", kind, lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
        return F.filter(made, lambda x: _valid(kind, x["value"]))

    parts = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return df.select(*names, F.array_sort(F.concat(*parts)).alias("spans"))


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a piece is cut out of a short string wherever it stands."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    i, j = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, i), start % BLOCK + 1, F.lit(BLOCK))
    several = F.concat(head, F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(F.get(blocks, j), F.lit(1), end - j * BLOCK))
    return F.when(end <= start, "").when(i == j, F.substring(F.get(blocks, i), start % BLOCK + 1, end - start)).otherwise(several)


def _replaced(rows: DataFrame, text: Column, spans: Column, instead: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows with name: the text with instead(span, where the spans before it end) in place of each span; null where there is none. Spans are sorted, and may overlap."""
    df = rows.withColumn("__spans", spans).withColumns({"__tops": F.transform("__spans", lambda s: s["end"]), "__blocks": F.when(F.size("__spans") > 0, _blocks(text)), "__length": F.length(text)})
    df = running(df, ["__tops"], F.greatest)

    def part(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get("__tops", i - 1), F.lit(0))
        return F.concat(_piece(F.col("__blocks"), at, F.greatest(s["start"], at)), instead(s, at))

    last = _piece(F.col("__blocks"), F.element_at("__tops", -1), F.col("__length"))
    whole = F.concat(F.array_join(F.transform("__spans", part), ""), last)
    return df.withColumn(name, F.when(F.size("__spans") > 0, whole)).drop("__spans", "__tops", "__blocks", "__length")


def _blank(s: Column, at: Column) -> Column:
    """A space for each code point of a span that no span before it covers, so that all offsets stay."""
    return F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0)))


def _label(s: Column, at: Column) -> Column:
    return F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(F.replace(s["kind"], F.lit("_"), F.lit(" "))), F.lit("]"))).otherwise("")


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _disclosing(held: DataFrame, texts: DataFrame, alpha: float) -> DataFrame:
    """row, term, removed: the terms of each row that give away an entity of it. held: row, entities, masked."""
    often = texts.select(F.explode(F.array_distinct(_words(F.coalesce("t", F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = texts.agg(F.count("*").alias("n"))
    pairs = held.select("row", F.explode("entities").alias("entity"))
    rows_of = F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("two")
    alike = pairs.groupBy("entity").agg(*rows_of).groupBy("n_e", "one", "two").agg(F.min("entity").alias("entity"))  # of the same rows: one stands for all
    entities = alike.select("entity", "n_e").crossJoin(total)  # total is one row
    p = F.col("n_e") / F.col("n").cast("double")
    entities = entities.withColumn("p", p).withColumn("least", F.pow("p", F.lit(1 - 1 / alpha)))  # of p(e | t)
    entities = entities.withColumn("most", (F.col("n_e") + PRIOR * F.col("p")) / F.col("least") - PRIOR)  # of n_t
    own = kept(pairs.join(entities, "entity"), "entities")
    terms = held.select("row", F.explode(F.array_distinct(_words(F.col("masked")))).alias("term"))
    bound = own.agg(F.max("most").alias("bound"))  # one row
    rare = often.crossJoin(bound).where("n_t <= bound").select("term", "n_t")
    near = kept(terms.join(rare, "term").join(own, "row").where("n_t <= most").select("row", "term", "n_t", "entity", "p", "least"), "pairs")
    counts = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("p").alias("p"), F.first("least").alias("least"))
    reveal = counts.where((F.col("n_te") + PRIOR * F.col("p")) / (F.col("n_t") + PRIOR) >= F.col("least")).select("entity", "term", (F.col("n_te") >= F.col("n_t")).alias("removed"))
    return near.join(reveal, ["entity", "term"]).groupBy("row", "term").agg(F.max("removed").alias("removed"))


def _standing(held: DataFrame, hits: DataFrame) -> DataFrame:
    """row, terms: where the terms of hits stand in their rows."""
    hits = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("hits"))
    words = F.regexp_extract_all("masked", F.lit(TERM), F.lit(0))
    rows = held.join(hits, "row").select("row", "hits", "masked", words.alias("words"))
    rows = rows.select("row", "hits", "words", advances(F.col("words"), F.split("masked", F.lit(TERM), -1)).alias("ends"))

    def term(e: Column, w: Column) -> Column:
        removed = F.try_element_at("hits", F.lower(w))
        kind = F.when(removed, "term_removed").when(~removed, "term_general")
        return F.struct((e - F.length(w)).alias("start"), F.lit(len(KINDS)).alias("rank"), e.alias("end"), kind.alias("kind"))

    each = F.filter(F.zip_with("ends", "words", term), lambda x: x["kind"].isNotNull())
    return running(rows, ["ends"], added).select("row", each.alias("terms"))


def find_private(docs: DataFrame, text: str = "text", alpha: float = ALPHA, carry: bool = False) -> DataFrame:
    """doc (a struct of the row's columns with carry, else of doc_id), spans (base) and terms: array of (start, rank, end, kind).

    What is the caller's stays in the struct, so no name of a column can clash with one of the operator's."""
    value = F.col(f"`{text}`").cast("string")
    doc = F.struct("*") if carry else F.struct("doc_id")
    scanned = with_spans(docs.select(doc.alias("doc"), F.coalesce(value, F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row")))
    found = kept(_replaced(scanned, F.col("t"), F.col("spans"), _blank, "masked").select("doc", "spans", "row", "masked"), "spans")
    entity = lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))
    held = found.where("size(spans) > 0").select("row", F.array_distinct(F.transform("spans", entity)).alias("entities"), "masked")
    hit = _standing(held, _disclosing(held, docs.select(value.alias("t")), alpha))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,end:int,kind:string>>")
    plain = found.where("size(spans) = 0").select("doc", "spans", empty.alias("terms"))
    rest = found.where("size(spans) > 0").join(hit, "row", "left")
    return plain.unionByName(rest.select("doc", "spans", F.coalesce("terms", empty).alias("terms")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _short(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    found = find_private(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat(_short(F.col("spans")), F.col("terms")))
    return found.select(F.col("doc.doc_id").cast("long").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one. Columns as they came."""
    found = find_private(docs, text, carry=True)
    value = F.col(f"doc.`{text}`").cast("string")
    every = F.array_sort(F.concat(_short(F.col("spans")), F.col("terms")))
    made = _replaced(found.select("doc", every.alias("every"), value.alias("t")), F.col("t"), F.col("every"), _label, "new")
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    columns[text] = F.coalesce("new", "t")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return made.select(*[x.alias(c) for c, x in columns.items()])
