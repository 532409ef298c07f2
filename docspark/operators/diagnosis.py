"""Diagnosis of web pages: a strict and a tolerant parse side by side, errors by part, readiness, warnings, canonical form."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.scans import scan_sensitive

GRAPH = 1000  # elements whose readiness is looked at
LOCATIONS = 100  # errors of a page that are told one by one
CAP = 100_000  # no count is told higher

#: elements without content, and those whose end tag may be left out (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL = frozenset("html head body p li dt dd option optgroup tr td th thead tbody tfoot colgroup rp rt".split())
#: a start of the first closes an open one of the others next to it (fixed values)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}} | {x: {"p"} for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}


class Tolerant(HTMLParser):
    """Reads any text as elements. An end tag closes the nearest open element of its name and all above it: those of them whose end tag comes later are
    crossed, the others are unclosed. An end tag without an open element is stray. parts are the elements right below body (below the root, where there
    is no body): each has its own errors, and the text and data that it holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, int, int]] = []  # name, part, line
        self.cut: list[tuple[str, int, int]] = []  # closed by the end of an outer one, their own end tag not met so far
        self.errors: list[tuple[int, str, str, int]] = []  # part, kind, what, line
        self.elements = self.visited = self.parts = self.part = 0
        self.figures = self.described = self.boxes = self.signatures = 0
        self.language = self.titled = False
        self.data: list[str] | None = None  # of the JSON block being read

    def problem(self, kind: str, what: str, part: int | None = None, line: int | None = None) -> None:
        self.errors.append((self.part if part is None else part, kind, what, self.getpos()[0] if line is None else line))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and self.open[-1][0] in CLOSES.get(tag, ()):
            self.open.pop()
        holder = self.open[-1][0] if self.open else ""
        if tag not in ("html", "head", "body") and (holder in ("body", "") or holder == "html" and not any(x[0] == "body" for x in self.open)):
            self.parts += 1
            self.part = self.parts
        elif tag in ("html", "head", "body") or holder == "head":
            self.part = 0
        self.elements += 1
        if self.visited < GRAPH:
            self.visited += 1
            self.look(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self.open.append((tag, self.part, self.getpos()[0]))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def look(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "img":
            self.figures += 1
            self.described += bool(attrs.get("alt", "").strip())
        if tag in ("img", "svg", "video", "iframe", "canvas"):
            for side in ("width", "height"):
                size = attrs.get(side, "").strip().removesuffix("px").removesuffix("%")
                if side in attrs and not (size.replace(".", "", 1).isdecimal() and float(size) > 0):
                    self.boxes += 1
        if tag in ("input", "textarea", "canvas") and "signature" in " ".join(attrs.get(k, "") for k in ("name", "id", "type", "class")).lower():
            self.signatures += 1
        if tag == "html":
            self.language |= bool(attrs.get("lang", "").strip())
        if tag == "script" and attrs.get("type", "").lower() == "application/ld+json":
            self.data = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.data is not None:
            try:
                json.loads("".join(self.data))
            except ValueError:
                self.problem("data", "json-ld")
            self.data = None
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            late = next((i for i in range(len(self.cut) - 1, -1, -1) if self.cut[i][0] == tag), None)
            if late is not None:
                _, part, line = self.cut.pop(late)
                self.problem("crossed", tag, part, line)
            elif tag != "p" and tag not in VOID:
                self.problem("stray", tag)
            return
        self.cut += [x for x in self.open[at + 1 :] if x[0] not in OPTIONAL]
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.data is not None:
            self.data.append(data)
        if self.open and self.open[-1][0] == "title":
            self.titled |= bool(data.strip())
        if "\0" in data or "�" in data:
            self.problem("text", "character")

    def handle_charref(self, name: str) -> None:
        try:
            point = int(name[1:], 16) if name[0] in "xX" else int(name)
        except ValueError:
            point = 0
        if not 0 < point < 0x110000 or 0xD800 <= point < 0xE000:
            self.problem("text", "reference")

    def finish(self) -> None:
        self.close()
        for name, part, line in [*self.cut, *(x for x in self.open if x[0] not in OPTIONAL)]:
            self.problem("unclosed", name, part, line)
        self.errors.sort(key=lambda e: (e[0], e[3], e[1], e[2]))


def tolerant(html: str) -> Tolerant:
    parser = Tolerant()
    parser.feed(html)
    parser.finish()
    return parser


def strict(html: str) -> tuple[str | None, int]:
    """Why the text is no XML (null: it is), and its elements if it is."""
    elements = 0

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal elements
        elements += 1

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    try:
        parser.Parse(html, True)
    except (expat.ExpatError, UnicodeEncodeError) as e:
        return (f"{expat.ErrorString(e.code)} (line {e.lineno})" if isinstance(e, expat.ExpatError) else "no text"), 0
    return None, elements


class Canonical(HTMLParser):
    """Writes what Tolerant reads as XML: each element closed where that takes it to end, names in lower case, values in quotes, references as characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.out: list[str] = []

    def shut(self, until: int) -> None:
        self.out += [f"</{name}>" for name in reversed(self.open[until:])]
        del self.open[until:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and self.open[-1] in CLOSES.get(tag, ()):
            self.shut(len(self.open) - 1)
        named = "".join(f" {k}={quoteattr(v if v is not None else k)}" for k, v in dict(reversed(attrs)).items())
        self.out.append(f"<{tag}{named}{'/' if tag in VOID else ''}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i] == tag), None)
        if at is not None:
            self.shut(at)

    def handle_data(self, data: str) -> None:
        raw = self.open and self.open[-1] in ("script", "style")
        self.out.append(f"<![CDATA[{data.replace(']]>', ']]]]><![CDATA[>')}]]>" if raw and ("<" in data or "&" in data) else escape(data))

    def handle_entityref(self, name: str) -> None:
        self.out.append(escape(unescape(f"&{name};")))

    def handle_charref(self, name: str) -> None:
        self.out.append(escape(unescape(f"&#{name};")))

    def handle_comment(self, data: str) -> None:
        self.out.append("<!--" + data.replace("--", "- -") + ("-->" if not data.endswith("-") else " -->"))

    def handle_decl(self, decl: str) -> None:
        self.out.append(f"<!{decl}>")


def canonical_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = Canonical()
    parser.feed(html)
    parser.close()
    parser.shut(0)
    return "".join(parser.out).strip()


def canonical(pages: DataFrame) -> DataFrame:
    """pages with html in canonical form. Columns as they came."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(html=[canonical_text(h) for h in b["html"]])

    return pages.mapInPandas(run, pages.schema)


#: what of a page is counted: pattern (fixed values)
PRIVACY = {
    "standard_metadata": r"(?i)<meta\b[^>]*\sname=",
    "xmp": r"(?i)<script\b[^>]*ld\+json",
    "catalog_attachments": r"(?i)<a\b[^>]*\sdownload\b",
    "page_attachments": r"(?i)<(?:object|embed)\b",
    "annotations": "<!--",
    "links_and_actions": r"(?i)<a\b[^>]*\shref=",
    "document_scripts": r"(?i)<script\b",
    "page_scripts": r"(?i)<[a-z][^>]*\son[a-z]+=",
    "forms": r"(?i)<(?:input|textarea|select)\b",
    "calculation_order": r"(?i)<[a-z][^>]*\stabindex=",
    "signature_fields": r"(?i)<(?:input|textarea|canvas)\b[^>]*signature",
    "invisible_text": r"(?i)display:\s*none|<[a-z][^>]*\shidden\b",
}
ENCRYPTED = r"-----BEGIN (?:PGP MESSAGE|ENCRYPTED)"
LOCKED = r'(?i)<input\b[^>]*\stype="?password'


def privacy_summary(pages: DataFrame, limit: int = 100) -> DataFrame:
    """page_id, encrypted, locked, 13 counts, by_category (findings of each category that has some, sorted), truncated, n_warnings. xmp is 1 or 0, findings (sensitive)
    are capped. A locked page cannot be looked into: its counts are 0, and that is a warning, as is encryption."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    counted = pages.select("page_id", html.rlike(ENCRYPTED).alias("encrypted"), html.rlike(LOCKED).alias("locked"), *[F.regexp_count(html, F.lit(p)).cast("long").alias(k) for k, p in PRIVACY.items()])
    found = scan_sensitive(pages.select(F.col("page_id").alias("doc_id"), html.alias("text"))).groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    found = found.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.concat_ws("=", "category", F.col("n").cast("string")))).alias("kinds"))
    both = counted.join(found, "page_id", "left")
    open_ = lambda c: F.when(F.col("locked"), 0).otherwise(c).cast("long")
    counts = [open_(F.least(F.col(k), F.lit(1)) if k == "xmp" else F.col(k)).alias(k) for k in PRIVACY]
    total = open_(F.coalesce("total", F.lit(0)))
    kinds = F.when(~F.col("locked"), F.array_join("kinds", ","))
    warnings_ = F.col("encrypted").cast("long") + F.col("locked").cast("long")
    return both.select("page_id", "encrypted", "locked", *counts, F.least(total, F.lit(limit)).alias("sensitive"), F.coalesce(kinds, F.lit("")).alias("by_category"), (total >= limit).alias("truncated"), F.least(warnings_, F.lit(20)).alias("n_warnings"))


_REPORT = {
    "strict": "boolean", "tolerant": "boolean", "error": "string", "strict_count": "long", "tolerant_count": "long", "consistent": "boolean", "unclosed": "long", "stray": "long", "crossed": "long",
    "boxes": "long", "signatures": "long", "figures": "long", "missing": "long", "has_lang": "boolean", "has_title": "boolean", "parts": "long", "errors": "long", "truncated": "boolean",
    "locations": "array<struct<part:long,kind:string,what:string,line:long>>",
}


def _report(html: str | None) -> tuple:
    html = html or ""
    why, count = strict(html)
    t = tolerant(html)
    kinds = Counter(e[1] for e in t.errors)
    places = [{"part": p, "kind": k, "what": w, "line": n} for p, k, w, n in t.errors[:LOCATIONS]]
    bounded = lambda n: min(n, CAP)
    return (
        why is None, t.elements > 0, why, bounded(count), bounded(t.elements), 0 < count == t.elements, *(bounded(kinds[k]) for k in ("unclosed", "stray", "crossed")),
        bounded(t.boxes), bounded(t.signatures), t.figures, t.figures - t.described, t.language, t.titled, bounded(t.parts), bounded(len(t.errors)), t.visited >= GRAPH, places,
    )


def html_diagnose(pages: DataFrame, deep: bool = False) -> DataFrame:
    """page_id and the report of each page, with its warnings: strict (it is XML) and tolerant (it has elements), elements by either, unclosed, stray and
    crossed ones, boxes without a size, signature fields, figures and those without a text (of the first GRAPH elements; truncated tells that there are as many),
    parts, errors. With deep also locations: part, kind, what and line of the first LOCATIONS errors; without it, and in why the strict parse failed, null.

    Pages go through Python in Arrow batches, one text at a time. A null page is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([_report(h) for h in b["html"]], columns=list(_REPORT))
            yield pd.concat([b[["page_id"]].reset_index(drop=True), found], axis=1)

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, " + ", ".join(f"{k} {v}" for k, v in _REPORT.items()))
    if not deep:
        out = out.withColumn("locations", F.lit(None).cast(_REPORT["locations"])).withColumn("error", F.lit(None).cast("string"))
    return out.withColumn("warnings", warned())


def part_errors(pages: DataFrame) -> DataFrame:
    """A row for each error of a part of a page: page_id, part, kind (unclosed, stray, crossed, text, data), what, line."""
    return html_diagnose(pages, deep=True).select("page_id", F.explode("locations").alias("e")).select("page_id", "e.*")


#: warnings in order, each with the rule over a report (fixed values)
RULES = {
    "tolerant parse only": "tolerant and not strict",
    "counts differ": "not (strict_count > 0 and strict_count = tolerant_count)",
    "box without a size": "boxes > 0",
    "signature field": "signatures > 0",
    "parts not inspected": "errors > 0",
    "graph truncated": "truncated",
}


def warned() -> Column:
    """The warnings of a report, as its columns say: an array of texts."""
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(text)) for text, rule in RULES.items()]))


def warnings(reports: DataFrame) -> DataFrame:
    """page_id and the warnings of each report, joined by a semicolon."""
    return reports.select("page_id", F.array_join(warned(), "; ").alias("warnings"))


def doctor_summary(reports: DataFrame) -> DataFrame:
    """A report's flags and counts, none over CAP, the number of its warnings (20 at most), and whether figures, language and title are all there."""
    counts = ["strict_count", "tolerant_count", "unclosed", "stray", "crossed", "boxes", "signatures", "figures", "missing", "parts", "errors"]
    ready = (F.col("missing") == 0) & F.col("has_lang") & F.col("has_title")
    bounded = [F.least(F.col(c).cast("long"), F.lit(CAP).cast("long")).alias(c) for c in counts]
    return reports.select("page_id", "strict", "tolerant", "has_lang", "has_title", "truncated", *bounded, F.least(F.size(warned()), F.lit(20)).cast("long").alias("n_warnings"), ready.alias("ready"))
