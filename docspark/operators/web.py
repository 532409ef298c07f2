"""Web pages as tables: metadata, links, scripts, audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.columns import is_present, localize_href, squeezed

#: category: pattern whose occurrences are counted in a page (fixed values)
CATEGORIES = {"links": r"(?i)<a\s[^>]*href", "scripts": r"(?i)<script\b", "forms": r"(?i)<(?:form|input|textarea|select)\b", "hidden": r"(?i)display:\s*none|\shidden\b", "comments": "<!--", "images": r"(?i)<img\b", "metadata": r"(?i)<meta\b"}


def title(html: Column) -> Column:
    return F.nullif(squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta_tags(html: Column) -> Column:
    """All meta elements of a page, read once."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))


def meta(tags: Column, attribute: str, name: str) -> Column:
    """content of the first of the meta elements with that attribute, in whatever order its attributes stand."""
    named = F.get(F.filter(tags, lambda t: t.rlike(rf'(?i)\b{attribute}="{name}"')), F.lit(0))
    return F.nullif(F.regexp_extract(named, r'(?i)\bcontent="([^"]*)"', 1), F.lit(""))


def extract_meta(pages: DataFrame, default: str = "") -> DataFrame:
    """page_id, title, description (own, else og's), twitter_title and twitter_description (own, else og's, else the page's, else the default)."""
    rows = pages.select("page_id", title(F.col("html")).alias("title"), meta_tags(F.col("html")).alias("tags"))
    m = lambda a, n: meta(F.col("tags"), a, n)
    own = F.coalesce(m("name", "description"), m("property", "og:description"))
    named = F.coalesce(m("name", "twitter:title"), m("property", "og:title"), F.col("title"), F.lit(default))
    told = F.coalesce(m("name", "twitter:description"), m("property", "og:description"), m("name", "description"), F.lit(default))
    return rows.select("page_id", "title", own.alias("description"), named.alias("twitter_title"), told.alias("twitter_description"))


#: what a page's metadata is rewritten with; one that is missing leaves the page as it was (fixed values)
NEW_VALUES = ("title", "description", "json_name", "json_description", "crumb_name", "home_name")

_LD = r'<script\b[^>]*type=["\']?application/ld\+json["\']?[^>]*>'


def _quoted(value: Column) -> Column:
    """As a replacement of regexp_replace."""
    return F.regexp_replace(value, r"([\\$])", r"\\$1")


def _attribute(value: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _set_meta(html: Column, attribute: str, name: str, value: Column) -> Column:
    """The content of the first meta element of that name, whatever the order of its attributes."""
    named = rf'<meta\b(?=[^>]*\s{attribute}="{name}")[^>]*?\scontent="'
    return F.regexp_replace(html, F.lit(rf'(?is)\A(.*?{named})[^"]*'), F.concat(F.lit("$1"), _quoted(_attribute(value))))


def _set_fields(node: Column, values: dict[str, Column]) -> Column:
    """A JSON object (text) with fields set: those it has in their place, others behind. All other fields stay as they are, of whatever type."""
    fields = F.from_json(node, "map<string,variant>")
    kept = fields
    for key, value in values.items():
        kept = F.transform_values(kept, lambda k, v: F.when(k == key, value.cast("variant")).otherwise(v))  # noqa: B023
    more = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))]), lambda k, _: ~F.map_contains_key(fields, k))
    return F.to_json(F.map_concat(kept, more))


def rewrite_graph(block: Column, url: Column, home_url: Column) -> Column:
    """A JSON-LD text with the application and the first two crumbs of its @graph rewritten by the columns of NEW_VALUES; null where it has no such nodes or is no JSON."""
    whole = F.from_json(block, "map<string,variant>")
    nodes = F.from_json(F.get_json_object(block, "$['@graph']"), "array<string>")
    type_ = lambda n: F.get_json_object(n, "$['@type']")
    first = lambda t: F.array_position(F.transform(nodes, lambda n: F.coalesce(type_(n), F.lit(""))), t)
    app, trail = first("SoftwareApplication"), first("BreadcrumbList")
    crumbs = F.from_json(F.get_json_object(F.get(nodes, (trail - 1).cast("int")), "$.itemListElement"), "array<string>")

    def crumb(n: Column, i: Column) -> Column:
        home = _set_fields(n, {"name": F.col("home_name"), "item": home_url})
        return F.when(i == 0, home).when(i == 1, _set_fields(n, {"name": F.col("crumb_name"), "item": url})).otherwise(n)

    new_crumbs = F.concat(F.lit("["), F.array_join(F.transform(crumbs, crumb), ","), F.lit("]"))

    def node(n: Column, i: Column) -> Column:
        own = _set_fields(n, {"name": F.col("json_name"), "description": F.col("json_description"), "url": url})
        list_ = F.transform_values(F.from_json(n, "map<string,variant>"), lambda k, v: F.when(k == "itemListElement", F.try_parse_json(new_crumbs)).otherwise(v))
        return F.when(i + 1 == app, own).when(i + 1 == trail, F.to_json(list_)).otherwise(n)

    graph = F.concat(F.lit("["), F.array_join(F.transform(nodes, node), ","), F.lit("]"))
    new = F.to_json(F.transform_values(whole, lambda k, v: F.when(k == "@graph", F.try_parse_json(graph)).otherwise(v)))
    return F.when((app > 0) & (trail > 0) & (F.size(crumbs) >= 2), new)


def rewrite_meta(pages: DataFrame, values: DataFrame) -> DataFrame:
    """Title, description, og and twitter elements, and application and crumbs of the JSON-LD, rewritten by values: page_id, NEW_VALUES, url, home_url.

    All or nothing: a page with a blank or missing value, or none, stays as it was (changed is false). Elements that a page does not have are not added,
    a JSON-LD block without the nodes or with broken JSON stays as it is; unknown fields are kept."""
    own = values.select("page_id", *NEW_VALUES, "url", "home_url")
    both = pages.select("page_id", F.struct("*").alias("page")).join(own, "page_id", "left").withColumn("h", F.col("page.html"))
    ok = reduce(lambda a, b: a & b, [is_present(F.col(c)) for c in NEW_VALUES], F.col("h").isNotNull())
    new = F.regexp_replace("h", F.lit(r"(?is)\A(.*?<title[^>]*>).*?(</title>)"), F.concat(F.lit("$1"), _quoted(_attribute(F.col("title"))), F.lit("$2")))
    for attribute, name, value in (("name", "description", "description"), ("property", "og:title", "title"), ("property", "og:description", "description"), ("property", "og:url", "url"), ("name", "twitter:title", "title"), ("name", "twitter:description", "description")):
        new = _set_meta(new, attribute, name, F.col(value))
    done = both.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("new", F.when(F.col("ok"), new).otherwise(F.col("h")))
    done = done.withColumn("block", F.nullif(F.regexp_extract("new", rf"(?is){_LD}(.*?)</script>", 1), F.lit("")))
    done = done.withColumn("graph", F.when(F.col("ok") & F.try_parse_json("block").isNotNull(), rewrite_graph(F.col("block"), F.col("url"), F.col("home_url"))))
    put = F.regexp_replace("new", F.lit(rf"(?is)\A(.*?{_LD}).*?(</script>)"), F.concat(F.lit("$1"), _quoted(F.col("graph")), F.lit("$2")))
    html = F.when(F.col("graph").isNotNull(), put).otherwise(F.col("new"))
    return done.select(*[F.col(f"page.`{c}`").alias(c) for c in pages.columns if c != "html"], F.col("ok").alias("changed"), html.alias("html"))


def rewrite_title(pages: DataFrame, values: DataFrame) -> DataFrame:
    """Title replaced where values (page_id, new_title) has one and the page has a title; all other pages as they were."""
    both = pages.join(values, "page_id", "left")
    new = F.regexp_replace(F.col("html"), F.lit(r"(?is)(<title[^>]*>).*?(</title>)"), F.concat(F.lit("$1"), _quoted(F.col("new_title")), F.lit("$2")))
    ok = is_present(F.col("new_title")) & F.col("html").rlike(r"(?is)<title[^>]*>.*?</title>")
    return both.withColumn("changed", F.coalesce(ok, F.lit(False))).withColumn("html", F.when(ok, new).otherwise(F.col("html"))).drop("new_title")


def link_table(pages: DataFrame) -> DataFrame:
    """page_id, link_no, href."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("link_no", "href"))


def localized_links(pages: DataFrame, lang: str) -> DataFrame:
    return link_table(pages).withColumn("localized", localize_href(F.col("href"), F.lit(lang)))


def inline_scripts(pages: DataFrame) -> DataFrame:
    """Distinct base64 SHA-256 of the non-blank inline scripts (those without src), sorted."""
    scripts = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script(?![^>]*\bsrc\b)[^>]*>(.*?)</script>"), F.lit(1))).alias("s")).where("trim(s) <> ''")
    return scripts.select(F.base64(F.unhex(F.sha2("s", 256))).alias("hash")).distinct().orderBy("hash")


def html_inspect(pages: DataFrame) -> DataFrame:
    """page_id, category, n: long form, zero counts included."""
    counts = F.create_map(*[x for c, p in CATEGORIES.items() for x in (F.lit(c), F.regexp_count("html", F.lit(p)).cast("long"))])
    return pages.select("page_id", F.explode(counts).alias("category", "n"))


def _readiness(html: Column) -> tuple[Column, Column, Column]:
    """Figures, those with a text, and whether the page names its language."""
    return F.regexp_count(html, F.lit(r"(?i)<img\b")).cast("long"), F.regexp_count(html, F.lit(r'(?i)<img\b[^>]*\salt="[^"]+"')).cast("long"), html.rlike(r'(?i)<html[^>]*\slang="[^"]+"')


def figure_readiness(pages: DataFrame) -> DataFrame:
    figures, described, has_lang = _readiness(F.col("html"))
    return pages.select("page_id", figures.alias("figures"), (figures - described).alias("missing"), has_lang.alias("has_lang"), title(F.col("html")).isNotNull().alias("has_title"))


#: part: pattern of which every page has exactly one (fixed values)
PARTS = {"title": r"(?i)<title\b", "body": r"(?i)<body\b", "html": r"(?i)<html\b", "main": r"(?i)<main\b", "header": r"(?i)<header\b", "footer": r"(?i)<footer\b", "skip link": r'(?i)<a\b[^>]*href="#main"'}


def page_source(pages: DataFrame) -> DataFrame:
    """page_id, url, name (the last part of the path), bytes, content: what a reader of pages gives, HTML or other bytes alike."""
    name = F.nullif(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), F.lit(""))
    content = F.col("html").cast("binary")
    return pages.select("page_id", "url", name.alias("name"), F.octet_length("html").cast("long").alias("bytes"), content.alias("content"))


def doctor_summary(pages: DataFrame, cap: int = 100_000) -> DataFrame:
    """figure_readiness with bounded counts, and whether a page breaks no rule."""
    bounded = lambda c: F.least(F.col(c), F.lit(cap).cast("long")).alias(c)
    ready = (F.col("missing") == 0) & F.col("has_lang") & F.col("has_title")
    return figure_readiness(pages).select("page_id", bounded("figures"), bounded("missing"), "has_lang", "has_title", ready.alias("ready"))


def _broken(html: Column) -> Column:
    """The rules that a page breaks: figures, language and title."""
    figures, described, has_lang = _readiness(html)
    return F.array_join(F.array_compact(F.array(F.when(figures > described, "figures without text"), F.when(~has_lang, "no language"), F.when(title(html).isNull(), "no title"))), ",")


def warnings(pages: DataFrame) -> DataFrame:
    """page_id and the rules it breaks."""
    return pages.select("page_id", _broken(F.col("html")).alias("warnings"))


def audit_pages(pages: DataFrame) -> DataFrame:
    """page_id, rule, n: parts that must be there exactly once and are not, and how many blocks of JSON-LD are invalid, if any."""
    counts = F.create_map(*[x for c, p in PARTS.items() for x in (F.lit(c), F.regexp_count("html", F.lit(p)).cast("long"))])
    parts = pages.select("page_id", F.explode(counts).alias("rule", "n")).where("n <> 1")
    bad = F.size(F.filter(_jsonld(F.col("html")), lambda j: F.get_json_object(j, "$").isNull())).cast("long")
    return parts.unionByName(pages.select("page_id", F.lit("json-ld").alias("rule"), bad.alias("n")).where("n > 0"))


def _jsonld(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))


def graph_entries(pages: DataFrame, type_: str) -> DataFrame:
    """page_id, entry: the entries of a type in the @graph lists of a page's JSON-LD."""
    blocks = pages.select("page_id", F.explode(_jsonld(F.col("html"))).alias("j"))
    entries = blocks.select("page_id", F.explode(F.from_json(F.get_json_object("j", "$['@graph']"), "array<string>")).alias("entry"))
    return entries.where(F.get_json_object("entry", "$['@type']") == type_)


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """page_id, block_no, type: blocks of ld+json; an invalid one has a null type and is flagged."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))).alias("block_no", "json"))
    return blocks.withColumn("valid", F.get_json_object("json", "$").isNotNull()).withColumn("type", F.get_json_object("json", "$['@type']")).drop("json")


def build_jsonld(rows: DataFrame, base: str) -> DataFrame:
    """slug and a compact JSON-LD graph: the application and its two-level breadcrumb, and the FAQ as it is, if rows have one. rows: slug, name; perhaps faq (a JSON object)."""
    url = F.concat(F.lit(base + "/"), F.col("slug"))
    app = F.struct(F.lit("SoftwareApplication").alias("@type"), F.col("name").alias("name"), url.alias("url"))
    crumb = lambda i, n, u: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), n.alias("name"), u.alias("item"))
    trail = F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(crumb(1, F.lit("Home"), F.lit(base)), crumb(2, F.col("name"), url)).alias("itemListElement"))
    faq = F.when(F.get_json_object("faq", "$").isNotNull(), F.concat(F.lit(","), F.trim("faq"))).otherwise("") if "faq" in rows.columns else F.lit("")
    return rows.select("slug", F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.to_json(app), F.lit(","), F.to_json(trail), faq, F.lit("]}")).alias("jsonld"))


def read_url_list(xml: DataFrame) -> DataFrame:
    """url of each loc element. xml: one column, text."""
    return xml.select(F.explode(F.regexp_extract_all("text", F.lit(r"<loc>\s*(https://[^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def duplicate_urls(urls: DataFrame) -> DataFrame:
    return urls.groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


def check_url_list(urls: DataFrame, most: int = 10_000) -> DataFrame:
    """problem, value, n: URLs that are there more than once, hosts if there is more than one, and a count that is not from 1 to most."""
    twice = duplicate_urls(urls).select(F.lit("duplicate").alias("problem"), F.col("url").alias("value"), "n")
    hosts = urls.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("value")).agg(F.count("*").alias("n"))
    several = hosts.crossJoin(hosts.agg(F.count("*").alias("hosts"))).where("hosts > 1").select(F.lit("host").alias("problem"), "value", "n")
    size = urls.agg(F.count("*").alias("n")).where(~F.col("n").between(1, most)).select(F.lit("count").alias("problem"), F.lit(None).cast("string").alias("value"), "n")
    return twice.unionByName(several).unionByName(size)


def set_block(pages: DataFrame, block: str) -> DataFrame:
    """The first run of og:image lines replaced by a fixed block; matched tells whether there was one."""
    p = r'(?m)\A([\s\S]*?)(?:^[ \t]*<meta property="og:image[^\n]*\n?)+'
    return pages.withColumn("matched", F.col("html").rlike(p)).withColumn("html", F.regexp_replace(F.col("html"), F.lit(p), F.lit("$1" + block.replace("\\", r"\\").replace("$", r"\$"))))


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items, breaks, bold and italic of a page; scripts, styles and comments left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line, self.prefix, self.skip = "", "", 0

    def flush(self) -> None:
        text = "\n".join(" ".join(x.split()) for x in self.line.split("\0")).strip()
        if text.strip("*"):
            self.blocks.append(self.prefix + text)
        self.line, self.prefix = "", ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "p", "div", "li"):
            self.flush()
            self.prefix = "- " if tag == "li" else "#" * int(tag[1]) + " " if tag[0] == "h" else ""
        elif tag == "br":
            self.line += "\0"
        elif not self.prefix and tag in ("b", "strong", "i", "em"):
            self.line += "**" if tag in ("b", "strong") else "*"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3", "h4", "p", "div", "li"):
            self.flush()
        elif not self.prefix and tag in ("b", "strong", "i", "em"):
            self.line += "**" if tag in ("b", "strong") else "*"

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line += data


def markdown_of(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown. Parsing needs a real parser, so pages go through Python in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "markdown": b["html"].map(markdown_of)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, markdown string")
