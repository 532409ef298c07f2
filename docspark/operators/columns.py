"""Column functions of the document model (family B): pure Column to Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["es", "fr", "de", "pt", "it", "ru", "ja", "ko", "zh", "zh-TW", "ar", "hi", "tr", "nl", "pl", "id", "vi", "th", "uk", "cs", "sv"]  # fixed values


def running(df: DataFrame, names: list[str], combine: Callable[..., Column]) -> DataFrame:
    """df with each array of names replaced by its running combination: element i becomes combine of all elements up to it.

    combine is associative, of several columns, and skips nulls. Each step joins four stretches, so an array of n takes log4 n passes over it
    (an append inside a fold copies the array each time). Arrays of up to 4^12 elements."""
    for k in range(12):
        step = 4**k

        def one(name: str) -> Column:
            before = lambda i: [F.get(F.col(name), i - step * j) for j in (1, 2, 3)]  # noqa: E731, B023
            return F.when(F.size(name) > step, F.transform(name, lambda v, i: combine(v, *before(i)))).otherwise(F.col(name))  # noqa: B023

        df = df.withColumns({name: one(name) for name in names})
    return df


def added(*x: Column) -> Column:
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), x)


def half_up(x: Column) -> Column:
    """Rounds halves up, towards plus infinity."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    return (F.floor(x * 10 + 0.5) / 10).cast("string")


def squeezed(s: Column) -> Column:
    """Runs of ASCII white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 10**6, F.concat(one_decimal(n / 1000), F.lit(" KB"))).otherwise(F.concat(one_decimal(n / 10**6), F.lit(" MB")))


def base_name(name: Column, ext: str = "pdf") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(name, rf"(?i)\.{ext}\z", ""), F.lit("")), F.lit("document"))


def output_name(name: Column, recipe: Column) -> Column:
    short = F.regexp_replace(F.regexp_replace(recipe, r"-v[0-9]+\z", ""), "[^A-Za-z0-9]+", "-")
    return F.concat(base_name(name), F.lit("-"), F.regexp_replace(short, r"^-+|-+\z", ""), F.lit(".pdf"))


def safe_text(s: Column, most: int) -> Column:
    return F.substring(squeezed(F.coalesce(s, F.lit(""))), 1, most)


def clamp_count(n: Column, low: int, high: int) -> Column:
    whole = F.when(n == F.floor(n), n).otherwise(0)
    return F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), whole.cast("bigint"))), F.lit(low)).cast("bigint")


def action_count(actions: Column) -> Column:
    """Entries over all lists of a map."""
    return F.aggregate(F.map_values(actions), F.lit(0).cast("long"), lambda n, v: n + F.greatest(F.coalesce(F.size(v), F.lit(0)), F.lit(0)))


def fill_template(template: Column, params: Column) -> Column:
    """{name} replaced for each entry of the map, all at once: what a value holds is not replaced again. Unknown names stay."""
    name = r"\{[^{}]*\}"
    value = lambda n: F.coalesce(F.try_element_at(params, F.substring(n, F.lit(2), F.length(n) - 2)), n)
    return F.array_join(F.zip_with(F.split(template, name, -1), F.regexp_extract_all(template, F.lit(name), F.lit(0)), lambda part, n: F.concat(part, F.coalesce(value(n), F.lit("")))), "")


def page_label(style: Column, n: Column, total: Column) -> Column:
    number = n.cast("string")
    return F.when(style == "n", number).when(style == "page", F.concat(F.lit("Page "), number)).otherwise(F.concat(F.lit("Page "), number, F.lit(" of "), total.cast("string")))


def rotate_angle(existing: Column, delta: Column) -> Column:
    return F.pmod(existing + delta, F.lit(360))


def crop_box(w: Column, h: Column, rotation: Column, top: float, right: float, bottom: float, left: float) -> Column:
    """Insets given in the frame as seen, each at most half a side less 5; mapped back to the page's own frame."""
    turned = rotation % 180 != 0
    seen_w, seen_h = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    capped = lambda inset, side: F.greatest(F.lit(0.0), F.least(F.lit(float(inset)), side / 2 - 5))
    t, r, b, l_ = capped(top, seen_h), capped(right, seen_w), capped(bottom, seen_h), capped(left, seen_w)
    width, height = F.greatest(F.lit(10.0), seen_w - l_ - r), F.greatest(F.lit(10.0), seen_h - t - b)
    pick = lambda a, c, d, e: F.when(rotation == 0, a).when(rotation == 90, c).when(rotation == 180, d).otherwise(e)
    return F.struct(pick(l_, t, r, b).alias("x"), pick(b, l_, t, r).alias("y"), F.when(turned, height).otherwise(width).alias("w"), F.when(turned, width).otherwise(height).alias("h"))


def quality_level(v: Column) -> Column:
    """0..100 to (scale, quality), linear through (0.85, 0.55), (1.3, 0.78), (2.0, 0.9)."""
    low, high = v / 50, (v - 50) / 50
    return F.struct(F.when(v <= 50, 0.85 + low * 0.45).otherwise(1.3 + high * 0.7).alias("scale"), F.when(v <= 50, 0.55 + low * 0.23).otherwise(0.78 + high * 0.12).alias("quality"))


#: the labels and their bounds are fixed values
def quality_label(v: Column) -> Column:
    return F.when(v < 20, "Smallest file").when(v < 40, "Smaller file").when(v <= 60, "Balanced").when(v < 80, "Good quality").otherwise("Highest quality")


def encodable_text(s: Column, most: int = 40, latin: bool = False) -> Column:
    """Printable ASCII only, at most so many characters; dropped tells whether anything went, text is null if nothing is left.
    latin: printable Latin-1 stays, and a question mark stands for what does not."""
    ascii_ = F.regexp_replace(s, r"[^\x20-\x7e\xa0-\xff]", "?") if latin else F.regexp_replace(s, r"[^\x20-\x7e]", "")
    return F.struct(F.nullif(F.substring(F.trim(ascii_), 1, most), F.lit("")).alias("text"), (ascii_ != s).alias("dropped"))


def wrap_emphasis(s: Column, bold: Column, italic: Column) -> Column:
    t = F.trim(s)
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(t == "", t).otherwise(F.concat(mark, t, mark))


def escape_leading_token(s: Column) -> Column:
    return F.regexp_replace(s, r"^([#\-*+>])", r"\\$1")


#: what stands before a text that was read by OCR, in Markdown and in plain text (fixed values)
OCR_NOTE, OCR_PLAIN = "*(Page scanned via OCR)*", "[Page scanned via OCR]"


def markdown_to_plain(s: Column) -> Column:
    """Line by line: heading marks go, emphasis and code are unwrapped, the OCR note takes its plain form."""
    steps = [(r"(?m)^#{1,6} ", ""), (r"(?m)^\*\(Page scanned via OCR\)\*$", OCR_PLAIN), (r"\*\*\*([^*\n]+)\*\*\*", "$1"), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"`([^`\n]+)`", "$1")]
    return reduce(lambda c, x: F.regexp_replace(c, *x), steps, F.replace(s, F.lit("\r\n"), F.lit("\n")))


def text_paragraphs(s: Column) -> Column:
    """Paragraphs between blank lines, each on one line, joined by a blank line."""
    parts = F.split(F.replace(s, F.lit("\r\n"), F.lit("\n")), r"\n[\x20\t]*\n")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != ""), "\n\n")


def ocr_markdown(s: Column) -> Column:
    """The paragraphs of a text read by OCR behind the OCR note; empty where there are none."""
    parts = text_paragraphs(s)
    return F.when(parts == "", "").otherwise(F.concat(F.lit(OCR_NOTE + "\n\n"), parts))


def escape_html(s: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")], s)


def escape_xml(s: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], s)


def split_keywords(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def is_present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def route_language(path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(2))
    known = first.isin(LANGUAGES)
    return F.struct(F.when(known, first).otherwise("en").alias("lang"), F.when(known, F.coalesce(F.nullif(F.substring(path, F.length(first) + 2, F.length(path)), F.lit("")), F.lit("/"))).otherwise(path).alias("page"))


def canonical_url(url: Column) -> Column:
    """www host to the apex; one trailing slash off unless the path is the root or a language's root; query kept."""
    apex = F.regexp_replace(url, r"^([a-z]+://)www\.", "$1")
    base, query = F.split_part(apex, F.lit("?"), F.lit(1)), F.when(F.contains(apex, F.lit("?")), F.concat(F.lit("?"), F.split_part(apex, F.lit("?"), F.lit(2)))).otherwise("")
    path = url_path(base)
    root = (path == "/") | F.regexp_replace(path, "^/|/$", "").isin(LANGUAGES)
    return F.concat(F.when(root, base).otherwise(F.regexp_replace(base, r"/\z", "")), query)


def redirect(url: Column) -> Column:
    """Where a request for url belongs, and its status: location, 301 if that is another place, else 200. www goes to the apex; a path that ends in .html (or
    /index.html) leads to the page without it, under its own language; trailing slashes go, but for the root and the roots of languages, which have one. Query and language stay."""
    origin = F.regexp_replace(F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), r"^([a-z]+://)www\.", "$1")
    route = route_language(F.coalesce(F.nullif(url_path(url), F.lit("")), F.lit("/")))
    bare = F.regexp_replace(F.regexp_replace(route["page"], r"(?:/index)?\.html\z", ""), r"/+\z", "")
    path = F.concat(F.when(route["lang"] == "en", "").otherwise(F.concat(F.lit("/"), route["lang"])), F.when(bare == "", "/").otherwise(bare))
    location = F.concat(origin, path, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))
    return F.struct(location.alias("location"), F.when(location == url, 200).otherwise(301).alias("status"))


def localize_href(href: Column, lang: Column) -> Column:
    alone = href.rlike(r"^(?:[a-z]+:|#|\?|\.|//)") | F.split_part(href, F.lit("/"), F.lit(2)).isin(LANGUAGES) | (lang == "en") | (href == "")
    return F.when(alone, href).when(F.startswith(href, F.lit("/")), F.concat(F.lit("/"), lang, href)).otherwise(F.concat(F.lit("/"), lang, F.lit("/"), href))


def detect_language(path: Column, saved: Column, browser: Column) -> Column:
    """The first supported of the path's, the saved and the browser's language; traditional Chinese apart; else en."""
    known = lambda c: F.when(c.isin([*LANGUAGES, "en"]), c)
    first = F.split_part(path, F.lit("/"), F.lit(2))
    traditional = F.when(F.lower(browser).rlike("^zh-(tw|hk|hant)"), F.lit("zh-TW"))
    return F.coalesce(F.when(first.isin(LANGUAGES), first), known(saved), traditional, known(F.lower(F.split_part(browser, F.lit("-"), F.lit(1)))), F.lit("en"))


def text_direction(lang: Column) -> Column:
    return F.when(lang == "ar", "rtl").otherwise("ltr")


def classify_line(size: Column, body: Column, text: Column) -> Column:
    """kind (heading1..4, bullet, ordered, paragraph) and the text without its marker."""
    ratio = size / body
    bullet, ordered = r"^[-*•] +", r"^[0-9]{1,3}[.)] +"
    kind = F.when(ratio >= 1.8, "heading1").when(ratio >= 1.5, "heading2").when(ratio >= 1.25, "heading3").when(ratio >= 1.1, "heading4").when(text.rlike(bullet), "bullet").when(text.rlike(ordered), "ordered").otherwise("paragraph")
    return F.struct(kind.alias("kind"), F.when(kind == "bullet", F.regexp_replace(text, bullet, "")).when(kind == "ordered", F.regexp_replace(text, ordered, "")).otherwise(text).alias("text"))


def is_locked_error(name: Column, message: Column) -> Column:
    return F.coalesce(name == "PasswordException", F.lit(False)) | F.coalesce(message.rlike("(?i)password|encrypted"), F.lit(False))


def clip_cell(s: Column, width: Column) -> Column:
    return F.substring(s, F.lit(1), F.greatest(F.lit(1), width.cast("int")))


def available_actions(queued: Column, running: Column, failed: Column, locked: Column) -> Column:
    return F.array_compact(F.array(F.when(queued | running, "cancel"), F.when(failed, "retry"), F.when(~locked, "normalise")))


def document_actions(queued: Column, running: Column, failed: Column, strict: Column, tolerant: Column, locked: Column) -> Column:
    """Actions that a record's state permits, by the parses of its diagnosis: what the tolerant parser read can be normalised, what the strict one took be rebuilt, nothing that is locked."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    free = ~yes(locked)
    return F.array_compact(F.array(F.when(yes(queued) | yes(running), "cancel"), F.when(yes(failed), "retry"), F.when(yes(tolerant) & free, "normalise"), F.when(yes(strict) & free, "rebuild")))


# --- metadata, permissions, sizes

#: fields of a document's metadata (fixed values)
FIELDS = ["title", "author", "subject", "keywords", "creator", "producer"]


def set_metadata(df: DataFrame, values: dict[str, Column], now: Column) -> DataFrame:
    """df with the given fields overwritten (others stay as they are) and the time of modification."""
    unknown = set(values) - set(FIELDS)
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    return df.withColumns({**values, "modified": now})


def carry_metadata(df: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Fields copied from the struct source where it has one that is not null and not empty; a value that does not fit the field's type is skipped."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(f"{source}.{c}").cast("string"), F.lit("")).try_cast(df.schema[c].dataType), F.col(c)) for c in fields})


def map_permissions(printing: Column, copying: Column, editing: Column) -> Column:
    """Choices as flags; printing has three levels, and content is always accessible."""
    level = F.when(printing == "none", "none").when(printing == "low", "lowResolution").otherwise("highResolution")
    return F.struct(level.alias("printing"), F.coalesce(copying, F.lit(False)).alias("copying"), F.coalesce(editing, F.lit(False)).alias("modifying"), F.lit(True).alias("accessibility"))


def image_page_size(width: Column, height: Column, edge: int = 842) -> Column:
    """Width and height scaled so that the longer edge is ``edge``."""
    scale = F.lit(edge) / F.greatest(width, height)
    return F.struct((width * scale).alias("w"), (height * scale).alias("h"))


def column_count(row: Column) -> Column:
    """The widest of all rows (arrays)."""
    return F.max(F.size(row))


def words_added(line: Column) -> Column:
    """Words of all lines, cut at single spaces."""
    return F.sum(F.size(F.split(line, " ")))
