"""Steps, recipes and the four-call surface over DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docspark.operators import diagnosis, pages, scans
from docspark.streaming import queues


@dataclass
class Step:
    """A versioned step: a DataFrame function, its parameter rules, defaults, what it loses, and what else it does or risks.

    accepts names the columns it needs, produces those it adds; measures are aggregates (SQL) of its output that its report holds."""

    id: str
    run: Callable[..., DataFrame]
    rules: dict[str, dict[str, Any]] = field(default_factory=dict)
    defaults: dict[str, Any] = field(default_factory=dict)
    loss: str = ""
    accepts: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    change: str = ""
    risk: str = ""
    measures: dict[str, str] = field(default_factory=dict)


STEPS: dict[str, Step] = {}


def register_step(step: Step) -> Step:
    """Adds a step; ids are names with a version (name-v1), and stay what they are."""
    if step.id in STEPS:
        raise ValueError(f"step {step.id} is there already")
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*-v[1-9][0-9]*", step.id):
        raise ValueError(f"{step.id} has no version")
    STEPS[step.id] = step
    return step


def validate_params(step: Step, values: dict[str, Any]) -> dict[str, Any]:
    """values with the defaults filled in; an unknown, missing or invalid one is an error."""
    for name in values:
        if name not in step.rules:
            raise ValueError(f"{step.id} has no parameter {name}")
    full = {**step.defaults, **values}
    kinds = {"string": str, "integer": int, "number": (int, float)}
    for name, rule in step.rules.items():
        if name not in full:
            if rule.get("required"):
                raise ValueError(f"{step.id} needs {name}")
            continue
        v = full[name]
        measure = len(v) if isinstance(v, str) else v
        if isinstance(v, bool) or not isinstance(v, kinds[rule["type"]]) or not rule.get("least", measure) <= measure <= rule.get("most", measure) or v not in rule.get("enum", [v]):
            raise ValueError(f"{step.id}: {name} is not valid")
    return full


def _of_steps(value: Callable[[Step], Any]) -> Column:
    """A literal map over the registered steps, which are few."""
    return F.create_map(*[x for i, step in STEPS.items() for x in (F.lit(i), F.lit(value(step)))])


def describe_steps(requests: DataFrame) -> DataFrame:
    """requests (with a column step) with known, and what the registered step loses; null for an unknown one."""
    loss = F.try_element_at(_of_steps(lambda s: s.loss), F.col("step"))
    return requests.withColumn("known", F.coalesce(F.col("step").isin(list(STEPS)), F.lit(False))).withColumn("loss", loss)


def _fits(rule: dict[str, Any], given: Column) -> Column:
    """Whether a text is a value that the rule of a parameter allows."""
    number = {"string": F.length(given), "integer": F.when(given.rlike(r"^-?[0-9]+\z"), given.try_cast("long")), "number": given.try_cast("double")}[rule["type"]]
    ok = number.isNotNull() & (number >= rule.get("least", number)) & (number <= rule.get("most", number)) & (given.isin(rule["enum"]) if "enum" in rule else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def usable_params(step_id: Column, stored: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Of stored parameters (a map of texts) those that are valid for the step, and its defaults for all others it has."""
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce(stored, none)
    out = none
    for id_, step in STEPS.items():
        pairs = []
        for name, rule in step.rules.items():
            value = F.lit(None).cast("string") if name in secrets else F.try_element_at(given, F.lit(name))
            default = F.lit(str(step.defaults[name])) if name in step.defaults else F.lit(None).cast("string")
            pairs += [F.lit(name), F.when(_fits(rule, value), value).otherwise(default)]
        own = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else none
        out = F.when(step_id == id_, own).otherwise(out)
    return out


def check_params(requests: DataFrame) -> DataFrame:
    """requests (step, params: a map of texts) with problem, the first rule a row breaks (null: none), and the
    params filled up with the step's defaults. The twin of validate_params for tables of parameters."""
    problem = F.when(~F.coalesce(F.col("step").isin(list(STEPS)), F.lit(False)), "unknown step")
    full = F.coalesce("params", F.create_map().cast("map<string,string>"))
    for id_, step in STEPS.items():
        here = F.col("step") == id_
        known = F.array(*[F.lit(n) for n in step.rules]).cast("array<string>")
        problem = problem.when(here & (F.size(F.array_except(F.map_keys(full), known)) > 0), "unknown parameter")
        for name, rule in step.rules.items():
            given = F.try_element_at(full, F.lit(name))
            ok = _fits(rule, given)
            if rule.get("required"):
                problem = problem.when(here & given.isNull() & F.lit(name not in step.defaults), f"missing {name}")
            problem = problem.when(here & given.isNotNull() & ~ok, f"invalid {name}")
    defaults = F.coalesce(*[F.when(F.col("step") == i, F.create_map(*[F.lit(str(x)) for kv in s.defaults.items() for x in kv]).cast("map<string,string>")) for i, s in STEPS.items()], F.create_map().cast("map<string,string>"))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(full, k))
    return requests.withColumn("problem", problem).withColumn("params", F.map_concat(full, missing))


def _applied(df: DataFrame, id_: str, params: dict[str, dict[str, Any]] | None) -> DataFrame:
    if id_ not in STEPS:
        raise ValueError(f"there is no step {id_}")
    step = STEPS[id_]
    if missing := [c for c in step.accepts if c not in df.columns]:
        raise ValueError(f"{id_} needs {', '.join(missing)}")
    out = df.transform(step.run, **validate_params(step, (params or {}).get(id_, {})))
    if missing := [c for c in step.produces if c not in out.columns]:
        raise ValueError(f"{id_} gave no {', '.join(missing)}")
    return out


def run_recipe(df: DataFrame, recipe: list[str], params: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """The steps in order, each fed the last one's output; one plan, run when the result is."""
    return reduce(lambda d, id_: _applied(d, id_, params), recipe, df)


def output_name(name: str, recipe: list[str]) -> str:
    """The name of what a recipe makes of name: always the same for the same steps. Letters, digits, points and hyphens, 160 at most."""
    base = re.sub(r"\.[^./]*\Z", "", name.rsplit("/", 1)[-1])
    safe = lambda x: re.sub(r"[^A-Za-z0-9.-]+", "-", x).strip("-.")
    tail = "-" + "+".join(safe(re.sub(r"-v[0-9]+\Z", "", id_)) for id_ in recipe) if recipe else ""
    return (safe(base) or "document")[: max(1, 160 - len(tail))] + tail


def run_reported(df: DataFrame, recipe: list[str], path: str, name: str = "document", params: dict[str, dict[str, Any]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs the recipe once, into the table output_name() of the folder path, and gives what was written and a report of each step:
    step_no, step, measure, value. The reports are observed in the job that writes, so no step is run and nothing is read again for them.

    Measures are rows, and the step's own; of a step with sensitive columns nothing but sums is told."""
    seen = []
    for n, id_ in enumerate(recipe):
        df = _applied(df, id_, params)
        measures = {"rows": "count(*)", **STEPS[id_].measures}
        seen.append((n, id_, Observation(f"{n}-{id_}-{uuid.uuid4().hex}"), list(measures)))
        df = df.observe(seen[-1][2], *[F.expr(c).cast("double").alias(m) for m, c in measures.items()])
    place, schema = f"{path}/{output_name(name, recipe)}", df.schema
    queues.swap_in(df, place)
    told = [(n, id_, m, watch.get[m]) for n, id_, watch, measures in seen for m in measures]
    spark = df.sparkSession
    return queues.current(spark, place, schema), spark.createDataFrame(told, "step_no int, step string, measure string, value double")


def loss_manifest(df: DataFrame, recipe: list[str]) -> DataFrame:
    """Each row of df with what every step of the recipe loses."""
    table = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.lit(STEPS[s].loss).alias("loss")) for i, s in enumerate(recipe)])
    return df.select("*", F.explode(table).alias("l")).select(*df.columns, "l.*")


def manifest(df: DataFrame, recipe: list[str]) -> DataFrame:
    """Each row of df with what every step of the recipe changes, loses and risks: step_no, step, kind, text. What a step does not have gives no row."""
    told = [(i, id_, kind, getattr(STEPS[id_], kind)) for i, id_ in enumerate(recipe) for kind in ("change", "loss", "risk")]
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.lit(k).alias("kind"), F.lit(t).alias("text")) for i, s, k, t in told if t])
    return df.select("*", F.explode(rows).alias("m")).select(*df.columns, "m.*")


register_step(Step("organize-pages-v1", lambda df, order: pages.reverse_pages(df) if order == "reverse" else df, {"order": {"type": "string", "enum": ["keep", "reverse"]}}, {"order": "reverse"}, "changes the reading order", ("doc_id", "page_no"), change="puts the pages into another order"))
register_step(Step("page-numbers-v1", lambda df, start: pages.number_pages(df, start, False), {"start": {"type": "integer", "least": 1, "most": 100_000}}, {"start": 1}, "adds numbers to every page", ("doc_id", "page_no"), ("number", "total"), "writes a number and the total on each page", "a number may cover what stands there", {"last_number": "max(number)"}))
register_step(Step("metadata-cleanup-v1", lambda df: scans.clean_metadata(df, [c for c in ("lang", "source") if c in df.columns]), {}, {}, "clears standard fields only", change="standard fields become empty", risk="what the text itself tells stays"))


class VerificationError(Exception):
    """What was written is not what it should be; the table is as it was before."""


def _digest(columns: list[str]) -> list[Column]:
    """Two sums over all rows that do not depend on their order, for each column."""
    return [x for c in columns for x in (F.bit_xor(F.xxhash64(F.lit(c), F.col(c))).alias(f"{c}_xor"), F.sum(F.pmod(F.xxhash64(F.col(c), F.lit(c)), F.lit(1 << 31))).alias(f"{c}_sum"))]


def verify_written(before: DataFrame, written: DataFrame, key: str, cleaned: list[str], changed: list[str] | None = None, samples: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key: expected and found rows, left (fields of cleaned that still have a value), altered (how many of the other columns differ), readable
    (each of samples has a value in the first and the last row of the key, by order of page_no where there is one), and ok. changed: columns that may differ.

    Columns are compared by sums over the rows of a key, not row by row, so rows need no key of their own; keys that one side lacks are told."""
    others = [c for c in before.columns if c not in (key, *cleaned, *(changed or []))]
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    left = sum((F.sum(F.when(blank(c), 0).otherwise(1)) for c in cleaned), F.lit(0))
    ends = [f(F.col(c).isNotNull(), F.col("page_no")) for c in samples for f in (F.min_by, F.max_by)] if "page_no" in written.columns else [F.every(F.col(c).isNotNull()) for c in samples]
    readable = reduce(lambda a, b: a & b, ends, F.lit(True))
    a = before.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), *_digest(others)).select(F.col("k"), F.struct("*").alias("a"))
    b = written.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), left.cast("long").alias("left"), readable.alias("readable"), *_digest(others)).select(F.col("k").alias("other"), F.struct("*").alias("b"))
    both = a.join(b, F.col("k").eqNullSafe(F.col("other")) & (F.col("a").isNotNull() & F.col("b").isNotNull()), "full")
    differ = sum((F.when(F.col(f"a.{c}_xor").eqNullSafe(F.col(f"b.{c}_xor")) & F.col(f"a.{c}_sum").eqNullSafe(F.col(f"b.{c}_sum")), 0).otherwise(1) for c in others), F.lit(0))
    told = both.select(F.coalesce("k", "other").alias(key), F.coalesce("a.n", F.lit(0)).alias("expected"), F.coalesce("b.n", F.lit(0)).alias("found"), F.coalesce("b.left", F.lit(0)).alias("left"), differ.cast("long").alias("altered"), F.coalesce("b.readable", F.lit(False)).alias("readable"))
    return told.withColumn("ok", (F.col("expected") == F.col("found")) & (F.col("left") == 0) & (F.col("altered") == 0) & F.col("readable"))


def commit_verified(before: DataFrame, after: DataFrame, path: str, key: str, cleaned: list[str], changed: list[str] | None = None, samples: tuple[str, ...] = (), write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Writes after beside the table in path, reads it from there, verifies it against before, and only then makes it the table's content.
    Gives the report of verify_written. If any key is not ok, a VerificationError is raised and the table stays as it was."""
    spark, schema = before.sparkSession, after.schema
    folder = queues.new_part(path)
    (write or (lambda df, to: df.write.parquet(to)))(after, folder)
    report = verify_written(before, spark.read.schema(schema).parquet(folder), key, cleaned, changed, samples)
    queues.swap_in(report, f"{path}-reports")
    report = queues.current(spark, f"{path}-reports", report.schema)
    bad = report.where("not ok").limit(1).collect()
    if bad:
        raise VerificationError(f"{key} {bad[0][key]}: {bad[0].asDict()}")
    queues.point_to(spark, path, folder)
    return report


def clean_and_verify(docs: DataFrame, fields: list[str], path: str, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Cleans the fields of docs into the table in path and gives its report: a row for each doc_id. What was written is scanned again; fields that
    remain, another number of rows, or any other column that changed refuse the whole table."""
    return commit_verified(docs, scans.clean_metadata(docs, fields), path, "doc_id", fields, write=write)


def rebuild(parts: DataFrame, content: list[str], path: str, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """The fallback that loses most: only doc_id, page_no and the content columns of each page go into the table in path. The report of verify_written:
    pages of each document before and after, content as it was, first and last page readable. Rows without a page are lost, and not expected."""
    kept = parts.where(F.col("page_no").isNotNull()).select("doc_id", "page_no", *content)
    return commit_verified(kept, kept, path, "doc_id", [], samples=tuple(content), write=write)


def rebuilt(parts: DataFrame, content: list[str]) -> DataFrame:
    """What rebuild writes, as a plan: content columns of each page."""
    return parts.where(F.col("page_no").isNotNull()).select("doc_id", "page_no", *content)


#: spaces of Unicode that become plain ones (fixed values)
SPACES = "\u00a0\u2000-\u200a"


def _canonical(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"[{SPACES}]", " "), r"(?m)[ \t]+$", "")


def normalize(docs: DataFrame) -> DataFrame:
    """Canonical text (line ends, trailing blanks, Unicode spaces) with accepted: the same words remain."""
    words = lambda c: F.regexp_replace(c, rf"[\s{SPACES}]+", " ")
    return docs.withColumn("normal", _canonical(F.col("text"))).withColumn("accepted", F.trim(words(F.col("text"))) == F.trim(words(F.col("normal")))).select("doc_id", "normal", "accepted")


#: columns that say who may see a row (fixed values)
ACCESS = ("password", "permissions", "encrypted", "locked", "owner")


def normalize_pages(pages_: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Web pages in canonical form into the table in path: unclosed and crossed elements get their end tags, void elements close themselves, stray end tags go, and so do columns
    of access control. Diagnosed again as read from there: page_id, strict (before and after), counts_agree, accepted. A page is accepted if the strict parser now takes it and both parsers count the
    same elements, as many as the tolerant one met before; pages that are not stay as they were in the table. Nothing is committed where rows are lost."""
    kept = pages_.select(*[c for c in pages_.columns if c not in ACCESS])
    spark = pages_.sparkSession
    tried = queues.new_part(f"{path}-tried")
    (write or (lambda df, to: df.write.parquet(to)))(diagnosis.canonical(kept), tried)
    normal = spark.read.schema(kept.schema).parquet(tried)
    was = diagnosis.html_diagnose(kept).select("page_id", F.col("strict").alias("was_strict"), F.col("tolerant_count").alias("expected"))
    now = diagnosis.html_diagnose(normal).select("page_id", "strict", "consistent", "tolerant_count")
    report = was.join(now, "page_id", "left").select("page_id", "was_strict", F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce(F.col("consistent") & (F.col("tolerant_count") == F.col("expected")), F.lit(False)).alias("counts_agree"))
    report = report.withColumn("accepted", F.col("strict") & F.col("counts_agree"))
    queues.swap_in(report, f"{path}-reports")
    report = queues.current(spark, f"{path}-reports", report.schema)
    good = report.where("accepted").select("page_id")
    final = normal.join(good, "page_id", "left_semi").unionByName(kept.join(good, "page_id", "left_anti"))
    commit_verified(kept, final, path, "page_id", [], changed=["html"])
    return report


#: kind: pattern of a line (fixed values), tried in this order
LINES = {"blank": r"\s*\Z", "rule": r"\s*(?:-{3,}|\*{3,}|_{3,})\s*\Z", "heading": "#{1,4} +", "bullet": "[-*+] +", "ordered": r"[0-9]{1,3}[.)] +"}


class Blocks:
    """Markdown blocks of a text as layout.parse_blocks gives them, for SQL: SELECT ... FROM documents, LATERAL blocks(text)."""

    def eval(self, text: str):  # noqa: ANN201
        if text is None:
            return
        number = item = 0
        paragraph: list[str] = []
        for line in [*text.split("\n"), ""]:
            kind = next((k for k, p in LINES.items() if re.match(p, line, re.ASCII)), "text")
            bare = line.strip(" ")
            if kind == "text":
                paragraph.append(bare)
                continue
            if paragraph:
                number, item = number + 1, 0
                yield number, "text", None, None, " ".join(paragraph)
                paragraph = []
            if kind != "blank":
                number, item = number + 1, item + 1 if kind == "ordered" else 0
                inner = "" if kind == "rule" else re.sub("^" + LINES[kind], "", bare)
                yield number, kind, len(bare) - len(bare.lstrip("#")) if kind == "heading" else None, item or None, inner


def register_sql(spark) -> None:  # noqa: ANN001
    """blocks(text) as a table function, html_markdown(html), and size_estimate(page_no, size) as an aggregate."""
    from docspark.operators.web import markdown_of

    def html_markdown(html: pd.Series) -> pd.Series:
        return html.map(markdown_of)

    spark.udf.register("html_markdown", F.pandas_udf(html_markdown, "string"))
    spark.udtf.register("blocks", F.udtf(Blocks, returnType="block_no long, kind string, level int, item_index long, text string"))

    def size_estimate(page: pd.Series, size: pd.Series) -> float:
        by = dict(zip(page, size, strict=True))
        n = len(by)
        if n <= 5:
            return float(sum(by.values()) + 300 * n + 1000)
        sample = sorted({int(1 + (k * (n - 1) / 4 + 0.5) // 1) for k in range(5)})
        rest = [by[p] for p in sample if p > 1]
        return float(by[1] + sum(rest) / len(rest) * (n - 1) + 300 * n + 1000)

    spark.udf.register("size_estimate", F.pandas_udf(size_estimate, "double"))


# --- the four calls


def merge_v1(inputs: list[DataFrame], by: str | None = None) -> DataFrame:
    """Pages of two inputs or more, one after the other; with by, one merged document for each of its values that
    two inputs have."""
    if len(inputs) < 2:
        raise ValueError("merging needs two inputs")
    both = [df.withColumn("input_no", F.lit(i)).withColumn("target", F.col(by) if by else F.lit(0)) for i, df in enumerate(inputs)]
    out = both[0]
    for df in both[1:]:
        out = out.unionByName(df)
    return pages.merge_documents(out).drop("target")


def inspect_v1(docs: DataFrame, max_matches: int = 100) -> DataFrame:
    """Findings by document, at most max_matches (1 to 100) of each, with the total told by truncated."""
    return scans.cap_findings(scans.scan_sensitive(docs), max(1, min(max_matches, 100)))


def inspect_pages_v1(html: DataFrame) -> DataFrame:
    """The privacy summary of each web page: its 13 counts and flags."""
    return diagnosis.privacy_summary(html)


def diagnose_v1(html: DataFrame, deep: bool = False) -> DataFrame:
    """The summary of each page's diagnosis: flags and bounded counts."""
    return diagnosis.doctor_summary(diagnosis.html_diagnose(html, deep))


def normalize_v1(docs: DataFrame) -> DataFrame:
    """Canonical texts; names (of a column name, if there is one) are cut to 160."""
    out = normalize(docs)
    return out.join(docs.select("doc_id", F.substring("name", 1, 160).alias("name")), "doc_id") if "name" in docs.columns else out
