"""Files in workflows: references, expiry, names, queues, dictionaries (A9-A11, C1, C3-C7, C9, C12, C14, D5, D9, D10, D22, E5, E10, E12, E13, F2, F5-F7, G2, G5, G6, K1, K10-K12, K16-K18)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.columns import half_up
from docspark.streaming import queues

DAY = "INTERVAL 24 HOURS"


def resolve_refs(workflows: DataFrame, files: DataFrame) -> DataFrame:
    """workflow_id, position, file_id and the file's columns; missing files dropped; running becomes canceled."""
    refs = workflows.select("workflow_id", F.posexplode("file_refs").alias("position", "file_id"))
    found = refs.join(files.drop("workflow_id"), "file_id")
    return found.withColumn("status", F.when(F.col("status") == "running", "canceled").otherwise(F.col("status")))


def _listed(workflows: DataFrame) -> DataFrame:
    """workflow_id, file_id, listed: one row for each reference."""
    return workflows.select("workflow_id", F.explode("file_refs").alias("file_id")).distinct().withColumn("listed", F.lit(True))


def orphan_files(workflows: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Files to remove: the owner expired; or there is none and the file expired; or the owner lives, does not refer to it, and it expired.

    References are joined by (workflow_id, file_id), so no file carries its owner's whole list. An owner without expires_at lives."""
    expired = F.coalesce(F.col("expires_at"), F.col("updated_at") + F.expr(DAY)) <= now
    owners = workflows.select("workflow_id", F.col("expires_at").alias("owner_until"), F.lit(True).alias("owned"))
    both = files.join(owners, "workflow_id", "left").join(_listed(workflows), ["workflow_id", "file_id"], "left")
    reason = F.when(F.col("owner_until") <= now, "owner expired").when(F.col("owned").isNull() & expired, "no owner").when(F.col("owned") & F.col("listed").isNull() & expired, "unreferenced")
    return both.withColumn("reason", reason).where("reason is not null").select("file_id", "workflow_id", "reason")


def stage_handoff(outputs: DataFrame, now: Column) -> DataFrame:
    """Outputs of a step (workflow_id, file_id, ...) as staged files: stamped, and expiring a day later."""
    blank = [c for c in ("created_at", "expires_at") if c not in outputs.columns]
    return stamp_ttl(outputs.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in blank}), now)


def take_handoff(workflows: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Staged files that may be taken: the workflow lives, lists the file, and owns it. Nothing is deleted."""
    live = workflows.where(F.col("expires_at") > now).select("workflow_id")
    return files.join(live, "workflow_id").join(_listed(workflows).drop("listed"), ["workflow_id", "file_id"], "left_semi")


def archive_manifest(entries: DataFrame) -> DataFrame:
    """archive, entry_no, name, size, and the byte offset of each entry's header (30 bytes and the name before the content); of
    entries with content (bytes) also its CRC-32."""
    if "content" in entries.columns:
        entries = entries.withColumn("crc32", F.crc32("content")).drop("content")
    before = Window.partitionBy("archive").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(30 + F.octet_length("name") + F.col("size")).over(before), F.lit(0)).cast("long"))


def upsert_bundle(old: DataFrame, new: DataFrame, owner: str = "workflow_id") -> DataFrame:
    """The file table after the owners in new are replaced: their old files go, all others stay."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def replace_bundle(spark: SparkSession, path: str, workflows: DataFrame, files: DataFrame, owner: str = "workflow_id") -> int:
    """The owners in workflows (in files only those have rows) replaced together with their files, in one commit: their old files go unless they are in files, all other owners
    and files stay, and the owners' table is written last. Gives the new version; a failure, or a writer in between (Conflict), changes nothing."""
    version, old = queues.read_bundle(spark, path, {"files": files.schema, "workflows": workflows.schema})
    mine = files.join(workflows.select(owner).distinct(), owner, "left_semi").select(*files.columns)
    named = workflows.select(owner).distinct()
    kept = {name: old[name].join(named, owner, "left_anti").select(*df.columns).unionByName(df) for name, df in (("files", mine), ("workflows", workflows))}
    return queues.commit_bundle(spark, path, version, kept)


def page_totals(files: DataFrame, by: str) -> DataFrame:
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """percent saved, rounded half up; null text for those that did not shrink."""
    saved = half_up((1 - F.col(after) / F.col(before)) * 100).cast("long")
    return df.withColumn("percent", saved).withColumn("note", F.when(saved <= 0, "did not shrink"))


def status_rollup(items: DataFrame) -> DataFrame:
    """Counts by workflow and status, with a row for each workflow's total (status null), and which states a workflow has."""
    n = items.rollup("workflow_id", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    has = lambda s: F.max(F.coalesce(F.col("status") == s, F.lit(False))).over(Window.partitionBy("workflow_id")).alias(f"has_{s}")
    return n.where("g <= 1").select("workflow_id", "status", "n", has("queued"), has("running"), has("success"))


def current_step(items: DataFrame) -> DataFrame:
    return items.groupBy("workflow_id").agg(F.greatest(F.max("step"), F.lit(0)).alias("step"))


def allocate_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Unique output names in each workflow, regardless of case: the first keeps its name, later ones get -2, -3, ...,
    passing over names that are taken.

    Numbering by a window is right unless a suffixed name meets somebody's own name. Only the workflows where that
    happens are named one file after the other, in tasks by workflow.
    """
    stem, ext = F.regexp_replace(name, r"\.[^.]*\z", ""), F.regexp_extract(name, r"(\.[^.]*)\z", 1)
    by = Window.partitionBy("workflow_id", F.lower(name)).orderBy("seq")
    ranked = files.withColumn("k", F.row_number().over(by))
    named = ranked.withColumn("unique_name", F.when(F.col("k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("k").cast("string"), ext))).drop("k")
    clash = named.groupBy("workflow_id", F.lower("unique_name").alias("u")).agg(F.count("*").alias("n")).where("n > 1").select("workflow_id").distinct()

    def one_by_one(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        group = group.sort_values("seq")
        for own in group[name]:
            base, dot, tail = own.rpartition(".")
            base, tail = (base, dot + tail) if dot else (own, "")
            new, k = own, 1
            while new.lower() in taken:
                k += 1
                new = f"{base}-{k}{tail}"
            taken.add(new.lower())
            out.append(new)
        return group.assign(unique_name=out)

    again = named.join(clash, "workflow_id", "left_semi").groupBy("workflow_id").applyInPandas(one_by_one, named.schema)
    return named.join(clash, "workflow_id", "left_anti").unionByName(again)


def swap_neighbour(items: DataFrame, id_: Column, delta: int) -> DataFrame:
    """Positions after the item that id_ marks is swapped with the one delta (1 or -1) away; an edge changes nothing."""
    by = Window.partitionBy("workflow_id").orderBy("seq")
    near = F.lag(id_, 1, False).over(by) if delta > 0 else F.lead(id_, 1, False).over(by)
    there, here = (F.lead("seq").over(by), F.lag("seq").over(by))[:: 1 if delta > 0 else -1]  # the neighbours' own places, gaps or not
    return items.withColumn("new_seq", F.when(id_, F.coalesce(there, F.col("seq"))).when(near, here).otherwise(F.col("seq")).cast("long"))


def latest_generation(updates: DataFrame, key: list[str], order: str) -> DataFrame:
    return updates.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("k = 1").drop("k")


def position_labels(items: DataFrame, by: str, order: str) -> DataFrame:
    return items.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy(by)))


def bounded_list(items: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key; truncated tells whether there were more."""
    return position_labels(items, by, order).where(F.col("position") <= n).withColumn("truncated", F.col("total") > n)


def next_queued(items: DataFrame) -> DataFrame:
    return items.where("status = 'queued'").groupBy("workflow_id").agg(F.min_by("file_id", "seq").alias("file_id"))


def search_rows(df: DataFrame, query: str, *columns: str) -> DataFrame:
    q = query.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q))) if q else df


def search_top(df: DataFrame, query: str, order: str, limit: int, *columns: str) -> DataFrame:
    """The first matches in catalogue order with the count of all."""
    found = search_rows(df, query, *columns)
    n = found.agg(F.count("*").alias("matches"))
    return found.orderBy(order).limit(max(1, min(limit, 10))).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("matches") > limit)


def popular_first(catalogue: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The entries of a short fixed list, in its order; names that the catalogue lacks are skipped."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(key))
    return catalogue.withColumn("position", place).where("position > 0").orderBy("position")


def missing_keys(required: DataFrame, dictionary: DataFrame, locales: DataFrame) -> DataFrame:
    """(locale, key) that are required but absent or empty. locales is a list of codes, and keys x locales is the answer's own size."""
    wanted = required.select("key").distinct().crossJoin(locales)
    return wanted.join(dictionary.where("value <> ''").select("locale", "key"), ["locale", "key"], "left_anti")


def lookup_translation(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """keys: locale, key, english. The entry of the locale, else the English text."""
    named = dictionary.where("value <> ''").select("locale", "key", "value")
    return keys.join(named, ["locale", "key"], "left").withColumn("text", F.coalesce("value", "english")).drop("value")


def add_missing(dictionary: DataFrame, entries: DataFrame) -> DataFrame:
    """The dictionary with the entries whose (locale, key) it lacks; nothing is overwritten."""
    return dictionary.unionByName(entries.join(dictionary, ["locale", "key"], "left_anti"))


def expand_locales(pages: DataFrame, locales: DataFrame, base: str, listed: DataFrame | None = None) -> DataFrame:
    """A URL of each page in each locale (en at the root), with its alternates: every locale's URL, and x-default, the English one.

    Pages (slug) of listed are there already and are skipped. The answer has pages times locales rows."""
    if listed is not None:
        pages = pages.join(listed.select("slug").distinct(), "slug", "left_anti")
    lang = F.when(F.col("locale") == "en", "").otherwise(F.concat(F.lit("/"), F.col("locale")))
    url = F.concat(F.lit(base), lang, F.lit("/"), F.col("slug"))
    each = pages.crossJoin(locales).withColumn("url", url)
    of = F.collect_list(F.struct("locale", "url")).over(Window.partitionBy("slug"))  # as long as the list of locales
    fallback = F.struct(F.lit("x-default").alias("locale"), F.concat(F.lit(base + "/"), F.col("slug")).alias("url"))
    return each.withColumn("alternates", F.concat(F.array_sort(of), F.array(fallback)))


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that only one side has."""
    return a.exceptAll(b).withColumn("side", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def toggle_set(clicks: DataFrame, *key: str) -> DataFrame:
    return clicks.groupBy(*key).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*key)


def recommend(goals: DataFrame, recipes: dict[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in recipes.items() for x in kv])
    return goals.withColumn("recipe", F.try_element_at(table, F.col("goal"))).withColumn("known", F.col("recipe").isNotNull())


def changed_categories(before: DataFrame, after: DataFrame, categories: list[str], selected: list[str]) -> DataFrame:
    """(page_id, category) whose value changed though the category was not selected for cleaning. Nulls are equal."""
    long = lambda df: df.select("page_id", F.explode(F.create_map(*[x for c in categories for x in (F.lit(c), F.col(c).cast("string"))])).alias("category", "value"))
    both = long(before).alias("a").join(long(after).alias("b"), ["page_id", "category"])
    return both.where(~F.col("a.value").eqNullSafe(F.col("b.value")) & ~F.col("category").isin(selected)).select("page_id", "category")


def fill_form(fields: DataFrame, values: DataFrame) -> DataFrame:
    """fields: name, kind, options; values: name, value. What each field ends with; a value that is no option is skipped."""
    both = fields.join(values, "name", "left")
    known = F.col("kind").isin("text", "checkbox", "dropdown", "radio", "optionlist")
    choice = F.col("kind").isin("dropdown", "radio", "optionlist")
    ok = known & F.col("value").isNotNull() & (~choice | F.array_contains("options", F.col("value")))
    return both.withColumn("state", F.when(~known, "unknown kind").when(F.col("value").isNull(), "empty").when(ok, "filled").otherwise("rejected")).withColumn("filled", F.when(ok, F.col("value"))).drop("value", "options")


def replace_all(df: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Literal replacements, in order."""
    return df.withColumn(column, reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, F.col(column)))


def migration_check(df: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows that the rewrite would still change."""
    return replace_all(df.withColumn("after", F.col(column)), "after", rules).where(~F.col(column).eqNullSafe(F.col("after"))).drop("after")


def compose_copy(dictionary: DataFrame, first: Column, second: Column) -> DataFrame:
    """New entries made of two others of the same locale."""
    pick = lambda c: F.max(F.when(c, F.col("value")))
    both = dictionary.groupBy("locale").agg(pick(first).alias("a"), pick(second).alias("b"))
    return both.select("locale", F.trim(F.concat_ws(" ", "a", "b")).alias("value"))


def stamp_ttl(df: DataFrame, now: Column, version: int = 1) -> DataFrame:
    """created kept if set, updated is now, expires a day later unless set, and the version of the manifest."""
    return df.withColumns({"created_at": F.coalesce("created_at", now), "updated_at": now, "expires_at": F.coalesce("expires_at", now + F.expr(DAY)), "version": F.lit(version)})


def matches_list(items: DataFrame, by: str, order: str, value: str, wanted: list[str]) -> DataFrame:
    """by, matches: whether the values of a key are the wanted ones, in order. Only counts are kept of a key, however many rows it has."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    right = F.coalesce(F.try_element_at(F.array(*map(F.lit, wanted)), F.least(F.col("k"), F.lit(len(wanted)))) == F.col(value), F.lit(False))
    return items.withColumn("k", place).groupBy(by).agg(((F.count("*") == len(wanted)) & (F.count_if(right) == len(wanted))).alias("matches"))


def budget_check(assets: DataFrame, most_bytes: int = 100_000, most_requests: int = 16) -> DataFrame:
    """Routes whose distinct assets weigh too much, or that make too many requests. assets: route, asset, bytes, requests."""
    size = assets.select("route", "asset", "bytes").distinct().groupBy("route").agg(F.sum("bytes").alias("bytes"))
    made = assets.groupBy("route").agg(F.max("requests").alias("requests"))
    return size.join(made, "route").where((F.col("bytes") >= most_bytes) | (F.col("requests") > most_requests))


def allowlist_check(actual: DataFrame, allowed: DataFrame) -> DataFrame:
    """name, problem: unexpected, missing or stale (other content)."""
    a, b = actual.select("name", F.sha2("content", 256).alias("is")), allowed.select("name", F.sha2("content", 256).alias("should"))
    both = a.join(b, "name", "full")
    return both.withColumn("problem", F.when(F.col("should").isNull(), "unexpected").when(F.col("is").isNull(), "missing").when(F.col("is") != F.col("should"), "stale")).where("problem is not null").select("name", "problem")
