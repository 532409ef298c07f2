"""Queue, expiry, quota and progress logic on streams, with batch twins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

#: operation: {state before: state after}; what is not listed changes nothing ("" is an unknown item)
MOVES = {"add": {"": "queued"}, "run": {"queued": "running"}, "success": {"running": "success"}, "error": {"running": "error"}, "cancel": {"queued": "canceled", "running": "canceled"}, "retry": {"error": "queued", "canceled": "queued"}}


def _folded(rows: DataFrame, key: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, dict], Iterator[tuple]], last: Callable[[Any], Iterator[tuple]] | None = None) -> DataFrame:
    """Rows of each key in order, folded as they stream by: a task holds one key's state, however many rows the key has.

    step and last give the rest of output rows, which begin with the key."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                now = tuple(row[k] for k in key)
                if now != at:
                    if at is not None and last:
                        out += [(*at, *x) for x in last(state)]
                    at, state = now, start()
                out += [(*at, *x) for x in step(state, row)]
            yield pd.DataFrame(out, columns=names)
        if at is not None and last:
            yield pd.DataFrame([(*at, *x) for x in last(state)], columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def queue_state(events: DataFrame) -> DataFrame:
    """Batch twin of queue_state_stream: the last state of each workflow's items, and how many operations moved it."""

    def step(state: list, row: dict) -> Iterator[tuple]:
        to = MOVES.get(row["op"], {}).get(state[0])
        if to is not None:
            state[:] = to, state[1] + 1
        return iter(())

    rows = events.select(F.col("workflow_id").cast("long").alias("workflow_id"), F.col("item_id").cast("long").alias("item_id"), "seq", "op")
    return _folded(rows, ["workflow_id", "item_id"], ["seq"], "workflow_id long, item_id long, state string, moves long", lambda: ["", 0], step, lambda s: iter([tuple(s)]))


def queue_state_stream(events: DataFrame) -> DataFrame:
    """The same machine on a stream: one row for each key of a batch with its state after it."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, moves = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for op in rows["op"]:
            to = MOVES.get(op, {}).get(now)
            if to is not None:
                now, moves = to, moves + 1
        state.update((now, moves))
        yield pd.DataFrame({"workflow_id": [key[0]], "item_id": [key[1]], "state": [now], "moves": [moves]})

    out = "workflow_id long, item_id long, state string, moves long"
    return events.groupBy("workflow_id", "item_id").applyInPandasWithState(advance, out, "state string, moves long", "update", GroupStateTimeout.NoTimeout)


def expire_state(records: DataFrame, now: Column) -> DataFrame:
    """Records with whether they are alive: they die at expires_at, a day after they were written by default."""
    return records.withColumn("alive", F.coalesce("expires_at", F.col("updated_at") + F.expr("INTERVAL 24 HOURS")) > now)


def drop_stale(events: DataFrame, key: str, generation: str) -> DataFrame:
    """Events of the newest generation met so far in their key, in order of seq."""
    newest = F.max(generation).over(Window.partitionBy(key).orderBy("seq"))
    return events.withColumn("newest", newest).where(F.col(generation) == F.col("newest")).drop("newest")


def drop_repeats_stream(events: DataFrame, ts: str, delay: str, *key: str) -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def reserve_quota(files: DataFrame, most_files: int = 20, most_bytes: int = 250 * 2**20) -> DataFrame:
    """Greedy admission in arrival order: a file that does not fit is passed over, later ones may still fit."""

    def step(state: list, row: dict) -> Iterator[tuple]:
        if state[0] < most_files and state[1] + row["size"] <= most_bytes:
            state[:] = state[0] + 1, state[1] + row["size"]
            yield (row["file_id"],)

    rows = files.select(F.col("workflow_id").cast("long").alias("workflow_id"), "seq", F.col("size").cast("long").alias("size"), F.col("file_id").cast("long").alias("file_id"))
    return _folded(rows, ["workflow_id"], ["seq", "size", "file_id"], "workflow_id long, file_id long", lambda: [0, 0], step)


def reserve_quota_stream(events: DataFrame, most_files: int = 20, most_bytes: int = 250 * 2**20) -> DataFrame:
    """The same on a stream of workflow_id, seq, file_id, size, op (reserve or release), with the state of each workflow kept: a released
    file makes room. One row for each reservation, with admitted."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, sizes = state.get if state.exists else ([], [])
        held = dict(zip(ids, sizes, strict=True))
        rows = pd.concat(list(batches)).sort_values(["seq", "size", "file_id"])
        out = []
        for op, file, size in zip(rows["op"], rows["file_id"].tolist(), rows["size"].tolist(), strict=True):
            if op == "release":
                held.pop(file, None)
                continue
            ok = file in held or (len(held) < most_files and sum(held.values()) + size <= most_bytes)
            if ok:
                held[file] = held.get(file, size)
            out.append((key[0], file, ok))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["workflow_id", "file_id", "admitted"])

    return events.groupBy("workflow_id").applyInPandasWithState(advance, "workflow_id long, file_id long, admitted boolean", "ids array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)


def newest_stream(events: DataFrame) -> DataFrame:
    """drop_stale on a stream of key, seq, generation: rows of the newest generation met so far in their key. A row that clears (generation null)
    starts a new epoch: what comes later must be of a newer generation than all before it."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, floor = state.get if state.exists else (-(1 << 62), -(1 << 62))
        out = []
        for seq, g in pd.concat(list(batches)).sort_values("seq")[["seq", "generation"]].itertuples(index=False):
            if pd.isna(g):
                floor = newest
            elif g >= newest and g > floor:
                newest = int(g)
                out.append((key[0], int(seq), newest))
        state.update((newest, floor))
        yield pd.DataFrame(out, columns=["key", "seq", "generation"])

    return events.groupBy("key").applyInPandasWithState(advance, "key long, seq long, generation long", "newest long, floor long", "append", GroupStateTimeout.NoTimeout)


class _Expiry(StatefulProcessor):
    """The record of one key, with a timer at its end: what nobody reads again leaves the state, too."""

    def __init__(self, now: str, hours: int) -> None:
        self.now, self.life = now, hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "value string, until long")

    def forget(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.record.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        value, until = self.record.get() if self.record.exists() else (None, None)
        out = []
        for at, _, op, new in pd.concat([r[[self.now, "seq", "op", "value"]] for r in rows]).sort_values([self.now, "seq"]).itertuples(index=False):
            moment = at.value // 1000
            if op == "write":
                value, until = new, moment + self.life
                continue
            if until is not None and until <= moment:
                value, until = None, None
            out.append((key[0], at, value))
        self.forget()
        if until is not None:
            self.record.update((value, until))
            self.handle.registerTimer(-(-until // 1000))  # timers are in milliseconds
        yield pd.DataFrame(out, columns=["key", self.now, "value"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def expire_stream(records: DataFrame, now: str = "ts", hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """Writes and reads of key on a stream (key, ts, seq, op: write or read, value), with the record of each key kept: a read gives its value, or
    null once it is as old as that. A record leaves the state when it is read after its end, or when the watermark passes that, whichever comes first.

    Needs the RocksDB state store, which keeps timers. A task holds the rows of one key of a micro-batch."""
    rows = records.select(F.col("key").cast("long").alias("key"), now, F.col("seq").cast("long").alias("seq"), "op", "value").withWatermark(now, delay)
    return rows.groupBy("key").transformWithStateInPandas(_Expiry(now, hours), f"key long, {now} timestamp, value string", "Append", "EventTime")


def progress_windows(events: DataFrame, ts: str = "ts", length: str = "1 hour", delay: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and errors by window, tumbling or, with slide, sliding; on a stream late rows within the delay still count."""
    late = events.withWatermark(ts, delay) if events.isStreaming else events
    n = late.groupBy(F.window(ts, length, slide or length).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return n.select(F.col("w.start").alias("begins"), "events", "errors")


def progress_sessions(events: DataFrame, *key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Events and errors of each key by session: events no further apart than the gap."""
    late = events.withWatermark(ts, delay) if events.isStreaming else events
    n = late.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return n.select(*key, F.col("w.start").alias("begins"), "events", "errors")


def progress_percent(events: DataFrame, *key: str) -> DataFrame:
    """The share of its pages that each key has done, in percent rounded half up: the furthest of its events (page, page_count)."""
    share = F.floor(100.0 * F.col("page") / F.nullif(F.col("page_count"), F.lit(0)) + 0.5)
    return events.groupBy(*key).agg(F.max(F.least(F.greatest(share, F.lit(0)), F.lit(100))).cast("long").alias("percent"))


def debounce(events: DataFrame, gap: str, *key: str) -> DataFrame:
    """Only the last event of each burst: one that no other follows within the gap."""
    after = F.lead("ts").over(Window.partitionBy(*key).orderBy("ts", "event_id"))
    return events.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") > F.col("ts") + F.expr(f"INTERVAL {gap}"))).drop("after")


def debounce_stream(events: DataFrame, gap: str, *key: str, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """debounce on a stream: a burst is a session whose events are no further apart than the gap, and gives its last event once the watermark has passed its end.
    Columns as they came. A burst that goes on in a later micro-batch is still one; what comes later than the delay is left out."""
    named = events.withWatermark(ts, delay) if events.isStreaming else events
    last = F.max_by(F.struct(*[F.col(c) for c in events.columns]), F.struct(F.col(ts), F.col("event_id"))).alias("last")
    return named.groupBy(*key, F.session_window(ts, f"{gap} 1 microsecond").alias("w")).agg(last).select("last.*")


def restore(items: DataFrame, steps: int) -> DataFrame:
    """What a restart reads back: running becomes canceled, steps are clamped, secrets are not carried."""
    return items.withColumn("status", F.when(F.col("status") == "running", "canceled").otherwise(F.col("status"))).withColumn("step", F.greatest(F.lit(0), F.least(F.lit(steps), F.col("step"))))


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path if "://" in path else f"file:{path}"), spark.sparkContext._jsc.hadoopConfiguration())


def restore_parameters(snapshot: DataFrame) -> DataFrame:
    """snapshot (step, params: a map of texts, and others) with what a restart may use: a stored parameter that the step does not have, or that breaks its rule, gives way to the
    step's default; secrets are dropped whatever they hold; an unknown step has no parameters."""
    from docspark.plans.recipes import usable_params

    return snapshot.withColumn("params", usable_params(F.col("step"), F.col("params"), SECRETS))


#: parameters that are never stored (fixed values)
SECRETS = ("password", "owner_password")


def new_part(path: str, part: str = "all") -> str:
    """A folder of its own for content of the table in path, which nothing reads until point_to names it."""
    return f"{path}/data/{part}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str, over: bool) -> None:
    """A small file in one move: over an old one, or only if there is none (FileAlreadyExistsException otherwise)."""
    jvm, fs = _file_system(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    folder, name = path.rsplit("/", 1)
    draft = at(f"{folder}/.{name}-{uuid.uuid4().hex}")
    fs.mkdir(at(folder), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    out = fs.create(draft, jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if over else rename.NONE
    try:
        fs.rename(draft, at(path), options)
    except Exception:
        fs.delete(draft, False)
        raise


def point_to(spark: SparkSession, path: str, folder: str, part: str = "all") -> None:
    """Makes a folder of new_part the content of a part of the table in path, in one move."""
    _put(spark, f"{path}/parts/{part}", folder.rsplit("/", 1)[-1], True)


def swap_in(df: DataFrame, path: str, part: str = "all") -> None:
    """df as the new content of a part of the table in path: it is written to a folder of its own, then a pointer is renamed over the part's old one.

    A write that fails, or is cut off, changes nothing that ``current`` reads."""
    folder = new_part(path, part)
    df.write.parquet(folder)
    point_to(df.sparkSession, path, folder, part)


class Conflict(Exception):
    """Someone else replaced the bundle since it was read."""


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, Any]) -> tuple[int, dict[str, DataFrame]]:
    """The newest version of a bundle of tables (0 and empty tables before the first), all as of one commit."""
    jvm, fs = _file_system(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    names = [f.getPath().getName() for f in fs.util().listStatus(at)] if fs.util().exists(at) else []
    version = max((int(n) for n in names if n.isdecimal()), default=0)
    if not version:
        return 0, {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    places = json.loads(spark.read.text(f"{path}/commits/{version:012d}", wholetext=True).first()[0])
    return version, {name: spark.read.schema(schema).parquet(places[name]) for name, schema in schemas.items()}


def commit_bundle(spark: SparkSession, path: str, version: int, tables: dict[str, DataFrame]) -> int:
    """The tables, in their order, as the version after ``version``: each is written to a folder of its own, then one file names them all. Readers see all of them or none. A write that
    fails leaves the old version; if another writer has committed since ``version`` was read, Conflict is raised and nothing changes."""
    places = {}
    for name, df in tables.items():
        places[name] = new_part(path, name)
        df.write.parquet(places[name])
    try:
        _put(spark, f"{path}/commits/{version + 1:012d}", json.dumps(places), False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"version {version + 1} is there already") from None
        raise
    return version + 1


def current(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """What the pointers of the table in path lead to."""
    names = [r[0] for r in spark.read.text(f"{path}/parts").collect()]  # one short line for each part
    return spark.read.schema(schema).parquet(*[f"{path}/data/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def idempotent_sink(path: str):  # noqa: ANN201 - for foreachBatch
    """Each batch is a part of the table in path, so that a batch that runs again replaces itself, and one that fails changes nothing."""
    return lambda batch, batch_id: swap_in(batch, path, f"batch-{batch_id}")


def newest_of(spark: SparkSession, path: str, schema: Any, *key: str) -> DataFrame:
    """Of a table that batches of an update-mode stream were stamped and written into: for each key its row of the newest batch."""
    whole = current(spark, path, StructType([*schema.fields, StructField("batch_id", LongType())]))
    others = [f.name for f in schema.fields if f.name not in key]
    newest = whole.groupBy(*key).agg(F.max_by(F.struct(*others), "batch_id").alias("r"))
    return newest.select(*key, "r.*").select(*schema.fieldNames())


def run_updates(stream: DataFrame, spark: SparkSession, folder: str, *key: str) -> DataFrame:
    """Runs an aggregation over what there is in update mode, through the idempotent sink, and reads the last row of each key."""
    sink = idempotent_sink(f"{folder}/out")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, i: sink(batch.withColumn("batch_id", F.lit(i).cast("long")), i)).start()
    q.awaitTermination()
    return newest_of(spark, f"{folder}/out", stream.schema, *key)


def run_available(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, through the idempotent sink, and reads the result."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(idempotent_sink(f"{folder}/out")).start()
    q.awaitTermination()
    return current(spark, f"{folder}/out", stream.schema)
