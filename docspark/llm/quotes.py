"""Quotation linking: messages that quote each other in lines with ``>`` become reply-ordered conversations.

A line's quote level is the number of ``>`` before its text (spaces between are allowed). A passage is a run of lines
of one level between blank lines; its normalised form (lower case, white space runs to one space, trimmed) is hashed to 128
bits. Lines of level 0 are a message's own words; the passage of all of a message's own lines, and each of its paragraphs,
can be quoted. A quoted passage of any level links to the first earlier message of its conversation that wrote it; one of at least
``ELSEWHERE`` words that nobody wrote there links to the first message of all earlier conversations (by conv_id,
then turn) that did. Messages are parsed row by row in one pass; only hashes of passages are shuffled.

A message answers the latest message found at the least level that links (its own conversation first), or nobody: where what it
answers is gone or was edited, what that had quoted still places it. Answers always lead to an earlier (conv_id,
turn), so there are no cycles. ``thread`` (with ``thread_conv``) is the first message reached by answers,
``depth`` the answers up to it; (thread_conv, thread, depth, conv_id, turn) is an order in which every answer comes after
what it answers. Chains are followed by doubling: each round joins the answers to themselves, so a chain of n
messages takes log2 n rounds on tables in the shared folder. One conversation may hold any share of all rows: joins go
by conversation and passage or turn, nothing collects a conversation.

Defined cases: a null text is an empty message; rows with a null conv_id or turn stay, answer nobody and are answered
by nobody; of rows with equal conv_id and turn each is kept, and the turn stands for all; blank passages link nothing;
a long message is parsed whole, one at a time in memory; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import kept, text_rows

ELSEWHERE = 8
_MARKS = re.compile(r"(?:[ \t]*>)+")
_BREAK = re.compile(r"\r?\n")
_SPACES = " \t\n\v\f\r"


def parse(text: str) -> tuple[str, list[tuple[int, int, bytes]]]:
    """The message's own text, and (level, words, hash) of its passages."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    before = None  # level of the line before; None after a blank one
    for line in _BREAK.split(text):
        marks = _MARKS.match(line)
        level = marks[0].count(">") if marks else 0
        said = line[marks.end() :] if marks else line
        said = said[1:] if marks and said[:1] in (" ", "\t") else said
        if not level:
            own.append(said)
        if not said.strip(_SPACES):
            before = None
            continue
        if level != before:
            runs.append((level, []))
        runs[-1][1].append(said)
        before = level
    out = []
    for level, lines in [*runs, (0, own)]:
        words = " ".join(lines).lower().translate(_TO_SPACE).split(" ")
        words = [w for w in words if w]
        if words:
            out.append((level, len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
    return "\n".join(own).strip("\n"), out


_TO_SPACE = str.maketrans(dict.fromkeys(_SPACES, " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), passages (array of level, words, hash) of each message."""
    passage = pa.list_(pa.struct([("level", pa.int32()), ("words", pa.int32()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse((t or b"").decode("utf-8", "replace")) for t in text_rows(b)]
            parts = [[{"level": x, "words": n, "hash": h} for x, n, h in p] for _, p in found]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([own for own, _ in found], pa.string()), pa.array(parts, passage)], names=["conv_id", "turn", "role", "own", "passages"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, own string, passages array<struct<level:int,words:int,hash:binary>>")


def _links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_conv, reply_to, n_quotes, n_nested of the messages that answer one."""
    found = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    wrote = found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("at"), F.max("words").alias("words"))
    quoted = found.where("level > 0").distinct()
    here = kept(quoted.join(wrote.drop("words"), ["conv_id", "hash"], "left").withColumn("at", F.when(F.col("at") < F.col("turn"), F.col("at"))), "quoted")
    first = wrote.where(F.col("words") >= ELSEWHERE).groupBy("hash").agg(F.min(F.struct("conv_id", "at")).alias("w"))
    there = here.where(F.col("at").isNull() & (F.col("words") >= ELSEWHERE)).drop("at").join(first, "hash").where("w.conv_id < conv_id")
    links = here.where("at is not null").select("conv_id", "turn", "level", F.col("conv_id").alias("reply_conv"), F.col("at").alias("reply_to"))
    links = links.unionByName(there.select("conv_id", "turn", "level", F.col("w.conv_id").alias("reply_conv"), F.col("w.at").alias("reply_to")))
    best = F.min_by(F.struct("reply_conv", "reply_to"), F.struct(F.col("level"), (F.col("reply_conv") != F.col("conv_id")).alias("away"), (-F.col("reply_conv")).alias("c"), (-F.col("reply_to")).alias("t")))
    direct = F.col("level") == 1
    return links.groupBy("conv_id", "turn").agg(best.alias("r"), F.count_if(direct).alias("n_quotes"), F.count_if(~direct).alias("n_nested")).select("conv_id", "turn", "r.*", "n_quotes", "n_nested")


def linked_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_conv, reply_to, thread_conv, thread, depth, n_quotes (linked passages of level 1), n_nested (of deeper ones), own_text."""
    df = kept(parsed(messages), "messages")
    links = kept(_links(df), "replies")
    up = links.select("conv_id", "turn", F.col("reply_conv").alias("top_conv"), F.col("reply_to").alias("top"), F.lit(1).cast("long").alias("depth"))
    while True:  # after k rounds top is 2^k answers up, or the end of the chain
        further = up.select(F.col("conv_id").alias("top_conv"), F.col("turn").alias("top"), F.struct("top_conv", "top").alias("next"), F.col("depth").alias("more"))
        step = kept(up.join(further, ["top_conv", "top"], "left"), "chains")
        if step.where("next is not null").isEmpty():
            break
        up = step.select("conv_id", "turn", F.coalesce("next.top_conv", "top_conv").alias("top_conv"), F.coalesce("next.top", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    placed = links.join(up, ["conv_id", "turn"])
    out = df.drop("passages").join(placed, ["conv_id", "turn"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    thread = F.coalesce("top_conv", "conv_id").alias("thread_conv"), F.coalesce("top", "turn").alias("thread")
    return out.select("conv_id", "turn", "role", "reply_conv", "reply_to", *thread, count("depth"), count("n_quotes"), count("n_nested"), F.col("own").alias("own_text"))


def as_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each message from the third on quotes the one before the last, which quotes the one two before it.

    Every row stays. Of rows with equal conv_id and turn the least (role, text) is the one that is quoted."""
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = c.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    earlier = lambda k, name: said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("m.text").alias(name))
    quoted = lambda col, mark: F.concat(F.lit(mark), F.replace(F.col(col), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    both = c.join(earlier(2, "a"), ["conv_id", "turn"], "left").join(earlier(4, "b"), ["conv_id", "turn"], "left")
    head = F.concat(F.when(F.col("b").isNotNull(), quoted("b", ">> ")).otherwise(""), F.when(F.col("a").isNotNull(), quoted("a", "> ")).otherwise(""))
    return both.select("conv_id", "turn", "role", F.concat(head, F.col("text")).alias("text"))
