"""Operator 7: reply trees to formatted conversations.

Messages form trees by parent.  Self-joins double the reach of every node's
ancestor link until all have met their root, which gives each branch (a leaf
with its root) its summed score.  The chosen branches are then walked back by
the same links, from the longest to the shortest, so a path of n messages takes
log2(n) joins and n rows.  Each path is formatted as one conversation in one
row; those of several megabytes go on in further rows, so that none has to fit
in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolglass.llm.common import as_batch, cut_lineage, pieces

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def paths(messages: DataFrame, *, branches: int = 1, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """tree_id, branch (1 is best), node_id, depth (root 0) of the messages on each tree's best branches.

    A branch is a leaf with its ancestors; it ranks by the sum of its scores
    (null: zero), then by the leaf's id.  A parent that is null or not in its
    tree makes a root.  Of rows with the same tree and node the one with the
    smallest parent counts.  Messages on or below a cycle have no root and are
    left out.  A null tree id is a tree of its own; rows without a node id are
    left out.  No rows give no rows.
    """
    nodes = messages.filter(F.col(node).isNotNull()).groupBy(F.struct(F.col(tree)).alias("t"), F.col(node).alias("id"))
    nodes = nodes.agg(F.min(F.struct(F.col(parent).alias("up"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))).alias("x")).select("t", "id", "x.*")
    known = nodes.select("t", F.col("id").alias("up"), F.lit(True).alias("known"))
    nodes = cut_lineage(nodes.join(known, ["t", "up"], "left").select("t", "id", F.when(F.col("known"), F.col("up")).alias("up"), "score"))
    state = nodes.select("t", "id", "up", F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    links: list[DataFrame] = []
    left = (state.groupBy("t").count().agg(F.max("count")).first()[0] or 0) - 1
    while left > 0 and not (open_ones := state.filter("up is not null")).isEmpty():
        # Only nodes that have not met their root go on; those that have are what others meet.
        links.append(open_ones)
        far = state.select("t", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        met = open_ones.join(far, ["t", "up"]).select("t", "id", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = cut_lineage(state.filter("up is null").unionByName(met))
        left //= 2
    rooted = state.filter("up is null")
    leaves = rooted.join(nodes.filter("up is not null").select("t", F.col("up").alias("id")).distinct(), ["t", "id"], "left_anti")
    order = Window.partitionBy("t").orderBy(F.desc("sum"), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches).select("t", "branch", "id")
    for link in reversed(links):
        # One reference to what is chosen so far: the plan stays as long as the number of joins.
        both = chosen.join(link.select("t", "id", "up"), ["t", "id"], "left")
        chosen = both.select("t", "branch", F.explode(F.array("id", "up")).alias("id")).filter("id is not null")
    return chosen.join(rooted.select("t", "id", (F.col("steps") - 1).alias("depth")), ["t", "id"]).select(F.col(f"t.{tree}").alias("tree_id"), "branch", F.col("id").alias("node_id"), "depth")


def escaped(text: str) -> str:
    """No control string is left: ``<|`` becomes ``<\\|``, and every ``<\\...|`` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where the text under the loss mask starts and ends in it."""
    head = f"{START}{escaped(role).replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n')}\n"
    body = escaped(text)
    learned = role == LEARNED_ROLE
    return f"{head}{body}{STOP}\n", len(head) if learned else 0, len(head) + len(body) if learned else 0


def parsed_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation, or of a part that starts and ends with turns."""
    turns = []
    while formatted:
        stop = formatted.index(STOP)
        if not formatted.startswith(START) or formatted[stop + len(STOP)] != "\n":
            raise ValueError("not a formatted turn")
        role, _, text = formatted[len(START) : stop].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((unescaped(role), unescaped(text)))
        formatted = formatted[stop + len(STOP) + 1 :]
    return turns


#: Characters after which a conversation goes on in another row: nearly all are one row, none has to fit in memory.
PART_CHARS = 4 << 20

PART_SCHEMA = pa.schema(
    [("tree_id", pa.int64()), ("branch", pa.int32()), ("part", pa.int32()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string())]
    + [(n, pa.list_(pa.int64())) for n in ("mask_starts", "mask_ends")]
)
PART_DDL = "tree_id long, branch int, part int, last boolean, n_turns long, formatted string, mask_starts array<long>, mask_ends array<long>"


class Conversation:
    """One conversation as it grows, turn by turn; full parts are given away."""

    def __init__(self, key: tuple) -> None:
        self.key, self.part = key, 0
        self.clear()

    def clear(self) -> None:
        self.turns, self.starts, self.ends, self.size = [], [], [], 0

    def add(self, role: str, text: str) -> None:
        turn, start, end = formatted_turn(role, text)
        if end:
            self.starts.append(self.size + start)
            self.ends.append(self.size + end)
        self.turns.append(turn)
        self.size += len(turn)

    def row(self, last: bool) -> tuple:
        out = (*self.key, self.part, last, len(self.turns), "".join(self.turns), self.starts, self.ends)
        self.part += 1
        self.clear()
        return out


def format_conversations(messages: DataFrame, *, branches: int = 1, part_chars: int = PART_CHARS) -> DataFrame:
    """The chosen branches of ``messages`` (tree_id, node_id, parent_id, score, role, text), each as one conversation.

    One row for each conversation: tree_id, branch, n_turns, formatted, and the
    loss mask, which covers the code points of ``formatted`` from each of
    mask_starts to that of mask_ends.  A conversation of over ``part_chars``
    goes on in further rows, cut between turns: ``part`` counts them and
    ``last`` marks the final one.  Null roles and texts are empty; see
    ``paths`` for ids.  Other columns are not read.
    """
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = messages.groupBy(F.struct("tree_id").alias("t"), "node_id").agg(F.min(F.struct("parent_id", "role", "text")).alias("x"))
    rows = paths(messages, branches=branches).select(F.struct("tree_id").alias("t"), "branch", "node_id", "depth").join(texts, ["t", "node_id"])
    rows = rows.select(F.col("t.tree_id").alias("tree_id"), "branch", "depth", F.coalesce("x.role", F.lit("")).alias("role"), F.coalesce("x.text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for batch in pieces(batches):
            for tree, branch, role, text in zip(*(batch.column(c).to_pylist() for c in ("tree_id", "branch", "role", "text")), strict=True):
                if now is None or now.key != (tree, branch):
                    if now is not None:
                        out.append(now.row(True))
                    now = Conversation((tree, branch))
                elif now.size > part_chars:
                    out.append(now.row(False))
                now.add(role, text)
                size += len(text)
            if size > part_chars and out:
                yield as_batch(out, PART_SCHEMA)
                out, size = [], 0
        if now is not None:
            yield as_batch([*out, now.row(True)], PART_SCHEMA)

    return rows.repartition(n, "tree_id", "branch").sortWithinPartitions("tree_id", "branch", "depth").mapInArrow(run, PART_DDL)


DIGESTS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("branch", pa.int32()), *DIGESTS])
DIGEST_DDL = "conv_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Reading:
    """What the parts of a conversation say, read in order."""

    def __init__(self, key: tuple) -> None:
        self.key, self.n, self.chars, self.size, self.said, self.learned = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in parsed_turns(formatted):
            self.n += 1
            self.said.update(f"{role}\n{text}\n".encode())
        for a, b in zip(starts, ends, strict=True):
            masked = unescaped(formatted[a:b])
            self.learned.update(masked.encode())
            self.chars += len(masked)
        self.size += len(formatted)

    def row(self) -> tuple:
        return (*self.key, self.n, self.said.hexdigest(), self.chars, self.learned.hexdigest(), self.size)


def read_back(conversations: DataFrame) -> DataFrame:
    """Parse formatted conversations, in whatever order their rows are; one row of digests for each.

    Conversations in one row are read where they are; only the parts of longer
    ones are brought together and sorted.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = ("part", "formatted", "mask_starts", "mask_ends")
    first_schema = pa.schema([*DIGEST_SCHEMA, *(PART_SCHEMA.field(c) for c in left)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "formatted"):
            rows = []
            for tree, branch, part, last, _, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in PART_SCHEMA.names), strict=True):
                if part or not last:
                    rows.append((tree, branch, *[None] * len(DIGESTS), part, formatted, starts, ends))
                    continue
                reading = Reading((tree, branch))
                reading.add(formatted, starts, ends)
                rows.append((*reading.row(), *[None] * len(left)))
            yield as_batch(rows, first_schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in pieces(batches, "formatted"):
            for tree, branch, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "branch", *left[1:])), strict=True):
                if now is None or now.key != (tree, branch):
                    out += [] if now is None else [now.row()]
                    now = Reading((tree, branch))
                now.add(formatted, starts, ends)
        if now is not None:
            yield as_batch([*out, now.row()], DIGEST_SCHEMA)

    # Written once: the digests are small, and the parts of very long conversations few.
    read = cut_lineage(conversations.mapInArrow(whole, f"{DIGEST_DDL}, part int, formatted string, mask_starts array<long>, mask_ends array<long>"))
    split = read.filter("formatted is not null").repartition(n, "conv_id", "branch").sortWithinPartitions("conv_id", "branch", "part")
    found = read.filter("formatted is null").select(*DIGEST_SCHEMA.names).unionByName(split.mapInArrow(parts, DIGEST_DDL))
    return found.drop("branch")


def as_reply_chain(conversations: DataFrame) -> DataFrame:
    """Messages of conversations given by turn: each replies to the one before it (ties by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")
