"""Chat formatting over reply trees.

Messages name the message they answer. Self-joins enumerate the root-to-leaf paths: each round joins every message's
pointer with the pointer of where it points, so a path of any length takes as many rounds as its length has binary digits.
Leaves are ranked per conversation by the mean score of their path; each chosen leaf's ancestors come back by the same
pointers, and its path is formatted as one conversation, with the places of what the assistant says as the loss mask.

A turn is `<s>[INST]…[/INST]` (user), `…</s>` (assistant), `<<SYS>>…<</SYS>>` (system) or `[ROLE]…[/ROLE]…[END]` (any other
role). In texts and roles a backslash goes before `\\`, `<` and `[`, so nothing in them reads as a mark, and taking it away
gives the text back.

Null texts and roles are empty; a null conversation is one of its own; rows without a turn come first; rows of one turn are
in order of role and text; repeated rows of a list are turns each. A message whose parent is missing is a root. Messages on a
cycle have no root and no path. Of messages with one conversation and node the first by parent, role, text and score counts.
Branches that tie by score go by length, longest first, then by node. A conversation, however long its texts, is one row. An
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_BODY = r"((?:[^\\<\[]+|\\.)*)"
_TURN = re.compile(rf"<s>\[INST\]{_BODY}\[/INST\]|<<SYS>>{_BODY}<</SYS>>|\[ROLE\]{_BODY}\[/ROLE\]{_BODY}\[END\]|{_BODY}</s>", re.DOTALL)
_MARKS = {"user": ("<s>[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of conversations that are lists of turns: each answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Messages of the `keep` best paths of each conversation: conv_id, branch (from 1), depth (from 1), role, text.

    `messages`: conv_id, node (unique in its conversation), parent or null, role, text, score or null.
    """
    rows = messages.select("conv_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("conv_id", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("conv_id", "node", "m.*")
    rows = cut(rows)
    nodes = rows.select("conv_id", F.col("node").alias("known"))
    a, b = rows.alias("a"), nodes.alias("b")
    jump = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.parent") == F.col("b.known")), "left").select("a.conv_id", "node", F.col("known").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    jumps, rounds = [cut(jump)], rows.count().bit_length()  # no path is longer than all messages; cycles end here too
    while True:
        still = jumps[-1].where("to IS NOT NULL")
        if len(jumps) > rounds or still.isEmpty():
            break
        a, b = still.alias("a"), jumps[-1].alias("b")
        moved = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.to") == F.col("b.node"))).select("a.conv_id", "a.node", "b.to", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total"))
        jumps.append(cut(jumps[-1].where("to IS NULL").unionByName(moved)))
    ends = jumps[-1].where("to IS NULL")
    parents = jumps[0].where("to IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("to").alias("answered")).distinct()
    leaves = ends.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("answered")), "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")
    members = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= keep).select("conv_id", "branch", "node")
    for level in reversed(jumps):
        a, b = members.alias("a"), level.where("to IS NOT NULL").alias("b")
        members = cut(members.unionByName(a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.node") == F.col("b.node"))).select("a.conv_id", "branch", F.col("b.to").alias("node"))))
    a, b, c = members.alias("a"), ends.alias("b"), rows.alias("c")
    at = lambda x: F.col("a.conv_id").eqNullSafe(F.col(f"{x}.conv_id")) & (F.col("a.node") == F.col(f"{x}.node"))
    return a.join(b, at("b")).join(c, at("c")).select("a.conv_id", "branch", F.col("steps").alias("depth"), "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: conv_id, branch, formatted, and the loss mask as begins and ends in code points."""
    whole = paths.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", "branch", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns(zip(r, t)) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([[s[0] for s in m[1]] for m in made], pa.list_(pa.int32())), pa.array([[s[1] for s in m[1]] for m in made], pa.list_(pa.int32()))], names=["conv_id", "branch", "formatted", "loss_begins", "loss_ends"])

    return whole.mapInArrow(run, "conv_id long, branch int, formatted string, loss_begins array<int>, loss_ends array<int>")


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    out, loss, at = [], [], 0
    for role, text in turns:
        body = _ESCAPE.sub(r"\\\g<0>", text)
        before, after = _MARKS.get(role) or ("[ROLE]" + _ESCAPE.sub(r"\\\g<0>", role) + "[/ROLE]", "[END]")
        if role == "assistant":
            loss.append((at, at + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; the inverse of `format_turns`."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, system, role, text, assistant = (x if x is None else _UNESCAPE.sub(r"\1", x) for x in m.groups())
        out.append(("user", user) if user is not None else ("system", system) if system is not None else (role, text) if role is not None else ("assistant", assistant))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted texts and masks say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, begins, ends in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse_turns(text)
                loss = "".join(_UNESCAPE.sub(r"\1", text[a:b]) for a, b in zip(begins, ends))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.select("conv_id", "formatted", "loss_begins", "loss_ends").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
