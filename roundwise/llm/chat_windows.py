"""Chat formatting in budgeted windows.

Turns are rendered one by one, their tokens summed by prefix, and cut at turn borders
into windows: each holds the system turn, some repeated history for context and the new
turns of its span. Only assistant texts of new turns are under the loss mask; repeated
turns are masked, so every assistant text is a target exactly once.

Prefix sums take two levels (turns within blocks of turns, then blocks), and a window is
built from the turns of one span only, so a conversation of any length is spread over
many tasks. A window keeps within the budget unless a single turn with the system turn
exceeds it; such a window holds that one new turn and no history.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is put
into every ``<|`` (behind the ``<``, before backslashes already there), and line feeds and
backslashes of roles are written ``\\n`` and ``\\\\``; both are undone on reading.

Defined cases: null role and text are empty; turns are ordered by (turn, role, text), a
missing turn number first; repeated rows are turns of their own; a missing conv_id is a
conversation like any other; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundwise.llm.shared import partitions, slices

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 512
HISTORY = 128
FRAME_TOKENS = 4
BLOCK_TURNS = 256
WINDOWS_AT_ONCE = 256
WINDOW_SCHEMA = (
    "conv_id long, span long, piece int, formatted string, n_tokens long, n_context int, n_new int, "
    "loss array<struct<start: int, stop: int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text starts and stops."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, text = piece.removesuffix(END).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def turn_tokens(text: Column) -> Column:
    """Words of a text plus the tokens of its frame."""
    words = F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))
    return (words + F.lit(FRAME_TOKENS)).cast("long")


def placed_turns(conversations: DataFrame, stride: int, history: int) -> DataFrame:
    """Every turn with its span, once as a new turn and, near the end of a span, once more
    as possible history of the next span; ``system`` is the text of a leading system turn."""
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), turn_tokens(text).alias("n"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    local = turns.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.min(F.struct("turn", "role", "text", "n")).alias("head"))
    over = Window.partitionBy("conv_id").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("head").over(over)
    offsets = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.when(first["role"] == "system", first["text"]).alias("system"), F.when(first["role"] == "system", first["n"]).otherwise(0).alias("system_n"),
    )
    placed = local.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    placed = placed.select("conv_id", "role", "text", "n", (F.col("rows_before") + F.col("place")).alias("place"), (F.col("tokens_before") + F.col("upto") - F.col("system_n")).alias("upto"), "system", "system_n")
    span = F.greatest(F.lit(0), F.floor((F.col("upto") - 1) / stride)).cast("long")
    copies = F.array(F.struct(span.alias("span"), F.lit(False).alias("repeated")))
    late = F.array(F.struct((span + 1).alias("span"), F.lit(True).alias("repeated")))
    is_system = F.col("system").isNotNull() & (F.col("place") == 1)
    again = (F.col("upto") > (span + 1) * stride - history) & ~is_system
    return placed.withColumn("copy", F.explode(F.when(again, F.concat(copies, late)).otherwise(copies))).select("*", "copy.*").drop("copy")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows: conv_id, span and piece (their order), text, tokens, number of
    context and new turns, and the loss mask as code-point intervals."""
    stride = budget - history
    if stride <= history:
        raise ValueError("the history must be less than half of the budget")

    def packed(group: list[dict]) -> Iterator[tuple]:
        """The windows of one span: its turns in order, possible history first."""
        head = group[0]
        leading = [] if head["system"] is None else [("system", head["system"], head["system_n"])]
        at = sum(t["repeated"] for t in group)
        piece = 0
        while at < len(group):
            context = [] if leading and group[at]["place"] == 1 else list(leading)
            used = sum(n for _, _, n in context)
            stop = at
            while stop < len(group) and (stop == at or used + group[stop]["n"] <= budget):
                used += group[stop]["n"]
                stop += 1
            past, spent = [], 0
            for t in reversed(group[:at]):
                if (leading and t["place"] == 1) or spent + t["n"] > history or used + t["n"] > budget:
                    break
                past.append((t["role"], t["text"], t["n"]))
                spent, used = spent + t["n"], used + t["n"]
            context += reversed(past)
            parts, loss, length = [], [], 0
            for k, (role, body) in enumerate([(r, t) for r, t, _ in context] + [(t["role"], t["text"]) for t in group[at:stop]]):
                text, start, end = render(role, body)
                if k >= len(context) and role == "assistant":
                    loss.append({"start": length + start, "stop": length + end})
                parts.append(text)
                length += len(text)
            yield head["conv_id"], head["span"], piece, "".join(parts), used, len(context), stop - at, loss
            at, piece = stop, piece + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (dict(zip(rows, values, strict=True)) for rows in slices(batches) for values in zip(*rows.values(), strict=True))
        held: list[tuple] = []
        for _, group in itertools.groupby(turns, key=lambda t: (t["conv_id"], t["span"])):
            held.extend(packed(list(group)))
            if len(held) >= WINDOWS_AT_ONCE:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "span", "piece", "formatted", "n_tokens", "n_context", "n_new", "loss"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    placed = placed_turns(conversations, stride, history)
    dealt = placed.repartition(partitions(conversations.sparkSession), "conv_id", "span").sortWithinPartitions("conv_id", "span", "place")
    return dealt.mapInArrow(run, WINDOW_SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its windows in order: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows. Only one window is
    held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def closed(s: dict) -> pa.RecordBatch:
            values = [s["conv_id"], s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["windows"]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for rows in slices(batches, 64):
            for conv_id, text, context, mask in zip(rows["conv_id"], rows["formatted"], rows["n_context"], rows["loss"], strict=True):
                if state is None or state["conv_id"] != conv_id:
                    if state is not None:
                        yield closed(state)
                    state = {"conv_id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "windows": 0}
                for role, body in read_turns(text)[context:]:
                    state["turns"].update(f"{role}\n{body}\n".encode())
                    state["n"] += 1
                for interval in mask:
                    target = unescape(text[interval["start"] : interval["stop"]])
                    state["loss"].update(target.encode())
                    state["loss_n"] += len(target)
                state["chars"] += len(text)
                state["windows"] += 1
        if state is not None:
            yield closed(state)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    ordered = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "span", "piece")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
