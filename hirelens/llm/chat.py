"""Chat formatting in budgeted windows (operator 8).

Template: a window is ``<s>`` and its turns; ``[INST] text [/INST]`` for a user,
``[OUT] text </s>`` for an assistant, ``[SYS] text [/SYS]`` for a system turn,
``[ROLE name] text [/ROLE]`` for others. A control string inside a text gets a
backslash after its first character (one more if it has some already), which
``parse`` takes back: any text comes out as it went in.

Windows: prefix sums of the turns' tokens choose the spans. A turn starts at
offset P of its conversation and belongs to span floor(P / stride); turns of more
than ``long`` tokens stand alone and separate the spans beside them. So a
span's turns hold at most stride + long tokens, and where one begins needs
only the sums, not the spans before it. Every window after the first starts with
the conversation's leading system turn, then up to ``HISTORY`` turns before the
span (each at most ``history`` tokens, and as far as the budget goes). These
three follow from what a conversation's system turn leaves of the budget, so a
window exceeds it only if a turn with the system turn is too long by itself.
Only new assistant turns are under the loss mask; repeated ones are not.

Sums are taken per block of a range partitioning and joined with the totals of
the blocks before, so a conversation with a third of all rows spreads over many
tasks; a window holds what the budget allows. Only ``digests`` reads one
conversation in one task, turn by turn: a SHA-256 has no other order.

Defined results: null text is empty, null role is ''; turns go by turn number
(nulls first), ties by a hash of role and text; repeated rows are turns of their
own; a null conversation id is a conversation; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import keep
from hirelens.llm.counts import counter

BUDGET = 2048
HISTORY, HISTORY_TURN = 2, 128
LONG_TURN = 512
SYSTEM_TURN = 256               # a shorter system turn leaves no more room than one of this size
SALTS = 16

_NAMES = {"user": "INST", "assistant": "OUT", "system": "SYS"}
_ROLES = {v: k for k, v in _NAMES.items()}
_CLOSE = {"INST": "[/INST]", "OUT": "</s>", "SYS": "[/SYS]", "ROLE": "[/ROLE]"}
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?(?:INST|OUT|SYS|ROLE)[\] ])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?(?:INST|OUT|SYS|ROLE)[\] ])")
_OPEN = re.compile(r"\[(?:(INST|OUT|SYS)|ROLE ((?:[^\\\]]|\\.)*))\] ", re.S)


# ------------------------------------------------------------ template

def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as template text, and where its own text lies in that."""
    name = _NAMES.get(role)
    head = f"[{name}] " if name else "[ROLE " + re.sub(r"([\\\]])", r"\\\1", role) + "] "
    body = escape(text)
    return f"{head}{body} {_CLOSE[name or 'ROLE']}", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) of a window's turns."""
    if not window.startswith("<s>"):
        raise ValueError("a window starts with <s>")
    at, out = 3, []
    while at < len(window):
        m = _OPEN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        name = m.group(1)
        role = _ROLES[name] if name else re.sub(r"\\(.)", r"\1", m.group(2), flags=re.S)
        close = _CLOSE[name or "ROLE"]
        end = window.index(close, m.end())
        out.append((role, unescape(window[m.end(): end - 1])))
        at = end + len(close)
    return out


# ------------------------------------------------------------ windows

def _with_tokens(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches):
        tokens = counter(path, pattern)
        for batch in batches:
            roles, texts = batch.column(batch.schema.get_field_index("role")), batch.column(batch.schema.get_field_index("text"))
            n = tokens.counts([render(r, t)[0] for r, t in zip(roles.to_pylist(), texts.to_pylist())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "tokens"])

    return turns.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema) + ", tokens long")


def _limits(system: F.Column) -> dict[str, F.Column]:
    """``stride``, ``long`` and ``history`` of a conversation whose system turn has so many tokens."""
    room = F.greatest(F.lit(BUDGET) - F.greatest(system, F.lit(SYSTEM_TURN)), F.lit(1))
    history = F.least(F.lit(HISTORY_TURN), F.floor(room / 8))
    rest = room - HISTORY * history
    long = F.least(F.lit(LONG_TURN), F.floor(rest / 2))
    return {"stride": F.greatest(rest - long, F.lit(1)), "long_turn": long, "history": history}


def placed_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every turn with its ordinal and its span: (c, conv_id, ord, role, text, tokens, long, longs, span, history)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("c"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange("c", "turn", "tie") \
        .withColumn("block", F.spark_partition_id())
    rows = keep(_with_tokens(dealt, path, pattern), "turns")
    head = rows.groupBy("c").agg(F.min(F.struct("turn", "tie", "role", "tokens")).alias("h")).select(
        "c", F.when(F.col("h.role") == "system", F.col("h.tokens")).otherwise(0).alias("system"))
    blocks = rows.groupBy("c", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).join(head, "c").select(
        "c", "block", "n", "t", *(v.alias(k) for k, v in _limits(F.col("system")).items()))
    blocks = keep(blocks, "blocks")
    limits = blocks.select("c", "block", "stride", "long_turn", "history")
    rows = rows.join(limits, ["c", "block"]).withColumn("long", (F.col("tokens") > F.col("long_turn")).cast("int"))
    inside = Window.partitionBy("c", "block").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"n_": F.count("*").over(inside), "t_": F.sum("tokens").over(inside), "l_": F.sum("long").over(inside)})
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    longs = rows.select("c", "block", "long").groupBy("c", "block").agg(F.sum("long").alias("l"))
    sums = blocks.select("c", "block", "n", "t").join(longs, ["c", "block"]).select(
        "c", "block", *(F.coalesce(F.sum(x).over(earlier), zero).alias(f"{x}0") for x in "ntl"))
    met = local.join(sums, ["c", "block"])
    start = F.col("t0") + F.col("t_") - F.col("tokens")
    return met.select("c", "conv_id", (F.col("n0") + F.col("n_") - 1).alias("ord"), "role", "text", "tokens", "long",
                      (F.col("l0") + F.col("l_")).alias("longs"), F.floor(start / F.col("stride")).cast("long").alias("span"), "history")


def windows(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, c, first, n_repeated, tokens, over_budget, text, loss): the formatted windows; ``first``
    is the ordinal of the first new turn, ``loss`` the code point ranges under the mask."""
    rows = keep(placed_turns(conversations, path, pattern), "placed")
    turn = F.struct("ord", "role", "text").alias("turn")
    spans = keep(rows.groupBy("c", "conv_id", "long", "longs", "span").agg(
        F.min("ord").alias("first"), F.sum("tokens").alias("tokens"), F.max("history").alias("history"), F.sort_array(F.collect_list(turn)).alias("new")), "spans")
    heads = rows.where("ord = 0 AND role = 'system'").select("c", "tokens", turn).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lead = spans.where("first > 0").select("c", "first", (F.col("first") % SALTS).cast("int").alias("salt")).join(heads, ["c", "salt"]).select(
        "c", "first", F.struct("turn", "tokens").alias("lead"))
    back = spans.where("first > 0").select("c", "first", F.explode(F.sequence(
        F.greatest(F.col("first") - HISTORY, F.lit(0)), F.col("first") - 1)).alias("ord"))
    past = back.join(rows.where("NOT (ord = 0 AND role = 'system')"), ["c", "ord"]).select(
        "c", "first", F.struct(turn, "tokens").alias("t")).groupBy("c", "first").agg(F.sort_array(F.collect_list("t")).alias("past"))
    full = spans.join(lead, ["c", "first"], "left").join(past, ["c", "first"], "left").select(
        "conv_id", "c", "first", "tokens", "history", "new", "lead", "past")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                again = []
                tokens = row["tokens"] + (row["lead"]["tokens"] if row["lead"] else 0)
                for t in reversed(row["past"] or ()):       # an overlong turn ends the history before it
                    if t["tokens"] > row["history"] or tokens + t["tokens"] > BUDGET:
                        break
                    again.insert(0, t)
                    tokens += t["tokens"]
                if row["lead"]:
                    again.insert(0, row["lead"])
                text, loss = "<s>", []
                for k, t in enumerate([x["turn"] for x in again] + row["new"]):
                    shown, a, b = render(t["role"], t["text"])
                    if k >= len(again) and t["role"] == "assistant":
                        loss.append({"start": len(text) + a, "end": len(text) + b})
                    text += shown
                out.append({"conv_id": row["conv_id"], "c": row["c"], "first": row["first"], "n_repeated": len(again),
                            "tokens": tokens, "over_budget": tokens > BUDGET, "text": text, "loss": loss})
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)

    return full.mapInArrow(run, "conv_id long, c string, first long, n_repeated int, tokens long, over_budget boolean, "
                                "text string, loss array<struct<start:int,end:int>>")


_WINDOW = pa.schema([("conv_id", pa.int64()), ("c", pa.string()), ("first", pa.int64()), ("n_repeated", pa.int32()), ("tokens", pa.int64()),
                     ("over_budget", pa.bool_()), ("text", pa.string()),
                     ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, digest of the turns, masked text and
    its digest, formatted characters. One window is in memory at a time."""
    def run(batches):
        own, state = None, None

        def done():
            turns, loss = state[1], state[3]
            return {"conv_id": state[5], "n_turns": state[0], "turns_sha256": turns.hexdigest(), "loss_chars": state[2],
                    "loss_sha256": loss.hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["c"] != own:
                    if state:
                        out.append(done())
                    own, state = row["c"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, row["conv_id"]]
                for role, text in parse(row["text"])[row["n_repeated"]:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"]: span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["text"])
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
        if state:
            yield pa.RecordBatch.from_pylist([done()], schema=_DIGEST)

    return formatted.repartition("c").sortWithinPartitions("c", "first").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
