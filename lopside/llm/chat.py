"""Chat formatting from an event log.

A log row is (conv_id, turn, copy, seq, kind, role, text). ``delta`` appends to
its message, ``edit`` replaces what the message says so far, ``regenerate``
starts it again (its own text, if any, is the start). Folding needs one
message's events only, so a conversation of any length spreads over tasks;
messages are rendered one by one as well. Only the read-back, which digests a
conversation as one stream, sends the segments of a conversation to one task,
sorted, and holds one Arrow batch of them at a time.

Template of a message: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Inside
roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``; a line end
in a role becomes ``\\n`` with a backslash. So the marks stand nowhere else and
the texts can be read back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
DELTA_CHARS = 512


def log_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """An event log that leads to each row of a conversation table.

    Rows of one conversation and turn are told apart by ``copy``, in order of
    role and text; a null role or text is empty. By a hash of these numbers,
    two fifths of the messages stream as deltas only; the others have a wrong
    start first, of two deltas, which an edit, a regeneration, or a regeneration
    with a text of its own takes back.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(delta_chars))
    pieces = F.transform(starts, lambda i: F.substring(F.col("text"), i + 1, F.lit(delta_chars)))
    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("text"))

    def deltas(texts: Column) -> Column:
        return F.transform(texts, lambda x: event("delta", x))

    first = F.element_at("pieces", 1)
    rest = deltas(F.slice("pieces", F.lit(2), F.size("pieces")))
    wrong = [event("delta", F.concat(F.lit("wrong "), first)), event("delta", F.lit(" start"))]
    history = F.pmod(F.xxhash64(F.lit(13), "conv_id", "turn", "copy"), F.lit(5))
    events = (
        F.when(history == 0, F.concat(F.array(*wrong, event("edit", first)), rest))
        .when(history == 1, F.concat(
            F.array(*wrong, event("regenerate", F.lit(None).cast("string"))), deltas(F.col("pieces"))))
        .when(history == 2, F.concat(F.array(*wrong, event("regenerate", first)), rest))
        .otherwise(deltas(F.col("pieces"))))
    logged = rows.withColumn("copy", copy).withColumn("pieces", pieces).select(
        "conv_id", "turn", "copy", "role", F.posexplode(events).alias("seq", "event"))
    return logged.select("conv_id", "turn", "copy", "role", "event.kind", "seq", "event.text")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): the final messages of a log.

    Events of a message apply in order of ``seq`` (ties: kind, then text). A
    null kind counts as ``delta``. The role is the last one given. A message
    without text is empty; a log without rows has no messages.
    """
    event = F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"), "role")
    messages = log.groupBy("conv_id", "turn", "copy").agg(
        F.sort_array(F.collect_list(event)).alias("events"))
    resets = F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(1))
    live = F.slice("events", F.array_max(resets), F.size("events"))
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return messages.select(
        "conv_id", "turn", "copy",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_chat(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, segment, loss_start, loss_end) of each message.

    A conversation's output is its segments in order of turn and copy. The loss
    mask covers the (escaped) texts of assistants: characters ``loss_start`` to
    ``loss_end`` of the segment, an empty span for other roles.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    said = escape(F.col("text"))
    start = F.length(head).cast("bigint")
    masked = F.when(F.col("role") == "assistant", F.length(said)).otherwise(0)
    return messages.select(
        "conv_id", "turn", "copy", F.concat(head, said, F.lit(END + "\n")).alias("segment"),
        start.alias("loss_start"), (start + masked).alias("loss_end"))


_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    of each conversation, parsed from the formatted segments."""
    schema = T.StructType([
        T.StructField("conv_id", formatted.schema["conv_id"].dataType),
        T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType())])
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches):
        state, kind = None, None

        def finished(states):
            rows = [(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in states]
            arrays = [pa.array(c, k or kind) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            done = []
            kind = batch.column("conv_id").type
            for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "segment", "loss_start", "loss_end"))):
                if state is None or state[0] != conv:
                    done += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                parsed = _SEGMENT.fullmatch(segment)
                if parsed is None or "<|" in parsed[1] or "<|" in parsed[2]:
                    raise ValueError("a segment is not in the template's form")
                role, text = _unescape_role(parsed[1]), unescape(parsed[2])
                lost = unescape(segment[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(lost)
                state[4].update(lost.encode())
                state[5] += len(segment)
            if done:
                yield finished(done)
        if state:
            yield finished([state])

    columns = ["conv_id", "turn", "copy", "segment", "loss_start", "loss_end"]
    ordered = formatted.select(*columns).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "copy")
    return ordered.mapInArrow(digest, schema)
