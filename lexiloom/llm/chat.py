"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\n`` + text + ``<|im_end|>\\n``. A control string inside a text (of
this template or of the bracket style) gets a backslash after its first character; a text that
already has backslashes there gets one more, so taking one away restores every text. In a role
a line feed is written as %0A and a percent sign as %25.
For a batch of turns the lengths of all segments are summed to offsets and headers, texts and
ends are copied into one buffer by index arrays; conversations are slices of that buffer.

Defined cases: null roles and texts are empty; turns stand by turn number (null first), then
role, then text; repeated rows are turns of their own; a null conv_id is a conversation; empty
tables give empty tables; other columns are ignored. A conversation is one output value, so it
must fit one (2 GB); rows stream through the task that assembles it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import mapped

START, END = "<|im_start|>", "<|im_end|>"
#: What may follow the first character of a control string.
TAILS = r"\|im_start\|>|\|im_end\|>|INST\]|/INST\]|s>|/s>"
ESCAPE, ESCAPED = rf"([<\[])(\\*)({TAILS})", r"\1\\\2\3"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({TAILS})")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("stop", T.LongType(), False)]), False)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, ESCAPED)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def one_line(roles: pa.Array) -> pa.Array:
    """Roles end at their line, so a line feed in one is written as %0A and a percent sign as %25."""
    return pc.replace_substring(pc.replace_substring(roles, "%", "%25"), "\n", "%0A")


def any_lines(role: str) -> str:
    return role.replace("%0A", "\n").replace("%25", "%")


def segments(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Joins string columns row by row into one buffer; where each cell starts in it, by row and column."""
    n, k = len(columns[0]), len(columns)
    lens = np.empty((n, k), np.int64)
    parts = []
    for j, column in enumerate(columns):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        lens[:, j] = np.diff(offsets)
        data = column.buffers()[2]
        parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8))
    to = (np.cumsum(lens.ravel()) - lens.ravel()).reshape(n, k)
    out = np.empty(int(lens.sum()), np.uint8)
    for j, part in enumerate(parts):
        own = np.cumsum(lens[:, j]) - lens[:, j]
        out[np.repeat(to[:, j] - own, lens[:, j]) + np.arange(len(part))] = part
    return out, np.append(to.ravel(), len(out))


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, list[list[tuple[int, int]]], np.ndarray]:
    """Formatted conversations, their loss spans (code points) and the first row of each; ``conv`` marks rows that start one."""
    n = len(roles)
    empty = lambda x: pc.fill_null(x.cast(pa.large_string()), "")
    roles, texts = escape(one_line(empty(roles))), escape(empty(texts))
    fixed = lambda x: pa.array([x], pa.large_string()).take(pa.array(np.zeros(n, np.int64)))
    columns = [fixed(START), roles, fixed("\n"), texts, fixed(f"{END}\n")]
    out, at = segments(columns)
    first = np.flatnonzero(conv)
    bounds = np.append(at[:-1].reshape(n, 5)[first, 0], len(out))
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    chars = np.stack([pc.utf8_length(c).to_numpy() for c in columns], 1).astype(np.int64)
    char_at = (np.cumsum(chars.ravel()) - chars.ravel()).reshape(n, 5)
    which = np.cumsum(conv) - 1
    start = char_at[:, 3] - char_at[first, 0][which]
    spans: list[list[tuple[int, int]]] = [[] for _ in first]
    for i in np.flatnonzero(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)):
        spans[which[i]].append((int(start[i]), int(start[i] + chars[i, 3])))
    return formatted, spans, first


def write(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of code points that count for the loss)."""
    slim = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss", SPAN)])
    kind = pa.list_(pa.struct([pa.field("start", pa.int64(), False), pa.field("stop", pa.int64(), False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids = t.column("conv_id").combine_chunks() if t.num_rows else t.column("conv_id")
            new = starts(ids)
            formatted, spans, first = assemble(new, t.column("role").combine_chunks(), t.column("text").combine_chunks())
            loss = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted.cast(pa.string()), loss], names=["conv_id", "formatted", "loss"])

        def starts(ids: pa.Array) -> np.ndarray:
            codes = pc.fill_null(pc.dictionary_encode(ids).indices, -1).to_numpy()
            return np.append(True, codes[1:] != codes[:-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(starts(batch.column(0)))[-1])
            if held and not last and batch.column(0)[0].equals(held[-1].column(0)[0]):
                held.append(batch)
                continue
            done = [*held, batch.slice(0, last)] if last else held
            if done:
                yield flush(done)
            held = [batch.slice(last)]  # this conversation may go on in the next batch
        if held:
            yield flush(held)

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return mapped(slim.repartition("conv_id").sortWithinPartitions(*order), run, schema)



def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        out.append((any_lines(unescape(formatted[at + len(START) : line])), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return out


def read(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, what the spans cover with escapes undone."""
    schema = T.StructType(
        [*formatted.schema.fields, T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("loss_text", T.StringType())]
    )
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, spans = part.column("formatted").to_pylist(), part.column("loss").to_pylist()
                turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
                loss = ["".join(unescape(x[s["start"] : s["stop"]]) for s in own) for x, own in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(turns, kind), pa.array(loss, pa.string())], names=names)

    return mapped(formatted, run, schema)


def digests(read_back: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
