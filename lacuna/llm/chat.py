"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
EXAMPLE = "conv_id {id}, example bigint, n_turns bigint, text string, loss_start bigint, loss_end bigint, last boolean"


def escape(text: str) -> str:
    """Reversible: every "<", backslashes, "|" gets one backslash more, so no control string is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(role: str, text: str) -> tuple[str, int]:
    """One turn in the template, and where its text begins."""
    head = f"{START}{_escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped."""
    turns = []
    for part in formatted.split(END + "\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((_unescape_role(role), unescape(text)))
    return turns


def expand(turns: list[tuple[str, str]]):
    """(turns so far, text, loss start, loss end, is it the last) for every assistant turn.

    Positions are code points; only the reply's own text is trainable. Turns after the last assistant turn come as
    one more example without a trainable part, so that the output holds every turn.
    """
    body, n, open_ = [], 0, False
    last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    size = 0
    for i, (role, text) in enumerate(turns):
        part, at = render(role, text)
        body.append(part)
        n, open_ = n + 1, role != "assistant"
        if role == "assistant":
            yield n, "".join(body), size + at, size + len(part) - len(END) - 1, i == last == len(turns) - 1
        size += len(part)
    if open_:
        yield n, "".join(body), size, size, True


def prefix_examples(turns: DataFrame, batch_chars: int = 1 << 22) -> DataFrame:
    """Examples of all conversations in ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Rows: conv_id, example (from 0), n_turns, text (context and reply in the template), loss_start, loss_end
    (the trainable span, in code points), last (the example that holds all turns).

    Turns are ordered by turn, then role, then text; null turns come first, null roles and texts are empty.
    Repeated rows are turns of their own. Rows with a null conv_id are one conversation. An empty table has no
    examples. Each example is made as it is emitted: memory holds one conversation and one batch.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    grouped = turns.select("conv_id", F.struct(
        "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.concat(F.filter("ts", lambda t: t["turn"].isNull()), F.filter("ts", lambda t: t["turn"].isNotNull())
                            ).alias("ts"))
    columns = EXAMPLE.format(id=kind)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts):
        for part in parts:
            held, size = [], 0
            schema = pa.schema([pa.field("conv_id", part.schema.field(0).type), ("example", pa.int64()),
                                ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()),
                                ("loss_end", pa.int64()), ("last", pa.bool_())])
            flush = lambda rows: pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))], schema=schema)
            for k in range(part.num_rows):  # a conversation at a time
                conv, ts = part.column(0)[k].as_py(), part.column(1)[k].as_py()
                for i, (n, text, begin, stop, last) in enumerate(expand([(t["role"], t["text"]) for t in ts])):
                    held.append((conv, i, n, text, begin, stop, last))
                    size += len(text)
                    if size > batch_chars:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

    return grouped.mapInArrow(run, columns)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say: conv_id, turns (role, text), losses (unescaped, in order), chars."""
    kind = examples.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, example bigint, chars bigint, loss string, turns array<struct<role:string,text:string>>"
    pair = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(parts):
        for part in parts:
            rows = part.to_pylist()
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(r["text"]) for r in rows], pa.int64()),
                pa.array([unescape(r["text"][r["loss_start"]:r["loss_end"]]) for r in rows], pa.string()),
                pa.array([[{"role": a, "text": b} for a, b in parse(r["text"])] if r["last"] else None for r in rows],
                         pa.list_(pair)),
            ], names=["conv_id", "example", "chars", "loss", "turns"])

    read = examples.select("conv_id", "example", "text", "loss_start", "loss_end", "last").mapInArrow(run, out)
    return read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("l"), F.sum("chars").alias("chars"),
        F.max("turns").alias("turns")).select(
        "conv_id", "turns", F.transform("l", lambda x: x["loss"]).alias("losses"), "chars")
