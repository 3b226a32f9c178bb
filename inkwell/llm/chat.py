"""Chat formatting: conversations rendered by a compiled template, with the spans that are trained on, and read back.

Rows are put in order without bringing a large conversation into one task (``ordered``): conversations that lie within a task
are rendered there; of others each piece is rendered by itself, as a template's loop knows no state but the index of a message
and the number of messages, which are summed from the pieces' sizes. Reading back parses the formatted text, not the rows; a
digest reads a conversation's pieces in order and holds one at a time.

The template marks turns by control strings and puts a backslash before each of them, and before each backslash, within a role
or text, so that any text reads back as it was.

Defined cases: a null text or role counts as empty; null conv_ids are one conversation; null turns come first; rows of one turn
stand in the order of a hash of role and text; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import PIECE_ROWS, gathered, in_order, pieces
from .storage import Scratch
from .template import Template, unescape

CONTROL = ("<turn>", "</turn>", "###")
#: Only behind a role, which it ends.
SAYS = ":"
TURNS = (
    "{% for m in messages %}<turn>### {{ m.role | escape('<turn>', '</turn>', '###', ':') }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape('<turn>', '</turn>', '###') }}{% endgeneration %}"
    "{% else %}{{ m.text | escape('<turn>', '</turn>', '###') }}{% endif %}</turn>\n{% endfor %}"
)
TURN = re.compile(r"<turn>### ((?:[^\\:]+|\\[\s\S])*+): ((?:[^\\<]+|\\[\s\S]|<(?!/turn>))*+)</turn>\n")
SPANS = "array<struct<begin: int, end: int>>"
ROWS_AT_ONCE = 5000


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TURNS has formatted."""
    out, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found.group(1), *CONTROL, SAYS), unescape(found.group(2), *CONTROL)))
        at = found.end()
    return out


def format_conversations(rows: DataFrame, source: str = TURNS, constants: dict | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per piece of a conversation: conv_id, piece (rises with the order), whole (the only piece), text, spans.

    rows: conv_id, turn, role, text. Spans are code points within the piece's text.
    """
    Template(source, constants)  # a template that is wrong fails here
    scratch, id_type = Scratch(rows.sparkSession, "chat"), dict(rows.dtypes)["conv_id"]
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pair, span = pa.struct([("role", pa.string()), ("text", pa.string())]), pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    schema = f"conv_id {id_type}, piece long, whole boolean, text string, spans {SPANS}, rows array<struct<role: string, text: string>>"

    def table(out: list[tuple], arrow_id: pa.DataType) -> pa.RecordBatch:
        types = [arrow_id, pa.int64(), pa.bool_(), pa.string(), pa.list_(span), pa.list_(pair)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "piece", "whole", "text", "spans", "rows"])

    def rendered(template: Template, messages: list[dict], first: int = 0, total: int | None = None) -> tuple[str, list[dict]]:
        text, spans = template.render(messages, first, total)
        return text, [{"begin": a, "end": b} for a, b in spans]

    def within(batches):
        template, held, n_rows, arrow_id = Template(source, constants), [], 0, None

        def noted(batches):
            nonlocal arrow_id
            for batch in batches:
                arrow_id = batch.schema.field(0).type
                yield batch

        for key, number, found, whole in pieces(noted(batches), 3, piece_rows):
            messages = [{"role": r[2], "text": r[3]} for r in found]
            held.append((key, number, True, *rendered(template, messages), None) if whole else (key, number, False, None, None, messages))
            n_rows += len(found)
            if n_rows >= ROWS_AT_ONCE:
                yield table(held, arrow_id)
                held, n_rows = [], 0
        if held:
            yield table(held, arrow_id)

    found = scratch.keep(in_order(clean, "conv_id", "turn", ["role", "text"]).mapInArrow(within, schema))
    parts = found.where("not whole").select("conv_id", "piece", "rows")
    sizes = parts.select("conv_id", "piece", F.size("rows").alias("n"))
    conversation = Window.partitionBy("conv_id")
    upto = F.sum("n").over(conversation.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = sizes.select("piece", (upto - F.col("n")).alias("first"), F.sum("n").over(conversation).alias("total"))

    def piecewise(batches):
        template = Template(source, constants)
        for batch in batches:
            out = [(key, number, False, *rendered(template, messages, first, total), None) for key, number, messages, first, total in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield table(out, batch.schema.field(0).type)

    rest = parts.join(places, "piece").select("conv_id", "piece", "rows", "first", "total").mapInArrow(piecewise, schema)
    return found.where("whole").unionByName(rest).drop("rows")


def read_back(formatted: DataFrame) -> DataFrame:
    """Of format_conversations() with TURNS: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    id_type, names = dict(formatted.dtypes)["conv_id"], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def merge(batches):
        one, key, started = {}, None, False

        def finish() -> tuple:
            return key, one["n"], one["turns"].hexdigest(), one["chars"], one["loss"].hexdigest(), one["formatted"]

        def table(out: list[tuple], arrow_id: pa.DataType) -> pa.RecordBatch:
            types = [arrow_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        arrow_id = None
        for batch in batches:
            out, arrow_id = [], batch.schema.field(0).type
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != key:
                    if started:
                        out.append(finish())
                    key, started = conv, True
                    one = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                turns = read_turns(text)
                one["n"] += len(turns)
                one["turns"].update("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                for s in spans:
                    loss = unescape(text[s["begin"] : s["end"]], *CONTROL)
                    one["chars"] += len(loss)
                    one["loss"].update(loss.encode())
                one["formatted"] += len(text)
            if out:
                yield table(out, arrow_id)
        if started:
            yield table([finish()], arrow_id)

    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    taken = ("conv_id", "text", "spans")
    rest = gathered(formatted.where("not whole").select("piece", *taken), "conv_id").select(*taken)
    return formatted.where("whole").select(*taken).mapInArrow(merge, schema).unionByName(rest.mapInArrow(merge, schema))
