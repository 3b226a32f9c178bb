"""Repair of conversation structure by the cheapest edits, found on a grammar of the rows' roles and faults.

A row becomes one symbol: its role's initial, whether its text is truncated, or that it must go. Sequences of symbols are
compressed by Re-Pair: the most frequent pair of neighbours becomes a rule until no pair occurs twice, and the rules are shared
by all conversations of a task. Each rule has one min-plus transfer matrix over the states of the wanted form
``(s?(ua)+)?``, the product of its two symbols' matrices; an entry is the least cost and the audit of edits as a rope, of
which ties take the ASCII-least. A conversation is then its start vector times its symbols' matrices.

Conversations that lie within a task are solved there. Others come in pieces of bounded size: which rows are the first with
their role and text is a grouping, every piece gives one matrix, and only the matrices are multiplied in order, a piece at a
time. A digest over a whole conversation reads its pieces in order and holds one at a time.

Edits: K keeps a row, R gives it the role user or assistant (3), D deletes it (4), I inserts an empty text of either role (3);
a truncated row that is not deleted costs 3 more.

Defined cases: null conv_ids are one conversation; null turns come first; null roles and texts are one space; rows of one turn
stand in the order of a hash of role and text; a conversation whose rows are all dropped (column ``live`` false) is repaired to
nothing; roles other than system, user and assistant count by their initial, others can't be kept; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import PIECE_ROWS, gathered, in_order, pieces
from .storage import Scratch

WHITE = " \t\n\x0b\x0c\r"
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Nothing yet, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
CHATS_AT_ONCE = 2000
_MODULUS, _BASE = (1 << 61) - 1, 0x1B873593A5A5A5A5 % ((1 << 61) - 1)


class Rope:
    """A string of edits as a tree; equal parts are told by size and hash."""

    __slots__ = ("size", "hash", "left", "right", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_BASE, right.size, _MODULUS) + right.hash) % _MODULUS
        else:
            self.size, self.hash = len(text), 0
            for c in text.encode():
                self.hash = (self.hash * _BASE + c + 1) % _MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.text is not None and other.text is not None and self.size + other.size <= 32:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size == y.size and x.hash == y.hash):
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                a += [Rope(x.text[n:])] if x.size > n else []
                b += [Rope(y.text[n:])] if y.size > n else []
            elif y.text is not None or (x.text is None and x.size >= y.size):
                a += [x.right, x.left]
                b.append(y)
            else:
                b += [y.right, y.left]
                a.append(x)
        return not a and bool(b)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is None:
                todo += [x.right, x.left]
            else:
                out.append(x.text)
        return "".join(out)


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def _better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    return a if a[0] < b[0] or (a[0] == b[0] and not b[1] < a[1]) else b


def times(rows: list[list[Entry]], right: Matrix) -> list[list[Entry]]:
    """The min-plus product; rows of a matrix or a single vector."""
    out = []
    for row in rows:
        line: list[Entry] = [None] * 4
        for k, first in enumerate(row):
            if first is not None:
                for j, second in enumerate(right[k]):
                    if second is not None:
                        cost = first[0] + second[0]
                        if line[j] is None or cost <= line[j][0]:
                            line[j] = _better(line[j], (cost, first[1] + second[1]))
        out.append(line)
    return out


def _insertions() -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        at, cost, audit = state, 0, ""
        out[state][state] = (0, Rope(""))
        for _ in range(2):
            at, cost, audit = (ASSISTANT if at == USER else USER), cost + INSERT, audit + "I"
            out[state][at] = _better(out[state][at], (cost, Rope(audit)))
    return out


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions before a row, and one edit of it. Symbols: x (must go), s u a o by initial, upper case if truncated."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    extra = TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        out[state][state] = (DELETE, Rope("D"))
        if symbol != "x":
            for to in ("u", "a"):
                if state in NEXT[to]:
                    out[state][NEXT[to][state]] = _better(out[state][NEXT[to][state]], (RENAME + extra, Rope("R")))
            to = NEXT.get(symbol.lower(), {}).get(state)
            if to is not None:
                out[state][to] = _better(out[state][to], (extra, Rope("K")))
    return times(INSERTIONS, out)


class Grammar:
    """Re-Pair rules of a task with their matrices; a rule that was made for earlier sequences is used again."""

    SYMBOLS = "xsuaoSUAO"

    def __init__(self):
        self.matrices = [symbol_matrix(c) for c in self.SYMBOLS]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, left: int, right: int) -> int:
        if (left, right) not in self.rules:
            self.rules[left, right] = len(self.matrices)
            self.matrices.append(times(self.matrices[left], self.matrices[right]))
        return self.rules[left, right]

    def compress(self, sequences: list[str]) -> list[list[int]]:
        """Each sequence in symbols and rules; no pair of neighbours is left twice."""
        number = {c: k for k, c in enumerate(self.SYMBOLS)}
        line = np.array([x for s in sequences for x in (*(number[c] for c in s), -1)], dtype=np.int64)
        while len(line) > 1:
            inner = np.flatnonzero((line[:-1] >= 0) & (line[1:] >= 0))
            pairs, counts = np.unique((line[inner] << 32) | line[inner + 1], return_counts=True)
            if not len(counts) or counts.max() < 2:
                break
            pair = int(pairs[counts.argmax()])
            left, right = pair >> 32, pair & 0xFFFFFFFF
            at = inner[(line[inner] == left) & (line[inner + 1] == right)]
            if left == right:  # of a stretch of equal symbols every other place
                fresh = np.append(True, np.diff(at) > 1)
                at = at[(at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]) % 2 == 0]
            line[at] = self.rule(left, right)
            line = np.delete(line, at + 1)
        out: list[list[int]] = [[]]
        for x in line.tolist():
            out[-1].append(x) if x >= 0 else out.append([])
        return out[:-1]

    def matrix(self, symbols: list[int]) -> Matrix:
        """The transfer matrix of a piece."""
        out = [[(0, Rope("")) if i == j else None for j in range(4)] for i in range(4)]
        for x in symbols:
            out = times(out, self.matrices[x])
        return out

    def audits(self, sequences: list[str]) -> dict[str, str]:
        """The cheapest audit of each of some sequences."""
        different = list(dict.fromkeys(sequences))
        out = {}
        for sequence, symbols in zip(different, self.compress(different)):
            vector = [[(0, Rope("")), None, None, None]]
            for x in symbols:
                vector = times(vector, self.matrices[x])
            out[sequence] = best_audit(vector)
        return out


def best_audit(vector: list[list[Entry]]) -> str:
    """Of a vector over the states: the cheapest audit that ends in the wanted form, insertions at the end included."""
    end = times(vector, INSERTIONS)[0]
    return str(_better(end[START], end[ASSISTANT])[1])


def row_symbol(role: str, text: str, seen: bool) -> str:
    body = text.rstrip(WHITE)
    if not body or seen:
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if body[-1] in ".!?" else initial.upper()


def edited(rows: list[tuple], symbols: str, audit: str, state: int) -> tuple[list[dict], int, int]:
    """(repaired rows, cost, state at the end) of rows (turn, role, text) under an audit."""
    out, cost, k = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = ASSISTANT if state == USER else USER
            out.append({"role": "assistant" if state == ASSISTANT else "user", "text": ""})
            cost += INSERT
            continue
        _, role, text = rows[k]
        if edit == "D":
            cost += DELETE
        else:
            if edit == "R":
                state = ASSISTANT if state == USER else USER
                role = "assistant" if state == ASSISTANT else "user"
                cost += RENAME
            else:
                state = NEXT[symbols[k].lower()][state]
            cost += TRUNCATED if symbols[k].isupper() else 0
            out.append({"role": role, "text": text})
        k += 1
    return out, cost, state


#: What a piece tells of its rows; ``initials`` are those of its first and last row.
FACTS = "n_rows long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
RESULT = f"{FACTS}, cost long, audit string, repaired array<struct<role: string, text: string>>"
_ROWS = "array<struct<turn: bigint, role: string, text: string>>"


def row_facts(rows: list[tuple], symbols: str) -> dict:
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    blank = sum(not t.rstrip(WHITE) for _, _, t in rows)
    return {
        "n_rows": len(rows), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)), "blank": blank, "duplicate": symbols.count("x") - blank,
        "truncated": sum(c.isupper() for c in symbols), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "first_initial": initials[0] if rows else None, "last_initial": initials[-1] if rows else None,
    }


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repaired conversations of rows (conv_id, turn, role, text and, if there is one, live): one row per piece.

    conv_id, piece (rises with the order), whole (the conversation's only piece), what faults its rows have, cost, audit and
    the repaired rows. Costs and counts of pieces add up, audits follow each other.
    """
    spark, scratch, id_type = rows.sparkSession, Scratch(rows.sparkSession, "repair"), dict(rows.dtypes)["conv_id"]
    live = F.coalesce("live", F.lit(True)) if "live" in rows.columns else F.lit(True)
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), live.alias("live"))
    names = ["conv_id", "piece", "whole", *(c.split()[0] for c in RESULT.replace("struct<role: string, text: string>", "").split(", ")), "rows"]
    schema = f"conv_id {id_type}, piece long, whole boolean, {RESULT}, rows {_ROWS}"
    arrow_types = {"repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), "rows": pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))}
    arrow_types |= dict.fromkeys(("first_initial", "last_initial", "audit"), pa.string()) | {"whole": pa.bool_()}

    def table(out: list[dict], arrow_id: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o.get(n) for o in out], arrow_id if n == "conv_id" else arrow_types.get(n, pa.int64())) for n in names], names=names)

    def solve(batches):
        grammar, held, arrow_id, n_rows = Grammar(), [], None, 0

        def finish() -> pa.RecordBatch:
            audits = grammar.audits([o["symbols"] for o in held if o["whole"]])
            for o in held:
                if o["whole"]:
                    audit = audits[o["symbols"]]
                    repaired, cost, _ = edited(o["rows"], o["symbols"], audit, START)
                    o.update(row_facts(o["rows"], o["symbols"]), cost=cost, audit=audit, repaired=repaired, rows=None)
                else:
                    o["rows"] = [dict(zip(("turn", "role", "text"), r)) for r in o["rows"]]
            return table(held, arrow_id)

        def noted(batches):
            nonlocal arrow_id
            for batch in batches:
                arrow_id = batch.schema.field(0).type
                yield batch

        for key, number, found, whole in pieces(noted(batches), 3, piece_rows):
            kept, seen, symbols = [r[1:4] for r in found if r[4]], set(), []
            if whole:
                for _, role, text in kept:
                    symbols.append(row_symbol(role, text, (role, text) in seen))
                    seen.add((role, text))
            held.append({"conv_id": key, "piece": number, "whole": whole, "rows": kept, "symbols": "".join(symbols)})
            n_rows += len(found)
            if n_rows >= 5 * CHATS_AT_ONCE:
                yield finish()
                held, n_rows = [], 0
        if held:
            yield finish()

    found = scratch.keep(in_order(clean, "conv_id", "turn", ["role", "text"]).mapInArrow(solve, schema))
    parts = found.where("not whole").select("conv_id", "piece", "rows")

    # Of all rows with one role and text, the first is no duplicate.
    each = parts.select("conv_id", "piece", F.posexplode("rows").alias("at", "r")).select("conv_id", "piece", "at", F.sha2(F.concat(F.length("r.role").cast("string"), F.lit(":"), "r.role", "r.text"), 256).alias("same"))
    firsts = each.groupBy("conv_id", "same").agg(F.min(F.struct("piece", "at")).alias("first")).groupBy("first.piece").agg(F.collect_list("first.at").alias("firsts"))
    marked = parts.join(firsts, "piece", "left").select("conv_id", "piece", "rows", "firsts")

    def transfer(batches):
        """The symbols and the matrix of each piece."""
        grammar = Grammar()
        for batch in batches:
            keys, numbers, rows_of, firsts_of = (c.to_pylist() for c in batch.columns)
            symbols = []
            for found, firsts in zip(rows_of, firsts_of):
                new = set(firsts or [])
                symbols.append("".join(row_symbol(r["role"], r["text"], k not in new) for k, r in enumerate(found)))
            matrices = [[e for row in grammar.matrix(s) for e in row] for s in grammar.compress(symbols)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(symbols, pa.string()), pa.array([[None if e is None else e[0] for e in m] for m in matrices], pa.list_(pa.int64())), pa.array([[None if e is None else str(e[1]) for e in m] for m in matrices], pa.list_(pa.string()))],
                names=["conv_id", "piece", "symbols", "costs", "audits"],
            )

    def fold(batches):
        """Multiply the matrices of a conversation in order; deal its audit out to its pieces."""
        key, started, vector, held = None, False, None, []

        def finish() -> pa.RecordBatch:
            audit, out, at, state = best_audit(vector), [], 0, START
            for k, (number, symbols) in enumerate(held):
                begin, left, before = at, len(symbols), state
                while left:
                    left -= audit[at] != "I"
                    at += 1
                at = len(audit) if k == len(held) - 1 else at
                state = edited([(None, "", "")] * len(symbols), symbols, audit[begin:at], before)[2]
                out.append((number, symbols, audit[begin:at], before))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["piece", "symbols", "audit", "state"])

        for batch in batches:
            for conv, number, symbols, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != key:
                    if started:
                        yield finish()
                    key, started, vector, held = conv, True, [[(0, Rope("")), None, None, None]], []
                entries = [None if c is None else (c, Rope(a)) for c, a in zip(costs, audits)]
                vector = times(vector, [entries[4 * i : 4 * i + 4] for i in range(4)])
                held.append((number, symbols))
        if started:
            yield finish()

    def apply(batches):
        for batch in batches:
            out = []
            for conv, number, found, symbols, audit, state in zip(*(c.to_pylist() for c in batch.columns)):
                plain = [(r["turn"], r["role"], r["text"]) for r in found]
                repaired, cost, _ = edited(plain, symbols, audit, state)
                out.append({"conv_id": conv, "piece": number, "whole": False, **row_facts(plain, symbols), "cost": cost, "audit": audit, "repaired": repaired})
            yield table(out, batch.schema.field(0).type)

    matrices = marked.mapInArrow(transfer, f"conv_id {id_type}, piece long, symbols string, costs array<long>, audits array<string>")
    slices = gathered(matrices, "conv_id").mapInArrow(fold, "piece long, symbols string, audit string, state int")
    rest = parts.join(slices, "piece").select("conv_id", "piece", "rows", "symbols", "audit", "state").mapInArrow(apply, schema)
    return found.where("whole").unionByName(rest).drop("rows")


def repair_digests(repaired: DataFrame) -> DataFrame:
    """Of repair_conversations(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    id_type, counts = dict(repaired.dtypes)["conv_id"], ["blank", "duplicate", "truncated", "illegal", "cost"]
    taken = repaired.select("conv_id", "n_rows", "first_turn", "last_turn", "turns", "first_initial", "last_initial", *counts, "audit", "repaired", "piece", "whole")

    def merge(batches):
        one, key, started = {}, None, False

        def finish() -> list:
            low, high = one["span"]
            return [key, 0 if low is None else high - low + 1 - one["turns"], *(one[c] for c in counts), "".join(one["audit"]), one["hash"].hexdigest()]

        def table(out: list[list], arrow_id: pa.DataType) -> pa.RecordBatch:
            types = [arrow_id, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["conv_id", "gaps", *counts, "audit", "repaired_sha256"])

        arrow_id = None
        for batch in batches:
            out, arrow_id = [], batch.schema.field(0).type
            for row in batch.to_pylist():
                if not started or row["conv_id"] != key:
                    if started:
                        out.append(finish())
                    key, started = row["conv_id"], True
                    one = dict.fromkeys(counts, 0) | {"span": (None, None), "turns": 0, "last": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                for c in counts:
                    one[c] += row[c]
                if one["last"] is not None and row["n_rows"]:
                    one["illegal"] += one["last"] + row["first_initial"] not in ("su", "ua", "au")
                one["last"] = row["last_initial"] if row["n_rows"] else one["last"]
                if row["first_turn"] is not None:
                    low, high = one["span"]
                    one["turns"] += row["turns"] - (high == row["first_turn"])
                    one["span"] = (row["first_turn"] if low is None else low, row["last_turn"])
                one["audit"].append(row["audit"])
                for r in row["repaired"]:
                    one["hash"].update((("\n" if one["any"] else "") + r["role"] + ":" + r["text"]).encode())
                    one["any"] = True
            if out:
                yield table(out, arrow_id)
        if started:
            yield table([finish()], arrow_id)

    schema = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return taken.where("whole").mapInArrow(merge, schema).unionByName(gathered(taken.where("not whole"), "conv_id").mapInArrow(merge, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live of conversations with faults that their crc32 chooses, for checks of the repair.

    By crc32 of "conv_id:turn" modulo 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3
    repeats it, 4 gives it the role user.
    """
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(either("text"), "[.!?]", "")).otherwise(either("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(either("role")).alias("role"), text.alias("text"), (fault != 0).alias("live"), copies.alias("copy")).drop("copy")
