"""Rows of groups in order, spread so that a large group takes many tasks.

Rows are range-partitioned by group and order, and sorted; so a task sees few groups that another one sees, too. A group
that a task surely holds in full is *whole*; the first and the last group of a task, and groups of many rows or characters,
come as numbered pieces, whose numbers rise with the order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_ROWS = 256
PIECE_CHARS = 1 << 20


def in_order(rows: DataFrame, key: str, order: str, tied: list[str]) -> DataFrame:
    """rows by key and order, nulls first; rows of equal order by a hash of the columns ``tied``.

    Rows that are alike in all of this are told apart by their place in the input, so that they, too, can be dealt out.
    """
    keyed = rows.withColumns({"_hash": F.xxhash64(*tied), "_place": F.monotonically_increasing_id()})
    by = [key, order, "_hash", "_place"]
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_hash", "_place")


def pieces(batches, chars: int, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> Iterator[tuple[object, int, list[tuple], bool]]:
    """(key, number, rows, whole) of sorted rows, whose first column is the key and whose column ``chars`` is a text."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    key, rows, size, edge, split, started = None, [], 0, True, False, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if started and row[0] != key:
                yield key, number, rows, not (edge or split)
                number, rows, size, edge, split = number + 1, [], 0, False, False
            elif len(rows) == piece_rows or size >= piece_chars:
                yield key, number, rows, False
                number, rows, size, split = number + 1, [], 0, True
            key, started = row[0], True
            rows.append(row)
            size += len(row[chars] or "")
    if started:
        yield key, number, rows, False


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """Pieces by key and number. A value that needs its group in order, such as a digest, is then made row by row."""
    return rows.repartition(key).sortWithinPartitions(key, "piece")
