"""Corpus preparation: loading facts, normalising, sentences, blocks, headings and chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strategy_tokens, strip, word_count, words

#: Fixed values
INVISIBLE = "​‌‍⁠﻿­"
UNICODE_SPACES = "   -   　\t\f\x0b"
MAX_HEADING_WORDS, MAX_HEADING_CHARS = 12, 80


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in estimated tokens."""

    chunk_size: int = 512
    overlap: int = 50
    min_chunk_size: int | None = None
    max_chunk_size: int | None = None
    merge_small_chunks: bool = True
    preserve_headings: bool = True

    def check(self) -> None:
        if self.overlap >= self.chunk_size:
            raise ValueError("overlap must be below chunk_size")
        if self.min_chunk_size and self.max_chunk_size and self.min_chunk_size > self.max_chunk_size:
            raise ValueError("min_chunk_size must not exceed max_chunk_size")


def corpus_facts(corpus: DataFrame) -> DataFrame:
    """doc_id, word_count, character_count, status ('error' for empty text)."""
    text = F.coalesce("text", F.lit(""))
    return corpus.select("doc_id", word_count(text).alias("word_count"), F.length(text).alias("character_count"), F.when(F.length(strip(text)) == 0, "error").otherwise("success").alias("status"))


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The column in NFC with plain line ends and spaces; only rows that aren't ASCII pass through Python."""
    plain = df.where(~F.col(column).rlike(r"[^\x00-\x7f]") | F.col(column).isNull())
    other = df.where(F.col(column).rlike(r"[^\x00-\x7f]")).withColumn(column, F.pandas_udf(_nfc, "string")(column))
    return plain.unionByName(other).withColumn(column, _tidy(F.col(column)))


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(c, f"[{INVISIBLE}]", "")
    c = F.regexp_replace(F.regexp_replace(c, f"[{UNICODE_SPACES}]", " "), " {2,}", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), "\n{3,}", "\n\n")
    return strip(c)


def sentence_array(text: Column | str) -> Column:
    """The sentences of a text: cut behind . ! ? and white space, inner white space collapsed."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.array_join(words(s), " ")), lambda s: s != "")


def sentences(corpus: DataFrame) -> DataFrame:
    """doc_id, position from 0, sentence."""
    return corpus.select("doc_id", F.posexplode(sentence_array("text")).alias("position", "sentence"))


def blocks(corpus: DataFrame) -> DataFrame:
    """doc_id, position from 0, block: trimmed parts between blank lines."""
    cut = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda s: s != "")
    return corpus.select("doc_id", F.posexplode(cut).alias("position", "block"))


def _lines(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


ATX = r"^(#{1,6})\s+(\S.*?)\s*#*\s*$"


def headings(corpus: DataFrame, heuristic: bool = False) -> DataFrame:
    """doc_id, line_no, level (null if guessed), title, source."""
    line = F.regexp_replace("line", r"\s+$", "")
    marks = F.regexp_extract(line, ATX, 1)
    bare = strip("line")
    guess = (bare != "") & ~bare.rlike("[.,;:!?]$") & (F.length(bare) <= MAX_HEADING_CHARS) & (word_count(bare) <= MAX_HEADING_WORDS)
    rows = _lines(corpus).select(
        "doc_id", "line_no", F.when(marks != "", F.length(marks)).alias("level"), F.when(marks != "", strip(F.regexp_extract(line, ATX, 2))).otherwise(bare).alias("title"),
        F.when(marks != "", "markdown").when(F.lit(heuristic) & guess, "heuristic").alias("source"),
    )
    return rows.where(F.col("source").isNotNull())


def heading_breadcrumb(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, level, title) of headings with their path: titles of enclosing headings joined by ' > '."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines
    for k in range(1, 7):
        rows = rows.withColumn(f"_{k}", F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), True).over(order))
    parts = []
    for k in range(1, 7):
        newer = [F.coalesce(F.col(f"_{j}.line_no"), F.lit(-1)) < F.col(f"_{k}.line_no") for j in range(1, k)]
        keep = F.col(f"_{k}").isNotNull()
        for n in newer:
            keep = keep & n
        parts.append(F.when(keep, F.col(f"_{k}.title")))
    return rows.withColumn("path", F.concat_ws(" > ", *parts)).drop(*[f"_{k}" for k in range(1, 7)])


def _sized(chunks: DataFrame, source: str) -> DataFrame:
    """Chunks with their size facts; chunk_index is renumbered from 0."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumns({
        "chunk_index": F.row_number().over(order) - 1, "word_count": word_count("text"), "character_count": F.length("text"),
        "estimated_tokens": strategy_tokens("text"), "source_type": F.lit(source),
    })


def merge_small_chunks(chunks: DataFrame, min_tokens: int, joint: str = " ") -> DataFrame:
    """Chunks (doc_id, chunk_index, text) below ``min_tokens`` joined to the one before; indexes are renumbered.

    Whether a chunk is small is judged before any joining, so a running count of the others numbers the results.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    begins = (strategy_tokens("text") >= min_tokens) | (F.row_number().over(order) == 1)
    marked = chunks.select("doc_id", "chunk_index", "text", begins.alias("begins")).withColumn("part", F.sum(F.col("begins").cast("int")).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x.text), joint)
    return marked.groupBy("doc_id", "part").agg(strip(joined).alias("text")).select("doc_id", (F.col("part") - 1).cast("int").alias("chunk_index"), "text")


def chunk_fixed(corpus: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Word windows of up to chunk_size x 4 characters that step back to hold overlap x 4 characters."""
    most, back = config.chunk_size * 4, min(config.overlap, config.chunk_size - 1) * 4

    def windows(text: str):
        w = text.split()
        start = 0
        while start < len(w):
            end, size = start + 1, len(w[start])
            while end < len(w) and size + len(w[end]) + 1 <= most:
                size += len(w[end]) + 1
                end += 1
            yield " ".join(w[start:end])
            if end == len(w):
                return
            held, start, first = 0, end, start + 1
            while start > first and held < back:
                start -= 1
                held += len(w[start]) + 1

    def cut(batches):
        for batch in batches:
            ids, index, out = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, piece in enumerate(windows(text or "")):
                    ids.append(key)
                    index.append(i)
                    out.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(out, pa.string())], names=["doc_id", "chunk_index", "text"])

    chunks = corpus.select("doc_id", "text").mapInArrow(cut, f"doc_id {dict(corpus.dtypes)['doc_id']}, chunk_index int, text string")
    if config.merge_small_chunks and config.min_chunk_size:
        chunks = merge_small_chunks(chunks, config.min_chunk_size)
    return _sized(chunks, "fixed")


def pack_by_size(parts: Column, most: int, joint: str) -> Column:
    """Parts joined greedily while the joined text has at most ``most`` estimated tokens."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state, part):
        longer = F.when(state.open == "", part).otherwise(F.concat(state.open, F.lit(joint), part))
        full = (state.open != "") & (strategy_tokens(longer) > most)
        return F.struct(F.when(full, F.concat(state.done, F.array(state.open))).otherwise(state.done).alias("done"), F.when(full, part).otherwise(longer).alias("open"))

    return F.aggregate(parts, zero, step, lambda s: F.when(s.open == "", s.done).otherwise(F.concat(s.done, F.array(s.open))))


def _within_size(text: Column, config: ChunkConfig) -> Column:
    if not config.max_chunk_size:
        return F.array(text)
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: strip(s) != "")
    return F.when(strategy_tokens(text) <= config.max_chunk_size, F.array(text)).otherwise(pack_by_size(parts, config.max_chunk_size, " "))


def chunk_paragraph(corpus: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A chunk per block; blocks over max_chunk_size are packed by sentence."""
    cut = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda s: s != "")
    pieces = F.flatten(F.transform(cut, lambda b: _within_size(b, config)))
    chunks = corpus.select("doc_id", F.posexplode(pieces).alias("chunk_index", "text"))
    if config.merge_small_chunks and config.min_chunk_size:
        chunks = merge_small_chunks(chunks, config.min_chunk_size, "\n\n")
    return _sized(chunks, "paragraph")


def chunk_heading(corpus: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A chunk per heading section with heading, section (breadcrumb) and heading_level; text before the first is kept."""
    line = F.regexp_replace("line", r"\s+$", "")
    marks = F.regexp_extract(line, r"^(#{1,6})\s+(\S.*)$", 1)
    rows = _lines(corpus).withColumns({"level": F.when(marks != "", F.length(marks)), "title": F.when(marks != "", strip(F.regexp_extract(line, r"^(#{1,6})\s+(\S.*)$", 2)))})
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum(F.col("level").isNotNull().cast("int")).over(order))
    paths = heading_breadcrumb(rows.where(F.col("level").isNotNull()).select("doc_id", "part", "line_no", "level", "title")).select("doc_id", "part", F.col("title").alias("heading"), F.col("path").alias("section"), F.col("level").alias("heading_level"))
    body = rows if config.preserve_headings else rows.where(F.col("level").isNull())
    text = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n"))
    parts = body.groupBy("doc_id", "part").agg(text.alias("text")).where("text != ''")
    inside = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda s: s != "")
    most = config.max_chunk_size
    pieces = F.when(strategy_tokens("text") <= most, F.array("text")).otherwise(pack_by_size(inside, most, "\n\n")) if most else F.array("text")
    chunks = parts.select("doc_id", "part", F.posexplode(pieces).alias("piece", "text")).join(paths, ["doc_id", "part"], "left")
    index = Window.partitionBy("doc_id").orderBy("part", "piece")
    return _sized(chunks.withColumn("chunk_index", F.row_number().over(index)), "heading").drop("part", "piece")


STRATEGIES: dict[str, Callable[[DataFrame, ChunkConfig], DataFrame]] = {"fixed": chunk_fixed, "paragraph": chunk_paragraph, "heading": chunk_heading}


def chunk_documents(corpus: DataFrame, strategy: str, config: ChunkConfig = ChunkConfig()) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected documents that are blank)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    config.check()
    blank = F.length(strip(F.coalesce("text", F.lit("")))) == 0
    return STRATEGIES[strategy](corpus.where(~blank), config), corpus.where(blank)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per document: total_chunks, total_tokens, average, largest and smallest tokens, average characters and words."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.sum("estimated_tokens").alias("total_tokens"), F.bround(F.avg("estimated_tokens"), 2).alias("average_tokens"), F.max("estimated_tokens").alias("largest_tokens"),
        F.min("estimated_tokens").alias("smallest_tokens"), F.bround(F.avg("character_count"), 2).alias("average_characters"), F.bround(F.avg("word_count"), 2).alias("average_words"),
    )


def vector_metadata(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks with ``metadata``: a map of the given columns without nulls."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return chunks.withColumn("metadata", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def streaks(rows: DataFrame, match: Column, min_length: int = 2) -> DataFrame:
    """Runs of at least ``min_length`` consecutive matching rows (doc_id, line_no): doc_id, begin, length."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = rows.withColumns({"hit": match, "n": F.row_number().over(order)}).where("hit")
    grouped = numbered.withColumn("run", F.col("n") - F.row_number().over(order))
    return grouped.groupBy("doc_id", "run").agg(F.min("line_no").alias("begin"), F.count("*").alias("length")).where(F.col("length") >= min_length).drop("run")


def lines(corpus: DataFrame) -> DataFrame:
    """doc_id, line_no from 0, line."""
    return _lines(corpus)


def merge_fragments(rows: DataFrame) -> DataFrame:
    """Lines folded into paragraphs: doc_id, paragraph, fragments, text.

    A fragment begins a paragraph if the last one that isn't blank ends in . ! ? or :, or if it begins a list item.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.last(F.when(strip("line") != "", strip("line")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | before.rlike("[.!?:]$") | strip("line").rlike(r"^(?:[-*•]|\d+[.)])\s")
    marked = rows.withColumn("begins", begins).withColumn("paragraph", F.sum(F.col("begins").cast("int")).over(order))
    kept = marked.where(strip("line") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: strip(x.line)), " ")
    return kept.groupBy("doc_id", "paragraph").agg(F.count("*").alias("fragments"), joined.alias("text"))
