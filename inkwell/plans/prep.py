"""Queries on corpus preparation and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, strip
from ..operators import prep as p
from .text import WORDS, docs

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
SENT = r"regexp_split_to_array(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_BLOCKS = "blocks AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda b: " + STRIP.format("b") + "), lambda b: b <> '')) AS block FROM documents)"
_CHUNKS = f"chunks AS (SELECT doc_id, {STRIP.format('text')} AS text FROM documents WHERE {STRIP.format('text')} <> '')"
_SIZE = "greatest(1, ceil(length(text) / 4))::BIGINT"
CONFIG = p.ChunkConfig(min_chunk_size=150, max_chunk_size=600)


def sentence_chunks(s, d):
    """Sentences as chunks, small ones merged."""
    return p.merge_small_chunks(p.sentences(docs(s, d)).select("doc_id", F.col("position").alias("chunk_index"), F.col("sentence").alias("text")), 20)


QUERIES = {
    "s1_load_corpus": lambda s, d: p.corpus_facts(docs(s, d)),
    "c1_normalize_text": lambda s, d: p.normalize_text(docs(s, d)).select("doc_id", "text"),
    "c2_estimate_tokens": lambda s, d: docs(s, d).select("doc_id", estimate_tokens("text").alias("tokens")),
    "c3_sentences": lambda s, d: p.sentences(docs(s, d)),
    "c4_blocks": lambda s, d: p.blocks(docs(s, d)),
    "c5_headings": lambda s, d: p.headings(docs(s, d), heuristic=True),
    "c6_chunk_fixed": lambda s, d: p.chunk_fixed(docs(s, d), CONFIG),
    "c7_chunk_paragraph": lambda s, d: p.chunk_paragraph(docs(s, d)),
    "c8_chunk_heading": lambda s, d: p.chunk_heading(docs(s, d), CONFIG),
    "c9_merge_small_chunks": sentence_chunks,
    "c10_chunk_documents": lambda s, d: p.chunk_documents(docs(s, d), "paragraph", CONFIG)[0],
    "c11_vector_metadata": lambda s, d: p.vector_metadata(docs(s, d), ["doc_id", "lang", "source"]).select("doc_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))).alias("metadata")),
    "a12_chunk_statistics": lambda s, d: p.chunk_statistics(p.chunk_paragraph(docs(s, d))),
    "w8_streaks": lambda s, d: p.streaks(p.lines(docs(s, d)), F.length("line") > 200),
    "w13_merge_fragments": lambda s, d: p.merge_fragments(p.lines(docs(s, d))),
}
ORACLES = {
    "s1_load_corpus": f"SELECT doc_id, len({WORDS.format('text')})::INT AS word_count, length(text)::INT AS character_count, CASE WHEN {STRIP.format('text')} = '' THEN 'error' ELSE 'success' END AS status FROM documents",
    "c1_normalize_text": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{ad}]', '', 'g') AS t FROM documents),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\t\f\x0b]', ' ', 'g'), ' {2,}', ' ', 'g') AS t FROM a)
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""",
    "c2_estimate_tokens": f"SELECT doc_id, CASE WHEN {STRIP.format('text')} = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END::BIGINT AS tokens FROM documents",
    "c3_sentences": f"WITH a AS (SELECT doc_id, list_filter(list_transform({SENT.format('text')}, lambda s: array_to_string({WORDS.format('s')}, ' ')), lambda s: s <> '') AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS sentence FROM a",
    "c4_blocks": "WITH a AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda b: " + STRIP.format("b") + "), lambda b: b <> '') AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS block FROM a",
    "c5_headings": f"WITH {LINES}, b AS (SELECT doc_id, line_no, {STRIP.format('line')} AS t FROM lines) SELECT doc_id, line_no, NULL::INT AS level, t AS title, 'heuristic' AS source FROM b WHERE t <> '' AND NOT regexp_matches(t, '[.,;:!?]$') AND length(t) <= 80 AND len({WORDS.format('t')}) <= 12",
    "c7_chunk_paragraph": f"WITH {_CHUNKS} SELECT doc_id, 0 AS chunk_index, text, len({WORDS.format('text')})::INT AS word_count, length(text)::INT AS character_count, {_SIZE} AS estimated_tokens, 'paragraph' AS source_type FROM chunks",
    "c9_merge_small_chunks": f"""WITH a AS (SELECT doc_id, list_filter(list_transform({SENT.format('text')}, lambda s: array_to_string({WORDS.format('s')}, ' ')), lambda s: s <> '') AS l FROM documents),
 b AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS text FROM a), c AS (SELECT *, CASE WHEN {_SIZE} >= 20 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS begins FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 e AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM c) SELECT doc_id, (part - 1)::INT AS chunk_index, {STRIP.format("string_agg(text, ' ' ORDER BY i)")} AS text FROM e GROUP BY doc_id, part""",
    "c11_vector_metadata": "SELECT doc_id, '{\"doc_id\":\"' || doc_id || '\",\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS metadata FROM documents",
    "a12_chunk_statistics": f"WITH {_CHUNKS} SELECT doc_id, 1 AS total_chunks, {_SIZE} AS total_tokens, {_SIZE}::DOUBLE AS average_tokens, {_SIZE} AS largest_tokens, {_SIZE} AS smallest_tokens, length(text)::DOUBLE AS average_characters, len({WORDS.format('text')})::DOUBLE AS average_words FROM chunks",
    "w8_streaks": f"WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines), h AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n WHERE length(line) > 200) SELECT doc_id, min(line_no) AS begin, count(*) AS length FROM h GROUP BY doc_id, run HAVING count(*) >= 2",
    "w13_merge_fragments": rf"""WITH {LINES}, s AS (SELECT doc_id, line_no, {STRIP.format('line')} AS t FROM lines),
 b AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
 c AS (SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '[.!?:]$') OR regexp_matches(t, '^(?:[-*•]|\d+[.)])\s') THEN 1 ELSE 0 END AS begins FROM b), e AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM c)
 SELECT doc_id, paragraph, count(*) AS fragments, string_agg(t, ' ' ORDER BY line_no) AS text FROM e WHERE t <> '' GROUP BY 1, 2""",
}
