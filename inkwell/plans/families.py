"""Queries on the accessibility rule families, over element tables derived from the table of parts, and their SQL.

An element table is a list of expressions that Spark and the SQL engine read alike; twenty parts in a row make a document.
The result of a family is one row per document, rule and status: how many findings there are, and the first place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements as el
from ..operators import cycles, rules
from ..operators import trees as tr
from ..sources.tables import table

DOC = {"doc_id": "p_partkey - p_partkey % 20", "seq": "p_partkey"}
PARAGRAPHS = {
    **DOC,
    "container": "CASE WHEN p_partkey % 23 = 0 THEN 'textbox' WHEN p_partkey % 29 < 2 THEN 'header' ELSE 'body' END",
    "text": """CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN '- item' WHEN 2 THEN '2. more' WHEN 3 THEN 'A    gap' WHEN 4 THEN 'ALL CAPITALS ARE IN THIS LINE OF TEXT HERE'
        WHEN 5 THEN 'Short title' WHEN 6 THEN ' ' WHEN 7 THEN '' WHEN 8 THEN 'a' || chr(9) || 'b' || chr(9) || 'c' ELSE CASE WHEN p_partkey % 20 = 9 THEN 'x' || chr(9) || chr(9) || 'y.' ELSE 'A sentence ends here.' END END""",
    "heading_level": "CASE WHEN p_partkey % 60 < 20 THEN NULL WHEN p_partkey % 20 = 5 THEN 1 + p_partkey % 3 WHEN p_partkey % 20 = 15 THEN 1 + p_partkey % 4 WHEN p_partkey % 20 = 7 THEN 2 END",
    "is_list": "p_partkey % 7 = 1", "has_drawing": "p_partkey % 26 = 7", "has_page_break": "p_partkey % 34 = 7", "style_name": "CASE WHEN p_partkey % 17 = 5 THEN 'Title' ELSE 'Normal' END",
    "justification": "CASE p_partkey % 6 WHEN 0 THEN 'both' WHEN 1 THEN 'justify' ELSE 'left' END",
    "size_pt": "CAST(CASE WHEN p_partkey % 5 = 0 THEN 14 WHEN p_partkey % 8 = 3 THEN 8 ELSE 11 END AS DOUBLE)", "bold": "p_partkey % 15 = 5", "italic": "p_partkey % 9 = 2", "underline": "p_partkey % 31 = 3",
    "color": "CASE p_partkey % 4 WHEN 0 THEN '777777' WHEN 1 THEN 'FF0000' WHEN 2 THEN '#abc' END", "background": "CASE WHEN p_partkey % 12 = 1 THEN 'EEEEEE' END", "background_known": "p_partkey % 3 <> 0",
    "vert_align": "CASE WHEN p_partkey % 16 = 3 THEN 'superscript' END", "lang": "CASE WHEN p_partkey % 33 = 0 THEN 'fr-FR' WHEN p_partkey % 47 = 0 THEN 'EN-us' ELSE 'en-US' END",
}
RUN = ["text", "size_pt", "bold", "italic", "underline", "color", "background", "background_known", "vert_align", "lang"]
IMAGES = {
    **DOC,
    "alt": "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'photo.png' WHEN 2 THEN 'Picture 3' WHEN 3 THEN 'Description automatically generated' WHEN 4 THEN 'The target' WHEN 5 THEN NULL WHEN 6 THEN ' n7 ' ELSE 'A chart of sales by year' END",
    "decorative": "p_partkey % 11 = 0", "target": "CASE WHEN p_partkey % 2 = 0 THEN 'the TARGET' ELSE 'x' END", "name": "'N7'", "floating": "p_partkey % 4 = 0",
}
LINKS = {
    **DOC,
    "text": "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'Click here' WHEN 2 THEN 'https://x.org' WHEN 3 THEN 'read more...' WHEN 4 THEN NULL ELSE 'The annual report' END",
    "target": "CASE p_partkey % 7 WHEN 0 THEN '#' WHEN 1 THEN 'https://' WHEN 2 THEN 'mailto:x' WHEN 3 THEN 'a b' WHEN 4 THEN NULL WHEN 5 THEN 'mailto:x@y.z' ELSE 'https://x.org/a' END",
    "tooltip": "CASE WHEN p_partkey % 3 = 0 THEN 'about' ELSE ' ' END", "slide_no": "p_partkey % 20",
}
META = {
    "doc_id": "p_partkey",
    "title": "CASE p_partkey % 100 WHEN 0 THEN ' Document1' WHEN 20 THEN NULL WHEN 40 THEN 'Slide 1' ELSE 'Annual report' END", "author": "CASE p_partkey % 60 WHEN 0 THEN '' ELSE 'N. N.' END",
    "default_language": "CASE p_partkey % 120 WHEN 0 THEN NULL WHEN 20 THEN 'english language' WHEN 40 THEN 'fr-fr' ELSE 'en-US' END", "language": "CASE p_partkey % 80 WHEN 0 THEN '' ELSE 'en' END",
    "tracked_changes": "p_partkey % 3", "comments": "p_partkey % 7", "word_count": "2980 + p_partkey % 60", "has_toc": "p_partkey % 40 = 0", "sha256": "'h' || CAST(p_partkey AS STRING)",
    "subject": "CASE WHEN p_partkey % 40 = 0 THEN 'a subject' END", "keywords": "CASE WHEN p_partkey % 60 = 20 THEN 'a, b' END", "theme": "CASE WHEN p_partkey % 60 = 40 THEN '' ELSE 'Office' END", "fonts": "p_partkey % 3", "slides": "p_partkey % 7", "hidden": "p_partkey % 11",
    "has_metadata": "p_partkey % 40 = 0", "tagged": "p_partkey % 60 <> 0", "pdfua": "p_partkey % 80 = 0", "bookmarks": "CASE WHEN p_partkey % 60 <> 20 THEN p_partkey % 3 END",
}
TABLES = {
    **DOC,
    "has_header_row": "p_partkey % 3 <> 0", "merged_cells": "p_partkey % 4", "depth": "p_partkey % 2", "blank_rows": "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", "blank_columns": "CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 0 END",
    "caption": "CASE WHEN p_partkey % 7 = 0 THEN 'c' ELSE ' ' END", "description": "CASE WHEN p_partkey % 8 = 0 THEN 'd' END", "rows": "p_partkey % 9", "columns": "1 + p_partkey % 10",
    "slide_no": "p_partkey % 20", "blank_header_cells": "p_partkey % 5", "alt_text": "CASE WHEN p_partkey % 6 = 0 THEN 'sales' ELSE '' END", "page": "p_partkey % 20", "tagged": "p_partkey % 4 <> 0", "header_cells": "p_partkey % 3", "empty_header_cells": "p_partkey % 7",
}
SECTIONS = {**DOC, "columns": "1 + p_partkey % 3"}
SHAPES = {
    "doc_id": "p_partkey - p_partkey % 20", "slide_no": "CASE WHEN p_partkey % 20 < 7 THEN 1 WHEN p_partkey % 20 < 14 THEN 2 ELSE 3 END", "shape_seq": "p_partkey", "slide_title": "CASE WHEN p_partkey % 100 = 43 THEN 'Add a title' END",
    "type": "CASE p_partkey % 6 WHEN 0 THEN 'Title' WHEN 1 THEN 'body' WHEN 2 THEN 'picture' WHEN 3 THEN 'chart' WHEN 4 THEN 'text' ELSE 'SmartArt' END",
    "text": "CASE p_partkey % 9 WHEN 0 THEN 'Untitled' WHEN 1 THEN '' WHEN 2 THEN 'Same title' WHEN 3 THEN NULL WHEN 4 THEN 'x' || chr(11) || 'y' || chr(11) || 'z' WHEN 5 THEN 'Some words that are so long that they may not fit into the box at all' ELSE 'Body' END",
    "layout": "CASE WHEN p_partkey % 40 < 20 THEN 'Title and text' END", "decorative": "CASE WHEN p_partkey % 10 = 0 THEN true WHEN p_partkey % 10 = 1 THEN NULL ELSE false END", "order": "CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 3 END", "z_order": "CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 13 ELSE NULL END",
    "alt_text": "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'img' WHEN 2 THEN 'Image of a dog' WHEN 3 THEN 'Company logo' WHEN 4 THEN NULL WHEN 5 THEN 'scan.jpeg' ELSE 'A red car' END", "name": "CASE WHEN p_partkey % 8 = 0 THEN 'Logo 1' ELSE 'Picture' END",
    "width": "CAST(100 + (p_partkey % 12) * 100 AS DOUBLE)", "height": "CAST(20 + (p_partkey % 12) * 65 AS DOUBLE)", "has_text_frame": "p_partkey % 6 <> 2", "autosize": "CASE WHEN p_partkey % 3 = 0 THEN 'shape' END",
    "size": "CAST(CASE WHEN p_partkey % 4 = 0 THEN 10 WHEN p_partkey % 4 = 1 THEN 16 ELSE 20 END AS DOUBLE)", "font": "'f' || CAST(p_partkey % 5 AS STRING)", "bold": "p_partkey % 13 = 0",
    "color": "CASE p_partkey % 5 WHEN 0 THEN 'FFFFFF' WHEN 1 THEN '999999' WHEN 2 THEN NULL ELSE '000000' END", "background": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'ffffff' END", "fill_color": "CASE p_partkey % 7 WHEN 0 THEN 'EEEEEE' WHEN 1 THEN '112233' END",
}
NODES = {"doc_id": "p_partkey - p_partkey % 20", "node_id": "p_partkey", "parent_id": "CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 40 < 20 THEN p_partkey - p_partkey % 20 ELSE p_partkey - 1 - p_partkey % 2 * (p_partkey % 20 - 1) END", "type": "CASE p_partkey % 3 WHEN 0 THEN 'Sect' WHEN 1 THEN 'P' ELSE 'H1' END"}
FIGURES = {**DOC, "page": "p_partkey % 20", "alt": "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN ' Figure ' WHEN 2 THEN 'to be described' WHEN 3 THEN 'a.svg' WHEN 4 THEN NULL WHEN 5 THEN '12 34 56 7' WHEN 6 THEN repeat('many words ', 50) ELSE 'A map' END", "caption": "CASE WHEN p_partkey % 3 = 0 THEN 'one two three four five' ELSE 'two words' END", "width": "CAST(p_partkey % 50 AS DOUBLE)", "height": "CAST(30 + p_partkey % 2 AS DOUBLE)"}
WORDS = {"doc_id": "p_partkey - p_partkey % 20", "page": "p_partkey % 2", "size": "CAST(CASE WHEN p_partkey % 30 = 0 THEN 7 ELSE 10 END AS DOUBLE)", "font": "'f' || CAST(p_partkey % 20 AS STRING)", "color": "CASE p_partkey % 9 WHEN 0 THEN 'EEEEEE' WHEN 1 THEN 'cc0000' WHEN 2 THEN NULL ELSE '000000' END", "left": "0.0", "right": "CAST(p_partkey % 300 AS DOUBLE)"}
PAGES = {"doc_id": "p_partkey - p_partkey % 2", "page": "p_partkey % 2", "n_images": "p_partkey % 3", "rotation": "(p_partkey % 3) * 90", "watermarks": "p_partkey % 5"}
FACTS = {"doc_id": "p_partkey - p_partkey % 20", "page": "p_partkey % 2", "width": "300.0", "n_images": "(p_partkey - p_partkey % 20) % 3", "rotation": "((p_partkey - p_partkey % 20) % 7) * 90", "watermarks": "p_partkey % 5"}
FACTS_OF = "p_partkey % 20 < 2"
FRAGMENTS = {
    "doc_id": "p_partkey - p_partkey % 40", "page": "CASE WHEN p_partkey % 40 < 20 THEN 1 ELSE 2 END", "seq": "p_partkey", "tag": "CASE WHEN p_partkey % 2 = 0 OR p_size % 3 > 0 THEN 'H' || CAST(1 + p_size % 6 AS STRING) ELSE 'P' END",
    "text": "CASE p_size % 9 WHEN 0 THEN '(' || CAST(p_partkey % 30 AS STRING) || ')' WHEN 1 THEN CASE WHEN p_partkey % 3 = 0 THEN ' __ - ' ELSE p_name END WHEN 2 THEN repeat(p_name || ' ', 9) WHEN 3 THEN NULL ELSE p_name END",
    "size": "CAST(CASE WHEN p_partkey % 2 = 1 AND p_size % 3 = 0 THEN 9 + p_size % 2 ELSE 8 + (p_size % 12) * 0.85 END AS DOUBLE)", "bold": "p_size % 5 = 0", "x": "CAST(50 + (p_partkey % 2) * 100 AS DOUBLE)", "y": "CAST(700 - (p_partkey % 20 - p_partkey % 2) * 7 - p_size % 2 AS DOUBLE)",
}
EVIDENCE = {
    "doc_id": "p_partkey - p_partkey % 20", "tool": "CASE p_partkey % 3 WHEN 0 THEN 'nvda' WHEN 1 THEN ' JAWS ' ELSE 'other' END", "tool_version": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '1' END", "tester": "'t'", "tested_at": "'2024-01-' || CAST(10 + p_partkey % 20 AS STRING)",
    "result": "CASE p_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'n/a' ELSE NULL END", "document_sha256": "CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE 'H' || CAST(p_partkey - p_partkey % 20 AS STRING) END",
}
ONE_IN_TWENTY = "p_partkey % 20 = 0"


def made(s: SparkSession, d: str, spec: dict[str, str], where: str = "true") -> DataFrame:
    return table(s, d, "part").where(where).select(*[F.expr(e).alias(c) for c, e in spec.items()])


def cte(name: str, spec: dict[str, str], where: str = "true") -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in spec.items())} FROM part WHERE {where})".replace("AS STRING)", "AS VARCHAR)")


def paragraphs(s: SparkSession, d: str) -> DataFrame:
    flat = made(s, d, PARAGRAPHS)
    return flat.withColumn("runs", F.array(F.struct(*RUN))).drop(*[c for c in RUN if c != "text"])


def shapes(s: SparkSession, d: str) -> DataFrame:
    run = F.struct(F.coalesce("text", F.lit("")).alias("text"), "size", "font", "bold", "color")
    return made(s, d, SHAPES).withColumn("runs", F.array(run)).drop("size", "font", "bold", "color")


def summed(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "rule_id", "status").agg(F.count("*").alias("n"), F.min("location").alias("first_location"))


def summed_sql(ctes: list[str], found: list[tuple[str, str, str, str, str]]) -> str:
    """found: (rule, status, source, condition, location)."""
    parts = [f"SELECT doc_id, '{rule}' AS rule_id, '{status}' AS status, CAST({location} AS VARCHAR) AS location FROM {source} WHERE {condition}" for rule, status, source, condition, location in found]
    return f"WITH {', '.join(ctes)}, findings AS ({' UNION ALL '.join(parts)}) SELECT doc_id, rule_id, status, count(*) AS n, min(location) AS first_location FROM findings GROUP BY ALL"


def blank(c: str) -> str:
    return f"trim(coalesce({c}, '')) = ''"


def hex6(c: str) -> str:
    plain = f"upper(replace({c}, '#', ''))"
    return f"(CASE length({plain}) WHEN 3 THEN {plain}[1] || {plain}[1] || {plain}[2] || {plain}[2] || {plain}[3] || {plain}[3] ELSE {plain} END)"


def light(c: str) -> str:
    """Relative luminance of six digits."""
    value = lambda i: f"(CAST('0x' || substr({c}, {i}, 2) AS INT) / 255.0::DOUBLE)"
    channel = lambda i: f"(CASE WHEN {value(i)} <= 0.04045 THEN {value(i)} / 12.92::DOUBLE ELSE pow(({value(i)} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
    return f"(0.2126::DOUBLE * {channel(1)} + 0.7152::DOUBLE * {channel(3)} + 0.0722::DOUBLE * {channel(5)})"


def contrast(a: str, b: str) -> str:
    return f"((greatest({light(a)}, {light(b)}) + 0.05::DOUBLE) / (least({light(a)}, {light(b)}) + 0.05::DOUBLE))"


def streak_sql(name: str, condition: str) -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n, {condition} AS hit FROM body),
 {name} AS (SELECT doc_id, min(seq) AS begin_ FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM {name}_n WHERE hit) GROUP BY doc_id, run HAVING count(*) >= 2)"""


P, BODY = cte("paras", PARAGRAPHS), "body AS (SELECT * FROM paras WHERE container = 'body')"
STRUCTURE_CTES = [
    P, BODY, cte("links", LINKS), cte("meta", META, ONE_IN_TWENTY),
    "heads AS (SELECT *, lag(heading_level) OVER w AS before, row_number() OVER w AS n FROM body WHERE heading_level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY seq))",
    f"counted AS (SELECT doc_id, count(heading_level) AS h, count(*) FILTER (NOT {blank('text')} AND heading_level IS NULL) AS b FROM body GROUP BY doc_id)",
    "chars AS (SELECT doc_id, size_pt, sum(length(text)) AS c FROM body GROUP BY ALL)", "sizes AS (SELECT doc_id, size_pt AS body_size FROM chars QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, size_pt DESC) = 1)",
    streak_sql("typed", "(text LIKE '- %' OR text LIKE '2. %') AND NOT is_list"), streak_sql("hollow", f"{blank('text')} AND NOT has_drawing AND NOT has_page_break"), streak_sql("tabs", "length(text) - length(replace(text, chr(9), '')) >= 2"),
]
STRUCTURE_FOUND = [
    ("STR-001", "FAIL", "counted", "h = 0 AND b >= 5", "'document'"), ("STR-002", "FAIL", "heads", "heading_level > before + 1", "'paragraph ' || seq"), ("STR-003", "FAIL", "heads", "n = 1 AND heading_level <> 1", "'paragraph ' || seq"),
    ("STR-004", "FAIL", "heads", f"{blank('text')} AND NOT has_drawing", "'paragraph ' || seq"),
    ("STR-005", "MANUAL", "body JOIN sizes USING (doc_id)", f"heading_level IS NULL AND NOT is_list AND style_name <> 'Title' AND NOT {blank('text')} AND right(text, 1) NOT IN ('.', ',') AND (bold OR size_pt >= body_size + 2)", "'paragraph ' || seq"),
    ("STR-006", "FAIL", "typed", "true", "begin_"), ("STR-007", "FAIL", "hollow", "true", "begin_"), ("STR-008", "FAIL", "meta", "word_count >= 3000 AND NOT has_toc", "'document'"),
    ("STR-009", "FAIL", "links", f"{blank('text')} OR text IN ('Click here', 'https://x.org', 'read more...')", "target"), ("STR-010", "FAIL", "body", "contains(text, '    ')", "'paragraph ' || seq"),
]
_ALT = "trim(coalesce(alt, ''))"
IMAGE_FOUND = [
    ("IMG-001", "FAIL", "images", f"NOT decorative AND {_ALT} = ''", "seq"), ("IMG-002", "FAIL", "images", f"NOT decorative AND ({_ALT} IN ('photo.png', 'Picture 3', 'n7') OR lower({_ALT}) = lower(target))", "seq"),
    ("IMG-003", "MANUAL", "images", f"NOT decorative AND {_ALT} LIKE 'Description auto%'", "seq"), ("IMG-004", "MANUAL", "images", f"NOT decorative AND {_ALT} <> '' AND {_ALT} NOT IN ('photo.png', 'Picture 3', 'n7') AND lower({_ALT}) <> lower(target)", "seq"),
]
META_CTES = [P, cte("meta", META, ONE_IN_TWENTY), "spoken AS (SELECT DISTINCT doc_id, lang FROM paras)"]
META_FOUND = [
    ("MET-001", "FAIL", "meta", f"{blank('title')} OR trim(title) = 'Document1'", "'properties'"), ("MET-002", "FAIL", "meta", blank("author"), "'properties'"), ("MET-003", "FAIL", "meta", blank("default_language"), "'properties'"),
    ("MET-004", "FAIL", "meta", "default_language = 'english language'", "'properties'"), ("MET-005", "MANUAL", "spoken JOIN meta USING (doc_id)", "lower(lang) IS DISTINCT FROM lower(default_language)", "lang"), ("MET-006", "FAIL", "meta", "tracked_changes > 0 OR comments > 0", "'properties'"),
]
ORDER_CTES = [P, BODY, cte("images", IMAGES), cte("sections", SECTIONS), STRUCTURE_CTES[-1], f"margins AS (SELECT DISTINCT doc_id, container, text FROM paras WHERE container = 'header' AND NOT {blank('text')})"]
ORDER_FOUND = [
    ("ROD-001", "FAIL", "paras", "container = 'textbox'", "seq"), ("ROD-002", "FAIL", "images", "floating AND NOT decorative", "seq"), ("ROD-003", "MANUAL", "sections", '"columns" > 1', "seq"), ("ROD-004", "MANUAL", "margins", "true", "container"), ("ROD-005", "FAIL", "tabs", "true", "begin_"),
]
TABLE_FOUND = [
    ("TBL-001", "FAIL", "tables", "NOT has_header_row", "seq"), ("TBL-002", "FAIL", "tables", "merged_cells > 0", "seq"), ("TBL-003", "FAIL", "tables", "depth > 0", "seq"), ("TBL-004", "FAIL", "tables", "blank_rows > 0 OR blank_columns > 0", "seq"),
    ("TBL-005", "FAIL", "tables", f"{blank('caption')} AND {blank('description')}", "seq"), ("TBL-006", "MANUAL", "tables", '"rows" <= 1 OR "columns" <= 1', "seq"),
]
VISUAL_CTES = [
    P, f"runs AS (SELECT *, coalesce({hex6('color')}, '000000') AS fore, coalesce({hex6('background')}, 'FFFFFF') AS back, CASE WHEN size_pt >= 18 OR (bold AND size_pt >= 14) THEN 3.0 ELSE 4.5 END AS need FROM paras WHERE NOT {blank('text')})",
    f"judged AS (SELECT *, {contrast('fore', 'back')} AS ratio FROM runs)",
]
_CUE = "(coalesce(bold, false) OR coalesce(italic, false) OR coalesce(underline, false))"
VISUAL_FOUND = [
    ("VIS-001", "FAIL", "judged", "ratio < need AND background_known", "seq"), ("VIS-001", "MANUAL", "judged", "ratio < need AND NOT background_known", "seq"), ("VIS-002", "FAIL", "runs", "size_pt < 9 AND coalesce(vert_align, '') <> 'superscript'", "seq || '/0'"),
    ("VIS-003", "MANUAL", "runs", f"color = 'FF0000' AND NOT {_CUE}", "seq || '/0'"), ("VIS-004", "FAIL", "runs", "justification IN ('both', 'justify')", "seq"), ("VIS-005", "FAIL", "runs", "text LIKE 'ALL CAPITALS%'", "seq"),
]
_SA, _SEEN = "trim(coalesce(alt_text, ''))", "trim(coalesce(text, '')) <> ''"
_WEAK = f"{_SA} IN ('img', 'Image of a dog', 'scan.jpeg')"
_PLAIN, _PLACE = "NOT coalesce(decorative, false)", "slide_no || '/' || shape_seq"
SLIDE_IMAGE_FOUND = [
    ("PPT-IMAGE-001", "FAIL", "images", f"{_PLAIN} AND {_SA} = ''", _PLACE), ("PPT-IMAGE-002", "FAIL", "images", f"{_PLAIN} AND {_WEAK}", _PLACE), ("PPT-IMAGE-003", "WARNING", "images", f"decorative AND {_SA} <> ''", _PLACE),
    ("PPT-IMAGE-004", "FAIL", "images", f"(name = 'Logo 1' OR alt_text = 'Company logo') AND ({_SA} = '' OR {_WEAK})", _PLACE), ("PPT-IMAGE-005", "FAIL", "images", f"{_PLAIN} AND {_SA} = '' AND width * height >= 737280", _PLACE), ("PPT-IMAGE-006", "INFO", "images", "true", _PLACE),
]
SLIDE_CTES = [
    cte("shapes", SHAPES),
    f"""slides AS (SELECT doc_id, slide_no, max(layout) AS layout, coalesce(max(slide_title), arg_min(trim(text), shape_seq) FILTER ({_SEEN})) AS any_title, coalesce(max(slide_title), arg_min(trim(text), shape_seq) FILTER ({_SEEN} AND type = 'Title')) AS own_title,
      bool_or({_SEEN}) AS has_text, bool_or({_SEEN} AND type <> 'Title') AS has_body FROM shapes GROUP BY ALL)""",
    "titled AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(any_title)) AS same FROM slides WHERE any_title IS NOT NULL)", "firsts AS (SELECT * FROM slides QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY slide_no) = 1)",
]
_TITLES = "('click to add title', 'add a title', 'title', 'untitled')"
SLIDE_FOUND = [
    ("PPT-HEADING-002", "FAIL", "titled", f"lower(any_title) IN {_TITLES}", "slide_no"), ("PPT-HEADING-003", "FAIL", "titled", "same > 1", "slide_no"), ("PPT-HEADING-004", "FAIL", "firsts", "any_title IS NULL", "slide_no"), ("PPT-STRUCTURE-001", "FAIL", "slides", "own_title IS NULL", "slide_no"),
    ("PPT-STRUCTURE-002", "FAIL", "slides", f"lower(own_title) IN {_TITLES}", "slide_no"), ("PPT-STRUCTURE-003", "FAIL", "slides", "own_title IS NULL AND NOT has_text", "slide_no"), ("PPT-STRUCTURE-004", "WARNING", "slides", "layout IS NULL", "slide_no"), ("PPT-STRUCTURE-005", "FAIL", "slides", "own_title IS NULL OR NOT has_body", "slide_no"),
]
READING_CTES = [
    cte("shapes", SHAPES),
    f"""firsts AS (SELECT doc_id, slide_no, min(shape_seq) FILTER (type = 'Title') AS title, min(shape_seq) FILTER (type IN ('body', 'text')) AS body, min(shape_seq) FILTER (decorative) AS deco, min(shape_seq) FILTER ({_SEEN} AND {_PLAIN}) AS content FROM shapes GROUP BY ALL)""",
    f"""spoken AS (SELECT doc_id, slide_no, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY shape_seq) <> row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY coalesce("order", shape_seq), shape_seq) AS m FROM shapes WHERE {_SEEN})""",
    "moved AS (SELECT doc_id, slide_no FROM spoken GROUP BY ALL HAVING bool_or(m))", "z AS (SELECT doc_id, slide_no, z_order < lag(z_order) OVER (PARTITION BY doc_id, slide_no ORDER BY shape_seq) AS f FROM shapes WHERE z_order IS NOT NULL)", "falls AS (SELECT doc_id, slide_no FROM z GROUP BY ALL HAVING bool_or(f))",
]
READING_FOUND = [("PPT-READING-001", "FAIL", "firsts", "title > body", "slide_no"), ("PPT-READING-002", "FAIL", "moved", "true", "slide_no"), ("PPT-READING-003", "FAIL", "firsts", "deco < content", "slide_no"), ("PPT-READING-004", "FAIL", "falls", "true", "slide_no")]
_T = "coalesce(nullif(trim(coalesce(text, '')), ''), '')"
TEXT_CTES = [
    cte("shapes", SHAPES), "framed AS (SELECT * FROM shapes WHERE has_text_frame)", f"runs AS (SELECT * FROM framed WHERE {_SEEN})", "deck AS (SELECT doc_id FROM runs GROUP BY doc_id HAVING count(DISTINCT font) > 3)",
    f"sized AS (SELECT *, ceil(length({_T}) / greatest(1.0, width / (size * 0.5))) * size * 1.2 AS needed FROM framed)",
]
TEXT_FOUND = [
    ("PPT-TEXT-001", "FAIL", "framed", f"NOT ({_SEEN})", _PLACE), ("PPT-TEXT-002", "FAIL", "runs", "size < 18", _PLACE), ("PPT-TEXT-003", "WARNING", "framed", "contains(text, chr(11))", _PLACE), ("PPT-TEXT-004", "WARNING", "deck", "true", "'deck'"),
    ("PPT-TEXT-005", "WARNING", "sized", "needed > 1.3 * height AND autosize IS NULL", _PLACE), ("PPT-TEXT-006", "FAIL", "runs", "color = upper(background)", _PLACE),
]
COLOR_CTES = [
    cte("shapes", SHAPES),
    f"judged AS (SELECT *, coalesce(fill_color, upper(background)) AS back, CASE WHEN size >= 18 OR (bold AND size >= 14) THEN 3.0 ELSE 4.5 END AS need FROM shapes WHERE {_SEEN})", f"rated AS (SELECT *, CASE WHEN color IS NOT NULL AND back IS NOT NULL THEN {contrast('color', 'back')} END AS ratio FROM judged)",
    f"filled AS (SELECT *, CASE WHEN fill_color IS NOT NULL AND background IS NOT NULL THEN {contrast('fill_color', 'upper(background)')} END AS ratio FROM shapes)",
]
COLOR_FOUND = [
    ("PPT-COLOR-001", "FAIL", "rated", "need = 4.5 AND ratio < 4.5", _PLACE), ("PPT-COLOR-002", "FAIL", "rated", "need = 3.0 AND ratio < 3.0", _PLACE), ("PPT-COLOR-003", "WARNING", "filled", "ratio < 3.0", _PLACE), ("PPT-COLOR-004", "INFO", "shapes", "type = 'SmartArt'", _PLACE),
    ("PPT-COLOR-005", "INFO", "shapes", "type = 'chart'", _PLACE), ("PPT-COLOR-006", "WARNING", "judged", "color IS NULL OR back IS NULL", _PLACE),
]
_U = "trim(coalesce(target, ''))"
SLIDE_LINK_FOUND = [
    ("PPT-LINK-001", "FAIL", "links", f"{_U} IN ('#', 'https://', 'mailto:x', 'a b', '')", "slide_no"), ("PPT-LINK-002", "WARNING", "links", "text LIKE 'https://%'", "slide_no"), ("PPT-LINK-003", "FAIL", "links", f"{blank('text')} OR text = 'Click here'", "slide_no"), ("PPT-LINK-004", "WARNING", "links", blank("tooltip"), "slide_no"),
]
SLIDE_TABLE_FOUND = [
    ("PPT-TABLE-001", "FAIL", "tables", 'NOT has_header_row AND "rows" > 1', "slide_no"), ("PPT-TABLE-002", "WARNING", "tables", "merged_cells > 0", "slide_no"), ("PPT-TABLE-003", "FAIL", "tables", "has_header_row AND blank_header_cells > 0", "slide_no"),
    ("PPT-TABLE-004", "WARNING", "tables", 'NOT has_header_row AND ("rows" <= 1 OR "columns" <= 1)', "slide_no"), ("PPT-TABLE-005", "WARNING", "tables", "alt_text = ''", "slide_no"),
]
SLIDE_META_FOUND = [
    ("PPT-META-001", "FAIL", "meta", f"{blank('title')} OR title = 'Slide 1'", "'deck'"), *[(f"PPT-META-00{i}", "WARNING", "meta", blank(c), "'deck'") for i, c in ((2, "subject"), (3, "author"), (4, "keywords"))], ("PPT-META-005", "FAIL", "meta", blank("language"), "'deck'"),
    *[(f"PPT-PRESENTATION-00{i}", k, "meta", blank(c), "'deck'") for i, k, c in ((1, "FAIL", "title"), (2, "WARNING", "language"), (3, "FAIL", "author"), (4, "WARNING", "theme"))],
    ("PPT-PRESENTATION-005", "FAIL", "meta", "fonts = 0", "'deck'"), ("PPT-PRESENTATION-006", "WARNING", "meta", "slides = 0", "'deck'"), ("PPT-PRESENTATION-007", "WARNING", "meta", "hidden > 0", "'deck'"),
]
PAGE_META_FOUND = [
    ("DOC_HAS_TITLE", "FAIL", "meta", blank("title"), "'document'"), ("DOC_HAS_LANGUAGE", "FAIL", "meta", blank("language"), "'document'"), ("DOC_HAS_METADATA", "WARNING", "meta", "NOT has_metadata", "'document'"), ("DOC_IS_TAGGED", "FAIL", "meta", "NOT tagged", "'document'"),
    ("DOC_PDFUA_DECLARATION", "FAIL", "meta", "NOT pdfua", "'document'"), ("DOC_HAS_BOOKMARKS", "WARNING", "meta", "coalesce(bookmarks, 0) = 0", "'document'"),
]
PAGE_TABLE_FOUND = [("TBL-001", "FAIL", "tables", "NOT tagged", "page"), ("TBL-002", "FAIL", "tables", "tagged AND header_cells = 0", "page"), ("TBL-003", "FAIL", "tables", 'tagged AND "rows" = 0', "page"), ("TBL-004", "FAIL", "tables", "tagged AND empty_header_cells > 0", "page")]
PAGE_IMAGE_FOUND = [("IMG-001", "FAIL", "figures", blank("alt"), "page"), ("IMG-002", "FAIL", "figures", "alt IN (' Figure ', 'to be described', 'a.svg')", "page")]
BACK = {"doc_id": "p_partkey - p_partkey % 20", "page": "p_partkey % 2", "color": "CASE p_partkey % 7 WHEN 0 THEN 'FFF' WHEN 1 THEN 'eeeeee' ELSE '333333' END"}
INK = {**BACK, "color": "CASE p_partkey % 5 WHEN 0 THEN 'FFFFFF' WHEN 1 THEN '777777' WHEN 2 THEN '959595' ELSE '000000' END", "large": "p_partkey % 3 = 0"}
PAGE_COLOR_CTES = [
    cte("ink", INK), cte("backs", BACK), "fore AS (SELECT DISTINCT doc_id, page, color AS fore, large FROM ink)", f"back AS (SELECT DISTINCT doc_id, page, {hex6('color')} AS back FROM backs WHERE {contrast(hex6('color'), chr(39) + '000000' + chr(39))} >= 10)",
    f"worst AS (SELECT doc_id, page, fore, large, min({contrast('fore', 'coalesce(back, ' + chr(39) + 'FFFFFF' + chr(39) + ')')}) AS ratio FROM fore LEFT JOIN back ON back.doc_id = fore.doc_id AND back.page = fore.page AND back.back <> fore.fore GROUP BY ALL)".replace("SELECT doc_id, page, fore, large", "SELECT fore.doc_id, fore.page, fore, large"),
]
PAGE_COLOR_FOUND = [("COLOR-001", "FAIL", "worst", "NOT large AND ratio < 4.5", "page"), ("COLOR-002", "FAIL", "worst", "large AND ratio < 3.0", "page")]
PAGE_VISUAL_CTES = [
    cte("words", WORDS), cte("facts", FACTS, FACTS_OF),
    f"""inked AS (SELECT w.*, "right" - "left" > 0.9 * width AS wide, color IN ('cc0000') AS hued, color = 'EEEEEE' AS light FROM words w JOIN facts USING (doc_id, page))""",
    "counted AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (wide) AS wide, count(*) FILTER (size < 8) AS tiny, count(*) FILTER (hued) AS hued, count(*) FILTER (light) AS light, count(DISTINCT font) AS fonts FROM inked GROUP BY ALL)",
    """totals AS (SELECT f.doc_id, sum(coalesce(tiny, 0)) AS v1, sum(watermarks) AS v2, count(*) FILTER (n_images > 0 AND coalesce(n, 0) < 20) AS v3, count(*) FILTER (n_images > 0 AND coalesce(n, 0) = 0) AS v4, count(*) FILTER (n > 500 OR wide > 40) AS v5,
      count(*) FILTER (fonts > 6) AS v6, count(*) FILTER (rotation % 360 <> 0) AS v7, sum(coalesce(hued, 0)) AS v8, sum(coalesce(light, 0)) AS v9 FROM facts f LEFT JOIN counted c ON c.doc_id = f.doc_id AND c.page = f.page GROUP BY 1)""",
]
PAGE_VISUAL_FOUND = [(f"VIS-00{i}", "INFO" if i == 8 else "WARNING", "totals", f"v{i} > 0", f"v{i}::BIGINT") for i in range(1, 10)]
ELEMENTS = {**DOC, "type": "CASE p_partkey % 10 WHEN 0 THEN 'H1' WHEN 3 THEN 'H' || CAST(2 + (p_partkey - p_partkey % 20) % 3 AS STRING) WHEN 7 THEN CASE WHEN p_partkey % 60 > 40 THEN 'H1' ELSE 'H4' END ELSE 'P' END", "parent_type": "CASE p_partkey % 7 WHEN 0 THEN 'Sect' WHEN 1 THEN 'P' WHEN 2 THEN NULL ELSE 'Document' END", "text": "CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END"}
HEADING_CTES = [
    cte("elements", ELEMENTS, "p_partkey % 80 >= 20 OR p_partkey % 10 NOT IN (0, 3, 7)"), "heads AS (SELECT *, CAST(type[2] AS INT) AS level FROM elements WHERE type LIKE 'H_')", "docs AS (SELECT DISTINCT doc_id FROM elements)",
    "levels AS (SELECT doc_id, count(*) FILTER (level = 1) AS h1 FROM docs LEFT JOIN heads USING (doc_id) GROUP BY doc_id)",
    "gaps AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, level - lag(level) OVER (PARTITION BY doc_id ORDER BY level) AS g FROM (SELECT DISTINCT doc_id, level FROM heads)) WHERE g > 1)",
]
HEADING_FOUND = [
    ("HDR-001", "FAIL", "levels", "h1 = 0", "'document'"), ("HDR-002", "FAIL", "levels", "h1 <> 1", "'document'"), ("HDR-003", "FAIL", "gaps", "true", "'document'"), ("HDR-004", "WARNING", "heads", blank("text"), "seq"),
    ("HDR-005", "FAIL", "heads", "coalesce(parent_type, '') NOT IN ('Sect', 'Document')", "seq"),
]
ADDRESS = r"(https?://[^\s<>]+|www\.[^\s<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
#: Pages of real texts; of a third of them the first address is covered by a link.
LINKED = "WHERE doc_id % 3 = 0 AND regexp_extract(text, '{}', 1, 'i') <> ''".format(ADDRESS)
PAGE_LINK_CTES = [
    f"spelled AS (SELECT doc_id, doc_id % 7 AS page, unnest(regexp_extract_all(text, '{ADDRESS}', 1, 'i')) AS target FROM documents)", f"covered AS (SELECT doc_id, doc_id % 7 AS page, 'MAILTO:' || regexp_extract(text, '{ADDRESS}', 1, 'i') AS target FROM documents {LINKED})",
    "bare AS (SELECT s.* FROM spelled s WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = s.doc_id AND c.page = s.page AND regexp_replace(lower(c.target), '^mailto:|[.,;)]+$', '', 'g') = regexp_replace(lower(s.target), '^mailto:|[.,;)]+$', '', 'g')))",
]
PAGE_LINK_FOUND = [("LINK-001", "FAIL", "bare", "true", "page")]
SLIDE_RUN_CTES = list(dict.fromkeys([*SLIDE_CTES, *[c for c in READING_CTES if not c.startswith("firsts")], READING_CTES[1].replace("firsts AS", "orders AS"), "images AS (SELECT * FROM shapes WHERE type = 'picture')", *TEXT_CTES, *COLOR_CTES, cte("links", LINKS), cte("tables", TABLES), cte("meta", META, ONE_IN_TWENTY)]))
SLIDE_RUN_FOUND = [*SLIDE_FOUND, *[(r, k, "orders" if t == "firsts" else t, c, x) for r, k, t, c, x in READING_FOUND], *SLIDE_IMAGE_FOUND, *TEXT_FOUND, *COLOR_FOUND, *SLIDE_LINK_FOUND, *SLIDE_TABLE_FOUND, *SLIDE_META_FOUND]
PAGE_RUN_CTES = list(dict.fromkeys([cte("figures", FIGURES), cte("tables", TABLES), cte("meta", META, ONE_IN_TWENTY), *HEADING_CTES, *PAGE_LINK_CTES, *PAGE_COLOR_CTES, *PAGE_VISUAL_CTES]))
PAGE_RUN_FOUND = [*HEADING_FOUND, *PAGE_LINK_FOUND, *PAGE_IMAGE_FOUND, *PAGE_TABLE_FOUND, *PAGE_META_FOUND, *PAGE_COLOR_FOUND, *PAGE_VISUAL_FOUND]
WORD_CTES = list(dict.fromkeys([*STRUCTURE_CTES, *ORDER_CTES, *META_CTES, cte("tables", TABLES), *VISUAL_CTES]))
WORD_FOUND = [*STRUCTURE_FOUND, *IMAGE_FOUND, *META_FOUND, *ORDER_FOUND, *TABLE_FOUND, *VISUAL_FOUND]
SCREEN = f"""{cte("evidence", EVIDENCE)}, {cte("meta", META, ONE_IN_TWENTY)},
 mine AS (SELECT e.doc_id, CASE WHEN upper(trim(tool)) = 'NVDA' THEN 'SRV-001' WHEN upper(trim(tool)) = 'JAWS' THEN 'SRV-002' END AS rule_id, upper(result) AS status, tested_at FROM evidence e JOIN meta m ON m.doc_id = e.doc_id AND lower(document_sha256) = sha256
          WHERE tool_version <> '' AND upper(result) IN ('PASS', 'FAIL')),
 latest AS (SELECT doc_id, rule_id, arg_max(status, tested_at) AS status FROM mine GROUP BY ALL),
 tested AS (SELECT m.doc_id, r.rule_id, coalesce(l.status, 'NOT_TESTED') AS status FROM meta m CROSS JOIN (VALUES ('SRV-001'), ('SRV-002')) r(rule_id) LEFT JOIN latest l ON l.doc_id = m.doc_id AND l.rule_id = r.rule_id)"""


def meta(s, d):
    return made(s, d, META, ONE_IN_TWENTY)


def images_of_slides(s, d):
    return rules.slide_images(shapes(s, d))


def all_word_rules(s, d):
    """Verdicts of a run of all word-processor rules."""
    return rules.run_word_checks(paragraphs(s, d), made(s, d, IMAGES), made(s, d, TABLES), made(s, d, LINKS), meta(s, d), made(s, d, SECTIONS), made(s, d, EVIDENCE))[0]


def all_slide_rules(s, d):
    """Verdicts of a run of all slide rules."""
    findings = rules.slide_findings(shapes(s, d), made(s, d, LINKS), made(s, d, TABLES), meta(s, d))
    return rules.run_rules(meta(s, d), findings, rules.SLIDE_SEVERITY)[0]


def elements_of(s, d):
    return made(s, d, ELEMENTS, "p_partkey % 80 >= 20 OR p_partkey % 10 NOT IN (0, 3, 7)")


def linked_pages(s, d):
    """(texts of pages, their links)."""
    pages = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 7).alias("page"), "text")
    first = F.regexp_extract("text", "(?i)" + ADDRESS, 1)
    return pages, pages.where((F.col("doc_id") % 3 == 0) & (first != "")).select("doc_id", "page", F.concat(F.lit("MAILTO:"), first).alias("target"))


def all_page_rules(s, d):
    """Verdicts of a run of all rules of page-based documents."""
    findings = rules.page_findings(elements_of(s, d), *linked_pages(s, d), made(s, d, TABLES), made(s, d, FIGURES), meta(s, d), made(s, d, INK), made(s, d, BACK), made(s, d, WORDS), made(s, d, FACTS, FACTS_OF))
    return rules.run_rules(meta(s, d), findings, rules.PAGE_SEVERITY)[0]


def scope(s, names):
    """Rules of organisation 1, some of them again for its project 7; those that end in 4 are off, every fifth is automatic, one is internal."""
    rows = [(1, p, "metadata" if r.startswith("MET") else r.split("-")[0].lower(), r, not r.endswith("4"), "Properties" if r.startswith("MET") else "Content", k % 5 == 0, r == "MET-006") for k, r in enumerate(names) for p in (None, 7) if p is None or r[-1] in "14"]
    return s.createDataFrame(rows, "org_id int, project_id int, agent string, check_code string, is_active boolean, category string, auto_fixable boolean, internal_check boolean")


def word_report(s, d):
    """One row per document: what a run of the scope's rules comes to."""
    return rules.report(all_word_rules(s, d), scope(s, [*rules.WORD_SEVERITY, "NEW-001"]), 1, 7)[2]


def word_states(s, d):
    """How far each analyser ran: NEW-001 has no verdict."""
    return rules.report(all_word_rules(s, d), scope(s, [*rules.WORD_SEVERITY, "STR-999"]), 1, 7)[1]


def looped_parts(s, d):
    """Parts that lie on a cycle of two links for each part, some of which lead to parts of the other group."""
    parts = table(s, d, "part")
    last = parts.agg(F.max("p_partkey").alias("last"))
    ends = parts.join(F.broadcast(last)).select((F.col("p_partkey") % 2).alias("doc_id"), F.col("p_partkey").alias("source"), F.explode(F.array((F.col("p_partkey") * 7 + F.col("p_size") * 13) % F.col("last"), (F.col("p_partkey") * 3 + F.col("p_size") * 11) % F.col("last"))).alias("target"))
    return cycles.strong_components(ends, parts.select((F.col("p_partkey") % 2).alias("doc_id"), F.col("p_partkey").alias("id")))


def alt_classes(s, d):
    return rules.alt_quality(made(s, d, FIGURES)).groupBy("doc_id", "alt_class").agg(F.count("*").alias("n"), F.count_if("caption_sufficient").alias("captioned"), F.count_if("decorative_by_size").alias("tiny"))


def trees(s, d):
    return rules.tree_checks(tr.flatten_tree(made(s, d, NODES), ancestors=False))


def tree_sizes(s, d):
    return tr.tree_statistics(made(s, d, NODES)).select("doc_id", "elements", "max_depth", "types", F.col("counts")["P"].alias("paragraphs"))


def layouts(s, d):
    return el.page_layout(made(s, d, WORDS).withColumn("doc_id", F.expr("doc_id - doc_id % 2000")), made(s, d, PAGES, "p_partkey % 2000 < 2"))


FAMILIES = {
    "r2_word_structure": (lambda s, d: rules.word_structure(paragraphs(s, d), made(s, d, LINKS), meta(s, d)), STRUCTURE_CTES, STRUCTURE_FOUND),
    "r6_word_images": (lambda s, d: rules.word_images(made(s, d, IMAGES)), [cte("images", IMAGES)], IMAGE_FOUND),
    "r6_slide_images": (images_of_slides, [cte("shapes", SHAPES), "images AS (SELECT * FROM shapes WHERE type = 'picture')"], SLIDE_IMAGE_FOUND),
    "r6_page_images": (lambda s, d: rules.page_images(made(s, d, FIGURES)), [cte("figures", FIGURES)], PAGE_IMAGE_FOUND),
    "r9_word_metadata": (lambda s, d: rules.word_metadata(meta(s, d), paragraphs(s, d)), META_CTES, META_FOUND),
    "r9_slide_metadata": (lambda s, d: rules.slide_metadata(meta(s, d)), [cte("meta", META, ONE_IN_TWENTY)], SLIDE_META_FOUND),
    "r9_page_document": (lambda s, d: rules.page_document(meta(s, d)), [cte("meta", META, ONE_IN_TWENTY)], PAGE_META_FOUND),
    "r10_word_reading_order": (lambda s, d: rules.word_reading_order(paragraphs(s, d), made(s, d, IMAGES), made(s, d, SECTIONS)), ORDER_CTES, ORDER_FOUND),
    "r10_slide_reading_order": (lambda s, d: rules.slide_reading_order(shapes(s, d)), READING_CTES, READING_FOUND),
    "r11_word_tables": (lambda s, d: rules.word_tables(made(s, d, TABLES)), [cte("tables", TABLES)], TABLE_FOUND),
    "r11_slide_tables": (lambda s, d: rules.slide_tables(made(s, d, TABLES)), [cte("tables", TABLES)], SLIDE_TABLE_FOUND),
    "r11_page_tables": (lambda s, d: rules.page_tables(made(s, d, TABLES)), [cte("tables", TABLES)], PAGE_TABLE_FOUND),
    "r12_slide_contrast": (lambda s, d: rules.slide_contrast(shapes(s, d)), COLOR_CTES, COLOR_FOUND),
    "r12_page_colors": (lambda s, d: rules.page_colors(made(s, d, INK), made(s, d, BACK)), PAGE_COLOR_CTES, PAGE_COLOR_FOUND),
    "r13_word_visual": (lambda s, d: rules.word_visual(paragraphs(s, d)), VISUAL_CTES, VISUAL_FOUND),
    "r13_slide_text": (lambda s, d: rules.slide_text(shapes(s, d)), TEXT_CTES, TEXT_FOUND),
    "r13_page_visual": (lambda s, d: rules.page_visual(made(s, d, WORDS), made(s, d, FACTS, FACTS_OF)), PAGE_VISUAL_CTES, PAGE_VISUAL_FOUND),
    "r1_slide_structure": (lambda s, d: rules.slide_structure(shapes(s, d)), SLIDE_CTES, SLIDE_FOUND),
    "w7_page_headings": (lambda s, d: rules.page_headings(elements_of(s, d)), HEADING_CTES, HEADING_FOUND),
    "r5_page_links": (lambda s, d: rules.page_links(*linked_pages(s, d)), PAGE_LINK_CTES, PAGE_LINK_FOUND),
    "r5_slide_links": (lambda s, d: rules.slide_links(made(s, d, LINKS)), [cte("links", LINKS)], SLIDE_LINK_FOUND),
}
QUERIES = {
    **{name: (lambda s, d, family=family: summed(family(s, d))) for name, (family, _, _) in FAMILIES.items()},
    "r14_screen_reader": lambda s, d: rules.screen_reader(made(s, d, EVIDENCE), meta(s, d)),
    "r17_run_word_checks": all_word_rules, "r17_run_slide_checks": all_slide_rules, "r17_run_page_checks": all_page_rules, "w11_heading_eligibility": lambda s, d: el.heading_eligibility(made(s, d, FRAGMENTS)), "n5_cycles": looped_parts, "r17_word_report": word_report, "r17_word_states": word_states, "r7_alt_quality": alt_classes, "r15_tree_checks": trees, "a18_tree_statistics": tree_sizes, "r16_page_layout": layouts,
}
_RANK = "CASE status WHEN 'FAIL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END"
_WALK = f"""WITH RECURSIVE {cte("nodes", NODES)}, walk AS (SELECT doc_id, node_id, type, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.doc_id, n.node_id, n.type, w.depth + 1 FROM nodes n JOIN walk w ON n.doc_id = w.doc_id AND n.parent_id = w.node_id)"""


def run_sql(ctes: list[str], found: list[tuple[str, str, str, str, str]], severity: dict[str, str]) -> str:
    """Verdicts of the findings, for the documents of the CTE meta."""
    findings = summed_sql(ctes, found).rsplit(" SELECT doc_id, rule_id, status, count(*)", 1)[0]
    values = ", ".join(f"('{r}', '{level}')" for r, level in severity.items())
    return findings + f""", own AS (SELECT doc_id, rule_id, arg_max(status, {_RANK}) AS found, count(*) AS n FROM findings GROUP BY ALL), wanted AS (SELECT doc_id, rule_id, severity FROM meta CROSS JOIN (VALUES {values}) v(rule_id, severity))
 SELECT doc_id, rule_id, severity, coalesce(found, 'PASS') AS status, coalesce(n, 0) AS affected_count FROM wanted LEFT JOIN own USING (doc_id, rule_id)"""


_WORD_RUN = (
    run_sql([*WORD_CTES, SCREEN.split(", meta AS")[0], SCREEN[SCREEN.index("mine AS") :]], WORD_FOUND, {r: v for r, v in rules.WORD_SEVERITY.items() if not r.startswith("SRV")})
    + " UNION ALL SELECT doc_id, rule_id, 'HIGH', status, 0 FROM tested"
)
#: fixed values of the scores
_KEPT = "CASE WHEN internal THEN NULL WHEN status = 'PASS' THEN 100 WHEN status = 'WARNING' THEN CASE severity WHEN 'LOW' THEN 90 WHEN 'MEDIUM' THEN 75 WHEN 'HIGH' THEN 60 ELSE 50 END WHEN status = 'FAIL' THEN CASE severity WHEN 'LOW' THEN 60 WHEN 'MEDIUM' THEN 35 WHEN 'HIGH' THEN 15 ELSE 0 END ELSE 50 END"
_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def report_sql(names: list[str], result: str) -> str:
    """A run of the word rules within scope(); result reads rows and states."""
    enabled = [r for r in names if not r.endswith("4")]
    listed = ", ".join(f"('{r}', '{'metadata' if r.startswith('MET') else r.split('-')[0].lower()}', {k % 5 == 0}, {r == 'MET-006'})" for k, r in enumerate(names) if r in enabled)
    return f"""WITH run AS MATERIALIZED ({_WORD_RUN}), catalog(rule_id, analyzer, auto, internal) AS (VALUES {listed}),
 executed AS (SELECT d.doc_id, c.*, coalesce(r.severity, 'MEDIUM') AS severity, coalesce(r.status, 'NOT_EVALUATED') AS status FROM (SELECT DISTINCT doc_id FROM run) d CROSS JOIN catalog c LEFT JOIN run r ON r.doc_id = d.doc_id AND r.rule_id = c.rule_id),
 scored AS (SELECT *, {_KEPT} AS kept, {_WEIGHT} AS weight FROM executed) {result}"""


_REPORT = """, sums AS (SELECT doc_id,
   count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') AS fail_critical, count(*) FILTER (status = 'FAIL' AND severity = 'HIGH') AS fail_high, count(*) FILTER (status = 'FAIL' AND severity = 'MEDIUM') AS fail_medium, count(*) FILTER (status = 'FAIL' AND severity = 'LOW') AS fail_low,
   count(*) FILTER (status = 'WARNING') AS warnings, count(*) FILTER (status IN ('FAIL', 'WARNING') AND auto) AS auto_fixable, count(*) FILTER (status IN ('FAIL', 'WARNING') AND NOT auto) AS manual, round_even(avg(kept), 0)::INT AS retained, count(kept) AS scored_checks,
   coalesce(sum(weight) FILTER (status = 'PASS'), 0) AS p, coalesce(sum(weight) FILTER (status = 'FAIL'), 0) AS f, coalesce(sum(weight) FILTER (status = 'NOT_EVALUATED'), 0) AS m, sum(weight) AS w,
   count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status IN ('MANUAL', 'NOT_TESTED')) AS manual_pending, count(*) FILTER (status = 'NOT_EVALUATED') AS not_evaluated,
   count(*) FILTER (severity = 'CRITICAL' AND status IN ('FAIL', 'WARNING')) AS critical_issues FROM scored GROUP BY doc_id)
 SELECT doc_id, fail_critical, fail_high, fail_medium, fail_low, warnings, auto_fixable, manual, CASE WHEN failed > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS overall, retained, scored_checks,
  CASE WHEN retained >= 90 THEN 'Excellent' WHEN retained >= 75 THEN 'Good' WHEN retained >= 60 THEN 'Needs work' ELSE 'Poor' END AS band, round_even(100.0::DOUBLE * p / (p + f), 1) AS score, round_even(100.0::DOUBLE * (p + f) / (p + f + m), 1) AS coverage,
  CASE WHEN p + f = 0 THEN 'unavailable' WHEN not_evaluated > 0 THEN 'partial' ELSE 'complete' END AS score_status, CASE WHEN fail_critical + fail_high > 0 THEN 'HIGH' WHEN fail_medium > 0 THEN 'MEDIUM' WHEN fail_low > 0 THEN 'LOW' WHEN p + f = 0 THEN 'UNKNOWN' ELSE 'NONE_DETECTED' END AS risk_level,
  passed, failed, manual_pending, not_evaluated, round_even(p / w * 100, 0)::INT AS accessibility_score, 100 AS pdfua_compliance, CASE WHEN fail_critical > 0 THEN 'High' WHEN fail_high > 0 THEN 'Medium' WHEN fail_medium + fail_low > 0 THEN 'Low' ELSE 'None' END AS wcag_risk, critical_issues FROM sums"""
_STATES = """SELECT doc_id, analyzer, CASE WHEN bool_and(status = 'NOT_EVALUATED') THEN 'FAILED' WHEN bool_or(status = 'NOT_EVALUATED') THEN 'PARTIAL' ELSE 'COMPLETED' END AS state FROM executed GROUP BY ALL"""


ORACLES = {
    "r17_run_slide_checks": run_sql(SLIDE_RUN_CTES, SLIDE_RUN_FOUND, rules.SLIDE_SEVERITY), "r17_run_page_checks": run_sql(PAGE_RUN_CTES, PAGE_RUN_FOUND, rules.PAGE_SEVERITY),
    "r17_word_report": report_sql([*rules.WORD_SEVERITY, "NEW-001"], _REPORT), "r17_word_states": report_sql([*rules.WORD_SEVERITY, "STR-999"], _STATES),
    **{name: summed_sql(ctes, found) for name, (_, ctes, found) in FAMILIES.items()},
    "r14_screen_reader": f"WITH {SCREEN} SELECT * FROM tested",
    "r17_run_word_checks": _WORD_RUN,
    "w11_heading_eligibility": rf"""WITH RECURSIVE {cte("f0", FRAGMENTS)}, f AS (SELECT *, trim(coalesce("text", '')) AS t, round_even(y / 4.0, 0) AS bucket, tag LIKE 'H_' AS heading FROM f0),
 bodies AS (SELECT doc_id, round_even("size", 0) AS body FROM f WHERE NOT heading AND length(t) > 40 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(seq)) = 1),
 judged AS (SELECT f.*, CASE WHEN regexp_matches(t, '^[\s_.\-–—·•]*$') THEN 'rule_only' WHEN regexp_matches(t, '^\(?\s*(\d{{1,2}}|[ivxIVX]{{1,4}}|[a-zA-Z])\s*[.)]?\s*$') THEN 'enumerator' WHEN length(t) > 110 THEN 'too_long'
   WHEN EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.page = f.page AND o.bucket = f.bucket AND NOT o.heading AND o.x > f.x + 3 AND length(o.t) >= 8) THEN 'run_in'
   WHEN "size" < coalesce(body, 10) * 0.92::DOUBLE THEN 'sub_body' WHEN "size" <= coalesce(body, 10) * 1.02::DOUBLE AND NOT bold THEN 'not_prominent' END AS reason FROM f LEFT JOIN bodies USING (doc_id) WHERE heading),
 merged AS (SELECT e.doc_id, e.seq, arg_min(h.seq, h.x) AS merged_into, any_value(e.t) AS t, any_value(e.x) AS x FROM judged e JOIN judged h ON h.doc_id = e.doc_id AND h.page = e.page AND h.bucket = e.bucket AND h.reason IS NULL AND h.x > e.x WHERE e.reason = 'enumerator' GROUP BY 1, 2),
 labels AS (SELECT doc_id, merged_into AS seq, string_agg(t, ' ' ORDER BY x, seq) AS label FROM merged GROUP BY 1, 2), stays AS (SELECT *, round("size", 1) AS s FROM judged WHERE reason IS NULL),
 heads AS (SELECT doc_id, max(s) AS s, 1 AS n FROM stays GROUP BY doc_id UNION ALL SELECT h.doc_id, (SELECT max(u.s) FROM stays u WHERE u.doc_id = h.doc_id AND h.s - u.s > 1.2::DOUBLE), n + 1 FROM heads h WHERE h.s IS NOT NULL),
 styled AS (SELECT st.*, least(6, (SELECT max(n) FROM heads h WHERE h.doc_id = st.doc_id AND h.s >= st.s)) AS lv FROM stays st), numbered AS (SELECT *, row_number() OVER w AS n FROM styled WINDOW w AS (PARTITION BY doc_id ORDER BY page, y DESC, x, seq)),
 clamped AS (SELECT doc_id, seq, lv, n, lv AS "level" FROM numbered WHERE n = 1 UNION ALL SELECT k.doc_id, k.seq, k.lv, k.n, least(k.lv, c."level" + 1) FROM clamped c JOIN numbered k ON k.doc_id = c.doc_id AND k.n = c.n + 1)
 SELECT j.doc_id, j.page, j.seq, j.t AS "text", j."size", CASE WHEN m.seq IS NULL THEN reason END AS demoted, merged_into, label, c."level" FROM judged j LEFT JOIN merged m USING (doc_id, seq) LEFT JOIN labels l USING (doc_id, seq) LEFT JOIN clamped c USING (doc_id, seq)""",
    "n5_cycles": """WITH RECURSIVE e AS (SELECT p_partkey % 2 AS doc_id, p_partkey AS s, (p_partkey * 7 + p_size * 13) % (SELECT max(p_partkey) FROM part) AS t FROM part UNION ALL SELECT p_partkey % 2, p_partkey, (p_partkey * 3 + 11 * p_size) % (SELECT max(p_partkey) FROM part) FROM part),
 known AS (SELECT p_partkey % 2 AS doc_id, p_partkey AS n FROM part), g AS (SELECT DISTINCT e.* FROM e JOIN known k ON k.doc_id = e.doc_id AND k.n = e.t),
 reach AS (SELECT doc_id, s, t FROM g UNION SELECT r.doc_id, r.s, g.t FROM reach r JOIN g ON g.doc_id = r.doc_id AND g.s = r.t)
 SELECT a.doc_id, a.s::VARCHAR AS node, min(b.t::VARCHAR) AS component FROM reach a JOIN reach b ON b.doc_id = a.doc_id AND b.s = a.s JOIN reach c ON c.doc_id = a.doc_id AND c.s = b.t AND c.t = a.s WHERE a.s = a.t GROUP BY 1, 2""",
    "r7_alt_quality": f"""WITH {cte("figures", FIGURES)}, k AS (SELECT *, CASE WHEN {blank("alt")} THEN 'empty' WHEN alt IN (' Figure ', 'a.svg') THEN 'placeholder' WHEN alt LIKE '12%' THEN 'corrupt' WHEN alt LIKE 'many%' THEN 'dump' ELSE 'ok' END AS alt_class FROM figures)
 SELECT doc_id, alt_class, count(*) AS n, count(*) FILTER (caption LIKE 'one%') AS captioned, count(*) FILTER (width < 24) AS tiny FROM k GROUP BY ALL""",
    "r15_tree_checks": f"{_WALK} SELECT doc_id, count(*) AS elements, count(*) <= 1 AS is_empty, max(depth) <= 1 AS is_flat FROM walk GROUP BY doc_id",
    "a18_tree_statistics": f"{_WALK} SELECT doc_id, count(*)::BIGINT AS elements, max(depth) AS max_depth, count(DISTINCT type) AS types, nullif(count(*) FILTER (type = 'P'), 0) AS paragraphs FROM walk GROUP BY doc_id",
    "r16_page_layout": f"""WITH {cte("w0", WORDS)}, w AS (SELECT doc_id - doc_id % 2000 AS doc_id, page, count(*) AS n, count(*) FILTER ("right" - "left" > 200) AS wide FROM w0 GROUP BY 1, 2), {cte("facts", PAGES, "p_partkey % 2000 < 2")}
 SELECT f.doc_id, f.page, coalesce(n, 0) AS n_words, coalesce(n, 0) > 500 OR coalesce(wide, 0) > 40 AS dense, coalesce(n, 0) < 20 AND n_images > 0 AS scanned, rotation % 360 <> 0 AS rotated FROM facts f LEFT JOIN w ON w.doc_id = f.doc_id AND w.page = f.page""",
}
