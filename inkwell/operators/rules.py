"""Accessibility rules on element tables of word-processor documents, slide decks and page-based documents.

A rule is a column: a finding (rule_id, status, location, message) where a row offends, else null. A table's rules are put into
one array that is exploded once, so that a table is read once however many rules look at it; what a rule must know of other
rows is a window within its document. A family is a function from element tables to findings, ``*_findings`` are all families
of a kind of document. ``verdicts`` turns findings into one row per document and rule, and ``report`` carries them through the
scope's catalogue to coverage and scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contrast_ratio, parse_hex, strip, word_count
from ..sources.shared import Tables, dealt
from .catalog import resolve_checks
from .score import cap_findings, dashboard_kpis, executed_checks_coverage, retained_score, validation_summary, weighted_score

#: Fixed values
WORD_SEVERITY = {
    "STR-001": "CRITICAL", "STR-002": "HIGH", "STR-003": "MEDIUM", "STR-004": "MEDIUM", "STR-005": "HIGH", "STR-006": "HIGH", "STR-007": "LOW", "STR-008": "LOW", "STR-009": "MEDIUM", "STR-010": "LOW",
    "IMG-001": "CRITICAL", "IMG-002": "HIGH", "IMG-003": "MEDIUM", "IMG-004": "HIGH", "MET-001": "HIGH", "MET-002": "LOW", "MET-003": "CRITICAL", "MET-004": "HIGH", "MET-005": "MEDIUM", "MET-006": "MEDIUM",
    "ROD-001": "HIGH", "ROD-002": "MEDIUM", "ROD-003": "MEDIUM", "ROD-004": "MEDIUM", "ROD-005": "MEDIUM", "TBL-001": "HIGH", "TBL-002": "MEDIUM", "TBL-003": "HIGH", "TBL-004": "MEDIUM", "TBL-005": "LOW", "TBL-006": "MEDIUM",
    "VIS-001": "HIGH", "VIS-002": "MEDIUM", "VIS-003": "MEDIUM", "VIS-004": "LOW", "VIS-005": "LOW", "SRV-001": "HIGH", "SRV-002": "HIGH",
}
VAGUE_LINKS = ["click here", "here", "link", "this link", "read more", "more", "learn more", "click", "this", "go"]
SLIDE_VAGUE_LINKS = [
    "click here", "click", "here", "link", "this link", "this", "read more", "more", "learn more", "see more", "go", "go here", "download", "click this",
    "click to read", "read", "info", "details", "this page", "website", "url",
]
PLACEHOLDER_TITLES = ["word document", "document", "untitled", "title", "document1", "new document"]
SLIDE_PLACEHOLDERS = ["click to add title", "add a title", "title", "untitled"]
DEFAULT_DECK_TITLES = ["powerpoint presentation", "presentation", "untitled", "untitled presentation", "slide 1", "deck"]
GENERIC_ALT = ["image", "picture", "photo", "photograph", "graphic", "img", "pic", "icon", "screenshot", "untitled", "figure", "diagram", "shape", "object"]
IMAGE_FILE = r"(?i)\.(png|jpe?g|gif|bmp|svg|tiff?|webp|emf|wmf|heic)\b"
DEFAULT_NAME = r"(?i)^(picture|image|content placeholder|google shape|shape|object|graphic|placeholder)\s*[\d;:_-]*$"
REDUNDANT_ALT = r"(?i)^(an?\s+)?(image|picture|photo|graphic)\s+of\b"
AUTO_ALT = r"(?i)description automatically generated|ai-generated content|generated with"
LIST_MARK = r"^\s*(?:[-*•–o]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+\S"
URL = r"(?i)^(?:https?://|www\.|mailto:)"
COLUMNS = ["doc_id", "rule_id", "status", "location", "message"]


def rule(rule_id: str, offends: Column, location: Column, message: Column | str, status: str = "FAIL") -> Column:
    """A finding where a row offends, else null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(offends, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(status).alias("status"), location.cast("string").alias("location"), text.alias("message")))


def found(rows: DataFrame, rules: list[Column]) -> DataFrame:
    """The findings of all rules on every row; each row is read once."""
    return rows.select("doc_id", F.inline(F.array_compact(F.array(*rules))))


def bound(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with columns that are worked out once a row, however often they are used later."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [p.select(*COLUMNS) for p in parts])


def _blank(c: Column | str) -> Column:
    return strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def verdicts(documents: DataFrame, findings: DataFrame, rules: list[str], severity: dict[str, str] | None = None) -> DataFrame:
    """doc_id, rule_id, severity, status (worst finding, else PASS), affected_count for every document and rule.

    Findings are counted first, and what is left meets its document in one row, as much as there are rules and statuses.
    """
    rank = F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "WARNING", 2).otherwise(1)
    counted = findings.where(F.col("rule_id").isin(rules)).groupBy("doc_id", "rule_id", "status").agg(F.count("*").alias("n"))
    own = counted.groupBy("doc_id").agg(F.collect_list(F.struct("rule_id", rank.alias("rank"), "status", "n")).alias("own"))
    levels = WORD_SEVERITY if severity is None else severity
    wanted = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(levels.get(r, "MEDIUM")).alias("severity")) for r in rules])
    mine = documents.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", "own", F.inline(wanted)).select("doc_id", "rule_id", "severity", F.filter("own", lambda x: x.rule_id == F.col("rule_id")).alias("mine"))
    worst = F.array_max(F.transform("mine", lambda x: F.struct(x.rank, x.status))).getField("status")
    return mine.select("doc_id", "rule_id", "severity", F.coalesce(worst, F.lit("PASS")).alias("status"), F.aggregate(F.coalesce("mine", F.array().cast(mine.schema["mine"].dataType)), F.lit(0).cast("long"), lambda a, x: a + x.n).alias("affected_count"))


# --- word-processor documents ---------------------------------------------------------------------------------------


RUN_FIELDS = ["text", "size_pt", "bold", "italic", "underline", "color", "background", "background_known", "vert_align", "lang"]


def paragraph_rows(paragraphs: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """What the rules on paragraphs and runs read: one row for each run, one for a paragraph without runs.

    ``lead`` marks a paragraph's first row. Facts about a document, a size, a streak or a paragraph are windows that all lie
    within a document, so that paragraphs are read once and shuffled once, to tasks of a bounded number of them. With ``meta``, default_language is joined.
    """
    inked = F.filter("runs", lambda r: strip(F.coalesce(r.text, F.lit(""))) != "")
    flat = dealt(paragraphs, "doc_id").select(
        "doc_id", "seq", "container", "style_name", "heading_level", "is_list", "has_drawing", "has_page_break", "justification", "text",
        ((F.size(inked) > 0) & F.forall(inked, lambda r: F.coalesce(r.bold, F.lit(False)))).alias("all_bold"), F.array_min(F.transform(inked, lambda r: r.size_pt)).alias("least_size"), F.posexplode_outer("runs").alias("_run", "_r"),
    )
    # fields of a run as columns of their own
    flat = flat.select("*", F.coalesce("_run", F.lit(0)).alias("run"), (F.coalesce("_run", F.lit(0)) == 0).alias("lead"), F.col("_r").isNotNull().alias("has_run"), *[F.col(f"_r.{c}").alias(f"r_{c}") for c in RUN_FIELDS]).drop("_run", "_r")
    if meta is not None:
        flat = flat.join(meta.select("doc_id", "default_language", F.lit(True).alias("has_meta")), "doc_id", "left")
    in_body, spoken = F.col("container") == "body", F.col("has_run") & ~_blank("r_text")
    flat = flat.withColumns({
        "body": _yes(F.col("lead") & in_body), "sized": _yes(in_body & F.col("r_size_pt").isNotNull()), "spoken": spoken, "margin": _yes(F.col("lead") & F.col("container").isin("header", "footer") & ~_blank("text")), "lang": F.when(~_blank("r_lang"), F.col("r_lang")),
        "typed": _yes(F.col("text").rlike(LIST_MARK) & ~F.col("is_list")), "hollow": _yes(_blank("text") & ~F.col("has_drawing") & ~F.col("has_page_break")),
        "tabbed": _yes(((F.length("text") - F.length(F.replace("text", F.lit("\t"), F.lit("")))) >= 2) & ~F.coalesce(F.lower("style_name"), F.lit("")).startswith("toc")),
    })
    colours = bound(flat, ink=parse_hex("r_color"), back=F.coalesce(parse_hex("r_background"), F.lit("FFFFFF")))
    judged = bound(colours, ratio=F.when(F.col("spoken"), contrast_ratio(F.coalesce("ink", F.lit("000000")), "back")))
    poor = F.col("ratio") < needed_contrast(F.coalesce("r_size_pt", F.lit(11.0)), F.col("r_bold"))
    doc, size, lines = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "r_size_pt"), Window.partitionBy("doc_id", "body").orderBy("seq")
    place, again, language = Window.partitionBy("doc_id", "seq").orderBy("run", "container"), Window.partitionBy("doc_id", "margin", "container", "text").orderBy("seq", "run"), Window.partitionBy("doc_id", "lang").orderBy("seq", "run")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = lambda c: F.col("body") & F.col(c) & ~_yes(F.lag(c).over(lines)) & _yes(F.lead(c).over(lines))
    head = F.col("body") & F.col("heading_level").isNotNull()
    rows = judged.withColumns({"chars": F.sum(F.when(F.col("sized"), F.length("r_text"))).over(size)}).withColumns({
        "line_no": F.row_number().over(lines), "before": F.last(F.when(head, F.col("heading_level")), True).over(lines.rowsBetween(Window.unboundedPreceding, -1)),
        "typed_begins": begins("typed"), "hollow_begins": begins("hollow"), "tabs_begin": begins("tabbed"),
    })
    rows = rows.withColumns({"place_no": F.row_number().over(place), "worst": F.min(F.when(poor, F.col("ratio"))).over(whole), "known": F.min_by("r_background_known", F.when(poor, F.col("ratio"))).over(whole)})
    rows = rows.withColumns({"margin_no": F.row_number().over(again)}).withColumns({"lang_no": F.row_number().over(language)})
    return rows.withColumns({
        "headings": F.count_if(head).over(doc), "texts": F.count_if(F.col("body") & ~_blank("text") & F.col("heading_level").isNull()).over(doc), "body_size": F.max_by("r_size_pt", F.when(F.col("sized"), F.struct("chars", "r_size_pt"))).over(doc),
    })


def paragraph_structure() -> list[Column]:
    """STR-001..007 and 010 of paragraph_rows()."""
    at, body, t = F.concat(F.lit("paragraph "), F.col("seq")), F.col("body"), strip("text")
    head = body & F.col("heading_level").isNotNull()
    should = F.concat(F.lit("Use Heading "), (F.col("before") + 1).cast("string"), F.lit(" instead of Heading "), F.col("heading_level").cast("string"))
    plain = body & F.col("heading_level").isNull() & ~F.col("is_list") & ~F.coalesce("style_name", F.lit("")).rlike("(?i)^(title|subtitle|caption|toc|table of|header|footer)")
    looks = ~_blank("text") & (F.length(t) <= 120) & ~t.rlike("[.,;:!?]$") & (F.col("all_bold") | (F.col("least_size") >= F.col("body_size") + 2))
    return [
        rule("STR-001", body & (F.col("line_no") == 1) & (F.col("headings") == 0) & (F.col("texts") >= 5), F.lit("document"), "No heading styles are used"),
        rule("STR-002", head & (F.col("heading_level") > F.col("before") + 1), at, should), rule("STR-003", head & F.col("before").isNull() & (F.col("heading_level") != 1), at, "The first heading is not Heading 1"),
        rule("STR-004", head & _blank("text") & ~F.col("has_drawing"), at, "Empty heading"), rule("STR-005", plain & looks, at, "Looks like a heading", "MANUAL"),
        rule("STR-006", F.col("typed_begins"), F.col("seq"), "Typed list markers"), rule("STR-007", F.col("hollow_begins"), F.col("seq"), "Empty paragraphs in a row"), rule("STR-010", body & F.col("text").rlike(" {4,}"), at, "Repeated spaces"),
    ]


def link_structure() -> list[Column]:
    """STR-009."""
    vague = ~_blank("text") & (strip("text").rlike(URL) | F.regexp_replace(F.lower(strip("text")), r"\.+$", "").isin(VAGUE_LINKS))
    return [rule("STR-009", _blank("text") | vague, F.col("target"), "Link text is not descriptive")]


def meta_structure() -> list[Column]:
    """STR-008."""
    return [rule("STR-008", (F.col("word_count") >= 3000) & ~F.col("has_toc"), F.lit("document"), "Long document without contents")]


def paragraph_order() -> list[Column]:
    """ROD-001, 004 and 005 of paragraph_rows()."""
    boxed = F.col("lead") & (F.col("container") == "textbox")
    return [
        rule("ROD-001", boxed, F.col("seq"), "Text box"), rule("ROD-004", F.col("margin") & (F.col("margin_no") == 1), F.col("container"), F.col("text"), "MANUAL"), rule("ROD-005", F.col("tabs_begin"), F.col("seq"), "Tabs imitate a table"),
    ]


def paragraph_visual() -> list[Column]:
    """VIS-001..005 of paragraph_rows()."""
    note, lead = F.concat(F.lit("Contrast "), F.format_number("worst", 2)), F.col("lead")
    dim = (F.col("place_no") == 1) & F.col("worst").isNotNull()
    channel = lambda i: F.conv(F.substring("ink", i, 2), 16, 10).cast("int")
    spread = F.greatest(channel(1), channel(3), channel(5)) - F.least(channel(1), channel(3), channel(5))
    cue = F.coalesce("r_bold", F.lit(False)) | F.coalesce("r_italic", F.lit(False)) | F.coalesce("r_underline", F.lit(False))
    small = (F.col("r_size_pt") < 9) & ~F.coalesce("r_vert_align", F.lit("")).isin("superscript", "subscript")
    capital = (word_count("text") >= 8) & (F.col("text") == F.upper("text")) & F.col("text").rlike(r"\p{Lu}")
    at = F.concat_ws("/", "seq", "run")
    return [
        rule("VIS-001", dim & F.coalesce("known", F.lit(True)), F.col("seq"), note), rule("VIS-001", dim & ~F.coalesce("known", F.lit(True)), F.col("seq"), note, "MANUAL"), rule("VIS-002", F.col("spoken") & small, at, "Text below 9 points"),
        rule("VIS-003", F.col("spoken") & (spread > 40) & ~cue, at, "Colour may be the only cue", "MANUAL"), rule("VIS-004", lead & F.lower("justification").isin("both", "justify", "distribute") & ~_blank("text"), F.col("seq"), "Justified text"),
        rule("VIS-005", lead & capital, F.col("seq"), "All capitals"),
    ]


def paragraph_languages() -> list[Column]:
    """MET-005 of paragraph_rows() with meta."""
    other = F.col("has_meta") & F.col("lang").isNotNull() & (F.col("lang_no") == 1) & ~F.lower("lang").eqNullSafe(F.lower("default_language"))
    return [rule("MET-005", other, F.col("lang"), "Other languages are marked", "MANUAL")]


def image_rules() -> list[Column]:
    """IMG-001..004."""
    alt = strip(F.coalesce("alt", F.lit("")))
    real = ~F.col("decorative") & (alt != "")
    weak = alt.rlike(IMAGE_FILE) | alt.rlike(DEFAULT_NAME) | (F.lower(alt) == F.lower(F.coalesce("target", F.lit("")))) | (F.lower(alt) == F.lower(F.coalesce("name", F.lit(""))))
    at = F.col("seq")
    return [
        rule("IMG-001", ~F.col("decorative") & (alt == ""), at, "Missing alt text"), rule("IMG-002", real & weak, at, "Placeholder alt text"),
        rule("IMG-003", real & alt.rlike(AUTO_ALT), at, "Auto-generated alt text", "MANUAL"), rule("IMG-004", real & ~weak, at, "Check that the alt text describes the image", "MANUAL"),
    ]


def image_order() -> list[Column]:
    """ROD-002."""
    return [rule("ROD-002", F.col("floating") & ~F.col("decorative"), F.col("seq"), "Floating object")]


def section_order() -> list[Column]:
    """ROD-003."""
    return [rule("ROD-003", F.col("columns") > 1, F.col("seq"), "Several columns", "MANUAL")]


def property_rules() -> list[Column]:
    """MET-001..004 and 006."""
    where = F.lit("properties")
    return [
        rule("MET-001", _blank("title") | F.lower(strip("title")).isin(PLACEHOLDER_TITLES), where, "The title is missing or a placeholder"), rule("MET-002", _blank("author"), where, "The author is missing"),
        rule("MET-003", _blank("default_language"), where, "The language is missing"), rule("MET-004", ~_blank("default_language") & ~strip("default_language").rlike("(?i)^[a-z]{2,3}(-[a-z0-9]{2,8})*$"), where, "The language tag is not valid"),
        rule("MET-006", (F.col("tracked_changes") > 0) | (F.col("comments") > 0), where, "Unresolved changes or comments"),
    ]


def table_rules() -> list[Column]:
    """TBL-001..006."""
    at = F.col("seq")
    return [
        rule("TBL-001", ~F.col("has_header_row"), at, "No header row"), rule("TBL-002", F.col("merged_cells") > 0, at, "Merged cells"), rule("TBL-003", F.col("depth") > 0, at, "Nested table"),
        rule("TBL-004", (F.col("blank_rows") > 0) | (F.col("blank_columns") > 0), at, "Blank rows or columns"), rule("TBL-005", _blank("caption") & _blank("description"), at, "No title or description"),
        rule("TBL-006", (F.col("rows") <= 1) | (F.col("columns") <= 1), at, "May be a layout table", "MANUAL"),
    ]


def needed_contrast(size: Column, bold: Column) -> Column:
    """3.0 for large text (18 points, or 14 in bold), else 4.5."""
    return F.when((size >= 18) | (F.coalesce(bold, F.lit(False)) & (size >= 14)), 3.0).otherwise(4.5)


def word_structure(paragraphs: DataFrame, links: DataFrame, meta: DataFrame) -> DataFrame:
    """STR-001..010."""
    return together(found(paragraph_rows(paragraphs), paragraph_structure()), found(links, link_structure()), found(meta, meta_structure()))


def word_images(images: DataFrame) -> DataFrame:
    """IMG-001..004."""
    return found(images, image_rules())


def word_metadata(meta: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """MET-001..006."""
    return together(found(meta, property_rules()), found(paragraph_rows(paragraphs, meta), paragraph_languages()))


def word_reading_order(paragraphs: DataFrame, images: DataFrame, sections: DataFrame) -> DataFrame:
    """ROD-001..005; sections: doc_id, seq, columns."""
    return together(found(paragraph_rows(paragraphs), paragraph_order()), found(images, image_order()), found(sections, section_order()))


def word_tables(tables: DataFrame) -> DataFrame:
    """TBL-001..006."""
    return found(tables, table_rules())


def word_visual(paragraphs: DataFrame) -> DataFrame:
    """VIS-001..005."""
    return found(paragraph_rows(paragraphs), paragraph_visual())


def word_findings(paragraphs: DataFrame, images: DataFrame, tables: DataFrame, links: DataFrame, meta: DataFrame, sections: DataFrame) -> DataFrame:
    """STR, IMG, MET, ROD, TBL and VIS; every element table is read once."""
    return together(
        found(paragraph_rows(paragraphs, meta), [*paragraph_structure(), *paragraph_languages(), *paragraph_order(), *paragraph_visual()]), found(images, [*image_rules(), *image_order()]), found(tables, table_rules()),
        found(links, link_structure()), found(meta, [*meta_structure(), *property_rules()]), found(sections, section_order()),
    )


def screen_reader(evidence: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, rule_id, status of SRV-001 (NVDA) and SRV-002 (JAWS): the latest complete record of this file, else NOT_TESTED."""
    complete = F.lit(True)
    for c in ("tool_version", "tester", "tested_at", "result", "document_sha256"):
        complete = complete & ~_blank(c)
    rows = evidence.where(complete & F.upper("result").isin("PASS", "FAIL")).withColumn("rule_id", F.when(F.upper(strip("tool")) == "NVDA", "SRV-001").when(F.upper(strip("tool")) == "JAWS", "SRV-002"))
    mine = rows.join(meta.select("doc_id", "sha256"), "doc_id").where(F.lower("document_sha256") == F.col("sha256"))
    latest = mine.groupBy("doc_id", "rule_id").agg(F.max_by(F.upper("result"), "tested_at").alias("status"))
    wanted = meta.select("doc_id", F.explode(F.array(F.lit("SRV-001"), F.lit("SRV-002"))).alias("rule_id"))
    return wanted.join(latest, ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", F.coalesce("status", F.lit("NOT_TESTED")).alias("status"))


# --- slide decks ----------------------------------------------------------------------------------------------------

#: Fixed values
SLIDE_SEVERITY = {
    "PPT-HEADING-002": "HIGH", "PPT-HEADING-003": "MEDIUM", "PPT-HEADING-004": "MEDIUM", "PPT-STRUCTURE-001": "HIGH", "PPT-STRUCTURE-002": "HIGH", "PPT-STRUCTURE-003": "MEDIUM", "PPT-STRUCTURE-004": "LOW", "PPT-STRUCTURE-005": "HIGH",
    "PPT-READING-001": "HIGH", "PPT-READING-002": "MEDIUM", "PPT-READING-003": "MEDIUM", "PPT-READING-004": "MEDIUM",
    "PPT-IMAGE-001": "HIGH", "PPT-IMAGE-002": "MEDIUM", "PPT-IMAGE-003": "LOW", "PPT-IMAGE-004": "MEDIUM", "PPT-IMAGE-005": "HIGH", "PPT-IMAGE-006": "LOW",
    "PPT-TEXT-001": "MEDIUM", "PPT-TEXT-002": "MEDIUM", "PPT-TEXT-003": "LOW", "PPT-TEXT-004": "LOW", "PPT-TEXT-005": "MEDIUM", "PPT-TEXT-006": "HIGH",
    "PPT-COLOR-001": "HIGH", "PPT-COLOR-002": "HIGH", "PPT-COLOR-003": "MEDIUM", "PPT-COLOR-004": "LOW", "PPT-COLOR-005": "LOW", "PPT-COLOR-006": "LOW",
    "PPT-LINK-001": "HIGH", "PPT-LINK-002": "LOW", "PPT-LINK-003": "MEDIUM", "PPT-LINK-004": "LOW", "PPT-TABLE-001": "HIGH", "PPT-TABLE-002": "MEDIUM", "PPT-TABLE-003": "HIGH", "PPT-TABLE-004": "LOW", "PPT-TABLE-005": "MEDIUM",
    "PPT-META-001": "HIGH", "PPT-META-002": "LOW", "PPT-META-003": "LOW", "PPT-META-004": "LOW", "PPT-META-005": "MEDIUM",
    "PPT-PRESENTATION-001": "MEDIUM", "PPT-PRESENTATION-002": "LOW", "PPT-PRESENTATION-003": "MEDIUM", "PPT-PRESENTATION-004": "LOW", "PPT-PRESENTATION-005": "MEDIUM", "PPT-PRESENTATION-006": "LOW", "PPT-PRESENTATION-007": "LOW",
}


def shape_rows(shapes: DataFrame) -> DataFrame:
    """What the rules on shapes, runs, slides and decks read: one row for each run, one for a shape without runs.

    ``lead`` marks a shape's first row, ``slide_row`` 1 a slide's and ``deck_row`` 1 a deck's. Facts are windows within a deck,
    so that shapes are read once and shuffled once.
    """
    words = F.array_join(F.transform("runs", lambda r: F.coalesce(r.text, F.lit(""))), "")
    t = strip(F.coalesce(F.nullif(strip(F.coalesce("text", F.lit(""))), F.lit("")), words, F.lit("")))
    wanted = {
        "slide_title": "string", "layout": "string", "type": "string", "name": "string", "order": "int", "z_order": "int", "decorative": "boolean", "alt_text": "string", "width": "double", "height": "double", "fill_color": "string", "background": "string",
        "autosize": "string", "has_text_frame": "boolean",
    }
    fields = {f.name for f in dict((f.name, f.dataType) for f in shapes.schema)["runs"].elementType}
    sizes = F.transform("runs", lambda r: r["size"]) if "size" in fields else F.lit(None).cast("array<double>")
    flat = shapes.select(
        "doc_id", "slide_no", "shape_seq", *[F.col(c) if c in shapes.columns else F.lit(None).cast(k).alias(c) for c, k in wanted.items()], t.alias("t"), F.array_max(sizes).alias("largest"), F.posexplode_outer("runs").alias("_run", "_r"),
    )
    of_run = [F.col(f"_r.{c}") if c in fields else F.lit(None).cast(k) for c, k in (("text", "string"), ("size", "double"), ("font", "string"), ("bold", "boolean"), ("color", "string"))]
    flat = flat.select("*", F.coalesce("_run", F.lit(0)).alias("run"), (F.coalesce("_run", F.lit(0)) == 0).alias("lead"), *[c.alias(f"r_{n}") for c, n in zip(of_run, ("text", "size", "font", "bold", "color"))]).drop("_run", "_r")
    seen, kind, plain = F.col("t") != "", F.coalesce(F.lower("type"), F.lit("")), ~_yes(F.col("decorative"))
    flat = bound(flat, fill=parse_hex("fill_color"), slide=parse_hex("background"), ink=parse_hex("r_color"), spoken=~_blank("r_text"), shown=F.col("lead") & seen, stacked=F.col("lead") & F.col("z_order").isNotNull())
    flat = bound(flat, back=F.coalesce("fill", "slide"), framed=_yes(F.col("has_text_frame")) & F.col("spoken"))
    slide, deck, box = Window.partitionBy("doc_id", "slide_no"), Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "slide_no", "shape_seq")
    shown, stack = Window.partitionBy("doc_id", "slide_no", "shown"), Window.partitionBy("doc_id", "slide_no", "stacked").orderBy("shape_seq")
    first = lambda when, value: F.min_by(F.when(F.col("lead") & when, value), F.when(F.col("lead") & when, F.col("shape_seq"))).over(slide)
    least = lambda when: F.min(F.when(F.col("lead") & when, F.col("shape_seq"))).over(slide)
    rows = flat.withColumns({
        "stored": F.row_number().over(shown.orderBy("shape_seq")), "read": F.row_number().over(shown.orderBy(F.coalesce("order", "shape_seq"), "shape_seq")), "below": F.lag("z_order").over(stack), "slide_row": F.row_number().over(slide.orderBy("shape_seq", "run")),
    })
    field = F.nullif(strip(F.coalesce(F.max("slide_title").over(slide), F.lit(""))), F.lit(""))
    rows = rows.withColumns({
        "any_title": F.coalesce(field, first(seen, F.col("t"))), "own_title": F.coalesce(field, first(seen & (kind == "title"), F.col("t"))), "has_text": F.bool_or(F.col("shown")).over(slide), "has_body": F.bool_or(F.col("shown") & (kind != "title")).over(slide), "any_layout": F.max("layout").over(slide),
        "title_at": least(kind == "title"), "body_at": least(kind.isin("body", "text")), "deco_at": least(~plain), "content_at": least(seen & plain), "moved": F.bool_or(F.col("shown") & (F.col("stored") != F.col("read"))).over(slide), "falls": F.bool_or(F.col("stacked") & (F.col("z_order") < F.col("below"))).over(slide),
    })
    rows = rows.withColumns({
        "same_titles": F.count_if((F.col("slide_row") == 1) & F.col("any_title").isNotNull()).over(Window.partitionBy("doc_id", F.lower(strip("any_title")))), "deck_row": F.row_number().over(deck.orderBy("slide_no", "shape_seq", "run")),
        "box_fonts": F.size(F.collect_set(F.when(F.col("framed"), F.col("r_font"))).over(box)), "deck_fonts": F.size(F.collect_set(F.when(F.col("framed"), F.col("r_font"))).over(deck)),
    })
    judged = F.when(F.col("spoken"), contrast_ratio("ink", "back"))
    return bound(rows, ratio=judged, need=needed_contrast(F.coalesce("r_size", F.lit(18.0)), F.col("r_bold")), filled=F.when(F.col("lead"), contrast_ratio("fill", "slide")))


def shape_structure() -> list[Column]:
    """PPT-HEADING-002..004 and PPT-STRUCTURE-001..005 of shape_rows()."""
    at, slide, titled, untitled = F.col("slide_no"), F.col("slide_row") == 1, F.col("any_title").isNotNull(), F.col("own_title").isNull()
    return [
        rule("PPT-HEADING-002", slide & titled & F.lower(strip("any_title")).isin(SLIDE_PLACEHOLDERS), at, "Placeholder title"), rule("PPT-HEADING-003", slide & titled & (F.col("same_titles") > 1), at, "Duplicate title"),
        rule("PPT-HEADING-004", (F.col("deck_row") == 1) & ~titled, at, "The first slide has no title"), rule("PPT-STRUCTURE-001", slide & untitled, at, "No title"), rule("PPT-STRUCTURE-002", slide & F.lower(strip("own_title")).isin(SLIDE_PLACEHOLDERS), at, "Placeholder title"),
        rule("PPT-STRUCTURE-003", slide & untitled & ~F.col("has_text"), at, "Empty slide"), rule("PPT-STRUCTURE-004", slide & _blank("any_layout"), at, "No layout", "WARNING"), rule("PPT-STRUCTURE-005", slide & (untitled | ~F.col("has_body")), at, "No title or no body"),
    ]


def shape_order() -> list[Column]:
    """PPT-READING-001..004 of shape_rows()."""
    at, slide = F.col("slide_no"), F.col("slide_row") == 1
    return [
        rule("PPT-READING-001", slide & (F.col("title_at") > F.col("body_at")), at, "A body object is before the title"), rule("PPT-READING-002", slide & F.col("moved"), at, "Stored and reading order differ"),
        rule("PPT-READING-003", slide & (F.col("deco_at") < F.col("content_at")), at, "A decorative object is before the content"), rule("PPT-READING-004", slide & F.col("falls"), at, "The stacking order falls"),
    ]


def shape_images(slide_area: float = 1280.0 * 720.0) -> list[Column]:
    """PPT-IMAGE-001..006 of shape_rows()."""
    image = F.col("lead") & F.lower("type").isin("image", "picture")
    alt, low = strip(F.coalesce("alt_text", F.lit(""))), F.lower(strip(F.coalesce("alt_text", F.lit(""))))
    deco = F.coalesce("decorative", F.lit(False))
    weak = (alt != "") & ((F.length(alt) < 5) | low.isin(GENERIC_ALT) | alt.rlike(IMAGE_FILE) | alt.rlike(DEFAULT_NAME) | alt.rlike(REDUNDANT_ALT))
    at = F.concat_ws("/", "slide_no", "shape_seq")
    logo = F.concat_ws(" ", "name", "alt_text").rlike(r"(?i)\blogo\b")
    return [
        rule("PPT-IMAGE-001", image & ~deco & (alt == ""), at, "No alt text"), rule("PPT-IMAGE-002", image & ~deco & weak, at, "Weak alt text"), rule("PPT-IMAGE-003", image & deco & (alt != ""), at, "Decorative with alt text", "WARNING"),
        rule("PPT-IMAGE-004", image & logo & ((alt == "") | weak), at, "Logo without alt text"), rule("PPT-IMAGE-005", image & ~deco & (alt == "") & (F.col("width") * F.col("height") >= 0.8 * slide_area), at, "Background image without alt text"),
        rule("PPT-IMAGE-006", image, at, "Check the images", "INFO"),
    ]


def shape_text() -> list[Column]:
    """PPT-TEXT-001..006 of shape_rows()."""
    frame, run = F.col("lead") & F.col("has_text_frame"), F.col("framed")
    at, size = F.concat_ws("/", "slide_no", "shape_seq"), F.col("largest")
    needed = F.ceil(F.length("t") / F.greatest(F.lit(1.0), F.col("width") / (size * 0.5))) * size * 1.2
    return [
        rule("PPT-TEXT-001", frame & (F.col("t") == ""), at, "Empty text shape"), rule("PPT-TEXT-002", run & (F.col("r_size") < 18), at, F.when(F.col("r_size") < 12, "Text below 12 points").otherwise("Text below 18 points")),
        rule("PPT-TEXT-003", frame & (F.regexp_count("t", F.lit("\u000b")) >= 2), at, "Manual line breaks", "WARNING"), rule("PPT-TEXT-004", (F.col("deck_row") == 1) & (F.col("deck_fonts") > 3), F.lit("deck"), "Many fonts", "WARNING"),
        rule("PPT-TEXT-004", F.col("lead") & (F.col("box_fonts") >= 3), at, "Many fonts in a box", "WARNING"), rule("PPT-TEXT-005", frame & (needed > 1.3 * F.col("height")) & (F.coalesce("autosize", F.lit("none")) == "none"), at, "Text may overflow", "WARNING"),
        rule("PPT-TEXT-006", run & (F.col("ink") == F.col("slide")), at, "Text has the background's colour"),
    ]


def shape_contrast() -> list[Column]:
    """PPT-COLOR-001..006 of shape_rows()."""
    at, low, run = F.concat_ws("/", "slide_no", "shape_seq"), F.lower(F.coalesce("type", F.lit(""))), F.col("spoken")
    return [
        rule("PPT-COLOR-001", run & (F.col("need") == 4.5) & (F.col("ratio") < 4.5), at, "Low contrast"), rule("PPT-COLOR-002", run & (F.col("need") == 3.0) & (F.col("ratio") < 3.0), at, "Low contrast of large text"),
        rule("PPT-COLOR-003", F.col("filled") < 3.0, at, "Shape and slide are alike", "WARNING"), rule("PPT-COLOR-004", F.col("lead") & low.isin("smartart", "diagram"), at, "Check the diagram's colours", "INFO"),
        rule("PPT-COLOR-005", F.col("lead") & (low == "chart"), at, "Check the chart's colours", "INFO"), rule("PPT-COLOR-006", run & (F.col("ink").isNull() | F.col("back").isNull()), at, "A colour is not resolved", "WARNING"),
    ]


def slide_structure(shapes: DataFrame) -> DataFrame:
    """PPT-HEADING-002..004 and PPT-STRUCTURE-001..005."""
    return found(shape_rows(shapes), shape_structure())


def slide_reading_order(shapes: DataFrame) -> DataFrame:
    """PPT-READING-001..004."""
    return found(shape_rows(shapes), shape_order())


def slide_images(shapes: DataFrame, slide_area: float = 1280.0 * 720.0) -> DataFrame:
    """PPT-IMAGE-001..006."""
    return found(shape_rows(shapes), shape_images(slide_area))


def slide_text(shapes: DataFrame) -> DataFrame:
    """PPT-TEXT-001..006."""
    return found(shape_rows(shapes), shape_text())


def slide_contrast(shapes: DataFrame) -> DataFrame:
    """PPT-COLOR-001..006."""
    return found(shape_rows(shapes), shape_contrast())


def slide_links(links: DataFrame) -> DataFrame:
    """PPT-LINK-001..004 of links (doc_id, slide_no, text, target, tooltip)."""
    u, t = strip(F.coalesce("target", F.lit(""))), strip(F.coalesce("text", F.lit("")))
    broken = F.lower(u).isin("#", "http://", "https://", "mailto:", "www.", "") | u.rlike(r"\s") | u.rlike(r"(?i)^https?://(?:[/?#]|$)") | (u.rlike("(?i)^mailto:") & ~F.contains(u, F.lit("@")))
    at = F.col("slide_no")
    return found(links, [
        rule("PPT-LINK-001", broken, at, u), rule("PPT-LINK-002", t.rlike(r"(?i)^(https?://|www\.|ftp://)"), at, t, "WARNING"),
        rule("PPT-LINK-003", (t == "") | F.lower(t).isin(SLIDE_VAGUE_LINKS), at, t), rule("PPT-LINK-004", _blank("tooltip"), at, "No tooltip", "WARNING"),
    ])


def slide_tables(tables: DataFrame) -> DataFrame:
    """PPT-TABLE-001..005 of tables (doc_id, slide_no, rows, columns, has_header_row, merged_cells, blank_header_cells, alt_text)."""
    at, bare = F.col("slide_no"), ~F.col("has_header_row")
    thin = (F.col("rows") <= 1) | (F.col("columns") <= 1)
    return found(tables, [
        rule("PPT-TABLE-001", bare & (F.col("rows") > 1), at, "No header row"), rule("PPT-TABLE-002", F.col("merged_cells") > 0, at, "Merged cells", "WARNING"), rule("PPT-TABLE-003", F.col("has_header_row") & (F.col("blank_header_cells") > 0), at, "Blank header cell"),
        rule("PPT-TABLE-004", bare & thin, at, "May be a layout table", "WARNING"), rule("PPT-TABLE-005", _blank("alt_text"), at, "No alt text", "WARNING"),
    ])


def slide_metadata(meta: DataFrame) -> DataFrame:
    """PPT-META-001..005 and PPT-PRESENTATION-001..007 of decks (title, subject, author, keywords, language, theme, fonts, slides, hidden)."""
    d = F.lit("deck")
    return found(meta, [
        rule("PPT-META-001", _blank("title") | F.lower(strip("title")).isin(DEFAULT_DECK_TITLES), d, "Title"), *[rule(f"PPT-META-00{i}", _blank(c), d, c, "WARNING") for i, c in ((2, "subject"), (3, "author"), (4, "keywords"))], rule("PPT-META-005", _blank("language"), d, "language"),
        rule("PPT-PRESENTATION-001", _blank("title"), d, "Title"), rule("PPT-PRESENTATION-002", _blank("language"), d, "Language", "WARNING"), rule("PPT-PRESENTATION-003", _blank("author"), d, "Author"), rule("PPT-PRESENTATION-004", _blank("theme"), d, "Theme", "WARNING"),
        rule("PPT-PRESENTATION-005", F.coalesce("fonts", F.lit(0)) == 0, d, "Fonts"), rule("PPT-PRESENTATION-006", F.coalesce("slides", F.lit(0)) == 0, d, "Slides", "WARNING"), rule("PPT-PRESENTATION-007", F.col("hidden") > 0, d, F.concat(F.col("hidden").cast("string"), F.lit(" hidden slides")), "WARNING"),
    ])


def slide_findings(shapes: DataFrame, links: DataFrame, tables: DataFrame, meta: DataFrame) -> DataFrame:
    """All families of slide decks; every element table is read once."""
    of_shapes = [*shape_structure(), *shape_order(), *shape_images(), *shape_text(), *shape_contrast()]
    return together(found(shape_rows(shapes), of_shapes), slide_links(links), slide_tables(tables), slide_metadata(meta))


# --- page-based documents -------------------------------------------------------------------------------------------

#: Fixed values
PAGE_SEVERITY = {
    "HDR-001": "CRITICAL", "HDR-002": "MEDIUM", "HDR-003": "HIGH", "HDR-004": "MEDIUM", "HDR-005": "HIGH", "LINK-001": "HIGH", "TBL-001": "CRITICAL", "TBL-002": "HIGH", "TBL-003": "HIGH", "TBL-004": "HIGH", "IMG-001": "CRITICAL", "IMG-002": "HIGH",
    "COLOR-001": "HIGH", "COLOR-002": "MEDIUM", "VIS-001": "MEDIUM", "VIS-002": "MEDIUM", "VIS-003": "MEDIUM", "VIS-004": "MEDIUM", "VIS-005": "MEDIUM", "VIS-006": "MEDIUM", "VIS-007": "MEDIUM", "VIS-008": "LOW", "VIS-009": "MEDIUM",
    "DOC_HAS_TITLE": "MEDIUM", "DOC_HAS_LANGUAGE": "HIGH", "DOC_HAS_METADATA": "LOW", "DOC_IS_TAGGED": "CRITICAL", "DOC_PDFUA_DECLARATION": "HIGH", "DOC_HAS_BOOKMARKS": "LOW",
}


def page_headings(nodes: DataFrame, parents: list[str] | None = None) -> DataFrame:
    """HDR-001..005 of structure elements (doc_id, seq, type, parent_type, text); the gap is between distinct levels."""
    doc = Window.partitionBy("doc_id")
    rows = nodes.withColumn("level", F.when(F.col("type").rlike("^H[1-6]$"), F.substring("type", 2, 1).cast("int")))
    # in order first: rows so sorted need no other sort for what is told of a whole document
    rows = rows.withColumn("n", F.row_number().over(doc.orderBy("seq")))
    rows = rows.withColumns({"h1": F.count_if(F.col("level") == 1).over(doc), "levels": F.array_sort(F.collect_set("level").over(doc))})
    gaps = F.exists(F.sequence(F.lit(0), F.greatest(F.size("levels") - 2, F.lit(0))), lambda i: F.coalesce(F.get("levels", i + 1) - F.get("levels", i) > 1, F.lit(False)))
    d, one, head = F.lit("document"), F.col("n") == 1, F.col("level").isNotNull()
    return found(rows, [
        rule("HDR-001", one & (F.col("h1") == 0), d, "No H1"), rule("HDR-002", one & (F.col("h1") != 1), d, "Not exactly one H1"), rule("HDR-003", one & gaps, d, "Levels are skipped"),
        rule("HDR-004", head & _blank("text"), F.col("seq"), "Heading without text", "WARNING"), rule("HDR-005", head & ~F.coalesce("parent_type", F.lit("")).isin(parents or ["Document", "Sect", "Part", "Div", "Art"]), F.col("seq"), "Invalid parent"),
    ])


def page_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """LINK-001: addresses in page text (doc_id, page, text) that no link element (doc_id, page, target) covers."""
    spelled = pages.select("doc_id", "page", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(https?://[^\s<>]+|www\.[^\s<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1))).alias("target"))
    plain = lambda c: F.regexp_replace(F.lower(c), r"^mailto:|[.,;)]+$", "")
    have = links.select("doc_id", "page", plain("target").alias("k")).distinct()
    return found(spelled.withColumn("k", plain("target")).join(have, ["doc_id", "page", "k"], "left_anti"), [rule("LINK-001", F.lit(True), F.col("page"), F.col("target"))])


def page_tables(tables: DataFrame) -> DataFrame:
    """TBL-001..004 of tables (doc_id, page, tagged, header_cells, rows, empty_header_cells)."""
    at = F.col("page")
    return found(tables, [
        rule("TBL-001", ~F.col("tagged"), at, "Untagged table"), rule("TBL-002", F.col("tagged") & (F.col("header_cells") == 0), at, "No header cells"),
        rule("TBL-003", F.col("tagged") & (F.col("rows") == 0), at, "No rows"), rule("TBL-004", F.col("tagged") & (F.col("empty_header_cells") > 0), at, "Empty header cells"),
    ])


def page_images(images: DataFrame) -> DataFrame:
    """IMG-001..002 of figures (doc_id, page, alt)."""
    alt = strip(F.coalesce("alt", F.lit("")))
    weak = F.lower(alt).isin(GENERIC_ALT) | alt.rlike(IMAGE_FILE) | alt.rlike(DEFAULT_NAME) | alt.rlike(r"(?i)to\s*be\s*described|placeholder|todo|tbd")
    return found(images, [rule("IMG-001", alt == "", F.col("page"), "No alt text"), rule("IMG-002", (alt != "") & weak, F.col("page"), "Placeholder alt text")])


def page_colors(texts: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """COLOR-001 and 002: worst contrast of each text colour (doc_id, page, color, large) with its page's other light backgrounds (doc_id, page, color), white if there is none."""
    distinct = texts.select("doc_id", "page", parse_hex("color").alias("fore"), "large").distinct()
    light = backgrounds.select("doc_id", "page", parse_hex("color").alias("back")).where(contrast_ratio("back", F.lit("000000")) >= 10).distinct()
    least = F.min(F.when(F.col("back") != F.col("fore"), contrast_ratio("fore", "back")))
    worst = distinct.join(light, ["doc_id", "page"], "left").groupBy("doc_id", "page", "fore", "large").agg(F.coalesce(least, F.first(contrast_ratio("fore", F.lit("FFFFFF")))).alias("ratio"))
    return found(worst, [rule("COLOR-001", ~F.col("large") & (F.col("ratio") < 4.5), F.col("page"), F.col("fore")), rule("COLOR-002", F.col("large") & (F.col("ratio") < 3.0), F.col("page"), F.col("fore"))])


def page_visual(word_rows: DataFrame, page_facts: DataFrame) -> DataFrame:
    """VIS-001..009 of words (doc_id, page, size, font, color, left, right) and pages (doc_id, page, width, n_images, rotation, watermarks).

    One finding a document and rule; the location is the number of words, annotations or pages that offend.
    """
    words = word_rows.select("doc_id", "page", "size", "font", "left", "right", parse_hex("color").alias("ink"), F.lit(True).alias("word"))
    inked = page_facts.select("doc_id", "page", "width", "n_images", "rotation", "watermarks").join(words, ["doc_id", "page"], "left")
    channel = [F.conv(F.substring("ink", i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5)]
    hued = (channel[0] != channel[1]) | (channel[1] != channel[2])
    bright = 0.2126 * channel[0] + 0.7152 * channel[1] + 0.0722 * channel[2] > 0.85
    wide = F.count_if((F.col("right") - F.col("left")) / F.col("width") > 0.9)
    pages = inked.groupBy("doc_id", "page").agg(
        F.count("word").alias("n"), wide.alias("wide"), F.count_if(F.col("size").between(0.001, 7.999)).alias("tiny"), F.count_if(hued).alias("hued"), F.count_if(bright).alias("light"), F.countDistinct(F.when(F.col("font") != "", F.col("font"))).alias("fonts"),
        *[F.first(c).alias(c) for c in ("n_images", "rotation", "watermarks")],
    )
    has_image = F.col("n_images") > 0
    rules = {
        "VIS-001": F.sum("tiny"), "VIS-002": F.sum("watermarks"), "VIS-003": F.count_if(has_image & (F.col("n") < 20)), "VIS-004": F.count_if(has_image & (F.col("n") == 0)), "VIS-005": F.count_if((F.col("n") > 500) | (F.col("wide") > 40)),
        "VIS-006": F.count_if(F.col("fonts") > 6), "VIS-007": F.count_if(F.col("rotation") % 360 != 0), "VIS-008": F.sum("hued"), "VIS-009": F.sum("light"),
    }
    summed = pages.groupBy("doc_id").agg(*[n.alias(r) for r, n in rules.items()])
    return found(summed, [rule(r, F.col(r) > 0, F.col(r), "Check the pages", "INFO" if r == "VIS-008" else "WARNING") for r in rules])


def page_document(meta: DataFrame) -> DataFrame:
    """DOC_* of documents (title, language, has_metadata, tagged, pdfua, bookmarks)."""
    d = F.lit("document")
    return found(meta, [
        rule("DOC_HAS_TITLE", _blank("title"), d, "Title"), rule("DOC_HAS_LANGUAGE", _blank("language"), d, "Language"), rule("DOC_HAS_METADATA", ~F.col("has_metadata"), d, "Metadata", "WARNING"),
        rule("DOC_IS_TAGGED", ~F.col("tagged"), d, "Not tagged"), rule("DOC_PDFUA_DECLARATION", ~F.col("pdfua"), d, "No declaration"), rule("DOC_HAS_BOOKMARKS", F.coalesce("bookmarks", F.lit(0)) == 0, d, "No bookmarks", "WARNING"),
    ])


def page_findings(nodes: DataFrame, pages: DataFrame, links: DataFrame, tables: DataFrame, images: DataFrame, meta: DataFrame, texts: DataFrame, backgrounds: DataFrame, word_rows: DataFrame, page_facts: DataFrame) -> DataFrame:
    """All families of page-based documents; every element table is read once."""
    return together(page_headings(nodes), page_links(pages, links), page_tables(tables), page_images(images), page_document(meta), page_colors(texts, backgrounds), page_visual(word_rows, page_facts))


def tree_checks(flat: DataFrame) -> DataFrame:
    """doc_id, elements, is_empty, is_flat of flattened trees (graph.flatten_tree)."""
    return flat.groupBy("doc_id").agg(F.count("*").alias("elements"), F.max("depth").alias("d")).select("doc_id", "elements", (F.col("elements") <= 1).alias("is_empty"), (F.col("d") <= 1).alias("is_flat"))


def alt_quality(images: DataFrame, caption_words: int = 5, tiny: float = 24.0) -> DataFrame:
    """images with alt_class (empty, placeholder, corrupt, dump, ok), caption_sufficient and decorative_by_size."""
    alt = strip(F.regexp_replace(F.coalesce("alt", F.lit("")), r"\p{Cc}", ""))
    letters = F.length(F.regexp_replace(alt, r"[^\p{L}]", ""))
    kind = F.when(alt == "", "empty").when(F.lower(alt).isin(GENERIC_ALT) | alt.rlike(DEFAULT_NAME) | alt.rlike(IMAGE_FILE), "placeholder").when((letters < F.length(alt) * 0.5) | F.contains(alt, F.lit("�")), "corrupt").when(word_count(alt) > 80, "dump").otherwise("ok")
    return images.withColumns({"alt_class": kind, "caption_sufficient": word_count(F.coalesce("caption", F.lit(""))) >= caption_words, "decorative_by_size": (F.col("width") < tiny) | (F.col("height") < tiny)})


# --- runs of all rules ----------------------------------------------------------------------------------------------


def run_word_checks(paragraphs: DataFrame, images: DataFrame, tables: DataFrame, links: DataFrame, meta: DataFrame, sections: DataFrame, evidence: DataFrame, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(verdicts of all rules per document, at most ``cap`` findings per document and rule)."""
    findings = word_findings(paragraphs, images, tables, links, meta, sections)
    rules = [r for r in WORD_SEVERITY if not r.startswith("SRV")]
    tested = screen_reader(evidence, meta).select("doc_id", "rule_id", F.lit("HIGH").alias("severity"), "status", F.lit(0).cast("long").alias("affected_count"))
    return verdicts(meta, findings, rules).unionByName(tested), cap_findings(findings, cap)


def run_rules(documents: DataFrame, findings: DataFrame, severity: dict[str, str], cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """run_word_checks() for slide decks (SLIDE_SEVERITY) and page-based documents (PAGE_SEVERITY)."""
    return verdicts(documents, findings, list(severity), severity), cap_findings(findings, cap)


def report(results: DataFrame, checks: DataFrame, org, project) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of verdicts: (executed checks, state of each analyser, one row per document).

    checks are a scope's rules (org_id, project_id, agent, check_code, is_active, category, auto_fixable, internal_check); a
    project's row wins. Verdicts of rules that are not enabled there go, and enabled rules without a verdict are NOT_EVALUATED.
    A document has its counts by severity and overall status, the share of worth retained and its band, the weighted score
    with its coverage and risk, and the dashboard's figures.
    """
    tables = Tables(results.sparkSession, "report")
    results, _ = tables.write(results)  # read twice below, and made of every element table
    scope = resolve_checks(checks, org, project, "project_wins")
    catalog = scope.select(F.col("check_code").alias("rule_id"), F.col("agent").alias("analyzer"), F.lit(True).alias("enabled"), "category", "auto_fixable", "internal_check").dropDuplicates(["rule_id"])
    executed, states = executed_checks_coverage(results, catalog, also=["severity", "affected_count"])
    rows = executed.join(F.broadcast(catalog.select("rule_id", "category", "auto_fixable", "internal_check")), "rule_id")  # at most MAX_RULES rules
    rows = rows.select("doc_id", "analyzer", "rule_id", "category", F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), "status", F.coalesce("affected_count", F.lit(0)).cast("long").alias("affected_count"), "auto_fixable", "internal_check")
    rows, _ = tables.write(rows)
    one = validation_summary(rows).join(retained_score(rows)[0].withColumnRenamed("overall", "retained"), "doc_id").join(weighted_score(rows), "doc_id").join(dashboard_kpis(rows), "doc_id")
    return rows, states, one
