"""Rules on tables of document elements: runs, paragraphs, shapes, images, tables, links, words and fragments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compacted, font_key, strip, word_count, words


def text_lint(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``lint``: the names of the tests that a text fails, comma-joined.

    char_spaced: half of at least four lettered tokens are single characters; too_short: at most two letters; bare_label;
    placeholder; mojibake: its characters are the bytes of other UTF-8 text; body: two sentence ends or over 20 words;
    list_item: begins with a number.
    """
    t = F.col(column)
    lettered = F.filter(words(t), lambda w: w.rlike(r"\p{L}"))
    single = F.size(F.filter(lettered, lambda w: F.length(w) == 1))
    tests = {
        "char_spaced": (F.size(lettered) >= 4) & (single / F.size(lettered) >= 0.5),
        "too_short": F.length(F.regexp_replace(t, "[^A-Za-z]", "")) <= 2,
        "bare_label": strip(t).rlike(r"(?i)^\W*(fig(ure)?|image|graphic|picture|img|pic|table|photo)?\.?\s*\d*\W*$"),
        "placeholder": t.rlike(r"(?i)to\s*be\s*described|placeholder|todo|xxx|tbd"),
        "mojibake": t.rlike("[\u00c2-\u00df][\u0080-\u00bf]|[\u00e0-\u00ef][\u0080-\u00bf]{2}|[ÃÂ][€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"),
        "body": (((F.length(t) - F.length(F.replace(t, F.lit(". "), F.lit("")))) / 2) >= 2) | (word_count(t) > 20),
        "list_item": t.rlike(r"^\s*\(?\d+[.)]\s+\S"),
    }
    return rows.withColumn("lint", F.array_join(compacted(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]), ","))


def column_layout(rows: DataFrame) -> DataFrame:
    """page, columns, multi_column of words (page, x).

    Ten buckets between a page's extremes; buckets with a tenth of the words that are neighbours make a cluster; clusters
    with at least three words and a fifth of all are columns.
    """
    ranges = rows.groupBy("page").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10).otherwise(0)
    buckets = rows.join(ranges, "page").groupBy("page", F.least(F.lit(9), F.floor(share)).cast("int").alias("bucket")).agg(F.first("n").alias("n"), F.count("*").alias("c"))
    order = Window.partitionBy("page").orderBy("bucket")
    full = buckets.where(F.col("c") >= F.col("n") * 0.1).withColumn("run", F.col("bucket") - F.row_number().over(order))
    clusters = full.groupBy("page", "run").agg(F.first("n").alias("n"), F.sum("c").alias("c"))
    counted = clusters.groupBy("page").agg(F.count_if(F.col("c") >= F.greatest(F.lit(3.0), F.col("n") * 0.2)).alias("columns"))
    columns = F.coalesce("columns", F.lit(0))
    return ranges.select("page").join(counted, "page", "left").select("page", columns.alias("columns"), (columns >= 2).alias("multi_column"))


def font_consistency(runs: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, fonts, consistent: whether there are at most ``most`` families, subset prefixes aside."""
    return runs.groupBy(*by).agg(F.countDistinct(font_key("font")).alias("fonts")).withColumn("consistent", F.col("fonts") <= most)


def running_headers(fragments: DataFrame, band: float = 0.14, most_chars: int = 120) -> DataFrame:
    """fragments with ``is_furniture``: the same text on at least two pages, always in the top or bottom band, not a Title."""
    key = F.lower(strip(F.regexp_replace("text", r"\s+", " ")))
    inside = (F.col("y") <= F.col("page_height") * band) | (F.col("y") >= F.col("page_height") * (1 - band))
    keyed = fragments.withColumn("_key", key)
    groups = keyed.where((F.length("_key") > 0) & (F.length("_key") <= most_chars) & (F.col("tag") != "Title")).groupBy("doc_id", "_key")
    found = groups.agg(F.countDistinct("page").alias("p"), F.every(inside).alias("e")).where("p >= 2 and e").select("doc_id", "_key", F.lit(True).alias("is_furniture"))
    marked = F.when(F.col("tag") != "Title", F.coalesce("is_furniture", F.lit(False))).otherwise(False)
    return keyed.join(found, ["doc_id", "_key"], "left").withColumn("is_furniture", marked).drop("_key")


def style_levels(fragments: DataFrame, long_text: int = 60) -> DataFrame:
    """doc_id, font, size, level of styles larger than the body's: ranked by size, then first appearance, at most 6.

    The body style is the most common one of long texts.
    """
    styles = fragments.groupBy("doc_id", "font", "size").agg(F.min("seq").alias("first"), F.count_if(F.length("text") >= long_text).alias("long"))
    body = styles.groupBy("doc_id").agg(F.max_by(F.struct("size", "font"), F.struct("long", -F.col("first"))).alias("body"))
    larger = styles.join(body, "doc_id").where(F.col("size") > F.col("body.size"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("size"), "first")
    return larger.select("doc_id", "font", "size", F.least(F.lit(6), F.row_number().over(order)).alias("level"))


#: Fixed values
HEADING_TAG = "^H[1-6]$"
RULE_ONLY = r"^[\s_.\-–—·•]+$"
ENUMERATOR = r"^\(?\s*(\d{1,2}|[ivxIVX]{1,4}|[a-zA-Z])\s*[.)]?\s*$"


def heading_eligibility(fragments: DataFrame, most_chars: int = 110, gap: float = 1.2, baseline: float = 4.0) -> DataFrame:
    """Headings (tag H1..H6) with ``demoted`` (a reason or null), ``merged_into``, ``label`` and ``level`` anew.

    fragments: doc_id, page, seq, tag, text, size, bold, x (left edge) and y (upper edge, upwards). A document's body size is the
    most common whole size of texts of over 40 characters that are no headings (ties to the first met; 10 without any). In this
    order a heading is demoted that is rule_only (empty or lines), an enumerator, too_long, run_in (a text of eight characters or
    more that is no heading begins right of it on its baseline), sub_body (below 0.92 of the body size) or not_prominent (not
    bold and at most 1.02 of it). An enumerator left of a heading that stays, on one baseline, is merged into the nearest one and
    is its ``label``. Levels count clusters of sizes, from the largest, that lie within ``gap`` of their first; in reading order
    none is more than one below the one before it.
    """
    t = strip(F.coalesce("text", F.lit("")))
    line = Window.partitionBy("doc_id", "page", "bucket")
    rows = fragments.select("doc_id", "page", "seq", t.alias("text"), F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), "x", "y", F.bround(F.col("y") / baseline).alias("bucket"), F.col("tag").rlike(HEADING_TAG).alias("heading"))
    sizes = rows.where(~F.col("heading") & (F.length("text") > 40)).groupBy("doc_id", F.bround("size").alias("whole")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    body = sizes.groupBy("doc_id").agg(F.max_by("whole", F.struct("n", -F.col("first"))).alias("body"))
    plain = F.max(F.when(~F.col("heading") & (F.length("text") >= 8), F.col("x"))).over(line)
    rows = rows.withColumn("rightmost", plain).where("heading").join(body, "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    reason = (
        F.when((F.col("text") == "") | F.col("text").rlike(RULE_ONLY), "rule_only").when(F.col("text").rlike(ENUMERATOR), "enumerator").when(F.length("text") > most_chars, "too_long")
        .when(F.col("rightmost") > F.col("x") + 3, "run_in").when(F.col("size") < F.col("body") * 0.92, "sub_body").when((F.col("size") <= F.col("body") * 1.02) & ~F.col("bold"), "not_prominent")
    )
    rows = rows.withColumn("reason", reason)
    # the nearest heading right of a place: the last one that stays, from the right, among those with a larger x
    rows = rows.withColumn("from_right", F.dense_rank().over(line.orderBy(F.desc("x"))))
    right = line.orderBy("from_right").rangeBetween(Window.unboundedPreceding, -1)
    mate = F.last(F.when(F.col("reason").isNull(), F.col("seq")), True).over(right)
    rows = rows.withColumn("merged_into", F.when(F.col("reason") == "enumerator", mate))
    labels = rows.where("merged_into is not null").groupBy("doc_id", F.col("merged_into").alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda e: e.text), " ").alias("label"))
    stays = rows.where("reason is null").withColumn("rounded", F.round("size", 1))
    zero = F.struct(F.lit(None).cast("double").alias("head"), F.lit(0).alias("level"), F.create_map().cast("map<double,int>").alias("of"))

    def step(state: Column, size: Column) -> Column:
        fresh = state.head.isNull() | (state.head - size > gap)
        level = F.when(fresh, F.least(F.lit(6), state.level + 1)).otherwise(state.level)
        return F.struct(F.when(fresh, size).otherwise(state.head).alias("head"), level.alias("level"), F.map_concat(state.of, F.create_map(size, level)).alias("of"))

    clusters = stays.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set("rounded"))).alias("sizes")).select("doc_id", F.aggregate("sizes", zero, step, lambda s: s.of).alias("of"))
    order = Window.partitionBy("doc_id").orderBy("page", F.desc("y"), "x", "seq")
    levelled = stays.join(clusters, "doc_id").withColumns({"n": F.row_number().over(order), "level": F.col("of")[F.col("rounded")]})
    # a level is at most its predecessor's plus one: the least of all earlier levels and the steps since
    levelled = levelled.select("doc_id", "seq", (F.min(F.col("level") - F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("n")).alias("level"))
    out = rows.join(levelled, ["doc_id", "seq"], "left").join(labels, ["doc_id", "seq"], "left")
    return out.select("doc_id", "page", "seq", "text", "size", F.when(F.col("merged_into").isNull(), F.col("reason")).alias("demoted"), "merged_into", "label", "level")


def reconstruct_lines(word_rows: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, line, text: words from top to bottom; a line ends where a top differs from its first word's by more than ``tolerance``."""
    def lines(key, table):
        table = table.sort_by([("top", "ascending"), ("left", "ascending"), ("seq", "ascending")])
        out: list[list[tuple[float, str]]] = []
        anchor = None
        for top, left, text in zip(*(table.column(c).to_pylist() for c in ("top", "left", "text"))):
            if anchor is None or top - anchor > tolerance:
                anchor = top
                out.append([])
            out[-1].append((left, text))
        texts = [" ".join(t for _, t in sorted(line)) for line in out]
        return pa.table({"doc_id": pa.array([key[0].as_py()] * len(out), pa.string()), "page": pa.array([key[1].as_py()] * len(out), pa.int32()), "line": pa.array(range(len(out)), pa.int32()), "text": pa.array(texts, pa.string())})

    return word_rows.groupBy("doc_id", "page").applyInArrow(lines, "doc_id string, page int, line int, text string")


def page_layout(word_rows: DataFrame, page_facts: DataFrame) -> DataFrame:
    """doc_id, page, n_words, dense (over 500 words, or over 40 wide ones), scanned, rotated; page_facts: n_images, rotation."""
    wide = F.count_if(F.col("right") - F.col("left") > 200)
    counted = word_rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"), wide.alias("wide"))
    n = F.coalesce("n", F.lit(0))
    return page_facts.join(counted, ["doc_id", "page"], "left").select("doc_id", "page", n.alias("n_words"), ((n > 500) | (F.coalesce("wide", F.lit(0)) > 40)).alias("dense"), ((n < 20) & (F.col("n_images") > 0)).alias("scanned"), (F.col("rotation") % 360 != 0).alias("rotated"))
