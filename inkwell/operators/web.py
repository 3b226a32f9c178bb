"""Web pages: elements, titles, links, rules and scans."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, words
from ..sources.shared import Tables, beside
from . import lifecycle, score

TAGS = ("img", "a", "input", "select", "textarea", "label")
SKIPPED_INPUTS = ("hidden", "submit", "button", "reset", "image")


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, dict[str, str], bool, str]] = []
        self.labels, self.open = 0, -1

    def handle_starttag(self, tag, attrs):
        if tag == "label":
            self.labels += 1
        if tag in TAGS:
            own = {k: v or "" for k, v in attrs}
            if tag != "input" or own.get("type", "text").lower() not in SKIPPED_INPUTS:
                self.rows.append((tag, own, self.labels > 0 and tag != "label", ""))
                self.open = len(self.rows) - 1 if tag == "a" else self.open

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        if self.open >= 0:
            tag, own, inside, text = self.rows[self.open]
            self.rows[self.open] = (tag, own, inside, text + data)

    def handle_endtag(self, tag):
        if tag == "label":
            self.labels = max(self.labels - 1, 0)
        if tag == "a":
            self.open = -1


def html_elements(pages: DataFrame) -> DataFrame:
    """page_id, seq, tag, attrs, in_label, text (of links)."""
    def parse(batches):
        kinds = [pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = _Elements()
                p.feed(html or "")
                for i, (tag, own, inside, text) in enumerate(p.rows):
                    for column, v in zip(out, (key, i, tag, list(own.items()), inside, " ".join(text.split()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *[pa.array(c, k) for c, k in zip(out[1:], kinds)]], names=["page_id", "seq", "tag", "attrs", "in_label", "text"])

    return pages.select("page_id", "html").mapInArrow(parse, f"page_id {dict(pages.dtypes)['page_id']}, seq int, tag string, attrs map<string,string>, in_label boolean, text string")


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, title: white space collapsed, at most 500 characters, null if blank."""
    title = F.array_join(words(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), " ")
    return pages.select("page_id", F.nullif(F.left(title, F.lit(500)), F.lit("")).alias("title"))


def missing_alt(elements: DataFrame) -> DataFrame:
    """Findings for images without an alt attribute; an empty one is fine."""
    src = F.coalesce(F.col("attrs")["src"], F.lit(""))
    return elements.where((F.col("tag") == "img") & ~F.map_contains_key("attrs", "alt")).select("page_id", F.lit("IMG_ALT").alias("rule_code"), F.concat(F.lit('img[src="'), src, F.lit('"]')).alias("element_selector"), F.lit("Image has no alt attribute").alias("message"))


def form_label_gaps(elements: DataFrame) -> DataFrame:
    """Findings for controls without a wrapping label, aria-label, aria-labelledby or a label for their id."""
    a = F.col("attrs")
    filled = lambda n: F.coalesce(strip(a[n]), F.lit("")) != ""
    controls = elements.where(F.col("tag").isin("input", "select", "textarea") & ~F.col("in_label") & ~filled("aria-label") & ~filled("aria-labelledby"))
    named = elements.where(F.col("tag") == "label").select("page_id", a["for"].alias("id")).where("id != ''").distinct()
    gaps = controls.withColumn("id", a["id"]).join(named, ["page_id", "id"], "left_anti")
    selector = F.coalesce(F.concat(F.lit("#"), F.nullif(a["id"], F.lit(""))), F.concat("tag", F.lit('[name="'), F.nullif(a["name"], F.lit("")), F.lit('"]')), F.concat("tag", F.lit(":"), "seq"))
    return gaps.select("page_id", F.lit("FORM_LABEL").alias("rule_code"), selector.alias("element_selector"), F.lit("Control has no label").alias("message"))


#: Fixed values
GENERIC_LINK_TEXT = ["click here", "here", "read more", "more", "link", "learn more", "this link", "details"]


def generic_links(elements: DataFrame) -> DataFrame:
    """Findings for links whose text is empty, generic or an address."""
    low = F.lower(strip("text"))
    bad = F.when(low == "", "LINK_EMPTY").when(low.isin(GENERIC_LINK_TEXT), "LINK_GENERIC").when(low.rlike("^(https?://|www[.])"), "LINK_RAW_URL")
    return elements.where("tag = 'a'").select("page_id", bad.alias("rule_code"), F.concat(F.lit('a[href="'), F.coalesce(F.col("attrs")["href"], F.lit("")), F.lit('"]')).alias("element_selector"), F.col("text").alias("message")).where("rule_code is not null")


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"IMG_ALT": missing_alt, "FORM_LABEL": form_label_gaps, "LINK_TEXT": generic_links}


def register_rule(code: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """``rule`` turns elements into findings, whose rule codes are enabled one by one; ``code`` names the rule itself."""
    RULES[code] = rule


def evaluate_page_rules(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of the registered rules that are enabled in ``rules``, with their facts."""
    parts = [rule(elements) for rule in RULES.values()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(beside(rules.where("enabled")), "rule_code")


def _absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    def join(b, h):
        try:
            return urldefrag(urljoin(b or "", (h or "").strip()))[0]
        except ValueError:
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))


def discover_links(pages: DataFrame, elements: DataFrame, most: int = 20) -> DataFrame:
    """page_id, position, url: the page itself first, then same-site http links in order of first sight, without fragments."""
    most = max(1, min(most, 100))
    links = elements.where(F.col("tag") == "a").select("page_id", "seq", F.col("attrs")["href"].alias("href")).join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    links = links.select("page_id", "seq", "base", F.pandas_udf(_absolute, "string")("base", "href").alias("url")).where(F.col("url").rlike("^https?://") & same_site(host("url"), host("base")))
    seeds = pages.select("page_id", F.lit(-1).alias("seq"), F.regexp_replace("url", "#.*$", "").alias("url"))
    first = seeds.unionByName(links.select("page_id", "seq", "url")).groupBy("page_id", "url").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("page_id").orderBy("seq", "url")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("page_id", "position", "url")


def discover_sitemap(sites: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """site_id, position, url from a flat urlset (sites: site_id, url, xml), or from discovered links where it gives none."""
    locs = sites.where("xml is not null").select("site_id", "url", F.posexplode(F.xpath("xml", F.lit("urlset/url/loc/text()"))).alias("seq", "loc"))
    mine = locs.select("site_id", "seq", "url", strip("loc").alias("loc")).where(F.col("loc").rlike("^https?://") & same_site(host("loc"), host("url")))
    first = mine.groupBy("site_id", F.regexp_replace("loc", "#.*$", "").alias("u")).agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("site_id").orderBy("seq", "u")
    found = first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("site_id", "position", F.col("u").alias("url"))
    return found.unionByName(links.join(found.select("site_id").distinct(), "site_id", "left_anti").select("site_id", "position", "url"))


def backfill_pages(scans: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (site_id, url) of scans with their page: page_id of an existing one, or a new number; was_created.

    New numbers follow the largest one in order of site and of the url's hash. New rows are dealt out by ranges of that order; a
    row's number is its place in its part plus the sizes of the parts before it, so that only sizes are added up in one place.
    """
    tables = Tables(scans.sparkSession, "pages")
    wanted = scans.select("site_id", "url", F.sha2("url", 256).alias("url_hash")).distinct()
    have = pages.select("site_id", "url_hash", "page_id")
    joined = wanted.join(have, ["site_id", "url_hash"], "left")
    fresh = joined.where("page_id is null").select("site_id", "url", "url_hash").repartitionByRange("site_id", "url_hash").sortWithinPartitions("site_id", "url_hash")
    # the upper bits are the part's number, the lower 33 the place within it; written, so that they stay what they are
    placed, _ = tables.write(fresh.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, total = [], pages.agg(F.coalesce(F.max("page_id"), F.lit(0)).alias("top")).first()["top"]
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each part
        before.append((row["part"], total))
        total += row["count"]
    offsets = scans.sparkSession.createDataFrame(before, "part long, before long")
    number = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("site_id", "url", "url_hash", number.alias("page_id"), F.lit(True).alias("was_created"))
    return joined.where("page_id is not null").select("site_id", "url", "url_hash", "page_id", F.lit(False).alias("was_created")).unionByName(numbered)


def scan_pages(pages: DataFrame, scans: DataFrame, rules: DataFrame, past_scans: DataFrame, past_findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues after these scans, score of each page): pages are evaluated and joined to the history."""
    found = evaluate_page_rules(html_elements(pages), rules)
    now = scans.select("page_id", "scan_id", "status")
    findings = found.join(now, "page_id").select("page_id", "scan_id", "rule_code", "element_selector", "message")
    issues = lifecycle.issue_lifecycle(past_scans.unionByName(now), past_findings.unionByName(findings))
    clean = pages.select("page_id").join(found.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit(100).cast("decimal(5,2)").alias("score"), F.lit("PASS").alias("status"))
    return issues, score.page_scan_score(found).unionByName(clean)
