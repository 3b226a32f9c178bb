"""Element rules on small fixtures."""

from collections import Counter

import pytest
from inkwell.functions.text import banner_key, contrast_ratio
from inkwell.operators import elements, rules
from inkwell.operators.score import executed_checks_coverage
from inkwell.sources.shared import dealt
from pyspark.sql import functions as F

RUN = "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,caps:boolean,hidden:boolean,size_pt:double,color:string,background:string,background_known:boolean,vert_align:string,lang:string>>"
PARAGRAPH = f"doc_id string, seq int, container string, text string, style_name string, heading_level int, is_list boolean, justification string, has_drawing boolean, has_page_break boolean, has_section_break boolean, runs {RUN}"
SHAPE = "doc_id string, slide_no int, slide_title string, layout string, background string, shape_seq int, type string, name string, text string, order int, z_order int, decorative boolean, alt_text string, width double, height double, fill_color string, autosize string, has_text_frame boolean, runs array<struct<text:string,size:double,font:string,bold:boolean,color:string>>"


def run(text, size=11.0, color=None, bold=False, background=None, lang=None):
    return (text, bold, False, False, False, False, size, color, background, True, None, lang)


def para(doc, seq, text, level=None, runs=None, is_list=False, container="body", justification=None):
    return (doc, seq, container, text, None, level, is_list, justification, False, False, False, runs or [run(text)])


def shape(doc, slide, seq, kind, text, **more):
    d = {"slide_title": None, "layout": "Title", "background": "FFFFFF", "name": None, "order": None, "z_order": None, "decorative": False, "alt_text": None, "width": 100.0, "height": 50.0, "fill_color": None, "autosize": "none", "runs": [(text, 20.0, "Arial", False, "000000")]} | more
    return (doc, slide, d["slide_title"], d["layout"], d["background"], seq, kind, d["name"], text, d["order"], d["z_order"], d["decorative"], d["alt_text"], d["width"], d["height"], d["fill_color"], d["autosize"], True, d["runs"])


def found(df):
    return {(r.doc_id, r.rule_id) for r in df.collect()}


def word_inputs(spark):
    clean = [para("good", 1, "Heading", 1), para("good", 2, "Some plain text in a paragraph."), para("good", 3, "Sub", 2)]
    bad = [para("bad", 1, "One", 1), para("bad", 2, "Two", 2), para("bad", 3, "Four", 4), para("bad", 4, "- first item"), para("bad", 5, "- second item"), para("bad", 6, ""), para("bad", 7, ""),
           para("bad", 8, "a    b"), para("bad", 9, "Grey text", runs=[run("Grey text", color="777777")]), para("bad", 10, "Bold line", runs=[run("Bold line", bold=True)]), para("bad", 11, "x\ty\tz"), para("bad", 12, "u\tv\tw")]
    bad += [para("bad", 20 + i, "tiny", runs=[run("tiny", 6.0)]) for i in range(150)]
    p = spark.createDataFrame(clean + bad, PARAGRAPH)
    images = spark.createDataFrame([("bad", 1, "pic", "", "Picture 1", "a.png", False, True), ("bad", 2, "pic", "photo.jpg", "x", "y", False, False)], "doc_id string, seq int, kind string, alt string, name string, target string, decorative boolean, floating boolean")
    tables = spark.createDataFrame([("bad", 1, 3, 3, 0, False, 2, 1, 0, None, None)], "doc_id string, seq int, rows int, columns int, depth int, has_header_row boolean, merged_cells int, blank_rows int, blank_columns int, caption string, description string")
    links = spark.createDataFrame([("bad", "click here", "http://x"), ("good", "Annual report", "http://y")], "doc_id string, text string, target string")
    meta = spark.createDataFrame([("good", "aa", "Annual report", "Ann", "en-GB", 100, False, 0, 0), ("bad", "bb", "Untitled", None, "english language", 5000, False, 1, 0)], "doc_id string, sha256 string, title string, author string, default_language string, word_count int, has_toc boolean, tracked_changes int, comments int")
    sections = spark.createDataFrame([("bad", 1, 2)], "doc_id string, seq int, columns int")
    evidence = spark.createDataFrame(
        [("good", "NVDA", "1", "t", "2024-01-01", "pass", "aa", None), ("good", "JAWS", "1", None, "2024-01-01", "pass", "aa", None), ("bad", "NVDA", "1", "t", "2024-01-01", "pass", "other", None)],
        "doc_id string, tool string, tool_version string, tester string, tested_at string, result string, document_sha256 string, notes string",
    )
    return p, images, tables, links, meta, sections, evidence


def test_word_rules(spark):
    verdicts, findings = rules.run_word_checks(*word_inputs(spark))
    got = {(r.doc_id, r.rule_id): (r.status, r.affected_count) for r in verdicts.collect()}
    assert all(s in ("PASS", "NOT_TESTED") for (d, _), (s, _) in got.items() if d == "good")
    failed = {rule for (d, rule), (s, _) in got.items() if d == "bad" and s == "FAIL"}
    assert {"STR-002", "STR-006", "STR-007", "STR-008", "STR-009", "STR-010", "IMG-001", "IMG-002", "MET-001", "MET-002", "MET-004", "MET-006", "ROD-002", "ROD-005", "TBL-001", "TBL-002", "TBL-004", "TBL-005", "VIS-001", "VIS-002"} <= failed
    assert got["bad", "STR-005"][0] == "MANUAL" and got["bad", "VIS-002"] == ("FAIL", 150)
    kept = findings.where("rule_id = 'VIS-002'").collect()
    assert len(kept) == 100 and kept[0].affected_count == 150
    assert [r.message for r in findings.where("rule_id = 'STR-002'").collect()] == ["Use Heading 3 instead of Heading 4"]
    assert got["good", "SRV-001"][0] == "PASS" and got["good", "SRV-002"][0] == "NOT_TESTED" and got["bad", "SRV-001"][0] == "NOT_TESTED"


def scans(df):
    """How often each table's folder is read in the plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for i in range(leaves.size()) if (x := leaves.apply(i)).getClass().getSimpleName() == "LogicalRelation"]
    paths = [x.relation().location().rootPaths().mkString() for x in files]
    return Counter(p.rsplit("element_", 1)[1] for p in paths)


def on_disk(spark, folder, tables):
    out = []
    for name, df in tables:
        df.write.parquet(f"file://{folder}/element_{name}")
        out.append(spark.read.parquet(f"file://{folder}/element_{name}"))
    return out


def test_every_element_table_is_read_once(spark, tmp_path):
    names = ["paragraphs", "images", "tables", "links", "meta", "sections", "evidence"]
    inputs = on_disk(spark, tmp_path, zip(names, word_inputs(spark)))
    plan = rules.word_findings(*inputs[:6])
    read = scans(plan)
    assert {n: read[n] for n in names[:6]} == {"paragraphs": 1, "images": 1, "tables": 1, "links": 1, "meta": 2, "sections": 1}
    assert scans(rules.run_word_checks(*inputs)[0])["paragraphs"] == 1
    shapes = on_disk(spark, tmp_path, [("shapes", spark.createDataFrame([shape("a", 1, 0, "title", "Overview"), shape("a", 1, 1, "body", "Text")], SHAPE))])[0]
    links = spark.createDataFrame([("a", 1, "here", "http://", None)], "doc_id string, slide_no int, text string, target string, tooltip string")
    tables = spark.createDataFrame([("a", 1, 2, 2, False, 0, 0, None)], "doc_id string, slide_no int, rows int, columns int, has_header_row boolean, merged_cells int, blank_header_cells int, alt_text string")
    meta = spark.createDataFrame([("a", "T", None, "x", None, "en", "t", 1, 1, 0)], "doc_id string, title string, subject string, author string, keywords string, language string, theme string, fonts int, slides int, hidden int")
    found = rules.slide_findings(shapes, links, tables, meta)
    assert scans(found)["shapes"] == 1
    results = {r.rule_id: (r.severity, r.status) for r in rules.run_rules(meta, found, rules.SLIDE_SEVERITY)[0].collect()}
    assert set(results) == set(rules.SLIDE_SEVERITY) and results["PPT-LINK-001"] == ("HIGH", "FAIL") and results["PPT-META-002"] == ("LOW", "WARNING") and results["PPT-STRUCTURE-001"] == ("HIGH", "PASS")


def test_report_of_a_run(spark):
    """A scope's rules: what is off goes, what has no verdict is not evaluated, and the scores follow."""
    results, _ = rules.run_word_checks(*word_inputs(spark))
    checks = [(1, None, "structure", r, r != "STR-010", "Content", False, False) for r in rules.WORD_SEVERITY if r.startswith("STR")] + [(1, 7, "images", "IMG-001", True, "Content", True, False), (2, None, "images", "IMG-002", True, "Content", True, False), (1, None, "other", "OTH-001", True, "Other", False, False)]
    rows, states, one = rules.report(results, spark.createDataFrame(checks, "org_id int, project_id int, agent string, check_code string, is_active boolean, category string, auto_fixable boolean, internal_check boolean"), 1, 7)
    assert {r.rule_id for r in rows.collect()} == {f"STR-00{i}" for i in range(1, 10)} | {"IMG-001", "OTH-001"}
    assert {(r.doc_id, r.analyzer): r.state for r in states.collect()} == {(d, a): s for d in ("good", "bad") for a, s in (("structure", "COMPLETED"), ("images", "COMPLETED"), ("other", "FAILED"))}
    got = {r.doc_id: r for r in one.collect()}
    assert (got["good"].overall, got["good"].score, got["good"].score_status, got["good"].risk_level, got["good"].wcag_risk) == ("PASS", 100.0, "partial", "NONE_DETECTED", "None")
    bad = {r.rule_id: r.status for r in rows.where("doc_id = 'bad'").collect()}
    assert got["bad"].failed == sum(s == "FAIL" for s in bad.values()) and got["bad"].fail_critical == 1 and got["bad"].auto_fixable == 1 and got["bad"].risk_level == "HIGH" and got["bad"].not_evaluated == 1


def test_contrast(spark):
    from inkwell.functions.text import contrast_ratio, parse_hex

    row = spark.range(1).select(F.round(contrast_ratio(F.lit("000000"), F.lit("FFFFFF")), 2).alias("a"), F.round(contrast_ratio(F.lit("777777"), F.lit("FFFFFF")), 2).alias("b"), parse_hex(F.lit("#abc")).alias("c"), parse_hex(F.lit("xyz")).alias("d")).first()
    assert tuple(row) == (21.0, 4.48, "AABBCC", None)


def test_slide_rules(spark):
    df = spark.createDataFrame(
        [
            shape("a", 1, 0, "body", "Body text first"), shape("a", 1, 1, "title", "Overview"),
            shape("b", 1, 0, "image", "", decorative=True, runs=[]), shape("b", 1, 1, "text", "Content"),
            shape("c", 1, 0, "text", "One", z_order=2), shape("c", 1, 1, "text", "Two", z_order=1),
            shape("d", 1, 0, "title", "Click to add title"), shape("d", 2, 0, "title", "Same"), shape("d", 3, 0, "title", "same"), shape("d", 4, 0, "text", "", layout=None, runs=[]),
            shape("e", 1, 0, "title", "Fine"), shape("e", 1, 1, "text", "Body"),
        ],
        SHAPE,
    )
    order, structure = found(rules.slide_reading_order(df)), found(rules.slide_structure(df))
    assert {("a", "PPT-READING-001"), ("b", "PPT-READING-003"), ("c", "PPT-READING-004")} <= order and not any(d == "e" for d, _ in order | structure)
    assert {("d", "PPT-HEADING-002"), ("d", "PPT-HEADING-003"), ("d", "PPT-STRUCTURE-001"), ("d", "PPT-STRUCTURE-002"), ("d", "PPT-STRUCTURE-003"), ("d", "PPT-STRUCTURE-004"), ("b", "PPT-STRUCTURE-001")} <= structure
    assert ("b", "PPT-HEADING-004") not in structure
    grey = spark.createDataFrame([shape("g", 1, 0, "text", "x y", runs=[("x y", 10.0, "Arial", False, "999999")]), shape("g", 1, 1, "image", "", alt_text="image of a cat", runs=[])], SHAPE)
    assert ("g", "PPT-COLOR-001") in found(rules.slide_contrast(grey)) and ("g", "PPT-TEXT-002") in found(rules.slide_text(grey)) and ("g", "PPT-IMAGE-002") in found(rules.slide_images(grey))
    links = spark.createDataFrame([("l", 1, "here", "http://", None), ("l", 2, "https://a.b", "https://a.b", "tip")], "doc_id string, slide_no int, text string, target string, tooltip string")
    assert found(rules.slide_links(links)) == {("l", f"PPT-LINK-00{i}") for i in (1, 2, 3, 4)}


def test_page_rules(spark):
    nodes = spark.createDataFrame([("x", 1, "H1", "Document", "A"), ("x", 2, "H3", "Document", "B"), ("y", 1, "H2", "P", ""), ("y", 2, "P", "Document", "t")], "doc_id string, seq int, type string, parent_type string, text string")
    got = found(rules.page_headings(nodes))
    assert got == {("x", "HDR-003"), ("y", "HDR-001"), ("y", "HDR-002"), ("y", "HDR-004"), ("y", "HDR-005")}
    pages = spark.createDataFrame([("x", 1, "see https://a.b/c. and me@x.org")], "doc_id string, page int, text string")
    links = spark.createDataFrame([("x", 1, "mailto:me@x.org")], "doc_id string, page int, target string")
    assert [r.message for r in rules.page_links(pages, links).collect()] == ["https://a.b/c."]
    texts = spark.createDataFrame([("x", 1, "999999", False), ("x", 1, "999999", True), ("x", 1, "000000", False)], "doc_id string, page int, color string, large boolean")
    none = spark.createDataFrame([], "doc_id string, page int, color string")
    assert found(rules.page_colors(texts, none)) == {("x", "COLOR-001"), ("x", "COLOR-002")}


def test_fragments_and_words(spark):
    rows = [("a", p, i, "P", t, "F", s, False, 0.0, y, 100.0) for p, i, t, s, y in [(1, 1, "Header", 9.0, 95.0), (2, 2, "header ", 9.0, 95.0), (1, 3, "Mid", 9.0, 95.0), (2, 4, "Mid", 9.0, 50.0), (1, 5, "Body " * 20, 10.0, 50.0)]]
    heads = [("a", 1, 10, "H1", "Big", "F", 20.0, True, 0.0, 40.0, 100.0), ("a", 1, 11, "H2", "Near", "F", 19.0, True, 0.0, 40.0, 100.0), ("a", 1, 12, "H2", "Third", "F", 18.5, True, 0.0, 40.0, 100.0), ("a", 1, 13, "H3", "1.", "F", 20.0, True, 0.0, 40.0, 100.0)]
    df = spark.createDataFrame(rows + heads, "doc_id string, page int, seq int, tag string, text string, font string, size double, bold boolean, x double, y double, page_height double")
    assert {r.seq for r in elements.running_headers(df).where("is_furniture").collect()} == {1, 2}
    levels = {r.seq: (r.demoted, r.level) for r in elements.heading_eligibility(df).collect()}
    assert levels == {10: (None, 1), 11: (None, 1), 12: (None, 2), 13: ("enumerator", None)}
    assert elements.style_levels(df).orderBy("level").first()["size"] == 20.0
    words = spark.createDataFrame([("a", 1, 1, "b", 20.0, 10.0, 30.0, 12.0), ("a", 1, 2, "a", 1.0, 11.0, 9.0, 12.0), ("a", 1, 3, "c", 1.0, 14.0, 9.0, 16.0)], "doc_id string, page int, seq int, text string, left double, top double, right double, bottom double")
    assert [r.text for r in elements.reconstruct_lines(words).orderBy("line").collect()] == ["a b", "c"]
    facts = spark.createDataFrame([("a", 1, 1, 90)], "doc_id string, page int, n_images int, rotation int")
    assert tuple(elements.page_layout(words, facts).first())[2:] == (3, False, True, True)


@pytest.mark.parametrize(("alt", "kind"), [("", "empty"), ("image", "placeholder"), ("###@@@12", "corrupt"), ("word " * 90, "dump"), ("A red house", "ok")])
def test_alt_quality(spark, alt, kind):
    df = spark.createDataFrame([(alt, None, 10.0, 50.0)], "alt string, caption string, width double, height double")
    row = rules.alt_quality(df).first()
    assert row.alt_class == kind and row.decorative_by_size


def test_slide_titles_are_the_fixed_values(spark):
    rows = [(1, i, 1, None, "title", t, None) for i, t in enumerate(["Add a title", "Slide title", "Untitled", "Add title"])]
    shapes = spark.createDataFrame(rows, "doc_id int, slide_no int, shape_seq int, slide_title string, type string, text string, layout string").withColumn("runs", F.array(F.struct(F.lit("").alias("text"))))
    found = rules.slide_structure(shapes).where("rule_id = 'PPT-HEADING-002'").collect()
    assert sorted(r.location for r in found) == ["0", "2"]


def test_contrast_of_an_unknown_colour_is_unknown(spark):
    row = spark.range(1).select(contrast_ratio(F.lit("000000"), F.lit(None).cast("string")).alias("a"), contrast_ratio(F.lit("000000"), F.lit("FFFFFF")).alias("b"), banner_key(F.lit("2023 Summary 4")).alias("k")).first()
    assert row.a is None and abs(row.b - 21) < 1e-9 and row.k == "summary"


def test_page_headings_sort_once(spark):
    """One sort of the elements serves both windows, so that a task holds them once."""
    nodes = spark.createDataFrame([("a", 2, "H1", "Document", "t"), ("a", 1, "H3", "Document", "t"), ("b", 1, "P", "Sect", "")], "doc_id string, seq int, type string, parent_type string, text string")
    df = rules.page_headings(nodes)
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {(r.doc_id, r.rule_id) for r in df.collect()} == {("a", "HDR-003"), ("b", "HDR-001"), ("b", "HDR-002")}


def test_paragraphs_meet_in_bounded_partitions(spark):
    """A task's rows don't grow with the table, though a shuffle's bytes would let AQE put all of them together."""
    paragraphs, _, _, _, meta, *_ = word_inputs(spark)
    many = paragraphs.where("doc_id = 'good'").drop("doc_id").crossJoin(spark.range(30_000).select(F.concat(F.lit("d"), "id").alias("doc_id"))).select(*paragraphs.columns)
    total = many.count()
    rows = rules.paragraph_rows(many, meta).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) >= total and max(r["count"] for r in rows) <= 30_000 and len(rows) >= -(-total // 20_000)
    assert dealt(spark.range(100), "id", 10).rdd.getNumPartitions() == 10


def test_verdicts_and_coverage_do_not_multiply(spark):
    """Documents and rules meet by one join of documents, and a report's verdicts are never joined with themselves."""
    findings = spark.createDataFrame([("a", "R1", "MANUAL"), ("a", "R1", "FAIL"), ("a", "R1", "MANUAL"), ("a", "R9", "FAIL"), ("b", "R2", "WARNING"), ("x", "R1", "FAIL")], "doc_id string, rule_id string, status string")
    documents = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "doc_id string")
    found = rules.verdicts(documents, findings, ["R1", "R2"], {"R1": "HIGH"})
    assert {tuple(r) for r in found.collect()} == {
        ("a", "R1", "HIGH", "FAIL", 3), ("a", "R2", "MEDIUM", "PASS", 0), ("b", "R1", "HIGH", "PASS", 0), ("b", "R2", "MEDIUM", "WARNING", 1), ("c", "R1", "HIGH", "PASS", 0), ("c", "R2", "MEDIUM", "PASS", 0),
    }
    catalog_ = spark.createDataFrame([("R1", "x", True), ("R3", "y", True), ("R2", "x", False)], "rule_id string, analyzer string, enabled boolean")
    rows, _ = executed_checks_coverage(found, catalog_, also=["severity", "affected_count"])
    assert {tuple(r) for r in rows.where("doc_id <> 'c'").collect()} == {("a", "x", "R1", "FAIL", "HIGH", 3), ("a", "y", "R3", "NOT_EVALUATED", None, None), ("b", "x", "R1", "PASS", "HIGH", 0), ("b", "y", "R3", "NOT_EVALUATED", None, None)}
    shuffled = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(rules.verdicts(documents, findings, ["R1", "R2"])) == 1 and shuffled(executed_checks_coverage(findings, catalog_)[0]) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_report_joins_no_verdicts_with_verdicts(spark):
    """What is told of a verdict stays with it, so that no join grows with documents and rules."""
    results, _ = rules.run_word_checks(*word_inputs(spark))
    checks = [(1, None, "structure", r, True, "Content", False, False) for r in ("STR-001", "OTH-001")]
    scope = spark.createDataFrame(checks, "org_id int, project_id int, agent string, check_code string, is_active boolean, category string, auto_fixable boolean, internal_check boolean")
    written, tables = [], rules.Tables.write
    rules.Tables.write = lambda self, df: written.append(df) or tables(self, df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rules.report(results, scope, 1, 7)[0]
    finally:
        rules.Tables.write = tables
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written[1]._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    assert {(r.doc_id, r.rule_id, r.severity, r.affected_count) for r in rows.collect() if r.rule_id == "OTH-001"} == {(d, "OTH-001", "MEDIUM", 0) for d in ("good", "bad")}
