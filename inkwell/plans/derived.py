"""Queries whose element, version and review tables are derived from the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import elements, graph, lifecycle, prep, rules, web
from ..operators import score as k
from ..sources import files
from ..sources.tables import table
from .score import _CH, checks, items, scans_and_findings
from .text import docs


def latest(s, d):
    return c.latest_version(checks(s, d), ["doc_id", "rule_id"], [F.desc("location")])


def review(s, d):
    n = F.col("l_linenumber")
    rows = items(s, d).select(
        F.col("l_suppkey").alias("project_id"), F.lit("s").alias("section"), (n % 3).alias("unit_number"), F.concat(F.lit("u"), n % 3).alias("unit"), n.alias("chapter_number"),
        F.when(n == 7, " total ").otherwise(F.concat(F.lit(" c"), "l_partkey")).alias("chapter"), F.when(F.col("l_partkey") % 5 == 0, "new").otherwise("").alias("corrected"), F.when(F.col("l_partkey") % 4 == 0, "n").alias("keep"),
        (F.col("l_partkey") % 10).alias("pyq_hits"), F.when(F.col("l_orderkey") % 2 == 0, (n + 1).cast("string")).otherwise("x").alias("sme_weight"),
    )
    return files.read_review_sheet(rows)


def outline(s, d):
    """Headings: a document per order, a level per line."""
    rows = items(s, d).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line_no")).agg(F.min(F.col("l_partkey") % 6 + 1).cast("int").alias("level"))
    return rows.withColumn("title", F.concat(F.lit("t"), "level", F.lit("-"), "line_no"))


def headings(s, d):
    nodes = outline(s, d).select("doc_id", F.col("line_no").alias("seq"), F.concat(F.lit("H"), "level").alias("type"), F.lit("Document").alias("parent_type"), F.col("title").alias("text"))
    return rules.page_headings(nodes).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


def furniture(s, d):
    f = items(s, d).select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.col("l_partkey") % 97, F.lit("")).alias("text"), F.lit("P").alias("tag"), F.when(F.col("l_partkey") % 97 < 60, 95.0).otherwise(F.col("l_quantity") * 2.0).alias("y"), F.lit(100.0).alias("page_height"))
    return elements.running_headers(f).groupBy("doc_id", "is_furniture").agg(F.count("*").alias("n"))


def units(s, d):
    ch = items(s, d).select(F.col("l_orderkey").alias("project_id"), (F.col("l_linenumber") % 3).alias("unit_number"), F.concat(F.lit("u"), F.col("l_linenumber") % 3).alias("unit"), F.concat(F.lit("c"), "l_linenumber").alias("chapter"), F.col("l_linenumber").alias("position")).dropDuplicates(["project_id", "position"])
    return k.group_into_units(ch).select("project_id", "unit_no", "unit_number", "unit", F.array_join(F.transform("chapters", lambda x: x.chapter), ",").alias("chapters"))


def templates(s, d):
    names = table(s, d, "nation").where("n_regionkey <> 2").select(F.concat(F.lit("base_"), F.lower("n_name")).alias("name"))
    asks = table(s, d, "customer").join(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("request_id"), F.lit("base").alias("base"), F.initcap("n_name").alias("category"))
    return c.resolve_template(names, asks)


#: Elements by the page's number, behind those that its own markup has.
MARKUP = """CASE WHEN page_id % 3 = 0 THEN '<img src="/i' || page_id || '.png">' WHEN page_id % 3 = 1 THEN '<img src="/j.png" alt="">' ELSE '' END
  || CASE WHEN page_id % 4 = 0 THEN '<input id="q' || page_id || '" name="q">' WHEN page_id % 4 = 1 THEN '<label for="r">R</label><select id="r"></select>' WHEN page_id % 4 = 2 THEN '<textarea aria-label="about"></textarea>' ELSE '<select name="s"></select>' END
  || '<a href="/own' || page_id || '">' || CASE page_id % 5 WHEN 0 THEN 'Click here' WHEN 1 THEN ' ' WHEN 2 THEN 'https://x.org' ELSE 'The annual report' END || '</a>'"""


def marked_up(s, d):
    return web.html_elements(table(s, d, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.expr(MARKUP)).alias("html")))


def page_rules(s):
    return s.createDataFrame([("IMG_ALT", "HIGH", True), ("FORM_LABEL", "LOW", True), ("OFF", "LOW", False)], "rule_code string, severity string, enabled boolean")


def issues(s, d):
    rows = lifecycle.issue_lifecycle(*scans_and_findings(s, d))
    rule = table(s, d, "events").select(F.col("event_type").alias("rule_code")).distinct().withColumn("severity", F.upper("rule_code"))
    return rows, rule


def crawls(s, d):
    scans = table(s, d, "orders").select(F.col("o_custkey").alias("crawl_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderkey") % 5 == 0, "RUNNING").when(F.col("o_orderkey") % 3 == 0, "QUEUED").otherwise("FAILED").alias("status"))
    return k.crawl_status(table(s, d, "customer").select(F.col("c_custkey").alias("crawl_id")), scans)


def clones(s, d):
    master = table(s, d, "part").select(F.col("p_partkey").alias("check_code"), (F.col("p_partkey") % 3 > 0).alias("is_active"))
    scoped = items(s, d).select(F.lit(1).cast("long").alias("org_id"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(5)).cast("long").alias("project_id"), F.col("l_partkey").alias("check_code"), F.lit(True).alias("is_active")).distinct()
    return c.clone_checks(master, scoped, 1, None)


def policy_checks(s, d):
    return items(s, d).select((F.col("l_suppkey") % 5).alias("org_id"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("project_id"), F.col("l_returnflag").alias("agent"), F.col("l_partkey").alias("check_code"), (F.col("l_quantity") > 20).alias("is_active")).distinct()


def generated(s, d):
    batch = items(s, d).select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("t"), "l_linenumber").alias("title")).distinct()
    made = items(s, d).where("l_returnflag <> 'N'").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit(" p"), F.col("l_linenumber"), F.lit(" ")).alias("content"), F.array(F.lit("b"), F.lit(" a "), F.lit(""), F.lit("b")).alias("source_ids"))
    return c.merge_generated(batch, made).withColumn("source_ids", F.array_join("source_ids", ","))


def activated(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").cast("int").alias("version"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("draft").alias("status"))
    return c.activate_version(o, c.latest_version(o.where("status = 'draft'"), ["name"], [F.desc("version")]).select("name", "version"))


def summary(s, d):
    runs = table(s, d, "customer").select(F.col("c_custkey").alias("run_id"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey")
    lines = o.join(items(s, d).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("run_id")
    return k.processing_summary(runs, {"documents": o, "chunks": lines})


def coverage(s, d):
    rows = c.latest_version(checks(s, d), ["doc_id", "rule_id"], [F.asc("location")])
    cat = rows.select("rule_id", F.col("category").alias("analyzer")).distinct().withColumn("enabled", F.lit(True))
    return k.executed_checks_coverage(rows.where("status <> 'INFO'"), cat)[1]


def upserted(s, d):
    source = items(s, d).groupBy((F.col("l_partkey") + F.col("l_partkey") % 8 * 500).alias("p_partkey")).agg(F.max("l_linenumber").cast("int").alias("p_size"))
    return c.upsert(table(s, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size")), source, "p_partkey", ["p_size"]).groupBy("action").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


QUERIES = {
    "s5_upsert_checks": upserted,
    "s6_clone_checks": lambda s, d: clones(s, d).groupBy("project_id").agg(F.count("*").alias("n"), F.sum("check_code").alias("codes")),
    "s10_review_sheet": lambda s, d: review(s, d).groupBy("project_id", "kept", "retitled").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")),
    "a7_recommendations": lambda s, d: k.recommendations(latest(s, d).select("doc_id", "rule_id", "severity", "status", "affected_count"), checks(s, d).select("doc_id", "rule_id", "location"), 2).withColumn("locations", F.array_join(F.transform("locations", lambda x: x.cast("string")), ",")),
    "a8_lint_summary": lambda s, d: k.lint_summary(checks(s, d)).select("doc_id", "total", "auto_fixable", F.col("by_severity")["HIGH"].alias("high"), F.col("by_category")["click"].alias("click")),
    "a10_crawl_status": crawls,
    "a17_review_counts": lambda s, d: k.review_counts(review(s, d)),
    "a21_processing_summary": summary,
    "a22_group_into_units": units,
    "f5_scan_issues": lambda s, d: lifecycle.scan_issues(*issues(s, d), 78900).select("page_id", "rule_code", "element_selector", "status", "severity"),
    "j1_issues_with_rules": lambda s, d: lifecycle.issues_with_rules(*issues(s, d)).groupBy("severity", "status").agg(F.count("*").alias("n")),
    "j3_resolve_checks": lambda s, d: c.resolve_checks(policy_checks(s, d), 2, 4),
    "j3_project_wins": lambda s, d: c.resolve_checks(policy_checks(s, d), 2, 4, "project_wins"),
    "j4_resolve_template": templates,
    "j8_merge_generated": generated,
    "j12_checks_coverage": coverage,
    "k4_sorted_findings": lambda s, d: k.sorted_findings(checks(s, d).where("status = 'FAIL'").select("location", "severity", (F.col("location") % 50).alias("page_no"))),
    "w3_activate_version": activated,
    "w6_heading_breadcrumb": lambda s, d: prep.heading_breadcrumb(outline(s, d)).select("doc_id", "line_no", "path"),
    "w7_heading_levels": headings,
    "w12_running_headers": furniture,
    "w18_font_consistency": lambda s, d: elements.font_consistency(items(s, d).select("l_orderkey", F.concat(F.lit("ABCDEF+f"), F.col("l_partkey") % 5).alias("font")), ["l_orderkey"], 3),
    "n1_entities": lambda s, d: graph.entities(docs(s, d)),
    "p3_missing_alt": lambda s, d: web.missing_alt(marked_up(s, d)),
    "j10_form_label_gaps": lambda s, d: web.form_label_gaps(marked_up(s, d)),
    "r5_generic_links": lambda s, d: web.generic_links(marked_up(s, d).where("attrs['href'] like '/own%'")),
    "p5_page_rules": lambda s, d: web.evaluate_page_rules(marked_up(s, d), page_rules(s)).groupBy("rule_code", "severity").agg(F.count("*").alias("n")),
}
_LATEST = "la AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY location DESC) = 1)"
_REVIEW = """rv AS (SELECT l_suppkey AS project_id, CASE WHEN l_partkey % 5 = 0 THEN 'new' ELSE 'c' || l_partkey END AS chapter, l_partkey % 5 = 0 AS retitled, l_partkey % 4 <> 0 AS kept, CASE WHEN l_orderkey % 2 = 0 THEN (l_linenumber + 1)::INT END AS weight FROM lineitem WHERE l_linenumber <> 7)"""
_OUT = "ol AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, min(l_partkey % 6 + 1)::INT AS level FROM lineitem GROUP BY 1, 2)"
_LIFE = """e AS (SELECT user_id AS page_id, date_diff('day', DATE '1970-01-01', ts::DATE) * 4 + hour(ts) // 6 AS scan_id, event_type AS rule_code, (event_id % 3)::VARCHAR AS element_selector FROM events),
 s AS (SELECT DISTINCT page_id, scan_id FROM e WHERE scan_id % 7 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY scan_id) AS o FROM s), t AS (SELECT page_id, max(o) AS top FROM o GROUP BY 1),
 f AS (SELECT DISTINCT page_id, rule_code, element_selector, scan_id, o FROM e JOIN o USING (page_id, scan_id)), i AS (SELECT page_id, rule_code, element_selector, count(*) AS n, min(scan_id) AS first_scan, max(scan_id) AS last_scan, min(o) AS lo, max(o) AS hi FROM f GROUP BY 1, 2, 3),
 li AS (SELECT i.*, upper(rule_code) AS severity, CASE WHEN hi < top THEN 'RESOLVED' WHEN hi - lo + 1 > n THEN 'REOPENED' ELSE 'OPEN' END AS status FROM i JOIN t USING (page_id))"""
_POL = "pc AS (SELECT DISTINCT l_suppkey % 5 AS org_id, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS project_id, l_returnflag AS agent, l_partkey AS check_code, l_quantity > 20 AS is_active FROM lineitem), pr AS (SELECT * FROM pc WHERE is_active AND org_id = 2 AND (project_id = 4 OR project_id IS NULL))"
_LEVELS = ", ".join(f"last_value(CASE WHEN level = {i} THEN line_no END IGNORE NULLS) OVER w AS p{i}" for i in range(1, 7))
_PATH = ", ".join(f"CASE WHEN p{i} IS NOT NULL{''.join(f' AND coalesce(p{j}, -1) < p{i}' for j in range(1, i))} THEN 't{i}-' || p{i} END" for i in range(1, 7))
_STOP = "[" + ", ".join(f"'{w}'" for w in graph.STOPWORDS) + "]"
ORACLES = {
    "s5_upsert_checks": "WITH s AS (SELECT l_partkey + l_partkey % 8 * 500 AS k, max(l_linenumber)::INT AS v FROM lineitem GROUP BY 1), j AS (SELECT CASE WHEN p_partkey IS NULL THEN 'inserted' WHEN k IS NULL THEN 'kept' WHEN v = p_size THEN 'unchanged' ELSE 'updated' END AS action, coalesce(v, p_size) AS v FROM part FULL JOIN s ON k = p_partkey) SELECT action, count(*) AS n, sum(v)::BIGINT AS total FROM j GROUP BY 1",
    "s6_clone_checks": "WITH sc AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 5 END AS project_id, l_partkey AS check_code FROM lineitem), al AS (SELECT * FROM sc UNION ALL SELECT NULL, p_partkey FROM part WHERE p_partkey % 3 > 0 AND p_partkey NOT IN (SELECT check_code FROM sc WHERE project_id IS NULL)) SELECT project_id, count(*) AS n, sum(check_code)::BIGINT AS codes FROM al GROUP BY 1",
    "s10_review_sheet": f"WITH {_REVIEW} SELECT project_id, kept, retitled, count(*) AS n, sum(weight)::BIGINT AS weight FROM rv GROUP BY 1, 2, 3",
    "a7_recommendations": f"WITH {_CH}, {_LATEST}, fi AS (SELECT doc_id, rule_id, string_agg(location::VARCHAR, ',' ORDER BY location) AS locations FROM (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY location) <= 2) GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, affected_count DESC, rule_id) AS position, rule_id, severity, affected_count, locations FROM la JOIN fi USING (doc_id, rule_id) WHERE status = 'FAIL'",
    "a8_lint_summary": f"WITH {_CH} SELECT doc_id, count(*) AS total, count(*) FILTER (auto_fixable) AS auto_fixable, nullif(count(*) FILTER (severity = 'HIGH'), 0) AS high, nullif(count(*) FILTER (category = 'click'), 0) AS click FROM ch GROUP BY 1",
    "a10_crawl_status": "WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderkey % 5 = 0 THEN 'RUNNING' WHEN o_orderkey % 3 = 0 THEN 'QUEUED' ELSE 'FAILED' END AS st FROM orders) SELECT c_custkey AS crawl_id, count(st) AS n_scans, CASE WHEN count(st) = 0 OR bool_and(st = 'COMPLETED') THEN 'COMPLETED' WHEN bool_or(st = 'RUNNING') THEN 'RUNNING' WHEN bool_or(st = 'QUEUED') THEN 'QUEUED' ELSE 'PARTIAL' END AS status FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY 1",
    "a17_review_counts": f"WITH {_REVIEW} SELECT project_id, count(*) AS rows, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (kept AND weight IS NOT NULL) AS weighted, count(*) FILTER (kept AND retitled) AS retitled FROM rv GROUP BY 1",
    "a21_processing_summary": "SELECT c_custkey AS run_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS documents, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS chunks FROM customer",
    "a22_group_into_units": "WITH u AS (SELECT DISTINCT l_orderkey AS project_id, l_linenumber % 3 AS unit_number, l_linenumber AS p FROM lineitem), g AS (SELECT project_id, unit_number, min(p) AS f, string_agg('c' || p, ',' ORDER BY p) AS chapters FROM u GROUP BY 1, 2) SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY f) AS unit_no, unit_number, 'u' || unit_number AS unit, chapters FROM g",
    "f5_scan_issues": f"WITH {_LIFE} SELECT page_id, rule_code, element_selector, status, severity FROM li WHERE first_scan = 78900 OR last_scan = 78900",
    "j1_issues_with_rules": f"WITH {_LIFE} SELECT severity, status, count(*) AS n FROM li GROUP BY 1, 2",
    "j3_resolve_checks": f"WITH {_POL} SELECT * FROM pr",
    "j3_project_wins": f"WITH {_POL} SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY org_id, agent, check_code ORDER BY project_id IS NULL) = 1",
    "j4_resolve_template": "WITH n AS (SELECT n_nationkey, n_regionkey, 'base_' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS t, 'base_' || lower(n_name) AS own FROM nation) SELECT c_custkey AS request_id, CASE WHEN t IN (SELECT own FROM n WHERE n_regionkey <> 2) THEN t ELSE 'base' END AS template FROM customer JOIN n ON n_nationkey = c_nationkey",
    "j8_merge_generated": "SELECT l_orderkey AS batch_id, l_linenumber AS pos, 't' || l_linenumber AS title, CASE WHEN bool_or(l_returnflag <> 'N') THEN 'p' || l_linenumber ELSE '' END AS content, CASE WHEN bool_or(l_returnflag <> 'N') THEN 'a,b' ELSE '' END AS source_ids FROM lineitem GROUP BY 1, 2",
    "j12_checks_coverage": f"WITH {_CH}, fi AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY location) = 1), ct AS (SELECT DISTINCT rule_id, category AS analyzer FROM fi), kp AS (SELECT * FROM fi WHERE status <> 'INFO'), w AS (SELECT d.doc_id, analyzer, coalesce(kp.status, 'NOT_EVALUATED') AS st FROM (SELECT DISTINCT doc_id FROM kp) d, ct LEFT JOIN kp ON kp.doc_id = d.doc_id AND kp.rule_id = ct.rule_id) SELECT doc_id, analyzer, CASE WHEN bool_and(st = 'NOT_EVALUATED') THEN 'FAILED' WHEN bool_or(st = 'NOT_EVALUATED') THEN 'PARTIAL' ELSE 'COMPLETED' END AS state FROM w GROUP BY 1, 2",
    "k4_sorted_findings": f"WITH {_CH} SELECT location, severity, location % 50 AS page_no FROM ch WHERE status = 'FAIL'",
    "w3_activate_version": "WITH t AS (SELECT o_custkey, max(o_orderkey) AS target FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT o_custkey::VARCHAR AS name, o_orderkey::INT AS version, CASE WHEN target IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'draft' END WHEN o_orderkey = target THEN 'active' WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'draft' END AS status FROM orders LEFT JOIN t USING (o_custkey)",
    "w6_heading_breadcrumb": f"WITH {_OUT}, p AS (SELECT doc_id, line_no, {_LEVELS} FROM ol WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) SELECT doc_id, line_no, concat_ws(' > ', {_PATH}) AS path FROM p",
    "w7_heading_levels": f"WITH {_OUT}, d AS (SELECT doc_id, count(*) FILTER (level = 1) AS h1 FROM ol GROUP BY 1), g AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, level - lag(level) OVER (PARTITION BY doc_id ORDER BY level) AS gap FROM (SELECT DISTINCT doc_id, level FROM ol)) WHERE gap > 1) SELECT doc_id, 'HDR-001' AS rule_id, 1 AS n FROM d WHERE h1 = 0 UNION ALL SELECT doc_id, 'HDR-002', 1 FROM d WHERE h1 <> 1 UNION ALL SELECT doc_id, 'HDR-003', 1 FROM g",
    "w12_running_headers": "WITH f AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, l_partkey % 97 AS t, CASE WHEN l_partkey % 97 < 60 THEN 95.0 ELSE l_quantity * 2.0 END AS y FROM lineitem), k AS (SELECT doc_id, t, count(DISTINCT page) >= 2 AND bool_and(y <= 14.000000000000002 OR y >= 86) AS fu FROM f GROUP BY 1, 2) SELECT doc_id, fu AS is_furniture, count(*) AS n FROM f JOIN k USING (doc_id, t) GROUP BY 1, 2",
    "w18_font_consistency": "SELECT l_orderkey, count(DISTINCT l_partkey % 5) AS fonts, count(DISTINCT l_partkey % 5) <= 3 AS consistent FROM lineitem GROUP BY 1",
    "p3_missing_alt": """SELECT page_id, 'IMG_ALT' AS rule_code, 'img[src="/i' || page_id || '.png"]' AS element_selector, 'Image has no alt attribute' AS message FROM pages WHERE page_id % 3 = 0""",
    "j10_form_label_gaps": """SELECT page_id, 'FORM_LABEL' AS rule_code, CASE WHEN page_id % 4 = 0 THEN '#q' || page_id ELSE 'select[name="s"]' END AS element_selector, 'Control has no label' AS message FROM pages WHERE page_id % 4 IN (0, 3)""",
    "r5_generic_links": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'LINK_GENERIC' WHEN 1 THEN 'LINK_EMPTY' ELSE 'LINK_RAW_URL' END AS rule_code, 'a[href="/own' || page_id || '"]' AS element_selector,
      CASE page_id % 5 WHEN 0 THEN 'Click here' WHEN 1 THEN '' ELSE 'https://x.org' END AS message FROM pages WHERE page_id % 5 < 3""",
    "p5_page_rules": "SELECT 'IMG_ALT' AS rule_code, 'HIGH' AS severity, count(*) AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'FORM_LABEL', 'LOW', count(*) FROM pages WHERE page_id % 4 IN (0, 3)",
    "n1_entities": rf"WITH a AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b', 1) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS label, generate_subscripts(l, 1) AS i FROM a), f AS (SELECT doc_id, label, min(i) AS i FROM u WHERE contains(label, ' ') OR NOT list_contains({_STOP}, lower(label)) GROUP BY 1, 2) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS id, label FROM f",
}
