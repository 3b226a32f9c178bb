"""Queries on check tables, catalogues and versions, and their SQL. Check tables are derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import lifecycle
from ..operators import score as k
from ..sources.tables import table

N = "event_id"


def checks(s, d):
    n = F.col(N)
    return table(s, d, "events").select(
        F.col("user_id").alias("doc_id"), F.lit("agent").alias("agent"), F.concat(F.col("event_type"), (n % 4).cast("string")).alias("rule_id"), F.col("event_type").alias("category"),
        F.when(n % 11 < 4, "LOW").when(n % 11 < 7, "MEDIUM").when(n % 11 < 9, "HIGH").otherwise("CRITICAL").alias("severity"),
        F.when(n % 5 < 2, "PASS").when(n % 5 == 2, "WARNING").when(n % 5 == 3, "FAIL").when(n % 2 == 0, "NOT_EVALUATED").otherwise("INFO").alias("status"),
        (n % 3 == 0).alias("auto_fixable"), (n % 17 == 0).alias("internal_check"), (n % 6 + 1).alias("affected_count"), n.alias("location"), F.to_date("ts").alias("day"),
    )


def day_parts(s, d):
    """Checks of every document's earliest and latest row per rule."""
    rows = checks(s, d)
    first = c.latest_version(rows, ["doc_id", "rule_id"], [F.asc("location")])
    last = c.latest_version(rows, ["doc_id", "rule_id"], [F.desc("location")])
    return first, last


def scans_and_findings(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("page_id"), (F.unix_date(F.to_date("ts")) * 4 + F.hour("ts") / 6).cast("long").alias("scan_id"), F.col("event_type").alias("rule_code"), (F.col(N) % 3).cast("string").alias("element_selector"), F.concat(F.lit("m"), F.col(N)).alias("message"))
    scans = e.select("page_id", "scan_id").distinct().withColumn("status", F.when(F.col("scan_id") % 7 == 0, "BLOCKED").otherwise("COMPLETED"))
    return scans, e


def page_findings(s, d):
    n = F.col(N)
    return table(s, d, "events").select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("page_id"), F.col("event_type").alias("rule_code"), (n % 3).cast("string").alias("element_selector"), F.when(n % 8 == 0, "CRITICAL").when(n % 12 == 0, "SERIOUS").when(n % 5 == 0, "MODERATE").otherwise("MINOR").alias("severity"))


def by_status(s, d, status):
    return checks(s, d).where(F.col("status") == status).select("doc_id", "rule_id")


def versions(s, d):
    o = table(s, d, "orders")
    rank = F.row_number().over(c.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    existing = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), rank.alias("version"), F.when(F.col("o_orderkey") % 2 == 0, "audit").otherwise("review").alias("sheet_type"), F.lit("current").alias("status"), (F.col("o_orderkey") % 10 == 1).alias("is_deleted"))
    new = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, "audit").otherwise("review").alias("sheet_type"))
    return existing, new


PRICES = [("click", 2.5, 10.0), ("view", 0.15, 0.6), ("purchase", 3.0, 15.0)]


def costs(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("model"), (F.col(N) % 1000).alias("input_tokens"), (F.col(N) % 300).alias("output_tokens"))
    return k.llm_cost(e, s.createDataFrame(PRICES, "model string, input_rate double, output_rate double"))


def items(s, d):
    return table(s, d, "lineitem")


QUERIES = {
    "a1_validation_summary": lambda s, d: k.validation_summary(checks(s, d)),
    "a2_retained_score": lambda s, d: k.retained_score(checks(s, d))[0],
    "a2_retained_by_category": lambda s, d: k.retained_score(checks(s, d))[1],
    "a3_weighted_score": lambda s, d: k.weighted_score(checks(s, d)),
    "a4_dashboard_kpis": lambda s, d: k.dashboard_kpis(checks(s, d), pdfua_rules=["click0", "view1", "purchase2", "login3"]),
    "a5_result_summary": lambda s, d: k.result_summary(by_status(s, d, "FAIL"), by_status(s, d, "WARNING"), by_status(s, d, "INFO")),
    "a6_severity_distribution": lambda s, d: k.severity_distribution(checks(s, d)),
    "a9_page_scan_score": lambda s, d: k.page_scan_score(page_findings(s, d)).withColumn("score", F.col("score").cast("double")),
    "a14_llm_cost": costs,
    "a15_message_tokens": lambda s, d: k.message_tokens(table(s, d, "conversations")),
    "a16_review_rollup": lambda s, d: k.review_rollup(items(s, d).select(F.col("l_orderkey").alias("unit"), (F.col("l_partkey") % 14).alias("pyq_hits"))),
    "a19_savings_ledger": lambda s, d: k.savings_ledger(table(s, d, "events").select("user_id", F.when(F.col("event_type") == "click", "model").otherwise("cache").alias("route")), "user_id"),
    "j6_remediation_outcome": lambda s, d: k.remediation_outcome(*day_parts(s, d))[0],
    "j6_agent_status": lambda s, d: k.remediation_outcome(*day_parts(s, d))[1],
    "w14_cap_findings": lambda s, d: k.cap_findings(checks(s, d).select("doc_id", "rule_id", "location"), 2),
    "w5_issue_lifecycle": lambda s, d: lifecycle.issue_lifecycle(*scans_and_findings(s, d)),
    "f1_page": lambda s, d: c.page(table(s, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 10, 25, "re", ["p_name"])[0],
    "f1_page_total": lambda s, d: c.page(table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 0, 5, "1", ["c_name"])[1],
    "f2_prefix_filter": lambda s, d: c.prefix_filter(table(s, d, "customer").select("c_custkey", "c_name"), "c_name", "Customer#00000000"),
    "f3_active_rows": lambda s, d: c.active_rows(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 7 == 0, [F.desc("o_orderkey")], 5, 40, o_orderstatus="F"),
    "f4_optional_filters": lambda s, d: c.optional_filters(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), o_orderstatus="O", o_custkey=None),
    "j2_feature_status": lambda s, d: c.feature_status(table(s, d, "part").select(F.col("p_partkey").alias("feature_id")), items(s, d).groupBy(F.col("l_partkey").alias("feature_id"), (F.col("l_suppkey") % 10).alias("template_id")).agg(F.max(F.col("l_linenumber") % 2).alias("status")), 3),
    "j5_mapping_diff": lambda s, d: c.mapping_diff(items(s, d).where("l_linenumber = 1").select("l_partkey"), items(s, d).where("l_linenumber = 2").select("l_partkey"), ["l_partkey"]),
    "j11_child_counts": lambda s, d: c.child_counts(table(s, d, "customer"), table(s, d, "orders"), "c_custkey", "o_custkey"),
    "w1_latest_version": lambda s, d: c.latest_version(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], [F.desc("o_orderkey")], F.col("o_orderstatus") != "P"),
    "w2_append_versions": lambda s, d: c.append_versions(*versions(s, d)),
    "k3_history": lambda s, d: c.history(table(s, d, "events").select(N, "user_id", "event_type"), [F.desc(N)], 20, 100, event_type="click"),
    "u1_distinct_pairs": lambda s, d: items(s, d).select("l_partkey", "l_suppkey").distinct(),
    "u2_collect_findings": lambda s, d: c.collect_findings(checks(s, d).where("status = 'FAIL'").select("doc_id", "rule_id"), checks(s, d).where("status = 'WARNING'").select("doc_id", "rule_id", "location")),
    "u3_added_removed": lambda s, d: c.mapping_diff(by_status(s, d, "FAIL"), by_status(s, d, "PASS"), ["doc_id", "rule_id"]),
}
_CH = """ch AS (SELECT user_id AS doc_id, 'agent' AS agent, event_type || (event_id % 4) AS rule_id, event_type AS category, CASE WHEN event_id % 11 < 4 THEN 'LOW' WHEN event_id % 11 < 7 THEN 'MEDIUM' WHEN event_id % 11 < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
 CASE WHEN event_id % 5 < 2 THEN 'PASS' WHEN event_id % 5 = 2 THEN 'WARNING' WHEN event_id % 5 = 3 THEN 'FAIL' WHEN event_id % 2 = 0 THEN 'NOT_EVALUATED' ELSE 'INFO' END AS status, event_id % 3 = 0 AS auto_fixable, event_id % 17 = 0 AS internal_check, event_id % 6 + 1 AS affected_count, event_id AS location FROM events)"""
_KEPT = "kept AS (SELECT *, CASE WHEN internal_check OR status = 'INFO' THEN NULL WHEN status = 'PASS' THEN 1.0 WHEN status = 'WARNING' THEN CASE severity WHEN 'LOW' THEN 0.9 WHEN 'MEDIUM' THEN 0.75 WHEN 'HIGH' THEN 0.6 ELSE 0.5 END WHEN status = 'FAIL' THEN CASE severity WHEN 'LOW' THEN 0.6 WHEN 'MEDIUM' THEN 0.35 WHEN 'HIGH' THEN 0.15 ELSE 0 END ELSE 0.5 END::DOUBLE AS k FROM ch)"
_W = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_FL = "fl AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY location) = 1), la AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY location DESC) = 1), both_ AS (SELECT la.*, coalesce(fl.status, 'PASS') AS was, coalesce(fl.auto_fixable, la.auto_fixable) AS fixable FROM la LEFT JOIN fl USING (doc_id, agent, rule_id))"
_VERS = """ex AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'audit' ELSE 'review' END AS sheet_type, o_orderkey % 10 = 1 AS is_deleted FROM orders WHERE o_orderstatus = 'F'),
 nw AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'audit' ELSE 'review' END AS sheet_type FROM orders WHERE o_orderstatus <> 'F'),
 al AS (SELECT key, version, sheet_type FROM ex WHERE NOT is_deleted UNION ALL SELECT nw.key, coalesce(t.top, 0) + seq, sheet_type FROM nw LEFT JOIN (SELECT key, max(version) AS top FROM ex WHERE NOT is_deleted GROUP BY 1) t ON t.key = nw.key)"""
ORACLES = {
    "a1_validation_summary": f"WITH {_CH} SELECT doc_id, " + ", ".join(f"count(*) FILTER (status = 'FAIL' AND severity = '{x}') AS fail_{x.lower()}" for x in k.SEVERITIES) + ", count(*) FILTER (status = 'WARNING') AS warnings, count(*) FILTER (status IN ('FAIL', 'WARNING') AND auto_fixable) AS auto_fixable, count(*) FILTER (status IN ('FAIL', 'WARNING') AND NOT auto_fixable) AS manual, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS overall FROM ch GROUP BY 1",
    "a2_retained_score": f"WITH {_CH}, {_KEPT}, t AS (SELECT doc_id, coalesce(round_even((sum(round(k * 100)::INT) / nullif(count(k), 0)::DOUBLE)::DECIMAL(18, 8), 0), 100)::INT AS overall, count(k) AS scored_checks FROM kept GROUP BY 1) SELECT *, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 75 THEN 'Good' WHEN overall >= 60 THEN 'Needs work' ELSE 'Poor' END AS band FROM t",
    "a2_retained_by_category": f"WITH {_CH}, {_KEPT} SELECT doc_id, category, round_even((sum(round(k * 100)::INT) / nullif(count(k), 0)::DOUBLE)::DECIMAL(18, 8), 0)::INT AS score FROM kept WHERE k IS NOT NULL GROUP BY 1, 2",
    "a3_weighted_score": f"WITH {_CH}, w AS (SELECT doc_id, sum(CASE WHEN status = 'PASS' THEN {_W} ELSE 0 END) AS p, sum(CASE WHEN status = 'FAIL' THEN {_W} ELSE 0 END) AS f, sum(CASE WHEN status = 'NOT_EVALUATED' THEN {_W} ELSE 0 END) AS m, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, 0::BIGINT AS manual_pending, count(*) FILTER (status = 'NOT_EVALUATED') AS not_evaluated, bool_or(status = 'FAIL' AND severity IN ('HIGH', 'CRITICAL')) AS hi, bool_or(status = 'FAIL' AND severity = 'MEDIUM') AS me, bool_or(status = 'FAIL') AS an FROM ch GROUP BY 1) SELECT doc_id, CASE WHEN p + f > 0 THEN round_even((100 * p / (p + f)::DOUBLE)::DECIMAL(18, 8), 1)::DOUBLE END AS score, CASE WHEN p + f + m > 0 THEN round_even((100 * (p + f) / (p + f + m)::DOUBLE)::DECIMAL(18, 8), 1)::DOUBLE ELSE 0 END AS coverage, CASE WHEN p + f = 0 THEN 'unavailable' WHEN not_evaluated > 0 THEN 'partial' ELSE 'complete' END AS score_status, CASE WHEN hi THEN 'HIGH' WHEN me THEN 'MEDIUM' WHEN an THEN 'LOW' WHEN p + f = 0 THEN 'UNKNOWN' ELSE 'NONE_DETECTED' END AS risk_level, passed, failed, manual_pending, not_evaluated FROM w",
    "a4_dashboard_kpis": f"WITH {_CH} SELECT doc_id, round_even((sum(CASE WHEN status = 'PASS' THEN {_W} ELSE 0 END) / sum({_W})::DOUBLE * 100)::DECIMAL(18, 8), 0)::INT AS accessibility_score, coalesce(round_even((avg((status = 'PASS')::INT) FILTER (rule_id IN ('click0', 'view1', 'purchase2', 'login3')) * 100)::DECIMAL(18, 8), 0), 100)::INT AS pdfua_compliance, count(*) FILTER (severity = 'CRITICAL' AND status IN ('FAIL', 'WARNING')) AS critical_issues, CASE WHEN bool_or(status = 'FAIL' AND severity = 'CRITICAL') THEN 'High' WHEN bool_or(status = 'FAIL' AND severity = 'HIGH') THEN 'Medium' WHEN bool_or(status = 'FAIL') THEN 'Low' ELSE 'None' END AS wcag_risk FROM ch GROUP BY 1",
    "a5_result_summary": f"WITH {_CH}, r AS (SELECT doc_id, rule_id, bool_or(status = 'FAIL') AS d, bool_or(status = 'WARNING') AS r, bool_or(status = 'INFO') AS f FROM ch GROUP BY 1, 2), t AS (SELECT doc_id, count(*) FILTER (d)::INT AS n_detected, count(*) FILTER (d AND NOT (r OR f))::INT AS fixed, count(*) FILTER (d AND (r OR f))::INT AS not_fixed, count(*) FILTER (r)::INT AS n_remaining FROM r WHERE d OR r OR f GROUP BY 1) SELECT *, CASE WHEN n_detected = 0 THEN CASE WHEN n_remaining = 0 THEN 'NO_ISSUES' ELSE 'NEW_ISSUES' END WHEN not_fixed = 0 THEN 'ALL_FIXED' WHEN fixed > 0 THEN 'PARTIALLY_FIXED' ELSE 'NOT_FIXED' END AS status FROM t",
    "a6_severity_distribution": f"WITH {_CH} SELECT s.severity, count(ch.doc_id) AS failed, coalesce(sum(affected_count), 0)::BIGINT AS occurrences FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity) LEFT JOIN ch ON ch.severity = s.severity AND status = 'FAIL' GROUP BY 1",
    "a9_page_scan_score": "WITH f AS (SELECT user_id * 1000 + dayofyear(ts) AS page_id, event_type, event_id % 3 AS sel, CASE WHEN event_id % 8 = 0 THEN 'CRITICAL' WHEN event_id % 12 = 0 THEN 'SERIOUS' WHEN event_id % 5 = 0 THEN 'MODERATE' ELSE 'MINOR' END AS severity FROM events), o AS (SELECT page_id, event_type, sel, max(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'SERIOUS' THEN 10 WHEN 'MODERATE' THEN 5 ELSE 2 END) AS p, bool_or(severity IN ('CRITICAL', 'SERIOUS')) AS g FROM f GROUP BY 1, 2, 3) SELECT page_id, greatest(0, 100 - sum(p))::DOUBLE AS score, CASE WHEN bool_or(g) THEN 'FAIL' ELSE 'WARNING' END AS status FROM o GROUP BY 1",
    "a14_llm_cost": "SELECT e.event_type AS model, count(*) AS executions, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 300)::BIGINT AS output_tokens, round_even(sum((event_id % 1000) / 1e6 * i + (event_id % 300) / 1e6 * o)::DECIMAL(18, 12), 6)::DOUBLE AS cost FROM events e LEFT JOIN (VALUES ('click', 2.5::DOUBLE, 10.0::DOUBLE), ('view', 0.15, 0.6), ('purchase', 3.0, 15.0)) p(m, i, o) ON m = event_type GROUP BY 1",
    "a15_message_tokens": "SELECT conv_id, count(*) AS messages, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END + 4)::BIGINT AS tokens FROM conversations GROUP BY 1",
    "a16_review_rollup": "WITH c AS (SELECT l_orderkey AS unit, l_partkey % 14 AS h FROM lineitem) SELECT unit, count(*) AS chapters, sum(h)::BIGINT AS hits, count(*) FILTER (h = 0) AS zero_hit, round_even(avg(CASE WHEN h <= 0 THEN NULL WHEN h <= 2 THEN 2 WHEN h <= 5 THEN 3 WHEN h <= 9 THEN 4 ELSE 5 END)::DECIMAL(18, 8), 1)::DOUBLE AS mean_weight FROM c GROUP BY 1",
    "a19_savings_ledger": "WITH r AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS billed FROM events GROUP BY 1) SELECT *, total - billed AS avoided, round_even(((total - billed) * 100 / total::DOUBLE)::DECIMAL(18, 8), 1)::DOUBLE AS avoided_pct FROM r",
    "j6_remediation_outcome": f"WITH {_CH}, {_FL} SELECT doc_id, agent, rule_id, CASE WHEN was = 'PASS' THEN 'no_issue' WHEN status = 'PASS' THEN 'fixed' WHEN NOT fixable THEN 'manual_review_required' ELSE 'failed_to_fix' END AS outcome FROM both_",
    "j6_agent_status": f"WITH {_CH}, {_FL} SELECT doc_id, agent, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS status FROM both_ GROUP BY 1, 2",
    "w14_cap_findings": f"WITH {_CH} SELECT doc_id, rule_id, location, count(*) OVER (PARTITION BY doc_id, rule_id) AS affected_count FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY location) <= 2",
    "w5_issue_lifecycle": """WITH e AS (SELECT user_id AS page_id, date_diff('day', DATE '1970-01-01', ts::DATE) * 4 + hour(ts) // 6 AS scan_id, event_type AS rule_code, (event_id % 3)::VARCHAR AS element_selector, 'm' || event_id AS message FROM events),
 s AS (SELECT DISTINCT page_id, scan_id FROM e WHERE scan_id % 7 <> 0), o AS (SELECT *, row_number() OVER w AS o, lead(scan_id) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY page_id ORDER BY scan_id)), t AS (SELECT page_id, max(o) AS top FROM o GROUP BY 1),
 f AS (SELECT page_id, rule_code, element_selector, scan_id, o, nxt, max(message) AS message FROM e JOIN o USING (page_id, scan_id) GROUP BY ALL), i AS (SELECT page_id, rule_code, element_selector, count(*) AS times_seen, min(scan_id) AS first_scan, max(scan_id) AS last_scan, min(o) AS lo, max(o) AS hi, arg_max(message, o) AS message FROM f GROUP BY 1, 2, 3)
 SELECT i.page_id, rule_code, element_selector, times_seen, first_scan, last_scan, CASE WHEN hi < top THEN 'RESOLVED' WHEN hi - lo + 1 > times_seen THEN 'REOPENED' ELSE 'OPEN' END AS status, CASE WHEN hi < top THEN n.scan_id END AS resolved_scan, message FROM i JOIN t USING (page_id) LEFT JOIN o n ON n.page_id = i.page_id AND n.o = i.hi + 1""",
    "f1_page": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_partkey LIMIT 25 OFFSET 10",
    "f1_page_total": "SELECT count(*) AS total FROM customer WHERE contains(lower(c_name), '1')",
    "f2_prefix_filter": "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000000')",
    "f3_active_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 40 OFFSET 5",
    "f4_optional_filters": "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "j2_feature_status": "WITH m AS (SELECT l_partkey AS feature_id, max(l_linenumber % 2) AS status FROM lineitem WHERE l_suppkey % 10 = 3 GROUP BY 1) SELECT p_partkey AS feature_id, CASE WHEN (SELECT count(*) FROM m) = 0 THEN 1 ELSE coalesce(status, 0) END AS status FROM part LEFT JOIN m ON feature_id = p_partkey",
    "j5_mapping_diff": "WITH e AS (SELECT DISTINCT l_partkey AS a FROM lineitem WHERE l_linenumber = 1), w AS (SELECT DISTINCT l_partkey AS b FROM lineitem WHERE l_linenumber = 2) SELECT coalesce(a, b) AS l_partkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'kept' END AS change FROM e FULL JOIN w ON a = b",
    "j11_child_counts": "SELECT c_custkey, count(o_orderkey) AS n_children, count(o_orderkey) = 0 AS deletable FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "w1_latest_version": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "w2_append_versions": f"WITH {_VERS} SELECT key, version::INT AS version, sheet_type, CASE WHEN lead(version) OVER (PARTITION BY key, sheet_type ORDER BY version) IS NULL THEN 'current' ELSE 'superseded' END AS status FROM al",
    "k3_history": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 100 OFFSET 20",
    "u1_distinct_pairs": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "u2_collect_findings": f"WITH {_CH} SELECT doc_id, rule_id, NULL::BIGINT AS location FROM ch WHERE status = 'FAIL' UNION ALL SELECT doc_id, rule_id, location FROM ch WHERE status = 'WARNING'",
    "u3_added_removed": f"WITH {_CH}, e AS (SELECT DISTINCT doc_id, rule_id, 1 AS e FROM ch WHERE status = 'FAIL'), w AS (SELECT DISTINCT doc_id, rule_id, 1 AS w FROM ch WHERE status = 'PASS') SELECT doc_id, rule_id, CASE WHEN e IS NULL THEN 'added' WHEN w IS NULL THEN 'removed' ELSE 'kept' END AS change FROM e FULL JOIN w USING (doc_id, rule_id)",
}
