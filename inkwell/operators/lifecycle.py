"""Issues of pages across scans: first and last sight, open, resolved or reopened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def issue_lifecycle(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """page_id, rule_code, element_selector, times_seen, first_scan, last_scan, status, resolved_scan, freshest message.

    Only completed scans (page_id, scan_id, status) count, in order of scan_id. Seen in the newest: OPEN if it was never
    missing since its first sight, else REOPENED; not seen in it: RESOLVED in the scan after its last sight.
    """
    done = scans.where("status = 'COMPLETED'")
    order = Window.partitionBy("page_id").orderBy("scan_id")
    ordinals = done.select("page_id", "scan_id", F.row_number().over(order).alias("o"), F.lead("scan_id").over(order).alias("next_scan"))
    newest = ordinals.groupBy("page_id").agg(F.max("o").alias("top"))
    seen = findings.join(ordinals, ["page_id", "scan_id"]).groupBy("page_id", "rule_code", "element_selector", "scan_id", "o", "next_scan").agg(F.max("message").alias("message"))
    issue = seen.groupBy("page_id", "rule_code", "element_selector").agg(
        F.count("*").alias("times_seen"), F.min("scan_id").alias("first_scan"), F.max("scan_id").alias("last_scan"), F.min("o").alias("lo"), F.max("o").alias("hi"),
        F.max_by("next_scan", "o").alias("after"), F.max_by("message", "o").alias("message"),
    )
    last, gap = F.col("hi") == F.col("top"), F.col("hi") - F.col("lo") + 1 > F.col("times_seen")
    return issue.join(newest, "page_id").select(
        "page_id", "rule_code", "element_selector", "times_seen", "first_scan", "last_scan", F.when(last & ~gap, "OPEN").when(last, "REOPENED").otherwise("RESOLVED").alias("status"),
        F.when(~last, F.col("after")).alias("resolved_scan"), "message",
    )


def scan_issues(issues: DataFrame, rules: DataFrame, scan_id: int, status: str | None = None, severity: str | None = None, rule_code: str | None = None) -> DataFrame:
    """Issues first seen or last confirmed by a scan, with their rule's facts."""
    rows = issues_with_rules(issues.where((F.col("first_scan") == scan_id) | (F.col("last_scan") == scan_id)), rules)
    for column, value in (("status", status), ("severity", severity), ("rule_code", rule_code)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def issues_with_rules(issues: DataFrame, rules: DataFrame) -> DataFrame:
    return issues.join(rules, "rule_code")
