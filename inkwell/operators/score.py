"""Roll-ups of check tables: summaries, scores, remediation outcomes and reports.

checks: doc_id, agent, rule_id, category, severity, status, auto_fixable, internal_check, affected_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import beside

#: Fixed values
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
RETAINED = {
    ("WARNING", "LOW"): 0.90, ("WARNING", "MEDIUM"): 0.75, ("WARNING", "HIGH"): 0.60, ("WARNING", "CRITICAL"): 0.50,
    ("FAIL", "LOW"): 0.60, ("FAIL", "MEDIUM"): 0.35, ("FAIL", "HIGH"): 0.15, ("FAIL", "CRITICAL"): 0.00,
}
SEVERITY_WEIGHT = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
PAGE_PENALTY = {"CRITICAL": 15, "SERIOUS": 10, "MODERATE": 5, "MINOR": 2}
PDFUA_RULES = ["DOC_PDFUA_DECLARATION", "DOC_IS_TAGGED", "DOC_HAS_LANGUAGE", "DOC_HAS_TITLE", "HDR-001", "HDR-003", "HDR-005"]
MANUAL_PENDING = ["MANUAL", "NOT_TESTED"]
#: Of a catalogue, which becomes a constant of the query.
MAX_RULES = 5000


def by_value(c: Column, values: dict, otherwise) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()], F.lit(otherwise))


def severity_rank(c: Column) -> Column:
    """0 for the gravest."""
    return by_value(c, {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def validation_summary(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, FAIL counts per severity, warnings, auto_fixable, manual, overall FAIL > WARNING > PASS."""
    failed, warned = F.col("status") == "FAIL", F.col("status") == "WARNING"
    open_ = failed | warned
    rows = checks.groupBy(key).agg(
        *[F.count_if(failed & (F.col("severity") == s)).alias(f"fail_{s.lower()}") for s in SEVERITIES], F.count_if(warned).alias("warnings"),
        F.count_if(open_ & F.col("auto_fixable")).alias("auto_fixable"), F.count_if(open_ & ~F.col("auto_fixable")).alias("manual"), F.bool_or(failed).alias("f"), F.bool_or(warned).alias("w"),
    )
    return rows.withColumn("overall", F.when(F.col("f"), "FAIL").when(F.col("w"), "WARNING").otherwise("PASS")).drop("f", "w")


def retained_fraction() -> Column:
    """Share of a check's worth that is retained; null for advisory ones."""
    pairs = [F.when((F.col("status") == st) & (F.coalesce("severity", F.lit("MEDIUM")) == sv), F.lit(v)) for (st, sv), v in RETAINED.items()]
    return F.when(F.col("internal_check") | F.coalesce(F.col("status"), F.lit("")).isin("INFO", ""), None).when(F.col("status") == "PASS", 1.0).otherwise(F.coalesce(*pairs, F.lit(0.5)))


def retained_score(checks: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, overall, band, scored_checks), and (key, category, score)."""
    # fractions have two decimals, so sums of hundredths are exact
    rows = checks.withColumn("kept", F.bround(retained_fraction() * 100).cast("int"))
    overall = F.coalesce(F.bround(F.try_divide(F.sum("kept"), F.count("kept"))), F.lit(100.0)).cast("int")
    total = rows.groupBy(key).agg(overall.alias("overall"), F.count("kept").alias("scored_checks"))
    o = F.col("overall")
    total = total.withColumn("band", F.when(o >= 90, "Excellent").when(o >= 75, "Good").when(o >= 60, "Needs work").otherwise("Poor"))
    category = F.coalesce(F.nullif(F.btrim("category"), F.lit("")), F.lit("General"))
    return total, rows.where(F.col("kept").isNotNull()).groupBy(key, category.alias("category")).agg(F.bround(F.sum("kept") / F.count("kept")).cast("int").alias("score"))


def weighted_score(checks: DataFrame, key: str = "doc_id", weights: dict[str, int] | None = None) -> DataFrame:
    """key, score (100 x weight passed / evaluated, null if nothing was), coverage, score_status, risk_level, counts."""
    weight = by_value(F.col("severity"), weights or SEVERITY_WEIGHT, 1)
    of = lambda s: F.sum(F.when(F.col("status") == s, weight).otherwise(0))
    failed = F.col("status") == "FAIL"
    rows = checks.groupBy(key).agg(
        of("PASS").alias("p"), of("FAIL").alias("f"), of("NOT_EVALUATED").alias("m"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(failed).alias("failed"),
        F.count_if(F.col("status").isin(MANUAL_PENDING)).alias("manual_pending"), F.count_if(F.col("status") == "NOT_EVALUATED").alias("not_evaluated"),
        F.collect_set(F.when(failed, F.col("severity"))).alias("s"),
    )
    p, f, m = F.col("p"), F.col("f"), F.col("m")
    has = lambda *v: F.arrays_overlap("s", F.array(*[F.lit(x) for x in v]))
    score = F.when(p + f > 0, F.bround(100 * p / F.nullif(p + f, F.lit(0)), 1))
    return rows.select(
        key, score.alias("score"), F.when(p + f + m > 0, F.bround(100 * (p + f) / F.nullif(p + f + m, F.lit(0)), 1)).otherwise(0.0).alias("coverage"),
        F.when(p + f == 0, "unavailable").when(F.col("not_evaluated") > 0, "partial").otherwise("complete").alias("score_status"),
        F.when(has("CRITICAL", "HIGH"), "HIGH").when(has("MEDIUM"), "MEDIUM").when(F.size("s") > 0, "LOW").when(p + f == 0, "UNKNOWN").otherwise("NONE_DETECTED").alias("risk_level"),
        "passed", "failed", "manual_pending", "not_evaluated",
    )


def dashboard_kpis(checks: DataFrame, key: str = "doc_id", pdfua_rules: list[str] | None = None) -> DataFrame:
    """key, accessibility_score, pdfua_compliance, wcag_risk, critical_issues."""
    weight = by_value(F.coalesce("severity", F.lit("LOW")), SEVERITY_WEIGHT, 1)
    passed, failed, mine = F.col("status") == "PASS", F.col("status") == "FAIL", F.col("rule_id").isin(pdfua_rules or PDFUA_RULES)
    rank = F.min(F.when(failed, severity_rank(F.coalesce("severity", F.lit("LOW")))))
    # 100 times a whole number is exact, and so is a half after the division: 23 of 40 is 57.5, where 23 / 40 * 100 is less
    percent = lambda part, whole: F.coalesce(F.bround(F.try_divide(100 * part, whole)), F.lit(100.0)).cast("int")
    rows = checks.groupBy(key).agg(
        percent(F.sum(F.when(passed, weight).otherwise(0)), F.sum(weight)).alias("accessibility_score"), percent(F.count_if(mine & passed), F.count(F.when(mine, passed))).alias("pdfua_compliance"), rank.alias("r"),
        F.count_if((F.col("severity") == "CRITICAL") & F.col("status").isin("FAIL", "WARNING")).alias("critical_issues"),
    )
    r = F.col("r")
    return rows.withColumn("wcag_risk", F.when(r == 0, "High").when(r == 1, "Medium").when(r <= 3, "Low").otherwise("None")).drop("r")


def result_summary(detected: DataFrame, remaining: DataFrame, failed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_detected, fixed, not_fixed, n_remaining, status: from sets of rule ids.

    Fixed rules were detected and neither remain nor failed to be fixed.
    """
    sets = lambda df, name: df.groupBy(key).agg(F.collect_set("rule_id").alias(name))
    rows = sets(detected, "d").join(sets(remaining, "r"), key, "full_outer").join(sets(failed, "f"), key, "full_outer")
    empty = F.array().cast("array<string>")
    rows = rows.select(key, *[F.coalesce(c, empty).alias(c) for c in "drf"])
    fixed, unfixed = F.array_except("d", F.array_union("r", "f")), F.array_intersect("d", F.array_union("r", "f"))
    rows = rows.select(key, F.size("d").alias("n_detected"), F.size(fixed).alias("fixed"), F.size(unfixed).alias("not_fixed"), F.size("r").alias("n_remaining"))
    status = F.when(F.col("n_detected") == 0, F.when(F.col("n_remaining") == 0, "NO_ISSUES").otherwise("NEW_ISSUES")).when(F.col("not_fixed") == 0, "ALL_FIXED").when(F.col("fixed") > 0, "PARTIALLY_FIXED").otherwise("NOT_FIXED")
    return rows.withColumn("status", status)


def severity_distribution(checks: DataFrame) -> DataFrame:
    """severity, failed, occurrences; a row for every severity."""
    dim = checks.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counted = checks.where("status = 'FAIL'").groupBy("severity").agg(F.count("*").alias("failed"), F.sum("affected_count").alias("occurrences"))
    return dim.join(counted, "severity", "left").fillna(0)


def recommendations(checks: DataFrame, findings: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    """Failed rules by severity, count and id: key, position, rule_id, severity, affected_count, locations (first n)."""
    first = Window.partitionBy(key, "rule_id").orderBy("location")
    some = findings.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n).groupBy(key, "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "location"))), lambda x: x.location).alias("locations"))
    order = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), F.desc("affected_count"), "rule_id")
    return checks.where("status = 'FAIL'").join(some, [key, "rule_id"], "left").select(key, F.row_number().over(order).alias("position"), "rule_id", "severity", "affected_count", "locations")


def lint_summary(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, total, auto_fixable, by_severity and by_category maps."""
    def counts(by: str) -> DataFrame:
        return findings.groupBy(key, by).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col("n").alias("v"))))).alias(f"by_{by}"))

    return findings.groupBy(key).agg(F.count("*").alias("total"), F.count_if("auto_fixable").alias("auto_fixable")).join(counts("severity"), key).join(counts("category"), key)


def page_scan_score(findings: DataFrame, key: str = "page_id") -> DataFrame:
    """key, score (100 less penalties, not below 0), status; a finding counts once per rule and selector."""
    once = findings.groupBy(key, "rule_code", "element_selector").agg(F.max(by_value(F.col("severity"), PAGE_PENALTY, 5)).alias("penalty"), F.max(F.when(F.col("severity").isin("CRITICAL", "SERIOUS"), 2).otherwise(1)).alias("grave"))
    rows = once.groupBy(key).agg(F.greatest(F.lit(0), 100 - F.sum("penalty")).cast("decimal(5,2)").alias("score"), F.max("grave").alias("g"))
    return rows.select(key, "score", F.when(F.col("g") == 2, "FAIL").otherwise("WARNING").alias("status"))


def crawl_status(crawls: DataFrame, scans: DataFrame) -> DataFrame:
    """crawl_id, n_scans, status: RUNNING > QUEUED > all COMPLETED > PARTIAL; without scans COMPLETED."""
    s = F.col("status")
    rows = scans.groupBy("crawl_id").agg(F.count("*").alias("n"), F.bool_or(s == "RUNNING").alias("r"), F.bool_or(s == "QUEUED").alias("q"), F.every(s == "COMPLETED").alias("c"))
    status = F.when(F.col("n").isNull() | F.col("c"), "COMPLETED").when(F.col("r"), "RUNNING").when(F.col("q"), "QUEUED").otherwise("PARTIAL")
    return crawls.select("crawl_id").join(rows, "crawl_id", "left").select("crawl_id", F.coalesce("n", F.lit(0)).alias("n_scans"), status.alias("status"))


def crawl_report(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """crawl_id, position, page_id, url, issues (nested, by rule and selector), in discovery order."""
    nested = issues.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rule_code", "element_selector", "status"))).alias("issues"))
    order = Window.partitionBy("crawl_id").orderBy("discovered", "page_id")
    return pages.join(nested, "page_id", "left").select("crawl_id", F.row_number().over(order).alias("position"), "page_id", "url", F.coalesce("issues", F.array().cast(nested.schema["issues"].dataType)).alias("issues"))


def llm_cost(executions: DataFrame, pricing: DataFrame) -> DataFrame:
    """model, executions, input and output tokens, cost (null if the model has no price)."""
    rows = executions.join(beside(pricing), "model", "left")
    cost = F.col("input_tokens") / 1e6 * F.col("input_rate") + F.col("output_tokens") / 1e6 * F.col("output_rate")
    return rows.groupBy("model").agg(F.count("*").alias("executions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bround(F.sum(cost), 6).alias("cost"))


def message_tokens(turns: DataFrame) -> DataFrame:
    """conv_id, messages, tokens: a token for four characters (at least 1, 0 if empty) and four per message."""
    size = F.length(F.coalesce("text", F.lit("")))
    own = F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(size / 4)))
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(own + 4).alias("tokens"))


def review_band(hits: Column) -> Column:
    """Advisory weight of a chapter by its hits; none without."""
    return F.when(hits <= 0, None).when(hits <= 2, 2).when(hits <= 5, 3).when(hits <= 9, 4).otherwise(5)


def review_rollup(chapters: DataFrame) -> DataFrame:
    """unit, chapters, hits, zero_hit, mean_weight (1 dp) of chapters (unit, pyq_hits)."""
    return chapters.groupBy("unit").agg(F.count("*").alias("chapters"), F.sum("pyq_hits").alias("hits"), F.count_if(F.col("pyq_hits") == 0).alias("zero_hit"), F.bround(F.avg(review_band(F.col("pyq_hits"))), 1).alias("mean_weight"))


def review_counts(chapters: DataFrame, key: str = "project_id") -> DataFrame:
    """key, rows, kept, dropped, weighted, retitled of typed review chapters."""
    kept = F.col("kept")
    return chapters.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_if(kept & F.col("weight").isNotNull()).alias("weighted"), F.count_if(kept & F.col("retitled")).alias("retitled"))


def savings_ledger(resolutions: DataFrame, key: str) -> DataFrame:
    """key, total, billed, avoided, avoided_pct of resolutions (key, route); the route 'model' is billed."""
    billed = F.count_if(F.col("route") == "model")
    rows = resolutions.groupBy(key).agg(F.count("*").alias("total"), billed.alias("billed"))
    return rows.withColumn("avoided", F.col("total") - F.col("billed")).withColumn("avoided_pct", F.coalesce(F.bround(F.try_divide(F.col("avoided") * 100, "total"), 1), F.lit(0.0)))


def processing_summary(runs: DataFrame, tables: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """key and the number of rows of each table, 0 where there is none."""
    out = runs.select(key)
    for name, df in tables.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(tables))


def group_into_units(chapters: DataFrame, key: str = "project_id") -> DataFrame:
    """key, unit_no, unit_number, unit, chapters (nested in order), units in order of first appearance."""
    units = chapters.groupBy(key, "unit_number", "unit").agg(F.min("position").alias("first"), F.array_sort(F.collect_list(F.struct("position", "chapter"))).alias("chapters"))
    return units.withColumn("unit_no", F.row_number().over(Window.partitionBy(key).orderBy("first"))).drop("first")


def remediation_outcome(before: DataFrame, after: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, agent, rule_id, outcome) and (key, agent, status): what became of each rule, and the worst status left."""
    b = before.select(key, "agent", "rule_id", F.col("status").alias("was"), F.col("auto_fixable").alias("fixable"))
    rows = after.select(key, "agent", "rule_id", "status", "auto_fixable").join(b, [key, "agent", "rule_id"], "left")
    was, fixable = F.coalesce("was", F.lit("PASS")), F.coalesce("fixable", "auto_fixable")
    outcome = F.when(was == "PASS", "no_issue").when(F.col("status") == "PASS", "fixed").when(~fixable, "manual_review_required").otherwise("failed_to_fix")
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0))
    return rows.select(key, "agent", "rule_id", outcome.alias("outcome")), rows.groupBy(key, "agent").agg(worst.alias("w")).select(key, "agent", F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "WARNING").otherwise("PASS").alias("status"))


def cap_findings(findings: DataFrame, n: int = 100, order: str = "location", key: str = "doc_id") -> DataFrame:
    """At most n findings per document and rule, with the exact affected_count."""
    group = Window.partitionBy(key, "rule_id")
    return findings.withColumn("affected_count", F.count("*").over(group)).withColumn("r", F.row_number().over(group.orderBy(order))).where(F.col("r") <= n).drop("r")


def executed_checks_coverage(checks: DataFrame, catalog: DataFrame, key: str = "doc_id", also: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, analyzer, rule_id, status; NOT_EVALUATED where no verdict is), and (key, analyzer, state).

    Columns of checks that are named in ``also`` come with the former, null where no verdict is. Only the names of a document's
    rules are shuffled, to find those without a verdict.
    """
    enabled = catalog.where("enabled").select("rule_id", "analyzer").limit(MAX_RULES + 1).collect()
    if len(enabled) > MAX_RULES:
        raise ValueError(f"a catalogue of more than {MAX_RULES} enabled rules")
    # a constant of bounded size
    rules = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.analyzer).alias("analyzer")) for r in enabled]).cast("array<struct<rule_id:string,analyzer:string>>")
    listed = F.broadcast(checks.sparkSession.range(1).select(F.inline(rules)))
    status = F.coalesce("status", F.lit("NOT_EVALUATED")).alias("status")
    present = checks.join(listed, "rule_id").select(key, "analyzer", "rule_id", status, *(also or []))
    names = F.array_distinct(F.transform(rules, lambda r: r.rule_id))
    absent = checks.groupBy(key).agg(F.collect_set("rule_id").alias("_seen")).select(key, F.explode(F.array_except(names, "_seen")).alias("rule_id"))
    unknown = [F.lit(None).cast(checks.schema[c].dataType).alias(c) for c in also or []]
    rows = present.union(absent.join(listed, "rule_id").select(key, "analyzer", "rule_id", F.lit("NOT_EVALUATED").alias("status"), *unknown))
    missing = F.col("status") == "NOT_EVALUATED"
    state = F.when(F.every(missing), "FAILED").when(F.bool_or(missing), "PARTIAL").otherwise("COMPLETED")
    return rows, rows.groupBy(key, "analyzer").agg(state.alias("state"))


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.coalesce("page_no", F.lit(0)), severity_rank(F.col("severity")))
