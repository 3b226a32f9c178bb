"""Guardrails: personal data, injection, malformed and oversized prompts, output checks, repair and risk.

A check table has request_id, rule, status (PASS, WARNING, FAIL), severity (LOW..CRITICAL or null) and details.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compacted, estimate_tokens, strip
from .prep import normalize_text

#: Fixed values
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": r"\b\+?\d[\d\s().-]{7,}\d\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
}
INJECTION_PATTERNS = [
    "ignore (all |the )?(previous|above|prior) (instructions|prompt)",
    "disregard (the |all )?(previous|above)",
    "forget (everything|all previous)",
    "you are now",
    "pretend (to be|you are)",
    "developer mode",
    "jailbreak",
    "reveal (your |the )?(system )?prompt",
    "print your instructions",
]
UNSAFE_PATTERNS = [r"\brm\s+-rf\b", r"\bdrop\s+table\b", "delete all", "exfiltrate", "disable (the )?(safety|guardrails)"]
REDACTED_PATTERNS = [
    "ignore (all |the )?(previous|above|prior) (instructions|prompt)",
    "disregard (the |all )?(previous|above)",
    "forget (everything|all previous)",
    "reveal (your |the )?(system )?prompt",
    "developer mode",
    "jailbreak",
]
TOXIC_TERMS = ["abuse", "hate", "kill", "violence"]
SEVERITY_POINTS = {"LOW": 15, "MEDIUM": 40, "HIGH": 75, "CRITICAL": 100}
ALLOWED_FILES = ["pdf", "docx", "txt", "md", "epub"]
CHAPTER = r"(?i)^(?:#{1,6}\s+.*|chapter\s+\w+.*)$"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hits(text: Column, patterns: list[str]) -> Column:
    """The patterns found in a text, in the order given."""
    return compacted(*[F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns])


def pii(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, one count per kind, status, severity."""
    counts = [F.regexp_count(_text(column), F.lit(p)).alias(f"n_{k}") for k, p in PII_PATTERNS.items()]
    found = sum(F.col(f"n_{k}") for k in PII_PATTERNS) > 0
    return df.select(key, *counts).withColumns({"status": F.when(found, "FAIL").otherwise("PASS"), "severity": F.when(found, "HIGH")})


def prompt_injection(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, n_injection, n_unsafe, patterns, severity (CRITICAL for unsafe ones)."""
    text = _text(column)
    rows = df.select(key, hits(text, INJECTION_PATTERNS).alias("a"), hits(text, UNSAFE_PATTERNS).alias("b"))
    return rows.select(key, F.size("a").alias("n_injection"), F.size("b").alias("n_unsafe"), F.array_join(F.concat("a", "b"), " | ").alias("patterns"), F.when(F.size("b") > 0, "CRITICAL").when(F.size("a") > 0, "HIGH").alias("severity"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def malformed(df: DataFrame, column: str, key: str, max_tokens: int = 8000) -> DataFrame:
    """key, form_status, form_severity, tokens, token_status."""
    text = _text(column)
    blank = F.length(strip(text)) == 0
    uneven = (_count(text, "{") != _count(text, "}")) | (_count(text, "[") != _count(text, "]"))
    tokens = estimate_tokens(text)
    return df.select(key, F.when(blank, "FAIL").when(uneven, "WARNING").otherwise("PASS").alias("form_status"), F.when(blank, "HIGH").when(uneven, "MEDIUM").alias("form_severity"), tokens.alias("tokens"), F.when(tokens > max_tokens, "FAIL").otherwise("PASS").alias("token_status"))


def unsupported_files(files: Column, allowed: list[str] | None = None) -> Column:
    ext = lambda f: F.when(F.contains(f, F.lit(".")), F.lower(F.substring_index(f, ".", -1))).otherwise("")
    return F.filter(files, lambda f: ~ext(f).isin(allowed or ALLOWED_FILES))


def input_checks(df: DataFrame, column: str, key: str, max_chars: int = 100_000, files: str | None = None) -> DataFrame:
    """key, is_empty, is_large, is_garbled (control or replacement characters), n_unsupported."""
    text = _text(column)
    bad_files = F.size(unsupported_files(F.col(files))) if files else F.lit(0)
    return df.select(key, (F.length(strip(text)) == 0).alias("is_empty"), (F.length(text) > max_chars).alias("is_large"), text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffd]").alias("is_garbled"), bad_files.alias("n_unsupported"))


def listed_terms(df: DataFrame, column: str, key: str, terms: list[str] | None = None) -> DataFrame:
    """key, n_terms, terms: whole-word hits of the terms, sorted."""
    low = F.lower(_text(column))
    found = compacted(*[F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){t}(?![\p{{L}}\p{{N}}_])"), F.lit(t)) for t in sorted(terms or TOXIC_TERMS)])
    return df.select(key, found.alias("found")).select(key, F.size("found").alias("n_terms"), F.array_join("found", ",").alias("terms"))


def required_sections(df: DataFrame, column: str, key: str, names: list[str], max_length: int | None = None) -> DataFrame:
    """key, missing (section names not in the text), format_status."""
    low = F.lower(_text(column))
    missing = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.contains(low, F.lower(n)))
    bad = (F.length(strip(low)) == 0) | (F.length(low) > (max_length or 2**31 - 1))
    return df.select(key, F.array_join(missing, ",").alias("missing"), F.when(bad, "FAIL").otherwise("PASS").alias("format_status"))


def json_shape(df: DataFrame, column: str, key: str, keys: list[str]) -> DataFrame:
    """key, is_json, is_object, missing."""
    parsed = F.try_parse_json(F.col(column))
    own = F.json_object_keys(column)
    rows = df.select(key, parsed.isNotNull().alias("is_json"), own.alias("own"))
    return rows.select(key, "is_json", F.col("own").isNotNull().alias("is_object"), F.when(F.col("own").isNotNull(), F.array_join(F.array_except(F.array(*[F.lit(k) for k in keys]), "own"), ",")).alias("missing"))


def output_length(df: DataFrame, column: str, key: str, min_chars: int | None = None, max_chars: int | None = None, min_tokens: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """key, n_short, n_long: bounds that a text misses."""
    size, tokens = F.length(_text(column)), estimate_tokens(_text(column))
    short = [(v < b).cast("int") for v, b in ((size, min_chars), (tokens, min_tokens)) if b is not None]
    long = [(v > b).cast("int") for v, b in ((size, max_chars), (tokens, max_tokens)) if b is not None]
    return df.select(key, sum(short, F.lit(0)).alias("n_short"), sum(long, F.lit(0)).alias("n_long"))


def chapter_requirement(df: DataFrame, column: str, key: str, phrase: str = "Learning Objectives", heading: str = CHAPTER) -> DataFrame:
    """key, chapter (from 1), status: whether each chapter's body holds the phrase; chapter 0 and WARNING if there is none."""
    from pyspark.sql.window import Window

    lines = df.select(key, F.posexplode(F.split(_text(column), "\n")).alias("at", "line")).withColumn("head", F.col("line").rlike(heading))
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("chapter", F.sum(F.col("head").cast("int")).over(order))
    inside = F.bool_or(~F.col("head") & F.contains(F.lower("line"), F.lit(phrase.lower())))
    chapters = lines.where("chapter > 0").groupBy(key, "chapter").agg(F.when(inside, "PASS").otherwise("FAIL").alias("status"))
    none = df.select(key).join(chapters.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("chapter"), F.lit("WARNING").alias("status"))
    return chapters.unionByName(none)


def sanitize_prompts(df: DataFrame, column: str, key: str, max_chars: int | None = None) -> DataFrame:
    """key, sanitized, changed: normalised, injection phrases replaced, cut."""
    rows = normalize_text(df.select(key, F.col(column).alias("before"), _text(column).alias("text")))
    text = F.col("text")
    for p in REDACTED_PATTERNS:
        text = F.regexp_replace(text, "(?i)" + p, "[filtered]")
    text = strip(text)
    if max_chars is not None:
        text = F.regexp_replace(F.left(text, F.lit(max_chars)), r"\s+$", "")
    return rows.select(key, text.alias("sanitized"), (~text.eqNullSafe(F.col("before"))).alias("changed"))


def _literal(text: pd.Series) -> pd.Series:
    def parse(t):
        try:
            return json.dumps(ast.literal_eval(t))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return text.map(parse, na_action="ignore")


def clean_outputs(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, cleaned, parsed JSON text or null), and the quarantined rows that no repair parses.

    Cleaning strips a preamble line, a code fence and wrapping quotes. Repair tries the text itself, the fenced part, the
    part between the outermost brackets and that without trailing commas; what remains may still be a literal.
    """
    text = strip(_text(column))
    fenced = F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    body = F.regexp_replace(body, r"(?i)^(?:sure|certainly|of course|here(?:'s| is| are))[^\n]*:\s*\n", "")
    cleaned = F.regexp_replace(strip(body), "(?s)^([\"'])(.*)\\1$", "$2")
    bracketed = F.regexp_extract(text, r"(?s)[\[{].*[\]}]", 0)
    candidates = F.array(text, fenced, bracketed, F.regexp_replace(bracketed, r",\s*([\]}])", "$1"))
    good = F.get(F.filter(candidates, lambda c: (c != "") & F.try_parse_json(c).isNotNull()), F.lit(0))
    rows = df.select(key, cleaned.alias("cleaned"), good.alias("json"), bracketed.alias("bracketed"))
    done = rows.where(F.col("json").isNotNull()).select(key, "cleaned", F.col("json").alias("parsed"))
    rest = rows.where(F.col("json").isNull()).select(key, "cleaned", F.when(F.col("bracketed") != "", F.pandas_udf(_literal, "string")("bracketed")).alias("parsed"))
    return done.unionByName(rest.where(F.col("parsed").isNotNull())), rest.where(F.col("parsed").isNull()).drop("parsed")


def contribution(weights: dict[str, float] | None = None) -> Column:
    """Risk points of a check: by severity, less for a warning, none for a pass."""
    points = F.coalesce(*[F.when(F.col("severity") == s, p) for s, p in SEVERITY_POINTS.items()], F.lit(40)).cast("double")
    for rule, w in (weights or {}).items():
        points = F.when(F.col("rule") == rule, points * w).otherwise(points)
    points = F.when(F.col("status") == "PASS", 0.0).when(F.col("status") == "WARNING", points * 0.35).otherwise(points)
    return F.bround(F.least(points, F.lit(100.0))).cast("int")


def risk(checks: DataFrame, key: str = "request_id", weights: dict[str, float] | None = None, block: int = 70, review: int = 40) -> DataFrame:
    """key, overall_risk, level, decision: the largest risk of each rule, combined as independent chances."""
    by_rule = checks.groupBy(key, "rule").agg(F.max(contribution(weights)).alias("points"), F.bool_or((F.col("status") == "FAIL") & F.coalesce(F.col("severity") == "CRITICAL", F.lit(False))).alias("critical"))
    rows = by_rule.groupBy(key).agg(F.product(1 - F.col("points") / 100).alias("safe"), F.bool_or("critical").alias("critical")).withColumn("overall_risk", F.bround((1 - F.col("safe")) * 100).cast("int"))
    r = F.col("overall_risk")
    return rows.select(
        key, "overall_risk", F.when(r >= 90, "CRITICAL").when(r >= 70, "HIGH").when(r >= 40, "MEDIUM").when(r > 0, "LOW").otherwise("NONE").alias("level"),
        F.when(F.col("critical") | (r >= block), "BLOCK").when(r >= review, "REVIEW").otherwise("ALLOW").alias("decision"),
    )


#: Named policies: functions from requests (request_id, prompt, output) to an array column of checks.
POLICIES: dict[str, Callable[[], Column]] = {}


def register_policy(name: str, policy: Callable[[], Column]) -> None:
    POLICIES[name] = policy


def check(rule: str, bad: Column, severity: str, status: str = "FAIL") -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.when(bad, status).otherwise("PASS").alias("status"), F.when(bad, severity).alias("severity"))


def _pii_policy() -> Column:
    both = F.concat_ws("\n", F.nullif(F.col("prompt"), F.lit("")), F.nullif(F.col("output"), F.lit("")))
    return F.array(check("PII", both.rlike("|".join(PII_PATTERNS.values())), "HIGH"))


def _injection_policy() -> Column:
    text = _text("prompt")
    return F.array(check("prompt_injection", text.rlike("(?i)" + "|".join(INJECTION_PATTERNS)), "HIGH"), check("unsafe_instructions", text.rlike("(?i)" + "|".join(UNSAFE_PATTERNS)), "CRITICAL"))


register_policy("pii", _pii_policy)
register_policy("prompt_injection", _injection_policy)


def load_policies(config: list[dict]) -> list[str]:
    """Names of the policies of a configuration; an unknown one is an error."""
    names = [c["type"] for c in config]
    unknown = sorted(set(names) - set(POLICIES))
    if unknown:
        raise ValueError(f"unknown policies: {unknown}")
    return names


def request_checks(requests: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """requests with ``checks``: an array of (rule, status, severity), all checks of a request in its own row."""
    prompt, output = _text("prompt"), _text("output")
    asked, answered = F.col("prompt").isNotNull(), F.col("output").isNotNull()
    empty = F.array().cast("array<struct<rule:string,status:string,severity:string>>")
    on_input = F.array(check("empty_prompt", F.length(strip(prompt)) == 0, "HIGH"), check("prompt_size", F.length(prompt) > 100_000, "MEDIUM"), check("encoding", prompt.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffd]"), "HIGH"))
    low = F.lower(output)
    on_output = F.array(check("toxic_content", low.rlike(r"\b(?:" + "|".join(TOXIC_TERMS) + r")\b"), "HIGH"), check("publisher_rules", F.lit(False), "MEDIUM"), check("formatting", F.length(strip(output)) == 0, "HIGH"))
    chosen = [POLICIES[p]() for p in policies or ["pii", "prompt_injection"]]
    return requests.withColumn("checks", F.concat(F.when(asked, on_input).otherwise(empty), *chosen, F.when(answered, on_output).otherwise(empty)))


def risk_of_checks(checks: Column) -> Column:
    """overall_risk, decision inputs of an array of checks whose rules are distinct, without leaving the row."""
    points = lambda c: F.when(c.status == "PASS", 0).otherwise(F.coalesce(*[F.when(c.severity == s, p) for s, p in SEVERITY_POINTS.items()], F.lit(40)))
    safe = F.aggregate(checks, F.lit(1.0).cast("double"), lambda a, c: a * (1 - points(c) / 100))
    return F.bround((1 - safe) * 100).cast("int")


def guardrail_rows(requests: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """request_id, n_violations, n_warnings, rules, overall_risk, level, decision, allowed; one row per request, no shuffle."""
    rows = request_checks(requests, policies).withColumn("overall_risk", risk_of_checks(F.col("checks")))
    failed = F.filter("checks", lambda c: c.status == "FAIL")
    critical = F.exists(failed, lambda c: c.severity == "CRITICAL")
    r = F.col("overall_risk")
    decision = F.when(critical | (r >= 70), "BLOCK").when(r >= 40, "REVIEW").otherwise("ALLOW")
    return rows.select(
        "request_id", F.size(failed).alias("n_violations"), F.size(F.filter("checks", lambda c: c.status == "WARNING")).alias("n_warnings"), F.array_join(F.array_sort(F.transform(failed, lambda c: c.rule)), ",").alias("rules"),
        "overall_risk", F.when(r >= 90, "CRITICAL").when(r >= 70, "HIGH").when(r >= 40, "MEDIUM").when(r > 0, "LOW").otherwise("NONE").alias("level"), decision.alias("decision"), (decision != "BLOCK").alias("allowed"),
    )


def guardrail_run(requests: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """guardrail_rows() with the sanitised prompt where it differs."""
    clean = sanitize_prompts(requests.where(F.col("prompt").isNotNull()), "prompt", "request_id").where("changed").select("request_id", F.col("sanitized").alias("modified_prompt"))
    return guardrail_rows(requests, policies).join(clean, "request_id", "left")
