"""Queries on guardrails and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as e
from ..operators import guard as g
from ..operators import prep
from ..sources.tables import table
from .prep import STRIP
from .text import WORDS, docs


def turns(s, d):
    """conversations with a request_id."""
    return table(s, d, "conversations").withColumn("request_id", F.concat_ws("-", "conv_id", "turn"))


def requests(s, d):
    """User turns as prompts, with the answer of the next turn as output."""
    t = table(s, d, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(said, ["conv_id", "turn"], "left").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "prompt", "output")


def responses(s, d):
    return requests(s, d).where("output is not null").select("request_id", F.col("output").alias("response"), F.lit(None).cast("string").alias("reference"), F.col("prompt").alias("context"))


def chunks(s, d):
    return prep.chunk_paragraph(docs(s, d)).withColumn("heading", F.lit(None).cast("string"))


def long_checks(s, d):
    """Checks derived from events: a rule per type, status and severity by number."""
    n = F.col("event_id")
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("request_id"), F.col("event_type").alias("rule"),
        F.when(n % 5 < 2, "PASS").when(n % 5 == 2, "WARNING").otherwise("FAIL").alias("status"), F.when(n % 7 < 4, "LOW").when(n % 7 < 6, "MEDIUM").otherwise("HIGH").alias("severity"),
    )


TERMS = ["the", "mit", "loser", "idiot", "stupid", "worthless", "hate"]
QUERIES = {
    "g1_pii": lambda s, d: g.pii(docs(s, d), "text", "doc_id"),
    "g2_prompt_injection": lambda s, d: g.prompt_injection(turns(s, d), "text", "request_id"),
    "g3_malformed": lambda s, d: g.malformed(turns(s, d), "text", "request_id", 100),
    "g4_input_checks": lambda s, d: g.input_checks(docs(s, d), "text", "doc_id", 5000),
    "g5_listed_terms": lambda s, d: g.listed_terms(docs(s, d), "text", "doc_id", TERMS),
    "g6_required_sections": lambda s, d: g.required_sections(docs(s, d), "text", "doc_id", ["The", "License", "und"], 4000),
    "g7_json_shape": lambda s, d: g.json_shape(table(s, d, "events"), "props", "event_id", ["k", "v"]),
    "g8_output_length": lambda s, d: g.output_length(docs(s, d), "text", "doc_id", 100, 5000, 50, 1000),
    "g9_chapter_requirement": lambda s, d: g.chapter_requirement(docs(s, d), "text", "doc_id", "the", r"(?i)^(?:#{1,6}\s+.*|the\s+\w+.*)$"),
    "g10_sanitize_prompts": lambda s, d: g.sanitize_prompts(turns(s, d), "text", "request_id", 200),
    "g11_clean_outputs": lambda s, d: g.clean_outputs(table(s, d, "events").select("event_id", F.concat(F.lit("Here is:\n"), "props").alias("said")), "said", "event_id")[0],
    "g12_risk": lambda s, d: g.risk(long_checks(s, d)),
    "g13_guardrail_run": lambda s, d: g.guardrail_run(requests(s, d)).drop("modified_prompt"),
    "e1_evaluate_chunks": lambda s, d: e.evaluate_chunks(chunks(s, d)),
    "e3_evaluate_responses": lambda s, d: e.evaluate_responses(responses(s, d), "request_id"),
    "e5_evaluate_prompts": lambda s, d: e.evaluate_prompts(turns(s, d), "text", "request_id"),
    "e6_score_card": lambda s, d: e.score_card(e.evaluate_responses(responses(s, d), "request_id"), "request_id"),
}
_RID = "conv_id || '-' || turn AS request_id"
_REQ = """req AS (SELECT a.conv_id || '-' || a.turn AS request_id, a.text AS prompt, b.text AS output FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"""


def _hits(patterns, column="text"):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN '{p}' END" for p in patterns) + "], lambda x: x IS NOT NULL)"


_PII = g.PII_PATTERNS


def _contain(a, b):
    return f"CASE WHEN len(regexp_extract_all(lower({a}), '[a-z0-9]+')) = 0 THEN 1.0 ELSE round_even(len(list_filter(regexp_extract_all(lower({a}), '[a-z0-9]+'), lambda w: list_contains(regexp_extract_all(lower({b}), '[a-z0-9]+'), w))) / len(regexp_extract_all(lower({a}), '[a-z0-9]+'))::DOUBLE, 4) END"


def _long(module, key, source, scores):
    parts = [f"SELECT {key}, '{n}' AS name, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c})::DOUBLE)), 4)::DOUBLE AS score FROM {source}" for n, c in scores.items()]
    return f"SELECT '{module}' AS module, {key}, name, score, 0.7::DOUBLE AS threshold, 1.0::DOUBLE AS weight, score >= 0.7 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


_RESP = f"WITH {_REQ}, r AS (SELECT request_id, output AS response, prompt AS context FROM req WHERE output IS NOT NULL) "
_RESP_SCORES = {"completeness": f"len({WORDS.format('response')}) / 50.0::DOUBLE", "consistency": "1.0", "faithfulness": f"CASE WHEN context = '' THEN 1.0 ELSE {_contain('response', 'context')} END", "structure": r"CASE WHEN " + STRIP.format("response") + r" = '' THEN 0.0 WHEN regexp_matches(response, '(^|\n)\s*(#{1,6}\s|[-*]\s|\d+\.\s)') OR contains(response, chr(10) || chr(10)) THEN 1.0 ELSE 0.5 END"}
_TOKENS = f"CASE WHEN {STRIP.format('text')} = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END::BIGINT"
_OPEN = "(length(text) - length(replace(text, '{}', '')))"
ORACLES = {
    "g1_pii": "WITH c AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::INT AS n_{k}" for k, p in _PII.items()) + " FROM documents) SELECT *, CASE WHEN n_email + n_phone + n_ssn + n_credit_card > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN n_email + n_phone + n_ssn + n_credit_card > 0 THEN 'HIGH' END AS severity FROM c",
    "g2_prompt_injection": f"WITH h AS (SELECT {_RID}, {_hits(g.INJECTION_PATTERNS)} AS a, {_hits(g.UNSAFE_PATTERNS)} AS b FROM conversations) SELECT request_id, len(a)::INT AS n_injection, len(b)::INT AS n_unsafe, coalesce(array_to_string(list_concat(a, b), ' | '), '') AS patterns, CASE WHEN len(b) > 0 THEN 'CRITICAL' WHEN len(a) > 0 THEN 'HIGH' END AS severity FROM h",
    "g3_malformed": f"WITH t AS (SELECT {_RID}, {STRIP.format('text')} = '' AS blank, {_OPEN.format('{')} <> {_OPEN.format('}')} OR {_OPEN.format('[')} <> {_OPEN.format(']')} AS uneven, {_TOKENS} AS tokens FROM conversations) SELECT request_id, CASE WHEN blank THEN 'FAIL' WHEN uneven THEN 'WARNING' ELSE 'PASS' END AS form_status, CASE WHEN blank THEN 'HIGH' WHEN uneven THEN 'MEDIUM' END AS form_severity, tokens, CASE WHEN tokens > 100 THEN 'FAIL' ELSE 'PASS' END AS token_status FROM t",
    "g4_input_checks": f"SELECT doc_id, {STRIP.format('text')} = '' AS is_empty, length(text) > 5000 AS is_large, regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') OR contains(text, chr(65533)) AS is_garbled, 0 AS n_unsupported FROM documents",
    "g5_listed_terms": "WITH f AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])') THEN '{t}' END" for t in sorted(TERMS)) + "], lambda x: x IS NOT NULL) AS found FROM documents) SELECT doc_id, len(found)::INT AS n_terms, coalesce(array_to_string(found, ','), '') AS terms FROM f",
    "g6_required_sections": f"SELECT doc_id, coalesce(array_to_string(list_filter(['The', 'License', 'und'], lambda n: NOT contains(lower(text), lower(n))), ','), '') AS missing, CASE WHEN {STRIP.format('text')} = '' OR length(text) > 4000 THEN 'FAIL' ELSE 'PASS' END AS format_status FROM documents",
    "g7_json_shape": "SELECT event_id, json_valid(props) AS is_json, json_type(props) = 'OBJECT' AS is_object, coalesce(array_to_string(list_filter(['k', 'v'], lambda k: NOT list_contains(json_keys(props), k)), ','), '') AS missing FROM events",
    "g8_output_length": f"SELECT doc_id, (length(text) < 100)::INT + ({_TOKENS} < 50)::INT AS n_short, (length(text) > 5000)::INT + ({_TOKENS} > 1000)::INT AS n_long FROM documents",
    "g9_chapter_requirement": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), h AS (SELECT *, regexp_matches(line, '(?i)^(?:#{1,6}\s+.*|the\s+\w+.*)$') AS head FROM l),
 c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM h), g AS (SELECT doc_id, chapter, bool_or(NOT head AND contains(lower(line), 'the')) AS ok FROM c WHERE chapter > 0 GROUP BY 1, 2)
 SELECT doc_id, chapter::BIGINT AS chapter, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM g UNION ALL SELECT doc_id, 0, 'WARNING' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)""",
    "g12_risk": """WITH k AS (SELECT user_id::VARCHAR AS request_id, event_type AS rule, CASE WHEN event_id % 5 < 2 THEN 'PASS' WHEN event_id % 5 = 2 THEN 'WARNING' ELSE 'FAIL' END AS status, CASE WHEN event_id % 7 < 4 THEN 15 WHEN event_id % 7 < 6 THEN 40 ELSE 75 END AS p FROM events),
 c AS (SELECT request_id, rule, max(CASE status WHEN 'PASS' THEN 0 WHEN 'WARNING' THEN round_even(p * 0.35, 0) ELSE p END)::INT AS points FROM k GROUP BY 1, 2), r AS (SELECT request_id, round_even((1 - product(1 - points / 100::DOUBLE)) * 100, 0)::INT AS overall_risk FROM c GROUP BY 1)
 SELECT *, CASE WHEN overall_risk >= 90 THEN 'CRITICAL' WHEN overall_risk >= 70 THEN 'HIGH' WHEN overall_risk >= 40 THEN 'MEDIUM' WHEN overall_risk > 0 THEN 'LOW' ELSE 'NONE' END AS level, CASE WHEN overall_risk >= 70 THEN 'BLOCK' WHEN overall_risk >= 40 THEN 'REVIEW' ELSE 'ALLOW' END AS decision FROM r""",
    "g13_guardrail_run": f"""WITH {_REQ}, f AS (SELECT request_id, list_filter([CASE WHEN regexp_matches(concat_ws(chr(10), nullif(prompt, ''), nullif(output, '')), '{"|".join(_PII.values())}') THEN 'PII' END,
 CASE WHEN {STRIP.format('prompt')} = '' THEN 'empty_prompt' END, CASE WHEN regexp_matches(prompt, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') OR contains(prompt, chr(65533)) THEN 'encoding' END, CASE WHEN {STRIP.format('output')} = '' THEN 'formatting' END,
 CASE WHEN regexp_matches(prompt, '(?i){"|".join(g.INJECTION_PATTERNS)}') THEN 'prompt_injection' END, CASE WHEN length(prompt) > 100000 THEN 'prompt_size' END, CASE WHEN regexp_matches(lower(output), '\\b(?:abuse|hate|kill|violence)\\b') THEN 'toxic_content' END,
 CASE WHEN regexp_matches(prompt, '(?i){"|".join(g.UNSAFE_PATTERNS)}') THEN 'unsafe_instructions' END], lambda x: x IS NOT NULL) AS r FROM req),
 k AS (SELECT *, round_even((1 - list_reduce(list_concat([1.0::DOUBLE], list_transform(r, lambda x: CASE x WHEN 'unsafe_instructions' THEN 0.0::DOUBLE WHEN 'prompt_size' THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END)), lambda a, b: a * b)) * 100, 0)::INT AS overall_risk FROM f)
 SELECT request_id, len(r)::INT AS n_violations, 0 AS n_warnings, coalesce(array_to_string(r, ','), '') AS rules, overall_risk, CASE WHEN overall_risk >= 90 THEN 'CRITICAL' WHEN overall_risk >= 70 THEN 'HIGH' WHEN overall_risk >= 40 THEN 'MEDIUM' WHEN overall_risk > 0 THEN 'LOW' ELSE 'NONE' END AS level,
  CASE WHEN overall_risk >= 70 THEN 'BLOCK' WHEN overall_risk >= 40 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, overall_risk < 70 AS allowed FROM k""",
    "e1_evaluate_chunks": f"WITH c AS (SELECT doc_id, {STRIP.format('text')} AS text FROM documents WHERE {STRIP.format('text')} <> ''), r AS (SELECT doc_id, greatest(1, ceil(length(text) / 4)) AS size, regexp_matches(text, '[.!?\"”]$')::INT AS clean FROM c) "
    + _long("CHUNKING", "doc_id", "r", {"average_size": "1 - abs(size - 512) / 512::DOUBLE", "heading_preservation": "0", "semantic_boundaries": "clean"}),
    "e3_evaluate_responses": _RESP + _long("LLM", "request_id", "r", _RESP_SCORES),
    "e5_evaluate_prompts": f"WITH r AS (SELECT {_RID}, text, {_TOKENS} AS tokens FROM conversations) " + _long("PROMPT", "request_id", "r", {"prompt_completeness": f"len({WORDS.format('text')}) / 20.0::DOUBLE", "variable_usage": r"CASE WHEN regexp_matches(text, '\{\s*(\w+)\s*\}') THEN 1.0 ELSE 0.6 END", "token_efficiency": "CASE WHEN tokens <= 400 THEN 1.0 ELSE 400 / tokens::DOUBLE END"}),
    "e6_score_card": _RESP + ", m AS (" + _long("LLM", "request_id", "r", _RESP_SCORES) + ") SELECT request_id, round_even(avg(score) FILTER (name = 'faithfulness'), 4)::DOUBLE AS accuracy, round_even(avg(score) FILTER (name = 'completeness'), 4)::DOUBLE AS completeness, round_even(avg(score) FILTER (name = 'consistency'), 4)::DOUBLE AS consistency, round_even(avg(score)::DECIMAL(18, 8), 4)::DOUBLE AS overall FROM m GROUP BY 1",
}
