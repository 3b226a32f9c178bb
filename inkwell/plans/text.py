"""Queries on manuscripts and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manuscript as m
from ..sources.tables import table

TEMPLATE = ["The", "and", "einen", "introduction"]
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
PARAS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal, regexp_replace(line, '^\s+|\s+$', '', 'g') AS paragraph
           FROM lines WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 50)"""
PAIRS = (
    PARAS
    + r""",
 sets AS (SELECT doc_id, ordinal, list_distinct("""
    + WORDS.format("lower(paragraph)")
    + r""") AS w FROM paras),
 bo AS (SELECT a.doc_id, a.ordinal AS i, b.ordinal AS j, len(a.w) AS x, len(b.w) AS y, len(list_intersect(a.w, b.w)) AS c
          FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.ordinal < b.ordinal),
 pairs AS (SELECT doc_id, i, j, c / (x + y - c)::DOUBLE AS similarity FROM bo)"""
)
FACTS = (
    PAIRS
    + """,
 facts AS (SELECT d.doc_id, length(d.text) > 0 AS has_text, coalesce(p.n, 0) AS n, coalesce(s.pair_sum, 0) AS pair_sum, coalesce(s.n_pairs, 0) AS n_pairs, coalesce(s.n_flagged, 0) AS n_flagged
           FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM paras GROUP BY 1) p USING (doc_id)
           LEFT JOIN (SELECT doc_id, sum(similarity) AS pair_sum, count(*) AS n_pairs, count(*) FILTER (similarity > 0.75) AS n_flagged FROM pairs GROUP BY 1) s USING (doc_id)),
 orig AS (SELECT doc_id, CASE WHEN NOT has_text THEN 0.0::DOUBLE WHEN n < 2 THEN 1.0::DOUBLE ELSE round_even(1 - pair_sum / (n_pairs + n), 2)::DOUBLE END AS originality_score, n_flagged FROM facts),
 redu AS (SELECT doc_id, CASE WHEN n_pairs > 0 THEN round_even(pair_sum / n_pairs, 2)::DOUBLE ELSE 0.0::DOUBLE END AS redundancy_score, n_flagged AS n_duplicates FROM facts)"""
)
AI = (
    r"""ai0 AS (SELECT doc_id, length(text) > 0 AS has_text, list_transform(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''), lambda s: len("""
    + WORDS.format("s")
    + ")) AS l, "
    + WORDS.format("text")
    + r""" AS w FROM documents),
 ai1 AS (SELECT doc_id, has_text, len(l) AS sentences, len(l) <= 1 OR list_aggregate(l, 'stddev_pop') < 5 AS even, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END AS diversity FROM ai0),
 ai2 AS (SELECT *, diversity < 0.5 AS poor, (1 - diversity) > 0.5 AS repeated FROM ai1),
 ai3 AS (SELECT *, least(1.0, (CASE WHEN even THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN poor THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN repeated THEN 0.4::DOUBLE ELSE 0 END)) AS score FROM ai2),
 ai AS (SELECT doc_id, sentences, round_even(score, 2)::DOUBLE AS ai_likelihood_score,
   CASE WHEN score > 0.75 THEN 'High AI Generation Likely' WHEN score > 0.5 THEN 'Moderate AI Assistance Likely' ELSE 'Likely Human-Written' END AS classification,
   array_to_string(list_filter([CASE WHEN poor THEN 'Low lexical diversity' END, CASE WHEN even THEN 'Low sentence variation' END, CASE WHEN repeated THEN 'Repetitive phrasing' END], lambda x: x IS NOT NULL), '; ') AS signals,
   round_even(least(1.0, score + 0.1), 2)::DOUBLE AS confidence FROM ai3)"""
)
SECTIONS = (
    r"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE length(text) > 0),
 l1 AS (SELECT *, CASE WHEN contains(lower(line), 'introduction') THEN 'Introduction' WHEN contains(lower(line), 'conclusion') THEN 'Conclusion' END AS marker FROM l0),
 l2 AS (SELECT *, sum(CASE WHEN marker IS NULL THEN 0 ELSE 1 END) OVER w AS part, coalesce(last_value(marker IGNORE NULLS) OVER w, 'General') AS section FROM l1
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 l3 AS (SELECT doc_id, section, part, count(*) AS lines, sum(len("""
    + WORDS.format("line")
    + r"""))::BIGINT AS words, bool_or(contains(lower(line), 'in conclusion')) AS in_conclusion FROM l2 GROUP BY 1, 2, 3),
 l4 AS (SELECT doc_id, section, lines, words, in_conclusion FROM l3 QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY part DESC) = 1),
 secs AS (SELECT * FROM l4 UNION ALL SELECT doc_id, 'General', 0, 0, false FROM l4 GROUP BY doc_id HAVING NOT bool_or(section = 'General'))"""
)
EDITORIAL = (
    SECTIONS
    + r""",
 e0 AS (SELECT doc_id, count(*) AS n, max(words) FILTER (section = 'Introduction') AS intro, max(words) FILTER (section = 'Conclusion') AS fin, bool_or(in_conclusion) FILTER (section = 'Conclusion') AS said FROM secs GROUP BY 1),
 e1 AS (SELECT d.doc_id, e0.*, (length(lower(text)) - length(replace(lower(text), 'in today''s world', ''))) / 16 + (length(lower(text)) - length(replace(lower(text), 'it is important to note', ''))) / 23
          + (length(lower(text)) - length(replace(lower(text), 'this highlights', ''))) / 15 > 3 AS generic FROM documents d JOIN e0 USING (doc_id)),
 e2 AS (SELECT doc_id, list_filter([CASE WHEN intro < 50 THEN 'Weak introduction' END, CASE WHEN fin IS NOT NULL AND NOT said AND fin < 50 THEN 'Weak conclusion' END, CASE WHEN n < 3 THEN 'Poor structure' END, CASE WHEN generic THEN 'Generic writing style' END], lambda x: x IS NOT NULL) AS i,
   list_filter([CASE WHEN intro >= 50 THEN 'Introduction provides context' END, CASE WHEN fin IS NOT NULL AND NOT (NOT said AND fin < 50) THEN 'Conclusion summarizes key ideas' END, CASE WHEN NOT generic THEN 'Content shows some specificity' END], lambda x: x IS NOT NULL) AS s FROM e1),
 edi AS (SELECT doc_id, CASE WHEN len(i) > 3 THEN 'Needs Major Editing' WHEN len(i) > 1 THEN 'Needs Structural Editing' ELSE 'Ready for Copyediting' END AS readiness_status, len(i)::INT AS n_issues,
   coalesce(array_to_string(i, '; '), '') AS issues, coalesce(array_to_string(s, '; '), '') AS strengths FROM e2)"""
)
_NAMES = "[" + ", ".join(f"'{t}'" for t in TEMPLATE) + "]"
STRUCTURE = f"""s0 AS (SELECT doc_id, list_filter({_NAMES}, lambda s: contains(lower(text), lower(s))) AS found FROM documents),
 struct_ AS (SELECT doc_id, round_even(least(1.0, len(found) / 4.0::DOUBLE * 100 / 100 * 0.7::DOUBLE + 0.3::DOUBLE), 2)::DOUBLE AS structure_score, coalesce(array_to_string(found, ', '), '') AS sections_found,
   coalesce(array_to_string(list_filter({_NAMES}, lambda s: NOT list_contains(found, s)), ', '), '') AS sections_missing, true AS order_correct, round_even(len(found) / 4.0::DOUBLE * 100, 2)::DOUBLE AS completeness_percentage FROM s0)"""
BAND = "CASE WHEN s >= 85 THEN {} WHEN s >= 65 THEN {} WHEN s >= 45 THEN {} ELSE {} END"
REPORT_COLUMNS = ["doc_id", "originality_score", "ai_likelihood_score", "readiness_status", "structure_score", "redundancy_score", "submission_score", "readiness_label", "editing_effort", "estimated_hours", "recommended_action"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = docs(spark, sf_dir)
    paras = m.sized_paragraphs(corpus)
    return corpus, paras, m.pair_totals(paras)


def t4_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.external_matches(m.paragraphs(docs(spark, sf_dir)), table(spark, sf_dir, "benchmark"), above=0.2)
    return found.withColumn("containment", F.round("containment", 6))


QUERIES = {
    "t1_paragraphs": lambda s, d: m.paragraphs(docs(s, d)),
    "t2_pair_similarity": lambda s, d: m.pair_similarity(m.sized_paragraphs(docs(s, d))).withColumn("similarity", F.round("similarity", 9)),
    "t3_originality": lambda s, d: m.originality(*_pairs(s, d)),
    "t4_external_matches": t4_external,
    "t5_redundancy": lambda s, d: m.redundancy(*_pairs(s, d)),
    "t6_terminology": lambda s, d: m.terminology_issues(docs(s, d), [*m.TERM_GROUPS, ["the", "that", "with"]]),
    "t7_ai_authorship": lambda s, d: m.ai_authorship(docs(s, d)),
    "t8_sections": lambda s, d: m.sections(docs(s, d)),
    "t9_editorial": lambda s, d: m.editorial(docs(s, d)),
    "t10_structure": lambda s, d: m.structure(docs(s, d), TEMPLATE),
    "t12_manuscript_report": lambda s, d: m.manuscript_report(docs(s, d), TEMPLATE).select(*REPORT_COLUMNS),
}
_TERMS = [*m.TERM_GROUPS, ["the", "that", "with"]]
ORACLES = {
    "t1_paragraphs": f"WITH {PARAS} SELECT doc_id, ordinal, paragraph FROM paras",
    "t2_pair_similarity": f"WITH {PAIRS} SELECT doc_id, i, j, round(similarity, 9) AS similarity FROM pairs",
    "t3_originality": f"WITH {FACTS} SELECT doc_id, originality_score, CASE WHEN originality_score > 0.8 THEN 'Low' WHEN originality_score > 0.5 THEN 'Moderate' ELSE 'High' END AS risk_level, n_flagged FROM orig",
    "t4_external_matches": f"""WITH {PARAS},
 pw AS (SELECT item_id, {WORDS.format("lower(text)")} AS w FROM benchmark), ps AS (SELECT item_id, list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS r FROM pw WHERE len(w) >= 5),
 pe AS (SELECT item_id, len(r) AS n, unnest(r) AS run FROM ps),
 ow AS (SELECT doc_id, ordinal, {WORDS.format("lower(paragraph)")} AS w FROM paras), oe AS (SELECT doc_id, ordinal, unnest(list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) AS run FROM ow WHERE len(w) >= 5),
 sh AS (SELECT doc_id, ordinal, item_id, count(*) / any_value(n)::DOUBLE AS containment FROM oe JOIN pe USING (run) GROUP BY 1, 2, 3)
 SELECT doc_id, ordinal, item_id, round(containment, 6) AS containment FROM sh WHERE containment > 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY containment DESC, item_id) = 1""",
    "t5_redundancy": f"WITH {FACTS} SELECT doc_id, redundancy_score, n_duplicates FROM redu",
    "t6_terminology": "WITH f AS (SELECT doc_id, list_filter(["
    + ", ".join("CASE WHEN len(list_filter({0}, lambda t: contains(lower(text), t))) > 1 THEN 'Inconsistent usage: ' || array_to_string(list_filter({0}, lambda t: contains(lower(text), t)), ', ') END".format("[" + ", ".join(f"'{t}'" for t in g) + "]") for g in _TERMS)
    + "], lambda x: x IS NOT NULL) AS found FROM documents) SELECT doc_id, len(found)::INT AS n_issues, coalesce(array_to_string(found, '; '), '') AS issues FROM f",
    "t7_ai_authorship": f"WITH {AI} SELECT * REPLACE (coalesce(signals, '') AS signals) FROM ai",
    "t8_sections": f"WITH {SECTIONS} SELECT * FROM secs",
    "t9_editorial": f"WITH {EDITORIAL} SELECT * FROM edi",
    "t10_structure": f"WITH {STRUCTURE} SELECT * FROM struct_",
    "t12_manuscript_report": f"""WITH {FACTS}, {AI}, {EDITORIAL}, {STRUCTURE},
 r AS (SELECT *, ((originality_score * 0.25::DOUBLE + (1 - ai_likelihood_score) * 0.15::DOUBLE + (CASE readiness_status WHEN 'Ready for Copyediting' THEN 0.9::DOUBLE WHEN 'Needs Structural Editing' THEN 0.6 WHEN 'Needs Major Editing' THEN 0.3 ELSE 0.5 END) * 0.25::DOUBLE
   + structure_score * 0.20::DOUBLE + (1 - redundancy_score) * 0.15::DOUBLE) * 100) AS raw FROM orig JOIN ai USING (doc_id) JOIN edi USING (doc_id) JOIN struct_ USING (doc_id) JOIN redu USING (doc_id)),
 q AS (SELECT *, trunc(raw)::INT AS s FROM r)
 SELECT doc_id, originality_score, ai_likelihood_score, readiness_status, structure_score, redundancy_score, s AS submission_score, {BAND.format("'Ready for Editing'", "'Needs Minor Revision'", "'Needs Structural Editing'", "'High Risk Submission'")} AS readiness_label,
   {BAND.format("'Low'", "'Medium'", "'High'", "'Very High'")} AS editing_effort, {BAND.format(5, 18, 30, 50)} AS estimated_hours,
   {BAND.format("'Proceed to copyediting'", "'Proceed with copyediting after fixes'", "'Require structural revision before editing'", "'Reject or major rewrite required'")} AS recommended_action FROM q""",
}
