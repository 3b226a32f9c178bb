"""Evaluation metrics: scores from 0 to 1 with a threshold of 0.7, in long form, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, estimate_tokens, normalize_label, py_round, strip, word_containment, word_count

THRESHOLD = 0.7
#: Fixed value: the dimension that a metric counts for
DIMENSIONS = {
    "faithfulness": "accuracy", "top_k_relevance": "accuracy", "relationship_quality": "accuracy", "completeness": "completeness", "prompt_completeness": "completeness", "missing_chunks": "completeness",
    "entity_count": "completeness", "consistency": "consistency", "duplicate_chunks": "consistency", "duplicate_nodes": "consistency", "semantic_boundaries": "consistency",
}


def as_metrics(rows: DataFrame, key: str, module: str, scores: dict[str, Column]) -> DataFrame:
    """Long form: module, key, name, score, threshold, weight, passed."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), py_round(clamp(c.cast("double")), 4).alias("score")) for n, c in scores.items()])
    return rows.select(key, F.explode(entries).alias("m")).select(F.lit(module).alias("module"), key, "m.name", "m.score", F.lit(THRESHOLD).alias("threshold"), F.lit(1.0).alias("weight"), (F.col("m.score") >= THRESHOLD).alias("passed"))


def summary(metrics: DataFrame, key: str) -> DataFrame:
    """key, overall_score (weighted mean), passed (all)."""
    return metrics.groupBy("module", key).agg(py_round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 4).alias("overall_score"), F.every("passed").alias("passed"))


def evaluate_chunks(chunks: DataFrame, key: str = "doc_id", target: int = 512) -> DataFrame:
    """Chunks (key, text, heading, estimated_tokens) to average_size, heading_preservation, semantic_boundaries."""
    ends = F.regexp_replace("text", r"\s+$", "").rlike('[.!?"”]$')
    rows = chunks.groupBy(key).agg(F.avg("estimated_tokens").alias("size"), F.avg((F.coalesce("heading", F.lit("")) != "").cast("double")).alias("headed"), F.avg(ends.cast("double")).alias("clean"))
    return as_metrics(rows, key, "CHUNKING", {"average_size": 1 - F.abs(F.col("size") - target) / target, "heading_preservation": F.col("headed"), "semantic_boundaries": F.col("clean")})


def _truth_of_classes(hits: DataFrame, queries: DataFrame, chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(right hits (key, chunk_id), number of right chunks (key, wanted)), without the pairs of every query and chunk of a class."""
    asked, have = queries.select(key, "class").where("class is not null").distinct(), chunks.select("chunk_id", "class").where("class is not null").distinct()
    right = hits.select(key, "chunk_id").distinct().join(asked, key).join(have, ["chunk_id", "class"]).select(key, "chunk_id").distinct()
    one = asked.groupBy(key).agg(F.count("*").alias("n"), F.first("class").alias("class"))
    sizes = have.groupBy("class").agg(F.count("*").alias("wanted"))
    # classes of one query may share chunks, so only the chunks themselves tell how many there are
    several = asked.join(one.where("n > 1").select(key), key).join(have, "class").select(key, "chunk_id").distinct().groupBy(key).agg(F.count("*").alias("wanted"))
    return right, one.where("n = 1").join(sizes, "class").select(key, "wanted").union(several)


def evaluate_retrieval(hits: DataFrame, truth: DataFrame | None = None, key: str = "query_id", classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Hits (key, chunk_id, score) and truth (key, chunk_id) to top_k_relevance, duplicate_chunks, missing_chunks.

    Where the right chunks of a query are those of its class, ``classes`` gives queries (key, class) and chunks (chunk_id, class)
    in place of the pairs.
    """
    if truth is None and classes is None:
        marked = hits.withColumns({"good": F.lit(None).cast("int"), "wanted": F.lit(None).cast("long")})
    else:
        if classes is None:
            right = truth.select(key, "chunk_id").distinct()
            wanted = right.groupBy(key).agg(F.count("*").alias("wanted"))
        else:
            right, wanted = _truth_of_classes(hits, *classes, key)
        marked = hits.join(right.withColumn("good", F.lit(1)), [key, "chunk_id"], "left").join(wanted, key, "left")
    rows = marked.groupBy(key).agg(F.count("*").alias("k"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.max("wanted").alias("wanted"), F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.countDistinct("chunk_id").alias("own"), F.count("chunk_id").alias("named"))
    known = F.col("wanted").isNotNull()
    return as_metrics(rows, key, "RETRIEVAL", {
        "top_k_relevance": F.when(known, F.col("good") / F.col("k")).otherwise(F.col("total") / F.col("k")),
        "duplicate_chunks": F.when(F.col("named") > 0, F.col("own") / F.col("named")).otherwise(1.0),
        "missing_chunks": F.when(known, F.col("good") / F.col("wanted")).otherwise(1.0),
    })


def evaluate_responses(rows: DataFrame, key: str, sections: list[str] | None = None) -> DataFrame:
    """Rows (key, response, reference, context; the last two may be null) to four metrics."""
    text = F.coalesce("response", F.lit(""))
    complete = (sum(F.contains(F.lower(text), F.lit(s.lower())).cast("int") for s in sections) / len(sections)) if sections else word_count(text) / 50.0
    shaped = text.rlike(r"(^|\n)\s*(#{1,6}\s|[-*]\s|\d+\.\s)") | F.contains(text, F.lit("\n\n"))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return as_metrics(rows, key, "LLM", {
        "completeness": complete, "consistency": F.when(given("reference"), word_containment("response", "reference")).otherwise(1.0),
        "faithfulness": F.when(given("context"), word_containment("response", "context")).otherwise(1.0),
        "structure": F.when(F.length(strip(text)) == 0, 0.0).when(shaped, 1.0).otherwise(0.5),
    })


def evaluate_graph(nodes: DataFrame, edges: DataFrame, key: str = "graph_id", expected: int | None = None, min_confidence: float = 0.5) -> DataFrame:
    """Nodes (key, id, label) and edges (key, source, target, confidence) to three metrics."""
    label = normalize_label(F.coalesce("label", "id"))
    named = nodes.withColumn("norm", F.when(label != "", label)).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("norm").alias("own"), F.count("norm").alias("named"))
    ends = nodes.select(key, "id").distinct()
    sound = edges.join(ends.select(key, F.col("id").alias("source"), F.lit(1).alias("s")), [key, "source"], "left").join(ends.select(key, F.col("id").alias("target"), F.lit(1).alias("t")), [key, "target"], "left")
    good = F.col("s").isNotNull() & F.col("t").isNotNull() & (F.col("source") != F.col("target")) & F.coalesce(F.col("confidence") >= min_confidence, F.lit(True))
    rows = named.join(sound.groupBy(key).agg(F.avg(good.cast("double")).alias("quality")), key, "left")
    return as_metrics(rows, key, "KNOWLEDGE_GRAPH", {"entity_count": F.col("n") / expected if expected else F.lit(1.0), "duplicate_nodes": F.when(F.col("named") > 0, F.col("own") / F.col("named")).otherwise(1.0), "relationship_quality": F.coalesce("quality", F.lit(1.0))})


def evaluate_prompts(rows: DataFrame, column: str, key: str, expected: list[str] | None = None, target: int = 400) -> DataFrame:
    text = F.coalesce(F.col(column), F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\s*(\w+)\s*\}"), F.lit(1)))
    used = F.size(F.array_intersect(found, F.array(*[F.lit(e) for e in expected]))) / len(set(expected)) if expected else F.when(F.size(found) > 0, 1.0).otherwise(0.6)
    tokens = estimate_tokens(text)
    return as_metrics(rows, key, "PROMPT", {"prompt_completeness": word_count(text) / 20.0, "variable_usage": used, "token_efficiency": F.when(tokens <= target, 1.0).otherwise(target / tokens)})


def score_card(metrics: DataFrame, key: str) -> DataFrame:
    """key, accuracy, completeness, consistency, overall: means by dimension, null where there is none."""
    mapping = F.create_map(*[F.lit(x) for pair in DIMENSIONS.items() for x in pair])
    rows = metrics.withColumn("dimension", F.get(F.array(mapping[F.col("name")]), F.lit(0)))
    of = lambda d: py_round(F.avg(F.when(F.col("dimension") == d, F.col("score"))), 4).alias(d)
    return rows.groupBy(key).agg(of("accuracy"), of("completeness"), of("consistency"), py_round(F.avg("score"), 4).alias("overall"))


def prompt_variables(templates: DataFrame, variables: DataFrame) -> DataFrame:
    """Findings on templates (template_id, text) and variables (template_id, name, value): missing, null, empty, unused."""
    used = templates.select("template_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\{\s*(\w+)"), F.lit(1)))).alias("name"))
    joined = used.withColumn("used", F.lit(True)).join(variables.withColumn("given", F.lit(True)), ["template_id", "name"], "full_outer")
    problem = F.when(F.col("given").isNull(), "missing").when(F.col("used").isNull(), "unused").when(F.col("value").isNull(), "null").when(strip("value") == "", "empty")
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("template_id", "name", "problem", F.when(F.col("problem").isin("missing", "null"), "ERROR").otherwise("WARNING").alias("level"))
