"""Queries on vectors, graphs, web pages and text rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import contrast_ratio, fold_for_match, strip
from ..operators import elements as el
from ..operators import evaluate, graph, prep, vectors, web
from ..sources.shared import beside
from ..sources.tables import table
from .prep import LINES, SENT, STRIP
from .text import WORDS, docs


def store(s, d):
    return table(s, d, "embeddings").select(F.concat(F.lit("n"), F.col("label") % 3).alias("namespace"), F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("source"), F.col("label").cast("string")).alias("metadata"))


def asked(s, d):
    return store(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "namespace", F.col("embedding").alias("query_vector"))


def upserted(s, d):
    v = store(s, d)
    new = v.where("namespace = 'n1'").withColumn("seq", F.col("id")).select("namespace", (F.col("id") + F.col("id") % 2 * 1000).alias("id"), "embedding", "metadata", "seq")
    return vectors.vectors_upsert(v, new).select("namespace", "id", F.size("embedding").alias("n"))


def retrieval(s, d):
    v = store(s, d)
    hits = vectors.vector_top_k(asked(s, d), v).withColumnRenamed("id", "chunk_id")
    labels = table(s, d, "embeddings")
    queries = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("class"))
    return evaluate.evaluate_retrieval(hits, classes=(queries, labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("class"))))


def chapters(s, d):
    t = table(s, d, "embeddings").select(F.col("vec_id").alias("chapter_id"), F.lit("unit").alias("unit"), F.concat(F.lit("t"), "vec_id").alias("title"))
    return vectors.retrieve_for_chapters(t, asked(s, d), store(s, d), 3)


def label_checks(s, d):
    """In how many texts of its source each label stands; texts and labels are folded before they are paired, once each."""
    b = table(s, d, "benchmark").select("item_id", fold_for_match("text").alias("label"), (F.col("item_id") % 20).alias("src"))
    t = docs(s, d).select(F.substring_index("source", "src", -1).cast("int").alias("src"), fold_for_match("text").alias("text"))
    found = t.join(beside(b), "src").where(F.contains("text", "label"))
    return b.join(found.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_sources"))


def links(s, d):
    p = table(s, d, "pages")
    return web.discover_links(p, web.html_elements(p))


def sites(s, d):
    p = table(s, d, "pages").select("page_id", web.host("url").alias("h"))
    return p.select("page_id", "h", web.same_site(F.col("h"), F.lit("example.com")).alias("in_site"))


def backfilled(s, d):
    p = table(s, d, "pages").select((F.col("page_id") % 7).alias("site_id"), "url", "page_id")
    have = p.where("site_id < 4").groupBy("site_id", F.sha2("url", 256).alias("url_hash")).agg(F.min("page_id").alias("page_id"))
    return web.backfill_pages(p, have).groupBy("site_id", "was_created").agg(F.count("*").alias("n"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))


def contrasts(s, d):
    e = table(s, d, "events").select("event_id", F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 6).alias("a"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 7, 6).alias("b"))
    r = contrast_ratio("a", "b")
    return e.select("event_id", F.round(r, 6).alias("ratio"), (F.round(r, 6) >= 4.5).alias("normal_ok"), (F.round(r, 6) >= 3).alias("large_ok"))


QUERIES = {
    "s7_vectors_upsert": upserted,
    "k1_vector_top_k": lambda s, d: vectors.vector_top_k(asked(s, d), store(s, d)).withColumn("score", F.round("score", 6)),
    "k2_retrieve_for_chapters": chapters,
    "a13_embedding_statistics": lambda s, d: vectors.embedding_statistics(store(s, d), ["namespace"]),
    "e2_evaluate_retrieval": retrieval,
    "n2_concepts": lambda s, d: graph.concepts(docs(s, d)),
    "n3_relations": lambda s, d: graph.relations(docs(s, d), graph.entities(docs(s, d))),
    "n4_merge_nodes": lambda s, d: graph.merge_nodes(graph.entities(docs(s, d)), graph.relations(docs(s, d), graph.entities(docs(s, d))))[0].select("doc_id", "pos", "id", "label", F.array_join("aliases", ",").alias("aliases")),
    "n5_graph_issues": lambda s, d: graph.graph_issues(graph.entities(docs(s, d)), graph.relations(docs(s, d), graph.entities(docs(s, d)))),
    "n6_build_graph": lambda s, d: graph.build_graph(docs(s, d))[1],
    "p1_html_elements": lambda s, d: web.html_elements(table(s, d, "pages")).select("page_id", "seq", "tag", F.col("attrs")["href"].alias("href"), "in_label", "text"),
    "p2_page_titles": lambda s, d: web.page_titles(table(s, d, "pages")),
    "p6_discover_links": links,
    "p8_same_site": sites,
    "j7_backfill_pages": backfilled,
    "j9_verify_labels": label_checks,
    "r8_text_lint": lambda s, d: el.text_lint(prep.lines(docs(s, d)).where(strip("line") != ""), "line"),
    "r12_contrast": contrasts,
    "w15_column_layout": lambda s, d: el.column_layout(table(s, d, "events").select(F.col("user_id").alias("page"), F.col("value").alias("x"))),
}
_ST = "st AS (SELECT 'n' || (label % 3) AS namespace, vec_id AS id, embedding, label FROM embeddings), q AS (SELECT id AS query_id, namespace, embedding AS qv FROM st WHERE id % 100 = 0)"
_TOP = "sc AS (SELECT query_id, id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS score FROM st JOIN q USING (namespace)), top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM sc QUALIFY rank <= {})"
_STOP = "[" + ", ".join(f"'{w}'" for w in graph.STOPWORDS) + "]"
_MEMBER = "SELECT '{m}' AS module, query_id, '{n}' AS name, round_even(({c})::DECIMAL(18, 8), 4)::DOUBLE AS score FROM r"
_LETTERED = f"list_filter({WORDS.format('line')}, lambda w: regexp_matches(w, '\\p{{L}}'))"
ORACLES = {
    "r8_text_lint": rf"""WITH {LINES} SELECT doc_id, line_no, line, coalesce(array_to_string(list_filter([CASE WHEN len({_LETTERED}) >= 4 AND len(list_filter({_LETTERED}, lambda w: length(w) = 1)) / len({_LETTERED})::DOUBLE >= 0.5 THEN 'char_spaced' END,
 CASE WHEN length(regexp_replace(line, '[^A-Za-z]', '', 'g')) <= 2 THEN 'too_short' END, CASE WHEN regexp_matches({STRIP.format('line')}, '(?i)^\W*(fig(ure)?|image|graphic|picture|img|pic|table|photo)?\.?\s*\d*\W*$') THEN 'bare_label' END,
 CASE WHEN regexp_matches(line, '(?i)to\s*be\s*described|placeholder|todo|xxx|tbd') THEN 'placeholder' END, CASE WHEN (length(line) - length(replace(line, '. ', ''))) / 2 >= 2 OR len({WORDS.format('line')}) > 20 THEN 'body' END,
 CASE WHEN regexp_matches(line, '^\s*\(?\d+[.)]\s+\S') THEN 'list_item' END], lambda x: x IS NOT NULL), ','), '') AS lint FROM lines WHERE {STRIP.format('line')} <> ''""",
    "s7_vectors_upsert": "WITH st AS (SELECT 'n' || (label % 3) AS namespace, vec_id AS id, len(embedding)::INT AS n FROM embeddings), nw AS (SELECT DISTINCT namespace, id + id % 2 * 1000 AS id, n FROM st WHERE namespace = 'n1') SELECT * FROM st WHERE (namespace, id) NOT IN (SELECT (namespace, id) FROM nw) UNION ALL SELECT * FROM nw",
    "k1_vector_top_k": f"WITH {_ST}, {_TOP.format(5)} SELECT query_id, rank, id, round(score, 6) AS score FROM top",
    "k2_retrieve_for_chapters": f"WITH {_ST}, {_TOP.format(3)}, h AS (SELECT query_id, count(*) AS n, string_agg(top.id::VARCHAR, ',' ORDER BY rank) AS c, list_sort(list_distinct(list(label::VARCHAR))) AS s FROM top JOIN st ON st.id = top.id GROUP BY 1) SELECT vec_id AS chapter_id, 'unit: t' || vec_id AS query, coalesce(n, 0) AS n_hits, coalesce(c, '') AS chunk_ids, coalesce(array_to_string(s, ','), '') AS sources, n IS NOT NULL AS grounded FROM embeddings LEFT JOIN h ON query_id = vec_id",
    "a13_embedding_statistics": "SELECT 'n' || (label % 3) AS namespace, count(*) AS vectors, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) END AS dimension, avg(len(embedding)) AS average_dimension, min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension FROM embeddings GROUP BY 1",
    "e2_evaluate_retrieval": f"WITH {_ST}, {_TOP.format(5)}, r AS (SELECT query_id, count(*) AS k, count(*) FILTER (a.label = b.label) AS good, (SELECT count(*) FROM embeddings x WHERE x.label = any_value(a.label)) AS wanted, count(DISTINCT top.id) AS own FROM top JOIN st b ON b.id = top.id JOIN st a ON a.id = query_id GROUP BY 1), m AS ("
    + " UNION ALL ".join(_MEMBER.format(m="RETRIEVAL", n=n, c=x) for n, x in (("top_k_relevance", "good / k::DOUBLE"), ("duplicate_chunks", "own / k::DOUBLE"), ("missing_chunks", "good / wanted::DOUBLE")))
    + ") SELECT *, 0.7::DOUBLE AS threshold, 1.0::DOUBLE AS weight, score >= 0.7 AS passed FROM m",
    "n2_concepts": f"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]+'), lambda w: regexp_matches(w, '^[a-z]')) AS l FROM documents), u AS (SELECT doc_id, unnest(list_transform(l, lambda w: lower(w))) AS w, generate_subscripts(l, 1) AS i FROM t), f AS (SELECT doc_id, w, min(i) AS i FROM u WHERE length(w) >= 4 AND NOT list_contains({_STOP}, w) GROUP BY 1, 2) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, w AS id, w AS label FROM f",
    "p2_page_titles": f"SELECT page_id, nullif(left(array_to_string({WORDS.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ' '), 500), '') AS title FROM pages",
    "p8_same_site": "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM pages) SELECT page_id, h, h = 'example.com' OR ends_with(h, '.example.com') OR ends_with('example.com', '.' || h) AS in_site FROM h",
    "j7_backfill_pages": "WITH w AS (SELECT DISTINCT page_id % 7 AS site_id, url, sha256(url) AS h FROM pages), e AS (SELECT page_id % 7 AS site_id, sha256(url) AS h, min(page_id) AS page_id FROM pages WHERE page_id % 7 < 4 GROUP BY 1, 2), j AS (SELECT w.*, e.page_id FROM w LEFT JOIN e USING (site_id, h)), n AS (SELECT site_id, page_id IS NULL AS was_created, CASE WHEN page_id IS NULL THEN (SELECT max(page_id) FROM e) + row_number() OVER (PARTITION BY page_id IS NULL ORDER BY site_id, h) ELSE page_id END AS page_id FROM j) SELECT site_id, was_created, count(*) AS n, min(page_id) AS lo, max(page_id) AS hi FROM n GROUP BY 1, 2",
    "j9_verify_labels": r"WITH b AS (SELECT item_id, item_id % 20 AS src, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS label FROM benchmark), t AS (SELECT substring(source, 4)::INT AS src, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents) SELECT item_id, count(t.src) AS n_sources FROM b LEFT JOIN t ON t.src = b.src AND contains(t.t, b.label) GROUP BY 1",
    "r12_contrast": "WITH h AS (SELECT event_id, md5(event_id::VARCHAR) AS m FROM events), c AS (SELECT event_id, list_transform([1, 3, 5, 7, 9, 11], lambda i: ('0x' || substring(m, i, 2))::INT / 255::DOUBLE) AS v FROM h), g AS (SELECT event_id, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92::DOUBLE ELSE pow((x + 0.055) / 1.055, 2.4) END) AS v FROM c), l AS (SELECT event_id, 0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3] AS a, 0.2126 * v[4] + 0.7152 * v[5] + 0.0722 * v[6] AS b FROM g), r AS (SELECT event_id, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio FROM l) SELECT *, ratio >= 4.5 AS normal_ok, ratio >= 3 AS large_ok FROM r",
    "w15_column_layout": "WITH b AS (SELECT user_id AS page, value AS x FROM events), r AS (SELECT page, min(x) AS lo, max(x) AS hi, count(*) AS n FROM b GROUP BY 1), k AS (SELECT page, least(9, floor(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) * 10 ELSE 0 END))::INT AS bucket, any_value(n) AS n, count(*) AS c FROM b JOIN r USING (page) GROUP BY 1, 2), g AS (SELECT *, bucket - row_number() OVER (PARTITION BY page ORDER BY bucket) AS run FROM k WHERE c >= n * 0.1), u AS (SELECT page, run, any_value(n) AS n, sum(c) AS c FROM g GROUP BY 1, 2), s AS (SELECT page, count(*) FILTER (c >= greatest(3, n * 0.2)) AS columns FROM u GROUP BY 1) SELECT r.page, coalesce(columns, 0) AS columns, coalesce(columns, 0) >= 2 AS multi_column FROM r LEFT JOIN s USING (page)",
}
