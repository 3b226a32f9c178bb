"""SQL for queries that fold or match many patterns, and queries on stores, crawls, layouts and templates, with theirs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import elements as el
from ..operators import evaluate, graph, web
from ..operators import guard as g
from ..operators import manuscript as m
from ..operators import prep as p
from ..operators import score as k
from ..sources import files, graphs
from ..sources.shared import Tables, shared_folder
from ..sources.tables import table
from .derived import ORACLES as DERIVED
from .derived import MARKUP
from .families import FRAGMENTS, cte, made
from .more import ORACLES as MORE
from .prep import CONFIG, SENT, STRIP
from .score import items
from .text import WORDS, docs

# --- chunks ---------------------------------------------------------------------------------------------------------

SPLIT = p.ChunkConfig(min_chunk_size=40, max_chunk_size=30 * 4)


def marked_docs(s, d):
    """documents as marked-up texts with paragraphs."""
    t = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"(^|\n)([AT][a-z]+)", "$1# $2\n"), r"(^|\n)([ED][a-z]+)", "$1### $2\n")
    return docs(s, d).select("doc_id", t.alias("text"))


_MARKED = r"""documents AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10)), '(^|\n)([AT][a-z]+)', '\1# \2' || chr(10), 'g'), '(^|\n)([ED][a-z]+)', '\1### \2' || chr(10), 'g') AS text FROM main.documents)"""
_TOKENS = "greatest(1, ceil(length({0}) / 4))"


def sized_sql(source: str, more: str = "") -> str:
    """Chunks of the CTE chunks (doc_id, chunk_index, text) with their facts."""
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1)::INT AS chunk_index, text, len({WORDS.format('text')})::INT AS word_count, length(text)::INT AS character_count, {_TOKENS.format('text')}::BIGINT AS estimated_tokens, '{source}' AS source_type{more} FROM chunks"


def merged_sql(least: int, joint: str) -> str:
    """CTE chunks of the CTE pieces (doc_id, i, text): small ones joined to the one before."""
    return f"""marked AS (SELECT *, CASE WHEN {_TOKENS.format('text')} >= {least} OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS begins FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 groups AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM marked), chunks AS (SELECT doc_id, part AS chunk_index, {STRIP.format(f"string_agg(text, {joint} ORDER BY i)")} AS text FROM groups GROUP BY doc_id, part)"""


def packed_sql(parts: str, most: int, joint: str) -> str:
    """CTEs of greedy packing: parts (doc_id, b, i from 1, t) into packed (doc_id, b, chunk, text)."""
    longer = f"f.open || {joint} || n.t"
    full = f"{_TOKENS.format(f'({longer})')} > {most}"
    return f"""{parts}, folded AS (SELECT doc_id, b, i, 0 AS chunk, t AS open FROM parts WHERE i = 1 UNION ALL
   SELECT n.doc_id, n.b, n.i, CASE WHEN {full} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN {full} THEN n.t ELSE {longer} END FROM folded f JOIN parts n ON n.doc_id = f.doc_id AND n.b = f.b AND n.i = f.i + 1),
 packed AS (SELECT doc_id, b, chunk, arg_max(open, i) AS text FROM folded GROUP BY 1, 2, 3)"""


_MOST, _BACK = CONFIG.chunk_size * 4, CONFIG.overlap * 4
_FIXED = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), pre AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
 sums AS (SELECT doc_id, list(s ORDER BY i) AS p, any_value(n) AS n FROM (SELECT doc_id, i, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM pre) GROUP BY doc_id),
 cut AS (SELECT doc_id, 0 AS i, 0::BIGINT AS s, greatest(1, len(list_filter(p, lambda x: x <= {_MOST} + 1)))::BIGINT AS e, p, n FROM sums UNION ALL
  SELECT doc_id, i + 1, s, greatest(s + 1, len(list_filter(p, lambda x: x <= (CASE WHEN s = 0 THEN 0 ELSE p[s] END) + {_MOST} + 1)))::BIGINT, p, n FROM (SELECT doc_id, i, greatest(s + 1, len(list_filter(p, lambda x: x <= p[e] - {_BACK})))::BIGINT AS s, p, n FROM cut WHERE e < n)),
 pieces AS (SELECT doc_id, i, array_to_string(w[s + 1:e], ' ') AS text FROM cut JOIN w USING (doc_id)), {merged_sql(CONFIG.min_chunk_size, "' '")} {sized_sql('fixed')}"""


def paragraph_sql(head: str, config: p.ChunkConfig) -> str:
    """chunk_paragraph() of the table or CTE documents."""
    blocks = f"blocks AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS b FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda b: {STRIP.format('b')}), lambda b: b <> '') AS l FROM documents))"
    parts = f"parts AS (SELECT doc_id, b, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, b, list_filter({SENT.format('t')}, lambda s: {STRIP.format('s')} <> '') AS l FROM blocks WHERE {_TOKENS.format('t')} > {config.max_chunk_size}))"
    pieces = f"pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, chunk) AS i, text FROM (SELECT doc_id, b, chunk, text FROM packed UNION ALL SELECT doc_id, b, 0, t FROM blocks WHERE {_TOKENS.format('t')} <= {config.max_chunk_size}))"
    joint = "chr(10) || chr(10)"
    return f"WITH RECURSIVE {head}{blocks}, {packed_sql(parts, config.max_chunk_size, chr(39) + ' ' + chr(39))}, {pieces}, {merged_sql(config.min_chunk_size, joint)} "


_PATHS = ", ".join(f"last_value(CASE WHEN level = {i} THEN part END IGNORE NULLS) OVER w AS p{i}, last_value(CASE WHEN level = {i} THEN title END IGNORE NULLS) OVER w AS t{i}" for i in range(1, 7))
_PATH = ", ".join(f"CASE WHEN p{i} IS NOT NULL{''.join(f' AND coalesce(p{j}, -1) < p{i}' for j in range(1, i))} THEN t{i} END" for i in range(1, 7))


def heading_sql(head: str, config: p.ChunkConfig) -> str:
    """chunk_heading() of the table or CTE documents."""
    lines = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
 leveled AS (SELECT *, nullif(length(regexp_extract(regexp_replace(line, '\s+$', ''), '^(#{1,6})\s+(\S.*)$', 1)), 0) AS level, trim(regexp_extract(regexp_replace(line, '\s+$', ''), '^(#{1,6})\s+(\S.*)$', 2)) AS title FROM lines),
 numbered AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM leveled),"""
    paths = f"paths AS (SELECT doc_id, part, title AS heading, concat_ws(' > ', {_PATH}) AS section, level AS heading_level FROM (SELECT *, {_PATHS} FROM numbered WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY part ROWS UNBOUNDED PRECEDING)))"
    bodies = f"bodies AS (SELECT doc_id, part AS b, {STRIP.format('string_agg(line, chr(10) ORDER BY line_no)')} AS t FROM numbered GROUP BY 1, 2), kept AS (SELECT * FROM bodies WHERE t <> '')"
    inner = f"parts AS (SELECT doc_id, b, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, b, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda b: {STRIP.format('b')}), lambda b: b <> '') AS l FROM kept WHERE {_TOKENS.format('t')} > {config.max_chunk_size}))"
    chunks = f"chunks AS (SELECT x.doc_id, row_number() OVER (PARTITION BY x.doc_id ORDER BY b, chunk) AS chunk_index, text, heading, section, heading_level FROM (SELECT doc_id, b, chunk, text FROM packed UNION ALL SELECT doc_id, b, 0, t FROM kept WHERE {_TOKENS.format('t')} <= {config.max_chunk_size}) x LEFT JOIN paths y ON y.doc_id = x.doc_id AND y.part = x.b)"
    return f"WITH RECURSIVE {head}{lines} {paths}, {bodies}, {packed_sql(inner, config.max_chunk_size, 'chr(10) || chr(10)')}, {chunks} {sized_sql('heading', ', heading, section, heading_level')}"


# --- graphs of texts ------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in graph.STOPWORDS) + "]"
_SENTENCES = f"sents AS (SELECT doc_id, generate_subscripts(l, 1) AS sn, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform({SENT.format('text')}, lambda s: array_to_string({WORDS.format('s')}, ' ')), lambda s: s <> '') AS l FROM documents))"
_KIND = "CASE " + " ".join(f"WHEN contains(btw, '{phrase}') THEN '{kind}'" for phrase, kind in graph.PHRASES)
_ENTS = f"ents AS ({DERIVED['n1_entities']})"
#: Edges of the CTE nodes (doc_id, pos, label).
_EDGES = f"""{_SENTENCES}, placed AS (SELECT s.doc_id, sn, sentence, label, pos, strpos(sentence, label) AS spot FROM sents s JOIN nodes n USING (doc_id) WHERE contains(sentence, label)),
 ordered AS (SELECT *, lead(label) OVER (PARTITION BY doc_id, sn ORDER BY spot, pos) AS target FROM placed), rests AS (SELECT *, substr(sentence, spot + length(label)) AS rest FROM ordered WHERE target IS NOT NULL),
 betweens AS (SELECT doc_id, label AS source, target, CASE WHEN strpos(rest, target) > 0 THEN lower(substr(rest, 1, strpos(rest, target) - 1)) ELSE '' END AS btw FROM rests),
 edges AS (SELECT DISTINCT doc_id, source, target, {_KIND} ELSE coalesce(upper(list_filter(regexp_extract_all(btw, '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))[1]), 'RELATED_TO') END AS relationship_type FROM betweens)"""
_NORM = "regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')"
#: Nodes with equal letters and digits merged, and edges between them.
_MERGED = f"""keyed AS (SELECT *, {_NORM} AS nk FROM nodes), firsts AS (SELECT doc_id, nk, min(pos) AS pos, arg_min(id, pos) AS id, arg_min(label, pos) AS label, list_sort(list_distinct(list(label))) AS labels FROM keyed GROUP BY 1, 2),
 ends AS (SELECT doc_id, e, arg_min(t, (o, t)) AS t FROM (SELECT k.doc_id, k.label AS e, f.id AS t, 1 AS o FROM keyed k JOIN firsts f USING (doc_id, nk) UNION ALL SELECT k.doc_id, k.id, f.id, 0 FROM keyed k JOIN firsts f USING (doc_id, nk)) GROUP BY 1, 2),
 joined AS (SELECT DISTINCT e.doc_id, coalesce(a.t, source) AS source, coalesce(b.t, target) AS target, relationship_type FROM edges e LEFT JOIN ends a ON a.doc_id = e.doc_id AND a.e = source LEFT JOIN ends b ON b.doc_id = e.doc_id AND b.e = target)"""
_ISSUES = r"""SELECT doc_id, 'duplicate_id' AS issue, id AS subject FROM nodes GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_label', regexp_replace(lower(label), '[ \t\n]', '', 'g') FROM nodes GROUP BY ALL HAVING count(*) > 1
 UNION ALL SELECT DISTINCT doc_id, 'dangling_end', e FROM (SELECT doc_id, source AS e FROM edges UNION SELECT doc_id, target FROM edges) x WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = x.doc_id AND n.id = e)
 UNION ALL SELECT DISTINCT doc_id, 'self_loop', source FROM edges WHERE source = target"""

# --- stores, crawls, layouts and templates --------------------------------------------------------------------------


def stored_graphs(s, d):
    """Entities of the documents as a graph for each source, written in two versions, read from the newest."""
    path = f"{shared_folder(s)}/graphs-{uuid.uuid4().hex}"
    # written once, as both versions and their edges are made of them
    nodes, _ = Tables(s, "entities").write(graph.entities(docs(s, d)).join(docs(s, d).select("doc_id", F.col("source").alias("graph_id")), "doc_id"))
    edges = nodes.select("graph_id", F.col("id").alias("source"), F.lit(None).cast("string").alias("target"))
    graphs.write_graph(nodes, edges, path)
    graphs.write_graph(nodes.where("graph_id <> 'src1' and pos < 2"), edges.where("graph_id <> 'src1'"), path)
    graphs.delete_graph(s, path, "src2")
    newest = [graphs.read_graph(s, path, r.graph_id)[0].select("graph_id", "pos") for r in graphs.list_graphs(s, path).collect()]
    out = newest[0]
    for rows in newest[1:]:
        out = out.union(rows)
    return out.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.max("pos").alias("last"))


def reported(s, d):
    """The summary of a written report of findings on the orders' lines."""
    path = f"{shared_folder(s)}/report-{uuid.uuid4().hex}"
    files.write_report(items(s, d).select(F.col("l_orderkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("rule_id")), path)
    return s.read.schema("doc_id long, total long, rules long").json(f"{path}/summary")


def crawl_pages(s, d):
    pages = table(s, d, "pages").select((F.col("page_id") % 9).alias("crawl_id"), (F.length("url") * 100 + F.col("page_id") % 100).alias("discovered"), "page_id", "url")
    issues = table(s, d, "events").select((F.col("event_id") % 400).alias("page_id"), F.col("event_type").alias("rule_code"), F.col("user_id").cast("string").alias("element_selector"), F.lit("OPEN").alias("status")).distinct()
    return k.crawl_report(pages, issues).select("crawl_id", "position", "page_id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i.rule_code, i.element_selector)), ",").alias("issues"))


def styles(s, d):
    rows = made(s, d, FRAGMENTS).withColumn("font", F.when(F.col("bold"), "Bold").otherwise("Plain"))
    return el.style_levels(rows.withColumn("text", F.coalesce("text", F.lit(""))))


def text_lines(s, d):
    """Words of part names, set out on pages of forty parts."""
    n = F.col("p_partkey")
    rows = table(s, d, "part").select(F.floor(n / 40).cast("string").alias("doc_id"), (n % 2).cast("int").alias("page"), n.cast("int").alias("seq"), "p_name", (F.floor(n % 40 / 6) * 10 + n % 3).cast("double").alias("top"), ((n * 37) % 101).cast("double").alias("left"))
    return el.reconstruct_lines(rows.select("doc_id", "page", "seq", F.col("p_name").alias("text"), "top", "left"))


def course(s, d):
    """A tree for each customer: a section, a unit for each of its orders' priorities, and a chapter for each order."""
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", "o_orderpriority")
    unit = F.ascii("o_orderpriority").cast("long") - 48
    chapters = o.select("doc_id", (F.col("o_orderkey") + 1000).alias("node_id"), unit.alias("parent_id"), F.lit("chapter").alias("type"), F.concat(F.lit("c"), "o_orderkey").alias("label"), F.col("o_orderkey").alias("pos"))
    unit_rows = o.select("doc_id", unit.alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit("unit").alias("type"), F.col("o_orderpriority").alias("label"), F.lit(-1).cast("long").alias("pos")).distinct()
    roots = o.select("doc_id", F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("section").alias("type"), F.lit("Orders").alias("label"), F.lit(-2).cast("long").alias("pos")).distinct()
    return graph.chapter_rows(chapters.unionByName(unit_rows).unionByName(roots))


def part_graphs(s, d):
    n = F.col("p_partkey")
    nodes = table(s, d, "part").select((n % 50).alias("graph_id"), n.cast("string").alias("id"), F.element_at(F.split("p_name", " "), 1).alias("label"))
    edges = table(s, d, "part").select((n % 50).alias("graph_id"), n.cast("string").alias("source"), (n + F.col("p_size") % 5 * 25).cast("string").alias("target"), F.when(n % 3 > 0, F.col("p_size") / 50.0).alias("confidence"))
    return evaluate.evaluate_graph(nodes, edges, expected=40)


def variables(s, d):
    """A template for each part, that names words of the part's name, and variables of which some are not used."""
    word = F.split("p_name", " ")
    templates = table(s, d, "part").select(F.col("p_partkey").alias("template_id"), F.concat(F.lit("Dear {{ "), F.element_at(word, 1), F.lit(" }}, {{size}} and {{ "), F.element_at(word, -1), F.lit(" | upper }}.")).alias("text"))
    given = table(s, d, "part").select(F.col("p_partkey").alias("template_id"), F.explode(F.array(F.struct(F.element_at(word, 1).alias("name"), F.when(F.col("p_size") % 4 > 0, "v").alias("value")), F.struct(F.lit("size").alias("name"), F.when(F.col("p_size") % 3 == 0, " ").otherwise("9").alias("value")), F.struct(F.lit("other").alias("name"), F.lit("x").alias("value")))).alias("v")).select("template_id", "v.*")
    return evaluate.prompt_variables(templates, given.dropDuplicates(["template_id", "name"]))


def sitemaps(s, d):
    """Sites of pages whose numbers agree modulo 40: a site map of their addresses, or none."""
    rows = table(s, d, "pages").select((F.col("page_id") % 40).alias("site_id"), "page_id", "url")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: F.concat(F.lit("<url><loc> "), F.replace(x.url, F.lit("&"), F.lit("&amp;")), F.lit("#top</loc></url>"))), "")
    sites = rows.groupBy("site_id").agg(F.min_by("url", "page_id").alias("url"), F.when(F.first(F.col("site_id")) % 4 > 0, F.concat(F.lit("<urlset>"), listed, F.lit("</urlset>"))).alias("xml"))
    links = rows.select("site_id", F.lit(1).alias("position"), "url").where("site_id % 8 = 0")
    return web.discover_sitemap(sites, links).select("site_id", "position", "url")


def scored_pages(s, d):
    """A first scan of all pages: their scores."""
    pages = table(s, d, "pages").select("page_id", "url", F.col("html"))
    rules = s.createDataFrame([("IMG_ALT", "CRITICAL", True), ("FORM_LABEL", "SERIOUS", True)], "rule_code string, severity string, enabled boolean")
    scans = pages.select("page_id", F.lit(1).cast("long").alias("scan_id"), F.lit("COMPLETED").alias("status"))
    past = s.createDataFrame([], "page_id long, scan_id long, status string"), s.createDataFrame([], "page_id long, scan_id long, rule_code string, element_selector string, message string")
    marked = pages.select("page_id", "url", F.expr(MARKUP).alias("html"))
    return web.scan_pages(marked, scans, rules, *past)[0].groupBy("rule_code", "status").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def submissions(s, d):
    """Scores of manuscripts whose parts come from the parts' table."""
    n = F.col("p_partkey")
    rows = table(s, d, "part")
    of = lambda c: rows.select(n.alias("doc_id"), *c)
    parts = [of([((n % 11) / 10).alias("originality_score")]), of([((F.col("p_size") % 10) / 10).alias("ai_likelihood_score")]), of([F.when(n % 4 == 0, "Ready for Copyediting").when(n % 4 == 1, "Needs Structural Editing").when(n % 4 == 2, "Needs Major Editing").otherwise("Unknown").alias("readiness_status")]), of([((n % 5) / 4).alias("structure_score")]), of([((n % 7) / 10).alias("redundancy_score")])]
    return m.submission_score(*parts).select("doc_id", "submission_score", "readiness_label", "editing_effort", "estimated_hours", "recommended_action")


QUERIES = {
    "c7_split_paragraphs": lambda s, d: p.chunk_paragraph(marked_docs(s, d), SPLIT), "c8_split_headings": lambda s, d: p.chunk_heading(marked_docs(s, d), SPLIT), "a12_split_statistics": lambda s, d: p.chunk_statistics(p.chunk_paragraph(marked_docs(s, d), SPLIT)),
    "c5_marked_headings": lambda s, d: p.headings(marked_docs(s, d)),
    "f6_rows_of_type": lambda s, d: c.rows_of_type(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 3 == 0).alias("is_deleted")), "1-urgent"),
    "w4_next_group_code": lambda s, d: c.next_group_code(table(s, d, "orders").select(F.col("o_orderkey").alias("group_code")), 3),
    "w10_style_levels": styles, "w16_reconstruct_lines": text_lines, "w17_chapter_rows": course, "a11_crawl_report": crawl_pages, "e4_evaluate_graph": part_graphs, "e7_prompt_variables": variables,
    "p7_discover_sitemap": sitemaps, "p10_scan_pages": scored_pages, "t11_submission_score": submissions, "s8_graph_store": stored_graphs, "s9_write_report": reported,
}
_FAMILY = "(SELECT page_id % 40 AS site_id, page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS h FROM pages)"
#: Pages hold links from the root only, each <a href="...">...</a>.
_ANCHORS = """anchors AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS seq, unnest(h) AS href, unnest(t) AS said FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages))"""
ORACLES = {
    "p1_html_elements": f"WITH {_ANCHORS} SELECT page_id, seq, 'a' AS tag, replace(href, '&amp;', '&') AS href, false AS in_label, replace(said, '&amp;', '&') AS text FROM anchors",
    "p6_discover_links": rf"""WITH {_ANCHORS}, seen AS (SELECT page_id, -1 AS seq, regexp_replace(url, '#.*$', '') AS url FROM pages UNION ALL SELECT page_id, seq, regexp_extract(url, '^https?://[^/?#]+') || regexp_replace(replace(href, '&amp;', '&'), '#.*$', '') FROM anchors),
 firsts AS (SELECT page_id, url, min(seq) AS seq FROM seen GROUP BY 1, 2), placed AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq, url)::INT AS position, url FROM firsts) SELECT * FROM placed WHERE position <= 20""",
    "c6_chunk_fixed": _FIXED,
    "c10_chunk_documents": paragraph_sql("", CONFIG) + sized_sql("paragraph"),
    "c8_chunk_heading": heading_sql("", CONFIG),
    "c7_split_paragraphs": paragraph_sql(_MARKED + ", ", SPLIT) + sized_sql("paragraph"),
    "c8_split_headings": heading_sql(_MARKED + ", ", SPLIT),
    "a12_split_statistics": paragraph_sql(_MARKED + ", ", SPLIT) + f"""SELECT doc_id, count(*) AS total_chunks, sum(tk)::BIGINT AS total_tokens, round_even(avg(tk), 2) AS average_tokens, max(tk) AS largest_tokens, min(tk) AS smallest_tokens, round_even(avg(length(text)), 2) AS average_characters,
      round_even(avg(len({WORDS.format('text')})), 2) AS average_words FROM (SELECT *, {_TOKENS.format('text')}::BIGINT AS tk FROM chunks) GROUP BY doc_id""",
    "c5_marked_headings": rf"WITH {_MARKED}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(\S.*?)\s*#*\s*$', 1))::INT AS level, regexp_extract(line, '^(#{{1,6}})\s+(\S.*?)\s*#*\s*$', 2) AS title, 'markdown' AS source FROM lines WHERE regexp_matches(line, '^(#{{1,6}})\s+(\S.*?)\s*#*\s*$')",
    "n3_relations": f"WITH {_ENTS}, nodes AS (SELECT * FROM ents), {_EDGES} SELECT * FROM edges",
    "n4_merge_nodes": f"WITH {_ENTS}, nodes AS (SELECT * FROM ents), edges AS (SELECT NULL::BIGINT AS doc_id, '' AS source, '' AS target, '' AS relationship_type WHERE false), {_MERGED} SELECT doc_id, pos, id, label, array_to_string(list_filter(labels, lambda l: l <> label), ',') AS aliases FROM firsts",
    "n5_graph_issues": f"WITH {_ENTS}, nodes AS (SELECT * FROM ents), {_EDGES} {_ISSUES}",
    "n6_build_graph": f"WITH {_ENTS}, nodes AS (SELECT doc_id, pos::BIGINT AS pos, id, label FROM ents UNION ALL SELECT doc_id, pos + 4294967296, id, label FROM ({MORE['n2_concepts']})), {_EDGES}, {_MERGED} SELECT * FROM joined",
    "g11_clean_outputs": "SELECT event_id, props AS cleaned, props AS parsed FROM events WHERE json_valid(props)",
    "g10_sanitize_prompts": rf"""WITH a AS (SELECT conv_id || '-' || turn AS request_id, text AS before, regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\r\n?', chr(10), 'g'), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g') AS t FROM conversations),
 b AS (SELECT *, regexp_replace(regexp_replace(t, '[\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\t\f\x0b]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS u FROM a),
 n AS (SELECT *, {STRIP.format("regexp_replace(regexp_replace(u, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS v0 FROM b),
 {", ".join(f"r{i} AS (SELECT *, regexp_replace(v{i}, '(?i){pattern}', '[filtered]', 'g') AS v{i + 1} FROM {f'r{i - 1}' if i else 'n'})" for i, pattern in enumerate(g.REDACTED_PATTERNS))},
 e AS (SELECT request_id, before, regexp_replace(left({STRIP.format(f'v{len(g.REDACTED_PATTERNS)}')}, 200), '\s+$', '') AS sanitized FROM r{len(g.REDACTED_PATTERNS) - 1}) SELECT request_id, sanitized, sanitized IS DISTINCT FROM before AS changed FROM e""",
    "f6_rows_of_type": "SELECT o_orderkey AS id, o_orderpriority AS type, NULL::VARCHAR AS error FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_orderkey % 3 <> 0",
    "w4_next_group_code": "SELECT (floor(max(o_orderkey) / 1000) + 1)::BIGINT * 1000 + 1000 * i AS group_code FROM orders, (SELECT unnest([0, 1, 2]) AS i) GROUP BY i",
    "w10_style_levels": f"""WITH {cte("f", FRAGMENTS)}, st AS (SELECT doc_id, CASE WHEN bold THEN 'Bold' ELSE 'Plain' END AS font, "size", min(seq) AS first, count(*) FILTER (length("text") >= 60) AS long FROM f GROUP BY 1, 2, 3),
 body AS (SELECT doc_id, "size" AS b FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY long DESC, first) = 1) SELECT doc_id, font, "size", least(6, row_number() OVER (PARTITION BY doc_id ORDER BY "size" DESC, first))::INT AS level FROM st JOIN body USING (doc_id) WHERE "size" > b""",
    "w16_reconstruct_lines": """WITH RECURSIVE w AS (SELECT (p_partkey // 40)::VARCHAR AS doc_id, (p_partkey % 2)::INT AS page, p_partkey AS seq, p_name AS t, ((p_partkey % 40) // 6 * 10 + p_partkey % 3)::DOUBLE AS top, ((p_partkey * 37) % 101)::DOUBLE AS lft FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, lft, seq) AS i FROM w), r AS (SELECT doc_id, page, i, t, lft, top AS anchor, 0 AS line FROM n WHERE i = 1 UNION ALL
  SELECT n.doc_id, n.page, n.i, n.t, n.lft, CASE WHEN n.top - anchor > 3 THEN n.top ELSE anchor END, CASE WHEN n.top - anchor > 3 THEN line + 1 ELSE line END FROM r JOIN n ON n.doc_id = r.doc_id AND n.page = r.page AND n.i = r.i + 1) SELECT doc_id, page, line, string_agg(t, ' ' ORDER BY lft, t) AS text FROM r GROUP BY 1, 2, 3""",
    "w17_chapter_rows": "WITH o AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS k, o_orderpriority AS unit, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders) SELECT doc_id, 'Orders' AS section, dense_rank() OVER (PARTITION BY doc_id ORDER BY first)::INT AS unit_number, unit, row_number() OVER (PARTITION BY doc_id, unit ORDER BY k)::INT AS chapter_number, 'c' || k AS chapter FROM o",
    "a11_crawl_report": "WITH i AS (SELECT event_id % 400 AS page_id, string_agg(x, ',' ORDER BY a, b) AS issues FROM (SELECT DISTINCT event_id % 400 AS event_id, event_type AS a, user_id::VARCHAR AS b, event_type || ':' || user_id AS x FROM events) GROUP BY 1) SELECT page_id % 9 AS crawl_id, row_number() OVER (PARTITION BY page_id % 9 ORDER BY length(url) * 100 + page_id % 100, page_id)::INT AS position, page_id, coalesce(issues, '') AS issues FROM pages LEFT JOIN i USING (page_id)",
    "e4_evaluate_graph": """WITH n AS (SELECT p_partkey % 50 AS graph_id, p_partkey AS id, regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z0-9]+', '', 'g') AS l FROM part), s AS (SELECT graph_id, count(*) AS n, count(DISTINCT l) AS own FROM n GROUP BY 1),
 e AS (SELECT p_partkey % 50 AS graph_id, p_partkey AS a, p_partkey + p_size % 5 * 25 AS b, CASE WHEN p_partkey % 3 > 0 THEN p_size / 50.0::DOUBLE END AS f FROM part), q AS (SELECT e.graph_id, avg(CASE WHEN n.id IS NOT NULL AND a <> b AND coalesce(f >= 0.5, true) THEN 1.0::DOUBLE ELSE 0.0 END) AS q FROM e LEFT JOIN n ON n.graph_id = e.graph_id AND n.id = e.b GROUP BY 1),
 v AS (SELECT graph_id, 'entity_count' AS name, n / 40::DOUBLE AS score FROM s UNION ALL SELECT graph_id, 'duplicate_nodes', own / n::DOUBLE FROM s UNION ALL SELECT graph_id, 'relationship_quality', q FROM q)
 SELECT 'KNOWLEDGE_GRAPH' AS module, graph_id, name, round_even(greatest(0, least(1, score))::DECIMAL(18, 8), 4)::DOUBLE AS score, 0.7::DOUBLE AS threshold, 1.0::DOUBLE AS weight, round_even(greatest(0, least(1, score))::DECIMAL(18, 8), 4) >= 0.7 AS passed FROM v""",
    "e7_prompt_variables": r"""WITH t AS (SELECT DISTINCT p_partkey AS id, unnest([split_part(p_name, ' ', 1), 'size', split_part(p_name, ' ', -1)]) AS name FROM part), v AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS name, CASE WHEN p_size % 4 > 0 THEN 'v' END AS value FROM part UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '9' END FROM part UNION ALL SELECT p_partkey, 'other', 'x' FROM part),
 j AS (SELECT coalesce(t.id, v.id) AS template_id, coalesce(t.name, v.name) AS name, CASE WHEN v.id IS NULL THEN 'missing' WHEN t.id IS NULL THEN 'unused' WHEN value IS NULL THEN 'null' WHEN trim(value) = '' THEN 'empty' END AS problem FROM t FULL JOIN v ON v.id = t.id AND v.name = t.name) SELECT *, CASE WHEN problem IN ('missing', 'null') THEN 'ERROR' ELSE 'WARNING' END AS level FROM j WHERE problem IS NOT NULL""",
    "p7_discover_sitemap": f"""WITH r AS {_FAMILY}, b AS (SELECT site_id, arg_min(h, page_id) AS base FROM r GROUP BY 1), l AS (SELECT r.site_id, regexp_replace(url, '#.*$', '') AS url, min(page_id) AS o FROM r JOIN b USING (site_id) WHERE r.site_id % 4 > 0 AND (h = base OR ends_with(h, '.' || base) OR ends_with(base, '.' || h)) GROUP BY 1, 2),
 n AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY o, url)::INT AS position, url FROM l) SELECT * FROM n WHERE position <= 20 UNION ALL SELECT site_id, 1, url FROM r WHERE site_id % 8 = 0""",
    "p10_scan_pages": "SELECT 'IMG_ALT' AS rule_code, 'OPEN' AS status, count(*) AS n, count(*) AS pages FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'FORM_LABEL', 'OPEN', count(*), count(*) FROM pages WHERE page_id % 4 IN (0, 3)",
    "t11_submission_score": """WITH q AS (SELECT p_partkey AS doc_id, ((p_partkey % 11 / 10.0::DOUBLE * 0.25::DOUBLE + (1 - p_size % 10 / 10.0::DOUBLE) * 0.15::DOUBLE + CASE p_partkey % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END * 0.25::DOUBLE + p_partkey % 5 / 4.0::DOUBLE * 0.20::DOUBLE + (1 - p_partkey % 7 / 10.0::DOUBLE) * 0.15::DOUBLE) * 100) AS x FROM part), v AS (SELECT doc_id, trunc(x)::INT AS s FROM q)
 SELECT doc_id, s AS submission_score, CASE WHEN s >= 85 THEN 'Ready for Editing' WHEN s >= 65 THEN 'Needs Minor Revision' WHEN s >= 45 THEN 'Needs Structural Editing' ELSE 'High Risk Submission' END AS readiness_label, CASE WHEN s >= 85 THEN 'Low' WHEN s >= 65 THEN 'Medium' WHEN s >= 45 THEN 'High' ELSE 'Very High' END AS editing_effort,
  CASE WHEN s >= 85 THEN 5 WHEN s >= 65 THEN 18 WHEN s >= 45 THEN 30 ELSE 50 END AS estimated_hours, CASE WHEN s >= 85 THEN 'Proceed to copyediting' WHEN s >= 65 THEN 'Proceed with copyediting after fixes' WHEN s >= 45 THEN 'Require structural revision before editing' ELSE 'Reject or major rewrite required' END AS recommended_action FROM v""",
    "s8_graph_store": f"WITH {_ENTS} SELECT source AS graph_id, count(*) AS nodes, max(pos) AS last FROM ents JOIN documents USING (doc_id) WHERE source <> 'src2' AND (source = 'src1' OR pos < 2) GROUP BY 1",
    "s9_write_report": "SELECT l_orderkey AS doc_id, count(*) AS total, count(DISTINCT l_returnflag || l_linestatus) AS rules FROM lineitem GROUP BY 1",
}
