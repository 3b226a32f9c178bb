"""Cycles, trees and relations against searches over small graphs, and where they are long."""

import random
import re

import pytest
from inkwell.functions.text import words
from inkwell.operators import cycles, elements, graph, prep, trees
from pyspark.sql import functions as F

EDGE = "doc_id long, source string, target string"


def searched(edges):
    """(doc_id, node) -> smallest node of its component, of the nodes that reach themselves."""
    out, docs = {}, {}
    for d, s, t in edges:
        docs.setdefault(d, {}).setdefault(s, set()).add(t)
    for d, after in docs.items():
        reach = {}
        for n in set(after) | {t for ts in after.values() for t in ts}:
            seen, todo = set(), list(after.get(n, ()))
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            reach[n] = seen
        out |= {(d, n): min(m for m in seen if n in reach[m]) for n, seen in reach.items() if n in seen}
    return out


def components(spark, edges, nodes=None, few_edges=cycles.FEW_EDGES):
    found = cycles.strong_components(spark.createDataFrame(edges, EDGE), nodes, few_edges).collect()
    assert len(found) == len({(r.doc_id, r.node) for r in found})
    return {(r.doc_id, r.node): r.component for r in found}


@pytest.mark.parametrize("few_edges", [0, 600, cycles.FEW_EDGES])
def test_components_equal_a_search(spark, few_edges):
    """Random graphs, a chain and a ring of 1,000, and two rings with a bridge, whose node is on no cycle."""
    r, edges = random.Random(3), []
    for d in range(40):
        n = r.choice([2, 3, 5, 8, 12, 20])
        edges += [(d, str(r.randrange(n)), str(r.randrange(n))) for _ in range(r.choice([n // 2 + 1, n, int(n * 1.5), 3 * n]))]
    edges += [(100, f"{i:04d}", f"{i + 1:04d}") for i in range(1000)] + [(101, f"{i:04d}", f"{(i + 1) % 1000:04d}") for i in range(1000)]
    edges += [(102, f"{x}{i}", f"{x}{(i + 1) % 30}") for x in "ab" for i in range(30)] + [(102, "a3", "m"), (102, "m", "b4")]
    got = components(spark, edges, few_edges=few_edges)
    assert got == searched(edges)
    assert (102, "m") not in got and not any(d == 100 for d, _ in got) and sum(d == 101 for d, _ in got) == 1000


def test_only_known_nodes_count(spark):
    edges = [(1, "a", "b"), (1, "b", "a"), (1, "c", "x"), (1, "x", "c"), (1, "d", "d"), (2, "d", "e"), (1, None, "a")]
    nodes = spark.createDataFrame([(1, k, k) for k in "abcd"] + [(2, "d", "d"), (2, "e", "e")], "doc_id long, id string, label string")
    assert components(spark, edges, nodes) == {(1, "a"): "a", (1, "b"): "a", (1, "d"): "d"}
    assert components(spark, []) == {}
    typed = spark.createDataFrame([(*e, "R") for e in edges if e[1]], EDGE + ", relationship_type string")
    issues = {(r.doc_id, r.issue, r.subject) for r in graph.graph_issues(nodes, typed, allow_cycles=False).collect()}
    assert issues == {(1, "cycle", "a"), (1, "cycle", "b"), (1, "cycle", "d"), (1, "self_loop", "d"), (1, "dangling_end", "x")}


NODE = "doc_id string, node_id long, parent_id long, type string"


def test_deep_trees(spark):
    deep = [("deep", i, i - 1 if i else None, "P" if i % 3 else "Sect") for i in range(10_000)]
    flat = {r.node_id: r for r in trees.flatten_tree(spark.createDataFrame(deep, NODE), ancestors=False).collect()}
    assert len(flat) == 10_000 and all(r.depth == i for i, r in flat.items()) and flat[4].parent_type == "Sect"
    stats = trees.tree_statistics(spark.createDataFrame(deep, NODE)).first()
    assert (stats.elements, stats.max_depth, stats.types, stats.counts["Sect"]) == (10_000, 9_999, 2, 3_334)


def test_trees_equal_walks(spark):
    """Random trees; nodes behind an unknown parent or in a ring of parents are in none."""
    r = random.Random(5)
    rows = [(f"d{d}", i, r.randrange(i) if i and r.random() < 0.95 else None, r.choice("ABC")) for d in range(8) for i in range(r.choice([1, 5, 150]))]
    lost = [("x", 1, 99, "A"), ("x", 2, 1, "A"), ("x", 3, 4, "A"), ("x", 4, 3, "A"), ("x", 5, None, "B"), ("x", 6, 5, "C")]
    known = {(d, i): (p, t) for d, i, p, t in rows}
    got = {(x.doc_id, x.node_id): x for x in trees.flatten_tree(spark.createDataFrame(rows + lost, NODE)).collect()}
    assert {k for k in got if k[0] == "x"} == {("x", 5), ("x", 6)} and got["x", 6].ancestors == ["B"] and got["x", 6].depth == 1
    for (d, i), (p, t) in known.items():
        up = []
        while p is not None:
            up.insert(0, known[d, p][1])
            p = known[d, p][0]
        row = got[d, i]
        assert (row.type, row.depth, row.ancestors, row.parent_type) == (t, len(up), up, up[-1] if up else None)
    assert trees.flatten_tree(spark.createDataFrame([], NODE)).count() == 0


def related(text, labels, match):
    """Relations by looking for every label in every sentence."""
    found = set()
    for sentence in (" ".join(s.split()) for s in re.split(r"(?<=[.!?])\s+", text)):
        places = {}
        for label in labels:
            at = sentence.find(label) if match == "substring" else next((m.start() for m in re.finditer(rf"(?<![A-Za-z0-9_])(?={re.escape(label)}(?![A-Za-z0-9_]))", sentence)), -1)
            if at >= 0 and label not in places:
                places[label] = at
        ordered = sorted(places, key=places.get)
        for s, t in zip(ordered, ordered[1:]):
            begin = places[s] + len(s)
            upto = sentence.find(t, begin)
            between = sentence[begin:upto].lower() if upto >= 0 else ""
            kind = next((k for p, k in graph.PHRASES if p in between), None)
            verb = next((w.upper() for w in re.findall("[a-z]+", between) if len(w) > 2 and w not in graph.STOPWORDS), "RELATED_TO")
            found.add((s, t, kind or verb))
    return found


@pytest.mark.parametrize("match", ["substring", "word"])
def test_relations_equal_looking_for_every_label(spark, match):
    r = random.Random(6)
    vocabulary = ["Ann", "An", "Ann Lee", "Lee", "lee", "x", "is a", "are", "part of", "causes", "the", "Gravity", "discovered", "é", "Annex"]
    texts = {i: "".join(r.choice(vocabulary) + r.choice([" ", " ", "", ". ", "! "]) for _ in range(r.randrange(60))) for i in range(60)} | {60: "", 61: "One."}
    labels = {i: r.sample(["Ann", "An", "Ann Lee", "Lee", "lee", "Gravity", "e", "é", "nope"], r.randrange(8)) for i in texts}
    corpus = spark.createDataFrame([*texts.items(), (70, None)], "doc_id long, text string")
    nodes = spark.createDataFrame([(i, k, x) for i, own in labels.items() for k, x in enumerate([*own, *own[:1], ""])], "doc_id long, pos int, label string")
    got = [(x.doc_id, x.source, x.target, x.relationship_type) for x in graph.relations(corpus, nodes, match).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, *x) for i, t in texts.items() for x in related(t, labels[i], match)}


def test_relations_send_no_labels_to_sentences(spark):
    """The plan cuts sentences behind the join of documents with their labels, not before it."""
    docs = spark.createDataFrame([(1, "A b.")], "doc_id long, text string")
    plan = graph.relations(docs, graph.entities(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.split("MapInArrow")[1].split("Join")[0].lower()
    assert prep.sentence_array("text") is not None and words("text") is not None


HEAD = "doc_id string, page int, seq int, tag string, text string, size double, bold boolean, x double, y double"


def test_heading_eligibility(spark):
    body = [("a", 1, i, "P", "Body text of more than forty characters, number", 10.4, False, 50.0, 500.0 - 20 * i) for i in range(3)] + [("a", 1, 5, "P", "Larger body text, but of forty characters or more", 14.0, False, 50.0, 100.0)]
    heads = [
        ("a", 1, 10, "H1", "Title", 20.0, True, 50.0, 700.0), ("a", 1, 11, "H2", "___", 20.0, True, 50.0, 690.0), ("a", 1, 12, "H2", "1.", 12.0, True, 50.0, 651.0), ("a", 1, 13, "H3", "Herbs", 12.0, True, 90.0, 651.5), ("a", 1, 14, "H3", "Far", 12.0, True, 200.0, 652.0),
        ("a", 1, 15, "H2", "iv)", 12.0, True, 50.0, 600.0), ("a", 1, 16, "H2", "x" * 111, 12.0, True, 50.0, 580.0), ("a", 1, 17, "H5", "Reason:", 12.0, True, 50.0, 560.0), ("a", 1, 18, "P", "Because it is.", 10.0, False, 120.0, 560.0), ("a", 1, 19, "H2", "Badge", 6.0, True, 50.0, 540.0),
        ("a", 1, 20, "H4", "Plain", 10.0, False, 50.0, 520.5), ("a", 2, 21, "H4", "Small", 10.0, True, 50.0, 700.0), ("a", 2, 22, "H4", "Next", 11.0, True, 50.0, 650.0), ("b", 1, 1, "H1", "Alone", 10.2, False, 50.0, 700.0), ("b", 1, 2, "H1", "", 30.0, True, 50.0, 650.0), ("b", 1, 3, "H2", "Bold", None, True, 50.0, 600.0),
    ]
    got = {(r.doc_id, r.seq): (r.demoted, r.merged_into, r.label, r.level) for r in elements.heading_eligibility(spark.createDataFrame(body + heads, HEAD)).collect()}
    assert got == {
        ("a", 10): (None, None, None, 1), ("a", 11): ("rule_only", None, None, None), ("a", 12): (None, 13, None, None), ("a", 13): (None, None, "1.", 2), ("a", 14): (None, None, None, 2), ("a", 15): ("enumerator", None, None, None), ("a", 16): ("too_long", None, None, None),
        ("a", 17): ("run_in", None, None, None), ("a", 19): ("sub_body", None, None, None), ("a", 20): ("not_prominent", None, None, None), ("a", 21): (None, None, None, 3), ("a", 22): (None, None, None, 2),
        ("b", 1): ("not_prominent", None, None, None), ("b", 2): ("rule_only", None, None, None), ("b", 3): ("sub_body", None, None, None),
    }
    skipped = [("c", 1, 1, "H1", "Big", 30.0, True, 0.0, 90.0), ("c", 1, 2, "H1", "Small", 12.0, True, 0.0, 80.0), ("c", 1, 3, "H1", "Middle", 20.0, True, 0.0, 70.0), ("c", 1, 4, "H1", "Small again", 12.0, True, 0.0, 60.0)]
    assert {r.seq: r.level for r in elements.heading_eligibility(spark.createDataFrame(skipped, HEAD)).collect()} == {1: 1, 2: 2, 3: 2, 4: 3}


def test_built_edges_equal_merged_relations_without_a_join(spark):
    """Edges of a built graph are those of merge_nodes() of all nodes and their relations, also where an id stands for several texts."""
    texts = [(1, "Open AI Lab grows the open-ai field. OpenAI Lab is part of Science Park; science parks grow."), (1, "OPEN AI lab causes openai trouble. Open Ai lab."), (2, ""), (3, None), (4, "Newton discovered Gravity. Newton discovered Gravity. newton and gravity."), (5, "alone")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = graph.entities(docs).withColumn("pos", F.col("pos").cast("long")).unionByName(graph.concepts(docs).withColumn("pos", F.col("pos").cast("long") + (1 << 32)))
    merged, expected = graph.merge_nodes(nodes, graph.relations(docs, nodes))
    built = graph.build_graph(docs)
    plan = built[1]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    rows = [tuple(r) for r in built[1].collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in expected.collect()} and {r[0] for r in rows} == {1, 4}
    assert sorted(map(str, built[0].collect())) == sorted(map(str, merged.collect()))


def test_graph_issues_read_edges_once(spark):
    """Nodes and edges are each read once; a null end is dangling even if a node has no id."""
    nodes = spark.createDataFrame([(1, "a", "X y"), (1, "a", "xY"), (1, None, "n"), (1, None, "m"), (2, "b", "b")], "doc_id long, id string, label string")
    edges = spark.createDataFrame([(1, "a", "c", "R"), (1, "a", "a", " "), (1, None, "a", None), (2, "b", "a", "R")], "doc_id long, source string, target string, relationship_type string")
    df = graph.graph_issues(nodes, edges)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Exchange") == 1
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [
        (1, "duplicate_id", "a"), (1, "duplicate_id", None), (1, "duplicate_label", "xy"), (1, "dangling_end", "c"), (1, "dangling_end", None), (1, "self_loop", "a"), (1, "empty_type", "a"), (1, "empty_type", None), (2, "dangling_end", "a"),
    ]))


def test_entities_of_a_long_run_of_capitalised_words(spark):
    """A pattern that may give words back recurses for each of them and ends the JVM, so only short texts are matched by the plain one."""
    r = random.Random(3)
    plain = r"(?<![\p{L}\p{N}_])([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)(?![\p{L}\p{N}_])"
    short = spark.createDataFrame([("".join(r.choice(["A", "B", "a", "b", "\u00e9", "\u00c9", "_", "1", " ", " ", "\n", "."]) for _ in range(r.randrange(40))),) for _ in range(2000)], "text string")
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias(n) for n, p in (("plain", plain), ("new", graph.PROPER_NOUNS))]
    assert short.select("text", *found).where("plain <> new").count() == 0
    run = " ".join(f"Word{chr(97 + i % 26)}" for i in range(20_000))
    corpus = spark.createDataFrame([(1, run), (2, f"Tree {run}1 depends on Root.")], "doc_id long, text string")
    assert [(x.doc_id, len(x.label)) for x in graph.entities(corpus).orderBy("doc_id", "pos").collect()] == [(1, len(run)), (2, len(run) + 5 - 6), (2, 4)]
    assert {(x.doc_id, len(x.source), x.target, x.relationship_type) for x in graph.build_graph(corpus)[1].collect()} == {(2, len(run) - 1, "depends", "WORDF"), (2, 7, "root", "RELATED_TO")}
