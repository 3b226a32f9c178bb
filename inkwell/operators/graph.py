"""Knowledge graphs of texts: entities, concepts, relations, merging and validation."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_label, slugify
from .cycles import strong_components
from .prep import sentence_array

#: Fixed values
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "of", "to", "in", "on",
    "at", "by", "for", "with", "as", "is", "are", "was", "were", "be", "been",
    "this", "that", "these", "those", "it", "its", "he", "she", "they", "we",
    "you", "i", "from", "into", "than", "such", "not", "no", "yes", "can", "will",
    "would", "should", "could", "may", "might", "also", "which", "who", "whom",
    "what", "when", "where", "why", "how", "there", "here", "their", "his", "her",
]
PHRASES = [
    ("is a", "IS_A"), ("is an", "IS_A"), ("are", "IS_A"), ("part of", "PART_OF"), ("depends on", "DEPENDS_ON"), ("written by", "WRITTEN_BY"),
    ("authored by", "WRITTEN_BY"), ("explains", "EXPLAINS"), ("causes", "CAUSES"), ("caused", "CAUSES"),
]
WORD_CHARACTER = re.compile("[A-Za-z0-9_]")
#: Rows that a task holds before it hands them on.
EDGES_A_BATCH = 50_000
#: Every word ends at a boundary, so that nothing is taken back: Java's groups that may take back recurse for each of their words,
#: and thousands of capitalised words in a row end the JVM with a StackOverflowError.
PROPER_NOUNS = r"(?<![\p{L}\p{N}_])([A-Z][a-zA-Z]*+(?![\p{L}\p{N}_])(?:\s++[A-Z][a-zA-Z]*+(?![\p{L}\p{N}_]))*+)"


def _stopwords() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def _entity_labels(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PROPER_NOUNS), F.lit(1)))
    return F.filter(found, lambda l: F.contains(l, F.lit(" ")) | ~F.array_contains(_stopwords(), F.lower(l)))


def _concept_labels(text: Column, min_length: int = 4) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z\-]+"), F.lit(0))
    terms = F.transform(F.filter(found, lambda w: w.rlike("^[a-z]")), F.lower)
    return F.filter(F.array_distinct(terms), lambda w: (F.length(w) >= min_length) & ~F.array_contains(_stopwords(), w))


def entities(corpus: DataFrame) -> DataFrame:
    """doc_id, pos, id, label: runs of capitalised words, single stopwords dropped, unique in order of appearance."""
    return corpus.select("doc_id", F.posexplode(_entity_labels(F.col("text"))).alias("pos", "label")).select("doc_id", "pos", slugify("label").alias("id"), "label")


def concepts(corpus: DataFrame, min_length: int = 4) -> DataFrame:
    """doc_id, pos, id, label: lower-case content words, unique in order of appearance."""
    return corpus.select("doc_id", F.posexplode(_concept_labels(F.col("text"), min_length)).alias("pos", "label")).select("doc_id", "pos", F.col("label").alias("id"), "label")


@lru_cache(1 << 14)
def _inferred(between: str) -> str:
    """The relation that the lower-case text between two labels states: a phrase, else its first verb-like word."""
    named = next((kind for phrase, kind in PHRASES if phrase in between), None)
    return named or next((w.upper() for w in re.findall("[a-z]+", between) if len(w) > 2 and w not in STOPWORDS), "RELATED_TO")


def _one_row(corpus: DataFrame) -> DataFrame:
    """doc_id, texts: a document's texts meet once, so that what is made of them needs no other shuffle."""
    return corpus.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def _sentences() -> Column:
    return F.flatten(F.transform("texts", sentence_array))


def relations(corpus: DataFrame, nodes: DataFrame, match: str = "substring") -> DataFrame:
    """doc_id, source, target, relationship_type: labels of a document that follow each other in a sentence.

    nodes: doc_id, pos, label; a label's first place in a sentence counts, ties in the order of pos. A document's labels make one
    automaton that finds all of them in one pass over each of its sentences. ``match='word'`` asks for whole words. Empty labels
    and repetitions of a label are left out.
    """
    labels = nodes.where("label <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("nodes")).withColumn("labels", F.array_distinct("nodes.label"))
    rows = _one_row(corpus).join(labels.where(F.size("labels") > 1), "doc_id")
    return _followed(rows.select("doc_id", _sentences().alias("sentences"), "labels"), match=match)


def _labels_as_names(labels: list[str]) -> tuple[list[str], list[str]]:
    return labels, labels


def _followed(rows: DataFrame, named: Callable = _labels_as_names, match: str = "substring") -> DataFrame:
    """Edges of documents (doc_id, sentences, more arrays): ``named`` makes the labels, and what each is called in an edge, of those arrays.

    A document is one row, so its repeated edges go where they are found.
    """
    if match not in ("substring", "word"):
        raise ValueError(f"no way to match called {match!r}")

    def table(ids, out):
        return pa.RecordBatch.from_arrays([ids.take(pa.array([o[0] for o in out], pa.int32())), *[pa.array([o[i] for o in out], pa.string()) for i in (1, 2, 3)]], names=["doc_id", "source", "target", "relationship_type"])

    def follow(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                said, *about = [c[row].as_py() for c in batch.columns[1:]]
                out += [(row, *edge) for edge in _document_edges(said, *named(*about), match)]
                if len(out) >= EDGES_A_BATCH:
                    yield table(batch.column(0), out)
                    out = []
            yield table(batch.column(0), out)

    return rows.mapInArrow(follow, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, target string, relationship_type string")


def _document_edges(said: list[str], labels: list[str], names: list[str], match: str) -> set[tuple]:
    if len(labels) < 2:
        return set()
    index = ahocorasick.Automaton()
    for k, label in enumerate(labels):
        index.add_word(label, k)
    index.make_automaton()
    edges = set()
    for sentence in said:
        places: dict[int, int] = {}
        for last, k in index.iter(sentence):
            at = last + 1 - len(labels[k])
            if k not in places and (match == "substring" or _is_word(sentence, at, last + 1)):
                places[k] = at
        found = sorted(places, key=lambda k: (places[k], k))
        for s, t in zip(found, found[1:]):
            begin = places[s] + len(labels[s])
            upto = sentence.find(labels[t], begin)
            between = sentence[begin:upto].lower() if upto >= 0 else ""
            edges.add((names[s], names[t], _inferred(between) if len(between) < 100 else _inferred.__wrapped__(between)))
    return edges


def _is_word(sentence: str, begin: int, end: int) -> bool:
    return not (begin and WORD_CHARACTER.match(sentence[begin - 1]) or end < len(sentence) and WORD_CHARACTER.match(sentence[end]))


def _merged(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their key, the nodes of each key)."""
    keyed = nodes.withColumn("key", normalize_label("label"))
    return keyed, keyed.groupBy("doc_id", "key").agg(F.min(F.struct("pos", "id", "label")).alias("first"), F.array_sort(F.collect_set("label")).alias("labels"))


def _with_aliases(group: DataFrame) -> DataFrame:
    return group.select("doc_id", "first.pos", "first.id", "first.label", F.filter("labels", lambda l: l != F.col("first.label")).alias("aliases"))


def merge_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with aliases, edges): nodes (doc_id, pos, id, label) with equal letters and digits become the first one.

    Edge ends may be ids or labels; equal edges become one.
    """
    keyed, group = _merged(nodes)
    to = keyed.join(group.select("doc_id", "key", F.col("first.id").alias("to")), ["doc_id", "key"])
    ends = to.select("doc_id", F.col("label").alias("end"), "to", F.lit(1).alias("o")).union(to.select("doc_id", F.col("id"), "to", F.lit(0)))
    ends = ends.groupBy("doc_id", "end").agg(F.min(F.struct("o", "to")).alias("x")).select("doc_id", "end", "x.to")
    out = edges
    for side in ("source", "target"):
        names = ends.select("doc_id", F.col("end").alias(side), F.col("to").alias(f"_{side}"))
        out = out.join(names, ["doc_id", side], "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return _with_aliases(group), out.select("doc_id", "source", "target", "relationship_type").distinct()


def _merged_names(pos: list[int], labels: list[str], ids: list[str], keys: list[str]) -> tuple[list[str], list[str]]:
    """A document's labels in their order, and the ids that merge_nodes() gives to ends of these names."""
    first: dict[str, tuple] = {}
    for key, *node in zip(keys, pos, ids, labels):
        first[key] = min(first.get(key, node), node)
    of_id: dict[str, str] = {}
    for key, i in zip(keys, ids):
        of_id[i] = min(of_id.get(i, first[key][1]), first[key][1])
    names: dict[str, str] = {}
    for key, label in zip(keys, labels):
        names.setdefault(label, of_id.get(label, first[key][1]))
    return list(names), list(names.values())


def graph_issues(nodes: DataFrame, edges: DataFrame, allow_cycles: bool = True) -> DataFrame:
    """doc_id, issue, subject: duplicate ids and labels, dangling ends, self-loops, empty types, nodes on cycles.

    Nodes and edges are read once each: what they say of a subject is counted in one grouping.
    """
    spaceless = F.regexp_replace(F.lower("label"), "[ \t\n]", "")
    said = lambda kind, subject, node: F.struct(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), F.lit(node).alias("node"))
    of_nodes = nodes.select("doc_id", F.inline(F.array(said("id", F.col("id"), 1), said("label", spaceless, 1))))
    loop, untyped = F.col("source") == F.col("target"), F.coalesce(F.trim("relationship_type"), F.lit("")) == ""
    of_edges = edges.select("doc_id", F.inline(F.array_compact(F.array(
        said("id", F.col("source"), 0), said("id", F.col("target"), 0), F.when(loop, said("loop", F.col("source"), 0)), F.when(untyped, said("untyped", F.col("source"), 0)),
    ))))
    counted = of_nodes.union(of_edges).groupBy("doc_id", "kind", "subject").agg(F.sum("node").alias("nodes"), F.count_if(F.col("node") == 0).alias("ends"))
    kind, twice = F.col("kind"), F.col("nodes") > 1
    # an unknown end is no node's
    dangling = (F.col("ends") > 0) & ((F.col("nodes") == 0) | F.col("subject").isNull())
    issues = {"duplicate_id": (kind == "id") & twice, "duplicate_label": (kind == "label") & twice, "dangling_end": (kind == "id") & dangling, "self_loop": kind == "loop", "empty_type": kind == "untyped"}
    out = counted.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, issue) for issue, c in issues.items()]))).alias("issue"), "subject")
    return out if allow_cycles else out.union(strong_components(edges, nodes).select("doc_id", F.lit("cycle"), "node"))


def build_graph(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, issues) of every document.

    Nodes and edges are those of merge_nodes() of all entities, then all concepts, and of their relations. A document's nodes
    stay in its row for the edges, which so cost one shuffle of the texts.
    """
    # concepts stand behind all entities, of which an array holds less than 2^31
    first = entities(corpus).withColumn("pos", F.col("pos").cast("long"))
    nodes = first.unionByName(concepts(corpus).withColumn("pos", F.col("pos").cast("long") + (1 << 32)))
    merged = _with_aliases(_merged(nodes)[1])
    own = lambda labels, to_id, begin: F.flatten(F.transform("texts", lambda t: F.transform(labels(t), lambda l, i: F.struct((i + F.lit(begin)).alias("pos"), l.alias("label"), to_id(l).alias("id")))))
    rows = _one_row(corpus).select("doc_id", _sentences().alias("sentences"), F.sort_array(F.concat(own(_entity_labels, slugify, 0), own(_concept_labels, lambda l: l, 1 << 32))).alias("nodes"))
    rows = rows.select("doc_id", "sentences", "nodes.pos", "nodes.label", "nodes.id", F.transform("nodes", lambda n: normalize_label(n.label)).alias("keys"))
    edges = _followed(rows, _merged_names)
    return merged, edges, graph_issues(merged, edges)


def chapter_rows(nodes: DataFrame) -> DataFrame:
    """Chapters of trees (doc_id, node_id, parent_id, type, label, pos): unit and section are the nearest labelled ancestors.

    chapter_number counts within the unit in document order, unit_number counts units by first appearance.
    """
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("label").alias("unit"), F.col("parent_id").alias("grand"))
    top = nodes.select("doc_id", F.col("node_id").alias("grand"), F.col("label").alias("section"))
    rows = nodes.where("type = 'chapter'").join(up, ["doc_id", "parent_id"], "left").join(top, ["doc_id", "grand"], "left")
    first = F.min("pos").over(Window.partitionBy("doc_id", "unit"))
    rows = rows.withColumn("first", first)
    return rows.select("doc_id", "section", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")).alias("unit_number"), "unit", F.row_number().over(Window.partitionBy("doc_id", "unit").orderBy("pos")).alias("chapter_number"), F.col("label").alias("chapter"))
