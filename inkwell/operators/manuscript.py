"""Manuscript analytics: originality, redundancy, authorship, editorial state, structure and submission score.

Each operator takes a corpus (doc_id, text) and gives one row per document, or per paragraph or pair of paragraphs. All
work inside a document is arrays or windows keyed by doc_id, so a corpus is only ever shuffled by its documents.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp, compacted, occurrences, present, py_round, strip, word_count, words

MIN_PARAGRAPH = 50
FLAG_ABOVE = 0.75
#: Paragraphs of a document that are compared with as many others in one group.
BLOCK = 256
#: What counts as white space. Splitting at one of them, and not at a pattern, compiles none for each of many short texts.
SPACE = " \t\n\v\f\r"
#: Fixed values
TERM_GROUPS = [["ai system", "ml engine", "artificial intelligence"], ["model", "algorithm", "system"]]
GENERIC_PHRASES = ["in today's world", "it is important to note", "this highlights"]


def paragraphs(corpus: DataFrame, min_chars: int = MIN_PARAGRAPH) -> DataFrame:
    """Trimmed lines longer than ``min_chars``, numbered from 1 within their document: doc_id, ordinal, paragraph."""
    return sized_paragraphs(corpus, min_chars).drop("n")


def sized_paragraphs(corpus: DataFrame, min_chars: int = MIN_PARAGRAPH) -> DataFrame:
    """paragraphs() with n, how many its document has."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p: F.btrim(p, F.lit(SPACE))), lambda p: F.length(p) > min_chars)
    # a column of its own, so that it is worked out once a row
    split = corpus.select("doc_id", F.explode(F.array(lines)).alias("lines"))
    return split.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "paragraph")).select("doc_id", (F.col("at") + 1).alias("ordinal"), "paragraph", "n")


def _in_blocks(paras: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on the word sets of every pair of blocks of a document's paragraphs, each of at most ``BLOCK`` of them.

    A document of up to ``BLOCK`` paragraphs is one group; a larger one is spread over as many as it has pairs of blocks. work gets
    a group's key, the ordinals and sides (0, or 1 for the second of two blocks), and for each paragraph its set's size and word
    numbers, and gives columns.
    """
    if "n" not in paras.columns:
        paras = paras.join(paras.groupBy("doc_id").agg(F.max("ordinal").alias("n")), "doc_id")
    sets = paras.select("doc_id", "ordinal", F.array_distinct(words(F.lower("paragraph"))).alias("words"), F.expr(f"(ordinal - 1) div {BLOCK}").cast("int").alias("mine"), F.expr(f"(n - 1) div {BLOCK}").cast("int").alias("last"))
    met = sets.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    keyed = met.select("doc_id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "ordinal", "words")
    names = [c.split()[0] for c in schema.split(", ")]

    def stream(batches):
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            if rows.num_rows < 2:
                return None
            lists = rows.column("words").chunk(0)
            sizes = np.diff(lists.offsets.to_numpy())
            numbers = lists.flatten().dictionary_encode().indices.to_numpy()
            found = work(rows.column("ordinal").to_numpy(), rows.column("side").to_numpy(), sizes, numbers)
            key = pa.array([rows.column("doc_id")[0].as_py()] * len(found[0]), rows.schema.field("doc_id").type)
            return pa.RecordBatch.from_arrays([key, *found], names=names) if len(found[0]) else None

        key, parts = None, []
        for batch in batches:
            keys, begin = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "i", "j")))), 0
            for at in [*(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]:
                if at > begin:
                    if parts and keys[begin] != key:
                        if (out := done(parts)) is not None:
                            yield out
                        parts = []
                    key = keys[begin]
                    parts.append(batch.slice(begin, at - begin))
                begin = at
        if parts and (out := done(parts)) is not None:
            yield out

    return keyed.repartition("doc_id", "i", "j").sortWithinPartitions("doc_id", "i", "j", "side", "ordinal").mapInArrow(stream, schema)


@lru_cache(64)
def _corner(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of n, which documents of one size share."""
    return np.triu_indices(n, 1)


def _similarities(sides: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, similarity) of a block's pairs, or of those between two blocks."""
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    a, b = _corner(n) if not sides.any() else (x.ravel() for x in np.meshgrid(np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), indexing="ij"))
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(numbers, kind="stable")
    owner, numbers = owner[order], numbers[order]
    for begin in range(0, int(numbers[-1]) + 1 if len(numbers) else 0, 8192):
        low, high = np.searchsorted(numbers, (begin, begin + 8192))
        has = np.zeros((n, int(numbers[high - 1]) - begin + 1), dtype=np.float32)
        has[owner[low:high], numbers[low:high] - begin] = 1
        both += has @ has.T
    common = both[a, b].astype(np.float64)
    return a, b, common / np.maximum(sizes[a] + sizes[b] - common, 1)


def _pair_rows(ordinals: np.ndarray, sides: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[pa.Array]:
    a, b, similarity = _similarities(sides, sizes, numbers)
    return [pa.array(ordinals[a]), pa.array(ordinals[b]), pa.array(similarity)]


def _pair_sums(ordinals: np.ndarray, sides: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[pa.Array]:
    _, _, similarity = _similarities(sides, sizes, numbers)
    return [pa.array([float(similarity.sum())]), pa.array([len(similarity)], pa.int64()), pa.array([int((similarity > FLAG_ABOVE).sum())], pa.int64())]


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def pair_similarity(paras: DataFrame, metric: str = "jaccard") -> DataFrame:
    """All pairs i < j of a document's paragraphs: doc_id, i, j, similarity.

    ``jaccard`` compares sets of lower-case words, by products of blocks; ``levenshtein`` is one minus the distance over the longer
    length, and ``ratio`` the matching-blocks ratio, which has no native form and depends on the order of the two. paras may
    carry n (sized_paragraphs), which else is counted.
    """
    if metric == "jaccard":
        return _in_blocks(paras, _pair_rows, f"doc_id {dict(paras.dtypes)['doc_id']}, i int, j int, similarity double")
    left, right = paras.select("doc_id", F.col("ordinal").alias("i"), F.col("paragraph").alias("a")), paras.select("doc_id", F.col("ordinal").alias("j"), F.col("paragraph").alias("b"))
    pairs = left.join(right, "doc_id").where("i < j")
    similarity = {
        "levenshtein": lambda: 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")),
        "ratio": lambda: F.pandas_udf(_ratio, "double")("a", "b"),
    }[metric]()
    return pairs.select("doc_id", "i", "j", similarity.alias("similarity"))


def pair_totals(paras: DataFrame, metric: str = "jaccard") -> DataFrame:
    """Sums over the pairs of pair_similarity(), for scores that need no pair: doc_id, pair_sum, n_pairs, n_flagged."""
    if metric == "jaccard":
        blocks = _in_blocks(paras, _pair_sums, f"doc_id {dict(paras.dtypes)['doc_id']}, pair_sum double, n_pairs long, n_flagged long")
        return blocks.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("pair_sum", "n_pairs", "n_flagged")])
    return pair_similarity(paras, metric).groupBy("doc_id").agg(F.sum("similarity").alias("pair_sum"), F.count("*").alias("n_pairs"), F.count_if(F.col("similarity") > FLAG_ABOVE).alias("n_flagged"))


def _by_document(corpus: DataFrame, paras: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, has_text, n (paragraphs), pair_sum, n_pairs, n_flagged; pairs are those of pair_similarity() or pair_totals()."""
    counted = paras.groupBy("doc_id").agg(F.count("*").alias("n"))
    summed = pairs
    if "similarity" in pairs.columns:
        summed = pairs.groupBy("doc_id").agg(F.sum("similarity").alias("pair_sum"), F.count("*").alias("n_pairs"), F.count_if(F.col("similarity") > FLAG_ABOVE).alias("n_flagged"))
    filled = {"n": 0, "pair_sum": 0.0, "n_pairs": 0, "n_flagged": 0}
    return corpus.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text")).join(counted, "doc_id", "left").join(summed, "doc_id", "left").fillna(filled)


def _plain_words(c: Column) -> Column:
    """words() of a text whose white space is only spaces."""
    return F.array_remove(F.split(c, " "), "")


def text_totals(corpus: DataFrame) -> DataFrame:
    """What _by_document() tells, straight from the texts: doc_id, has_text, n, pair_sum, n_pairs, n_flagged.

    The word sets of a document of up to ``BLOCK`` paragraphs stay in its row, which is not shuffled; a larger one goes through
    pair_totals().
    """
    held = corpus.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), F.explode(F.array(F.split(F.regexp_replace("text", r"[\t\x0B\f\r]", " "), "\n"))).alias("lines"))
    lines = F.filter("lines", lambda p: (F.length(p) > MIN_PARAGRAPH) & (F.length(F.btrim(p)) > MIN_PARAGRAPH))
    held = held.select("doc_id", "has_text", F.explode(F.array(lines)).alias("lines")).select("doc_id", "has_text", F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n"), "lines")
    sets = F.when(F.col("n").between(2, BLOCK), F.transform("lines", lambda p: F.array_distinct(_plain_words(F.lower(p))))).alias("sets")
    kind = dict(corpus.dtypes)["doc_id"]

    def stream(batches):
        for batch in batches:
            held = batch.column("sets")
            documents = held.offsets.to_numpy()
            sets = held.values
            words = sets.offsets.to_numpy()
            numbers = sets.values.slice(words[0], words[-1] - words[0]).dictionary_encode().indices.to_numpy() if len(words) > 1 else np.zeros(0, np.int32)
            sums = np.zeros(len(held)), np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            for k in np.flatnonzero(np.diff(documents)):
                at = words[documents[k] : documents[k + 1] + 1]
                own = np.unique(numbers[at[0] - words[0] : at[-1] - words[0]], return_inverse=True)[1]
                sizes = np.diff(at)
                _, _, similarity = _similarities(np.zeros(len(sizes), np.int32), sizes, own)
                sums[0][k], sums[1][k], sums[2][k] = similarity.sum(), len(similarity), (similarity > FLAG_ABOVE).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "has_text", "n")), *(pa.array(x) for x in sums)], names=["doc_id", "has_text", "n", "pair_sum", "n_pairs", "n_flagged"])

    rows = held.select("doc_id", "has_text", "n", sets).mapInArrow(stream, f"doc_id {kind}, has_text boolean, n long, pair_sum double, n_pairs long, n_flagged long")
    # a text of no more characters has no more paragraphs
    large = sized_paragraphs(corpus.where(F.length("text") > BLOCK * MIN_PARAGRAPH)).where(F.col("n") > BLOCK)
    sums = ["pair_sum", "n_pairs", "n_flagged"]
    return rows.join(pair_totals(large).select("doc_id", *[F.col(c).alias(f"large_{c}") for c in sums]), "doc_id", "left").select("doc_id", "has_text", "n", *[F.coalesce(f"large_{c}", c).alias(c) for c in sums])


def _originality_score() -> Column:
    mean = (F.col("pair_sum") + F.col("external")) / (F.col("n_pairs") + F.col("n"))
    return F.when(~F.col("has_text"), 0.0).when(F.col("n") < 2, 1.0).otherwise(py_round(1 - mean, 2))


def _redundancy_score() -> Column:
    return F.when(F.col("n_pairs") > 0, py_round(F.col("pair_sum") / F.col("n_pairs"), 2)).otherwise(0.0)


def originality(corpus: DataFrame, paras: DataFrame, pairs: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """doc_id, originality_score, risk_level, n_flagged.

    One minus the mean of all pair scores and of one external score per paragraph (0 unless ``external``, doc_id and
    similarity, says otherwise). Fewer than two paragraphs: 1.0 and Low; empty text: 0.0 and High.
    """
    rows = _by_document(corpus, paras, pairs)
    if external is None:
        rows = rows.withColumns({"external": F.lit(0.0), "n_external": F.lit(0)})
    else:
        found = external.groupBy("doc_id").agg(F.sum("similarity").alias("external"), F.count_if(F.col("similarity") > FLAG_ABOVE).alias("n_external"))
        rows = rows.join(found, "doc_id", "left").fillna({"external": 0.0, "n_external": 0})
    score = F.col("originality_score")
    return rows.select("doc_id", _originality_score().alias("originality_score"), (F.col("n_flagged") + F.col("n_external")).alias("n_flagged")).select(
        "doc_id", "originality_score", F.when(score > 0.8, "Low").when(score > 0.5, "Moderate").otherwise("High").alias("risk_level"), "n_flagged"
    )


def redundancy(corpus: DataFrame, paras: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, redundancy_score (mean of the pair scores, 0 without pairs), n_duplicates."""
    return _by_document(corpus, paras, pairs).select("doc_id", _redundancy_score().alias("redundancy_score"), F.col("n_flagged").alias("n_duplicates"))


def external_matches(paras: DataFrame, sources: DataFrame, shingle: int = 5, max_docs: int | None = None, above: float = FLAG_ABOVE) -> DataFrame:
    """Paragraphs that hold most of an outside passage's runs of words: doc_id, ordinal, item_id, containment.

    Containment is the share of the different runs of ``shingle`` words of a passage (item_id, text) that the paragraph has; each
    paragraph keeps its best passage, ties to the smaller id. A run that more than ``max_docs`` passages share is not counted as
    shared if that is given.

    A paragraph with more than a share c of a passage's n runs lacks fewer than (1 - c) n of them, so it has one of any n - cn of
    them: only the passage's rarest runs, so many, are looked for (by hash), and the paragraphs that have one are compared with
    the passage's runs themselves.
    """

    def split(rows: DataFrame, text: str) -> DataFrame:
        # the words are a column of their own, so that they are split once a row, and not once a run
        return rows.select("*", F.explode(F.array(words(F.lower(text)))).alias("_words")).where(F.size("_words") >= shingle)

    def runs() -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_words") - shingle), lambda i: F.concat_ws(" ", F.slice("_words", i + 1, shingle))))

    def hashes(rows: DataFrame, text: str, *keys: str) -> DataFrame:
        """keys and the different runs' hashes, made of the words' hashes, so that no run is written out."""
        hashed = split(rows, text).select(*keys, F.explode(F.array(F.transform("_words", lambda w: F.xxhash64(w)))).alias("_hashes"))
        every = F.transform(F.sequence(F.lit(0), F.size("_hashes") - shingle), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(shingle)]))
        return hashed.select(*keys, F.explode(F.array_distinct(every)).alias("hash"))

    passages = split(sources.select("item_id", "text"), "text").select("item_id", F.explode(F.array(runs())).alias("runs")).select("item_id", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    shared_by = passages.groupBy("run").agg(F.count("*").alias("c"))
    ranked = passages.join(shared_by if max_docs is None else shared_by.where(F.col("c") <= max_docs), "run")
    own = Window.partitionBy("item_id")
    ranked = ranked.withColumns({"rank": F.row_number().over(own.orderBy("c", "run")), "kept": F.count("*").over(own)})
    rarest = ranked.where(F.col("rank") <= F.col("kept") - F.floor(above * F.col("n") - 1e-9)).select("item_id", F.split("run", " ").alias("w"))
    rarest = rarest.select("item_id", F.xxhash64(*[F.xxhash64(F.get("w", F.lit(k))) for k in range(shingle)]).alias("hash"))
    whole = ranked.groupBy("item_id").agg(F.first("n").alias("n"), F.collect_list("run").alias("passage"))
    met = hashes(paras.select("doc_id", "ordinal", "paragraph"), "paragraph", "doc_id", "ordinal").join(rarest, "hash").select("doc_id", "ordinal", "item_id").distinct()
    texts = split(met.join(paras.select("doc_id", "ordinal", "paragraph"), ["doc_id", "ordinal"]), "paragraph").select("doc_id", "ordinal", "item_id", runs().alias("runs"))
    shared = texts.join(whole, "item_id").select("doc_id", "ordinal", "item_id", (F.size(F.array_intersect("runs", "passage")) / F.col("n")).alias("containment")).where(F.col("containment") > above)
    best = Window.partitionBy("doc_id", "ordinal").orderBy(F.desc("containment"), "item_id")
    return shared.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def terminology_issues(corpus: DataFrame, groups: list[list[str]] | None = None) -> DataFrame:
    """doc_id, n_issues, issues: groups of synonyms of which a text uses more than one."""
    text = F.lower(F.coalesce("text", F.lit("")))
    each = [F.get(F.transform(F.array(present(text, g)), lambda p: F.when(F.size(p) > 1, F.concat(F.lit("Inconsistent usage: "), F.array_join(p, ", ")))), F.lit(0)) for g in groups or TERM_GROUPS]
    return corpus.select("doc_id", compacted(*each).alias("found")).select("doc_id", F.size("found").alias("n_issues"), F.array_join("found", "; ").alias("issues"))


def ai_authorship(corpus: DataFrame) -> DataFrame:
    """doc_id, sentences, ai_likelihood_score, classification, signals, confidence.

    Signals: population deviation of sentence lengths below 5, lexical diversity below 0.5, repetition above 0.5.
    """
    flat = corpus.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), F.explode(F.array(F.regexp_replace("text", r"[\t\n\x0B\f\r]", " "))).alias("flat"))
    # a sentence without words is none
    lengths = F.filter(F.transform(F.split("flat", "[.!?]"), lambda s: F.size(_plain_words(s))), lambda n: n > 0)
    rows = flat.select("doc_id", "has_text", F.explode(F.array(lengths)).alias("lengths"), _plain_words(F.col("flat")).alias("words"))
    n = F.size("lengths").cast("long")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    # n^2 * variance is a whole number, so the comparison with 5 is exact; 25 n^2 outgrows an int at 9268 sentences
    low_variance = (n <= 1) | ((n * squares - total * total) < 25 * n * n)
    rows = rows.select("doc_id", "has_text", F.size("lengths").alias("sentences"), low_variance.alias("even"), F.size("words").alias("total"), F.size(F.array_distinct("words")).alias("unique"))
    diversity = F.when(F.col("total") > 0, F.col("unique") / F.col("total")).otherwise(0.0)
    even, poor, repeated = F.col("even"), diversity < 0.5, (1 - diversity) > 0.5
    score = F.when(even, 0.3).otherwise(0.0) + F.when(poor, 0.3).otherwise(0.0) + F.when(repeated, 0.4).otherwise(0.0)
    signals = compacted(F.when(poor, F.lit("Low lexical diversity")), F.when(even, F.lit("Low sentence variation")), F.when(repeated, F.lit("Repetitive phrasing")))
    rows = rows.select("doc_id", "has_text", "sentences", F.least(score, F.lit(1.0)).alias("score"), F.array_join(signals, "; ").alias("signals"))
    known = F.col("has_text")
    return rows.select(
        "doc_id", "sentences", F.when(known, py_round(F.col("score"), 2)).otherwise(0.0).alias("ai_likelihood_score"),
        F.when(~known, "Unknown").when(F.col("score") > 0.75, "High AI Generation Likely").when(F.col("score") > 0.5, "Moderate AI Assistance Likely").otherwise("Likely Human-Written").alias("classification"),
        F.when(known, F.col("signals")).otherwise("").alias("signals"),
        F.when(known, py_round(F.least(F.lit(1.0), F.col("score") + 0.1), 2)).otherwise(0.0).alias("confidence"),
    )


def sections(corpus: DataFrame) -> DataFrame:
    """doc_id, section, lines, words, in_conclusion: a line with 'introduction' or 'conclusion' begins that section anew."""
    lines = corpus.where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    low = F.lower("line")
    marker = F.when(F.contains(low, F.lit("introduction")), "Introduction").when(F.contains(low, F.lit("conclusion")), "Conclusion")
    order = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("marker", marker)
    lines = lines.select("doc_id", "line", F.sum(F.col("marker").isNotNull().cast("int")).over(order).alias("part"), F.coalesce(F.last("marker", True).over(order), F.lit("General")).alias("section"))
    parts = lines.groupBy("doc_id", "section", "part").agg(F.count("*").alias("lines"), F.sum(word_count("line")).alias("words"), F.bool_or(F.contains(F.lower("line"), F.lit("in conclusion"))).alias("in_conclusion"))
    newest = F.max(F.struct("part", "lines", "words", "in_conclusion")).alias("s")
    found = parts.groupBy("doc_id", "section").agg(newest).select("doc_id", "section", "s.lines", "s.words", "s.in_conclusion")
    # A text that begins with a marker still has its (empty) general section.
    empty = found.groupBy("doc_id").agg(F.bool_or(F.col("section") == "General").alias("there")).where("not there")
    blank = empty.select("doc_id", F.lit("General").alias("section"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("in_conclusion"))
    return found.unionByName(blank)


def editorial(corpus: DataFrame) -> DataFrame:
    """doc_id, readiness_status, n_issues, issues, strengths.

    A text without a marker is one general section, so that only the lines of others are looked at.
    """
    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("section") == name, F.col(value)))

    marked = corpus.where(F.contains(F.lower("text"), F.lit("introduction")) | F.contains(F.lower("text"), F.lit("conclusion")))
    facts = sections(marked).groupBy("doc_id").agg(F.count("*").alias("n"), of("Introduction", "words").alias("intro"), of("Conclusion", "words").alias("end"), of("Conclusion", "in_conclusion").alias("said"))
    held = corpus.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), F.explode(F.array(F.lower("text"))).alias("low"))
    generic = sum((F.when(F.contains("low", F.lit(p)), occurrences(F.col("low"), p)).otherwise(0.0) for p in GENERIC_PHRASES), F.lit(0.0))
    rows = held.select("doc_id", "has_text", (generic > 3).alias("generic")).join(facts, "doc_id", "left").withColumn("n", F.coalesce("n", F.when(F.col("has_text"), 1)))
    weak_end = ~F.col("said") & (F.col("end") < 50)
    issues = compacted(
        F.when(F.col("intro") < 50, F.lit("Weak introduction")), F.when(F.col("end").isNotNull() & weak_end, F.lit("Weak conclusion")),
        F.when(F.col("n") < 3, F.lit("Poor structure")), F.when(F.col("generic"), F.lit("Generic writing style")),
    )
    strengths = compacted(
        F.when(F.col("intro") >= 50, F.lit("Introduction provides context")), F.when(F.col("end").isNotNull() & ~weak_end, F.lit("Conclusion summarizes key ideas")),
        F.when(~F.col("generic"), F.lit("Content shows some specificity")),
    )
    rows = rows.select("doc_id", "has_text", issues.alias("issues"), strengths.alias("strengths"))
    status = F.when(~F.col("has_text"), "Unknown").when(F.size("issues") > 3, "Needs Major Editing").when(F.size("issues") > 1, "Needs Structural Editing").otherwise("Ready for Copyediting")
    shown = F.col("has_text")
    return rows.select("doc_id", status.alias("readiness_status"), F.when(shown, F.size("issues")).otherwise(0).alias("n_issues"), F.when(shown, F.array_join("issues", "; ")).otherwise("").alias("issues"), F.when(shown, F.array_join("strengths", "; ")).otherwise("").alias("strengths"))


def structure_template(column: Column | str) -> Column:
    """Section names of a template that is a JSON list or comma-separated text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(strip(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.transform(F.split(c, ","), strip))


def structure(corpus: DataFrame, required: list[str], order_mode: str = "reference") -> DataFrame:
    """doc_id, structure_score, sections_found, sections_missing, order_correct, completeness_percentage.

    ``reference``: the found sections are tested in the template's own order, so that without repeated names the order is
    always right; ``position``: their places in the text must ascend.
    """
    # a column of its own, so that it is worked out once a row, and not for every name
    held = corpus.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), F.explode(F.array(F.lower(F.coalesce("text", F.lit(""))))).alias("low"))
    names = F.array(*[F.lit(s) for s in required])
    found = compacted(*[F.when(F.contains("low", F.lower(F.lit(s))), F.lit(s)) for s in required])
    rows = held.select("doc_id", "has_text", found.alias("found"), F.transform(found, lambda s: F.instr("low", F.lower(s))).alias("places"))
    places = F.transform("found", lambda s: F.array_position(names, s)) if order_mode == "reference" else F.col("places")
    ascending = F.get(F.transform(F.array(places), lambda p: (F.size(p) <= 1) | F.forall(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.coalesce(F.get(p, i) > F.get(p, i - 1), F.lit(True)))), F.lit(0))
    complete = F.size("found") / len(required) * 100
    rows = rows.select("doc_id", "has_text", "found", ascending.alias("ordered"), complete.alias("complete"))
    score = clamp(F.col("complete") / 100 * 0.7 + F.when(F.col("ordered"), 0.3).otherwise(0.0))
    shown = F.col("has_text")
    return rows.select(
        "doc_id", F.when(shown, py_round(score, 2)).otherwise(0.0).alias("structure_score"), F.when(shown, F.array_join("found", ", ")).otherwise("").alias("sections_found"),
        F.when(shown, F.array_join(F.array_except(names, "found"), ", ")).otherwise("").alias("sections_missing"), (shown & F.col("ordered")).alias("order_correct"),
        F.when(shown, py_round(F.col("complete"), 2)).otherwise(0.0).alias("completeness_percentage"),
    )


def submission_score(*parts: DataFrame) -> DataFrame:
    """The results of all engines, joined, with submission_score, readiness_label, editing_effort, estimated_hours, recommended_action."""
    rows = reduce(lambda a, b: a.join(b, "doc_id"), parts)
    status = F.col("readiness_status")
    edited = F.when(status == "Ready for Copyediting", 0.9).when(status == "Needs Structural Editing", 0.6).when(status == "Needs Major Editing", 0.3).otherwise(0.5)
    score = F.col("originality_score") * 0.25 + (1 - F.col("ai_likelihood_score")) * 0.15 + edited * 0.25 + F.col("structure_score") * 0.20 + (1 - F.col("redundancy_score")) * 0.15
    s = F.col("submission_score")

    def by_band(*values) -> Column:
        return F.when(s >= 85, values[0]).when(s >= 65, values[1]).when(s >= 45, values[2]).otherwise(values[3])

    return rows.select("*", (score * 100).cast("int").alias("submission_score")).withColumns({
        "readiness_label": by_band("Ready for Editing", "Needs Minor Revision", "Needs Structural Editing", "High Risk Submission"),
        "editing_effort": by_band("Low", "Medium", "High", "Very High"),
        "estimated_hours": by_band(5, 18, 30, 50),
        "recommended_action": by_band("Proceed to copyediting", "Proceed with copyediting after fixes", "Require structural revision before editing", "Reject or major rewrite required"),
    })


def manuscript_report(corpus: DataFrame, required: list[str], metric: str = "jaccard", order_mode: str = "reference") -> DataFrame:
    """One row per document with the results of all engines; the pairs are compared once for both scores made of them."""
    if metric == "jaccard":
        facts = text_totals(corpus)
    else:
        paras = sized_paragraphs(corpus)
        facts = _by_document(corpus, paras, pair_totals(paras, metric))
    facts = facts.withColumn("external", F.lit(0.0))
    compared = facts.select("doc_id", _originality_score().alias("originality_score"), _redundancy_score().alias("redundancy_score"))
    return submission_score(compared, ai_authorship(corpus), editorial(corpus), structure(corpus, required, order_mode))
