"""Pair scores by blocks and outside passages by their rarest runs, against all pairs of small tables."""

import random

import pytest
from inkwell.operators import manuscript as m


def word_sets(paragraphs):
    return [set(p.lower().split()) for p in paragraphs]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def manuscripts(seed, n_documents=12):
    r, out = random.Random(seed), {}
    for d in range(n_documents):
        base = [" ".join(f"Word{r.randrange(60)}" for _ in range(12)) for _ in range(4)]
        out[d] = [r.choice(base) + r.choice(["", " end", " more and more words"]) for _ in range(r.choice([0, 1, 2, 7, 23]))]
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_pair_scores_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    documents = manuscripts(block)
    corpus = spark.createDataFrame([(d, "\n".join(ps)) for d, ps in documents.items()] + [(99, None), (100, "short")], "doc_id long, text string").repartition(3)
    sets = {d: word_sets(ps) for d, ps in documents.items()}
    expected = {(d, i + 1, j + 1): jaccard(a, b) for d, own in sets.items() for j, b in enumerate(own) for i, a in enumerate(own[:j])}
    for paras in (m.sized_paragraphs(corpus), m.paragraphs(corpus)):
        got = {(r.doc_id, r.i, r.j): r.similarity for r in m.pair_similarity(paras).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in expected)
        totals = {r.doc_id: r for r in m.pair_totals(paras).collect()}
        assert set(totals) == {d for d, ps in documents.items() if len(ps) > 1}
        for d, row in totals.items():
            own = [v for (doc, _, _), v in expected.items() if doc == d]
            assert (row.n_pairs, row.n_flagged) == (len(own), sum(v > 0.75 for v in own)) and abs(row.pair_sum - sum(own)) < 1e-9
    paras = m.sized_paragraphs(corpus)
    assert m.originality(corpus, paras, m.pair_totals(paras)).orderBy("doc_id").collect() == m.originality(corpus, paras, m.pair_similarity(paras)).orderBy("doc_id").collect()
    assert m.redundancy(corpus, paras, m.pair_totals(paras)).orderBy("doc_id").collect() == m.redundancy(corpus, paras, m.pair_similarity(paras)).orderBy("doc_id").collect()


def test_no_join_makes_pairs(spark):
    corpus = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = m.pair_totals(m.sized_paragraphs(corpus))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def contained(paragraph, passages, above, max_docs):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    mine, best = runs(paragraph), None
    for item, text in passages:
        own = runs(text)
        counted = {x for x in own if max_docs is None or sum(x in runs(t) for _, t in passages) <= max_docs}
        share = len(mine & counted) / len(own) if own else 0
        if share > above and (best is None or (-share, item) < best):
            best = (-share, item)
    return best


@pytest.mark.parametrize(("above", "max_docs"), [(0.75, None), (0.5, None), (0.2, 1), (0.8, 2), (0.0, None)])
def test_external_matches_equal_all_passages(spark, above, max_docs):
    r = random.Random(8)
    passages = [(i, " ".join(f"p{r.randrange(40)}" for _ in range(r.choice([3, 5, 9, 14, 24])))) for i in range(25)]
    passages += [(30, passages[4][1]), (31, passages[5][1] + " tail of words that differ"), (32, None), (33, "")]
    known = [(i, t) for i, t in passages if t]
    rows = []
    for k in range(150):
        words = r.choice(known)[1].split()
        cut = r.randrange(len(words))
        text = " ".join(words[cut:] + [f"q{r.randrange(9)}"] * r.randrange(4) + words[: r.choice([cut, len(words)])] + r.choice(known)[1].split()[: r.randrange(20)])
        rows.append((k % 20, k, r.choice([text, text.upper()])))
    got = m.external_matches(spark.createDataFrame(rows, "doc_id int, ordinal int, paragraph string"), spark.createDataFrame(passages, "item_id int, text string"), max_docs=max_docs, above=above)
    expected = {(d, o): best for d, o, t in rows if (best := contained(t, known, above, max_docs))}
    assert {(x.doc_id, x.ordinal): (round(-x.containment, 9), x.item_id) for x in got.collect()} == {k: (round(c, 9), i) for k, (c, i) in expected.items()}
    assert expected


@pytest.mark.parametrize("block", [3, 256])
def test_totals_of_texts_equal_those_of_paragraphs(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    odd = [(90, None), (91, ""), (92, "short"), (93, "\n".join(["\t " + "wide gaps \t in \v a line that repeats" * 3 + " \r", " " * 80, "gaps in a wide line, and \u00c4\u00d6\u00dc \u4e2d\u6587" * 3])), (94, "one paragraph of more than fifty characters, and no other one")]
    corpus = spark.createDataFrame([(d, "\n".join(ps)) for d, ps in manuscripts(block).items()] + odd, "doc_id long, text string").repartition(3)
    paras = m.sized_paragraphs(corpus)
    listed = lambda df: [(r.doc_id, r.has_text, r.n, round(r.pair_sum, 9), r.n_pairs, r.n_flagged) for r in df.orderBy("doc_id").collect()]
    assert listed(m.text_totals(corpus)) == listed(m._by_document(corpus, paras, m.pair_totals(paras)))
    assert m.manuscript_report(corpus, ["The"]).where("doc_id = 93").first().redundancy_score == round(listed(m.text_totals(corpus))[-2][3], 2)


def test_word_sets_stay_with_their_document(spark):
    """Only the few texts that may hold over BLOCK paragraphs are shuffled as sets."""
    plan = m.text_totals(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("RepartitionByExpression")
    assert len(below) == 2 and f"> {m.BLOCK * m.MIN_PARAGRAPH}" in below[1]


def test_authorship_of_many_sentences(spark):
    """25 n^2 of 10,000 sentences is no int."""
    rows = m.ai_authorship(spark.createDataFrame([(1, "One two. " * 10_000), (2, " . ! \t ? a\tb.\nc  d")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.sentences, r.ai_likelihood_score) for r in rows] == [(10_000, 1.0), (2, 0.3)]


def test_lines_are_looked_at_where_a_marker_is(spark):
    corpus = spark.createDataFrame([(1, None), (2, ""), (3, "no marker"), (4, "a\nINTRODUCTION\n" + "w " * 60 + "\nConclusion: in conclusion"), (5, "introduction")], "doc_id long, text string")
    got = {r.doc_id: (r.readiness_status, r.issues, r.strengths) for r in m.editorial(corpus).collect()}
    assert got == {
        1: ("Unknown", "", ""), 2: ("Unknown", "", ""), 3: ("Ready for Copyediting", "Poor structure", "Content shows some specificity"),
        4: ("Ready for Copyediting", "", "Introduction provides context; Conclusion summarizes key ideas; Content shows some specificity"),
        5: ("Needs Structural Editing", "Weak introduction; Poor structure", "Content shows some specificity"),
    }
    assert "introduction" in m.editorial(corpus)._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1].split("Filter")[-1]
