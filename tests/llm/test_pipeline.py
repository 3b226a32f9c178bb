"""The pipeline against its stages done by hand on a small corpus."""

import os
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from inkwell.llm import pii
from tokenizers import Tokenizer

from .test_operators import brute_repeats, shingles


def words(seed, n, syllables):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(n))


def test_pipeline(spark, tmp_path):
    a, z = ["ba", "bo", "bi", "du"], ["kro", "gla", "tru", "pfe"]
    rows = [(i, words(i, 60, a if i % 2 else z), "aa" if i % 2 else "zz", "s", 0) for i in range(40)]
    rows += [(100, rows[3][1] + " end", "aa", "s", 0), (101, rows[3][1], "aa", "s", 0), (102, "12345 !!", "aa", "s", 0), (103, words(1000, 30, a) + " " + rows[5][1][:200] + " x@y.z", "aa", "s", 0), (104, None, "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    docs = [(i, t) for i, t, *_ in rows if i not in (102, 104)]
    sets = {i: shingles(t) for i, t in docs}
    docs = [(i, t) for i, t in docs if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j, _ in docs)]
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, text in docs:
        raw = text.encode()
        earlier = {t.encode()[s : s + 50] for j, t in docs if j < i for s in range(len(t.encode()) - 49)}
        gone = {k for s in range(len(raw) - 49) if raw[s : s + 50] in earlier for k in range(s, s + 50)}
        text = bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")
        if text.strip():
            expected[i] = len(tokenizer.encode(pii.redact(text, pii.all_spans(text, pii.plain_spans(text))), add_special_tokens=False).ids) + 1
    assert brute_repeats(docs[:2], 50)
    found = {}
    for r in got:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == expected and 103 in found and 100 not in found and 102 not in found
    assert np.sum(list(found.values())) == sum(r.length for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_only_the_last_kept_stage_stays_on_disk(spark, monkeypatch):
    made = []

    class Watched(corpus_pipeline.Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self.root.removeprefix("file://"))

    monkeypatch.setattr(corpus_pipeline, "Scratch", Watched)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert os.listdir(made[0]) == [str(len(corpus_pipeline.STAGES) - 2)]
