"""Each operator against a brute-force version, and on nulls, empty and repeated rows, empty tables and clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from inkwell.llm import bpe, components, graphdedup, hamming, hashing, langid, licenses, nearjoin, packing, pii, quality, suffix
from inkwell.llm.storage import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, labels string, spans int, found int, runs int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, rows):
    """Documents of (id, text[, lang]); the other columns have names that operators use too."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, None, 1, 2, None) for r in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " "), (None, "same text here"), (4, "same text here"), (4, "same text here"), (5, "é" * 300), (6, "x " * 20000)]


def by_id_list(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


def by_id(df, key="doc_id"):
    return by_id_list(df.collect(), key)


# --- licenses -------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    texts = {
        10: "Released under the MIT License.", 11: "LICENSED under the Apache License, Version 2.0; see CC-BY-NC 4.0", 12: "mit Lizenz", 13: "GNU General Public License, version 3. GPLv2 or later",
        14: "SPDX-License-Identifier: MIT", 15: "under\nthe\tMIT, license under the mit license", 16: "underthe mit license",
    }
    got = by_id(licenses.license_labels(documents(spark, [*ODD, *texts.items()])))
    assert got[10].labels == "mit" and got[10].base_labels == "mit" and got[10].first_word == 1 and got[10].score == 0.9
    assert got[11].base_labels == "apache-2,cc-by-nc" and "cc-by-nc-4.0" in got[11].labels and (got[11].first_word, got[11].last_word) == (3, 9)
    assert got[12].labels == "" and got[12].first_word is None and got[12].score == 0
    assert got[13].labels == "gpl-2,gpl-3"
    assert got[14].labels == "mit" and got[14].n_base == 0 and got[14].score == 1.0
    assert got[15].n_base == 2 and got[15].n_words == 8
    assert got[16].n_base == 0
    assert got[1].n_words == 0 and got[2].n_words == 0 and got[5].n_words == 1 and got[6].n_words == 20000
    assert licenses.license_labels(documents(spark, [])).count() == 0
    assert len(licenses.signature_rules()) > 300
    more = {
        30: ("Boost Software License 1.0", "boost-1"), 31: ("Business Source License 1.1", "busl-1.1"), 32: ("BSD 3-Clause", "bsd-3-clause"), 33: ("the two clause BSD license", "bsd-2-clause"), 34: ("Apache-2.0", "apache-2"),
        35: ("MIT licensed", "mit"), 36: ("SPDX-License-Identifier: LGPL-2.1-or-later OR MIT", "lgpl-2.1,mit"), 37: ("the gpl 3 times", ""), 38: ("Microsoft Public License", "ms-pl"), 39: ("is provided AS IS", ""),
        40: ("Everyone is permitted to copy and distribute verbatim copies of this license document", "gpl"),
    }
    got = by_id(licenses.license_labels(documents(spark, [(i, t) for i, (t, _) in more.items()])))
    assert {i: r.labels for i, r in got.items()} == {i: x for i, (_, x) in more.items()}


def test_license_suppression_matches_brute_force(spark):
    text = "gnu general public license version 2 then gnu general public license and spdx license identifier gpl 2 0 only"
    kept = licenses.license_scan(documents(spark, [(1, text)])).first().detections
    words = text.split()
    every = []
    for pattern, _, tier, label in licenses.signature_rules():
        rx = regex.compile(f"(?<= )(?:{pattern})(?= )")
        line = " " + text + " "
        every += [(line[: m.start()].count(" ") - 1, line[: m.start()].count(" ") - 1 + len(m[0].split()), tier, label) for m in rx.finditer(line)]
    every.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    expected = []
    for i, d in enumerate(every):
        if not any(e[1] >= d[1] and e[2] <= d[2] for e in every[:i]):
            expected.append(d)
    assert [(d.start, d.end, d.tier, d.label) for d in kept] == expected and len(words) > max(d[1] for d in expected) - 1


def test_every_license_rule_fires_on_its_own_phrase(spark):
    def phrase(pattern):
        pattern = re.sub(r"\(\?!.*\)$", "", pattern)
        before, pattern = ("spdx license identifier x or ", pattern.split(" )", 1)[1]) if pattern.startswith("(?<=") else ("", pattern)
        return before + plain(pattern)

    def plain(pattern):
        pattern = pattern.replace("[cs]", "c").replace("[0-4]", "3").replace("[^ ]+", "x").replace("(3)", "3").replace("share ?alike", "sharealike")
        while "(?:" in pattern:
            pattern = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], pattern)
        return " ".join(re.sub(r"[a-z ]\?", "", pattern).split())

    rules = licenses.signature_rules()
    phrases = [phrase(p) for p, *_ in rules]
    assert all((regex.search(f"{p}$", x) if p.startswith("(?<=") else re.fullmatch(p, x)) and k in x for (p, k, *_), x in zip(rules, phrases))
    rows = [(i, x.upper().replace(" ", (" ", "\n", "  ", ", ")[i % 4])) for i, x in enumerate(phrases)]
    got = by_id(licenses.license_scan(documents(spark, rows)))
    for i, (pattern, _, tier, label) in enumerate(rules):
        n = len(phrases[i].split())
        assert got[i].n_words == n and any(d.start == (5 if pattern.startswith("(?<=") else 0) and d.end == n and d.tier <= tier for d in got[i].detections), (pattern, label)
    short = {1: ("MPL 2.0", "mpl-2"), 2: ("EUPL 1.2", "eupl-1.2"), 3: ("BSD-3-Clause", "bsd-3-clause"), 4: ("GFDL 1.3", "gfdl-1.3"), 5: ("in the public\ndomain", "public-domain"), 6: ("neither the  name of x nor the names of its contributors", "bsd-3-clause")}
    labels = by_id(licenses.license_labels(documents(spark, [(i, t) for i, (t, _) in short.items()])))
    assert {i: r.labels for i, r in labels.items()} == {i: x for i, (_, x) in short.items()}


# --- nearest neighbours ---------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[500:505] = x[0]
    rows = [(i, v.tolist(), 0, None) for i, v in enumerate(x)]
    bad = [(1000, None, 0, None), (1100, [0.0] * 16, 0, None), (1200, [float("nan")] * 16, 0, None), (1300, [1.0] * 3, 0, None), (None, x[1].tolist(), 0, None), (7, x[7].tolist(), 0, None)]
    from pyspark.sql import functions as F

    got = hamming.nearest(vectors(spark, rows + bad), F.col("vec_id") % 100 == 0, 10, block_rows=200, block_queries=4).collect()
    found, hit = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 900, 100))
    for q, hits in found.items():
        hits.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        assert [h[0] for h in hits] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in hits)
        assert [(s, v) for _, v, s in hits] == sorted((s, v) for _, v, s in hits)
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        hit += len(set(order) & {v for _, v, _ in hits})
    assert hit / 90 >= 0.9
    assert [v for _, v, _ in sorted(found[0])][:5] == [500, 501, 502, 503, 504]
    few = hamming.nearest(vectors(spark, rows[:3]), F.col("vec_id") == 0, 10)
    assert few.count() == 2
    assert hamming.nearest(vectors(spark, []), F.col("vec_id") == 0, 10).count() == 0


def test_pigeonhole_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, size=(500, 4), dtype=np.uint8)
    codes[1] = codes[0] ^ np.array([1, 1, 3, 0], dtype=np.uint8)
    index = hamming.SubstringIndex(codes)
    for radius in (3, 4, 7, 11):
        apart = np.array([bin(int.from_bytes((c ^ codes[0]).tobytes(), "big")).count("1") for c in codes])
        assert set(index.within(codes[0], radius, 1)) == set(np.flatnonzero(apart <= radius))
    assert len(index.within(codes[0], 0, 500)) == 500


# --- languages ------------------------------------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(5)
    syllables = {"aa": ["ba", "bo", "bi"], "zz": ["kro", "gla", "tru"]}
    make = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(("aa", "zz")[i % 2], 30), ("aa", "zz")[i % 2]) for i in range(100, 160)]
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "123 !?", None), (4, make("zz", 4000), None), (None, make("aa", 9), "aa"), (5, "привет мир", None)]
    got = by_id(langid.identify(documents(spark, rows + odd)))
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[3].score == 0
    assert got[4].lang_pred == "zz" and all(0 <= r.score <= 1 for r in got.values())
    for i, row in got.items():
        assert row.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    kept = langid.recognised(documents(spark, rows + odd))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} | {4, None}
    assert langid.identify(documents(spark, [])).count() == 0
    assert langid.identify(documents(spark, [(1, "text", None)])).first().lang_pred == "und"


def test_out_of_place_distance_matches_brute_force(spark):
    r = random.Random(3)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efgha"}
    make = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(1, 6))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    profiles = langid.learn_profiles(documents(spark, rows))

    def distinct_grams(text):
        joined = " " + " ".join(text.split()) + " "
        return {joined[i : i + k] for k in (1, 2, 3) for i in range(len(joined) - k + 1) if joined[i : i + k].strip() and (k < 3 or joined[i + 1] != " ")}

    counts = {}
    for lang in letters:
        total = {}
        for _, t, x in rows:
            if x == lang:
                own, n = langid.gram_counts(t)
                for g, k in zip(own.tolist(), n.tolist()):
                    total[g] = total.get(g, 0) + k
        counts[lang] = {g: i for i, g in enumerate(sorted(total, key=lambda g: (-total[g], g if g < 1 << 63 else g - (1 << 64)))[: langid.PROFILE_GRAMS])}
    assert profiles.languages == sorted(letters)
    for _, text, _ in rows:
        own, n = langid.gram_counts(text)
        assert len(own) == len(distinct_grams(text))
        mine = [g for _, g in sorted(zip((-n).tolist(), own.tolist()))][: langid.DOCUMENT_GRAMS]
        distance = {lang: sum(min(abs(counts[lang][g] - i), langid.PROFILE_GRAMS) if g in counts[lang] else langid.PROFILE_GRAMS for i, g in enumerate(mine)) for lang in letters}
        best = min(sorted(letters), key=lambda lang: distance[lang])
        lang, score, _ = profiles.judge(text)
        assert lang == best and score == pytest.approx(1 - distance[best] / (langid.PROFILE_GRAMS * len(mine)))


def test_many_languages_stay_small(spark):
    """5,000 languages: profiles hold what the languages have, not a rank for every language and n-gram."""
    letters = [chr(0x4E00 + k) for k in range(10_000)]
    rows = [(k, " ".join(letters[2 * (k % 5000) + j % 2] + letters[2 * (k % 5000)] for j in range(4)), f"l{k % 5000}") for k in range(10_000)]
    profiles = langid.learn_profiles(documents(spark, rows))
    assert len(profiles.languages) == 5000
    assert sum(x.nbytes for x in (profiles.grams, profiles.begins, profiles.owners, profiles.ranks)) < 5000 * 20 * 40
    assert all(profiles.judge(t)[0] == lang for _, t, lang in rows[::500])
    with pytest.raises(ValueError, match="max_bytes"):
        langid.learn_profiles(documents(spark, rows), max_bytes=100_000)


def test_profiles_learn_from_a_bounded_number_of_documents_of_a_hot_language(spark, monkeypatch):
    rows = [(i, "hot words " + chr(97 + i % 26), "hot") for i in range(3000)] + [(5000 + i, "rare", f"r{i}") for i in range(600)]
    profiles = langid.learn_profiles(documents(spark, rows), docs_per_language=20)
    assert len(profiles.languages) == 601 and "r599" in profiles.languages


# --- repeated bytes -------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        earlier = {(t or "").encode()[s : s + length] for j, t in rows if i is not None and j is not None and j < i for s in range(len((t or "").encode()) - length + 1)}
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in earlier:
                covered[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((i, len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    r = random.Random(seed)
    shared = [prose(i, 14) for i in range(4)] + ["a" * 90, "ab" * 60]
    rows = [*ODD, (7, "same text here" * 9), (8, "same text here" * 9)]
    for i in range(20, 60):
        parts = [prose(1000 + i, r.randrange(0, 20)), r.choice(shared)[r.randrange(8) :], prose(2000 + i, r.randrange(0, 12)), r.choice(shared)]
        rows.append((i, r.choice([" ", "\n", ""]).join(parts)))
    rows += [(70, rows[-1][1]), (71, rows[-1][1]), (71, prose(9, 30)), (71, prose(9, 30) + "x")]
    rows = [(i, t[:2000] if t else t) for i, t in rows]
    got = suffix.repeat_digests(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_repeats(rows, 50)))
    kept = by_id(suffix.without_repeats(documents(spark, rows)))
    assert 70 not in kept and kept[1].text is None and kept[5].text == rows[6][1]
    assert suffix.repeat_digests(documents(spark, [])).count() == 0


def test_suffix_dedup_of_marks_with_many_continuations(spark):
    r, passage = random.Random(8), "the passage that every document holds many times, each time beside others"
    rows = [(i, "".join(prose(r.randrange(1 << 30), 3) + passage[r.randrange(9) : 73 - r.randrange(9)] for _ in range(40))) for i in (3, 1, 2, 7, 9)]
    assert sorted(map(tuple, suffix.repeat_digests(documents(spark, rows)).collect())) == sorted(brute_repeats(rows, 50))


def test_suffix_dedup_of_strings_that_end_in_every_round(spark):
    # common strings of 15 to 60 bytes between unique ones: some are unique with 16 bytes, some with 32, some with 50
    r = random.Random(5)
    token = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    common = [token() for _ in range(12)]
    rows = [(i, "".join(r.choice(common)[(a := r.randrange(20)) : a + r.randrange(15, 61)] + token()[: r.randrange(30)] for _ in range(60))) for i in r.sample(range(1000), 14)]
    brute = brute_repeats(rows, 50)
    assert sorted(map(tuple, suffix.repeat_digests(documents(spark, rows)).collect())) == sorted(brute) and any(0 < b[2] < b[1] for b in brute)


def test_suffix_dedup_leaves_columns_of_any_name_alone(spark):
    text = prose(3, 40)
    names = ["_id", "_text", "row", "handle", "at", "a", "b", "copy", "kept", "n_bytes", "spans", "name", "body"]
    docs = spark.createDataFrame([(1, text, *["mine"] * len(names)), (2, "x" + text + "yz", *["yours"] * len(names))], ["doc_id", "text", *names])
    kept = by_id(suffix.without_repeats(docs))
    assert kept[1].text == text and kept[2].text == "xyz" and all(kept[1][n] == "mine" and kept[2][n] == "yours" for n in names)
    full = by_id(suffix.repeated_bytes(docs))
    assert full[2].n_bytes == len(text) + 3 and full[2]["_id"] == "yours" and bytes(full[2].kept) == b"xyz"


def test_suffix_dedup_of_a_long_document_with_a_hot_mark(spark):
    r, passage = random.Random(2), "terms and conditions apply to all offers made on this page, see below"
    long = "".join(prose(r.randrange(1 << 30), 2, 5000) + passage for _ in range(3000))
    rows = [(5, long), (1, passage), (2, "z" + passage + long[:300]), (9, passage + long[1000:1200])]
    got = suffix.repeat_digests(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows, 50)) and by_id_list(got)[5].n_removed >= 3000 * len(passage)


def test_suffix_dedup_settles_hot_strings_before_the_shuffle(spark, monkeypatch):
    r, passage = random.Random(4), "notice: this passage stands in every document of the table, between words that differ"
    rows = [(r.choice([i, i, i - 1]), prose(i, r.randrange(6)) + passage[r.randrange(12) : 85 - r.randrange(12)] + prose(900 + i % 7, 9)) for i in range(2, 240, 2)]
    brute = sorted(map(str, brute_repeats(rows, 50)))
    for held in (suffix.HELD_BYTES, 500):
        monkeypatch.setattr(suffix, "HELD_BYTES", held)
        assert sorted(map(str, map(tuple, suffix.repeat_digests(documents(spark, rows).coalesce(1)).collect()))) == brute
    # a mark of 400 rows: its two outermost documents meet other tasks' rows, as do all rows of a mark of one document
    name, row = np.array([7] * 400 + [8, 9, 9]), np.array([*range(400), 5, 6, 7])
    rank = np.arange(400)
    rank[7] = rank[6]
    lane = suffix._lanes(name, row, rank)
    assert (lane[:400] == 0).sum() == 2 and len(set(lane[:400].tolist())) == 399 and not lane[400:].any()


@pytest.mark.parametrize("most", [8, 3])
def test_suffix_dedup_of_slices(spark, monkeypatch, most):
    """Rounds of a large input are done for one slice of names after the other, so that their shuffle files don't lie side by side."""
    r, passages = random.Random(6), [prose(i, 20) for i in range(9)]
    rows = [(i, " ".join(r.choice([prose(100 + i, 9), r.choice(passages)[r.randrange(30) :]]) for _ in range(6))) for i in range(40)]
    docs, met = documents(spark, rows).repartition(3), []
    monkeypatch.setattr(suffix, "MARKS_A_SLICE", 50)
    monkeypatch.setattr(suffix, "SLICES", most)
    round_1 = suffix._shared_marks
    monkeypatch.setattr(suffix, "_shared_marks", lambda marks: met.append({x.name for x in marks.select("name").collect()}) or round_1(marks))
    assert sorted(map(tuple, suffix.repeat_digests(docs).collect())) == sorted(brute_repeats(rows, 50))
    assert len(met) == most and max(map(len, met)) < 2 * len(set().union(*met)) / most and sum(map(len, met)) == len(set().union(*met))


# --- embedding graph ------------------------------------------------------------------------------------------------


def test_graph_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    near = [base[i % 40] + 0.02 * rng.normal(size=24) for i in range(120)] + [base[0] + 0.01 * rng.normal(size=24) for _ in range(60)]
    x = np.concatenate([base, near]).astype(np.float32)
    x[299] = x[298]
    rows = [(i, v.tolist(), 0, None) for i, v in enumerate(x)]
    bad = [(1000, None, 0, None), (1001, [0.0] * 24, 0, None), (1002, [float("inf")] * 24, 0, None), (None, x[0].tolist(), 0, None)]
    got = graphdedup.embedding_links(vectors(spark, rows + bad), shard_rows=64).collect()
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    component = np.arange(len(x))
    for _ in range(20):
        component = np.array([min([component[i], *component[link[i]]]) for i in range(len(x))])
    found = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + 4
    assert [found[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist() and [found[i].component_id for i in range(len(x))] == component.tolist()
    assert found[0].audit_recall == 1.0
    assert found[1000].n_links == 0 and found[1000].kept and found[1001].component_id == 1001
    assert graphdedup.embedding_links(vectors(spark, [])).count() == 0


def test_graph_audit_sees_rows_whose_links_were_all_lost(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24))
    rows = [(f"k{i}", 1, v.tolist()) for i, v in enumerate(x)] + [(f"n{i}", 1, (x[i] + 0.02 * rng.normal(size=24)).tolist()) for i in range(100)]
    classes = spark.createDataFrame(rows, "key string, weight long, v array<double>").repartition(4)
    for lost in (0, 60):
        links = spark.createDataFrame([(f"{side}{i}", 1) for side in "kn" for i in range(lost, 100)], "key string, others long")
        recall = graphdedup._audit(classes, links, len(rows), sample_rows=256, min_cosine=0.95)
        assert recall == 1.0 if not lost else 0.2 < recall < 0.6


def test_graph_audit_says_what_it_measured(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 32))
    rows = [(i, v.tolist(), 0, None) for i, v in enumerate(x)]
    assert graphdedup.embedding_links(vectors(spark, rows)).first().audit_recall is None
    # one pair among many: the sample of linked rows finds it
    found = graphdedup.embedding_links(vectors(spark, [*rows, (1000, (x[7] * 1.001 + 0.001).tolist(), 0, None)])).collect()
    assert found[0].audit_recall == 1.0 and sorted(r.vec_id for r in found if r.n_links) == [7, 1000]
    monkeypatch.setattr(graphdedup, "_audit", lambda *a, **k: 0.5)
    with pytest.raises(RuntimeError, match="0.500"):
        graphdedup.embedding_links(vectors(spark, rows))


# --- encoding and packing -------------------------------------------------------------------------------------------


def tiktoken_ids(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_bpe_in_chunks_equals_the_whole(spark):
    rows = [*ODD[:6], (10, "Hello  world\n\n it's 3½ <|endoftext|>\t\r\n x\x1c y 😀 中文 " * 9), (11, prose(1, 300)), (12, " " * 150 + "a" * 150 + "\n" * 90), (13, prose(1, 300))]
    got = bpe.bpe_ids(documents(spark, rows), RANKS, public_tokenizers.PATTERN, chunk_chars=100, overlap_chars=20).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert ids == tiktoken_ids(texts[r.doc_id] or "") and r.n_tokens == len(ids) and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    digest = by_id(bpe.bpe_digests(documents(spark, rows), RANKS, public_tokenizers.PATTERN))
    assert digest[2].n_tokens == 0 and digest[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[11].ids_sha256 == hashlib.sha256(",".join(map(str, tiktoken_ids(texts[11]))).encode()).hexdigest()
    assert bpe.bpe_digests(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_stitching_random_texts():
    coder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    pieces = [" ", "\n", "\t", "a", "The", " the", "'s", "1", "é", " ", "!", " ", "😀", "  ", "\r\n", "\x1c", "²", "中"]
    for _ in range(2000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(30, 80)))
        size, over = r.choice([(7, 3), (10, 9), (12, 1), (5, 4)])
        starts = range(0, max(len(text) - over, 1), size)
        chunks = [(s, text[s : s + size + over], np.fromiter(coder.boundaries(text[s : s + size + over]), dtype="<i8")) for s in starts]
        parts = bpe.stitch(chunks, coder)
        assert "".join(parts) == text and b"".join(coder.encode(parts)) == np.array(coder.bpe.encode_ordinary(text), "<u4").tobytes()


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*ODD, *((i, prose(i, i * 7 % 900)) for i in range(100, 180))]
    got = packing.pack_documents(documents(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, length=64, open_bins=8).collect()
    of, bins = {}, {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in rows:
        if i in (None, 4):
            continue
        ids, at = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (k == 0 or r.length == 64)
            at += r.length
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(of[4]) == 2 and len(of[None]) == 1
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 8 * 4
    assert packing.pack_documents(documents(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_packing_knows_the_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    r, parts = random.Random(4), ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " the", "'s", "é", "7", "<|", "<|ENDOFTEXT|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(300))]
    got = by_id(packing.pack_documents(documents(spark, list(enumerate(texts))), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].length, got[i].ids_crc32) == (0, len(ids), zlib.crc32(ids.tobytes())), text


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 3, 2)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8)]


# --- quality --------------------------------------------------------------------------------------------------------


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)) / 3
    index, value = quality.features("Some words, some more words.\nAnd a line")
    pairs = sum(float(v[i] @ v[j]) * a * b for k, (i, a) in enumerate(zip(index, value)) for j, b in list(zip(index, value))[k + 1 :])
    z = 0.3 + float(w[index] @ value) + pairs
    assert quality.FactorisationMachine(0.3, w, v).score(index, value) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality(spark):
    rows = [(i, prose(i, 60) if i % 2 else "BUY!! NOW!! " * 30) for i in range(200, 400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200, 400)] + [(None, 1, 0), (250, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judge_quality(documents(spark, rows + ODD), labels))
    assert np.mean([got[i].predicted == i % 2 for i, _ in rows]) > 0.95
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    again = by_id(quality.judge_quality(documents(spark, [*rows, *rows[:50], *ODD]), labels.union(labels.limit(100))))
    assert all(again[i].score == got[i].score for i, _ in rows)
    none = quality.judge_quality(documents(spark, [(1, "a")]), labels.where("quality > 5")).first()
    assert none.score == 0.5


def test_long_texts_are_learned_from(spark):
    """Texts of many different words count like others, and a sample bounded in features takes fewer of them."""
    r = random.Random(12)
    rows = [(i, " ".join(f"{'ok' if i % 2 else 'bad'}{r.randrange(9000)}" for _ in range(2500))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judge_quality(documents(spark, rows), labels))
    held = [x for x in got.values() if x.held_out]
    assert held and np.mean([(x.score > 0.5) == bool(x.doc_id % 2) for x in held]) > 0.8
    some = quality.learn(documents(spark, rows), labels, train_features=20_000)
    assert 0 < np.count_nonzero(some.w) < np.count_nonzero(quality.learn(documents(spark, rows), labels).w)


def test_fitted_interactions_equal_the_sum_over_pairs():
    """The sum-of-squares identity on a fitted machine, which tells its rows apart."""
    rows = [quality.features(t) for t in ("good words here", "bad things there", "good things", "bad words")]
    machine = quality.fit(rows, [1, 0, 1, 0])
    assert [machine.score(*x) > 0.5 for x in rows] == [True, False, True, False]
    index, value = rows[0]
    mixed = machine.v[index] * value[:, None]
    pairs = sum(float(mixed[a] @ mixed[b]) for a in range(len(index)) for b in range(a))
    assert 0.5 * float((mixed.sum(axis=0) ** 2 - (mixed**2).sum(axis=0)).sum()) == pytest.approx(pairs, rel=1e-3, abs=1e-5)



# --- near duplicates ------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("small_key", [1, 24])
def test_jaccard_join(spark, small_key):
    r = random.Random(9)
    rows = [*ODD]
    for family in range(6):
        words = prose(family, 120).split()
        for k in range(12):
            own = list(words)
            for _ in range(r.randrange(4)):
                own[r.randrange(120)] = f"x{family}{k}"
            rows.append((100 + family * 20 + k, " ".join(own)))
    rows += [(300, rows[-1][1].upper()), (301, "one two"), (302, "One, two!"), (303, prose(77, 200))]
    got = nearjoin.jaccard_links(documents(spark, rows), small_key=small_key, block=5).collect()
    sets = [shingles(t) for _, t in rows]
    known = [i is not None for i, _ in rows]
    link = [[known[a] and known[b] and a != b and bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(len(rows))] for a in range(len(rows))]
    component = [i for i, _ in rows]
    for _ in range(8):
        component = [min([component[a], *(component[b] for b in range(len(rows)) if link[a][b])]) if known[a] else None for a in range(len(rows))]
    expected = sorted((i if i is not None else -1, sum(link[a]), component[a] if known[a] else -1) for a, (i, _) in enumerate(rows))
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_links, x.component_id if x.component_id is not None else -1) for x in got) == expected
    kept = nearjoin.one_of_each(documents(spark, rows))
    assert {x.doc_id for x in kept.collect()} == {c for c in component if c is not None} | {None}
    assert nearjoin.jaccard_links(documents(spark, [])).count() == 0


def test_texts_of_one_id_do_not_stand_for_each_other(spark):
    """Rows with repeated doc_ids: every group of near copies keeps one text, and no unique text is lost."""
    r = random.Random(10)
    families = [prose(200 + k, 60) for k in range(6)]
    rows = [(1, families[0]), (5, families[0]), (5, families[1]), (7, families[1] + " end"), (5, families[2]), (5, families[2]), (7, families[0] + " end")]
    rows += [(r.randrange(20, 30), families[r.randrange(3, 6)] + r.choice(["", " end", " more"])) for _ in range(30)] + [(i, prose(300 + i, 40)) for i in (1, 5, 5, 7, 20)] + [(None, families[0]), (5, None)]
    sets = {t: shingles(t) for _, t in rows}
    near = lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for small_key in (1, 24):
        links = nearjoin._links(documents(spark, rows), small_key=small_key, block=5).where("doc_id is not null").collect()
        assert sorted(x.doc_id for x in links) == sorted(i for i, _ in rows if i is not None)
        assert sum(x.n_links for x in links) == sum(near(a, b) for k, (i, a) in enumerate(rows) for m, (j, b) in enumerate(rows) if k != m and i is not None and j is not None)
    kept = [(x.doc_id, x.text) for x in nearjoin.one_of_each(documents(spark, rows)).collect()]
    groups = {}
    for i, t in rows:
        if i is not None:
            groups.setdefault(next((f for f in sets if near(f, t)), t), []).append((i, t))
    assert (None, families[0]) in kept
    for members in groups.values():
        left = {x for x in kept if x in members}
        assert len(left) == 1 and left.pop()[0] == min(i for i, _ in members)


def test_banding_reaches_its_recall():
    bands, rows = hashing.bands_for(0.8, 0.9995, 256)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 256


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 40)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[339] == 300 and 200 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# --- personal data --------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_plain_spans_equal_the_patterns():
    r = random.Random(1)
    parts = ["1", "22", "333", "4444", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "0", "4111111111111111", "@x.y", "é"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert pii.plain_spans(text) == brute_spans(text), text


@pytest.mark.parametrize(
    ("text", "redacted"),
    [
        ("mail john (at) mail dot example dot com now", "mail <EMAIL> now"),
        ("call plus four nine one five one two three four five six seven ok", "call <PHONE> ok"),
        ("ｊohn@mаil.com", "<EMAIL>"),
        ("joh​n@mail.com", "<EMAIL>"),
        ("10 dot 0 dot 0 dot 1", "<IP>"),
        ("٤١١١ ١١١١ ١١١١ ١١١١", "<CARD>"),
        ("we met at noon near a dot on the map", "we met at noon near a dot on the map"),
        ("look at the dot com boom", "look at the dot com boom"), ("meet at noon dot org chart", "meet at noon dot org chart"), ("arrive at station point zero", "arrive at station point zero"), ("we met @ cafe.com", "we met @ cafe.com"),
        ("john @ example . com", "<EMAIL>"), ("mail ann at example dot org now", "mail <EMAIL> now"), ("we were at home . come in", "we were at home . come in"), ("ann [at] the [dot] shop", "<EMAIL>"),
        ("one two three blind mice", "one two three blind mice"),
    ],
)
def test_disguises_map_back(text, redacted):
    assert pii.redact(text, pii.all_spans(text, pii.plain_spans(text))) == redacted


@pytest.mark.parametrize("beside", ["", " é", " “x”", " x@y z", " dot"])
@pytest.mark.parametrize(
    ("text", "redacted"),
    [
        ("host 192[.]168[.]1[.]20 down", "host <IP> down"),
        ("host 192 (.) 168 [DOT] 1 Dot 20 down", "host <IP> down"),
        ("Visit us at example.com or so", "Visit us at example.com or so"),
        ("We met at 10.30 today", "We met at 10.30 today"),
        ("We met @ 10.30 today", "We met @ 10.30 today"),
        ("write john at example dot com now", "write <EMAIL> now"),
        ("an john at beispiel punkt de bitte", "an <EMAIL> bitte"),
        ("à jean arobase exemple point fr", "à <EMAIL>"),
        ("a juan (arroba) ejemplo.es ya", "a <EMAIL> ya"),
        ("ruf plus vier neun eins fünf eins zwei drei vier fünf an", "ruf <PHONE> an"),
        ("tel plus trois trois un deux trois quatre cinq six sept huit", "tel <PHONE>"),
        ("tel plus tres cuatro nueve uno dos tres cuatro cinco seis", "tel <PHONE>"),
        ("write JOHN AT EXAMPLE DOT COM now", "write <EMAIL> now"),
        ("write john [AT] example.com now", "write <EMAIL> now"),
        ("write john{At}example[.]com now", "write <EMAIL> now"),
        ("Four One One One 1111 1111 1111, ok", "<CARD>, ok"),
        ("one 234 5678 9012 3456 78 9 0 1 two", "one 234 5678 9012 3456 78 9 0 1 two"),
        ("call Plus 4 9 1 5 1 2 3 4 5 ok", "call <PHONE> ok"),
        ("call Plus Four nine ONE 5 1 2 3 4 5 ok", "call <PHONE> ok"),
        ("call plus four nıne one ſeven 1 2 3 4 5 ok", "call <PHONE> ok"),
        ("it grew at 3.5 or so", "it grew at 3.5 or so"),
    ],
)
def test_disguises_do_not_depend_on_the_rest(text, redacted, beside):
    whole = text + beside
    assert pii.redact(whole, pii.all_spans(whole, pii.plain_spans(whole))) == redacted + beside


def test_gates_hold_for_every_match():
    r = random.Random(6)
    parts = ["at", "AT", "@", "arroba", "[", "]", "(", ")", " ", "\t", "dot", "Dot", "punkt", ".", "Fünf", "un", "a", "b-c", "1", "22", "é", "Seven", "one", "plus", ",", "-"]
    for _ in range(60000):
        text = "".join(r.choice(parts) for _ in range(r.randint(3, 22)))
        assert pii._HAS_ADDRESS.search(text) or not pii._SPELLED_ADDRESS.search(text), text
        if not pii._HAS_QUAD.search(text):
            assert not any(len(x[0]) > 1 for m in pii._SPELLED_QUAD.finditer(text) for x in pii._AT_OR_DOT.finditer(m[0])), text
        if not pii._HAS_NUMBER.search(text.lower()):
            assert not any(pii._NUMBER_WORD.search(m[0]) for m in pii._SPELLED_NUMBER.finditer(text)), text


def test_pii(spark):
    rows = [*ODD, (10, "a@b.c and 10.0.0.1, +1 (375) 555-4393; 4111 1111 1111 1111"), (11, "1" * 50000 + "@" + "." * 20000), (12, "é a@b.c")]
    got = by_id(pii.pii_digests(documents(spark, rows)))
    assert (got[10].n_email, got[10].n_ip, got[10].n_card, got[10].n_phone) == (1, 1, 1, 1)
    assert got[10].base_sha256 == hashlib.sha256(pii.written(brute_spans(rows[8][1])).encode()).hexdigest() and got[12].spans == "email:2:7"
    assert got[1].spans == "" and got[11].n_email == 0
    clean = by_id(pii.redact_documents(documents(spark, rows)))
    assert clean[10].text == "<EMAIL> and <IP>, <PHONE>; <CARD>" and clean[10].n_chars == len(clean[10].text) and clean[1].text is None
    assert pii.pii_digests(documents(spark, [])).count() == 0
