"""License scans: ordered signature rules on the words of a text, built from DataFrame functions only.

A text is reduced to its words, lowered and joined by single spaces. Every rule is a regex over such a string, a keyword
that must be present before the regex is tried, a tier (0 an explicit tag, 1 a full name with its version or a notice,
2 a bare name) and a label. Detections are resolved in order of start, longer first, then tier: one that lies within an
earlier detection of the same or a better tier is suppressed.

All of it works inside a row, so nothing is shuffled. Every text is scanned: a rule's regex is tried where the words hold
the rule's own keyword, which every match of it holds.

Defined cases: a null text counts as empty and has no words; repeated and null doc_ids give one row each; other columns
are not read; texts of any length are scanned whole.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, names (each the keyword of its own rules), versions
FAMILIES = [
    ("apache", ["apache", "apache software"], ["1", "1 0", "1 1", "2", "2 0"]),
    ("gpl", ["gnu general public", "gnu gpl", "gpl"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("lgpl", ["gnu lesser general public", "gnu library general public", "lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", ["gnu affero general public", "affero general public", "agpl"], ["1", "1 0", "3", "3 0"]),
    ("gfdl", ["gnu free documentation", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("mpl", ["mozilla public", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], ["1 0", "2 0"]),
    ("eupl", ["european union public", "eupl"], ["1 0", "1 1", "1 2"]),
    ("cddl", ["common development and distribution", "cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public"], ["1 0"]),
    ("afl", ["academic free"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("osl", ["open software"], ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("artistic", ["artistic"], ["1 0", "2 0"]),
    ("boost", ["boost software"], ["1 0"]),
    ("busl", ["business source"], ["1 0", "1 1"]),
    ("lppl", ["latex project public"], ["1 0", "1 1", "1 2", "1 3"]),
    ("zpl", ["zope public"], ["1 1", "2 0", "2 1"]),
    ("odbl", ["open database"], ["1 0"]),
    ("ofl", ["open font"], ["1 0", "1 1"]),
    ("php", ["php"], ["3 0", "3 01"]),
    ("cecill", ["cecill"], ["1 0", "1 1", "2 0", "2 1"]),
]
VERSION_FORMS = [
    "{name} licen[cs]e version {v}", "{name} licen[cs]e v ?{v}", "{name} licen[cs]e {v}", "{name} {v} licen[cs]e",
    "{name} licen[cs]e as published by the free software foundation (?:either )?version {v}",
]
#: short names that are known without the word license
SHORT = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "mpl": "mpl", "epl": "epl", "eupl": "eupl", "cddl": "cddl"}
#: pattern, keyword, tier, label
NOTICES = [
    ("(?:under|using|with) (?:the )?(?:terms of the )?(?:mit|expat|x11) licen[cs]e", "licen", 1, "mit"),
    ("(?:the )?mit licen[cs]e", "mit licen", 2, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 1, "mit"),
    ("permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "permission to use", 1, "isc"),
    ("isc licen[cs]e", "isc licen", 2, "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 1, "bsd"),
    ("neither the name of (?:the )?[^ ]+ nor the names of its contributors", "neither the name", 1, "bsd-3-clause"),
    ("(?:new |modified |revised )bsd licen[cs]e", "bsd licen", 1, "bsd-3-clause"),
    ("(?:simplified |freebsd )bsd licen[cs]e", "bsd licen", 1, "bsd-2-clause"),
    ("bsd (?:3|three) clause(?: licen[cs]e)?", "bsd", 1, "bsd-3-clause"),
    ("(?:3|three) clause bsd(?: licen[cs]e)?", "clause bsd", 1, "bsd-3-clause"),
    ("bsd (?:2|two) clause(?: licen[cs]e)?", "bsd", 1, "bsd-2-clause"),
    ("(?:2|two) clause bsd(?: licen[cs]e)?", "clause bsd", 1, "bsd-2-clause"),
    ("bsd (?:4|four) clause(?: licen[cs]e)?", "bsd", 1, "bsd-4-clause"),
    ("bsd (?:1|one) clause(?: licen[cs]e)?", "bsd", 1, "bsd-1-clause"),
    ("(?:0bsd|bsd (?:0|zero) clause)(?: licen[cs]e)?", "bsd", 1, "0bsd"),
    ("all advertising materials mentioning features or use of this software must display", "all advertising materials", 1, "bsd-4-clause"),
    ("(?:mit|expat|x11) licensed", "licensed", 1, "mit"),
    ("licensed under (?:the )?(?:terms of (?:the )?)?(?:mit|expat|x11)", "licensed under", 1, "mit"),
    ("(?:bsd|isc|zlib) licensed", "licensed", 2, "permissive"),
    ("(?:apache|asl) licensed", "licensed", 2, "apache"),
    ("apache 2(?: 0)?", "apache 2", 1, "apache-2"),
    ("ms pl", "ms pl", 2, "ms-pl"),
    ("microsoft public licen[cs]e", "microsoft public", 1, "ms-pl"),
    ("ms rl", "ms rl", 2, "ms-rl"),
    ("microsoft reciprocal licen[cs]e", "microsoft reciprocal", 1, "ms-rl"),
    ("unicode (?:data files and software )?licen[cs]e(?: agreement)?", "unicode", 1, "unicode"),
    ("postgresql licen[cs]e", "postgresql licen", 1, "postgresql"),
    ("wtfpl", "wtfpl", 1, "wtfpl"),
    ("blue oak model licen[cs]e(?: 1 0 0)?", "blue oak", 1, "blueoak-1.0.0"),
    ("mulan permissive software licen[cs]e", "mulan permissive", 1, "mulanpsl"),
    ("openssl licen[cs]e", "openssl licen", 1, "openssl"),
    ("server side public licen[cs]e", "server side public", 1, "sspl"),
    ("elastic licen[cs]e(?: 2 0)?", "elastic licen", 1, "elastic"),
    ("universal permissive licen[cs]e", "universal permissive", 1, "upl"),
    ("university of illinois ncsa open source licen[cs]e", "ncsa", 1, "ncsa"),
    ("(?:w3c|world wide web consortium) software (?:notice and )?licen[cs]e", "software", 1, "w3c"),
    ("historical permission notice and disclaimer", "historical permission", 1, "hpnd"),
    ("academic software licen[cs]e", "academic software", 2, "academic"),
    ("open government licen[cs]e(?: v ?[123]| version [123])?", "open government", 1, "ogl"),
    ("sleepycat licen[cs]e", "sleepycat", 1, "sleepycat"),
    ("the software is provided as is without warranty of any kind", "provided as is", 2, "as-is-notice"),
    ("this software is provided (?:by .{1,80} )?as is (?:and any express|without any express)", "provided", 2, "as-is-notice"),
    ("everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", "verbatim copies", 1, "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "free software you can", 1, "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "free software you can", 1, "lgpl"),
    ("altered source versions must be plainly marked as such", "altered source versions", 1, "zlib"),
    ("this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "source code form is", 1, "mpl-2"),
    ("licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance", "except in compliance", 1, "apache-2"),
    ("(?:you may not|may not) use this (?:file|work) except in compliance with the licen[cs]e", "except in compliance", 2, "apache"),
    ("bsd licen[cs]e", "bsd licen", 2, "bsd"),
    ("zlib licen[cs]e", "zlib licen", 2, "zlib"),
    ("python software foundation licen[cs]e", "python software", 2, "psf"),
    ("do what the fuck you want to public licen[cs]e", "do what the", 1, "wtfpl"),
    ("this is free and unencumbered software released into the public domain", "unencumbered", 1, "unlicense"),
    ("the unlicense", "unlicense", 2, "unlicense"),
    ("(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 1, "public-domain"),
    ("in the public domain", "public domain", 2, "public-domain"),
    ("cc0(?: 1 0)?(?: universal)?", "cc0", 1, "cc0"),
    ("creative commons zero", "commons zero", 1, "cc0"),
    ("all rights reserved under licen[cs]e", "all rights reserved", 2, "proprietary"),
    ("proprietary licen[cs]e", "proprietary licen", 2, "proprietary"),
    ("end user licen[cs]e agreement", "end user licen", 2, "proprietary"),
    ("may not be (?:copied|reproduced|redistributed) without (?:a )?licen[cs]e", "may not be", 1, "proprietary"),
    ("copyleft", "copyleft", 2, "copyleft"),
]
CC_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


def dotted(version: str) -> str:
    return version.replace(" ", ".").removesuffix(".0")


def signature_rules() -> list[tuple[str, str, int, str]]:
    """(pattern, keyword, tier, label) of every rule, from the families, their versions and the forms of a mention."""
    rules = list(NOTICES)
    for family, names, versions in FAMILIES:
        for version in versions:
            label = f"{family}-{dotted(version)}"
            rules += [(form.format(name=name, v=version), name, 1, label) for name in names for form in VERSION_FORMS]
            short = SHORT.get(family)
            if short:
                rules.append((f"{short} ?(?:version )?v? ?{version}(?: or later| only)?(?! (?:times|percent|years|days|files|of))", short, 1, label))
            rules.append((f"spdx licen[cs]e identifier {short or family} {version}(?: or later| only)?", "identifier", 0, label))
        rules += [(f"{name} licen[cs]e", name, 2, family) for name in names]
    for (short, long), version in product(CC_PARTS.items(), CC_VERSIONS):
        label = f"cc-{short.replace(' ', '-')}-{version.replace(' ', '.')}"
        rules.append((f"cc {short} {version}(?: international| unported)?", "cc by", 1, label))
        rules.append((f"creative commons (?:{short}|{long}) {version}(?: international| unported)?", "creative commons", 1, label))
        rules.append((f"spdx licen[cs]e identifier cc {short} {version}", "identifier", 0, label))
    for short, long in CC_PARTS.items():
        rules.append((f"cc {short}", "cc by", 2, "cc-" + short.replace(" ", "-")))
        rules.append((f"creative commons {long}(?: licen[cs]e)?", "creative commons", 2, "cc-" + short.replace(" ", "-")))
    for name in ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsd 2 clause", "bsd 3 clause", "cc0 1 0", "ms pl", "postgresql", "ncsa", "upl 1 0"):
        label = name.replace(" ", "-").removesuffix("-1-0")
        rules.append((f"spdx licen[cs]e identifier {name}", "identifier", 0, label))
        # another operand of the tag's expression
        rules.append((f"(?<=licen[cs]e identifier[ a-z0-9]{{1,120}} (?:or|and) ){name}", "identifier", 0, label))
    return rules


def rule_groups() -> Column:
    """The rules by keyword, as a constant."""
    groups: dict[str, list[dict]] = {}
    for pattern, keyword, tier, label in signature_rules():
        groups.setdefault(keyword, []).append({"pattern": f"(?<= )(?:{pattern})(?= )", "tier": tier, "label": label})
    written = json.dumps([{"keyword": k, "rules": r} for k, r in groups.items()])
    return F.from_json(F.lit(written), "array<struct<keyword:string,rules:array<struct<pattern:string,tier:int,label:string>>>>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """start and end (exclusive), in words, of every match of a pattern of whole words in ' a b c '."""
    hits = F.regexp_extract_all(words, pattern, F.lit(0))
    gaps = F.slice(F.split(words, pattern, F.lit(-1)), F.lit(1), F.size(hits))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state, pair):
        start = state.at + _words_in(pair.gap) - 1
        end = start + _words_in(pair.hit) + 1
        return F.struct(end.alias("at"), F.concat(state.found, F.array(F.struct(start.alias("start"), end.alias("end")))).alias("found"))

    return F.aggregate(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), zero, step, lambda s: s.found)


def _resolved(detections: Column) -> Column:
    """Detections that no earlier one of the same or a better tier contains."""
    order = F.array_sort(F.transform(detections, lambda d: F.struct(d.start, (-d.end).alias("back"), d.tier, d.label)))
    zero = F.struct(*[F.lit(0).alias(f"m{t}") for t in range(3)], F.array().cast("array<struct<start:int,end:int,tier:int,label:string>>").alias("kept"))

    def step(state, d):
        end = -d.back
        covered = F.when(d.tier == 0, state.m0).when(d.tier == 1, F.greatest(state.m0, state.m1)).otherwise(F.greatest(state.m0, state.m1, state.m2))
        reach = [F.when((d.tier == t) & (end > state[f"m{t}"]), end).otherwise(state[f"m{t}"]).alias(f"m{t}") for t in range(3)]
        one = F.struct(d.start.alias("start"), end.alias("end"), d.tier.alias("tier"), d.label.alias("label"))
        return F.struct(*reach, F.when(end <= covered, state.kept).otherwise(F.concat(state.kept, F.array(one))).alias("kept"))

    return F.aggregate(order, zero, step, lambda s: s.kept)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, base (places of the base phrases), detections (resolved).

    ``base``: array of (start, end, label); ``detections``: array of (start, end, tier, label); places count words.
    """
    groups = rule_groups()
    phrases = F.from_json(F.lit(json.dumps([{"phrase": p, "pattern": f"(?<= ){p}(?= )", "label": x} for p, x in BASE.items()])), "array<struct<phrase:string,pattern:string,label:string>>")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce("text", F.lit(""))
    joined = F.translate(F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" ")), upper, upper.lower())

    def scan(words):
        found = F.flatten(F.transform(F.filter(phrases, lambda p: F.contains(words, p.phrase)), lambda p: F.transform(_places(words, p.pattern), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), p.label.alias("label")))))
        gated = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g.keyword)), lambda g: g.rules))
        tried = F.filter(gated, lambda r: F.regexp_like(words, r.pattern))
        hits = F.flatten(F.transform(tried, lambda r: F.transform(_places(words, r.pattern), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), r.tier.alias("tier"), r.label.alias("label")))))
        n_words = F.when(words == "  ", 0).otherwise(_words_in(words) - 1).cast("long")
        return F.struct(n_words.alias("n_words"), F.array_sort(found).alias("base"), _resolved(hits).alias("detections"))

    return docs.select("doc_id", _let(joined, scan).alias("found")).select("doc_id", "found.*")


def license_labels(docs: DataFrame) -> DataFrame:
    """license_scan() in figures: n_base, first_word, last_word, base_labels, labels, score (of the best tier)."""
    scan = license_scan(docs)
    base, all_labels = F.array_distinct(F.col("base.label")), F.array_union("base.label", "detections.label")
    best = F.array_min(F.concat(F.transform("detections", lambda d: d.tier), F.transform("base", lambda _: F.lit(1))))
    return scan.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"),
        F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.when(best == 0, 1.0).when(best == 1, 0.9).when(best == 2, 0.6).otherwise(0.0).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
