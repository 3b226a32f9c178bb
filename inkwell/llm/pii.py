"""Personal data, also where it is disguised, with places in the original text.

The plain identifiers (email, ip, card, phone) are found in the text as it stands. For disguised ones a transducer
rewrites the text: look-alike characters and digits of other scripts become ASCII, invisible characters go, digits in
English, German, French and Spanish words become digits, and 'at' and 'dot' in words or brackets become @ and . where an
address is spelled out. Each
character of the result remembers the source characters it stands for; the same detectors run on the result, and their
spans are mapped back. A span found only there is added, if it doesn't lie within a plain one of its kind.

Every detector is linear in the text. Defined cases: a null text counts as empty; repeated and null doc_ids give one
row each; other columns are not read; places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ROWS_AT_ONCE = 1000
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A dotted quad begins at the start of a run of digits, and every part takes its whole run.
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS_RUN = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def _emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        left = text[free:at]
        size = len(left) - len(left.rstrip(LOCAL_PART))
        free = at + 1
        if size and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            found.append(("email", at - size, free))
        at = text.find("@", free)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _below_256(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) < 4 and int(significant or 0) <= 255


def plain_spans(text: str) -> list[Span]:
    """Identifiers in the text as it stands, by kind and start."""
    found = _emails(text) if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _QUAD.finditer(text) if all(map(_below_256, m[0].split(".")))]
    for m in _DIGIT_RUN.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PLUS_RUN.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


#: Letters of other scripts that look like an ASCII letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "։": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
#: The digits in English, German, French and Spanish.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


class _Ascii(dict):
    """For str.translate: the ASCII character that a character stands for, worked out when first met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        to = LOOK_ALIKES.get(c) or (str(unicodedata.decimal(c)) if code > 127 and unicodedata.decimal(c, None) is not None else None)
        if to is None and code > 0x24F:
            to = unicodedata.normalize("NFKC", c)
        self[code] = ord(to) if to and len(to) == 1 and ord(to) < 128 else code
        return self[code]


_ascii = _Ascii({i: i for i in range(128)})
_FOREIGN = re.compile(f"[ɐ-῿‐-–․℀-⅏①-⓿。！-～\U0001d400-\U0001d7ff{INVISIBLE}]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_OPEN, _CLOSE = r"[ \t]*[(\[{<][ \t]*", r"[ \t]*[)\]}>][ \t]*"
# 'at' is a common word, the names of the sign in French and Spanish are not
_AT = rf"(?:{_OPEN}(?:at|arobase|arroba|@){_CLOSE}|[ \t]+(?:at|arobase|arroba)[ \t]+|[ \t]*@[ \t]*)"
_QUAD_DOT = rf"(?:{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}|[ \t]+(?:dot|punkt|point|punto)[ \t]+|\.)"
_DOT = rf"(?:{_QUAD_DOT}|[ \t]+\.[ \t]+)"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPELLED_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}){_AT}(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})+)", re.I)
_SPELLED_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_QUAD_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: The last label of an address without brackets.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io dev app ai co me tv cc online site shop cloud tech email mail "
    "de at ch li fr be lu es pt it nl uk ie us ca mx ar cl br au nz in jp cn hk sg kr tw ru ua pl cz sk hu ro bg gr tr se no dk fi is ee lv lt eu example test invalid localhost".split()
)
#: Words that stand before or behind an "at" of prose, and so neither name a mailbox nor begin a domain there.
BEFORE_AT = frozenset(
    "look looks looked looking meet meets met meeting arrive arrives arrived arriving stay stays stayed staying work works worked working live lives lived living sit sits sat sitting stand stands stood standing be is am are was were been being "
    "eat eats ate eating start starts started starting end ends ended ending begin begins began stop stops stopped open opens opened close closes closed see saw seen find found talk talks talked speak speaks spoke sell sells sold buy buys bought "
    "aim aimed laugh laughed shout shouted smile smiled stare stared point pointed good bad best better angry not only even still again here there back him her it us them me you we they i he she one all and or but".split()
)
BEHIND_AT = frozenset(
    "the a an this that these those my your his her its our their some any no each every all both least most last first once noon midnight night dawn dusk home work school sea war peace rest random times present one two three four five six seven eight nine ten "
    "what which whom whose it them us him me you".split()
)
_AT_OR_DOT = re.compile(rf"(?P<dot>{_DOT})|{_AT}", re.I)
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9.-]+")
# What every spelled address, and every quad or number with something to rewrite, holds. The transducers run where it is found.
_HAS_ADDRESS = re.compile(rf"(?:@|at|arobase|arroba)[ \t]*(?:[)\]}}>][ \t]*)?{_LABEL}{_DOT}[A-Za-z0-9-]", re.I)
_AT_PLACES = ["@", *(f"{a}at{b}" for a in " \t([{<" for b in " \t)]}>"), "arobase", "arroba"]
_HAS_QUAD = re.compile(r"[0-9](?:[ \t]*[(\[{<]|[ \t]+[DdPp])")
_WORDS = "|".join(NUMBER_WORDS)
_HAS_NUMBER = re.compile(rf"(?:{_WORDS})[ ,.-]{{1,2}}(?:{_WORDS}|[0-9])|[0-9][ ,.-]{{1,2}}(?:{_WORDS})|plus[ -]+[0-9]")
#: What the regexes take for i, s and k besides those and their capitals.
_SMALL = str.maketrans("İıſ\u212a", "iisk")
_NUMBER = "(?:" + "|".join(NUMBER_WORDS) + "|[0-9]+)"
_SPELLED_NUMBER = re.compile(rf"\b(?:plus[ -]+|\+ ?)?{_NUMBER}(?:[ ,.-]{{1,2}}{_NUMBER}){{6,}}\b", re.I)
_NUMBER_WORD = re.compile(r"\b(?:(plus)[ -]+|(" + "|".join(NUMBER_WORDS) + r")\b(?:,? |-)?)", re.I)


def deobfuscate(text: str) -> tuple[str, list[int], list[int]]:
    """(normalised text, source start of each character, source end of each character); ('', [], []) if unchanged."""
    foreign = not text.isascii() and _FOREIGN.search(text)
    folded = text.translate(_ascii) if foreign else text
    edits: list[tuple[int, int, str]] = []
    if foreign:
        edits += [(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)]
    low = (folded if folded.isascii() else folded.translate(_SMALL)).lower()
    may_have = any(w in low for w in _AT_PLACES) and _HAS_ADDRESS.search(folded)
    spelled = [m for m in _SPELLED_ADDRESS.finditer(folded) if _disguised(m)] if may_have else []
    spelled += _SPELLED_QUAD.finditer(folded) if _HAS_QUAD.search(folded) else []
    for m in spelled:
        edits += [(m.start() + x.start(), m.start() + x.end(), "." if x["dot"] else "@") for x in _AT_OR_DOT.finditer(m[0]) if len(x[0]) > 1]
    if _HAS_NUMBER.search(low):
        for m in _SPELLED_NUMBER.finditer(folded):
            edits += [(m.start() + x.start(), m.start() + x.end(), "+" if x[1] else NUMBER_WORDS[x[2].translate(_SMALL).lower()]) for x in _NUMBER_WORD.finditer(m[0])]
    if not edits and folded == text:
        return "", [], []
    out, starts, ends, at = [], [], [], 0
    for a, b, to in sorted(edits):
        if a < at:
            continue
        out += [folded[at:a], to]
        starts += [*range(at, a), *[a] * len(to)]
        ends += [*range(at + 1, a + 1), *[b] * len(to)]
        at = b
    out.append(folded[at:])
    starts += range(at, len(text))
    ends += range(at + 1, len(text) + 1)
    return "".join(out), starts, ends


def _disguised(m: re.Match) -> bool:
    """Whether a spelled address is more than prose, such as 'see us at example.com', 'met @ 10.30' or 'look at the dot com boom'.

    A bare 'at' counts only with a dot in words or brackets, and the last label has a letter. Without any bracket, the last
    label must be a top-level domain, and words of prose name neither the mailbox nor the domain.
    """
    domain = m["domain"]
    at = m[0][m.end("local") - m.start() : -len(domain)].strip(" \t").lower()
    labels = [x for x in _AT_OR_DOT.split(domain) if x and not _AT_OR_DOT.fullmatch(x)]
    if at == "at" and _PLAIN_DOMAIN.fullmatch(domain) or not any(c.isalpha() for c in labels[-1]):
        return False
    if at[0] in "([{<" or any(c in domain for c in "([{<"):
        return True
    return labels[-1].lower() in TOP_LEVEL and m["local"].lower() not in BEFORE_AT and labels[0].lower() not in BEHIND_AT


def all_spans(text: str, plain: list[Span]) -> list[Span]:
    """The plain spans and those that show only after normalisation, by kind and start."""
    normal, starts, ends = deobfuscate(text)
    added = []
    if normal:
        taken = {k: sorted((a, b) for kind, a, b in plain if kind == k) for k in KINDS}
        for kind, a, b in plain_spans(normal):
            a, b = starts[a], ends[b - 1]
            while b > a and text[b - 1] in " \t":
                b -= 1
            if not any(x <= a and b <= y for x, y in taken[kind]):
                added.append((kind, a, b))
    return sorted([*plain, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span, in angle brackets."""
    out, at, inside = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= inside:
            out += [text[at:a], f"<{kind.upper()}>"]
        inside = at = max(inside, b)
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, plain (spans in the text as it stands), spans (all), redacted text."""

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(1).to_pylist()
                plain = [plain_spans(t) for t in texts]
                every = [all_spans(t, p) for t, p in zip(texts, plain)]
                columns = [pa.array(map(_rows, plain), _SPAN_TYPE), pa.array(map(_rows, every), _SPAN_TYPE), pa.array([redact(t, s) for t, s in zip(texts, every)], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "plain", "spans", "redacted"])

    return _texts(docs).mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, plain {_SPANS}, spans {_SPANS}, redacted string")


def pii_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts and digest of the plain spans, all spans in writing, n_spans."""

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(1).to_pylist()
                plain = [plain_spans(t) for t in texts]
                every = [all_spans(t, p) for t, p in zip(texts, plain)]
                counts = [pa.array([sum(s[0] == k for s in p) for p in plain], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(written(p).encode()).hexdigest() for p in plain], pa.string())
                columns = [*counts, digest, pa.array(map(written, every), pa.string()), pa.array(map(len, every), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return _texts(docs).mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data in their texts replaced; n_chars, if there, counts the new text."""
    at = docs.columns.index("text")
    names = docs.columns
    counted = names.index("n_chars") if "n_chars" in names else None

    def scan(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                columns, new = list(part.columns), []
                for t in part.column(at).to_pylist():
                    spans = all_spans(t, plain_spans(t)) if t else []
                    new.append(redact(t, spans) if spans else t)
                columns[at] = pa.array(new, pa.string())
                if counted is not None:
                    old = part.column(counted).to_pylist()
                    columns[counted] = pa.array([n if t is None else len(t) for t, n in zip(new, old)], part.column(counted).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, docs.schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
