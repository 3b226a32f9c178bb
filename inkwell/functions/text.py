"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def occurrences(c: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps."""
    return (F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))


def slugify(c: Column | str) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_label(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def py_round(c: Column, digits: int = 0) -> Column:
    """Half to even on the shortest decimal text of a double."""
    return F.bround(c, digits)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def estimate_tokens(c: Column | str) -> Column:
    """A token for four characters, begun ones counted; 0 for blank text."""
    c = _col(c)
    return F.when(F.coalesce(F.length(strip(c)), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(c) / 4))).cast("long")


def strategy_tokens(c: Column | str) -> Column:
    """The chunkers' own count: at least 1, also for blank text."""
    return F.greatest(F.lit(1), F.ceil(F.length(_col(c)) / 4)).cast("long")


def present(text: Column, terms: list[str]) -> Column:
    """The terms that a lower-case text holds, in the order given."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def word_containment(a: Column | str, b: Column | str) -> Column:
    """Share of a's words that b has, rounded to 4; 1 if a has none."""
    def own(c):
        return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))

    return F.get(F.transform(F.array(F.struct(own(a).alias("a"), F.array_distinct(own(b)).alias("b"))), lambda x: F.when(F.size(x.a) == 0, 1.0).otherwise(
        py_round(F.size(F.filter(x.a, lambda w: F.array_contains(x.b, w))) / F.size(x.a), 4))), F.lit(0))


def parse_hex(c: Column | str) -> Column:
    """Six upper-case digits of a 3- or 6-digit colour, else null."""
    raw = F.upper(F.regexp_replace(_col(c), "^#", ""))
    three = F.regexp_replace(raw, "(.)(.)(.)", "$1$1$2$2$3$3")
    return F.when(raw.rlike("^[0-9A-F]{6}$"), raw).when(raw.rlike("^[0-9A-F]{3}$"), three)


def luminance(c: Column | str) -> Column:
    """Relative luminance of a six-digit colour."""
    def channel(at: int) -> Column:
        v = F.conv(F.substring(_col(c), at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast_ratio(a: Column | str, b: Column | str) -> Column:
    """Null if one of the colours is."""
    x, y = luminance(a), luminance(b)
    known = _col(a).isNotNull() & _col(b).isNotNull()
    return F.when(known, (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def fold_for_match(c: Column | str) -> Column:
    """Quotes and dashes made plain, white space collapsed, lower case."""
    c = F.translate(_col(c), "‘’‚‛“”„‐‑‒–—−", "''''\"\"\"------")
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def clean_alt(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"\p{C}", ""))


def font_key(c: Column | str) -> Column:
    """A font's name without its subset prefix."""
    return F.regexp_replace(_col(c), r"^[A-Z]{6}\+", "")


def banner_key(c: Column | str) -> Column:
    """The letters of a running header, without its page number."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z]", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def compacted(*values: Column) -> Column:
    """An array of those that aren't null."""
    return F.filter(F.array(*values), lambda x: x.isNotNull())
