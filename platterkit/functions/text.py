"""Text functions as native column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that Unicode doesn't decompose and what they fold to, and digraphs that spell an umlaut.
LETTER_FOLDS = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ß": "ss"}
DIGRAPH_FOLDS = [("ae", "a"), ("oe", "o"), ("ue", "u")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points whose compatibility decompositions are applied: Latin, Greek and Cyrillic, punctuation, wide and presentation forms.
_RANGES = (range(0xA0, 0x530), range(0x1E00, 0x2150), range(0x3000, 0x3001), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))


@cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters to replace one by one, what they become (dropped ones come last and have nothing), and those that become several."""
    source, target, drop, several = [], [], [chr(c) for c in range(0x300, 0x370)], {}
    for cp in (c for r in _RANGES for c in r):
        c = chr(cp)
        if unicodedata.combining(c):
            if c not in drop:
                drop.append(c)
            continue
        to = "".join(x for x in unicodedata.normalize("NFKD", LETTER_FOLDS.get(c, c)) if not unicodedata.combining(x)).lower()
        if to == c:
            continue
        if len(to) == 1:
            source.append(c)
            target.append(to)
        else:
            several[c] = to
    return "".join(source) + "".join(drop), "".join(target), several


def fold(text: Column) -> Column:
    """Lower-cased text without accents in which ae, oe and ue count as a, o and u, so all spellings of a name agree.

    Null stays null. ASCII text takes only the lower-casing and the digraphs.
    """
    source, target, several = fold_tables()
    lookup = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(lookup, c), c)), "")
    some = "[" + "".join(re.escape(c) for c in several) + "]"
    folded = F.lower(F.translate(F.when(text.rlike(some), spread).otherwise(text), source, target))
    out = F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(text))
    for digraph, vowel in DIGRAPH_FOLDS:
        out = F.replace(out, F.lit(digraph), F.lit(vowel))
    return out


def fold_sql(column: str) -> str:
    """The same fold in DuckDB's SQL."""
    source, target, several = fold_tables()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    e = column
    for c, to in several.items():
        e = f"replace({e}, {quote(c)}, {quote(to)})"
    e = f"case when regexp_matches({column}, '[^\\x{{00}}-\\x{{7F}}]') then lower(translate({e}, {quote(source)}, {quote(target)})) else lower({column}) end"
    for digraph, vowel in DIGRAPH_FOLDS:
        e = f"replace({e}, '{digraph}', '{vowel}')"
    return e


def nocase(text: Column) -> Column:
    """Sort key that ignores the case of A to Z only."""
    return F.translate(text, _UPPER, _LOWER)


def contains_folded(text: Column, query: str) -> Column:
    """Whether the folded text holds the folded query; no character of the query is a wildcard."""
    return F.contains(fold(text), fold(F.lit(query)))


def strip_disambiguation(names: Column) -> Column:
    """Names without a number in brackets before a comma or the end."""
    return F.regexp_replace(names, r"\s\(\d+\)(?=,|$)", "")


def parse_duration(text: Column) -> Column:
    """Seconds of whole numbers joined by colons, base 60; null for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p).try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.aggregate(parts, F.lit(0), lambda a, x: a * 60 + x))


def format_duration(seconds: Column) -> Column:
    """m:ss, where minutes may pass 59; ``unknown`` for null."""
    s = seconds.cast("int")
    return F.when(s.isNull(), F.lit("unknown")).otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60))


def _literal(term: Column) -> Column:
    return F.concat(F.lit("(?i)"), F.regexp_replace(term, r"([\\\[\](){}.*+?^$|])", r"\\$1"))


def denoise(title: Column, names: Column | None = None, terms: Sequence[str] = ("Original Mix",)) -> Column:
    """A title without the given names (array column) and terms, in this order, without years, blanks evened out."""
    all_terms = F.array(*[F.lit(t) for t in terms]) if names is None else F.concat(names, F.array(*[F.lit(t) for t in terms]))
    cleaned = F.aggregate(
        F.filter(all_terms, lambda t: t.isNotNull() & (t != "")),
        title,
        lambda acc, term: F.when(F.contains(F.lower(acc), F.lower(term)), F.regexp_replace(acc, _literal(term), F.lit(" "))).otherwise(acc),
    )
    return F.trim(F.regexp_replace(F.regexp_replace(cleaned, r"\b(19|20)\d{2}\b", " "), r"\s+", " "))


def has_content(text: Column) -> Column:
    """Whether two ASCII letters or digits stand together."""
    return text.rlike("[A-Za-z0-9]{2,}")


def clean_filename(name: Column) -> Column:
    """A file's stem without a leading track number."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, r"^\d{1,3}[\s._-]+", "")


def sanitize_filename(name: Column) -> Column:
    """A name that every file system takes."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), r"\s+", " "))


def audio_stem(position: Column, title: Column) -> Column:
    """``position - title`` as a file stem, the title alone where there is no position."""
    return sanitize_filename(F.when(F.coalesce(position, F.lit("")) != "", F.concat(position, F.lit(" - "), title)).otherwise(title))


def url_extension(url: Column) -> Column:
    """The suffix of a URL's path, ``.jpg`` where it has none."""
    ext = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/[^/]*(\.[^./]+)$", 1)
    return F.when(ext == "", F.lit(".jpg")).otherwise(ext)


def truncate(text: Column, most: int) -> Column:
    """Text cut to a length, with three full stops where something is missing."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def has_cjk(text: Column) -> Column:
    """Whether Japanese, Chinese or Korean characters or wide forms occur."""
    return text.rlike("[\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFF00-\\uFFEF]")


def date_prefix(stamp: Column) -> Column:
    """The date of an ISO timestamp text."""
    return F.substring(stamp, 1, 10)


def year_or_dashes(year: Column) -> Column:
    """A year as text, four dashes where it is unknown."""
    return F.coalesce(year.cast("string"), F.lit("----"))
