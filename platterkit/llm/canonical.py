"""Visually identical text with different characters (problem 3).

DuckDB runs inside the Arrow partitions: its SQL takes out invisible characters, maps compatibility forms and
look-alike letters, composes accents with nfc_normalize and evens out blanks. The form it gives is a key for comparing, in
which look-alikes of other scripts are the Latin letters they look like. Which letters look alike comes from Unicode's data on confusable
characters, as the ICU library that Spark ships has them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterkit.session import stash

# The commonest Cyrillic, Greek and other letters that look like Latin ones in common typefaces; look_alikes() has all.
LOOK_ALIKES = {
    "АВЕІЈКМНОРСЅТУХѴԚԜЁЇ": "ABEIJKMHOPCSTYXVQWËÏ",
    "аеіјорсѕухѵһԁԛԝӏёї": "aeijopcsyxvhdqwlëï",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οϲϳ": "ocj",
    "ɑɡ": "ag",
}


@cache
def _tables() -> tuple[tuple[str, str], tuple[str, str], dict[str, str]]:
    """Compatibility forms that differ in look by width, typeface or joining only.

    One-to-one forms of the basic plane and of the planes above it, each as two strings, and ligatures as a dict.
    """
    near, far, ligatures = ([], []), ([], []), {}
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if kind not in ("<wide>", "<narrow>", "<font>", "<compat>"):
            continue
        to = unicodedata.normalize("NFKC", c)
        if len(to) == 1 and (kind != "<compat>" or (c.isalpha() and to.isalpha())):
            for side, x in zip(far if cp > 0xFFFF else near, (c, to)):
                side.append(x)
        elif kind == "<compat>" and 0xFB00 <= cp <= 0xFB06:
            ligatures[c] = to
    return ("".join(near[0]), "".join(near[1])), ("".join(far[0]), "".join(far[1])), ligatures


_found: dict[str, tuple[str, str]] = {}


def look_alikes(spark: SparkSession) -> tuple[str, str]:
    """Letters that look like a Latin letter, and these Latin letters, as two strings.

    A letter outside ASCII whose skeleton (the form to which ICU brings all characters that may be confused) is that of an ASCII letter stands for it; of I and
    l, which share one, capitals stand for I. Letters with accents stand for the Latin letter with the same accents. Digits aren't mapped, nor is ASCII.
    """
    if not _found:
        plain = [chr(c) for c in range(0x21, 0x7F) if chr(c).isalpha()]
        letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] == "L" and not unicodedata.decomposition(chr(c))]
        forms = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(plain + letters)).split("\n")
        latin: dict[str, str] = {}
        for c, form in zip(plain, forms):
            latin.setdefault(form, "")
            latin[form] += c
        pick = lambda c, of: of[0] if len(of) == 1 or unicodedata.category(c) == "Lu" else of[-1]
        one = {c: pick(c, latin[form]) for c, form in zip(letters, forms[len(plain) :]) if form in latin}
        one |= {c: to for odd, to_ in LOOK_ALIKES.items() for c, to in zip(odd, to_)}
        for cp in range(0x80, 0x2000):
            base, *marks = unicodedata.normalize("NFD", chr(cp))
            if marks and base in one and len(to := unicodedata.normalize("NFC", one[base] + "".join(marks))) == 1:
                one.setdefault(chr(cp), to)
        _found["looks"] = ("".join(one), "".join(one.values()))
    return _found["looks"]


@cache
def canonical_sql(looks: tuple[str, str], column: str = "text") -> str:
    """The DuckDB expression for the canonical form of a column with the given look-alikes; each step is taken only where its characters occur."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    when = lambda e, pattern, then: f"case when regexp_matches({e}, '{pattern}') then {then} else {e} end"
    near, far, ligatures = _tables()
    e = rf"regexp_replace({column}, '[\p{{Cf}}\x{{34F}}\x{{115F}}\x{{1160}}\x{{17B4}}\x{{17B5}}\x{{180B}}-\x{{180F}}\x{{3164}}\x{{FE00}}-\x{{FE0F}}]+', '', 'g')"
    e = when(e, r"[\x{FF00}-\x{FFEF}\x{2000}-\x{33FF}\x{1C4}-\x{1F3}]", f"translate({e}, {quote(near[0])}, {quote(near[1])})")
    e = when(e, r"[\x{10000}-\x{1FFFF}]", f"translate({e}, {quote(far[0])}, {quote(far[1])})")
    joined = e
    for c, to in ligatures.items():
        joined = f"replace({joined}, {quote(c)}, {quote(to)})"
    e = when(e, r"[\x{FB00}-\x{FB06}]", joined)
    e = f"nfc_normalize({e})"
    e = f"nfc_normalize(translate({e}, {quote(looks[0])}, {quote(looks[1])}))"
    e = when(column, r"[^\x{00}-\x{7F}]", e)
    return rf"trim(regexp_replace({e}, '[\p{{Z}}\s]+', ' ', 'g'))"


def with_canonical(df: DataFrame, text: str, canonical: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of a text column beside it.

    Plain ASCII without odd blanks is its own form. Null stays null, empty and blank text become empty. Whole texts are
    taken, however long. A column that already bears the new name is replaced.

    Plan: one Arrow pass without a shuffle; a batch is the only state a task holds.
    """
    kept = [c for c in df.columns if c != canonical]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != canonical) + f", `{canonical}` string"
    index, looks = kept.index(text), look_alikes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        steps = canonical_sql(looks, "t")
        for batch in batches:
            column = batch.column(index)
            rows = pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "t": column.cast(pa.string())})
            con.register("b", rows)
            done = con.sql(f"select i, {steps} c from b order by i").to_arrow_table().column("c").combine_chunks()
            con.unregister("b")
            done = pa.concat_arrays(done.chunks) if isinstance(done, pa.ChunkedArray) else done
            yield pa.RecordBatch.from_arrays([*batch.columns, done.cast(pa.string())], names=[*kept, canonical])

    return df.select(*kept).mapInArrow(run, schema)


def look_alike_pairs(df: DataFrame, key: str, text: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*within, id_a, id_b)``, id_a < id_b, whose texts have one canonical form but aren't the same string.

    Both rows must have the same values, none of them null, in the columns ``within``. Null texts and keys and texts that are
    empty in canonical form pair with none. Repeated rows make a pair once.

    Plan: each different text goes through DuckDB once. Spellings, that is different texts with one 64-bit key of form and ``within``, are paired first; their rows come
    in afterwards, so copies of a popular title never meet each other. The narrow keys are written once and read by all that follows.
    """
    w = [f"w{i}" for i in range(len(within))]
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(within, w)])
    base = base.where(" and ".join(f"{c} is not null" for c in ("id", "text", *w)))
    forms = with_canonical(base.select("text").distinct(), "text").where("canonical <> ''").select("text", F.xxhash64("canonical").alias("form"))
    # only forms that texts share and rows of them are needed from here on
    odd = forms.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    rows = base.join(forms.join(odd, "form"), "text").select("id", *w, F.xxhash64(*w, "form").alias("k"), F.xxhash64("text").alias("h")).distinct()
    rows = stash(rows)
    spelt = rows.select("k", "h").distinct()
    pairs = spelt.withColumnRenamed("h", "h_a").join(spelt.withColumnRenamed("h", "h_b"), "k").where("h_a <> h_b")
    a, b = (rows.select("k", F.col("h").alias(f"h_{x}"), F.col("id").alias(f"id_{x}"), *([F.col(n).alias(c) for n, c in zip(w, within)] if x == "a" else [])) for x in "ab")
    met = pairs.join(a, ["k", "h_a"]).join(b, ["k", "h_b"])
    return met.where("id_a < id_b").select(*within, "id_a", "id_b").distinct()
