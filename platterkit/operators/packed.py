"""Several values packed in one field (problem 2).

Quoted spans are replaced with indexed placeholders that can't collide with the text, what remains is split at the
delimiters, the spans are put back by array lookup, and the items are exploded with their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks as Unicode knows them; Java's \s has only the ASCII ones.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
SIGN = r"[,;|/&+\n\t]"
#: Delimiters of each field: signs with the blanks around them, and words between blanks.
REFERENCE_DELIMITER = rf"{BLANK}*{SIGN}{BLANK}*(?:(?<={BLANK}|,|;)(?:and|und|et|y|e){BLANK}+)?|{BLANK}+(?:and|und|et|y|e){BLANK}+"
NAME_DELIMITER = rf"{BLANK}*{SIGN}{BLANK}*|{BLANK}+(?i:vs\.?|versus|feat\.?|ft\.?|featuring){BLANK}+"
#: A span in quotes that starts and ends where an item may; quotes are doubled inside.
QUOTED = r'(?<=^|[\s\u00a0\u2000-\u200a\u202f\u3000,;|/&+])"((?:[^"]|"")*)"(?=$|[\s\u00a0\u2000-\u200a\u202f\u3000,;|/&+])'
OPEN, CLOSE = "\ue000", "\ue001"
MARK = rf"{OPEN}(\d+){CLOSE}"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def _escape(text: Column) -> Column:
    """Every OPEN becomes OPEN x CLOSE, so that OPEN, digits, CLOSE can only be a placeholder."""
    return F.when(F.contains(text, F.lit(OPEN)), F.replace(text, F.lit(OPEN), F.lit(f"{OPEN}x{CLOSE}"))).otherwise(text)


def _unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(OPEN)), F.replace(text, F.lit(f"{OPEN}x{CLOSE}"), F.lit(OPEN))).otherwise(text)


def hide_quotes(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__spans``, the contents of the quoted spans as written, and ``__masked``, the text with placeholders."""
    escaped = _escape(F.col(text))
    spans = F.regexp_extract_all(F.col("__escaped"), F.lit(QUOTED), F.lit(1))
    pieces = F.split(F.col("__escaped"), QUOTED)
    masked = F.array_join(
        F.transform(F.col("__pieces"), lambda s, i: F.when(i < F.size("__spans"), F.concat(s, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(s)), ""
    )
    return df.withColumn("__escaped", escaped).withColumns({"__spans": spans, "__pieces": pieces}).withColumn("__masked", masked).drop("__escaped", "__pieces")


def restore(item: Column, spans: Column) -> Column:
    """The value of a piece: a lone placeholder gives its span without quotes, one inside other text the span as written."""
    piece = _strip(item)
    lone = F.get(spans, F.regexp_extract(piece, rf"^{MARK}$", 1).try_cast("int"))
    parts = F.split(piece, MARK)
    numbers = F.regexp_extract_all(piece, F.lit(MARK), F.lit(1))
    inner = F.array_join(
        F.transform(parts, lambda s, i: F.when(i < F.size(numbers), F.concat(s, F.lit('"'), F.get(spans, F.get(numbers, i).cast("int")), F.lit('"'))).otherwise(s)), ""
    )
    value = (
        F.when(piece.rlike(rf"^{MARK}$"), _strip(F.replace(lone, F.lit('""'), F.lit('"')))).when(F.contains(piece, F.lit(OPEN)), inner).otherwise(piece)
    )
    return _unescape(value)


def _packs(df: DataFrame, text: str, delimiter: str) -> DataFrame:
    """The distinct rows of ``df`` whose text has a delimiter outside quotes."""
    some = df.where(F.col(text).rlike(delimiter)).distinct()
    hidden = hide_quotes(some, text)
    return hidden.withColumn("__raw", F.split("__masked", delimiter)).where(F.size("__raw") > 1)


def split_packed(df: DataFrame, key: str, text: str, delimiter: str = REFERENCE_DELIMITER) -> DataFrame:
    """Rows ``(<key>, pos, item)``, one for each value of a field that packs two or more.

    Null and empty texts, texts of one value and texts whose other pieces are empty give no row. Empty items take no
    position; a value listed twice appears twice. Repeated rows give their items once; two different texts under
    one key are split each for itself and the distinct rows of both come out. Rows with a null key are split like others.
    """
    packs = _packs(df.select(F.col(key), F.col(text).alias("__text")), "__text", delimiter)
    items = packs.select(key, F.filter(F.transform("__raw", lambda x: restore(x, F.col("__spans"))), lambda x: x != "").alias("__items"))
    return (
        items.where(F.size("__items") > 1).select(key, F.posexplode("__items").alias("__i", "item")).select(key, (F.col("__i") + 1).alias("pos"), "item").distinct()
    )


def split_names(df: DataFrame, key: str, text: str, known: DataFrame, name: str, delimiter: str = NAME_DELIMITER) -> DataFrame:
    """Like :func:`split_packed`, but names in ``known`` that hold a delimiter themselves stay whole.

    Runs of neighbouring pieces that are together a known name, as written, are joined again; the longest run that
    starts furthest left wins. Runs are as long as the longest known name needs, so none is missed.

    Plan: only names and texts that hold a delimiter take part. The candidate runs (a few a text) meet the names in an equi-join on
    the run's text, and only hits are gathered by text. Candidates are distinct before the join, so a popular name
    costs one row.
    """
    compound = (
        known.select(_strip(F.col(name)).alias("__name"))
        .where(F.col("__name").rlike(delimiter))
        .distinct()
        .withColumn("__width", F.size(F.split("__name", delimiter)))
    )
    packs = _packs(df.select(F.col(key), F.col(text).alias("__text")), "__text", delimiter)
    texts = packs.select("__text", "__masked", "__spans", "__raw").distinct()
    kept = texts.withColumn("__between", F.concat(F.regexp_extract_all("__masked", F.lit(f"({delimiter})"), F.lit(1)), F.array(F.lit(""))))
    tokens = kept.withColumn("__tokens", F.arrays_zip(F.col("__raw").alias("piece"), F.col("__between").alias("mark")))
    widest = compound.agg(F.coalesce(F.max("__width"), F.lit(1)).alias("__widest"))
    n = F.size("__raw")
    run = lambda i, j: restore(
        F.concat(F.array_join(F.transform(F.slice("__tokens", i + 1, j - i - 1), lambda t: F.concat(t["piece"], t["mark"])), ""), F.get(F.col("__tokens"), j - 1)["piece"]), F.col("__spans")
    )
    # each run leaves its text as a name and two numbers; neither pieces nor spans go with it
    of_text = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 2, F.least(n, i + F.col("__widest"))), lambda j: F.struct(i.alias("i"), j.alias("j"), run(i, j).alias("__name")))))
    wide = tokens.withColumn("__id", F.md5("__text")).crossJoin(F.broadcast(widest)).where((n > 1) & (F.col("__widest") > 1))  # one row, a single number
    runs = wide.select("__id", F.inline(of_text))
    hits = runs.join(compound.select("__name"), "__name", "left_semi").groupBy("__id").agg(F.collect_set(F.struct("i", (-F.col("j")).alias("j"))).alias("__hits"))
    # take the hits from left to right, the longest first; one that begins before the end of the last taken is passed over
    taken = F.aggregate(
        F.sort_array(F.coalesce("__hits", F.array().cast("array<struct<i:int,j:int>>"))),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i:int,j:int>>").alias("runs")),
        lambda a, h: F.when(h["i"] >= a["end"], F.struct((-h["j"]).alias("end"), F.array_append(a["runs"], F.struct(h["i"].alias("i"), (-h["j"]).alias("j"))).alias("runs"))).otherwise(a),
    )["runs"]
    joined = tokens.withColumn("__id", F.md5("__text")).join(hits, "__id", "left").drop("__id").withColumn("__runs", taken)
    run_at = lambda i: F.get(F.filter("__runs", lambda r: r["i"] == i), F.lit(0))
    inside = lambda i: F.exists("__runs", lambda r: (r["i"] < i) & (i < r["j"]))
    whole = lambda r: F.concat(
        F.array_join(F.transform(F.slice("__tokens", r["i"] + 1, r["j"] - r["i"] - 1), lambda t: F.concat(t["piece"], t["mark"])), ""),
        F.get(F.col("__tokens"), r["j"] - 1)["piece"],
    )
    joined = joined.withColumn(
        "__list",
        F.filter(
            F.transform(F.col("__tokens"), lambda t, i: F.when(inside(i), F.lit("")).when(run_at(i).isNotNull(), whole(run_at(i))).otherwise(t["piece"])),
            lambda x: x != "",
        ),
    )
    items = joined.select("__text", F.filter(F.transform("__list", lambda x: restore(x, F.col("__spans"))), lambda x: x != "").alias("__items"))
    return (
        packs.select(key, "__text")
        .join(items.where(F.size("__items") > 1), "__text")
        .select(key, F.posexplode("__items").alias("__i", "item"))
        .select(key, (F.col("__i") + 1).alias("pos"), "item")
        .distinct()
    )
