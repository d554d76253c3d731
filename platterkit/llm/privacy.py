"""Personal information inside free text (problem 4).

Information-theoretic sanitisation. Spans that might reveal a person (addresses, e-mail addresses, numbers, pairs of capitalised words) are
taken from the texts as candidates. Co-occurrence over the corpus then estimates how strongly each term, that is a number's
shape, a family name, the words around a span or the company of certain mentions in a text, reveals a protected entity, starting from mentions that are certain: a number
after a word that announces it, a known given name before a rare family name. Candidates whose terms
exceed the disclosure threshold are replaced by the placeholder of their type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterkit.session import stash

#: A name in this share of the different texts, or more, and in so many of them, loses TERM_BITS and is no seed; one in half as many loses nothing.
COMMON_SHARE, COMMON_USES = 0.02, 3
#: Texts as many as these, with the corpus's share of certain mentions, are added to those of a name when its company is weighed.
COMPANY_PRIOR = 4.0
#: Uses of words around a span from which they are weighed: what was seen once says nothing of others.
CONTEXT_USES = 2
#: Digits of a number that may reveal a person by its shape, and of one that a word announces.
NUMBER_DIGITS, ANNOUNCED_DIGITS = 6, 5
#: A number's shape reveals a person if this share of its occurrences is announced by a word.
SHAPE_SHARE = 0.15
#: Bits a known given name adds, and the most that one term adds or takes.
GIVEN_BITS, TERM_BITS = 5.0, 6.0

# Words that announce numbers issued to persons, and telephone numbers, in several languages.
ID_WORDS = (
    "SSN|SS#|social security|National Insurance|NI number|NI no|DNI|documento|NIF|NIE|CNI|carte d.identité|carte nationale|Steuer-?ID|Steuer-Identifikationsnummer|Steuernummer"
    "|Personalausweis|Ausweis|personnummer|pnr|passport|Reisepass|pasaporte|passeport|paszport|passaporte|PESEL|CPF|RG|BSN|codice fiscale|tax id|ID card|identity card|driving licence|Führerschein"
)
PHONE_WORDS = "tel|telephone|téléphone|telefon|teléfono|telefone|phone|call|mobile|mobil|handy|cell|whatsapp|anrufen|ruf|llamar|llame|appeler|ligar|fono|fax|sms"

_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĻŁŃŅŇŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽА-ЯЁ]"
_WORD = rf"{_CAP}[\w]+(?:[-’'](?=\w)\w+)*"
_TOWN = rf"(?:{_WORD}|{_CAP}\w+(?:-\w+)+)(?: {_WORD})?"
_EMAIL = re.compile(
    r"(?:mailto:)?[\w.+-]*\w\s?(?:@|＠)\s?[\w-]+(?:\.[\w-]+)+"
    r"|[\w.+-]*\w\s?[\[({<]\s?(?:at|@|ät|arroba|chez|małpa)\s?[\])}>]\s?[\w-]+(?:(?:\s?[\[({<]\s?(?:dot|punkt|point|punto|ponto|kropka)\s?[\])}>]\s?|\.)[\w-]+)+"
    r"|[\w.+-]*\w (?:at|arroba) [\w-]+(?: (?:dot|punkt|point|punto|ponto) [\w-]+)+",
    re.I,
)
_STREET = "St|Street|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Way|Close|Terrace|Place|Square|Court|Hill|Row|Crescent|Gardens|Grove|Boulevard|Blvd"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+\w?,? )?\b\d{{1,4}}[a-zA-Z]? (?:{_WORD} ){{1,3}}(?:{_STREET})\b\.?(?:, {_TOWN}(?: \d{{3}} ?\d{{2}})?)?"
    rf"|\b{_CAP}[\w-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|vägen|gatan|laan|straat) \d{{1,4}}(?: ?[a-z]\b)?(?:(?:,| in)? ?(?:\d{{3}} ?\d{{2}} )?{_TOWN})?"
    rf"|\b\d{{1,4}}(?: ?bis| ?ter)?,? (?:rue|avenue|boulevard|chemin|place|allée|impasse|quai|route|cours) (?:(?:de la|de|du|des|d’|d'|la|le) ?)?{_WORD}(?:[ -]{_WORD})?(?:, (?:\d{{5}} )?{_TOWN})?"
    rf"|\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Rua|Via|Viale|ul\.|ulica) (?:(?:de la|de los|de|del|da|do|dos) )?{_WORD}(?: {_WORD})?,? \d{{1,4}}(?: ?[a-z]\b)?(?:, (?:\d{{2}}-?\d{{3}} )?{_TOWN})?"
)
_NUMBER = re.compile(
    r"(?<![\w@.-])(?:\+?\(\+?\d+\)|\+?\d+(?:[A-Z]{1,2}\d*)?|[A-Z]{1,2}\d+(?:[A-Z]\d*)?|[A-Z]{2}(?= \d))(?:[ ./-]?\(\d+\)|[ ./-]\d+[A-Z]?|(?<=\))\d+| [A-Z]\b)*(?![\w@])"
)
#: Numbers written for dialling: with a country's prefix, or an area code in brackets.
_DIALLED = re.compile(r"\+\d{1,3}[ (]|\(0?\d{2,4}\) ?\d{3}")
_NAME_TOKEN = re.compile(rf"{_WORD}|{_CAP}\.(?= {_CAP})")
_ID_BEFORE = re.compile(rf"(?i:\b(?:{ID_WORDS}))\W*(?:(?:no|nr|n°|nº|number|num|num\.|número|nummer)\b\.?)?[\s:.#°º-]*\Z", re.I)
_PHONE_BEFORE = re.compile(rf"\b(?:{PHONE_WORDS})\b[\s:.]*(?:(?:me|us|al|at|an|under|on|no|nr|n°|bei [^:\n]{{1,40}})[\s:.]*)?\Z", re.I)


def shape(number: str) -> str:
    """A number's form: digits as 9, letters as A, everything else as it is."""
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", number))


def candidates(text: str) -> list[tuple]:
    """Rows (kind, start, end, surface, given, family, left, right, shape, seed) of a text; kinds are final for e-mails and addresses."""
    out: list[tuple] = []
    masked = text
    for kind, pattern in (("email", _EMAIL), ("address", _ADDRESS)):
        for m in pattern.finditer(masked):
            out.append((kind, m.start(), m.end(), m[0], None, None, None, None, None, kind))
        masked = pattern.sub(lambda m: "\x00" * len(m[0]), masked)
    for m in _NUMBER.finditer(masked):
        digits = sum(c.isdigit() for c in m[0])
        if digits >= ANNOUNCED_DIGITS:
            before = masked[max(0, m.start() - 60) : m.start()]
            seed = "id" if _ID_BEFORE.search(before) else "phone" if _PHONE_BEFORE.search(before) or _DIALLED.match(m[0]) else None
            if seed is None and digits < NUMBER_DIGITS:
                continue
            out.append(("number", m.start(), m.end(), m[0], None, None, None, None, shape(m[0]), seed))
    tokens = [(m.start(), m.end(), m[0]) for m in _NAME_TOKEN.finditer(masked)]
    for i, (start, end, given) in enumerate(tokens):
        if len(given) < 2 or given.endswith("."):
            continue
        j = i + 1
        if j < len(tokens) and tokens[j][2].endswith(".") and masked[end : tokens[j][0]] == " ":
            end, j = tokens[j][1], j + 1
        if j >= len(tokens) or masked[end : tokens[j][0]] != " " or tokens[j][2].endswith("."):
            continue
        stop, family = tokens[j][1], tokens[j][2]
        for suffix in ("'s", "’s"):
            if family.endswith(suffix):
                stop, family = stop - 2, family[:-2]
        left = re.findall(r"[\w.#'’-]+|[^\w\s]|\n|\A", masked[max(0, start - 40) : start].rstrip(" "))[-2:]
        right = re.findall(r"[\w'’-]+|[^\w\s]|\n", masked[stop : stop + 30])[:2]
        out.append(("name", start, stop, masked[start:stop], given, family, " ".join(left).lower(), " ".join(right).lower(), None, None))
    return out


_FIELDS = "kind string, start int, end int, surface string, given string, family string, left string, right string, shape string, seed string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["src", "rec_id", "copy", *(f.split()[0] for f in _FIELDS.split(", "))]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 7]
    for batch in batches:
        rows = [(s, i, h, *c) for s, i, t, h in zip(*(batch.column(k).to_pylist() for k in range(4))) if t for c in candidates(t)]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _bits(n: Column, seeds: Column, prior: Column) -> Column:
    """Bits by which a term makes a protected entity likelier, from its occurrences and those beside a seed."""
    odds = (seeds + prior) / (n - seeds + (1 - prior))
    return F.least(F.greatest(F.log2(odds / (prior / (1 - prior))), F.lit(-TERM_BITS)), F.lit(TERM_BITS))


def disclosed_numbers(spans: DataFrame) -> DataFrame:
    """The number candidates that reveal a person, with kind ``id`` or ``phone``, by the shape's co-occurrence with announcing words."""
    numbers = spans.where("kind = 'number'")
    of = lambda k: F.sum((F.col("seed") == k).cast("long"))
    shapes = (
        numbers.groupBy("shape")
        .agg(F.count("*").alias("n"), F.coalesce(of("id"), F.lit(0)).alias("ids"), F.coalesce(of("phone"), F.lit(0)).alias("phones"))
        .where((F.col("ids") + F.col("phones")) >= SHAPE_SHARE * F.col("n"))
        .select("shape", F.when(F.col("ids") >= F.col("phones"), "id").otherwise("phone").alias("shape_kind"))
    )
    found = numbers.drop("kind").join(shapes, "shape", "left").withColumn("kind", F.coalesce("seed", "shape_kind")).where("kind is not null")
    # what no word announces has to be as long as a phone number with its area
    return found.where("kind = 'id' or seed is not null or length(regexp_replace(surface, '[^0-9]', '')) between 9 and 15").select("src", "rec_id", "kind", "start", "end", "surface")


def disclosed_names(spans: DataFrame, texts: DataFrame, artists: DataFrame, given_names: DataFrame) -> DataFrame:
    """The name candidates that reveal a private person."""
    names = spans.where("kind = 'name'")
    total = texts.agg(F.count("*").alias("texts"), F.count_distinct("copy").alias("different"))
    full = F.concat_ws(" ", "given", "family")
    terms = ["surface", "given", "family", "left", "right"]
    # texts that certainly mention a person, by other kinds: what often stands in their company is about persons
    certain = spans.where("kind in ('email', 'address') or seed is not null").select("copy", F.lit(1).alias("company")).distinct()
    base_share = certain.agg(F.count("*").alias("certain"))
    uses = names.groupBy(*terms, "copy").agg(F.count("*").alias("n")).join(certain, "copy", "left")
    uses = uses.groupBy(*terms).agg(F.sum("n").alias("n"), F.count("*").alias("texts_with"), F.count("company").alias("company")).withColumn("name", full)
    # counted over different texts, so that copies don't weigh
    common = uses.groupBy("surface").agg(F.sum("texts_with").alias("uses"), F.sum("company").alias("company")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(base_share))
    # a text doesn't vouch for its own name
    rate = F.greatest(F.least(F.col("certain") / F.greatest("different", F.lit(1)), F.lit(0.5)), F.lit(1e-4))
    others, beside = F.col("uses") - 1, F.greatest(F.col("company") - 1, F.lit(0))
    odds = (beside + COMPANY_PRIOR * rate) / (others - beside + COMPANY_PRIOR * (1 - rate))
    company = F.least(F.greatest(F.log2(odds / (rate / (1 - rate))), F.lit(0.0)), F.lit(TERM_BITS))
    share = F.log2(2 * F.col("uses") / F.greatest(COMMON_SHARE * F.col("different"), F.lit(COMMON_USES)))
    common = common.select("surface", (-TERM_BITS * F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))).alias("common_bits"), company.alias("company_bits"))
    uses = uses.drop("company").join(common, "surface")
    known = artists.select(F.col("name").alias("name"), F.lit(True).alias("artist")).where("name is not null").distinct()
    listed = given_names.select(F.col("name").alias("given"), F.lit(True).alias("listed")).where("given is not null").distinct()
    uses = uses.join(known, "name", "left").join(F.broadcast(listed), "given", "left")  # the list of given names doesn't grow
    # a frequent name is scored like any, but is no evidence about others
    uses = uses.withColumn("e", F.when(F.col("common_bits") > -TERM_BITS, F.col("n")).otherwise(F.lit(0)))
    uses = uses.withColumn("s", F.when(F.col("listed") & F.col("artist").isNull(), F.col("e")).otherwise(F.lit(0)))
    uses = stash(uses.select(*terms, "n", "e", "s", "listed", "artist", "common_bits", "company_bits"))  # read five times
    prior = uses.agg(F.greatest(F.least((F.sum("s") + 1) / (F.sum("e") + 2), F.lit(0.5)), F.lit(1e-4)).alias("prior"))
    family = uses.groupBy("family").agg(F.sum("e").alias("fn"), F.sum("s").alias("fs"))
    base = uses.crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(total)).join(family, "family")  # one number each

    def context(side: str) -> DataFrame:
        counts = uses.groupBy(side).agg(F.sum("n").alias("all"), F.sum("e").alias(f"{side}_n"), F.sum("s").alias(f"{side}_s"))
        return counts.where(F.col("all") >= CONTEXT_USES).drop("all")

    scored = base.join(context("left"), "left", "left").join(context("right"), "right", "left")
    # a use doesn't vouch for itself
    own = lambda n, s: F.when(F.col(n).isNull(), F.lit(0.0)).otherwise(_bits(F.col(n) - F.col("e"), F.col(s) - F.col("s"), F.col("prior")))
    score = (
        F.log2(F.col("prior") / (1 - F.col("prior")))
        + own("fn", "fs") + own("left_n", "left_s") + own("right_n", "right_s")
        + F.when(F.col("listed"), GIVEN_BITS).otherwise(0.0) + F.col("common_bits") + F.col("company_bits")
    )
    good = scored.where("artist is null").withColumn("score", score).where("score > 0").select("surface", "left", "right", "score")
    hits = names.join(good, ["surface", "left", "right"])
    # of overlapping pairs ("Herr Thomas", "Thomas Weber") the one that reveals most stays
    pairs = hits.groupBy("src", "rec_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "end", "surface"))).alias("found"))
    kept = F.aggregate(
        "found",
        F.array().cast("array<struct<rank:double,start:int,end:int,surface:string>>"),
        lambda a, x: F.when(F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), a).otherwise(F.array_append(a, x)),
    )
    return pairs.select("src", "rec_id", F.explode(kept).alias("x")).select("src", "rec_id", F.lit("name").alias("kind"), "x.start", "x.end", "x.surface")


def find_mentions(texts: DataFrame, artists: DataFrame, given_names: DataFrame) -> DataFrame:
    """Rows ``(src, rec_id, kind, start, end, surface)``, one for each mention of personal information.

    ``texts`` has ``src, rec_id, text``. Kinds are name, email, phone, id and address. Null and empty texts have no mention; repeated rows give theirs
    once. A name whose two words are together the name of an artist is no private person. Whole texts are read.

    Plan: one Arrow pass gives narrow candidates, written once, as are the different uses of names with their counts; repeated spans are aggregated to their different uses before anything is joined, counts are
    aggregated partially, and only one-row totals and the list of given names are broadcast. What is
    gathered by text are the few mentions of one description.
    """
    own = texts.select("src", F.col("rec_id").cast("long"), F.col("text").cast("string")).where("rec_id is not null and text <> ''").distinct().withColumn("copy", F.xxhash64("text"))
    spans = stash(own.mapInArrow(_extract, f"src string, rec_id long, copy long, {_FIELDS}"))
    fixed = spans.where("kind in ('email', 'address')").select("src", "rec_id", "kind", "start", "end", "surface")
    return fixed.unionByName(disclosed_numbers(spans)).unionByName(disclosed_names(spans, own, artists, given_names)).distinct()


def numbered_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with ``mention_no``, counted from 1 in each text and kind in order of appearance."""
    per = mentions.groupBy("src", "rec_id", "kind").agg(F.sort_array(F.collect_set(F.struct("start", "surface"))).alias("all"))
    return per.select("src", "rec_id", "kind", F.posexplode("all").alias("i", "m")).select("src", "rec_id", "kind", (F.col("i") + 1).alias("mention_no"), F.col("m.surface").alias("surface"))


def sanitise(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """``texts`` (``src, rec_id, text``) with ``clean``, each mention replaced by its type in brackets, the rest as it is."""
    per = mentions.groupBy("src", "rec_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("m"))
    parts = F.aggregate(
        F.coalesce("m", F.array().cast("array<struct<start:int,end:int,kind:string>>")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(
            F.struct(x["end"].alias("at"), F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("done"))
        ),
    )
    joined = texts.distinct().join(per, ["src", "rec_id"], "left").withColumn("p", parts)
    rest = F.substring(F.col("text"), F.col("p.at") + 1, F.length("text"))
    return joined.select("src", "rec_id", "text", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.concat("p.done", rest)).alias("clean"))
