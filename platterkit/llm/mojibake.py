"""Garbled text from wrong character encoding (problem 10).

Adjacent characters are scored by their mutual information over the corpus, maximum-scoring segments isolate the runs
that are improbable, and only inside those runs the inverse mappings are tried: the characters go back to bytes by the
wrong encoding and are decoded by the right one. A mapping is taken if the corpus makes its text more likely.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the pair counts; their number bounds what is gathered and broadcast (8 MB), whatever the corpus.
PAIR_BUCKETS = 1 << 20
#: Buckets of the character counts; exact for the basic plane.
CHAR_BUCKETS = 1 << 16
#: A pair seen in less than this share of all counted pairs has little support, whatever the corpus' size.
SUPPORT = 2e-4
#: Bits by which a restored run must be likelier, for mappings to UTF-8 and for mappings between one-byte encodings.
UTF8_BITS, BYTE_BITS = 4.0, 8.0
#: Bits a pair of a run must cost on average for mappings between one-byte encodings to be tried.
PAIR_BITS = 4.0
#: Encodings text is wrongly decoded with, and one-byte encodings it may have been written in. Python's codec names.
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "iso8859_2", "iso8859_15", "cp866", "cp1254")
WRITTEN = ("cp1251", "koi8_r", "cp1250", "cp1252", "iso8859_2", "cp866", "cp850", "mac_roman", "mac_cyrillic")
_NEVER = re.compile("[\x80-\x9f�]")
#: A sign between small letters, as when letters of a Central European encoding show as signs.
_INSIDE = re.compile(r"[a-zß-öø-ÿ][¡¢£¤¥¦§¨©ª¬®¯°±²³´µ¶¸¹º¼½¾¿][a-zß-öø-ÿ]")
_CLUSTER = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+(?:[\x00-\x7f]{1,2}[^\x00-\x7f]+)*[\x00-\x7f]?")
_RUN = re.compile(r"[^\x00-\x7f]+(?:[\x00-\x7f]{1,2}[^\x00-\x7f]+)*")


@cache
def _decoded(encoding: str) -> tuple[str, ...]:
    """The character of each byte; bytes an encoding leaves undefined stay as they are, as lenient decoders do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@cache
def _byte_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_decoded(encoding))))}


@cache
def _utf8_as(encoding: str) -> re.Pattern:
    """Matches whole UTF-8 sequences of two to four bytes as the encoding shows them."""
    table = _decoded(encoding)
    span = lambda lo, hi: "[" + "".join(re.escape(table[b]) for b in range(lo, hi + 1)) + "]"
    tail = span(0x80, 0xBF)
    return re.compile(f"{span(0xC2, 0xDF)}{tail}|{span(0xE0, 0xEF)}{tail}{{2}}|{span(0xF0, 0xF4)}{tail}{{3}}")


def _from_utf8(text: str, encoding: str) -> str:
    byte = _byte_of(encoding)

    def back(m: re.Match) -> str:
        try:
            return bytes(byte[c] for c in m[0]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return m[0]

    return _utf8_as(encoding).sub(back, text)


@cache
def _broken(encoding: str) -> re.Pattern:
    """Matches the two bytes before a third one that the encoding leaves undefined and a lenient decoder dropped."""
    table = _decoded(encoding)
    span = lambda lo, hi: "[" + "".join(re.escape(table[b]) for b in range(lo, hi + 1)) + "]"
    return re.compile(f"({span(0xE0, 0xEF)}{span(0x80, 0xBF)})(?!{span(0x80, 0xBF)})")


def _mended(text: str) -> Iterator[str]:
    """The text with such dropped bytes put back, each of the bytes that cp1252 leaves undefined in turn."""
    byte = _byte_of("cp1252")
    for lost in (0x9D, 0x81, 0x8D, 0x8F, 0x90):

        def back(m: re.Match) -> str:
            try:
                return bytes([*(byte[c] for c in m[1]), lost]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                return m[0]

        there = _from_utf8(_broken("cp1252").sub(back, text), "cp1252")
        if there != text:
            yield there


@cache
def _bytewise(wrong: str, written: str) -> dict[int, str]:
    a, b = _decoded(wrong), _decoded(written)
    return {ord(a[i]): b[i] for i in range(255, 127, -1) if a[i] != b[i]}


def certainly_garbled(text: str) -> bool:
    """Whether a text must be kept out of the corpus counts: it holds characters text never has, a sequence of three
    or more bytes shown in a wrong encoding, three different ones of two, or a sign inside a word."""
    if text.isascii():
        return False
    if _NEVER.search(text) or _INSIDE.search(text):
        return True
    for encoding in ("cp1252", "cp437", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp850"):
        byte, seen = _byte_of(encoding), set()
        for m in _utf8_as(encoding).finditer(text):
            try:
                bytes(byte[c] for c in m[0]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            seen.add(m[0])
            if len(m[0]) > 2 or len(seen) > 2:
                return True
    return False


def _hash_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * 0x9E3779B1) ^ (b.astype(np.uint64) * 0x85EBCA77) ^ (a.astype(np.uint64) >> np.uint64(7))) & np.uint64(PAIR_BUCKETS - 1)


def _hash_pair(a: int, b: int) -> int:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (a >> 7)) & (PAIR_BUCKETS - 1)


def count_pairs(texts: Iterator[list[str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of adjacent characters of which one isn't ASCII, and of such characters themselves."""
    pairs, chars = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(CHAR_BUCKETS, np.int64)
    for some in texts:
        for t in some:
            if not t or t.isascii() or certainly_garbled(t):
                continue
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            a, b = points[:-1], points[1:]
            odd = (a > 127) | (b > 127)
            np.add.at(pairs, _hash_pairs(a[odd], b[odd]).astype(np.int64), 1)
            np.add.at(chars, (points[points > 127] & (CHAR_BUCKETS - 1)).astype(np.int64), 1)
    return pairs, chars


@dataclass
class Corpus:
    """Pair statistics of the clean part of a corpus, and the tests that rest on them."""

    pairs: np.ndarray
    chars: np.ndarray
    total: int = field(init=False)

    def __post_init__(self) -> None:
        self.total = max(int(self.pairs.sum()), 1)
        self._clusters: dict[str, tuple[str, int]] = {}

    def seen(self, c: str) -> int:
        return int(self.chars[ord(c) & (CHAR_BUCKETS - 1)]) if ord(c) > 127 else self.total

    def information(self, a: str, b: str) -> float:
        """Discounted pointwise mutual information in bits; pairs of little support fall below 0."""
        n = int(self.pairs[_hash_pair(ord(a), ord(b))])
        return float(np.log2((n + 0.5) / (min(self.seen(a), self.total) * min(self.seen(b), self.total) / self.total / 8 + SUPPORT * self.total + 0.5)))

    def likelihood(self, text: str) -> float:
        """Bits of a text by the pairs of the corpus; pairs of ASCII characters count nothing."""
        bits = 0.0
        for a, b in zip(text, text[1:]):
            if a > "\x7f" or b > "\x7f":
                n = int(self.pairs[_hash_pair(ord(a), ord(b))])
                p_b = (self.seen(b) + 0.1) / (self.total + 1) if b > "\x7f" else 0.02
                bits += float(np.log2((n + 2 * p_b) / (self.seen(a) + 2)))
        return bits

    def segments(self, cluster: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments (Ruzzo and Tompa) of the pairs' improbability, as character spans."""
        stack: list[list[float]] = []  # start, end, sum before, sum after
        total = 0.0
        for i, (a, b) in enumerate(zip(cluster, cluster[1:])):
            score = -self.information(a, b) if a > "\x7f" or b > "\x7f" else -1.0
            if _NEVER.match(a) or _NEVER.match(b):
                score = max(score, 4.0)
            if score <= 0:
                total += score
                continue
            new = [i, i + 1, total, total + score]
            total += score
            while True:
                j = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][2] < new[2]), -1)
                if j < 0 or stack[j][3] >= new[3]:
                    stack.append(new)
                    break
                new = [stack[j][0], new[1], stack[j][2], new[3]]
                del stack[j:]
        return [(int(s[0]), int(s[1]) + 1) for s in stack]

    def inverse(self, run: str, before: str, after: str) -> str:
        """The likeliest text that a run stands for, perhaps itself."""
        while True:  # each turn makes the run likelier, so it ends
            own = self.likelihood(before + run + after)
            best, gain = run, 0.0
            for there in {_from_utf8(run, wrong) for wrong in WRONG} | set(_mended(run)):
                if there != run and (g := self._gain(there, run, before, after, own) - UTF8_BITS) > gain:
                    best, gain = there, g
            if own < -PAIR_BITS * (len(run) + 1):  # a run whose pairs are common stands for itself
                for there in {run.translate(_bytewise(wrong, written)) for wrong in WRONG for written in WRITTEN if wrong != written}:
                    if there != run and not _NEVER.search(there) and (g := self._gain(there, run, before, after, own) - BYTE_BITS) > gain:
                        best, gain = there, g
            if best == run:
                return run
            run = best

    def _gain(self, there: str, run: str, before: str, after: str, own: float) -> float:
        unknown = sum(1 for c in there if c > "\x7f" and not self.seen(c) and c not in run)
        return self.likelihood(before + there + after) - own - 12.0 * unknown

    def restore_cluster(self, cluster: str) -> tuple[str, int]:
        """A cluster with its garbled runs restored, and how many runs were garbled."""
        known = self._clusters.get(cluster)
        if known is None:
            found = len(re.findall("�+", cluster))
            spans: list[tuple[int, int]] = []
            for start, end in sorted(self.segments(cluster)):
                # the whole runs that the segment touches: half a sequence can't be mapped back
                for m in _RUN.finditer(cluster):
                    if m.start() < end and start < m.end() and (m.start(), m.end()) not in spans:
                        spans.append((m.start(), m.end()))
            out, at = [], 0
            for start, end in sorted(spans):
                run = cluster[start:end]
                there = self.inverse(run, cluster[max(0, start - 1) : start], cluster[end : end + 1])
                found += there != run or bool(re.search("[\x80-\x9f]", run))
                out += [cluster[at:start], there]
                at = end
            known = "".join([*out, cluster[at:]]), found
            if len(self._clusters) > 200_000:  # a cache only
                self._clusters.clear()
            self._clusters[cluster] = known
        return known

    def restore(self, text: str | None) -> tuple[str | None, int]:
        """A text with every garbled run restored where possible, and the number of garbled runs."""
        if not text or text.isascii():
            return text, 0
        found = 0

        def one(m: re.Match) -> str:
            nonlocal found
            there, n = self.restore_cluster(m[0])
            found += n
            return there

        return _CLUSTER.sub(one, text), found


def corpus_model(df: DataFrame, text: str) -> Corpus:
    """Pair statistics of all texts of a table that aren't certainly garbled.

    Each task adds its texts into two arrays of fixed size; what is gathered is at most PAIR_BUCKETS + CHAR_BUCKETS rows
    of counts, never texts or fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = count_pairs(b.column(0).to_pylist() for b in batches)
        for kind, counts in ((0, pairs), (1, chars)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["kind", "bucket", "n"])

    rows = df.select(text).mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (rows.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    pairs, chars = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(CHAR_BUCKETS, np.int64)
    pairs[bucket[kind == 0]] = n[kind == 0]
    chars[bucket[kind == 1]] = n[kind == 1]
    return Corpus(pairs, chars)


def restore_texts(df: DataFrame, text: str, keep_text: bool = True) -> DataFrame:
    """``df`` with ``garbled_runs`` (int), the number of garbled runs, and ``restored``, the text with those restored that can be.

    Runs of replacement characters count as garbled and stay. Null and empty texts have none. Whole texts are taken. Columns that already
    bear these names are replaced. With ``keep_text`` false the text and its restored form are left out.

    Plan: one pass that counts, one that restores; no shuffle but of the bounded counts.
    """
    model = df.sparkSession.sparkContext.broadcast((lambda m: (m.pairs, m.chars))(corpus_model(df, text)))
    kept = [f for f in df.schema if f.name not in ("garbled_runs", "restored") and (keep_text or f.name != text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "garbled_runs int", *(["restored string"] if keep_text else [])])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus(*model.value)
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            done = [corpus.restore(t) for t in column[text].to_pylist()]
            new = [pa.array([n for _, n in done], pa.int32())] + ([pa.array([t for t, _ in done], pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([*(column[n] for n in names), *new], names=[*names, "garbled_runs", *(["restored"] if keep_text else [])])

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)
