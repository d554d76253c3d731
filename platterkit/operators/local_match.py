"""Matching releases to local folders and tracks to files."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterkit.functions.similarity import process, ratio_similarity, sorted_words, weighted_above
from platterkit.functions.text import clean_filename
from platterkit.session import stash

CONFIDENT = 0.75
#: Most releases or folders of a cell, pairs for which a cell is worth its own task, and so few that they are compared one by one.
BLOCK, CELL_PAIRS, FEW_PAIRS = 32_768, 4_000_000, 128
#: Words of bits of releases that are compared with a folder at once, and characters of a folder's text behind which the states are kept for the next text.
LANES, KEPT = 8192, 64
#: Pairs in arrays at once, bounds in arrays at once and, of a text's characters in bounds, kinds told apart and repeats counted one by one.
PAIRS_AT_ONCE, BOUNDS_AT_ONCE, LETTERS, REPEATS = 32_768, 1_048_576, 256, 6


def _folder_name(path: str = "path") -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def score_folders(releases: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows ``(release_id, path, score)`` for every release with every folder; a folder without a path is none.

    releases: ``id, title, artists`` (text); folders: ``path``. The score is the token sort ratio of "artists title" with the folder's
    last part. There is a row for each pair; :func:`best_folders` finds the best ones without.
    """
    # each text is prepared once and written once
    f = stash(folders.where("path is not null").select("path").distinct().select("path", sorted_words(_folder_name()).alias("own")))
    r = releases.select(F.col("id").alias("release_id"), F.concat_ws(" ", "artists", "title").alias("text")).distinct()
    r = stash(r.select("release_id", sorted_words(F.col("text")).alias("text_words")))
    return r.crossJoin(f).select("release_id", "path", (ratio_similarity(F.col("text_words"), F.col("own")) / 100).alias("score"))


def best_folder(scored: DataFrame) -> DataFrame:
    """Rows ``(release_id, path, score)``: the best folder of each release, of equals the first by path; none with score 0."""
    return scored.where("score > 0").groupBy("release_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "path")).alias("b")).select("release_id", "b.path", (-F.col("b.neg")).alias("score"))


def _key_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of texts, their characters as numbers ``(texts, longest)``, 0 behind an end, their lengths, and the count of numbers."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, number = np.unique(flat, return_inverse=True)
    codes = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.int32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = number + 1
    return codes, lengths, len(known) + 1


def _common_lengths(codes: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, row ``left`` and row ``right`` of ``codes`` each, the right ones by falling length.
    Bit-parallel, 64 characters of the left a word, for all pairs at once."""
    texts, row = np.unique(left, return_inverse=True)
    own = codes[texts][:, : max(1, int(lengths[texts].max()))]
    # only the characters of these texts have a word of bits; the last one stands for all others
    known = np.unique(own)
    known = known[known > 0]
    place = np.full(int(codes.max(initial=0)) + 1, len(known), np.int64)
    place[known] = np.arange(len(known))
    small = place[own]
    words, n_codes = (own.shape[1] + 63) // 64, len(known) + 1
    where = np.zeros((words, len(texts), n_codes), np.uint64)
    for i in range(own.shape[1]):
        where[i // 64, np.arange(len(texts)), small[:, i]] |= np.uint64(1 << i % 64)
    where[:, :, -1] = 0
    at = place[codes[right][:, : max(1, int(lengths[right[0]]))].T] + row * n_codes
    state = np.full((words, len(left)), np.uint64(2**64 - 1))
    going = np.searchsorted(-lengths[right], -np.arange(at.shape[0]), "left")
    for j in range(at.shape[0]):
        carry = None
        here = at[j, : going[j]]
        for w in range(words):
            s = state[w, : going[j]]
            used = where[w].ravel().take(here)
            used &= s
            added = s + used
            if words > 1:
                over = added < s
                if carry is not None:
                    added += carry
                    over |= carry & (added == 0)
                carry = over
            s ^= used
            s |= added
    return np.bitwise_count(~state).sum(0, dtype=np.int64)


def _best_of_lanes(left: np.ndarray, right: np.ndarray, rank: np.ndarray, ratio: np.ndarray, chosen: np.ndarray) -> None:
    """Sets ``ratio`` and ``chosen`` of each text of ``left`` to the best of all texts of ``right`` and its number; of equals the one of least ``rank``.

    All texts of up to LANES, of one length in words of bits, meet one folder's text at once: a character of it is one row of bits of all of them. Folders come in order of
    their texts, and what one has in common with the last at its start isn't worked out again.
    """
    order = sorted(range(len(right)), key=lambda i: (right[i], rank[i]))
    order = [i for i, last in zip(order, [None, *order]) if last is None or right[i] != right[last]]
    lengths = np.fromiter(map(len, left), np.int64, len(left))
    kinds = np.where(lengths <= 32, 0, (lengths + 63) // 64)
    for mine in (some[at : at + LANES // max(kind, 1) + 1] for kind in np.unique(kinds).tolist() for some in [np.flatnonzero(kinds == kind)] for at in range(0, len(some), LANES // max(kind, 1) + 1)):
        kind, n = int(kinds[mine[0]]), len(mine)
        bits, words, whole = (32, 1, np.uint32) if kind == 0 else (64, kind, np.uint64)
        codes, long, n_codes = _key_bits(left[mine].tolist())
        place = {c: i for i, c in enumerate(sorted(set("".join(left[mine]))), 1)}
        where = np.zeros((n_codes, words, n), whole)
        for i in range(codes.shape[1]):
            has = np.flatnonzero(long > i)
            where[codes[has, i], i // bits, has] |= whole(1 << i % bits)
        states = [np.full((words, n), ~whole(0), whole)]
        spare = [np.empty((words, n), whole), np.empty((words, n), whole)]
        used, added = np.empty(n, whole), np.empty(n, whole)
        exact = np.float32 if words == 1 else np.float64
        sizes, least, most = long.astype(exact), np.full(n, -1, exact), np.empty(n, exact)
        before: list[int] = []
        for no in order:
            text = right[no]
            steps = [place[c] for c in text if c in place]  # others change nothing
            same = next((j for j, (x, y) in enumerate(zip(steps[:KEPT], before)) if x != y), min(len(steps), len(before), KEPT))
            state = states[same]
            for j in range(same, len(steps)):
                if j < KEPT and len(states) == j + 1:
                    states.append(np.empty((words, n), whole))
                last, state = state, states[j + 1] if j < KEPT else spare[j % 2]
                carry = None
                for s, out, m in zip(last, state, where[steps[j]]):
                    np.bitwise_and(s, m, out=used)
                    np.add(s, used, out=added)
                    if words > 1:
                        over = added < s
                        if carry is not None:
                            added += carry
                            over |= carry & (added == 0)
                        carry = over
                    np.bitwise_xor(s, used, out=out)
                    np.bitwise_or(out, added, out=out)
            before = steps
            # zeros are what is in common; the little that is added is what rounding may take
            ones = np.bitwise_count(state)
            ones = ones[0] if words == 1 else ones.sum(0, dtype=np.int64)
            np.add(sizes, len(text), out=most)
            most *= least
            np.subtract(bits * words + 0.01, most, out=most)
            may = np.flatnonzero(ones <= most)
            if len(may):
                who, total = mine[may], long[may] + len(text)
                score = np.where(total > 0, 200.0 * (bits * words - ones[may].astype(np.int64)) / np.maximum(total, 1), 100.0)
                better = (score > ratio[who]) | (score == ratio[who]) & (rank[no] < rank[chosen[who]])
                ratio[who[better]], chosen[who[better]] = score[better], no
                least[may[better]] = score[better] / 200 * (1 - 1e-6)


def _best_of_cell(releases: pa.Table, folders: pa.Table, least: float = 0.0) -> pa.Table:
    """Of one cell the best folder of each release among all of them: ``(release_id, path, ratio)``; of equals the first by path; none below ``least``.

    Two texts have no longer common subsequence than they have common characters, whatever their order. With a ``least`` only pairs that so may reach it and the best
    found for the release are compared; without, the bound leaves out too few.
    """
    n = releases.num_rows
    paths = np.array(folders["path"].to_pylist(), object)
    rank = np.empty(len(paths), np.int64)
    rank[np.argsort(np.array([p.encode("utf-8", "surrogatepass") for p in paths], object), kind="stable")] = np.arange(len(paths))
    mine, theirs = (np.array(column.to_pylist(), object) for column in (releases["text_words"], folders["own"]))
    ratio, chosen = np.full(n, -1.0), np.zeros(n, np.int64)
    if not least and n * len(paths) > FEW_PAIRS:
        _best_of_lanes(mine, theirs, rank, ratio, chosen)
        return _found(releases, paths, ratio, chosen, least)
    texts, text_no = np.unique(np.r_[mine, theirs], return_inverse=True)
    r_text, f_text = text_no[:n], text_no[n:]
    codes, lengths, n_codes = _key_bits(list(texts))

    def judge(rs: np.ndarray, fs: np.ndarray) -> None:
        order = np.argsort(r_text[rs], kind="stable")
        for at in range(0, len(rs), PAIRS_AT_ONCE):
            some = order[at : at + PAIRS_AT_ONCE]
            some = some[np.argsort(-lengths[f_text[fs[some]]], kind="stable")]
            f, left, right, who = fs[some], r_text[rs[some]], f_text[fs[some]], rs[some]
            total = lengths[left] + lengths[right]
            score = np.where(total > 0, 200.0 * _common_lengths(codes, lengths, left, right) / np.maximum(total, 1), 100.0)
            first = np.lexsort((rank[f], -score, who))
            first = first[np.r_[True, np.diff(who[first]) > 0]]
            who, score, f = who[first], score[first], f[first]
            better = (score > ratio[who]) | (score == ratio[who]) & (rank[f] < rank[chosen[who]])
            ratio[who[better]], chosen[who[better]] = score[better], f[better]

    def bounded() -> None:
        counts = np.zeros((len(texts), min(n_codes, LETTERS)), np.uint16)  # characters that share a number are taken for the same: the bound stays one
        for i in range(codes.shape[1]):
            some = np.flatnonzero(lengths > i)
            counts[some, codes[some, i] % counts.shape[1]] += 1
        most = np.minimum(counts[r_text].max(0), counts[f_text].max(0))
        steps = [(c, t) for c in np.flatnonzero(most) for t in range(1, min(int(most[c]), REPEATS) + 1)]
        letter, times = np.array([c for c, _ in steps], np.int64), np.array([t for _, t in steps])
        held = lambda t: (counts[t][:, letter] >= times).astype(np.float32)
        rest = lambda t: np.maximum(counts[t].astype(np.int64) - REPEATS, 0).sum(1).astype(np.float32)
        by_length = np.argsort(lengths[f_text], kind="stable")
        step = max(1, BOUNDS_AT_ONCE // LANES)
        for to in range(0, len(by_length), LANES):
            fs = by_length[to : to + LANES]
            right, right_rest, right_n = held(f_text[fs]).T.copy(), rest(f_text[fs]), lengths[f_text[fs]].astype(np.float32)
            for at in range(0, n, step):
                rs = np.arange(at, min(at + step, n))
                total = lengths[r_text[rs]].astype(np.float32)[:, None] + right_n
                bound = held(r_text[rs]) @ right
                if right_rest.any():
                    bound += np.minimum(rest(r_text[rs])[:, None], right_rest)
                bound *= 200
                bound /= np.maximum(total, 1)
                r, f = np.nonzero((bound >= (np.maximum(ratio[rs], least) - 0.01)[:, None]) | (total == 0))  # what rounding may take from a bound
                if len(r):
                    judge(rs[r], fs[f])

    if n * len(paths) <= FEW_PAIRS:
        judge(np.repeat(np.arange(n), len(paths)), np.tile(np.arange(len(paths)), n))
    else:
        bounded()
    return _found(releases, paths, ratio, chosen, least)


def _found(releases: pa.Table, paths: np.ndarray, ratio: np.ndarray, chosen: np.ndarray, least: float) -> pa.Table:
    done = np.flatnonzero((ratio > 0) & (ratio >= least))
    return pa.table({"release_id": releases["release_id"].take(pa.array(done)), "path": pa.array(paths[chosen[done]], pa.string()), "ratio": pa.array(ratio[done])})


def best_folders(releases: DataFrame, folders: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows ``(release_id, path, score)``, the same as :func:`best_folder` of :func:`score_folders`, without a row for each pair; only those of a score of ``least`` or more.

    Every release is compared with every folder, whatever words they share. A cell holds a block of releases and one of folders; its best pairs are found at
    once in arrays. Folders of equal words are one, under the first path. What is shuffled are the texts, once for each block of the other side; what is computed grows
    with releases times folders. Cells are few bytes and much work, so they are spread over partitions of their own, whatever their size.
    """
    f = stash(folders.where("path is not null").select("path", sorted_words(_folder_name()).alias("own")).groupBy("own").agg(F.min("path").alias("path")))
    r = releases.select(F.col("id").alias("release_id"), F.concat_ws(" ", "artists", "title").alias("text")).distinct()
    r = stash(r.select("release_id", sorted_words(F.col("text")).alias("text_words")))
    n_r, n_f = r.count(), f.count()
    side = min(BLOCK, max(1, CELL_PAIRS, n_r * n_f // (4 * r.sparkSession.sparkContext.defaultParallelism)) ** 0.5)
    rows, cols = max(1, math.ceil(n_r / side)), max(1, math.ceil(n_f / side))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = r.withColumn("col", every(cols)).select((block("release_id", rows) * cols + F.col("col")).alias("cell"), "release_id", "text_words")
    right = f.withColumn("row", every(rows)).select((F.col("row") * cols + block("path", cols)).alias("cell"), "path", "own")

    def best_of_cell(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return _best_of_cell(mine, theirs, max(0.0, 100 * least - 1e-6))

    spread = lambda df: df.repartition(4 * rows * cols, "cell").groupBy("cell")
    best = spread(left).cogroup(spread(right)).applyInArrow(best_of_cell, "release_id long, path string, ratio double")
    return best_folder(best.select("release_id", "path", (F.col("ratio") / 100).alias("score")).where(F.col("score") >= least))


def _given_files(tracks: pa.Table, files: pa.Table) -> pa.Table:
    """:func:`assign_files` of one release: ``(release_id, track_id, file, score)``."""
    ready = cache(process)
    named = [(file, ready(name)) for file, name in zip(files["file"].to_pylist(), files["name"].to_pylist())]
    ranked = []
    for track, p, t, a in zip(*(tracks[c].to_pylist() for c in ("track_id", "position", "title", "artist"))):
        place, whole = ready(f"{p or ''} {t or ''}".strip()), ready(f"{t or ''} {a}") if a else ""
        for file, name in named:
            # mostly the text with the artist is the better one: the other is worked out only as far as it may beat it
            score = weighted_above(place, name, weighted_above(whole, name, 0.0))
            ranked.append((-(score / 100), track is None, track or 0, file is None, file or ""))
    ranked.sort()
    tracks_used, files_used, kept = set(), set(), []
    for score, no_track, track, no_file, file in ranked:
        if (no_track, track) not in tracks_used and (no_file, file) not in files_used:
            tracks_used.add((no_track, track))
            files_used.add((no_file, file))
            kept.append((None if no_track else track, None if no_file else file, -score))
    columns = list(zip(*kept)) or [(), (), ()]
    release = tracks["release_id"][:1].to_pylist() * len(kept)
    return pa.table([pa.array(release, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["release_id", "track_id", "file", "score"])


def assign_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows ``(release_id, track_id, file, score)``: files of a release's folder given to its tracks one to one, the best pairs first.

    tracks: ``id, release_id, position, title, artist``; files: ``release_id, file``. All pairs of a release are scored by the better of
    "position title" and "title artist" against the file's clean name; equal scores go by track id, then file. Low scores are
    given too. The assignment is sequential by nature and runs for each release on its own short lists, which meet only there; they are few bytes and much work, so
    they are spread over all shuffle partitions, whatever their size.
    """
    files = stash(files.where("release_id is not null").select("release_id", "file", clean_filename(F.col("file")).alias("name")))
    own = tracks.select("release_id", F.col("id").alias("track_id"), "position", "title", "artist").join(files.select("release_id").distinct(), "release_id", "left_semi")
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "release_id").groupBy("release_id")
    return spread(own).cogroup(spread(files)).applyInArrow(_given_files, "release_id long, track_id long, file string, score double")


def matched_folders(releases: DataFrame) -> DataFrame:
    """One row ``n``: how many releases have a confident local folder."""
    return releases.agg(F.count("local_folder_path").alias("n"))


def _files_of(best: DataFrame, tracks: DataFrame, folders: DataFrame, threshold: float) -> DataFrame:
    sure = best.where(F.col("score") >= threshold).join(folders.select("path", "files"), "path").select("release_id", F.explode("files").alias("file"))
    return assign_files(tracks, sure)


def match_library(releases: DataFrame, tracks: DataFrame, folders: DataFrame, threshold: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """Each release's best folder, and the files given to tracks of releases whose folder is confident. folders: ``path, files``."""
    best = stash(best_folders(releases, folders))
    return best, _files_of(best, tracks, folders, threshold)


def match_files(releases: DataFrame, tracks: DataFrame, folders: DataFrame, threshold: float = CONFIDENT) -> DataFrame:
    """The files of :func:`match_library` alone: pairs of releases and folders that can't be confident aren't compared."""
    return _files_of(best_folders(releases, folders, threshold), tracks, folders, threshold)
