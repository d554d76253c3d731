"""Filling fixed-capacity containers with items (problem 8).

Bin completion: a container is begun with the largest text left, and the undominated ways to fill it up are enumerated, the
fullest first; a branch is pruned as soon as the unused space it has made can't beat the best solution known.
Best-fit-decreasing gives the first such solution. A block whose solution meets a lower bound, or whose search ended without having been cut
short, is proven to have the fewest containers; the result tells of each block whether it is.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterkit.session import stash

#: Texts packed together, about. Blocks are packed independently; each wastes at most part of one container more.
BLOCK_TEXTS = 8192
#: Most tasks that blocks are spread over.
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Limits:
    """What cuts the search short; None is no limit. Beyond the limits the best solution known stands, which best-fit-decreasing begins."""

    #: steps of the search for one container's fillings (a step is a text placed); the first, greedy filling is always found
    steps: int | None = 400
    #: fillings of one container that are tried, the fullest first
    fillings: int | None = 8
    #: containers tried in a block
    containers: int | None = 40_000


LIMITS, EXACT = Limits(), Limits(None, None, None)


class _Sizes:
    """A multiset of sizes: distinct sizes in order, and how many of each are left."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.values, self.counts = values.tolist(), counts.tolist()

    def largest(self, at_most: int, below: int | None = None) -> int:
        """Index of the largest size left that is at most ``at_most`` and whose index is at most ``below``; -1 if there is none."""
        i = bisect.bisect_right(self.values, at_most) - 1
        if below is not None and below < i:
            i = below
        while i >= 0 and not self.counts[i]:
            i -= 1
        return i


def _undominated(left: _Sizes, chosen: list[int], room: int) -> bool:
    """Whether no text left could join, or replace a smaller chosen one, within the room that remains."""
    if left.largest(room) >= 0:
        return False
    return all(left.values[left.largest(left.values[i] + room)] <= left.values[i] if left.largest(left.values[i] + room) >= 0 else True for i in set(chosen))


def completions(left: _Sizes, room: int, most_waste: int, limits: Limits = LIMITS) -> tuple[list[tuple[int, list[int]]], bool]:
    """Undominated fillings of ``room`` as (waste, indexes of sizes), the fullest first, waste at most ``most_waste``; and whether these are all that need be tried.

    A single text that fills the room dominates every other filling, so it ends the search. With limits any filling without waste does.
    """
    found: list[tuple[int, list[int]]] = []
    chosen: list[int] = []
    budget = limits.steps if limits.steps is not None else 1 << 62
    whole = True
    below = lambda i: left.largest(left.values[i] - 1, i - 1) if i else -1
    first = left.largest(room)
    if first < 0:
        return ([(room, [])] if room <= most_waste else []), True
    reached = False
    frames = [[room, first]]  # room left, index of the size to try next
    while frames:
        space, i = frames[-1]
        if i < 0 or (budget <= 0 and reached):
            whole = whole and i < 0
            frames.pop()
            if frames:
                left.counts[chosen.pop()] += 1
                frames[-1][1] = below(frames[-1][1])
            continue
        budget -= 1
        left.counts[i] -= 1
        chosen.append(i)
        rest = space - left.values[i]
        following = left.largest(rest, i)
        if following >= 0:
            frames.append([rest, following])
            continue
        reached = True
        if rest <= most_waste and _undominated(left, chosen, rest):
            found.append((rest, chosen.copy()))
        alone = len(chosen) == 1
        left.counts[chosen.pop()] += 1
        frames[-1][1] = below(i)
        if rest == 0 and (alone or limits.steps is not None):
            whole = whole and alone
            for j in chosen:
                left.counts[j] += 1
            break
    found.sort(key=lambda f: f[0])
    if limits.fillings is not None and len(found) > limits.fillings:
        found, whole = found[: limits.fillings], False
    return found, whole


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: containers as lists of sizes."""
    rooms: list[tuple[int, int]] = []  # (room, container), in order
    bins: list[list[int]] = []
    for s in sorted(sizes.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        bisect.insort(rooms, (room - s, b))
    return bins


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A number of containers that no packing can go below: sizes too large to share one are counted, the rest must fit into the space they leave or into further ones."""
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    at = lambda x: np.searchsorted(s, x, side="right")  # sizes up to x
    bound = -(-int(total[-1]) // capacity)
    low = np.unique(np.concatenate([[0], s[s <= capacity / 2]]))  # sizes below are left out
    half, most = at(capacity // 2), at(capacity - low)
    begin = np.searchsorted(s, low, side="left")
    large, middle = len(s) - most, most - half
    room = middle * capacity - (total[most] - total[half])
    more = np.ceil((total[half] - total[begin] - room) / capacity).astype(int)
    return max(bound, int((large + middle + np.maximum(more, 0)).max()))


def pack(sizes: np.ndarray, capacity: int, limits: Limits = LIMITS) -> tuple[list[list[int]], bool]:
    """Containers, as lists of sizes, for sizes of at most ``capacity``, and whether fewer are proven impossible; all sizes are packed."""
    if not len(sizes):
        return [], True
    best = best_fit(sizes, capacity)
    bound = fewest(sizes, capacity)
    if len(best) <= bound:
        return best, True
    left = _Sizes(sizes)
    # each level: fillings still to try, and the waste so far
    levels: list[tuple[list[list[int]], int]] = []
    bins: list[list[int]] = []
    remaining, waste, whole = len(sizes), 0, True
    total = int(sizes.sum())
    tries = limits.containers if limits.containers is not None else 1 << 62

    def open_level() -> None:
        nonlocal whole
        first = left.largest(capacity)
        left.counts[first] -= 1
        slack = (len(best) - 1) * capacity - total - waste  # the waste that still lets this branch win
        ways, all_ = completions(left, capacity - left.values[first], slack, limits) if slack >= 0 else ([], True)
        left.counts[first] += 1
        whole = whole and all_
        levels.append(([[first, *w] for _, w in reversed(ways)], waste))

    open_level()
    while levels and tries > 0:
        ways, base = levels[-1]
        if len(bins) == len(levels):  # coming back: undo this level's container
            for i in bins.pop():
                left.counts[i] += 1
                remaining += 1
        waste = base
        if not ways:
            levels.pop()
            continue
        tries -= 1
        chosen = ways.pop()
        for i in chosen:
            left.counts[i] -= 1
        remaining -= len(chosen)
        bins.append(chosen)
        waste = base + capacity - sum(left.values[i] for i in chosen)
        if not remaining:
            if len(bins) < len(best):
                best = [[left.values[i] for i in b] for b in bins]
            if len(best) <= bound:
                break
            continue
        open_level()
    return best, len(best) <= bound or (whole and not levels)


def pack_texts(sized: DataFrame, key: str, size: str, capacities: DataFrame, block_texts: int | None = BLOCK_TEXTS, limits: Limits = LIMITS) -> DataFrame:
    """Rows ``(pack_name, container, <key>, piece_no, start_token, tokens, proven)``: every text assigned for each capacity.

    ``capacities`` has ``pack_name, capacity_tokens`` and, as a table of settings, few rows. A text longer than a capacity is
    cut into full containers and a rest, which is packed like a text; any other text stays whole. Texts of null or no
    tokens and null keys need no container and give no row. Equal keys are equal texts and are packed once.
    Capacities that are null or not positive are ignored. ``proven`` tells whether the block of the container is proven to have the fewest containers. The
    exact mode, ``block_texts=None, limits=EXACT``, packs each capacity as one block without limits and is for what one task can hold and search.

    Plan: sizes are written once; after that only sizes move, never texts. A text's block comes from a hash of its key; blocks hold ``block_texts`` texts on
    average whatever the sources' sizes, so no task's group grows with the data.
    """
    sized = stash(sized.where(F.col(key).isNotNull() & (F.col(size) > 0)).groupBy(F.col(key).alias("key")).agg(F.max(size).alias("n")))
    fit = capacities.where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    blocks = max(1, -(-sized.count() // block_texts)) if block_texts else 1
    items = sized.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).crossJoin(F.broadcast(fit))  # settings: a few rows
    full = F.floor(F.col("n") / F.col("capacity"))
    pieces = items.withColumns({"full": F.when(F.col("n") > F.col("capacity"), full).otherwise(0), "rest": F.when(F.col("n") > F.col("capacity"), F.col("n") % F.col("capacity")).otherwise(F.col("n"))})
    name = lambda *parts: F.concat_ws("-", *parts)
    whole = pieces.where("full > 0").select("pack_name", "key", "capacity", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no")).select(
        "pack_name", name(F.lit("f"), F.col("key"), F.col("piece_no")).alias("container"), "key", "piece_no", ((F.col("piece_no") - 1) * F.col("capacity")).alias("start_token"), F.col("capacity").cast("long").alias("tokens"), F.lit(True).alias("proven")
    )
    rests = pieces.where("rest > 0").select("pack_name", "block", "capacity", "key", "full", "rest")
    key_type = dict(sized.dtypes)["key"]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        bins, proven = pack(pdf["rest"].to_numpy(), capacity, limits)
        order = pdf.sort_values(["rest", "key"], kind="stable")
        queues: dict[int, Iterator] = {s: iter(g.index.to_list()) for s, g in order.groupby("rest", sort=False)}
        at = pd.Series({next(queues[s]): b for b, own in enumerate(bins) for s in own})
        out = pdf.assign(container=[f"b-{pdf['block'].iloc[0]}-{b}" for b in at.loc[pdf.index]], piece_no=pdf["full"] + 1, start_token=pdf["full"] * capacity, tokens=pdf["rest"], proven=proven)
        return out[["pack_name", "container", "key", "piece_no", "start_token", "tokens", "proven"]]

    # a block is worth a task of its own, however few bytes it has
    spread = rests.repartition(min(4 * blocks, MOST_TASKS), "pack_name", "block")
    packed = spread.groupBy("pack_name", "block").applyInPandas(block, f"pack_name string, container string, key {key_type}, piece_no long, start_token long, tokens long, proven boolean")
    return whole.unionByName(packed).withColumnRenamed("key", key)


def packing_report(packed: DataFrame) -> DataFrame:
    """Rows ``(pack_name, containers, tokens, proven_containers)`` of a packing: how many containers there are, what they hold, and how many are of blocks proven to have the fewest."""
    per = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("held"), F.min("proven").alias("proven"))
    return per.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.sum(F.col("proven").cast("long")).alias("proven_containers"))
