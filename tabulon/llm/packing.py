"""Filling containers of a fixed capacity with items, dividing only items larger than that.

Sizes are whole numbers up to the capacity, so that the number of items per size describes the whole
task: it has at most ``capacity`` entries however many items there are. Large-item matching runs on
that histogram: items above a third of the capacity go at most two to a container, each with the
largest partner that fits (greedy matching); smaller ones, the largest first, go into the container
with the smallest room that takes them (best fit). The outcome is a list of container patterns with
multiplicities. Items then find their container from their rank within their size, without being
gathered anywhere.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.runtime import quoted, ranked


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(containers, [(size, items of it in each), ..])] that hold all items of the histogram."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise EngineError("Sizes must lie between 1 and the capacity.")
    rooms: dict[int, list[list]] = defaultdict(list)  # room -> [[containers, contents]]
    keys: list[int] = []  # the rooms there are, in order

    def put(room: int, n: int, contents: list[tuple[int, int]]) -> None:
        if room not in rooms:
            bisect.insort(keys, room)
        rooms[room].append([n, contents])

    def drop(room: int) -> None:
        del rooms[room]
        keys.pop(bisect.bisect_left(keys, room))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large.pop()
        n = left.pop(s)
        if 2 * s <= capacity and n > 1:  # no partner is larger than one of the same size
            put(capacity - 2 * s, n // 2, [(s, 2)])
            n %= 2
        while n:
            at = bisect.bisect_right(large, capacity - s) - 1
            if at < 0:
                put(capacity - s, n, [(s, 1)])
                break
            partner = large[at]
            both = min(n, left[partner])
            put(capacity - s - partner, both, [(s, 1), (partner, 1)])
            n -= both
            left[partner] -= both
            if not left[partner]:
                large.pop(at)
                del left[partner]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(keys, s)
            if at == len(keys):
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * s, full, [(s, each)])
                if rest:
                    put(capacity - rest * s, 1, [(s, rest)])
                break
            room = keys[at]
            containers, contents = rooms[room].pop()
            if not rooms[room]:
                drop(room)
            each = room // s
            full, rest = divmod(n, each)
            used = min(containers, full)
            if used:
                put(room - each * s, used, [*contents, (s, each)])
                n -= used * each
                containers -= used
            if containers and n:  # what is left fills one container in part
                put(room - n * s, 1, [*contents, (s, n)])
                n = 0
                containers -= 1
            if containers:
                put(room, containers, contents)
    return [(n, contents) for room in reversed(keys) for n, contents in rooms[room]]


class Slots:
    """For each size, the ranges of ranks that share a pattern: where a rank's container and position are."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int):
        rows: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        first = 1
        for n, contents in patterns:
            room = capacity - sum(s * k for s, k in contents)
            position = 1
            for s, k in contents:
                rows[s].append((ranks[s], first, k, position, room))
                ranks[s] += n * k
                position += k
            first += n
        self.containers = first - 1
        sizes = sorted(rows)
        self.sizes = np.array(sizes, np.int64)
        self.start = np.cumsum([0, *(len(rows[s]) for s in sizes)])
        self.table = np.array([r for s in sizes for r in rows[s]], np.int64).reshape(-1, 5)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(container, position, room) of items by their size and rank within it."""
        out = np.zeros((3, len(size)), np.int64)
        at = np.searchsorted(self.sizes, size)
        for k in np.unique(at):
            rows = self.table[self.start[k] : self.start[k + 1]]
            m = np.flatnonzero(at == k)
            r = rows[np.searchsorted(rows[:, 0], rank[m], side="right") - 1]
            past = rank[m] - r[:, 0]
            out[:, m] = r[:, 1] + past // r[:, 2], r[:, 3] + past % r[:, 2], r[:, 4]
        return out[0], out[1], out[2]


def fill_containers(sizes: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """(container, position, id, piece, start, size, room): one row per item or piece of an item.

    An item larger than ``capacity`` is divided into pieces of the full capacity and a rest; ``piece``
    counts from 0 and ``start`` is the piece's offset in the item. Containers are numbered from 1 and
    positions within them from 1; ``room`` is what is left in the container. Items of size 0 lie in
    container 0, which holds only them. Items of null size are left out; equal sizes and repeated ids
    are separate items; ids must be integers; an empty table gives no rows.
    """
    if capacity < 1:
        raise EngineError("The capacity must be at least 1.")
    items = sizes.select(quoted(id_column).cast("long").alias("id"), quoted(size).cast("long").alias("whole")).where("whole >= 0")
    count = F.greatest(F.ceil(F.col("whole") / capacity).cast("int"), F.lit(1))
    pieces = items.select("id", "whole", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "whole")
    pieces = pieces.select("id", "piece", "start", F.least(F.col("whole") - F.col("start"), F.lit(capacity)).alias("size"))
    histogram = {r["size"]: r["n"] for r in pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots = Slots(plan(histogram, capacity), capacity)
    order = F.xxhash64("id", "piece", "size")
    placed = ranked(pieces.withColumn("order", order), ["size"], "order", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            s, r = at["size"].to_numpy(zero_copy_only=False), at["rank"].to_numpy(zero_copy_only=False)
            container, position, room = np.zeros(len(s), np.int64), r + 1, np.full(len(s), capacity, np.int64)
            full = np.flatnonzero(s > 0)
            container[full], position[full], room[full] = slots.place(s[full], r[full])
            yield pa.RecordBatch.from_arrays(
                [pa.array(container), pa.array(position), at["id"], at["piece"], at["start"], at["size"], pa.array(room)],
                ["container", "position", "id", "piece", "start", "size", "room"],
            )

    return placed.select("id", "piece", "start", "size", "rank").mapInArrow(
        run, "container long, position long, id long, piece int, start long, size long, room long"
    )
