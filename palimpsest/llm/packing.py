"""Filling fixed-capacity containers with texts measured in tokens (hierarchical multi-length packing)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokenizers import FOLDER, counter

#: Texts packed together in one task; large enough that the last, unfilled containers of a group don't matter.
GROUP_TEXTS = 25_000
#: Containers of a step group, whose costs are balanced against the other groups'.
STEP = 64
#: Context sizes of the tiers: the capacity, and each a fourth of the one before.
TIERS, NARROWER = 4, 4
#: Share of its context size that a window of a tier may leave empty and still be stacked.
LOOSE = 1 / 128


class Room:
    """Rooms with gaps; an item goes where it leaves the least."""

    def __init__(self):
        self.gaps: list[int] = []  # distinct gaps, ascending
        self.open: dict[int, list[int]] = {}  # gap -> rooms

    def add(self, room: int, gap: int) -> None:
        if gap not in self.open:
            self.open[gap] = []
            insort(self.gaps, gap)
        self.open[gap].append(room)

    def take(self, size: int) -> int | None:
        """The room that an item fills best, None if it fits nowhere."""
        at = bisect_left(self.gaps, size)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        held = self.open[gap]
        room = held.pop()
        if not held:
            del self.open[gap], self.gaps[at]
        self.add(room, gap - size)
        return room


def tier_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The tier each size is routed to: that of the smallest context size that holds it."""
    tier = np.zeros(len(sizes), np.int64)
    for t in range(1, TIERS):
        tier[sizes <= capacity // NARROWER**t] = t
    return tier


def pack_tiers(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, tier) of each size, packed from the longest tier to the shortest.

    Texts of a tier first fill the gaps that longer tiers left in their containers. The others are packed, longest first,
    into windows of their tier's own context size, and full windows are stacked into containers, whose gaps stand open to
    the shorter tiers. Windows that stay loose are undone; their texts, and those of the shortest tier, which nobody comes
    after, go into containers directly.
    """
    tiers = tier_of(sizes, capacity)
    where, containers, room = np.empty(len(sizes), np.int64), 0, Room()
    for t in range(TIERS):
        wide, stacked = capacity // NARROWER**t, NARROWER**t
        own, windows, direct = Room(), [], []
        members = np.flatnonzero(tiers == t)
        for i in members[np.argsort(-sizes[members], kind="stable")]:
            size = int(sizes[i])
            at = room.take(size)
            if at is not None:
                where[i] = at
            elif t in (0, TIERS - 1):
                direct.append(i)
            else:
                at = own.take(size)
                if at is None:
                    at = len(windows)
                    windows.append([])
                    own.add(at, wide - size)
                windows[at].append(i)
        loads = [int(sizes[w].sum()) for w in windows]
        tight = [n for n, load in enumerate(loads) if load >= wide * (1 - LOOSE)]
        for n in range(0, len(tight), stacked):
            stack = tight[n : n + stacked]
            for w in stack:
                where[windows[w]] = containers
            room.add(containers, capacity - sum(loads[w] for w in stack))
            containers += 1
        direct += [i for n, w in enumerate(windows) if loads[n] < wide * (1 - LOOSE) for i in w]
        for i in sorted(direct, key=lambda i: -sizes[i]):
            size = int(sizes[i])
            at = room.take(size)
            if at is None:
                at = containers
                room.add(at, capacity - size)
                containers += 1
            where[i] = at
    return where, tiers


def pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, start, end): an item that exceeds the capacity is cut into full pieces and a rest, others stay whole."""
    count = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    return item, piece, start, np.minimum(start + capacity, sizes[item])


def step_groups(costs: np.ndarray, step: int) -> np.ndarray:
    """Step group of each container: containers by falling cost are dealt forth and back, so sums of costs come out even."""
    n = len(costs)
    groups = max(1, -(-n // step))
    rank = np.empty(n, np.int64)
    rank[np.argsort(-costs, kind="stable")] = np.arange(n)
    lap, seat = np.divmod(rank, groups)
    return np.where(lap % 2 == 0, seat, groups - 1 - seat)


def pack_window(ids: np.ndarray, sizes: np.ndarray, capacity: int, step: int = STEP) -> pd.DataFrame:
    item, piece, start, end = pieces(sizes, capacity)
    length = end - start
    container, _ = pack_tiers(length, capacity)
    order = np.lexsort((piece, item, container))
    item, piece, start, end, length, container = (x[order] for x in (item, piece, start, end, length, container))
    first = np.searchsorted(container, container)
    costs = np.bincount(container, length.astype(float) ** 2) if len(container) else np.zeros(0)  # attention within texts
    groups = step_groups(costs, step)
    return pd.DataFrame({
        "container": container, "step_group": groups[container] if len(container) else container, "position": np.arange(len(item)) - first,
        "doc_id": ids[item], "piece": piece, "token_start": start, "token_end": end,
    })


def _count_batches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        counts = [pa.array(c, pa.int64()) for c in counter(names, folder).counts(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts], ["doc_id", *(f"n{i}" for i in range(len(names)))])


def token_sizes(documents: DataFrame, names: list[str], folder: str = FOLDER) -> DataFrame:
    """(doc_id, n0, n1, ...): sizes of the non-empty texts in tokens of each named tokenizer, in one pass over the texts."""
    slim = documents.where(F.length("text") > 0).select("doc_id", "text")
    columns = ", ".join(f"n{i} bigint" for i in range(len(names)))
    return slim.mapInArrow(partial(_count_batches, names=tuple(names), folder=folder), f"doc_id bigint, {columns}")


_OUT = "window_id bigint, container_id bigint, step_group bigint, position bigint, doc_id bigint, piece bigint, token_start bigint, token_end bigint"


def _pack_group(key, group: pd.DataFrame, windows: tuple, names: tuple, step: int) -> pd.DataFrame:
    base = int(key[0]) << 32
    group = group.sort_values("doc_id", kind="stable")
    ids = group["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
    out = []
    for window_id, name, capacity in windows:
        made = pack_window(ids, group[f"n{names.index(name)}"].to_numpy(np.int64), capacity, step)
        made.insert(0, "window_id", window_id)
        made["container_id"] = made.pop("container") + base
        made["step_group"] += base
        out.append(made)
    done = pd.concat(out, ignore_index=True)
    done["doc_id"] = done["doc_id"].astype("Int64")
    return done[[c.split()[0] for c in _OUT.split(", ")]]


def pack(documents: DataFrame, windows: DataFrame, folder: str = FOLDER, group_texts: int = GROUP_TEXTS, step: int = STEP) -> DataFrame:
    """Every non-empty text in a container of every window.

    ``windows`` (``window_id, tokenizer, capacity_tokens``) is a parameter table of a few rows. Returns one row per placed
    piece: ``window_id, container_id, step_group, position, doc_id, piece, token_start, token_end``. A text is cut only if
    it alone exceeds the capacity; a text of no tokens takes no room. Rows are spread evenly over groups, whatever their
    ``doc_id``, and each group is packed in a task of its own, so only sizes are shuffled and no task holds more than a
    group. Null and empty texts aren't packed; repeated rows are packed as often as they occur; no windows or no texts
    give no rows.
    """
    rows = windows.where("capacity_tokens > 0").select("window_id", "tokenizer", "capacity_tokens").collect()
    chosen = tuple(sorted((r[0], r[1], r[2]) for r in rows))
    names = tuple(sorted({w[1] for w in chosen}))
    if not chosen:
        return documents.sparkSession.createDataFrame([], _OUT)
    groups = max(1, round(documents.select("doc_id").count() / group_texts))  # rows are counted from the files' footers
    salted = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups))
    sizes = token_sizes(documents, list(names), folder).withColumn("g", salted)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(key, group, chosen, names, step)

    return sizes.repartition(max(groups, 1), "g").groupBy("g").applyInPandas(run, _OUT)


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: texts, containers, tokens and the share of the containers' room that is used."""
    per = packed.groupBy("window_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    total = per.groupBy("window_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"))
    joined = total.join(F.broadcast(windows.select("window_id", "capacity_tokens")), "window_id")
    return joined.select("window_id", "containers", "pieces", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
