"""Best-fit packing of documents into fixed-length sequences, after Martello-Toth dominance reduction.

Documents are tokenised once, where they are read; only the pieces' lengths
travel. Lengths are whole numbers up to the capacity, so the instance is a
histogram of at most ``capacity`` sizes however many documents there are. The
plan is made on that histogram, in whole runs of equal bins:

1. reduction: a piece is fixed with a set of at most three pieces, itself
   included, that provably dominates every other way to fill its bin. Every
   size is tried in turn; fixed pieces leave the instance, and the sizes are
   tried again until none can be fixed;
2. best fit decreasing packs the remainder, each size into the bins of the
   least room that holds it.

A piece's rank among those of its length (tasks count locally, prefix sums
over the tasks' counts give offsets) says which bin of the plan is its own.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textcore import spread
from plumbline.shared import written

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoder(name: str):
    """The byte-level BPE vocabulary ``name``: ids equal those of the tokenizers library on its JSON file as it is.

    The special tokens that the file lists split a text and become their own ids, as they do there. The merge table is
    read as ranks, which encode about four times as fast; tests hold the ids of both against each other.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(name: str, text: str) -> list[int]:
    """Ids of a text, special tokens in it included; nothing is added."""
    return encoder(name).encode(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(capacity: int, end_id: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*token_ids(tokenizer, text.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, int(seen[length])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    return run


class Plan:
    """Bins for a histogram of sizes. ``slots[size]``: runs (first rank, first bin, place), in the order of the ranks."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.slots: dict[int, list[tuple[int, int, int]]] = {s: [] for s in self.left}
        self.bins = 0
        self.fixed = self._reduce()
        self._best_fit()

    def _place(self, size: int, n: int, first_bin: int, place: int) -> None:
        """The next n pieces of a size go to n bins in a row."""
        self.slots[size].append((self.used[size], first_bin, place))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def _fix(self, n: int, *sizes: int) -> None:
        place = 0
        for s in sizes:
            self._place(s, n, self.bins, place)
            place += s
        self.bins += n

    def _reduce(self) -> int:
        """Fixes dominating sets while there are any; returns the number of bins fixed.

        A set stays dominating while pieces leave the instance, so as many equal bins are fixed at once as its pieces
        allow.
        """
        fixed = True
        while fixed:
            fixed = False
            for size in sorted(self.left, reverse=True):
                while size in self.left and (others := self._dominating(size)) is not None:
                    need = Counter([size, *others])
                    self._fix(min(self.left[s] // k for s, k in need.items()), size, *others)
                    fixed = True
        return self.bins

    def _dominating(self, size: int) -> tuple[int, ...] | None:
        """What goes beside a piece of ``size`` in a set of at most three that dominates all others with it; None if none does.

        A set dominates another if the other's pieces can be dealt to its pieces so that none gets more than its size.
        """
        room = self.capacity - size
        rest = {s: n for s in self.left if s <= room and (n := self.left[s] - (s == size))}
        if not rest:
            return ()
        order = sorted(rest)
        big, least = order[-1], order[0]
        two = 2 * least if rest[least] > 1 else least + (order[1] if len(order) > 1 else room)
        if big == room or two > room:  # nothing else is left over, or no two fit: the largest stands for any one
            return (big,)
        few = [s for s in order[:3] for _ in range(min(rest[s], 3))][:3]
        if len(few) == 3 and sum(few) <= room:
            return None
        fullest = []  # of the pairs with the same smaller piece b, the one of the largest sum
        for i, b in enumerate(order):
            j = bisect_right(order, room - b) - 1
            if j == i and rest[b] < 2:
                continue
            if j < i:
                break
            fullest.append((order[j], b))
        if all(a + b <= big for a, b in fullest):  # the largest stands for any two
            return (big,)
        beside = max((s for s in order if s <= room - big and (s != big or rest[s] > 1)), default=None)
        if beside is not None and all(a + b <= big or b <= beside for a, b in fullest):
            return (big, beside)
        return None

    def _best_fit(self) -> None:
        open_bins: dict[int, list[tuple[int, int]]] = {}  # room: runs (first bin, bins)
        for size in sorted(self.left, reverse=True):
            while (n := self.left.get(size, 0)) > 0:
                room = min((r for r in open_bins if r >= size), default=None)
                if room is None:
                    room, runs = self.capacity, [(self.bins, -(-n // (self.capacity // size)))]
                    self.bins += runs[0][1]
                    open_bins[room] = runs
                first, width = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                each = room // size
                full = min(width, n // each)
                if full:
                    for k in range(each):
                        self._place(size, full, first, self.capacity - room + k * size)
                    if room - each * size:
                        open_bins.setdefault(room - each * size, []).append((first, full))
                    if width > full:
                        open_bins.setdefault(room, []).append((first + full, width - full))
                else:  # the last bin takes fewer than it could hold
                    for k in range(n):
                        self._place(size, 1, first, self.capacity - room + k * size)
                    open_bins.setdefault(room - n * size, []).append((first, 1))
                    if width > 1:
                        open_bins.setdefault(room, []).append((first + 1, width - 1))


def _assign(slots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                runs = slots[int(size)]
                at = np.searchsorted(runs[:, 0], rank[own], side="right") - 1
                sequence[own] = runs[at, 1] + rank[own] - runs[at, 0]
                offset[own] = runs[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are the end alone. One of more than ``capacity`` ids is
    cut into pieces of that length, the first of which may be shorter. sequence_id runs from 0, ``offset`` is the
    place of the piece in its sequence, gapless from 0. ids_crc32 is over the ids as little-endian unsigned 32 bits.
    Repeated rows and null ids are documents like any other. Other columns are not read.

    The histogram and the plan's runs (a few for each size) are all that reaches the driver.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    data = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = written(spread(data).mapInArrow(_pieces(capacity, end_id, tokenizer), schema), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r[0]): int(r[1]) for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    plan = Plan(counts, capacity)
    slots = {size: np.array(runs, np.int64) for size, runs in plan.slots.items()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_assign(slots), out)
