"""Benchmark decontamination with suffix arrays of the training shards.

Each slice of documents (a shard) gets an array of its suffixes, sorted by
their first ``window`` words. The array is sparse: it holds the suffixes whose
first few words occur somewhere in the benchmark, since no other suffix can
match. Every benchmark suffix is then binary-searched in it; the equal range
gives the locations. A place of a text matches at most one distinct window of
a length, so what a shard finds is bounded by its words, however many items
share a line: items are only looked up once for each distinct set of windows
of a text, and once for each distinct run of matching places.

The benchmark is the query side. It goes to the executors in blocks of at most
``BLOCK_WINDOWS`` windows (about 40 MB); a longer item is cut into overlapping
parts. One block - any usual benchmark - is one pass over the rows without a
shuffle. More blocks are one pass each, one after the other: the rows are
written to the shared folder in between with what was found so far, so a
single block is alive at any time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import shared
from plumbline.llm.textcore import ALNUM, Words, free_name, intervals, run_hashes, slices, spread, text_buffer

WINDOW = 13
BLOCK_WINDOWS = 500_000
ANCHOR = 4


def _keys(symbols: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Sortable byte keys of k symbols from each position: 64 bits of each if there are few, 32 bits of each from 8 on."""
    width = 8 if k < 8 else 4
    if not len(at):
        return np.zeros(0, f"S{width * k}")
    parts = symbols.astype(">u8") if k < 8 else (symbols >> np.uint64(32)).astype(">u4")
    parts |= 1  # no zero bytes at the end, which would not count
    return np.ascontiguousarray(parts[at[:, None] + np.arange(k)]).view(f"S{width * k}").ravel()


class Windows:
    """Distinct windows of one length: sorted keys, their anchors, and the benchmark places of each."""

    def __init__(self, words: Words, rows: np.ndarray, k: int):
        self.k, self.anchor = k, min(k, ANCHOR)
        at = np.concatenate([np.arange(words.first[r], words.first[r + 1] - k + 1) for r in rows])
        keys = _keys(words.hash, at, k)
        order = np.argsort(keys, kind="stable")
        self.keys, begin = np.unique(keys[order], return_index=True)
        self.begin, self.places = np.append(begin, len(order)), at[order]
        where, h = run_hashes(words.hash, words.first, self.anchor)
        self.starts, of = np.unique(h[np.searchsorted(where, self.places[begin])], return_inverse=True)
        self.start_of = of.astype(np.int32)

    def owners(self, j: int) -> np.ndarray:
        return self.places[self.begin[j] : self.begin[j + 1]]

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the window) of every match in a shard, in order."""
        at, h = words.windows(self.anchor)
        near = np.minimum(np.searchsorted(self.starts, h), len(self.starts) - 1)
        same = self.starts[near] == h
        at, near = at[same], near[same]
        stop = words.first[1:][words.doc_of(at)] if len(at) else at
        at, near = at[at + self.k <= stop], near[at + self.k <= stop]
        if not len(at):
            return at, at
        seen = np.zeros(len(self.starts), bool)
        seen[near] = True
        tests = np.flatnonzero(seen[self.start_of])
        suffixes = _keys(words.hash, at, self.k)
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        low, high = (np.searchsorted(suffixes, self.keys[tests], side) for side in ("left", "right"))
        size = high - low
        where = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at, window = at[order][where], np.repeat(tests, size)
        order = np.argsort(at)
        return at[order], window[order]


class Block:
    """Some benchmark items: their windows by length, and whose word each benchmark word is."""

    def __init__(self, parts: list[tuple[str | None, str]], skip: list[int], window: int):
        data, offsets = text_buffer(pa.array([t for _, t in parts], pa.string()))
        words = Words(data, offsets, ALNUM, lower=True)
        self.names = [i for i, _ in parts]
        self.first, self.skip = words.first, np.array(skip, np.int64)
        span = np.minimum(words.counts, window)
        self.classes = [Windows(words, np.flatnonzero(span == k), k) for k in sorted(set(span.tolist()) - {0})]
        self.memo: dict[tuple, tuple] = {}

    def part_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def items(self, windows: list[np.ndarray]) -> list[str]:
        """Ids, in order, of the items that hold any of the windows (numbers by length); those without an id are left out."""
        parts = [self.part_of(c.owners(int(j))) for c, own in zip(self.classes, windows) for j in own]
        if not parts:
            return []
        return sorted({n for p in np.unique(np.concatenate(parts)) if (n := self.names[p]) is not None})

    def longest(self, c: int, run: np.ndarray) -> tuple[int, int, str | None, int]:
        """Longest verbatim match in a run of windows at consecutive places: words, first word in the run, item, first word in the item.

        Of equals the earliest in the run, then the one whose place in the benchmark comes first.
        """
        if (kept := self.memo.get((c, run.tobytes()))) is not None:
            return kept
        own = self.classes[c]
        places, since, best = np.zeros(0, np.int64), np.zeros(0, np.int64), (0, 0, 0)
        for n, j in enumerate(run):
            now = np.sort(own.owners(int(j)))
            began = np.full(len(now), n)
            if len(places):
                at = np.minimum(np.searchsorted(places, now - 1), len(places) - 1)
                on = places[at] == now - 1
                began[on] = since[at[on]]
            places, since = now, began
            top = int(since.argmin())
            if n + own.k - since[top] > best[0]:
                best = (int(n + own.k - since[top]), int(since[top]), int(places[top] - (n - since[top])))
        part = int(self.part_of(np.array([best[2]]))[0])
        out = (best[0], best[1], self.names[part], int(best[2] - self.first[part] + self.skip[part]))
        if len(self.memo) >= 10_000:
            self.memo.clear()
        self.memo[c, run.tobytes()] = out
        return out


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[tuple[str | None, str, int, int]]:
    """(item, text, words before it, bound on its windows) of items, in parts that a block can hold."""
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if not text:
            continue
        if len(text) // 2 < BLOCK_WINDOWS:
            yield item, text, 0, 1 + len(text) // 2
            continue
        data, offsets = text_buffer(pa.array([text]))
        words = Words(data, offsets, ALNUM, lower=True)
        n, step = len(words.start), max(BLOCK_WINDOWS // 2, window)
        for a in range(0, max(n - window + 1, 1), step):
            b = min(n, a + step + window - 1)
            if b > a:
                yield item, data[words.start[a] : words.end[b - 1]].tobytes().decode(), a, b - a


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, each read when it is asked for; items without words are skipped."""
    parts, skip, held = [], [], 0
    for item, text, before, size in _parts(benchmark, item_col, text_col, window):
        if held and held + size > BLOCK_WINDOWS:
            yield Block(parts, skip, window)
            parts, skip, held = [], [], 0
        parts.append((item, text))
        skip.append(before)
        held += size
    if parts:
        yield Block(parts, skip, window)


_MATCH = T.StructType(
    [T.StructField("doc_word", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType())]
)
_ARROW_MATCH = pa.list_(pa.struct([("doc_word", pa.int32()), ("length", pa.int32()), ("item_id", pa.string()), ("item_word", pa.int32())]))
#: Names of the added columns, in order.
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "matches")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents with what they share with the benchmark: every input column, then the columns ``ADDED``.

    n_hit counts the words inside windows that occur in the benchmark, n_items the item_ids of items with such a window,
    items_sha256 is over those, sorted as strings and joined by commas. ``matches`` has, for every run of places at
    which windows of one length match, the longest verbatim match (first word in the document, length in words, item, first
    word in the item; the earliest of equals), ordered by place and length.

    Items with the same item_id count as one. Items of fewer than ``window`` words are one window; items without words
    match nothing. The words of an item without an item_id are hit like any others, but it is not listed. A null or
    empty document text has no words. Repeated rows are judged each for itself. If an input column
    already has one of the added names, the added one gets a trailing ``_``. A match across the cut of an item of over
    ``BLOCK_WINDOWS`` / 2 words is reported as its longer part.
    """
    spark, taken = docs.sparkSession, docs.columns
    names: list[str] = []
    for x in ADDED:
        names.append(free_name([*taken, *names], x))
    found = free_name([*taken, *names], "found")  # hit words as bits, and the ids so far
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.ArrayType(_MATCH), T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("items", T.BinaryType())])]
    out = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip([*names, found], kinds))])
    df = spread(docs).withColumns({n: F.lit(None).cast(k) for n, k in zip([*names, found], kinds)})
    turns = blocks(benchmark, item_col, item_text_col, window)
    block, last = next(turns, None), []
    while True:
        after = next(turns, None)
        df = df.mapInArrow(_pass(spark.sparkContext.broadcast(block), taken.index(text_col), len(taken), after is None), out)
        if after is None:
            return df.drop(found)
        df, path = shared.stored(df, "decontaminated")
        shared.drop(spark, last)
        block, last = after, [path]


def _pass(held, text_at: int, n_cols: int, is_last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value or Block([], [], 1)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            had, had_matches = batch.column(n_cols + 5), batch.column(n_cols + 4)
            cols: list[list] = [[] for _ in range(6)]
            known: dict[tuple, tuple] = {}
            for a, b, part, off in slices(data, offsets):
                words = Words(part, off, ALNUM, lower=True)
                cols[0] += words.counts.tolist()
                hits = [c.search(words) for c in block.classes]
                edges = [np.searchsorted(at, words.first) for at, _ in hits]
                for d in range(b - a):
                    old = had[a + d].as_py() or {"bits": None, "items": None}
                    own = [(at[e[d] : e[d + 1]] - words.first[d], w[e[d] : e[d + 1]]) for (at, w), e in zip(hits, edges)]
                    row = _judge(block, own, int(words.counts[d]), old, had_matches[a + d].as_py() or [], known, is_last)
                    for c, x in zip(cols[1:], row):
                        c.append(x)
            state = pa.array(cols[5], pa.struct([("bits", pa.binary()), ("items", pa.binary())]))
            made = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], _ARROW_MATCH), state]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], *made], names=batch.schema.names)

    return run


_NOTHING = (0, 0, hashlib.sha256(b"").hexdigest(), [], None)


def _judge(block: Block, own: list, n_words: int, old: dict, matches: list, known: dict, is_last: bool) -> tuple:
    """n_hit, n_items, items_sha256, matches and the state of one document; ``own``: (place, window) by length of window."""
    if not old["bits"] and not any(len(at) for at, _ in own):
        return _NOTHING
    hit = np.zeros(n_words + 1, np.int32)
    for (at, _), c in zip(own, block.classes):
        np.add.at(hit, at, 1)
        np.add.at(hit, at + c.k, -1)
    mask = np.cumsum(hit[:-1]) > 0
    if old["bits"]:
        mask |= np.unpackbits(np.frombuffer(old["bits"], np.uint8), count=n_words).astype(bool)
    for i, (at, windows) in enumerate(own):
        edge = np.append(np.flatnonzero(np.diff(at, prepend=-2) != 1), len(at))
        for x, y in zip(edge[:-1], edge[1:]):
            length, begin, item, item_word = block.longest(i, windows[x:y])
            matches.append({"doc_word": int(at[x]) + begin, "length": length, "item_id": item, "item_word": item_word})
    matches.sort(key=lambda m: (m["doc_word"], m["length"], m["item_id"] or "", m["item_word"]))
    sets = [np.unique(w) for _, w in own]
    key = (old["items"], *(s.tobytes() for s in sets))
    if key not in known:
        ids = block.items(sets)
        if old["items"]:
            ids = sorted({*ids, *zlib.decompress(old["items"]).decode().split("\0")})
        packed = zlib.compress("\0".join(ids).encode(), 1) if ids and not is_last else None
        if len(known) >= 1000:
            known.clear()
        known[key] = len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), packed
    n_items, sha, packed = known[key]
    state = None if is_last else {"bits": np.packbits(mask).tobytes(), "items": packed}
    return int(mask.sum()), n_items, sha, matches, state


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one hit word, and a twentieth of the words or more."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns; one pass without a shuffle for a benchmark of one block."""
    found = find_contamination(docs, benchmark, text_col)
    n_words, n_hit = found.columns[-5:-3]
    return found.filter(~is_contaminated(f"`{n_words}`", f"`{n_hit}`")).select(*(f"`{c}`" for c in docs.columns))
