"""Vectorised text primitives shared by the document operators.

A batch of texts is one byte buffer with offsets. Words are found with a byte
table, hashed with a polynomial (Rabin-Karp) prefix sum modulo 2**64 and then
mixed; word windows are hashed the same way over the word hashes. Every step
is a NumPy pass over a slice of bounded size, so memory depends on
``SLICE_BYTES`` and on the longest single text, never on the batch.

Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
#: Stands for a null id, below all real ones.
NULL_ID = -(1 << 62)
MOST_RANGES = 16384

#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, cached per worker."""
    up, down = _POWERS.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    while len(up) < n:
        k = len(up)
        up = np.concatenate([up, up * np.uint64(pow(base, k, 1 << 64))])
        down = np.concatenate([down, down * np.uint64(pow(base, -k, 1 << 64))])
    _POWERS[base] = up, down
    return up, down


def mix64(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words:
    """Words of a slice of texts: byte spans, hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        if n:
            inside = table[self.data]
            before = np.zeros(n, bool)
            before[1:] = inside[:-1]
            before[offsets[:-1][offsets[:-1] < n]] = False
            after = np.zeros(n, bool)
            after[:-1] = inside[1:]
            ends = offsets[1:]
            after[ends[ends > 0] - 1] = False
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            m, i = len(self.start), 0
            self._hash = np.empty(m, np.uint64)
            while i < m:  # a part of bounded size at a time, so that one very long text needs no long tables
                base = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.start, base + SLICE_BYTES)))
                part = self.data[base : self.end[j - 1]]
                up, down = _powers(_BYTE_BASE, len(part) + 1)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
                start, end = self.start[i:j] - base, self.end[i:j] - base
                size = (end - start).astype(np.uint64)
                self._hash[i:j] = mix64((sums[end] - sums[start]) * down[start] + size * np.uint64(0xA24BAED4963EE407))
                i = j
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every run of k words inside one text."""
        return run_hashes(self.hash, self.first, k)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1


def run_hashes(symbols: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of every k consecutive symbols that lie within one text."""
    m = len(symbols)
    if m < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(_WORD_BASE, m + 1)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(symbols * up[:m], out=sums[1:])
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(m) + k <= last)
    return at, mix64((sums[at + k] - sums[at]) * down[at] + np.uint64(k))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES, most: int = 1 << 30):
    """(first text, texts after the last, bytes, offsets) of parts of at most ``limit`` bytes (or one text) and ``most`` texts."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(a + most, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n words that a window of k words starting at one of ``at`` covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def intervals(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, end)."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (names compare without case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text of a table, in one aggregate."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def stretch(size: int) -> float:
    """How much larger than their usual size chunks and buckets are made for ``size`` bytes of text, 1 to 16.

    With n chunks that exchange messages with m buckets, there are n * m messages. Both grow with the square root of the
    input beyond 32 GB, so that a message stays as long as it is there, up to 8 TB.
    """
    return min(max(math.sqrt(size / (32 << 30)), 1.0), 16.0)


def _texts_of(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(id, h, text, rest): a null id lies below all others, h is a hash of the text, rest a struct of the columns in ``carry``."""
    rest = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("string")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    data = docs.select(ident.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), rest.alias("rest"))
    return data.select("id", F.xxhash64("text").alias("h"), "text", "rest")


def hashed_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, least: int = 48) -> tuple[DataFrame, int]:
    """Texts dealt into chunks of about ``chunk_bytes`` (more by ``stretch``) by a hash of id and text.

    Returns columns (chunk, id, h, text) and the bytes of text. There are at least ``least`` chunks while there is more than 1 MB.
    """
    data = _texts_of(docs, id_col, text_col, ()).drop("rest")
    _, size = text_bytes(data, "text")
    want = max(-(-size // int(chunk_bytes * stretch(size))), least if size > 1 << 20 else 1)
    return data.select(F.pmod(F.xxhash64("id", "h"), F.lit(want)).cast("int").alias("chunk"), "id", "h", "text"), size


def ordered_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, carry: tuple[str, ...] = (), least: int = 48) -> tuple[DataFrame, int]:
    """Texts with a chunk number that follows the order of (id, h).

    Returns columns (chunk, id, h, text, rest) and the bytes of text; h is a hash of the text, by which rows of one id are ordered,
    rest a struct of the columns in ``carry``, else null. Null ids sort first. Chunks hold about ``chunk_bytes`` of text (more by
    ``stretch``), and are at least ``least`` while there is more than 1 MB: they are cut at quantiles of ids that are drawn
    in proportion to their bytes (some 64 draws a chunk, by a hash; the draw decides on balance alone). An id
    that holds several quantiles - null ids, say - is cut by h into as many chunks. Beyond ``MOST_RANGES``
    chunks each range is cut evenly by the id.
    """
    from pyspark.ml.feature import Bucketizer

    data = _texts_of(docs, id_col, text_col, carry)
    n, size = text_bytes(data, "text")
    want = max(-(-size // int(chunk_bytes * stretch(size))), least if size > 1 << 20 else 1)
    ranges = min(want, MOST_RANGES)
    quantiles: list[float] = []
    if ranges > 1 and n > 1:
        share = F.octet_length("text") / F.lit(max(size / (64 * ranges), 1.0))
        draws = F.floor(share + F.pmod(F.xxhash64("id", "h", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("int")
        drawn = data.select(F.col("id").cast("double").alias("id"), draws.alias("k")).filter("k > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("k"))))
        quantiles = sorted(drawn.approxQuantile("id", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)))
    cuts = sorted(set(quantiles))
    if not cuts:
        return data.select(F.lit(0).alias("chunk"), "id", "h", "text", "rest"), size
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="key", outputCol="at", handleInvalid="keep")
    data = cut.transform(data.withColumn("key", F.col("id").cast("double"))).withColumn("at", F.col("at").cast("int"))
    if len(cuts) == len(quantiles) and want <= MOST_RANGES:
        return data.select(F.col("at").alias("chunk"), "id", "h", "text", "rest"), size
    # per range: its number, and for an id that repeats at its start how many chunks that one has
    times, number, rows = Counter(quantiles), 1, [(0, 0, 1)]
    for i, c in enumerate(cuts):
        rows.append((i + 1, number, times[c]))
        number += 1 if times[c] == 1 else times[c] + 1
    parts = -(-want // MOST_RANGES)
    ends = [(i, base, k, lo, hi) for (i, base, k), lo, hi in zip(rows, [cuts[0], *cuts], [*cuts, cuts[-1]])]
    ends = _range_ends(data, ends) if parts > 1 else data.sparkSession.createDataFrame(ends, _ENDS)
    data = data.join(F.broadcast(ends), "at")  # MOST_RANGES rows
    own = (F.col("k") > 1) & (F.col("key") == F.col("lo")) & (F.col("at") > 0)
    inner = F.when(own, F.least(F.col("k") - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("k")))).when(F.col("k") > 1, F.col("k")).otherwise(0)
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("key") - F.col("lo")) / width * parts)))
    return data.select(((F.col("base") + inner) * parts + part).cast("int").alias("chunk"), "id", "h", "text", "rest"), size


_ENDS = "at int, base int, k int, lo double, hi double"


def _range_ends(like: DataFrame, ends: list[tuple[int, int, int, float, float]]) -> DataFrame:
    """The ranges' ends; the outermost ranges, open on one side, are as wide as the data that lie there."""
    real = F.when(F.col("key") > -float(1 << 61), F.col("key"))  # ids that were null lie far below all others
    least, most = like.agg(F.coalesce(F.min(real), F.lit(0.0)), F.max("key")).first()
    ends[0], ends[-1] = (*ends[0][:3], least, ends[0][4]), (*ends[-1][:4], most)
    return like.sparkSession.createDataFrame(ends, _ENDS)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to every core if the scan would use less than half of them (a small table in one file).

    A table of many files or row groups is left as it is, so large inputs are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
