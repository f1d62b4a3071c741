"""Phrase collocations: frequent n-grams by pivot partitioning (MG-FSM), their weakest cut, and the best of each language.

1. Texts become chunks of tokens once, written to the shared folder. A word's key is a 64-bit hash of language and word, so
   everything that follows is per language without being grouped by it.
2. Buckets of the keys add up the words' counts. Words seen ``least`` times or more are the frequent ones: only they can
   be part of a frequent phrase. They get numbers, and chunks get the numbers and counts of theirs back.
3. An n-gram belongs to its rarest word, the pivot. First the pairs of words: each chunk sends its distinct pairs, with their
   numbers, to the bucket of the pivot, and learns which are frequent. No longer phrase holds another pair.
4. Every occurrence of a frequent word is a pivot: its fragment is the run of words around it, at most ``longest - 1`` on
   either side, up to the first that is rarer than the pivot or does not make a frequent pair. Of several occurrences
   the leftmost owns an n-gram (words to the left must be more frequent, words to the right may be the pivot itself). So
   each occurrence of an n-gram lies around its pivot in exactly one fragment. Equal fragments of a chunk are one with a
   number, and go to the bucket of their pivot, which counts the n-grams that hold the pivot.
5. A pivot with more occurrences than ``HOT_TOKENS`` is dealt to several groups, as many as its count asks for: its pairs by
   the other word, its fragments by the chunk, whose counts are added up afterwards.
6. The frequent phrases are a relation from then on: cuts, the longer phrases that hold them, ranks and words are joins.
   Products are decimals of 38 digits, and division is that of integers.

Words are told apart by 64-bit hashes; two of n share one with probability near n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textcore import Words, mix64, slices, spread, stretch, text_buffer, text_bytes
from plumbline.shared import scratch, written

LEAST, LONGEST, BEST = 100, 5, 2000
CHUNK_BYTES = 8 << 20
#: Tokens of a bucket, and occurrences of a word from which its fragments are dealt to several groups.
BUCKET_TOKENS, HOT_TOKENS = 1 << 19, 1 << 19
#: Rows of a relation that may be broadcast.
BROADCAST_ROWS = 100_000
UNDETERMINED = "und"

#: Words of ``[^\x20\x09]+`` in the pieces that ``[.,;:!?\x0A-\x0D]`` cuts.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False

_BASE = np.uint64(0x9E6C63D0676A9A99)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _packed(x: np.ndarray) -> bytes:
    """Numbers that are mostly small: the bytes of equal weight together, compressed."""
    return zstandard.compress(_blob(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def _unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _batch(rows: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))


_B, _I, _L = pa.binary(), pa.int32(), pa.int64()
_CHUNK = {"chunk": _L, "keys": _B, "lang": _B, "of": _B, "breaks": _B, "words": _B, "sizes": _B, "langs": pa.list_(pa.string()), "tokens": pa.list_(_L), "lang_keys": pa.list_(_L)}
_CHUNK_SQL = "chunk long, keys binary, lang binary, of binary, breaks binary, words binary, sizes binary, langs array<string>, tokens array<long>, lang_keys array<long>"


def _spans(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the spans one after another, and where each ends."""
    size = end - start
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return _blob(text[at]), ends


class _Building:
    """The tokens of a chunk as its texts come."""

    def __init__(self):
        self.keys, self.lang, self.breaks, self.words, self.tokens, self.size = [], [], [], [], {}, 0

    def add(self, langs: list[str], part: np.ndarray, off: np.ndarray) -> None:
        words = Words(part, off, _INSIDE, lower=True)
        n, lang = len(words.start), np.repeat(np.array([xxhash.xxh64_intdigest(x) for x in langs], np.uint64), words.counts)
        ends = np.concatenate([[0], np.cumsum(_ENDS[words.data])])
        breaks = np.ones(n, bool)
        breaks[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
        breaks[words.first[:-1][words.counts > 0]] = True
        keys = mix64(words.hash ^ mix64(lang))
        seen, first = np.unique(keys, return_index=True)
        raw, stop = _spans(words.data, words.start[first], words.end[first])
        self.keys.append(keys)
        self.lang.append((seen, lang[first]))
        self.breaks.append(breaks)
        self.words.append((raw, stop))
        for x, k in zip(langs, words.counts.tolist()):
            self.tokens[x] = self.tokens.get(x, 0) + k
        self.size += len(part) + 16 * len(langs)

    def row(self, chunk: int) -> tuple:
        keys, of, n = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        lang, start, stop, base = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), 0
        for (seen, own), (raw, ends) in zip(self.lang, self.words):
            at = np.searchsorted(keys, seen)
            lang[at], start[at], stop[at] = own, np.concatenate([[0], ends[:-1]])[: len(ends)] + base, ends + base
            base += len(raw)
        # frequent words first: their places are small numbers
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys), dtype=np.uint32)
        raw, ends = _spans(np.frombuffer(b"".join(x for x, _ in self.words), np.uint8), start[order], stop[order])
        lang_keys = np.array([xxhash.xxh64_intdigest(x) for x in self.tokens], np.uint64)
        by_key = np.argsort(lang_keys)
        lang = by_key[np.searchsorted(lang_keys[by_key], lang[order])].astype(np.uint32)
        breaks = zstandard.compress(_blob(np.packbits(np.concatenate(self.breaks))))
        sizes = _packed(np.diff(ends, prepend=0).astype(np.uint32))
        blobs = (_blob(keys[order]), _packed(lang), _packed(place[of]), breaks, zstandard.compress(raw), sizes)
        return chunk, *blobs, list(self.tokens), list(self.tokens.values()), lang_keys.view(np.int64).tolist()


def _tokenised(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = TaskContext.get().partitionId() << 32, _Building()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, off in slices(data, offsets):
                own.add(langs[a:b], part, off)
                if own.size >= chunk_bytes:
                    yield _batch([own.row(number)], _CHUNK)
                    number, own = number + 1, _Building()
        if own.keys:
            yield _batch([own.row(number)], _CHUNK)

    return run


def _as_phrases(words: np.ndarray) -> pa.Array:
    """Rows of keys as binary values, 8 bytes a word, the highest byte first."""
    n, size = words.shape
    ends = np.arange(0, 8 * size * (n + 1), 8 * size, dtype=np.int32)
    return pa.Array.from_buffers(_B, n, [None, pa.py_buffer(ends), pa.py_buffer(_blob(words.astype(">u8")))])


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _dealt(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the entries by group, the groups, and where each begins after the first."""
    order = np.argsort(group, kind="stable")
    used, begin = np.unique(group[order], return_index=True)
    return order, used, begin[1:]


_COUNTS_SQL = "bucket int, chunk long, keys binary, n binary, lang binary, at binary, lang_keys array<long>"
_COUNTS = {"bucket": _I, "chunk": _L, "keys": _B, "n": _B, "lang": _B, "at": _B, "lang_keys": pa.list_(_L)}
_WORDS = -1


def _counted(buckets: int):
    """Counts of each chunk's words, by bucket; ``at`` are their places among the chunk's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, lang, of, lang_keys in zip(*(c.to_pylist() for c in batch.columns)):
                keys, lang = np.frombuffer(raw, np.uint64), _unpacked(lang, np.uint32)
                order, used, begin = _dealt(_bucket_of(keys, buckets))
                cut = lambda x, f=_packed: [f(p) for p in np.split(x[order], begin)] if len(used) else []
                n = np.bincount(_unpacked(of, np.uint32), minlength=len(keys)).astype(np.uint32)
                cols = (cut(keys, _blob), cut(n), cut(lang), cut(np.arange(len(keys), dtype=np.uint32)), [lang_keys] * len(used))
                yield _batch(list(zip(used.tolist(), [chunk] * len(used), *cols)), _COUNTS)

    return run


def _added(least: int, buckets: int):
    """The words of a bucket seen ``least`` times or more: one row (chunk -1) of all, and one for each chunk with the places, counts and numbers of its own.

    The i-th word of a bucket has the number i * buckets + bucket.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        asked = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("keys")]
        ends = np.cumsum([0, *map(len, asked)])
        keys, first, which = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([_unpacked(x.as_py(), np.uint32) for x in rows.column("n")]), minlength=len(keys)).astype(np.int64)
        lang = np.concatenate([np.array(k.as_py(), np.int64)[_unpacked(x.as_py(), np.uint32)] for x, k in zip(rows.column("lang"), rows.column("lang_keys"))])[first]
        own = n >= least
        number = (np.cumsum(own) - 1).astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        out = [(bucket, _WORDS, _blob(keys[own]), _packed(n[own]), _packed(lang[own]), b"", [])]
        for i, at in enumerate(rows.column("at")):
            mine = which[ends[i] : ends[i + 1]]
            known = np.flatnonzero(own[mine])
            if len(known):
                mine = mine[known]
                out.append((bucket, rows.column("chunk")[i].as_py(), _packed(number[mine]), _packed(n[mine]), b"", _packed(_unpacked(at.as_py(), np.uint32)[known]), []))
        return pa.Table.from_batches([_batch(out, _COUNTS)])

    return run


_RANKED = {"chunk": _L, "ids": _B, "n": _B, "ranks": _B, "breaks": _B}
_RANKED_SQL = "chunk long, ids binary, n binary, ranks binary, breaks binary"


def _ranked(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's tokens as 1 + the rank of their word in the chunk, the most frequent first; 0 for words that are not frequent."""
    c = chunk.to_pylist()[0]
    of = _unpacked(c["of"], np.uint32)
    cat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(_unpacked(x.as_py(), kind) for x in answers.column(name))])
    at, n, ids = cat("at", np.uint32), cat("n", np.int64), cat("keys", np.uint64)
    order = np.lexsort((ids, -n))
    rank = np.zeros(int(max(of.max(initial=0), at.max(initial=0))) + 1, np.uint32)
    rank[at[order]] = np.arange(1, len(at) + 1)
    return pa.Table.from_batches([_batch([(c["chunk"], _packed(ids[order]), _packed(n[order]), _packed(rank[of]), c["breaks"])], _RANKED)])


class _Ranked:
    """A ranked chunk: ``rank`` of each token (-1: not frequent), and whether it and the next are in one piece and frequent."""

    def __init__(self, chunk: int, ids: bytes, n: bytes, ranks: bytes, breaks: bytes):
        self.chunk, self.ids, self.n = chunk, _unpacked(ids, np.uint64), _unpacked(n, np.int64)
        self.rank = _unpacked(ranks, np.uint32).astype(np.int32) - 1
        starts = np.unpackbits(np.frombuffer(zstandard.decompress(breaks), np.uint8), count=len(self.rank)).astype(bool)
        self.joined = np.zeros(len(self.rank), bool)
        self.joined[:-1] = ~starts[1:] & (self.rank[1:] >= 0) & (self.rank[:-1] >= 0)

    def pairs(self, buckets: int, hot: int) -> tuple[np.ndarray, ...]:
        """Distinct pairs (pivot, other, whether the pivot is the second word, number, group) by group, and the pair that each joined token begins."""
        at = np.flatnonzero(self.joined)
        a, b = self.rank[at].astype(np.int64), self.rank[at + 1].astype(np.int64)
        code, which, n = np.unique(np.maximum(a, b) << 32 | np.minimum(a, b) << 1 | (b > a), return_inverse=True, return_counts=True)
        pivot, other = code >> 32, code >> 1 & ((1 << 31) - 1)
        groups = np.maximum(-(-self.n[pivot] // hot), 1).astype(np.uint64) if len(code) else np.zeros(0, np.uint64)
        salt = (mix64(self.ids[other] + np.uint64(1)) % groups).astype(np.int64) if len(code) else np.zeros(0, np.int64)
        most = int(salt.max(initial=0)) + 1
        group = _bucket_of(mix64(self.ids[pivot]), buckets) * most + salt
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pivot[order], other[order], (code & 1)[order].astype(bool), n[order], group[order] // most, group[order] % most, place[which]


def _ranked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Ranked]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield _Ranked(*row)


_PAIRS = {"bucket": _I, "salt": _I, "chunk": _L, "start": _I, "ids": _B, "pivot": _B, "other": _B, "second": _B, "n": _B}
_PAIRS_SQL = "bucket int, salt int, chunk long, start int, ids binary, pivot binary, other binary, second binary, n binary"


def _paired(buckets: int, hot: int):
    """The distinct pairs of each chunk, by the bucket of their pivot; ``start`` is the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _ranked_chunks(batches):
            pivot, other, second, n, bucket, salt, _ = c.pairs(buckets, hot)
            begin = np.flatnonzero(np.diff(bucket, prepend=-1) | np.diff(salt, prepend=-1)) if len(pivot) else []
            rows = []
            for i, j in zip(begin, [*begin[1:], len(pivot)]):
                words, slots = np.unique(np.concatenate([pivot[i:j], other[i:j]]), return_inverse=True)
                slots = slots.astype(np.uint32)
                step = np.diff(slots[: j - i], prepend=np.uint32(0)).astype(np.uint32)
                rows.append((bucket[i], salt[i], c.chunk, i, _packed(c.ids[words]), _packed(step), _packed(slots[j - i :]), _blob(np.packbits(second[i:j])), _packed(n[i:j].astype(np.uint32))))
            yield _batch(rows, _PAIRS)

    return run


_FREQUENT_SQL = "phrase binary, a long, chunk long, start int, size int, bits binary"


def _pairs_mined(least: int):
    """The frequent pairs of a group, and for each chunk one bit for each pair it sent: frequent or not."""

    def run(rows: pa.Table) -> pa.Table:
        left, right, times, sizes = [], [], [], []
        for ids, step, other, second, n in zip(*(rows.column(c) for c in ("ids", "pivot", "other", "second", "n"))):
            ids, pivot = _unpacked(ids.as_py(), np.uint64), np.cumsum(_unpacked(step.as_py(), np.uint32), dtype=np.uint32)
            a, b = ids[pivot], ids[_unpacked(other.as_py(), np.uint32)]
            last = np.unpackbits(np.frombuffer(second.as_py(), np.uint8), count=len(a)).astype(bool)
            left.append(np.where(last, b, a))
            right.append(np.where(last, a, b))
            times.append(_unpacked(n.as_py(), np.uint32))
            sizes.append(len(a))
        left, right = np.concatenate(left), np.concatenate(right)
        code, first, which = np.unique(mix64(mix64(left) * _BASE + right), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(times), minlength=len(code)).astype(np.int64)
        keep, some = np.flatnonzero(n >= least), n[which] >= least
        phrases = _as_phrases(np.stack([left[first[keep]], right[first[keep]]], 1))
        bits = [np.packbits(x).tobytes() for x in np.split(some, np.cumsum(sizes)[:-1])]
        blank = lambda k, kind: pa.nulls(k, kind)
        chunks = pa.chunked_array([blank(len(keep), _L), rows.column("chunk").combine_chunks()], _L)
        starts = pa.chunked_array([blank(len(keep), _I), rows.column("start").combine_chunks()], _I)
        cols = (pa.chunked_array([phrases, blank(len(sizes), _B)], _B), pa.chunked_array([pa.array(n[keep]), blank(len(sizes), _L)], _L), chunks, starts)
        return pa.table([*cols, pa.chunked_array([blank(len(keep), _I), pa.array(sizes, _I)], _I), pa.chunked_array([blank(len(keep), _B), pa.array(bits, _B)], _B)], names=["phrase", "a", "chunk", "start", "size", "bits"])

    return run


_FRAGMENTS = {"bucket": _I, "salt": _I, "ids": _B, "sides": _B, "slots": _B, "n": _B}
_FRAGMENTS_SQL = "bucket int, salt int, ids binary, sides binary, slots binary, n binary"


def around_pivots(rank: np.ndarray, joined: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each token in its fragment; ``rank`` is 0 for the most frequent word, ``joined`` whether a phrase may hold a token and the next."""
    size = len(rank)
    before, after = np.zeros(size, np.int8), np.zeros(size, np.int8)
    left = right = np.ones(size, bool)
    for d in range(1, min(reach, size - 1) + 1):
        left, right = left.copy(), right.copy()
        left[:d], right[size - d :] = False, False
        left[d:] &= joined[: size - d] & (rank[:-d] < rank[d:])
        right[:-d] &= joined[d - 1 : size - 1] & (rank[d:] <= rank[:-d])
        before += left
        after += right
    return before, after


def _columns(reach: int) -> list[int]:
    """Columns of a fragment from the pivot outwards."""
    return [reach, *(reach + d * side for d in range(1, reach + 1) for side in (1, -1))]


def _fragments(buckets: int, reach: int, hot: int):
    width = 2 * reach + 1

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = next(_ranked_chunks(chunk.to_batches()))
        rank, ids, n = c.rank, c.ids, c.n
        *_, pair = c.pairs(buckets, hot)
        frequent = np.zeros(int(pair.max(initial=-1)) + 1, bool)
        for start, size, bits in zip(*(answers.column(x).to_pylist() for x in ("start", "size", "bits"))):
            frequent[start : start + size] = np.unpackbits(np.frombuffer(bits, np.uint8), count=size)
        joined = c.joined.copy()
        joined[c.joined] = frequent[pair]
        before, after = around_pivots(rank, joined, reach)
        at = np.flatnonzero(before + after > 1)
        before, after = before[at], after[at]
        # the words around each pivot, 1 + rank, 0 outside of the fragment
        grid, code = np.zeros((len(at), width), np.int32), np.zeros(len(at), np.uint64)
        for d in range(-reach, reach + 1):
            inside = np.flatnonzero((before >= -d) if d < 0 else (after >= d))
            grid[inside, d + reach] = rank[at[inside] + d] + 1
            code = code * _BASE + grid[:, d + reach].astype(np.uint64)
        _, first, times = np.unique(mix64(code), return_index=True, return_counts=True)
        grid, before, after = grid[first], before[first], after[first]
        pivot = grid[:, reach].astype(np.int64) - 1
        groups = -(-n[pivot] // hot)
        salt = np.where(groups > 1, 1 + int(mix64(np.array([c.chunk]).astype(np.uint64))[0] >> np.uint64(1)) % np.maximum(groups, 1), 0)
        most = int(salt.max(initial=0)) + 1
        # equal words next to each other: that is what makes the messages short
        alike = np.lexsort((grid[:, reach - 1], grid[:, reach + 1], grid[:, reach])) if len(grid) else np.zeros(0, np.int64)
        group = _bucket_of(mix64(ids[pivot]), buckets) * most + salt
        order, used, begin = _dealt(group[alike])
        rows = []
        for g, own in zip(used.tolist(), np.split(alike[order], begin)) if len(used) else []:
            part = grid[own]
            words, slots = np.unique(part[part > 0], return_inverse=True)
            local = np.zeros(part.shape, np.uint32)
            local[part > 0] = slots
            slots = np.concatenate([local[part[:, i] > 0, i] for i in _columns(reach)])
            sides = (before[own].astype(np.uint8) << 4) | after[own].astype(np.uint8)
            rows.append((g // most, g % most, _packed(ids[words - 1]), _packed(sides), _packed(slots), _packed(times[own].astype(np.uint32))))
        return pa.Table.from_batches([_batch(rows, _FRAGMENTS)])

    return run


def count_around(keys: np.ndarray, grid: np.ndarray, before: np.ndarray, after: np.ndarray, times: np.ndarray, longest: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words as rows, counts) of the n-grams of 3 words or more around the pivots, one length at a time; ``grid`` has places in ``keys``, the pivot in the middle."""
    reach, mixed = grid.shape[1] // 2, mix64(keys)
    for size in range(3, longest + 1):
        codes, found = [], []
        for left in range(size):
            own = np.flatnonzero((before >= left) & (after >= size - 1 - left))
            code = np.zeros(len(own), np.uint64)
            for d in range(size):
                code = code * _BASE + mixed[grid[own, reach - left + d]]
            codes.append(code)
            found.append(own)
        lefts = np.repeat(np.arange(size), [len(x) for x in found])
        found = np.concatenate(found)
        code, first, which = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=times[found], minlength=len(code)).astype(np.int64)
        keep = np.flatnonzero(n >= least)
        at = first[keep]
        if len(keep):
            yield keys[grid[found[at][:, None], (reach - lefts[at])[:, None] + np.arange(size)]], n[keep]


def _mine(longest: int, least: int):
    reach = longest - 1

    def run(rows: pa.Table) -> pa.Table:
        heads = [_unpacked(x.as_py(), np.uint64) for x in rows.column("ids")]
        keys, place = np.unique(np.concatenate(heads), return_inverse=True)
        base, grids, sides, times = np.cumsum([0, *map(len, heads)]), [], [], []
        for i, (own, words, n) in enumerate(zip(*(rows.column(c) for c in ("sides", "slots", "n")))):
            sides.append(_unpacked(own.as_py(), np.uint8))
            times.append(_unpacked(n.as_py(), np.uint32))
            slots, at = place[base[i] + _unpacked(words.as_py(), np.uint32).astype(np.int64)].astype(np.int32), 0
            grid = np.zeros((len(sides[-1]), 2 * reach + 1), np.int32)
            for c in _columns(reach):
                inside = np.flatnonzero((sides[-1] >> 4) >= reach - c if c < reach else (sides[-1] & 15) >= c - reach)
                grid[inside, c] = slots[at : at + len(inside)]
                at += len(inside)
            grids.append(grid)
        sides, times, grid = np.concatenate(sides), np.concatenate(times), np.concatenate(grids)
        before, after = (sides >> 4).astype(np.int64), (sides & 15).astype(np.int64)
        # of a pivot that is dealt to several groups, every count is needed
        own = least if rows.column("salt")[0].as_py() == 0 else 1
        phrases, counts = [], []
        for words, n in count_around(keys, grid, before, after, times, longest, own):
            phrases.append(_as_phrases(words))
            counts.append(n)
        return pa.table({"phrase": pa.chunked_array(phrases, _B), "a": pa.array(np.concatenate(counts) if counts else [], _L)})

    return run


def _word_rows(buckets: int):
    """One row per frequent word: its number as a phrase, its count, its language's key and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw, n, lang in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(raw, np.uint64)
                number = np.arange(len(keys), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
                cols = [_as_phrases(number[:, None]), pa.array(_unpacked(n, np.int64)), pa.array(_unpacked(lang, np.int64)), pa.array(keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["phrase", "a", "lang_key", "key"])

    return run


def _spelled(wanted: np.ndarray | None):
    """(key, word) of the words of each chunk, of ``wanted`` ones (sorted keys) if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, w, e in zip(*(c.to_pylist() for c in batch.columns)):
                keys, ends, w = np.frombuffer(k, np.uint64), np.cumsum(_unpacked(e, np.uint32)), zstandard.decompress(w)
                own = np.arange(len(keys)) if wanted is None else np.flatnonzero(np.isin(keys, wanted))
                words = [w[(ends[i - 1] if i else 0) : ends[i]].decode() for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(words, pa.string())], names=["key", "word"])

    return run


def _part(phrase: Column, start: Column, words: Column) -> Column:
    """Words of a phrase, counted from 0."""
    return F.substring(phrase, start * 8 + 1, words * 8)


def _size(phrase: str) -> Column:
    return (F.octet_length(phrase) / 8).cast("int")


class Mined(NamedTuple):
    """Chunks of tokens, frequent words as (phrase, a, lang_key, key), frequent phrases as (phrase, a): 8 bytes for each word's number."""

    chunks: DataFrame
    words: DataFrame
    phrases: DataFrame

    def langs(self) -> DataFrame:
        """lang_key, lang and n (tokens) of each language."""
        each = self.chunks.select(F.explode(F.arrays_zip("lang_keys", "langs", "tokens")).alias("x"))
        return each.groupBy(F.col("x.lang_keys").alias("lang_key"), F.col("x.langs").alias("lang")).agg(F.sum("x.tokens").alias("n"))


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT_TOKENS
) -> Mined:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more in the texts of one language, with their counts.

    A phrase is 8 bytes per word. The tables are written to the shared folder.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)) if lang_col in docs.columns else F.lit(UNDETERMINED)
    data = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    _, size = text_bytes(data, "text")
    wider = stretch(size)
    buckets = max(48, int(size / 6 / BUCKET_TOKENS / wider))
    chunks = written(spread(data).mapInArrow(_tokenised(int(chunk_bytes * wider)), _CHUNK_SQL), "tokens")
    counts = chunks.select("chunk", "keys", "lang", "of", "lang_keys").mapInArrow(_counted(buckets), _COUNTS_SQL)
    known = written(counts.groupBy("bucket").applyInArrow(_added(least, buckets), _COUNTS_SQL), "words")
    answers = known.filter(F.col("chunk") != _WORDS).select("chunk", "keys", "at", "n")
    tokens = chunks.select("chunk", "of", "breaks")
    ranked = written(tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_ranked, _RANKED_SQL), "ranked")
    paired = ranked.mapInArrow(_paired(buckets, hot), _PAIRS_SQL)
    pairs = written(paired.groupBy("bucket", "salt").applyInArrow(_pairs_mined(least), _FREQUENT_SQL), "pairs")
    phrases = pairs.filter("phrase IS NOT NULL").select("phrase", "a")
    if longest > 2:
        bits = pairs.filter("chunk IS NOT NULL").select("chunk", "start", "size", "bits")
        routed = ranked.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(_fragments(buckets, longest - 1, hot), _FRAGMENTS_SQL)
        mined = routed.groupBy("bucket", "salt").applyInArrow(_mine(longest, least), "phrase binary, a long")
        longer = mined.groupBy("phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
        phrases = phrases.unionByName(written(longer, "phrases"))
    words = known.filter(F.col("chunk") == _WORDS).select("bucket", "keys", "n", "lang").mapInArrow(_word_rows(buckets), "phrase binary, a long, lang_key long, key long")
    return Mined(chunks, words, phrases)


def weakest_cut(found: Mined) -> DataFrame:
    """phrase, lang, a, l, r, n, score of every phrase: the cut of the lowest score, of equal ones the first."""
    parts = found.words.select("phrase", "a", "lang_key").unionByName(found.phrases, allowMissingColumns=True)
    cuts = found.phrases.select("phrase", "a", F.explode(F.sequence(F.lit(1), _size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": _part(F.col("phrase"), F.lit(0), F.col("k")), "tail": _part(F.col("phrase"), F.col("k"), _size("phrase"))})
    # the first cut's head is a word: its language is that of the phrase
    cuts = cuts.join(parts.select(F.col("phrase").alias("head"), F.col("a").alias("l"), "lang_key"), "head")
    cuts = cuts.join(parts.select(F.col("phrase").alias("tail"), F.col("a").alias("r")), "tail")
    whole = cuts.groupBy("phrase", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"), F.max("lang_key").alias("lang_key"))
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    score = f"(CAST(1000 AS DECIMAL(38, 0)) * {wide('a')} * {wide('n')}) div ({wide('c.l')} * {wide('c.r')})"
    scored = F.array_min(F.expr(f"transform(cuts, c -> struct({score} AS score, c.k AS k, c.l AS l, c.r AS r))"))
    best = whole.join(_bounded(found.langs()), "lang_key").withColumn("best", scored)
    return best.select("phrase", "lang", "a", "best.l", "best.r", "n", "best.score")


def _bounded(df: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _first(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each language with their ``rank``: of 64 parts first, then of what these leave."""
    parts, whole = (Window.partitionBy(*by).orderBy(*order) for by in (("lang", "part"), ("lang",)))
    own = df.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= n)
    return own.drop("part").withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= n)


def not_inside_longer(phrases: DataFrame) -> DataFrame:
    """The phrases without those of which every occurrence lies in one longer phrase.

    A longer phrase never occurs more often, and the phrases between the two then occur as often: those of one more word suffice.
    """
    inner = F.array(_part(F.col("phrase"), F.lit(0), _size("phrase") - 1), _part(F.col("phrase"), F.lit(1), _size("phrase") - 1))
    held = phrases.filter(_size("phrase") > 2).select(F.explode(inner).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    return phrases.join(held, "phrase", "left").filter("longer IS NULL OR longer < a").drop("longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int = BEST, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT_TOKENS
) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts have A-Z lower-cased, are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. Counts are per
    language (null, or no such column: ``und``) and over all rows, repeated ones included: n of all words, a of the phrase, l and r of
    the two parts of its weakest cut, score floor(1000 * a * n / (l * r)). Phrases have 2 to ``longest`` words and ``least``
    occurrences at least, and none that lies inside a longer one each time. Ranks follow score and a, both falling, then the phrase by its
    bytes. Null and empty texts have no words. Other columns are not read. A table without a frequent phrase gives no row.
    """
    with scratch(docs.sparkSession):
        found = frequent_phrases(docs, text_col, lang_col, least, longest, chunk_bytes, hot)
        scored = written(not_inside_longer(weakest_cut(found)), "scored")
        falling = F.desc("score"), F.desc("a")
        # what ties with the last stays until its words are known
        bar = _first(scored, best, *falling).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("bar"))
        top = written(scored.join(_bounded(bar), "lang").filter(F.struct("score", "a") >= F.col("bar")).drop("bar"), "top")
        each = F.transform(F.sequence(F.lit(0), _size("phrase") - 1), lambda i: _part(F.col("phrase"), i, F.lit(1)))
        keys = top.select("phrase", F.posexplode(each).alias("i", "id")).join(found.words.select(F.col("phrase").alias("id"), "key"), "id")
        wanted, near = keys.select("key").distinct(), None
        if wanted.count() <= BROADCAST_ROWS:
            near = np.sort(np.array([r["key"] for r in wanted.toLocalIterator()], np.int64).view(np.uint64))
        words = found.chunks.select("keys", "words", "sizes").mapInArrow(_spelled(near), "key long, word string").groupBy("key").agg(F.min("word").alias("word"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
        named = top.join(keys.join(words, "key").groupBy("phrase").agg(text.alias("text")), "phrase")
        ranked = _first(named, best, *falling, "text")
        return written(ranked.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score"), "collocations", hold=True)
