"""Class-based bigram language model with classes from exchange clustering (Brown classes).

Every distinct training word gets a class by exchange: it goes to the class
that raises the likelihood of the class bigrams most. What grows with the
corpus stays in Spark:

1. texts become chunks of tokens once: the sorted distinct word hashes of the
   chunk and each token's place among them. Chunks are written and never
   depend on the order of the rows;
2. buckets of the hash space count every word. The ``HEAD`` most frequent ones
   and their mutual neighbour counts - a table of fixed size - seed the classes
   by sequential exchange;
3. in each round every chunk counts, for each of its words, the classes of the
   words before and after. Buckets add the counts of a word and evaluate its
   exchange against the table of all class bigrams, which has a fixed size
   and goes to all tasks. All words are evaluated at once, as if their neighbours stayed;
   in the first round only the head has classes, so the others join
   by their neighbours in it;
4. chunks learn the counts and classes of their words from the buckets and
   become sequences of classes, from which texts are scored.

The probability of a word after another is P(class | class before) *
P(word | class), both with additive smoothing. All unseen words are one more
word of the class that has the most words seen once. The text's start and end
are a class of their own. Over all words, the unseen word and the end the
probabilities after any class add up to one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textcore import NULL_ID, SPACED, Words, mix64, slices, spread, stretch, text_buffer, text_bytes
from plumbline.shared import drop, scratch, stored, written

HEAD, CLASSES, SWEEPS, ROUNDS = 512, 64, 12, 4
CHUNK_BYTES = 8 << 20
BUCKET_TOKENS = 2 << 20
#: So many chunks at most are added up in one group; more are added up in two steps.
FAN_IN = 1024
EDGE, OPEN = 0, CLASSES  # the class of a text's ends, and of words that have none yet
_WIDTH = CLASSES + 1
#: A neighbour that only counts the word: tokens of texts that judge the rounds.
_ASIDE = 2 * _WIDTH
_UNSEEN = 255
LEARNS, HELD, JUDGES = 0, 1, 2


def _held_out(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo 10, is 0; a null id is never held out."""
    return np.array([i != NULL_ID and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.tolist()], bool)


def _roles(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What each text is for: held out, or to judge the rounds (a tenth of the rest, by a hash of the words, copies alike), or to learn."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    judges = mix64(sums[first[1:]] - sums[first[:-1]]) % np.uint64(10) == 1
    return np.where(_held_out(ids), HELD, np.where(judges, JUDGES, LEARNS)).astype(np.uint8)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _joined(column, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _short(keys: np.ndarray) -> np.ndarray:
    """The seven low bytes of each hash; the bucket stands for the rest."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]


def _long(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 7, 8), np.uint8)
    wide[:, :7] = raw.reshape(-1, 7)
    return wide.view("<u8").ravel()


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted hashes, and where each begins."""
    return np.unique((keys >> np.uint64(64 - bits)).astype(np.int64), return_index=True)


class Chunk:
    """A chunk of tokens; ``of`` is each token's place in the sorted ``keys``."""

    SCHEMA = "chunk long, ids binary, held binary, counts binary, keys binary, low binary, high binary"

    def __init__(self, chunk, ids, held, counts, keys, low, high):
        self.chunk, self.ids = chunk, np.frombuffer(ids, np.int64)
        self.role, self.counts = np.frombuffer(held, np.uint8), np.frombuffer(counts, np.int32)
        self.keys = np.frombuffer(keys, np.uint64)
        self.of = np.frombuffer(high, np.uint16).astype(np.int64) << 16 | np.frombuffer(low, np.uint16)
        self.first = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.held = self.role == HELD
        self.learns = np.repeat(~self.held, self.counts)

    @staticmethod
    def row(chunk: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list:
        ids, counts, hashes = (np.concatenate(x) for x in zip(*parts))
        keys, of = np.unique(hashes, return_inverse=True)
        blobs = (ids, _roles(ids, counts, hashes), counts.astype(np.int32), keys, (of & 0xFFFF).astype(np.uint16), (of >> 16).astype(np.uint16))
        return [chunk, *map(_blob, blobs)]

    def around(self, symbols: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols before and after each token's, ``edge`` at the ends of texts, and the last symbol of each text."""
        before, after = np.full(len(symbols), edge, symbols.dtype), np.full(len(symbols), edge, symbols.dtype)
        before[1:], after[:-1] = symbols[:-1], symbols[1:]
        some = self.counts > 0
        before[self.first[:-1][some]] = after[self.first[1:][some] - 1] = edge
        last = np.full(len(self.counts), edge, symbols.dtype)
        last[some] = symbols[self.first[1:][some] - 1]
        return before, after, last

    def bigrams(self, symbols: np.ndarray, edge: int, width: int, roles: tuple[int, ...] = (LEARNS, JUDGES)) -> np.ndarray:
        """Counts of (symbol before, symbol) in the texts of these roles, with their ends."""
        before, _, last = self.around(symbols, edge)
        texts = np.isin(self.role, roles)
        table = np.bincount((before * width + symbols)[np.repeat(texts, self.counts)], minlength=width * width)
        return table + np.bincount(last[texts] * width + edge, minlength=width * width)


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield Chunk(*row)


def _tokenised(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, off in slices(data, offsets):
                words = Words(part, off, SPACED, lower=True)
                parts.append((ids[a:b], words.counts, words.hash))
                size += len(part) + 16 * (b - a)
                if size >= chunk_bytes:
                    yield _batch([Chunk.row(number, parts)], _CHUNK)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield _batch([Chunk.row(number, parts)], _CHUNK)

    return run


def _batch(rows: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))


_B, _I, _L = pa.binary(), pa.int32(), pa.int64()
_CHUNK = {"chunk": _L, "ids": _B, "held": _B, "counts": _B, "keys": _B, "low": _B, "high": _B}
#: Words of a bucket: their hashes and counts, and later their classes.
_COUNTS, _COUNTS_SQL = {"bucket": _I, "chunk": _L, "keys": _B, "n": _B}, "bucket int, chunk long, keys binary, n binary"
_WORDS, _WORDS_SQL = {"bucket": _I, "keys": _B, "n": _B, "cls": _B, "moved": _L}, "bucket int, keys binary, n binary, cls binary, moved long"
#: Class-neighbour counts of words: ``size`` entries each, of ``ctx`` (class after, or _WIDTH + class before) and ``n``.
_NEAR = {"bucket": _I, "chunk": _L, "keys": _B, "cls": _B, "size": _B, "ctx": _B, "n": _B}
_NEAR_SQL = "bucket int, chunk long, keys binary, cls binary, size binary, ctx binary, n binary"


def _counted(bits: int):
    """Training counts of each chunk's words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            n = np.bincount(c.of[c.learns], minlength=len(c.keys))
            keys, n = c.keys[n > 0], n[n > 0]
            used, begin = _split(keys, bits)
            cut = lambda x: [_blob(p) for p in np.split(x, begin[1:])] if len(used) else []
            yield _batch(list(zip(used.tolist(), [c.chunk] * len(used), cut(_short(keys)), cut(n))), _COUNTS)

    return run


def _add_counts(rows: pa.Table) -> pa.Table:
    keys, which = np.unique(_long(_joined(rows.column("keys"), np.uint8)), return_inverse=True)
    n = np.bincount(which, weights=_joined(rows.column("n"), np.int64), minlength=len(keys)).astype(np.int64)
    return pa.Table.from_batches([_batch([(rows.column("bucket")[0].as_py(), rows.column("chunk")[0].as_py(), _blob(_short(keys)), _blob(n))], _COUNTS)])


def _added(df: DataFrame, n_chunks: int, add, schema: str, last=None, last_schema: str = "") -> DataFrame:
    """Rows of a bucket in one, in two steps if there are many chunks; ``last`` takes the place of ``add`` in the final step."""
    if n_chunks > FAN_IN:
        salt = F.pmod(F.xxhash64("chunk"), F.lit(-(-n_chunks // FAN_IN)))
        df = df.withColumn("salt", salt).groupBy("bucket", "salt").applyInArrow(lambda rows: add(rows.drop_columns("salt")), schema)
    return df.groupBy("bucket").applyInArrow(last or add, last_schema or schema)


def _totals(bits: int):
    """(words, tokens, null) of each bucket, and its most frequent words as (null, tokens, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, n = _long(np.frombuffer(raw, np.uint8)), np.frombuffer(blob, np.int64)
                keys = keys & np.uint64((1 << 56) - 1) | np.uint64(bucket) << np.uint64(64 - bits)
                top = np.lexsort((keys, -n))[:HEAD]
                rows = [(len(n), int(n.sum()), None), *((None, int(n[i]), int(keys[i].astype(np.int64))) for i in top)]
                yield _batch(rows, {"words": _L, "n": _L, "word": _L})

    return run


def _head_neighbours(head: np.ndarray):
    """Neighbour counts of the head's words; all other words are one unit, the ends another."""
    n = len(head) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for c in chunks_of(batches):
            total += c.bigrams(_labels(c.keys, head, np.arange(len(head)), n - 2)[c.of], n - 1, n, (LEARNS,))
        yield _batch([(TaskContext.get().partitionId(), i, _blob(r)) for i, r in enumerate(total.reshape(n, n)) if r.any()], {"task": _I, "unit": _I, "n": _B})

    return run


def _labels(keys: np.ndarray, head: np.ndarray, label: np.ndarray, other: int) -> np.ndarray:
    """Label of each hash that is in the sorted head, ``other`` for all others."""
    out = np.full(len(keys), other, np.int64)
    if len(head):
        at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
        out = np.where(head[at] == keys, label[at], out)
    return out


def _summed_rows(df: DataFrame) -> dict[int, np.ndarray]:
    """Arrays (task int, unit int, n binary) added up by unit, in two steps if there are many tasks."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.frombuffer(rows.column("n")[0].as_py(), np.int64).copy()
        for x in rows.column("n")[1:]:
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"task": rows.column("task")[:1], "unit": rows.column("unit")[:1], "n": pa.array([total.tobytes()], _B)})

    schema = "task int, unit int, n binary"
    df = df.withColumn("salt", F.col("task") % 64).groupBy("unit", "salt").applyInArrow(lambda rows: add(rows.drop_columns("salt")), schema)
    return {r["unit"]: np.frombuffer(r["n"], np.int64) for r in df.groupBy("unit").applyInArrow(add, schema).toLocalIterator()}


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, fixed: dict[int, int] | None = None) -> np.ndarray:
    """Class of each unit from the neighbour counts (square), by sequential exchange.

    ``fixed`` units keep their classes, which no other unit joins; without it that is the last unit, in class 0. The others
    start in the order of their frequency, one class each and then in turn; sweeps over all units end when none moves. Ties
    go to the smaller class.
    """
    n = counts.astype(float)
    fixed = {len(counts) - 1: 0} if fixed is None else fixed
    closed = sorted(set(fixed.values()))
    free = [k for k in range(classes) if k not in closed]
    mass = n.sum(0)
    order = [u for u in np.argsort(-mass, kind="stable").tolist() if u not in fixed]
    label = np.zeros(len(counts), np.int64)
    for u, k in fixed.items():
        label[u] = k
    for i, u in enumerate(order):
        label[u] = free[i % len(free)]
    member = np.eye(classes)[label]
    to, fro = n @ member, n.T @ member
    table = member.T @ to

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not mass[u]:
                continue
            a, own = label[u], n[u, u]
            r, c = to[u].copy(), fro[u].copy()
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            row, col = table.sum(1), table.sum(0)
            wide = (f(table + r) - f(table)).sum(1) + (f(table + c[:, None]) - f(table)).sum(0)
            d = np.diag(table)
            wide += f(d + r + c + own) - f(d + r) - f(d + c) + f(d)
            out, into = r.sum() + own, c.sum() + own
            gain = wide - (f(row + out) - f(row)) - (f(col + into) - f(col))
            gain[closed] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[a] + 1e-9:
                k = a
            table[k] += r
            table[:, k] += c
            table[k, k] += own
            if k != a:
                moved += 1
                label[u] = k
                to[:, a] -= n[:, u]
                to[:, k] += n[:, u]
                fro[:, a] -= n[u]
                fro[:, k] += n[u]
        if not moved:
            break
    return label


def _near_rows(c: Chunk, cls: np.ndarray, bits: int) -> list[tuple]:
    """Class-neighbour counts of a chunk's training words, by bucket; ``cls``: class of each of its keys."""
    symbols = cls[c.of]
    before, after, _ = c.around(symbols, EDGE)
    wide, mine, aside = _ASIDE + 1, *(np.repeat(c.role == r, c.counts) for r in (LEARNS, JUDGES))
    code = np.concatenate([(c.of * wide + after)[mine], (c.of * wide + _WIDTH + before)[mine], (c.of * wide + _ASIDE)[aside]])
    code, n = np.unique(code, return_counts=True)
    words, begin = np.unique(code // wide, return_index=True)
    keys, size = c.keys[words], np.diff(np.append(begin, len(code))).astype(np.uint8)
    used, at = _split(keys, bits)
    cut = lambda x: [_blob(p) for p in np.split(x, at[1:])] if len(used) else []
    inner = lambda x: [_blob(p) for p in np.split(x, begin[at[1:]])] if len(used) else []
    cols = [cut(_short(keys)), cut(cls[words].astype(np.uint8)), cut(size), inner((code % wide).astype(np.uint8)), inner(n.astype(np.int64))]
    return list(zip(used.tolist(), [c.chunk] * len(used), *cols))


def _first_near(bits: int, head: np.ndarray, label: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks_of(batches):
            yield _batch(_near_rows(c, _labels(c.keys, head, label, OPEN), bits), _NEAR)

    return run


def _served(c: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Corpus count and class of each of a chunk's keys."""
    answers = answers.sort_by("bucket")
    return _joined(answers.column("n"), np.int64), _joined(answers.column("cls"), np.uint8).astype(np.int64)


def _next_near(bits: int):
    """Class-neighbour counts with the classes of the last round; in rows of bucket -1 and -2, the chunk's class bigrams and those of the texts that judge."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = next(chunks_of(chunk.to_batches()))
        _, cls = _served(c, answers)
        cls = np.where(cls == _UNSEEN, OPEN, cls)
        rows = _near_rows(c, cls, bits)
        for bucket, role in ((-1, LEARNS), (-2, JUDGES)):
            rows.append((bucket, c.chunk, b"", b"", b"", b"", _blob(c.bigrams(cls[c.of], EDGE, _WIDTH, (role,)))))
        return pa.Table.from_batches([_batch(rows, _NEAR)])

    return run


class _Near(NamedTuple):
    keys: np.ndarray
    cls: np.ndarray
    begin: np.ndarray
    ctx: np.ndarray
    n: np.ndarray


def _add_up(rows: pa.Table) -> _Near:
    keys, first, which = np.unique(_long(_joined(rows.column("keys"), np.uint8)), return_index=True, return_inverse=True)
    size = _joined(rows.column("size"), np.uint8)
    code = np.repeat(which.astype(np.int64), size) * 256 + _joined(rows.column("ctx"), np.uint8)
    code, at = np.unique(code, return_inverse=True)
    n = np.bincount(at, weights=_joined(rows.column("n"), np.int64)).astype(np.int64)
    begin = np.searchsorted(code >> 8, np.arange(len(keys) + 1))
    return _Near(keys, _joined(rows.column("cls"), np.uint8)[first], begin, code & 255, n)


def _add_near(rows: pa.Table) -> pa.Table:
    x = _add_up(rows)
    blobs = (_short(x.keys), x.cls, np.diff(x.begin).astype(np.uint8), x.ctx.astype(np.uint8), x.n)
    return pa.Table.from_batches([_batch([(rows.column("bucket")[0].as_py(), rows.column("chunk")[0].as_py(), *map(_blob, blobs))], _NEAR)])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


_SMALL, _AT_ONCE = 16, 50_000


def best_classes(near: _Near, table: np.ndarray) -> np.ndarray:
    """The class that each word goes to: of the largest gain in likelihood, its own if no other gains more.

    ``table`` counts class bigrams (before, after) with every word in its class of ``near``; a word is taken out of its own
    class first. Its neighbours are taken to stay. Ties go to the smaller class.
    """
    both = np.concatenate([table.T, table, np.zeros((1, _WIDTH))]).astype(float)  # [ctx, class]: class before a right neighbour, after a left one
    grown = np.stack([_f(both + v) - _f(both) for v in range(_SMALL + 1)]).astype(np.float32)
    words = len(near.keys)
    right = near.ctx < _WIDTH
    of = np.repeat(np.arange(words), np.diff(near.begin))
    n = np.bincount(of[right], weights=near.n[right], minlength=words)
    row, col, cls = table.sum(1).astype(float), table.sum(0).astype(float), near.cls.astype(np.int64)
    gain = np.zeros((words, _WIDTH))
    edges, a = near.begin, 0
    while a < words:  # a bounded number of entries at a time
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + _AT_ONCE, side="right")) - 1)
        ctx, v = near.ctx[edges[a] : edges[b]], near.n[edges[a] : edges[b]]
        each = grown[np.minimum(v, _SMALL), ctx]
        big = np.flatnonzero(v > _SMALL)
        each[big] = _f(both[ctx[big]] + v[big, None]) - _f(both[ctx[big]])
        gain[a:b] = np.add.reduceat(each, edges[a:b] - edges[a], axis=0, dtype=np.float64)
        a = b
    k = np.arange(_WIDTH)
    gain -= _f(row[k] + n[:, None]) - _f(row[k]) + _f(col[k] + n[:, None]) - _f(col[k])
    own = both[near.ctx, cls[of]]
    stay = np.bincount(of, weights=_f(own) - _f(own - near.n), minlength=words)
    stay -= _f(row[cls]) - _f(row[cls] - n) + _f(col[cls]) - _f(col[cls] - n)
    gain[np.arange(words), cls] = stay
    gain[:, [EDGE, OPEN]] = -np.inf
    best = gain.argmax(1)
    keeps = (cls != OPEN) & (gain[np.arange(words), best] <= stay + 1e-6 * n)
    return np.where(keeps, cls, best)


def _evidence(x: _Near) -> tuple[_Near, np.ndarray]:
    """Neighbours in the texts that learn, and how often each word occurs in all."""
    of = np.repeat(np.arange(len(x.keys)), np.diff(x.begin))
    told = x.ctx < _ASIDE
    n = np.bincount(of[(x.ctx < _WIDTH) | ~told], weights=x.n[(x.ctx < _WIDTH) | ~told], minlength=len(x.keys)).astype(np.int64)
    return _Near(x.keys, x.cls, np.searchsorted(of[told], np.arange(len(x.keys) + 1)), x.ctx[told], x.n[told]), n


def _moved(table: np.ndarray, share: float):
    """The words of a bucket with their next classes; of those that have one, only a ``share`` (by their hashes) may move."""
    least = np.uint64(min(int(share * (1 << 32)), (1 << 32) - 1))

    def run(rows: pa.Table) -> pa.Table:
        x = _add_up(rows)
        told, n = _evidence(x)
        some = np.diff(told.begin) > 0
        may = some & ((x.cls == OPEN) | ((mix64(x.keys) >> np.uint64(32)) <= least))
        to = np.full(len(x.keys), OPEN)
        told = _Near(x.keys[some], x.cls[some], np.append(told.begin[:-1][some], told.begin[-1]), told.ctx, told.n)
        to[some] = np.where(may[some], best_classes(told, table), told.cls)
        row = (rows.column("bucket")[0].as_py(), _blob(_short(x.keys)), _blob(n), _blob(to.astype(np.uint8)), int(((to != x.cls) & (x.cls != OPEN)).sum()))
        return pa.Table.from_batches([_batch([row], _WORDS)])

    return run


def _labelled(unseen: int):
    """The words, those without a class in the one of unseen words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [np.frombuffer(x.as_py(), np.uint8) for x in batch.column(3)]
            own = pa.array([_blob(np.where(x == OPEN, np.uint8(unseen), x)) for x in cls], _B)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own, batch.column(4)], names=list(_WORDS))

    return run


def _asked(bits: int):
    """The words of each chunk, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = np.frombuffer(raw.as_py(), np.uint64)
                used, begin = _split(keys, bits)
                parts = [_blob(p) for p in np.split(_short(keys), begin[1:])] if len(used) else []
                yield _batch(list(zip(used.tolist(), [chunk] * len(used), parts)), {"bucket": _I, "chunk": _L, "keys": _B})

    return run


def _answered(asked: pa.Table, words: pa.Table) -> pa.Table:
    held, n, cls = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if words.num_rows:
        held, n, cls = _long(_joined(words.column("keys"), np.uint8)), _joined(words.column("n"), np.int64), _joined(words.column("cls"), np.uint8)
    counts, classes = [], []
    for x in asked.column("keys") if asked.num_rows else []:
        keys = _long(np.frombuffer(x.as_py(), np.uint8))
        at = np.minimum(np.searchsorted(held, keys), max(len(held) - 1, 0))
        known = held[at] == keys if len(held) else np.zeros(len(keys), bool)
        counts.append(_blob(np.where(known, n[at], 0) if len(held) else np.zeros(len(keys), np.int64)))
        classes.append(_blob(np.where(known, cls[at], _UNSEEN).astype(np.uint8) if len(held) else np.full(len(keys), _UNSEEN, np.uint8)))
    chunk, bucket = (asked.column(c) if asked.num_rows else pa.array([], k) for c, k in (("chunk", _L), ("bucket", _I)))
    return pa.table({"chunk": chunk, "bucket": bucket, "n": pa.array(counts, _B), "cls": pa.array(classes, _B)})


def _by_chunk(tokens: DataFrame, words: DataFrame, bits: int):
    """Each chunk with the counts and classes of its words."""
    asked = tokens.select("chunk", "keys").mapInArrow(_asked(bits), "bucket int, chunk long, keys binary")
    answers = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_answered, "chunk long, bucket int, n binary, cls binary")
    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk"))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigrams of a task's chunks."""
    total = np.zeros(_WIDTH * _WIDTH, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_py(), np.int64)
    yield _batch([(TaskContext.get().partitionId(), 0, _blob(total))], {"task": _I, "unit": _I, "n": _B})


def _class_bigrams(blobs: DataFrame) -> np.ndarray:
    got = _summed_rows(blobs.mapInArrow(_tables, "task int, unit int, n binary"))
    return got.get(0, np.zeros(_WIDTH * _WIDTH, np.int64)).reshape(_WIDTH, _WIDTH)


class Classes(NamedTuple):
    """What is learnt: every training word with its count and class, by bucket of ``bits`` bits; ``tokens`` are the chunks."""

    tokens: DataFrame
    words: DataFrame
    masses: np.ndarray
    bits: int
    n_words: int
    n_tokens: int
    moved: list[int]
    scores: list[float]
    paths: list[str]


def learn_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS) -> Classes:
    """Chunks of tokens, and the class of every training word after at most ``rounds`` rounds (the first one lets the words join).

    A tenth of the training texts only count words and judge the rounds: one that makes them less probable is undone,
    and from then on half as many words may move. Words that occur in these texts alone are of the class of unseen words.
    """
    data = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    _, size = text_bytes(data, "text")
    wider = stretch(size)
    bits = max(8, math.ceil(math.log2(max(size / 6 / BUCKET_TOKENS / wider, 1))))
    spark = docs.sparkSession
    tokens, tokens_at = stored(spread(data).mapInArrow(_tokenised(int(chunk_bytes * wider)), Chunk.SCHEMA), "tokens")
    n_chunks = tokens.count()
    counts, counts_at = stored(_added(tokens.mapInArrow(_counted(bits), _COUNTS_SQL), n_chunks, _add_counts, _COUNTS_SQL), "counts")
    stats = counts.select("bucket", "keys", "n").mapInArrow(_totals(bits), "words long, n long, word long")
    n_words, n_tokens = stats.filter("word is null").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    best = stats.filter("word is not null").orderBy(F.desc("n"), "word").limit(HEAD).collect()
    drop(spark, [counts_at])
    head = np.sort(np.array([r["word"] for r in best], np.int64).view(np.uint64))
    square = np.zeros((len(head) + 2, len(head) + 2), np.int64)
    for unit, row in _summed_rows(tokens.mapInArrow(_head_neighbours(head), "task int, unit int, n binary")).items():
        square[unit] = row
    label = exchange(square, _WIDTH, fixed={len(head): OPEN, len(head) + 1: EDGE})
    member = np.eye(_WIDTH)[label]
    table = np.rint(member.T @ square @ member).astype(np.int64)
    near, near_at = stored(_added(tokens.mapInArrow(_first_near(bits, head, label[: len(head)]), _NEAR_SQL), n_chunks, _add_near, _NEAR_SQL), "near")
    best, history, share = None, [], 1.0
    for n in range(max(rounds, 1)):
        words, words_at = stored(near.groupBy("bucket").applyInArrow(_moved(table, share), _WORDS_SQL), "words")
        moved = words.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
        if n and not moved:
            drop(spark, [words_at])
            break
        if rounds <= 1:
            return _final(tokens, words, bits, n_words, n_tokens, [moved], [0.0], [tokens_at, words_at, near_at])
        held, held_at = stored(_by_chunk(tokens, words, bits).applyInArrow(_next_near(bits), _NEAR_SQL), "near")
        learnt, judged = (_class_bigrams(held.filter(F.col("bucket") == b).select("n")) for b in (-1, -2))
        score = judge(learnt, judged, class_masses(words), n_words, n_tokens)
        history.append((moved, score))
        if best is not None and score <= best.score:  # worse for texts it did not learn from: fewer words move
            drop(spark, [words_at, held_at])
            share /= 2
            continue
        drop(spark, [near_at, *([best.at] if best else [])])
        best, table = _Round(score, words, words_at), learnt
        near, near_at = stored(_added(held.filter("bucket >= 0"), n_chunks, _add_near, _NEAR_SQL), "near") if n + 1 < rounds else (None, held_at)
        if n + 1 < rounds:
            drop(spark, [held_at])
    return _final(tokens, best.words, bits, n_words, n_tokens, *map(list, zip(*history)), [tokens_at, best.at, near_at])


class _Round(NamedTuple):
    score: float
    words: DataFrame
    at: str


def _final(tokens: DataFrame, words: DataFrame, bits: int, n_words: int, n_tokens: int, moved: list[int], scores: list[float], paths: list[str]) -> Classes:
    masses = class_masses(words)
    unseen = class_of_unseen(masses)
    masses[unseen] += masses[OPEN]
    masses[OPEN] = 0
    return Classes(tokens, words.mapInArrow(_labelled(unseen), _WORDS_SQL), masses, bits, n_words, n_tokens, moved, scores, paths)


def class_masses(words: DataFrame) -> np.ndarray:
    """Tokens, words and words seen once of each class, as columns."""
    masses = np.zeros((_WIDTH, 3), np.int64)
    rows = words.select("n", "cls").mapInArrow(_masses, "cls int, n long, words long, once long")
    for r in rows.groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("n", "words", "once"))).collect():
        masses[r["cls"]] = r["n"], r["words"], r["once"]
    return masses


def class_of_unseen(masses: np.ndarray) -> int:
    """The class with the most words seen once."""
    return max(range(1, CLASSES), key=lambda k: (masses[k, 2], masses[k, 1], -k))


def judge(learnt: np.ndarray, judged: np.ndarray, masses: np.ndarray, n_words: int, n_tokens: int) -> float:
    """log10 probability of the texts that judge, but for what is the same with all classes; without such texts, of those that learn."""
    model, own = Model(learnt, masses, n_words, n_tokens), judged if judged.any() else learnt
    own = model.folded(own)
    return float((own * model.turn).sum() - (own.sum(0) * model.below)[EDGE + 1 :].sum())


def _sequences(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's texts as classes, with what does not depend on the model; its class bigrams."""
    c = next(chunks_of(chunk.to_batches()))
    n, cls = _served(c, answers)
    per = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[c.of])])[c.first])
    table = c.bigrams(np.where(cls == _UNSEEN, OPEN, cls)[c.of], EDGE, _WIDTH)
    blobs = (c.ids, c.held, c.counts, per(n > 0).round().astype(np.int32), per(np.log10(n + 0.1)), cls.astype(np.uint8)[c.of], table)
    return pa.Table.from_batches([_batch([tuple(map(_blob, blobs))], dict.fromkeys(_SEQUENCES, _B))])


_SEQUENCES = ("ids", "held", "counts", "known", "weight", "cls", "bigrams")


def _masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, tokens, words, words seen once) of each row of words."""
    for batch in batches:
        for blob, classes in zip(batch.column(0), batch.column(1)):
            n, cls = np.frombuffer(blob.as_py(), np.int64), np.frombuffer(classes.as_py(), np.uint8)
            sums = [np.bincount(cls, weights=w, minlength=_WIDTH).astype(np.int64).tolist() for w in (n, np.ones(len(n)), n == 1)]
            yield _batch([r for r in zip(range(_WIDTH), *sums) if r[2]], {"cls": _I, "n": _L, "words": _L, "once": _L})


class Model:
    """Class bigrams and what a word's smoothed count is divided by in its class."""

    def __init__(self, table: np.ndarray, masses: np.ndarray, n_words: int, n_tokens: int):
        """``masses``: tokens, words and words seen once of each class, as columns. Words without a class are of that of unseen words."""
        self.ends = int(table[:, EDGE].sum())
        self.total, self.kinds = n_tokens + self.ends, n_words + (self.ends > 0)
        self.unseen = class_of_unseen(masses)
        masses, table = masses.copy(), self.folded(table)
        masses[self.unseen] += masses[OPEN]
        masses[OPEN] = 0
        words = masses[:, 1] + (np.arange(_WIDTH) == self.unseen)
        used = (words > 0) | (np.arange(_WIDTH) == EDGE)
        t = table * used
        self.turn = np.log10(t + 0.5) - np.log10(t.sum(1, keepdims=True) + 0.5 * used.sum())
        self.below = np.log10(np.maximum(masses[:, 0] + 0.1 * words, 1e-9))
        self.floor = math.log10(self.total + 0.1 * (self.kinds + 1))

    def folded(self, table: np.ndarray) -> np.ndarray:
        """Bigrams of words without a class are those of the class of unseen words."""
        table = table.copy()
        table[self.unseen] += table[OPEN]
        table[:, self.unseen] += table[:, OPEN]
        table[OPEN] = table[:, OPEN] = 0
        return table

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ids, held, counts, known, weight, cls = (np.frombuffer(x, k) for x, k in zip(row, (np.int64, bool, np.int32, np.int32, float, np.uint8)))
                cls = np.where(cls == _UNSEEN, self.unseen, cls).astype(np.int64)
                first, some = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), counts > 0
                before, last = np.concatenate([[EDGE], cls[:-1]]) if len(cls) else cls, np.full(len(counts), EDGE)
                before[first[:-1][some]] = EDGE
                last[some] = cls[first[1:][some] - 1]
                steps = np.concatenate([[0.0], np.cumsum(self.turn[before, cls] - self.below[cls])])
                n = counts.astype(np.int64) + 1
                plain = weight - self.floor * counts + math.log10(self.ends + 0.1) - self.floor
                cols = (ids, held, n, known.astype(np.int64) + (self.ends > 0), np.full(len(n), self.total, np.int64), plain, np.diff(steps[first]) + weight + self.turn[last, EDGE])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. The model learns from the documents
    whose id, as text, has a crc32 that 10 does not divide. base_score is the smoothed unigram log10 probability,
    score that of the class bigrams. Null and empty texts are the end alone; repeated rows count each time; null ids
    learn and come back null. Without any training document all counts are 0. Other columns are not read. Words are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    with scratch(spark):
        learnt = learn_classes(docs, id_col, text_col, chunk_bytes, rounds)
        schema = ", ".join(f"{c} binary" for c in _SEQUENCES)
        sequences = written(_by_chunk(learnt.tokens, learnt.words, learnt.bits).applyInArrow(_sequences, schema), "sequences", hold=True)
    model = Model(_class_bigrams(sequences.select("bigrams")), learnt.masses, learnt.n_words, learnt.n_tokens)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = sequences.drop("bigrams").mapInArrow(lambda batches: model(batches), out)
    return scored.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
