"""Substring dedup: every window of words that also starts earlier is removed.

Rabin-Karp hashes of all windows are counted in Spark. Documents lie in chunks
that follow the order of the ids (textcore.ordered_chunks), so the order of
two occurrences in different chunks is the order of the chunks:

1. each chunk sends the distinct hashes of its windows, sorted, as one packed
   array per bucket of the hash space - 7 bytes a window, and a window that
   repeats inside a chunk (a hot passage, a group of copies) goes once;
2. each bucket answers every chunk with one bit per hash: held by an earlier
   chunk or not;
3. chunks meet their answers (the texts come from the exchange that step 1
   made) and merge the repeated windows into maximal intervals.

A bucket holds about ``BUCKET_WINDOWS`` hashes, and chunks and buckets grow
together beyond 32 GB (textcore.stretch), since the number of buckets follows
the bytes of text. Two different windows share a 64-bit hash with probability
near n**2 / 2**65 for n windows: under 0.001 for 10**8 windows, one pair for
6 * 10**9 (some 35 GB of text). Beyond that, windows that are unlike each other
may count as repeated, about n / 2**64 of the windows each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.textcore import NULL_ID, SPACED, Words, covered, intervals, ordered_chunks, slices, stretch, text_buffer

WINDOW = 20
CHUNK_BYTES = 4 << 20
BUCKET_WINDOWS = 1 << 20


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows of a chunk by id; rows that repeat an id by the hash of their text."""
    return rows.sort_by([("id", "ascending"), ("h", "ascending"), ("text", "ascending")]) if rows.num_rows > 1 else rows


def _window_hashes(column, window: int):
    """Per slice of texts: (first text, texts after the last, words, positions, hashes)."""
    data, offsets = text_buffer(column)
    for a, b, part, off in slices(data, offsets):
        words = Words(part, off, SPACED)
        yield a, b, words, *words.windows(window)


def _requests(bits: int, window: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        found = [np.unique(h) for *_, h in _window_hashes(rows.column("text"), window)]
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        packed = keys.view(np.uint8).reshape(-1, 8)[:, :7]
        used, begin = np.unique(bucket, return_index=True)
        parts = np.split(packed, begin[1:]) if len(used) else []
        return pa.table({"bucket": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), rows.column("chunk")[0].as_py()), pa.int32()), "keys": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _answers(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("chunk")
    blobs = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 7) for x in rows.column("keys")]
    sizes = np.array([len(b) for b in blobs])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :7] = np.concatenate(blobs)
    keys = wide.view(np.uint64).ravel()
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    flags = np.split(later, np.cumsum(sizes)[:-1])
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "n": pa.array(sizes, pa.int32()), "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def _remove(window: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        answers = answers.sort_by("bucket")
        earlier = [np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=n.as_py()).astype(bool) for f, n in zip(answers.column("flags"), answers.column("n"))]
        earlier = np.concatenate(earlier) if earlier else np.zeros(0, bool)
        held = list(_window_hashes(rows.column("text"), window))
        hashes = np.concatenate([h for *_, h in held]) if held else np.zeros(0, np.uint64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        gone = earlier[which] | (first[which] != np.arange(len(hashes))) if len(hashes) else np.zeros(0, bool)
        n_words, n_removed, spans, kept, done = [], [], [], [], 0
        for a, b, words, at, h in held:
            mask = covered(at[gone[done : done + len(h)]], window, len(words.start))
            done += len(h)
            removed = np.concatenate([[0], np.cumsum(mask)])
            n_words.append(words.counts)
            n_removed.append(removed[words.first[1:]] - removed[words.first[:-1]])
            for d in range(b - a):
                w0, w1 = words.first[d], words.first[d + 1]
                raw = words.data[words.offsets[d] : words.offsets[d + 1]]
                if not n_removed[-1][d]:
                    spans.append([])
                    kept.append(raw.tobytes())
                    continue
                runs = intervals(mask[w0:w1])
                spans.append([{"start": int(s), "end": int(e)} for s, e in runs])
                cut, start, size = [], words.start - words.offsets[d], w1 - w0
                where = 0
                for s, e in runs:
                    cut.append(raw[where : start[w0 + s]])
                    where = start[w0 + e] if e < size else len(raw)
                cut.append(raw[where:])
                kept.append(np.concatenate(cut).tobytes())
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"doc_id": rows.column("id"), "n_words": cat(n_words), "n_removed": cat(n_removed), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_text": texts, "carried": rows.column("rest")})

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed, kept_text; with ``carry``, a struct ``carried`` of those columns.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``window`` consecutive words that covers it occurs
    with an earlier start: in a row with a smaller id, or earlier in the same text; windows are judged on the
    input. ``removed`` lists the maximal intervals of removed words (start, end after the last), ``kept_text`` is the
    text without them and without the white space after each. Rows that repeat an id are ordered by a hash of their text,
    so the second of two equal rows loses its windows. Null texts have no words and an empty kept_text; a
    text shorter than a window stays whole. Null ids sort first and come back null. Columns that are not in ``carry`` are not read.
    """
    chunks, size = ordered_chunks(docs, id_col, text_col, chunk_bytes, carry)
    bits = max(8, math.ceil(math.log2(max(size / 6 / BUCKET_WINDOWS / stretch(size), 1))))
    requests = chunks.groupBy("chunk").applyInArrow(_requests(bits, window), "bucket int, chunk int, keys binary")
    answers = requests.groupBy("bucket").applyInArrow(_answers, "chunk int, bucket int, n int, flags binary")
    out = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")
    out = out.add("carried", chunks.schema["rest"].dataType)
    kept = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(window), out)
    own = [F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "removed", "kept_text"]
    return kept.select(*own, *(["carried"] if carry else []))
