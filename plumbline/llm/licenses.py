"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are words (A-Z lower-cased, letters and digits). Winnowing
keeps the least hash of every ``WINNOW`` consecutive shingles of ``SHINGLE``
words, so any common run of SHINGLE + WINNOW - 1 words shares a fingerprint.
The templates' fingerprints are an inverted index of fixed size that goes to
the executors; documents are scanned where they are, without a shuffle. Hits
of a template whose diagonals lie within ``BAND`` words (a third of a short
template) form a candidate place, the place with the most hits first, and an
alignment within that band decides how much of the template is there.

``license_texts.TEMPLATES`` is the default set: whole texts of 0BSD, BSD-2,
BSD-3, BSL-1.0, ISC, MIT, Unlicense and Zlib, the notices of AGPL-3.0,
Apache-2.0, CC0, the CC-BY family, EPL-2.0, GPL-2.0 and 3.0, LGPL-2.1 and 3.0 and
MPL-2.0, and one-line forms. The whole texts of the long licenses are not
in it; give them, or any others, as a table (name, text).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.license_texts import TEMPLATES
from plumbline.llm.textcore import ALNUM, Words, slices, spread, text_buffer

SHINGLE, WINNOW, BAND = 2, 3, 24
#: Templates may have so many bytes in all; their index goes to every executor.
MOST_TEMPLATE_BYTES = 4 << 20
LEAST_SHARE, LEAST_COVERAGE = 0.3, 0.8

def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the fingerprints of some texts; a text of fewer windows keeps its least shingle."""
    at, h = words.windows(SHINGLE)
    edge = np.searchsorted(at, words.first)
    if not len(h):
        return at, h
    padded = np.concatenate([h, np.full(WINNOW, np.iinfo(np.uint64).max, np.uint64)])
    least = np.minimum.reduce([padded[k : k + len(h)] for k in range(WINNOW)])
    pick = np.zeros(len(h), bool)
    stop = np.repeat(edge[1:], np.diff(edge))
    whole = np.arange(len(h)) + WINNOW <= stop
    for k in range(WINNOW):
        hit = whole & (padded[k : k + len(h)] == least)
        pick[np.flatnonzero(hit) + k] = True
    for d in np.flatnonzero((np.diff(edge) > 0) & (np.diff(edge) < WINNOW)):
        pick[edge[d] + int(h[edge[d] : edge[d + 1]].argmin())] = True
    return at[pick], h[pick]


def align(doc: np.ndarray, template: np.ndarray, band: int) -> tuple[int, int, int]:
    """(matched words, first and last matched word + 1 in doc) of the longest common subsequence within a band.

    ``doc`` starts ``band`` words before the template's expected place. Of equal alignments the shortest span wins: first the
    latest start, then the earliest end.
    """
    n, width, far = len(doc), 2 * band + 1, 1 << 20
    padded = np.concatenate([doc, np.zeros(max(0, len(template) + width - n), doc.dtype)])
    inside = np.arange(len(padded)) < n
    best = np.full(width + 1, far, np.int64)  # per offset: matches, start and far - end in one number
    for i, word in enumerate(template):
        j = np.arange(i, i + width)
        hit = (padded[i : i + width] == word) & inside[i : i + width]
        m, s = best[:width] >> 42, (best[:width] >> 21) & (2 * far - 1)
        grown = ((m + 1) << 42) | (np.where(m > 0, s, j) << 21) | (far - (j + 1))
        row = np.maximum(best[1:], np.where(hit, grown, far))
        best[:width] = np.maximum.accumulate(row)
    top = int(best.max())
    return (top >> 42, (top >> 21) & (2 * far - 1), far - (top & (2 * far - 1))) if top >> 42 else (0, 0, 0)


class Index:
    """Templates as words, and the inverted index from fingerprints to their places."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        data, offsets = text_buffer(pa.array([templates[n] for n in self.names], pa.string()))
        words = Words(data, offsets, ALNUM, lower=True)
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        at, h = winnow(words)
        order = np.argsort(h, kind="stable")
        self.keys, begin = np.unique(h[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.template = words.doc_of(at)[order]
        self.place = (at - words.first[words.doc_of(at)])[order]
        self.prints = np.bincount(words.doc_of(at), minlength=len(self.names))

    def scan(self, words: Words, least: float) -> list[tuple[int, int, int, int, int]]:
        """(text, template, matched words, first word, word after the last) of every place with enough coverage."""
        at, h = winnow(words)
        if not len(at) or not len(self.keys):
            return []
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at, i = at[self.keys[i] == h], i[self.keys[i] == h]
        size = self.begin[i + 1] - self.begin[i]
        hit = np.repeat(at, size)
        which = np.repeat(self.begin[i], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc, template, diagonal = words.doc_of(hit), self.template[which], hit - self.place[which]
        order = np.lexsort((diagonal, template, doc))
        doc, template, diagonal = doc[order], template[order], diagonal[order]
        out = []
        edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(template, prepend=-1)), len(doc))
        for i, j in zip(edges[:-1], edges[1:]):
            t, w0, w1 = int(template[i]), words.first[doc[i]], words.first[doc[i] + 1]
            size, band, need = len(self.words[t]), min(BAND, max(1, len(self.words[t]) // 3)), math.ceil(LEAST_SHARE * self.prints[t])
            left = diagonal[i:j]
            while len(left) >= need:
                stop = np.searchsorted(left, left + band, side="right")
                at = int((stop - np.arange(len(left))).argmax())
                if stop[at] - at < need:
                    break
                lead = int(np.median(left[at : stop[at]])) - band
                left = np.concatenate([left[:at], left[stop[at] :]])
                lo, hi = max(lead, w0), min(lead + size + 2 * band, w1)
                if hi <= lo:
                    continue
                part = np.concatenate([np.zeros(lo - lead, np.uint64), words.hash[lo:hi]])
                m, s, e = align(part, self.words[t], band)
                if m and m >= least * size:
                    out.append((int(doc[i]), t, m, int(lead + s - w0), int(lead + e - w0)))
        share = lambda r: r[2] / len(self.words[r[1]])
        by_doc: dict[int, list] = {}
        for r in set(out):
            by_doc.setdefault(r[0], []).append(r)
        beaten = lambda r, o: o[3] < r[4] and r[3] < o[4] and share(o) > share(r) and o[2] >= r[2]
        out = [r for own in by_doc.values() for r in own if not any(beaten(r, o) for o in own)]
        return sorted(out, key=lambda r: (r[0], self.names[r[1]], r[3], r[4]))


def _given(templates: dict[str, str] | DataFrame | None) -> dict[str, str]:
    if templates is None:
        return TEMPLATES
    if isinstance(templates, dict):
        return templates
    rows = templates.select(F.col("name").cast("string"), F.col("text").cast("string")).dropna()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {MOST_TEMPLATE_BYTES} go to every executor")
    return {r["name"]: r["text"] for r in rows.collect()}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None, least_coverage: float = LEAST_COVERAGE
) -> DataFrame:
    """One row per place: doc_id, license, matched_words, coverage, start_word, end_word, span_text.

    coverage is the share of the template's words that the alignment matches; places below ``least_coverage`` are left
    out. The span counts words of the document (end after the last); ``span_text`` is its text. Every place in a text
    is reported, also of templates that contain each other, but for one that overlaps a place of higher coverage
    and no fewer matched words. Null and empty texts have none. Repeated rows
    are scanned each; null ids come back null. Templates without words match nothing. Other columns are not read.

    ``templates`` are names and texts, as a dict or a table (name, text) of at most MOST_TEMPLATE_BYTES in all.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(_given(templates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            data, offsets = text_buffer(batch.column(1))
            for a, _, part, off in slices(data, offsets):
                words = Words(part, off, ALNUM, lower=True)
                for d, t, m, s, e in ix.scan(words, least_coverage):
                    w0 = words.first[d]
                    text = part[words.start[w0 + s] : words.end[w0 + e - 1]].tobytes().decode()
                    rows.append((ids[a + d], ix.names[t], m, m / len(ix.words[t]), s, e, text))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            names = ["doc_id", "license", "matched_words", "coverage", "start_word", "end_word", "span_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    data = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return spread(data).mapInArrow(run, "doc_id long, license string, matched_words int, coverage double, start_word int, end_word int, span_text string")
