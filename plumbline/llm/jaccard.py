"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact at any threshold.

A document is the set of its distinct word shingles. Texts with equal sets fall
together at once (set id: 64 bits of two sums over the shingle hashes), so
copies cost one row each from there on.

Document frequencies come from the whole corpus: chunks of documents ask the
buckets of the hash space for their shingles and get one byte for each (exact
up to 127, then by powers of two). A set can link only if the required share t
of its shingles occurs elsewhere, and two sets can link only if they share one
of their rarest (1 - t) n + 1 shingles; the lists of those tie the remaining
sets into candidate groups. A common passage is never among the rarest
shingles of a longer text, so it ties nothing.

Search, in each candidate group on whole sets: every member is a query. Its short
inverted lists are merged (sorted runs, merged by a run-merging sort in place of
a heap) and counted, the longest are probed by binary search for those that can
still reach the required overlap, and the exact test decides. In groups of
over ``PIVOTS_FROM`` sets some pivots are compared with all members first, which
links large groups of near copies in a few passes; only members outside the
largest linked class are queries there. A group of over ``BLOCK`` sets first meets a few pivots in Spark; members that link to the best of
them are connected through it and need no search among themselves, so only the other members are queries,
dealt out as query blocks against member blocks. The work grows with the group, not with its square, unless
its members are really unlike each other.

Skipped are only pairs that are connected already. The buckets use shortened
hashes; a clash there raises a frequency for all its sets alike, which can add
candidates but never lose one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import attach, components
from plumbline.llm.textcore import NULL_ID, SPACED, Words, free_name, hashed_chunks, mix64, run_hashes, slices, spread, stretch, text_buffer
from plumbline.shared import scratch, written

SHINGLE = 5
CHUNK_BYTES = 4 << 20
BUCKET_SHINGLES = 1 << 20
KEY_BYTES = 5
#: A group of more sets than this, or a task of more shingles than that, is cut.
BLOCK, BLOCK_SHINGLES = 4096, 8 << 20
PIVOTS_FROM, PIVOTS = 256, 48
SPARK_PIVOTS = 4
LONG_LIST = 64


def shingle_sets(column, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, sorted distinct shingle hashes of each text) of every slice of a string column."""
    data, offsets = text_buffer(column)
    for a, b, part, off in slices(data, offsets):
        words = Words(part, off, SPACED, lower=True)
        at, h = words.windows(k)
        edge = np.searchsorted(at, words.first)
        sets = [np.unique(h[edge[d] : edge[d + 1]]) for d in range(b - a)]
        for size in range(1, k):
            short = np.flatnonzero(words.counts == size)
            if len(short):
                at, h = run_hashes(words.hash, words.first, size)
                for d, x in zip(short, h[np.searchsorted(at, words.first[short])]):
                    sets[d] = np.array([x], np.uint64)
        yield a, sets


def set_id(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    two = mix64(np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(mix64(two + s.sum(dtype=np.uint64)).view(np.int64)[0])


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid = [], []
            for _, sets in shingle_sets(batch.column(1), k):
                n += [len(s) for s in sets]
                sid += [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64())], names=["id", "n", "sid"])

    return run


def _distinct(column, k: int) -> dict[int, np.ndarray]:
    """Set ids and sets of a column, each once."""
    return {set_id(s): s for _, sets in shingle_sets(column, k) for s in sets if len(s)}


def _requests(k: int, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        sets = list(_distinct(rows.column("text"), k).values())
        keys, n = _short(np.concatenate(sets), bits) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        used, begin = np.unique((keys >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
        # big-endian order, so that the bytes kept are the ones after the bucket's bits
        packed = (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        out = [[p.tobytes() for p in np.split(x, begin[1:])] if len(used) else [] for x in (packed, np.minimum(n, 65535).astype(np.uint16))]
        chunk = np.full(len(used), rows.column("chunk")[0].as_py())
        return pa.table({"bucket": pa.array(used, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "keys": pa.array(out[0], pa.binary()), "n": pa.array(out[1], pa.binary())})

    return run


def _short(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes cut to the bits that travel, in order, and how often each is there."""
    return np.unique(hashes & np.uint64(~((1 << (64 - bits - 8 * KEY_BYTES)) - 1) & (1 << 64) - 1), return_counts=True)


def _frequency_code(n: np.ndarray) -> np.ndarray:
    """One byte that never falls as n grows: n up to 127, then 128 and more by powers of two."""
    return np.where(n < 128, n, 121 + np.log2(np.maximum(n, 1)).astype(np.int64)).astype(np.uint8)


def _answers(rows: pa.Table) -> pa.Table:
    blobs = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, KEY_BYTES) for x in rows.column("keys")]
    sizes = np.array([len(b) for b in blobs])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :KEY_BYTES] = np.concatenate(blobs)
    n = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rows.column("n")])
    _, which = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    code = _frequency_code(np.bincount(which, weights=n).astype(np.int64))[which]
    parts = np.split(code, np.cumsum(sizes)[:-1])
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "code": pa.array([p.tobytes() for p in parts], pa.binary())})


def _candidates(k: int, bits: int, num: int, den: int):
    """The sets of a chunk of which enough shingles occur elsewhere; shingles by frequency, the rarest first."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        code = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_py(), np.uint8) for x in answers.column("code"))])
        held = _distinct(rows.column("text"), k) if len(code) else {}
        sids, sizes, alone, blobs = [], [], [], []
        if held:
            flat = np.concatenate(list(held.values()))
            cut = flat & np.uint64(~((1 << (64 - bits - 8 * KEY_BYTES)) - 1) & (1 << 64) - 1)
            of = code[np.unique(cut, return_inverse=True)[1]]
            begin = 0
            for sid, s in held.items():
                mine = of[begin : begin + len(s)]
                begin += len(s)
                single = int((mine < 2).sum())
                if len(s) - single < _need(np.array([len(s)]), num, den)[0]:
                    continue
                sids.append(sid)
                sizes.append(len(s))
                alone.append(single)
                blobs.append(s[np.argsort(mine, kind="stable")].tobytes())  # s is sorted: by (frequency, hash)
        return pa.table({"sid": pa.array(sids, pa.int64()), "n": pa.array(sizes, pa.int64()), "alone": pa.array(alone, pa.int64()), "shingles": pa.array(blobs, pa.binary())})

    return run


def _rarest(num: int, den: int, buckets: int):
    """Postings of the shingles of each set's prefix, in one packed row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, alone = (batch.column(i).to_numpy() for i in range(3))
            if not len(sid):
                continue
            last = n - _need(n, num, den) + 1
            parts = [np.frombuffer(x.as_py(), np.uint64)[a:b] for x, a, b in zip(batch.column(3), alone, last)]
            flat, of = np.concatenate(parts), np.repeat(np.arange(len(sid)), [len(p) for p in parts])
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            flat, of = flat[order], of[order]
            used, begin = np.unique(bucket[order], return_index=True)
            cut = lambda x: pa.array([p.tobytes() for p in np.split(x, begin[1:])] if len(used) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), cut(flat), cut(sid[of]), cut(n[of])], names=["bucket", "keys", "sid", "n"])

    return run


def _ties(num: int, den: int):
    """Ties, as stars, of sets that share a prefix shingle and are of linkable size."""

    def run(rows: pa.Table) -> pa.Table:
        col = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows.column(name)])
        key, sid, n = col("keys", np.uint64), col("sid", np.int64), col("n", np.int64)
        order = np.lexsort((sid, n, key))
        key, sid, n = key[order], sid[order], n[order]
        # in a list by size, whoever lies between two of linkable size is of linkable size to both
        near = (key[1:] == key[:-1]) & (sid[1:] != sid[:-1]) & (n[:-1] >= _need(n[1:], num, den))
        at = np.flatnonzero(near)
        sids, which = np.unique(sid, return_inverse=True)
        root = _roots(len(sids), which[at], which[at + 1])
        member = np.flatnonzero(root != np.arange(len(sids)))
        return pa.table({"a": pa.array(sids[member]), "b": pa.array(sids[root[member]])})

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _need(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap with a set of ``size`` that any partner not larger can link by: ceil(t * size)."""
    return -(-(den * size) // (num - den))


class Linker:
    """Links between the sets of one group."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.size = np.array([len(s) for s in sets], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.n_tokens = flat.astype(np.int64), len(tokens)
        self.root = np.arange(len(sets))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def tie(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def tokens(self, i: int) -> np.ndarray:
        return self.flat[self.begin[i] : self.begin[i + 1]]

    def linked(self, i: int, overlap: np.ndarray, others: np.ndarray) -> np.ndarray:
        return self.num * overlap >= self.den * (self.size[i] + self.size[others])

    def run(self, among: np.ndarray | None = None) -> np.ndarray:
        """Smallest member of each set's class. With ``among``, pairs of which neither set is in it need not be found."""
        m = len(self.size)
        everyone, tried = np.arange(m), np.zeros(m, bool)
        waiting = np.ones(m, bool) if among is None else np.isin(everyone, among)
        mark = np.zeros(self.n_tokens, bool)
        for _ in range(PIVOTS if m > PIVOTS_FROM else 0):
            if not waiting.any():
                break
            left = np.flatnonzero(waiting)
            p = left[len(left) // 2]
            mark[self.tokens(p)] = True
            overlap = np.add.reduceat(mark[self.flat], self.begin[:-1]).astype(np.int64)
            mark[self.tokens(p)] = False
            found = np.flatnonzero(self.linked(p, overlap, everyone))
            for j in found:
                self.tie(p, j)
            waiting[found] = waiting[p] = False
            tried[p] = True
        label = self._finds(everyone)
        names, count = np.unique(label, return_counts=True)
        # without marked queries, whoever is outside the largest class looks for it, not the other way round
        queries = np.flatnonzero((label != names[count.argmax()]) & ~tried) if among is None else among[~tried[among]]
        if len(queries):
            self._search(queries)
        return self._finds(everyone)

    def _search(self, queries: np.ndarray) -> None:
        """T-occurrence search of each query among all sets: DivideSkip."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(self.flat, kind="stable")
        postings = owner[order]
        start = np.searchsorted(self.flat[order], np.arange(self.n_tokens + 1))
        length = np.diff(start)
        for q in queries:
            mine = self.tokens(q)
            need = int(_need(self.size[q : q + 1], self.num, self.den)[0])
            by_length = mine[np.argsort(length[mine], kind="stable")]
            n_long = min(need - 1, int((length[mine] > LONG_LIST).sum()))
            short, long = by_length[: len(mine) - n_long], by_length[len(mine) - n_long :]
            merged = np.sort(np.concatenate([postings[start[t] : start[t + 1]] for t in short]), kind="stable")
            edge = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
            ids, seen = merged[edge], np.diff(np.append(edge, len(merged)))
            # a partner larger than the query needs more, one smaller at least its own share
            least = -(-self.den * (self.size[q] + self.size[ids]) // self.num)
            ids_ok = (seen >= least - n_long) & (ids != q)
            ids, seen = ids[ids_ok], seen[ids_ok]
            ids, seen = self._apart(q, ids, seen)
            for t in long:
                if not len(ids):
                    break
                row = postings[start[t] : start[t + 1]]
                at = np.searchsorted(row, ids)
                seen = seen + ((at < len(row)) & (row[np.minimum(at, len(row) - 1)] == ids))
            for j in ids[self.linked(q, seen, ids)]:
                self.tie(q, j)

    def _finds(self, ids: np.ndarray) -> np.ndarray:
        """Class of each id."""
        at = self.root[ids]
        while (up := self.root[at]).tolist() != at.tolist():
            at = up
        return at

    def _apart(self, q: int, ids: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = self._finds(ids) != self.find(q)
        return ids[apart], seen[apart]


def _search_groups(num: int, den: int):
    """Links of each group in a task. With queries marked, a set is looked up only if it is one; else all are."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("grp", "ascending"), ("sid", "ascending"), ("query", "descending")])
        grp, sid, query = (rows.column(c).to_numpy() for c in ("grp", "sid", "query"))
        blobs = rows.column("shingles")
        edge = np.append(np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), len(grp))
        a, b = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            keep = lo + np.flatnonzero(np.append(True, sid[lo + 1 : hi] != sid[lo : hi - 1]))
            if len(keep) < 2:
                continue
            sets = [np.sort(np.frombuffer(blobs[int(i)].as_py(), np.uint64)) for i in keep]
            root = Linker(sets, num, den).run(None if query[keep].all() else np.flatnonzero(query[keep]))
            far = np.flatnonzero(root != np.arange(len(keep)))
            a.append(sid[keep[far]])
            b.append(sid[keep[root[far]]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    return run


def _meet_pivots(num: int, den: int):
    """Which members of a part of a large group link to each of its pivots."""

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        a, b, group = [], [], []
        sid, blobs = members.column("sid").to_numpy(), members.column("shingles")
        if len(sid) and pivots.num_rows:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in blobs]
            size = np.array([len(x) for x in sets], np.int64)
            flat, begin = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])[:-1]
            for p, blob in zip(pivots.column("sid").to_pylist(), pivots.column("shingles")):
                own = np.frombuffer(blob.as_py(), np.uint64)
                overlap = np.add.reduceat(np.isin(flat, own), begin).astype(np.int64)
                hit = np.flatnonzero(num * overlap >= den * (size + len(own)))
                a.append(sid[hit])
                b.append(np.full(len(hit), p))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        grp = members.column("grp")[0].as_py() if len(sid) else 0
        a, b = cat(a), cat(b)
        return pa.table({"grp": pa.array(np.full(len(a), grp), pa.int64()), "a": a, "b": b})

    return run


def _search_large(large: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect the large groups, from their members (grp, m, held, sid, shingles); held counts a group's shingles."""
    parts = F.greatest(F.ceil(F.col("m") / F.lit(BLOCK)), F.ceil(F.col("held") / F.lit(BLOCK_SHINGLES))).cast("int")
    part = F.pmod(F.xxhash64("sid"), parts).cast("int")
    large = large.withColumns({"parts": parts, "part": part})
    # the pivots: in each group the sets with the smallest names, which are as good as drawn
    names = large.groupBy("grp").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("sid", F.lit(1)), F.greatest(F.lit(1), F.col("m") / (8 * SPARK_PIVOTS)).cast("long")) == 0, F.col("sid")))), 1, SPARK_PIVOTS).alias("p"))
    pivots = large.join(names, "grp").filter(F.array_contains("p", F.col("sid"))).dropDuplicates(["grp", "sid"])
    pivots = written(pivots.select("grp", "parts", "sid", "shingles"), "pivot-sets")
    pivots = pivots.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sid", "shingles")
    met = large.groupBy("grp", "part").cogroup(pivots.groupBy("grp", "part")).applyInArrow(_meet_pivots(num, den), "grp long, a long, b long")
    met = written(met.distinct(), "pivots")
    best = met.groupBy("grp", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    easy = met.join(best, ["grp", "b"]).select("grp", F.col("a").alias("sid"), F.lit(True).alias("easy"))
    marked = large.join(easy, ["grp", "sid"], "left").withColumn("query", F.col("easy").isNull())
    # as many query blocks as there are blocks of members of the same size
    left = marked.filter("query").groupBy("grp").agg(F.least(F.max("parts"), F.ceil(F.max("parts") * F.count(F.lit(1)) / F.max("m"))).cast("int").alias("q"))
    marked = marked.join(left, "grp")  # a group without queries is connected already
    mine = F.pmod(F.xxhash64("sid"), F.col("q")).cast("int")
    name = lambda i, j: F.concat_ws("-", F.lit("b"), F.col("grp"), i, j)
    base = ["grp", "sid", "shingles"]
    member = marked.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda i: name(i, F.col("part")))).alias("task"), *base, F.lit(0).alias("query"))
    query = marked.filter("query").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: name(mine, j))).alias("task"), *base, F.lit(1).alias("query"))
    links = member.unionAll(query).groupBy("task").applyInArrow(_search_groups(num, den), "a long, b long")
    return links.unionAll(met.select("a", "b"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = 9, den: int = 4, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a document is the set of its distinct runs of ``shingle``
    words; one of fewer words is its whole sequence as one shingle. Two documents link when num * |x and y| >= den *
    (|x| + |y|): 9 and 4 are a Jaccard similarity of 0.8 or more, ties included. component_id is the smallest id
    that links reach, the document's own included. Null and empty texts have no shingle and link with nothing.
    Repeated rows are documents with equal sets. Null ids come back null and count as the smallest id. Other
    columns are not read.
    """
    with scratch(docs.sparkSession):
        data = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
        described = written(spread(data).mapInArrow(_describe(shingle), "id long, n long, sid long"), "sets")
        chunks, size = hashed_chunks(docs, id_col, text_col, chunk_bytes)
        rows, total = described.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        wider = stretch(size)
        bits = max(4, math.ceil(math.log2(max(total / BUCKET_SHINGLES / wider, 1))))
        requests = chunks.groupBy("chunk").applyInArrow(_requests(shingle, bits), "bucket int, chunk int, keys binary, n binary")
        answers = requests.groupBy("bucket").applyInArrow(_answers, "chunk int, bucket int, code binary")
        both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        sets = written(both.applyInArrow(_candidates(shingle, bits, num, den), "sid long, n long, alone long, shingles binary"), "candidates")
        left = sets.agg(F.sum("n")).first()[0] or 0
        rarest = sets.mapInArrow(_rarest(num, den, max(16, int(left / BUCKET_SHINGLES / wider))), "bucket int, keys binary, sid binary, n binary")
        ties = rarest.groupBy("bucket").applyInArrow(_ties(num, den), "a long, b long")
        groups = written(components(written(ties.distinct(), "ties")), "groups").withColumnRenamed("component", "grp")
        # one row per set, however many chunks hold a copy of it
        once = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
        members = written(once.join(groups.withColumnRenamed("node", "sid"), "sid"), "members")
        held = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("held"))
        n_members, n_held = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        bins = max(1, math.ceil(n_members / BLOCK), math.ceil(n_held / BLOCK_SHINGLES))
        is_large = (F.col("m") > BLOCK) | (F.col("held") > BLOCK_SHINGLES)
        large_groups = held.filter(is_large & (F.col("m") > 1))
        n_large = large_groups.count()  # at most n_members / 2, and each of them is large
        task = F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(bins)))
        small = members if not n_large else members.join(large_groups.select("grp"), "grp", "left_anti")
        links = small.select(task.alias("task"), "grp", "sid", "shingles", F.lit(1).alias("query")).groupBy("task").applyInArrow(_search_groups(num, den), "a long, b long")
        if n_large:
            large = attach(members, large_groups, "grp", n_members).filter("m is not null").select("grp", "m", "held", "sid", "shingles")
            links = links.unionAll(_search_large(written(large, "large"), num, den))
        classes = components(written(links.distinct(), "links"))
        label = attach(described, classes.withColumnRenamed("node", "sid"), "sid", rows).withColumn("class", F.coalesce("component", "sid"))
        label = written(label.select("id", "n", "class"), "classes", hold=True)
    first = label.filter("class is not null").groupBy("class").agg(F.min("id").alias("component_id"))
    out = attach(label, first, "class", rows).select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"))


#: Up to so many ids of dropped rows go to every executor (some 20 MB); beyond that the rows are joined by shuffle.
BROADCAST_IDS = 250_000


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a near duplicate with a smaller id; all their columns stay.

    Of rows that repeat an id and its text, one stays: the first by its columns as JSON. Rows without an id cannot be told apart by it: they
    all stay.
    """
    own = jaccard_components(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    per = written(own.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")).filter("c <> doc_id or n > 1"), "dropped")
    gone, again = per.filter("c <> doc_id"), per.filter("c = doc_id")
    n_gone, n_again = gone.count(), again.count()
    other, held = free_name(docs.columns, "doc_id_gone"), free_name(docs.columns, "row")
    key = F.col(f"`{id_col}`").cast("long") == F.col(other)
    small = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    kept = docs
    if n_gone:
        kept = kept.join(small(gone.select(F.col("doc_id").alias(other)), n_gone), key, "left_anti")
    if n_again:
        twice = small(again.select(F.col("doc_id").alias(other)), n_again)
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = kept.join(twice, key, "left_semi").groupBy(id_col, text_col).agg(F.min_by(row, F.to_json(row)).alias(held)).select(f"{held}.*")
        kept = kept.join(twice, key, "left_anti").unionByName(one)
    return kept
