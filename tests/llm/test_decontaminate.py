import hashlib
import random
import re

import pytest

from plumbline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, k):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(k, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    items |= found
                    hit |= set(range(p, p + n))
        items = sorted(items - {None})
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def case():
    rng = random.Random(3)
    vocab = ["Ab", "cd", "é1", "x", "y", "z9"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    bench = [(f"i{j}", text(rng.randint(0, 25))) for j in range(12)] + [("i3", "x, y; Z9 cd ab"), ("none", None), (None, "x y"), ("same", "x y z9"), ("same2", "x y z9")]
    docs = [(i, text(rng.randint(0, 50))) for i in range(80)] + [(900, None), (901, ""), (902, "..."), (903, bench[5][1] + " " + bench[5][1]), (903, bench[5][1]), (None, "x y z9")]
    return docs, bench


def run(found):
    return sorted(((r[0], *r[-5:-1]) for r in found.collect()), key=str)


def longest(docs, bench, k):
    """Per document the longest matches of the runs of places at which windows of one length match."""
    out = []
    for i, t in docs:
        w, rows = words(t), []
        items = [(j, words(x), min(k, len(words(x)))) for j, x in bench if words(x)]
        for n in {n for _, _, n in items}:
            own = [x for x in items if x[2] == n]
            at = [p for p in range(len(w) - n + 1) if any(w[p : p + n] == x[q : q + n] for _, x, _ in own for q in range(len(x) - n + 1))]
            runs = []
            for p in at:
                if runs and runs[-1][-1] == p - 1:
                    runs[-1].append(p)
                else:
                    runs.append([p])
            for r in runs:
                best = (0, 0)
                for p in r:
                    for _, x, _ in own:
                        for q in range(len(x) - n + 1):
                            size = 0
                            while p + size < r[-1] + n and q + size < len(x) and w[p + size] == x[q + size]:
                                size += 1
                            if size >= n and size > best[0]:
                                best = (size, p)
                rows.append((best[1], best[0]))
        out.append((i, sorted(rows)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, table, case):
    docs, bench = case
    b = spark.createDataFrame(bench, "item_id string, text string")
    found = decontaminate.find_contamination(table(docs), b, window=6)
    assert found.columns[-5:] == ["n_words_", "n_hit", "n_items", "items_sha256", "matches"]
    assert run(found) == brute(docs, bench, 6)
    assert sorted(((r.doc_id, [(m.doc_word, m.length) for m in r.matches]) for r in found.collect()), key=str) == longest(docs, bench, 6)


def test_blocks_of_the_benchmark_add_up(spark, table, case, monkeypatch):
    docs, bench = case
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 14)
    b = spark.createDataFrame(bench, "item_id string, text string")
    assert len(list(decontaminate.blocks(b, "item_id", "text", 6))) > 8
    assert run(decontaminate.find_contamination(table(docs), b, window=6)) == brute(docs, bench, 6)


def test_a_line_that_many_items_share(spark, table):
    rng = random.Random(8)
    line = " ".join(f"choose{i}" for i in range(15))
    bench = [(f"i{j}", f"{line} {rng.randint(0, 10**9)} {rng.randint(0, 10**9)}") for j in range(300)]
    docs = [(i, f"w{i} {line} v{i} {line}") for i in range(400)] + [(999, bench[7][1])]
    b = spark.createDataFrame(bench, "item_id string, text string")
    found = decontaminate.find_contamination(table(docs), b)
    assert run(found) == brute(docs, bench, 13)
    places = {r.doc_id: [(m.doc_word, m.length, m.item_word) for m in r.matches] for r in found.collect()}
    assert places[3] == [(1, 15, 0), (17, 15, 0)] and places[999] == [(0, 17, 0)]


def test_many_shared_places_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    from plumbline.llm.textcore import ALNUM, Words, text_buffer

    line = " ".join(f"choose{i}" for i in range(15))
    block = decontaminate.Block([(f"i{j}", f"{line} q{j} r{j}") for j in range(4000)], [0] * 4000, 13)
    data, offsets = text_buffer(pa.array([f"{line} {i}" for i in range(15_000)]))
    tracemalloc.start()
    w = Words(data, offsets, ALNUM, lower=True)
    hits = [c.search(w) for c in block.classes]
    assert len(hits[0][0]) == 3 * 15_000 and block.longest(0, hits[0][1][:3])[0] == 15 and len(block.items([hits[0][1][:3]])) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 1 << 20 and peak < 200 << 20


def test_longest_match_and_places(spark, table):
    b = spark.createDataFrame([("q", "a b c d e f g h")], "item_id string, text string")
    m = decontaminate.find_contamination(table([(1, "c d e zz b c d e f zz")]), b, window=3).first().matches
    assert [(x.item_id, x.length, x.doc_word, x.item_word) for x in m] == [("q", 3, 0, 2), ("q", 5, 4, 1)]


def test_only_contaminated_documents_go(spark, table):
    b = spark.createDataFrame([("q", "a b c d")], "item_id string, text string")
    rows = [(1, "a b c d"), (2, "a b c d " + "clean " * 100), (3, None), (4, "a b c")]
    kept = decontaminate.drop_contaminated(table(rows), b)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == table(rows).columns


def test_empty_tables(spark, table):
    none, empty = spark.createDataFrame([], "item_id string, text string"), hashlib.sha256(b"").hexdigest()
    assert run(decontaminate.find_contamination(table([(1, "a b")]), none)) == [(1, 2, 0, 0, empty)]
    assert run(decontaminate.find_contamination(table([]), none)) == []
