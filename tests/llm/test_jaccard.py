import random
import re

import numpy as np
import pytest

from plumbline.llm import graph, jaccard


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    low = lambda i: (-1 if i is None else i)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min(first[find(i)], key=low)) for i, (d, _) in enumerate(rows)), key=str)


def run(df):
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, chunk_bytes=4000).collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(20)]
    rows = []
    for _ in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randint(0, 8))]
        else:
            w = [word() for _ in range(rng.choice([1, 2, 4, 5, 7, 30, 60, 150]))]
            if rng.random() < 0.4:
                w = passage + w
        rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(table, seed):
    rows = corpus(seed)
    assert run(table(rows)) == brute(rows)


def test_blocks_of_large_groups(table, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rows = corpus(9, 50)
    assert run(table(rows)) == brute(rows)


def test_large_group_of_near_copies(table, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != spot else f"x{i}" for k, w in enumerate(base))) for i in range(70) for spot in [rng.randrange(120)]]
    far = list(base)
    for k in range(0, 120, 30):
        far[k] = "far"
    rows += [(100, " ".join(base[:100])), (101, " ".join(far)), (102, " ".join(far[:90])), (103, " ".join(base[30:] + ["tail"] * 3))]
    assert run(table(rows)) == brute(rows)


def test_edges_and_exact_threshold(table):
    base = [f"a{i}" for i in range(13)]  # 9 shingles
    near = base[:-1]  # 8 of 9 shingles: 0.89
    tie = [f"t{i}" for i in range(9)]  # 5 shingles; without the last word 4 of 5 are 0.8 exactly
    rows = [(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(tie)), (8, " ".join(tie[:-1])), (1, None), (2, ""), (3, "One two"), (4, "one  TWO"), (4, "one  TWO"), (9, " ".join(tie[:-2])), (None, "one two")]
    assert run(table(rows)) == brute(rows)
    assert run(table([])) == []


def test_long_text(table):
    long = [f"q{i}" for i in range(20_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:19_000])), (3, " ".join(long[:9_000]))]
    assert {r[0]: r[2] for r in run(table(rows))} == {1: 1, 2: 1, 3: 3}


def test_dense_groups_need_no_pairs():
    rng = np.random.default_rng(0)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(200, 6, False)), rng.integers(1000, 10**9, 6).astype(np.uint64)])) for _ in range(300)]
    sets += [np.unique(rng.integers(0, 10**6, 150).astype(np.uint64)) for _ in range(200)]
    root = jaccard.Linker(sets, 9, 4).run()
    for i in range(0, len(sets), 7):
        for j in range(0, len(sets), 11):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 9 * n >= 4 * (len(sets[i]) + len(sets[j])):
                assert root[i] == root[j]
    assert len(set(root[300:])) == 200


def test_keep_first_keeps_one_of_each(table):
    t = "one two three four five six seven"
    rows = [(1, t), (2, t.upper()), (3, "other words are here now"), (3, "other words are here now"), (4, None), (None, t), (None, None)]
    kept = jaccard.keep_first(table(rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id is not None) == [("1", t), ("3", rows[2][1]), ("4", None)]
    assert kept.filter("doc_id is null").count() == 2 and kept.columns == table(rows).columns


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1100)) and len(got) == 161
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
