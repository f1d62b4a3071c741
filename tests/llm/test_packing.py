import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing


def unroll(plan, counts):
    bins = {}
    for size, runs in plan.slots.items():
        assert plan.used[size] == counts[size]
        ends = [r[0] for r in runs[1:]] + [counts[size]]
        for (first, b, place), end in zip(runs, ends):
            for k in range(end - first):
                bins.setdefault(b + k, []).append((place, size))
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=0, max_size=80))
def test_plans_are_gapless_and_complete(sizes):
    counts = Counter(sizes)
    plan = packing.Plan(dict(counts), 24)
    bins = unroll(plan, counts)
    assert sorted(bins) == list(range(plan.bins))
    for rows in bins.values():
        at = 0
        for place, size in sorted(rows):
            assert place == at
            at += size
        assert at <= 24


def least_bins(sizes, cap):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[i]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_the_reduction_never_costs_a_bin(seed):
    rng = random.Random(seed)
    cap, sizes = 20, sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
    plan = packing.Plan(dict(Counter(sizes)), cap)
    fixed = [s for b, rows in unroll(plan, Counter(sizes)).items() if b < plan.fixed for _, s in rows]
    rest = sorted((Counter(sizes) - Counter(fixed)).elements(), reverse=True)
    assert plan.fixed + least_bins(rest, cap) == least_bins(sizes, cap)


def test_near_the_lower_bound():
    rng = random.Random(1)
    counts = Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 300)]) for _ in range(20_000))
    plan = packing.Plan(dict(counts), 1024)
    assert plan.bins <= 1.01 * -(-sum(s * n for s, n in counts.items()) // 1024)


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers_library():
    rng = random.Random(2)
    pool = "ab C'll 12 ½ ß éÉ ñ 日本 😀 \t\n\r     ___ !?.. ́ ﷽ <|endoftext|> \x00\x7f".split(" ") + [" ", "  ", "\n\n"]
    texts = ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "word  <|endoftext|>  \n"]
    got = [[*packing.token_ids("byte_bpe_50k", t), 2] for t in texts]
    assert got == reference_ids(texts) and got[-5] == [64, 220, 50256, 275, 2]


def test_pieces_and_sequences(table):
    rows = [(i, "word é 12 " * n) for i, n in enumerate([0, 1, 2, 3, 7, 50, 60, 400, 3000])] + [(49, "a<|endoftext|>b"), (50, None), (50, "twice"), (50, "twice"), (None, "no id")]
    got = packing.pack(table(rows), capacity=64).collect()
    want = []
    for (d, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        ids = np.array(ids, "<u4")
        starts = [0, *range(len(ids) % 64 or 64, len(ids), 64)]
        want += [(d, p, s, e - s, zlib.crc32(ids[s:e].tobytes())) for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by) == list(range(len(by)))


def test_empty_table(table):
    assert packing.pack(table([])).count() == 0
