import random
import re

from pyspark.sql import functions as F

from plumbline.llm import substring


def brute(rows, k):
    return brute_in(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), k)


def brute_in(rows, k):
    """Rows in the given order."""
    seen, out = set(), []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(df, k, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in substring.remove_repeats(df, window=k, **kw).collect()), key=str)


def test_equals_brute_force_over_many_chunks(table):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(6)]
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    assert run(table(rows), 4, chunk_bytes=500) == brute(rows, 4)


def test_more_chunks_than_quantiles(table, monkeypatch):
    from plumbline.llm import textcore

    monkeypatch.setattr(textcore, "MOST_RANGES", 3)
    rng = random.Random(6)
    rows = [(i * i - 50, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40)))) for i in range(90)] + [(None, "a b c d a b c d")]
    assert run(table(rows), 4, chunk_bytes=150) == brute(rows, 4)


def test_heavy_ids_are_cut_by_their_texts(table):
    rng = random.Random(7)
    rows = [(rng.choice([None, None, 5, i]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60)))) for i in range(300)]
    got = substring.remove_repeats(table(rows), window=4, chunk_bytes=600).collect()
    from plumbline.llm import textcore

    chunks, _ = textcore.ordered_chunks(table(rows * 30), "doc_id", "text", 5000)
    sizes = [r.b for r in chunks.groupBy("chunk").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert max(sizes) < 0.2 * sum(sizes)
    order = {r.text: (r.id if r.id is not None else 0, r.h) for r in chunks.collect()}
    want = brute_in([(i, t) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]][1], r[1]))], 4)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(r.kept_text.split())) for r in got), key=str) == want


def test_edges(table):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "too short"), (5, long), (6, long), (6, long), (None, "x y z x y z"), (7, "a b c a b c a b c")]
    assert run(table(rows), 3) == brute(rows, 3)


def test_empty_table(table):
    assert run(table([]), 3) == []


def test_spans_and_untouched_text(table):
    rows = [(1, "one two  three\nfour"), (2, "zero one two three  nine")]
    got = {r.doc_id: r for r in substring.remove_repeats(table(rows), window=3, carry=("lang",)).collect()}
    assert got[1].kept_text == rows[0][1] and got[1].removed == [] and got[1].carried.lang == "en"
    assert [(s.start, s.end) for s in got[2].removed] == [(1, 4)] and got[2].kept_text == "zero nine"
