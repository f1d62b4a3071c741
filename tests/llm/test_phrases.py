"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, best):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n, found = total[lang], []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((p, a, f[p[:k]], f[p[k:]], score))
        inside = defaultdict(int)
        for p, a, *_ in found:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        left = [(-s, -a, " ".join(p).encode(), a, x, y, s) for p, a, x, y, s in found if 100 * inside[p] < 100 * a]
        for rank, (_, _, p, a, x, y, s) in enumerate(sorted(left)[:best], 1):
            out.append((lang, rank, p.decode(), a, x, y, n, s))
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    return df.selectExpr("text", "lang", "7 as phrase", "8 as a", "9 as chunk", "'x' as key", "1 as n", "2 as rank", "3 as doc_id")


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ß", "x-y", "a", "a", "A", "zz", "\x0b", "q r"]
    mark = [" ", " ", "  ", "\t", ", ", ".", "\n", " ; "]
    rows = [("".join(rng.choice(words) + rng.choice(mark) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("...", "xx"), ("new york city " * 3000, "de"), ("a " * 5000, "fr")] + [("one two three four five six seven", "en")] * 30


@pytest.mark.parametrize("least, longest, best, hot, chunk", [(5, 5, 2000, 1 << 19, 1 << 20), (20, 5, 7, 30, 600), (2, 3, 2000, 10, 2000), (3, 2, 10, 1 << 19, 5000)])
def test_equals_a_plain_count(spark, least, longest, best, hot, chunk):
    rows = corpus(least)
    got = phrases.collocations(table(spark, rows), least=least, longest=longest, best=best, hot=hot, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, longest, best)


def test_without_broadcasts_and_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    rows = [(f"w{i} v{i}", "en") for i in range(40)] * 3
    got = phrases.collocations(table(spark, rows), least=3, best=11).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 5, 11) and len(got) == 11


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    words = spark.createDataFrame([(b"A" * 8, big, 1), (b"B" * 8, big, 1)], "phrase binary, a long, lang_key long")
    pairs = spark.createDataFrame([(b"A" * 8 + b"B" * 8, big - 1)], "phrase binary, a long")
    chunks = spark.createDataFrame([([1], ["en"], [4 * big])], "lang_keys array<long>, langs array<string>, tokens array<long>")
    r = phrases.weakest_cut(phrases.Mined(chunks, words, pairs)).first()
    assert r.score == 1000 * (big - 1) * 4 * big // big**2 and (r.l, r.r, r.n, r.lang) == (big, big, 4 * big, "en")


def test_every_occurrence_has_one_owner():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 40))
        rank = rng.integers(-1, 5, size)
        piece = np.cumsum(rng.random(size) < 0.2)
        joined = np.append((piece[1:] == piece[:-1]) & (rank[1:] >= 0) & (rank[:-1] >= 0), False)
        before, after = phrases.around_pivots(rank, joined, 4)
        for i in range(size):
            for m in range(2, 6):
                j = i + m
                own = j <= size and len(set(piece[i:j])) == 1 and (rank[i:j] >= 0).all()
                owners = [p for p in range(i, min(j, size)) if before[p] >= p - i and after[p] >= j - 1 - p] if j <= size else []
                assert len(owners) == int(own) and (not own or rank[owners[0]] == rank[i:j].max())


def test_empty_and_without_languages(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(None, None)])).count() == 0
    r = phrases.collocations(spark.createDataFrame([("a b",)] * 4, "text string"), least=4).collect()
    assert [tuple(x) for x in r] == [("und", 1, "a b", 4, 4, 4, 8, 2000)]
