import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            rep |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


GOOD = "The cat of the house and the dog sat in a garden. It was warm{0}, and the birds sang for an hour{0}. Then the rain came to the town and all went in.\nA{0} new line is here{0}."
JUNK = ["the*** cat### of&&& {0}*** and%%% the$$$ dog*** sat### in&&& a%%% row$$$ of*** ten### {0}%%%", "THE!! CAT!! OF!! THE!! {0}!! HOUSE!! AND!! THE!! DOG!! SAT!! IN!! A!! {0}!!"]


def test_counts_equal_brute_force(table):
    texts = [None, "", " \n\t", "a b c", "x y z\x0bw\fv\ru " * 9, "a b c d e f\na b c d e f\na b c d e f", "| <b> & |\n| <b> & |", "é😀 " * 12, "p q r s t u v w x y " + "k " * 30, GOOD, "w " + "long " * 3000] + ["same line\n" * 4]
    rows = list(enumerate(texts)) + [(3, "a b c"), (None, "a b c")]
    df, q = quality.judge(table(rows))
    assert q == "quality_"
    got = sorted(((r.doc_id, r[q].n_words, r[q].word_chars, r[q].n_symbols, r[q].n_dup_lines, r[q].n_repeat_words, r[q].base_failed) for r in df.collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_votes_separate_junk_and_copies_of_good_text_stay(spark, table):
    rows = [(i, GOOD.format(f" {i}x")) for i in range(60)] + [(100 + i, JUNK[i % 2].format(f"w{i}")) for i in range(12)] + [(200, None), (201, "few words"), (202, "no " * 200)]
    kept = sorted(r.doc_id for r in quality.keep_good(table(rows)).collect())
    assert kept == list(range(60))
    assert quality.keep_good(table(rows)).columns == table(rows).columns


def test_expectation_maximisation_recovers_accuracies(spark):
    import random

    rng, rows = random.Random(0), Counter()
    for _ in range(4000):
        y = rng.random() < 0.7
        code = 0
        for j, acc in enumerate((0.95, 0.9, 0.8, 0.7)):
            if rng.random() < 0.85:
                code += (1 if (rng.random() < acc) == y else 2) * 3**j
        rows[code] += 1
    prior, rates = quality.estimate(spark.createDataFrame([(k, float(n)) for k, n in rows.items()], "pattern int, n double"), 4)
    assert abs(prior - 0.7) < 0.05
    for (bad_ok, good_ok), acc in zip([(r[2][0] / (r[1][0] + r[2][0]), r[1][1] / (r[1][1] + r[2][1])) for r in rates], (0.95, 0.9, 0.8, 0.7)):
        assert abs(bad_ok - acc) < 0.08 and abs(good_ok - acc) < 0.08


def test_empty_table(table):
    df, _ = quality.judge(table([]))
    assert df.count() == 0


def test_no_python_in_the_plan(table):
    df, _ = quality.judge(table([(1, GOOD)]).select("doc_id", "text"), keep_text=False)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and F is not None


#: Counts of the 27 vote patterns of three weak rules. One pattern is at 0.503 after steps that stop at 1e-4 and at 0.4987 in the end.
NEAR_CUT = [5, 8, 4, 14, 16, 6, 6, 5, 9, 7, 19, 7, 36, 70, 10, 14, 26, 14, 9, 6, 16, 11, 9, 23, 8, 12, 31]


def settled(n, rules, tolerance):
    """The posteriors by the same steps in numpy."""
    votes = np.stack([np.arange(3**rules) // 3**j % 3 for j in range(rules)], 1)
    good, bad = (votes == 1).sum(1), (votes == 2).sum(1)
    r, was = (good + 0.5) / (good + bad + 1), np.inf
    while True:
        on = np.stack([n * (1 - r), n * r])
        total = on.sum(1)
        prior = (total[1] + 1) / (total.sum() + 2)
        rates = np.array([[[(x * (votes[:, j] == v)).sum() + 1 for x in on] for v in range(3)] for j in range(rules)]) / (total + 3)
        now = np.append(rates.ravel(), prior)
        if np.abs(now - was).max() < tolerance:
            return r
        was = now
        r = 1 / (1 + np.exp(-np.log(prior / (1 - prior)) - np.log(rates[:, :, 1] / rates[:, :, 0])[np.arange(rules), votes].sum(1)))


def test_kept_does_not_change_at_a_tighter_tolerance(spark):
    patterns = spark.createDataFrame([(k, float(n)) for k, n in enumerate(NEAR_CUT)], "pattern int, n double").coalesce(1).cache()
    prior, rates = quality.estimate(patterns, 3)
    kept = {r.pattern for r in patterns.filter(quality._posterior(F.col("pattern"), prior, rates) >= 0.5).collect()}
    assert kept == set(np.flatnonzero(settled(np.array(NEAR_CUT, float), 3, 1e-10) >= 0.5).tolist())


def test_posterior_and_kept_equal_numpy(table):
    rows = [(i, GOOD.format(f" {i}x")) for i in range(40)] + [(100 + i, JUNK[i % 2].format(f"w{i}")) for i in range(9)] + [(200, "few words"), (201, "no " * 200), (202, "1 2 3 4 5 6 7 8 9 10 11 12")]
    df, q = quality.judge(table(rows))
    got = [r[q] for r in df.collect()]
    n = np.bincount([r.pattern for r in got if r.n_words >= 10], minlength=3**11).astype(float)
    used = np.flatnonzero(n)
    want = settled_on(used, n[used], 11, 1e-10)
    for r in got:
        if r.n_words >= 10:
            assert abs(r.posterior - want[r.pattern]) < 1e-4
            assert r.kept == (not r.base_failed and want[r.pattern] >= 0.5)


def settled_on(patterns, n, rules, tolerance):
    """As ``settled``, for the patterns that occur."""
    votes = np.stack([patterns // 3**j % 3 for j in range(rules)], 1)
    good, bad = (votes == 1).sum(1), (votes == 2).sum(1)
    r, was = (good + 0.5) / (good + bad + 1), np.inf
    while True:
        on = np.stack([n * (1 - r), n * r])
        total = on.sum(1)
        prior = (total[1] + 1) / (total.sum() + 2)
        rates = np.array([[[(x * (votes[:, j] == v)).sum() + 1 for x in on] for v in range(3)] for j in range(rules)]) / (total + 3)
        now = np.append(rates.ravel(), prior)
        if np.abs(now - was).max() < tolerance:
            return dict(zip(patterns.tolist(), r))
        was = now
        r = 1 / (1 + np.exp(-np.log(prior / (1 - prior)) - np.log(rates[:, :, 1] / rates[:, :, 0])[np.arange(rules), votes].sum(1)))


def test_other_scripts_get_no_votes_about_words(table):
    cjk = "\u4f60\u597d\u4e16\u754c\u3002" * 30
    df, q = quality.judge(table([(1, " ".join([cjk] * 40)), (2, GOOD), (3, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 20)]))
    names = [n for n, _, _ in quality.rules(q)]
    for r in df.collect():
        votes = {n: r[q].pattern // 3**j % 3 for j, n in enumerate(names)}
        if r.doc_id != 2:
            assert votes["sentences"] == votes["word length"] == votes["function words"] == 0
        else:
            assert votes["function words"] == 1


def test_steps_that_do_not_settle_are_reported(spark, monkeypatch):
    patterns = spark.createDataFrame([(k, float(n)) for k, n in enumerate(NEAR_CUT)], "pattern int, n double")
    monkeypatch.setattr(quality, "STEPS", 3)
    with pytest.warns(RuntimeWarning, match="after 3 steps"):
        quality.estimate(patterns, 3)
