import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, language, licenses, token_counts


def unigram():
    import sentencepiece  # noqa: F401
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, held = token_counts.read_vocabulary("piece_bpe_32k.model")
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in sorted(held)), *pieces], 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizers_library(table):
    rng = random.Random(1)
    pool = ["the", "Haus", "niño", "  ", "\n", "日本語", "😀", "aaaaaaaaaaaa", "x▁y", "1234", "é", "﷽", "...", "\x00", "unbelievable"]
    texts = ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", " ", "a" * 3000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    want = [(i, len(e.ids)) for (i, t), e in zip(rows, unigram().encode_batch([t or "" for _, t in rows], add_special_tokens=False))]
    assert sorted((tuple(r) for r in token_counts.count_tokens(table(rows)).collect()), key=str) == sorted(want, key=str)


def test_ties_and_unknown_runs():
    c = token_counts.Counter([("▁a", -1.0), ("b", -1.0), ("▁ab", -2.0), ("c", -1.0), ("bc", -2.0), ("▁abc", -9.0)], set())
    assert c["▁ab"] == 1  # equal scores: the piece that starts first stays
    assert c["▁abc"] == 2 and c["▁a??c"] == 3  # a run of unknown characters is one piece


def test_empty_tables(spark, table):
    assert token_counts.count_tokens(table([])).count() == 0
    assert licenses.scan_licenses(table([])).count() == 0
    assert language.identify(table([])).count() == 0
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": "the house with that thing shall wash".split(), "de": "das haus mit ein ding schön über".split(), "fr": "la maison avec chose être où ça".split(), "es": "la casa con cosa ñandú están qué".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(8, 40))), lang) for i in range(400) for lang in [rng.choice(sorted(words))]]
    rows += [(1000, None, "en"), (1001, "123 !? 456", "en"), (1002, "", None), (1003, "the house " * 20_000, None), (None, "das haus mit", "de"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lettered", F.lit(1))
    got = {r.doc_id: r for r in language.identify(df, sample=60).collect()}
    out = [(lang, got[i].lang_pred) for i, _, lang in rows[:400] if got[i].held_out]
    assert sum(a == b for a, b in out) > 0.97 * len(out) > 50
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    changed = df.withColumns({"doc_id": F.col("doc_id") + 0, "source": F.lit("s")})
    assert {r.doc_id: r.lang_pred for r in language.identify(changed, sample=60).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_one_language_and_none(spark):
    df = spark.createDataFrame([(i, "abc def", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df).collect()} == {"xx"}
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_license_places(table):
    mit = "Released under the MIT License"
    long = licenses.TEMPLATES["Apache-2.0 notice"].split()
    cut = " ".join(w for i, w in enumerate(long) if i % 12)
    rows = [(1, f"some words {mit}, and more. {mit.upper()}"), (2, f"x y z {cut} q"), (3, "this is under the same roof and the license of the work"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."), (None, mit)]
    got = sorted(((r.doc_id, r.license, r.start_word, r.end_word, round(r.coverage, 2)) for r in licenses.scan_licenses(table(rows)).collect()), key=str)
    kept = re.findall("[A-Za-z0-9]+", cut)
    assert [g for g in got if g[0] == 1] == [(1, "MIT", 2, 7, 1.0), (1, "MIT", 9, 14, 1.0)]
    two = [g for g in got if g[0] == 2]
    assert [g[1] for g in two] == ["Apache-2.0 notice"] and 0.88 < two[0][4] < 0.95 and two[0][2] == 3 and abs(two[0][3] - 3 - len(kept)) <= 2
    assert [g[:2] for g in got if g[0] == 6] == [(6, "CC-BY-NC-4.0")] * 2 and (None, "MIT", 0, 5, 1.0) in got and not [g for g in got if g[0] in (3, 4, 5)]


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        template = np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 9))], np.uint64)
        doc = np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 14))], np.uint64)
        band = rng.randint(1, 3)
        best = {}

        def go(i, j, m, s, e):
            best[0] = max(best.get(0, (0, 0, 0)), (m, s if m else 0, -e))
            for a in range(i, len(template)):
                for b in range(max(j, a), min(len(doc), a + 2 * band + 1)):
                    if doc[b] == template[a]:
                        go(a + 1, b + 1, m + 1, s if m else b, b + 1)

        go(0, 0, 0, 0, 0)
        got = licenses.align(doc, template, band)
        assert got[0] == best[0][0] and (not got[0] or template[0] == template[0])
        if got[0]:
            assert doc[got[1]] in template and doc[got[2] - 1] in template and got[2] - got[1] >= got[0]


def test_recall_of_edited_licenses(table):
    """Whole texts and notices with a tenth of their words lost, changed or doubled, amid other prose."""
    rng = random.Random(9)
    names = [n for n, t in sorted(licenses.TEMPLATES.items()) if len(t.split()) >= 20]
    rows, planted = [], []
    for k in range(6):
        for n in names:
            w = []
            for x in licenses.TEMPLATES[n].split():
                e = rng.random()
                w += [] if e < 0.03 else [f"other{rng.randint(0, 99)}"] if e < 0.06 else [x, x] if e < 0.08 else [x]
            prose = [f"prose{rng.randint(0, 500)}" for _ in range(rng.randint(0, 80))] + "in the use of this software and the license".split()
            rows.append((len(rows), " ".join(prose + w + prose)))
            planted.append(n)
    found = {}
    for r in licenses.scan_licenses(table(rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    caught = sum(n in found.get(i, ()) for i, n in enumerate(planted))
    assert caught >= 0.95 * len(planted)
    # a whole text is told from its near relatives
    assert {r.license for r in licenses.scan_licenses(table([(1, licenses.TEMPLATES["BSD-2-Clause text"])])).collect()} == {"BSD-2-Clause text"}
    assert {r.license for r in licenses.scan_licenses(table([(1, licenses.TEMPLATES["BSD-3-Clause text"])])).collect()} == {"BSD-3-Clause text"}


def test_a_stray_hit_does_not_split_a_place(table):
    text = licenses.TEMPLATES["MIT text"]
    rows = [(1, "permission is hereby granted free of charge " + "x y z " * 4 + text + " " + " ".join(text.split()[-12:])), (2, text + " " + text)]
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(table(rows)).collect()]
    assert sorted(got) == [(1, "MIT text"), (2, "MIT text"), (2, "MIT text")]


def test_templates_as_a_table(spark, table):
    own = spark.createDataFrame([("mine", "all of this is mine and mine alone"), ("none", None)], "name string, text string")
    got = licenses.scan_licenses(table([(1, "see: All of this is mine, and mine alone."), (2, "Released under the MIT License")]), templates=own).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(1, "mine", 1.0)]


def test_a_word_of_any_length_needs_little_memory():
    import tracemalloc

    c = token_counts.counter(token_counts.VOCABULARY)
    word = "▁" + "abcdefghij" * 30_000
    tracemalloc.start()
    n = c[word]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and n == sum(e for e in [len(unigram().encode(word.replace("▁", "")).ids)])


def test_many_short_texts_are_a_few_at_a_time():
    import pyarrow as pa

    parts = [(a, b, m.shape) for a, b, m in language.trigrams(pa.array(["ab c"] * 1000 + [None]))]
    assert parts[-1][1] == 1001 and max(s[0] for _, _, s in parts) <= language.TEXTS_AT_ONCE


def test_many_languages_and_repeated_rows(spark):
    rng = random.Random(4)
    words = {f"l{k}": [f"{chr(97 + k)}{a}{b}" for a in "aeiou" for b in "rstln"] for k in range(12)} | {"fr": ["la", "être", "où"], "es": ["ñandú", "están"], "it": ["della", "perché"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i in range(600) for lang in [rng.choice(sorted(words))]]
    rows += [(None, "la être où", "fr")] * 500
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=30).collect()}
    assert sum(got[i] == lang for i, _, lang in rows[:600]) > 570


@pytest.mark.parametrize("passive", [("system",), ()])
def test_perspectives(spark, passive):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "cy", None), (1, 4, None, "who"), (1, 2, "bob", "hello"), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1))
    got = chat.rotate_perspectives(df, passive=passive).collect()
    sides = {r.perspective for r in got if r.conv_id == 1}
    assert sides == {"ann", "bob", "cy"} | ({"system"} if not passive else set())
    ann = sorted((r.turn, r.role, r.name, r["content"], r.mask) for r in got if r.conv_id == 1 and r.perspective == "ann" and r.turn != 4)
    head = (0, "system", None, "<|system|>\nbe kind<|end|>\n", 0) if passive else (0, "user", "system", "<|user name=system|>\nbe kind<|end|>\n", 0)
    assert ann[:2] == [head, (1, "assistant", None, "<|assistant|>\nhi<|end|>\n", 1)]
    assert ann[2:4] == [(2, "user", "bob", "<|user name=bob|>\nhello<|end|>\n", 0)] * 2 and ann[4][4] == 0
    assert [(r.role, r.name, r.mask) for r in got if r.turn == 4 and r.perspective == "cy"] == [("user", None, 0)]
    assert [r.mask for r in got if r.turn == 3 and r.perspective == "cy"] == [0]  # an empty turn teaches nothing
    assert bool([r for r in got if r.conv_id == 2]) == (not passive) and not [r for r in got if r.conv_id is None]
