"""Fill-in-the-middle against a plain version that splits texts into lists of units."""

import hashlib
import random
import re

import pytest

from plumbline.llm import fim


def brute(ident, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= rate:
        return ident, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return ident, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return ident, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(1)
    out = [(None, None), (None, "a\nb\n"), (1, ""), (2, "\n\n\n"), (3, "no end"), (4, "<P>\nx"), (5, "<<S\n>M>\n<\n"), (6, "é🙂\r\n x\ny"), (7, "z\n"), (7, "z\n"), (8, "l\n" * 50_000), (9, "w" * 200_000)]
    return out + [(i, "".join(rng.choice(["a", "bc", "\n", "<", "S>", "é"]) for _ in range(rng.randint(1, 40)))) for i in range(10, 400)]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_equals_lists_of_units_and_comes_back(table, rate, spm):
    made = fim.fill_in_middle(table(rows()), rate=rate, spm_rate=spm)
    got = made.withColumn("back", fim.restored("output", "form")).withColumn("digest", fim.restored("output", "form", digest=True)).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted([brute(*r, rate, spm) for r in rows()], key=str)
    assert sorted((r.back for r in got)) == sorted(t or "" for _, t in rows())
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.digest == hashlib.sha256(r.back.encode()).hexdigest()
    assert rate < 100 or {r.form for r in got} >= {"plain", "spm" if spm else "psm"}


def test_other_units_and_marks(table):
    text = "one two  three "
    r = fim.fill_in_middle(table([(i, text) for i in range(50)]), unit=r"\S+\s*", marks=("[pre]", "[suf]", "{mid}")).withColumn("back", fim.restored("output", "form", ("[pre]", "[suf]", "{mid}"))).collect()
    assert all(x.n == 3 and x.back == text and x.form != "plain" for x in r) and len({x.output for x in r}) > 10


def test_marks_that_could_be_mistaken():
    for marks in [("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "d"), ("", "b", "c")]:
        with pytest.raises(ValueError):
            fim.check_marks(marks)


def test_empty_table_and_null_output(table, spark):
    assert fim.fill_in_middle(table([])).count() == 0
    r = spark.createDataFrame([(None, "psm"), ("x", "plain")], "output string, form string").select(fim.restored("output", "form").alias("t")).collect()
    assert [x.t for x in r] == [None, "x"]
