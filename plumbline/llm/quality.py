"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at a text and votes good or bad, or abstains. A document's
votes are one small number, so all documents reduce to at most 3**rules
counted patterns. On those, expectation-maximisation estimates how often each
rule votes what on good and on bad documents: every step is one aggregate over
the pattern table, and only the sums of votes reach the driver. The posterior
probability of being good decides, not a conjunction of thresholds.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textcore import free_name, spread
from plumbline.shared import written

GOOD, BAD = 1, 2
STEPS, SETTLED, SMOOTH = 1000, 1e-7, 1.0
_SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on are as with be by this "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par au "
    "el los se las por con una su para como del y no al lo"
).split()


def _count(text: Column, chars: str) -> Column:
    """Characters of a class in a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def _features(docs: DataFrame, text_col: str, keep_text: bool) -> tuple[DataFrame, str]:
    """The documents with one struct of counts. Columns that are used more than once are made in a step of their own."""
    given = [c for c in docs.columns if keep_text or c != text_col]
    taken = list(docs.columns)
    t, w, h, s, p, q = (free_name(taken, x) for x in ("_t", "_w", "_h", "_s", "_p", "quality"))
    keep = [F.col(f"`{c}`") for c in given]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = spread(docs).select(*keep, text.alias(t))
    df = df.select(*keep, t, F.filter(F.split(t, _SPACE), lambda x: x != "").alias(w))
    word = lambda i: F.get(w, i)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(word(i + j) for j in range(5))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _count(F.col(t), r"[#*$%&|<>]"),
        "n_pipes": _count(F.col(t), r"\|"),
        "n_shouts": _count(F.col(t), "!"),
        "n_upper": _count(F.col(t), "[A-ZÀ-ÖØ-Þ]"),
        "n_ends": (F.size(F.split(t, r"[.!?](?=[\x20\x09-\x0D]|$)")) - 1).cast("long"),
        "n_kinds": F.size(F.array_distinct(w)).cast("long"),
        "n_letters": (F.length(t) - F.length(F.regexp_replace(t, r"[\p{L}\p{N}]+", ""))).cast("long"),
        "n_foreign": _count(F.col(t), r"[\p{L}&&[^A-Za-z\u00C0-\u024F]]+"),
        "n_function": F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))).cast("long"),
    }
    df = df.select(*keep, F.when(F.size(w) > 5, runs).alias(h), lines.alias(s), F.struct(*(v.alias(k) for k, v in counts.items())).alias(q))
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeats = F.when(F.size(h) > F.size(F.array_distinct(h)), by_hash)
    lined = F.struct(f"{q}.*", F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))
    df = df.select(*keep, repeats.alias(h), lined.alias(q))
    same = lambda x, i: F.coalesce(F.get(h, i)["h"] == x["h"], F.lit(False))
    twice = F.filter(h, lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.select(*keep, F.sort_array(F.transform(twice, lambda x: x["i"])).alias(p), q)
    gaps = F.transform(p, lambda x, i: F.least(F.lit(5), x - F.coalesce(F.get(p, i - 1), F.lit(-5))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return df.select(*keep, F.struct(f"{q}.*", covered.alias("n_repeat_words")).alias(q)), q


def rules(q: str) -> list[tuple[str, Column, Column]]:
    """(name, votes good, votes bad) of each rule over the counts in struct ``q``.

    Where most letters are not Latin, the rules that assume spaces between words and Western full stops abstain.
    """
    c = lambda name: F.col(f"{q}.{name}").cast("double")
    n = F.greatest(c("n_words"), F.lit(1.0))
    per = lambda name: c(name) / n
    per_char = lambda name: c(name) / F.greatest(c("word_chars"), F.lit(1.0))
    length, upper, ends, kinds = per("word_chars"), per_char("n_upper"), per("n_ends"), per("n_kinds")
    spaced = c("n_foreign") * 2 <= c("word_chars")  # most letters are Latin: the rules about words and sentences apply
    dup = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0))
    return [
        ("symbols", per("n_symbols") <= 0.05, per("n_symbols") > 0.2),
        ("capitals", upper < 0.2, upper > 0.5),
        ("shouting", per("n_shouts") < 0.1, per("n_shouts") > 0.3),
        ("cells", per("n_pipes") < 0.02, per("n_pipes") > 0.2),
        ("repeats", per("n_repeat_words") < 0.05, per("n_repeat_words") > 0.2),
        ("sentences", spaced & (ends >= 0.01) & (ends <= 0.3), spaced & ((ends > 0.5) | ((ends == 0) & (n >= 30)))),
        ("word length", spaced & (length >= 3) & (length <= 9), spaced & ((length > 14) | (length < 2))),
        ("lines", dup == 0, dup > 0.3),
        ("letters", per_char("n_letters") > 0.9, per_char("n_letters") < 0.82),
        ("function words", per("n_function") > 0.08, spaced & (n >= 30) & (per("n_function") < 0.03)),
        ("variety", (n >= 50) & (n <= 5000) & (kinds > 0.3), (n >= 50) & (n <= 5000) & (kinds < 0.1)),
    ]


def _vote(pattern: Column, rule: int) -> Column:
    return F.floor(pattern / F.lit(float(3**rule))) % 3


def _posterior(pattern: Column, prior: float, rates: list[list[list[float]]]) -> Column:
    """Probability of good, from rates[rule][vote] = (on bad, on good)."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, votes in enumerate(rates):
        a, g, b = (math.log(on_good / on_bad) for on_bad, on_good in votes)
        v = _vote(pattern, j)
        odds = odds + F.when(v == GOOD, F.lit(g)).when(v == BAD, F.lit(b)).otherwise(F.lit(a))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: DataFrame, n_rules: int) -> tuple[float, list[list[list[float]]]]:
    """(share of good documents, rates) by expectation-maximisation from a table (pattern, n).

    Starts from each pattern's share of good votes; every sum is smoothed by SMOOTH documents. Stops when no rate
    moves by SETTLED; STEPS steps without that are reported as a warning. A step joins its one row of weights, so that all
    steps run the same code, and reads the at most 3**n_rules patterns in one task, without a shuffle.
    """
    spark = patterns.sparkSession
    votes = F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: (F.floor(F.col("pattern") / F.pow(F.lit(3.0), j)) % 3).cast("int"))
    ballots = patterns.coalesce(1).select("n", votes.alias("v"))
    share = lambda x: F.size(F.filter("v", lambda v: v == x))
    start = (share(GOOD) + 0.5) / (share(GOOD) + share(BAD) + 1.0)
    odds = F.aggregate(F.transform("v", lambda v, j: F.get("w", 3 * j + v)), F.col("w0"), lambda a, x: a + x)
    seen = ballots.select("n", "v", start.alias("r"))
    was: list[float] = []
    for _ in range(STEPS):
        parts = seen.select("n", "r", F.posexplode("v").alias("rule", "vote")).groupBy("rule", "vote")
        sums = {(x["rule"], x["vote"]): (x["bad"], x["good"]) for x in parts.agg(F.sum(F.col("n") * (1 - F.col("r"))).alias("bad"), F.sum(F.col("n") * F.col("r")).alias("good")).collect()}
        total = [sum(sums.get((0, v), (0.0, 0.0))[y] for v in range(3)) for y in (0, 1)]
        prior = (total[1] + SMOOTH) / (total[1] + total[0] + 2 * SMOOTH)
        rates = [[[(sums.get((j, v), (0.0, 0.0))[y] + SMOOTH) / (total[y] + 3 * SMOOTH) for y in (0, 1)] for v in range(3)] for j in range(n_rules)]
        now = [prior, *(x for rule in rates for vote in rule for x in vote)]
        if was and max(abs(a - b) for a, b in zip(was, now)) < SETTLED:
            break
        was = now
        row = ", ".join(f"{math.log(v[1] / v[0])!r}D" for rule in rates for v in rule)
        weights = spark.sql(f"SELECT * FROM VALUES ({math.log(prior / (1 - prior))!r}D, array({row})) AS t(w0, w)")
        seen = ballots.join(F.broadcast(weights)).select("n", "v", (1.0 / (1.0 + F.exp(-odds))).alias("r"))  # one row
    else:
        warnings.warn(f"quality rules: rates still move by {SETTLED} or more after {STEPS} steps", RuntimeWarning, stacklevel=2)
    return prior, rates


def judge(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, str]:
    """The documents with one added struct, and its name (``quality``, lengthened if a column has that name).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the further counts that the rules use;
    pattern (the votes), posterior (probability of good), base_failed, kept. Words are ``[^\\x20\\x09-\\x0D]+``. Texts
    of fewer than 10 words fail the base rules and get no votes; so do null and empty ones, with counts of 0. A
    document is kept if it passes the base rules and its posterior is at least 0.5. Repeated rows are judged alike
    and count each time. The counts are written to the shared folder once, with the other columns.
    """
    df, q = _features(docs, text_col, keep_text)
    ballot, silent = rules(q), F.col(f"{q}.n_words") < 10
    pattern = F.lit(0)
    for j, (_, good, bad) in enumerate(ballot):
        pattern = pattern + F.when(silent, 0).when(good, GOOD).when(bad, BAD).otherwise(0) * 3**j
    others = [F.col(f"`{c}`") for c in df.columns if c != q]
    df = written(df.select(*others, F.struct(f"{q}.*", pattern.cast("int").alias("pattern")).alias(q)), "quality")
    patterns = written(df.filter(~silent).groupBy(F.col(f"{q}.pattern").alias("pattern")).agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns")
    prior, rates = estimate(patterns, len(ballot))
    n, repeat = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    failed = (n < 10) | (repeat * 100 > n * 20)
    df = df.withColumn(q, F.struct(f"{q}.*", _posterior(F.col(f"{q}.pattern"), prior, rates).alias("posterior"), failed.alias("base_failed")))
    return df.withColumn(q, F.struct(f"{q}.*", (~F.col(f"{q}.base_failed") & (F.col(f"{q}.posterior") >= 0.5)).alias("kept"))), q


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    df, q = judge(docs, text_col)
    return df.filter(f"`{q}`.kept").select(*(F.col(f"`{c}`") for c in docs.columns))
