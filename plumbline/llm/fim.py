"""Fill-in-the-middle: a text is cut at unit ends into prefix, middle and suffix, which change places around three marks.

Arrow batches go through pandas UDFs. The regex library's finditer gives the end of every unit, kept in one compact array
(8 bytes a unit); two look-ups in it are the cuts, and everything else is slices of the text. All draws come from one
SHA-256 of seed and id, so a row's result depends on nothing but the row: a lost task is computed again to the same bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

_CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@lru_cache(maxsize=8)
def _compiled(unit: str) -> regex.Pattern:
    return regex.compile(unit)


def unit_ends(text: str, unit: str = LINES) -> array:
    """0 and the end of every match, left to right, in code points."""
    ends = array("q", [0])
    ends.extend(m.end() for m in _compiled(unit).finditer(text))
    return ends


def draws(seed: int, ident: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from SHA-256 of ``seed:id``; a null id is the empty string."""
    key = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()
    return tuple(int.from_bytes(key[i : i + 4], "big") for i in (0, 4, 8, 12))


def check_marks(marks: tuple[str, str, str]) -> None:
    """A mark that could begin in a text or in another mark would be found at a wrong place: an error."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")
    if len(set(marks)) < 3:
        raise ValueError("three different marks are needed")


def cut_one(ident: int | None, text: str | None, unit: str, seed: int, rate: int, spm_rate: int, marks: tuple[str, str, str]) -> tuple:
    """(units, form, prefix length, middle length, output) of one text."""
    text = text or ""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, ident)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[second]
    p, s, m = marks
    if h4 % 100 < spm_rate:
        return n, SPM, a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, PSM, a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def restore_one(output: str | None, form: str | None, marks: tuple[str, str, str]) -> str | None:
    """The text that a form was made of."""
    if output is None or form == PLAIN:
        return output
    p, s, m = marks
    head, _, middle = output.partition(m)
    if form == SPM:
        suffix, _, prefix = head[len(s) :].partition(p)
    else:
        prefix, _, suffix = head[len(p) :].partition(s)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row per row: doc_id, n (units), form, prefix_chars, middle_chars (code points), output, output_sha256.

    Of the draws h1 to h4 of a row, the first two are the cuts (the prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, the middle after the larger), h3 % 100 < ``rate`` decides whether the text changes at all, and
    h4 % 100 < ``spm_rate`` whether the suffix goes first. A text that is empty or holds a mark stays plain, as does one that
    is not drawn; its lengths are null. Null texts are empty, repeated rows give the same row each time, null ids draw by an
    empty id and come back null. Characters that no unit matches after the last end belong to the suffix. Other columns are not read.
    """
    check_marks(marks)

    @F.pandas_udf(_CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            # ids come as strings: a column of numbers with nulls would turn into floats
            rows = [cut_one(i, t, unit, seed, rate, spm_rate, marks) for i, t in zip(ids, texts)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
            out["output_sha256"] = [_sha256(x) for x in out["output"]]
            yield out

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = own.select("doc_id", cut(F.col("doc_id").cast("string"), F.col("text")).alias("cut"))
    return made.select("doc_id", "cut.*")


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS, digest: bool = False) -> Column:
    """The text that an output of ``fill_in_middle`` was made of, or its SHA-256; null for a null output."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            texts = [restore_one(o, f, marks) for o, f in zip(outputs, forms)]
            yield pd.Series([t if t is None or not digest else _sha256(t) for t in texts], dtype=object)

    check_marks(marks)
    return run(output, form)
