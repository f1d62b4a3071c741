"""Language identification by hierarchical discrimination.

Texts are counts of lower-cased letter trigrams (bytes), hashed to ``DIM``
columns. A linear classifier over families decides the family; inside it,
one-versus-one linear support vector machines vote between the languages. The
machines learn on at most ``SAMPLE`` labelled documents of each language, and ``SAMPLE_IN_ALL``
of all (drawn by a hash of id and text), each machine in a task of its own; predicting reads
whole texts where they are and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textcore import slices, spread, text_buffer
from plumbline.shared import scratch, written

DIM, SAMPLE, SAMPLE_IN_ALL, SEED = 4096, 400, 20_000, 11
#: Texts whose dense rows are in memory at once.
TEXTS_AT_ONCE = 256
UNDETERMINED = "und"
#: Families of languages by code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indo-aryan": "hi ur bn mr ne gu pa".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigrams(column) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, texts after the last, matrix of unit rows) of every slice of a string column."""
    data, offsets = text_buffer(column)
    for a, b, part, off in slices(data, offsets, most=TEXTS_AT_ONCE):
        folded = _FOLD[part].astype(np.int64)
        out = np.zeros((b - a, DIM), np.float32)
        if len(folded) >= 3:
            code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
            doc = np.repeat(np.arange(b - a), np.diff(off))[:-2]
            inside = (np.arange(len(code)) + 3 <= np.repeat(off[1:], np.diff(off))[:-2]) & (code != 0x202020)
            column_of = (code * 2654435761 & 0xFFFFFFFF) >> 20
            out = np.bincount((doc * DIM + column_of)[inside], minlength=(b - a) * DIM).reshape(b - a, DIM).astype(np.float32)
        np.sqrt(out, out=out)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        yield a, b, out


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"only {lang}")


def machines(langs: list[str]) -> list[tuple[str, str, str, int]]:
    """(machine, its other side, language, sign): the languages that each machine learns from; a family's other side is ''."""
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        families.setdefault(family_of(lang), []).append(lang)
    out = []
    for family, members in families.items():
        if len(families) > 1:
            out += [(family, "", lang, 1 if lang in members else -1) for lang in sorted(langs)]
        for a, b in combinations(members, 2):
            out += [(a, b, a, 1), (a, b, b, -1)]
    return out


def _fitted(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in rows.column("x")]).astype(np.float32)
    w = fit_svm(x, rows.column("sign").to_numpy())
    return pa.table({"a": rows.column("a")[:1], "b": rows.column("b")[:1], "w": pa.array([w.tobytes()], pa.binary())})


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, sweeps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    balance = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    diagonal = 1 / (2 * cost * balance)
    norm = (x * x).sum(1) + diagonal
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(SEED)
    for _ in range(sweeps):
        for i in rng.permutation(len(y)):
            new = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + diagonal[i] * alpha[i]) / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """Families, then languages, from the weights of the machines. Without any labelled text it knows nothing and says so."""

    def __init__(self, langs: list[str], weights: dict[tuple[str, str], np.ndarray]):
        self.langs = sorted(langs)
        families: dict[str, list[str]] = {}
        for lang in self.langs:
            families.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(families)
        self.members = [families[f] for f in self.families]
        self.family_w = np.stack([weights[f, ""] for f in self.families], 1) if len(self.families) > 1 else None
        self.pair_w = {pair: weights[pair] for members in self.members for pair in combinations(members, 2)}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: the family's share times the mean share won from the family's others."""
        n = len(x)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n)
        one = np.concatenate([x, np.ones((n, 1), x.dtype)], 1)
        share = np.ones((n, len(self.families)))
        if self.family_w is not None:
            margin = 3 * (one @ self.family_w).astype(np.float64)
            share = np.exp(margin - margin.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
        family = share.argmax(1)
        out, score = np.empty(n, object), share.max(1)
        for f, members in enumerate(self.members):
            own = np.flatnonzero(family == f)
            votes, won = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
            for i, j in combinations(range(len(members)), 2):
                p = 1 / (1 + np.exp(-3 * (one[own] @ self.pair_w[members[i], members[j]]).astype(np.float64)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                won[:, i] += p
                won[:, j] += 1 - p
            best = (votes + won / (2 * len(members))).argmax(1) if len(own) else np.zeros(0, int)
            out[own] = np.array(members, object)[best]
            if len(members) > 1:
                score[own] *= won[np.arange(len(own)), best] / (len(members) - 1)
        return list(out), score


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> Model:
    known = docs.filter(~_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(SEED)), F.lit(1 << 30))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {})
    spark, each = docs.sparkSession, max(2, min(sample, SAMPLE_IN_ALL // len(sizes)))
    share = spark.createDataFrame([(lang, min(1 << 30, int((1 << 30) * 1.2 * each / n))) for lang, n in sizes.items()], "lang string, share long")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.tobytes() for _, _, m in trigrams(batch.column(2)) for row in m.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["lang", "draw", "x"])

    # equal rows have one draw and count once here
    drawn = known.join(F.broadcast(share), "lang").filter(F.col("draw") < F.col("share")).dropDuplicates(["lang", "draw"]).select("lang", "draw", "text")
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("r") <= each).drop("r")
    with scratch(spark):
        rows = written(drawn.mapInArrow(features, "lang string, draw long, x binary"), "labelled")
        langs = [r["lang"] for r in rows.select("lang").distinct().collect()]
        plan = spark.createDataFrame(machines(langs), "a string, b string, lang string, sign int")
        fits = rows.join(F.broadcast(plan), "lang").select("a", "b", "lang", "sign", "x").groupBy("a", "b").applyInArrow(_fitted, "a string, b string, w binary")
        weights = {(r["a"], r["b"]): np.frombuffer(r["w"], np.float32) for r in fits.collect()}
    return Model(langs, weights)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from the text and the non-null language of documents whose id, as text, has a crc32 with remainder other than
    2 by 4; at most ``sample`` of each language and SAMPLE_IN_ALL of all, equal rows once. Predictions depend on the text alone. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if nothing can be learned. A null id is not held out.
    Repeated rows are predicted alike. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, sample))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(3).to_pylist()
            lang, score = [], []
            for a, b, x in trigrams(batch.column(2)):
                found, sure = model.value.predict(x)
                lang += [v if ok else UNDETERMINED for v, ok in zip(found, lettered[a:b])]
                score += [float(s) if ok else 0.0 for s, ok in zip(sure, lettered[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    data = docs.select(F.col(id_col).cast("long"), _held_out(id_col).alias("held_out"), F.col(text_col).cast("string"), letters.alias("lettered"))
    return spread(data).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
