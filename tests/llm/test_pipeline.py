import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{n}"
        f(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((before, docs))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_filters_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == COLUMNS and after.dtypes == before.dtypes
        assert after.count() <= before.count()


def test_near_duplicates_keep_the_first(spark, stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    low = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} for i, t in rows for w in [words(low(t))]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j]) if j < i else 0
            if n and 9 * n >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i in sets if find(i) == i)


def test_no_window_is_left_twice(stages):
    before, after = stages[2]
    kept, seen = {r.doc_id: r for r in after.collect()}, set()
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        left = [x for x, g in zip(w, gone) if not g]
        if w and not left:
            assert r.doc_id not in kept
        else:
            assert words(kept[r.doc_id].text) == left and kept[r.doc_id].lang == r.lang and kept[r.doc_id].source == r.source
            if not any(gone):
                assert kept[r.doc_id] == r
            else:
                assert kept[r.doc_id].n_chars == len(kept[r.doc_id].text)


def test_clean_documents_pass_decontamination(spark, stages):
    before, after = stages[3]
    have = {r.doc_id for r in after.collect()}
    found = entry.queries()["op7_decontamination"]
    bad = {r.doc_id for r in found(spark, SF).collect() if r.contaminated}
    assert {r.doc_id for r in before.collect()} - have <= bad


def test_last_stage_holds_every_token(stages):
    before, after = stages[4]
    want = {r.doc_id: len(packing.token_ids("byte_bpe_50k", r.text)) + 1 for r in before.collect()}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_gives_the_rows_of_the_stages(spark, stages):
    key = lambda rows: sorted(tuple(r)[:5] for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(stages[-1][1].collect())


def test_two_runs_can_be_read_at_once(spark):
    one, two = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert one.count() == two.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, carried map<string,int>, n_words string, at timestamp, chunk array<binary>"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, repeats and clashing names in columns that the stages use inside."""
    import datetime

    prose = "The house on the hill was old and the people of the town did not like it . It is said that it has been there for many years ."
    more = {"carried": {"a": 1}, "n_words": "x", "at": datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), "chunk": [bytearray(b"\x00\xff")]}
    texts = [prose, prose, prose.upper(), None, "", "short", prose + " " + prose, " ".join(f"word{i} and the" for i in range(3000))]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": None, "n_chars": len(t or ""), **more} for i, t in enumerate(texts)]
    rows += [{**rows[0], "doc_id": None}, {**rows[0], "doc_id": None, "text": None}, rows[1], {**rows[1], "n_words": "y"}, {"doc_id": 50}]
    return spark.createDataFrame([{k: r.get(k) for k in ("doc_id", "text", "lang", "source", "n_chars", *more)} for r in rows], ODD)


@pytest.mark.parametrize("n", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, odd, n):
    name, stage = corpus_pipeline.STAGES[n]
    got = stage(spark, odd, SF)
    rows = got.collect()
    none = stage(spark, odd.filter("false"), SF)
    assert none.count() == 0 and none.columns == got.columns
    if n == 4:
        assert sorted({(r.doc_id is None, r.doc_id) for r in rows}) == sorted({(r.doc_id is None, r.doc_id) for r in odd.collect()})
        return
    assert got.dtypes == odd.dtypes
    ids = [r.doc_id for r in rows]
    kept = {r.doc_id: r for r in rows}
    if name == "quality rules":
        assert 0 in ids and not {3, 4, 5, 50} & set(ids)
    if name == "n-gram Jaccard join":
        assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 7, 50] and ids.count(None) == 2
    if name == "substring dedup":
        assert kept[3].text is None and kept[4].text == "" and kept[50].lang is None and kept[5] == odd.filter("doc_id = 5").first()
        assert 2 in ids and kept[7] == odd.filter("doc_id = 7").first()
    if name == "benchmark decontamination":
        assert len(rows) == odd.count()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_registered_queries_return_a_row_per_document(spark, name):
    got = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in ("conversations", "documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        order = lambda cols, rows: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=str)
        assert order(got.columns, [tuple(r) for r in got.collect()]) == order(want.columns, want.fetchall())
    elif name not in ("op1_best_fit_packing", "op5_license_scan"):
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


#: Names that stages use inside, or that they might.
INSIDE = (
    "doc_id_gone row c n chunk id h rest keys at key sid sides slots salt bucket quality kept kept_text carried removed n_words n_removed n_hit n_items "
    "component_id n_shingles no_text posterior word_char pattern lines words votes items_sha256 piece start length sequence_id offset ids_crc32 q text_ doc_id_"
).split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    docs = docs.unionByName(docs.filter("doc_id = 7")).unionByName(docs.filter("doc_id = 8").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    wide = docs.selectExpr("*", *(f"concat('{c}-', doc_id) AS `{c}`" for c in INSIDE if c not in docs.columns))
    plain, got = stage(spark, docs, SF), stage(spark, wide, SF)
    assert got.columns == wide.columns
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    for r in rows:
        assert all(r[c] == f"{c}-{r.doc_id}" for c in INSIDE if c not in docs.columns)


def test_packing_takes_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    wide = docs.selectExpr("*", *(f"concat('{c}-', doc_id) AS `{c}`" for c in INSIDE if c not in docs.columns))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (dict(corpus_pipeline.STAGES)["best-fit packing"](spark, d, SF).select(*own).collect() for d in (docs, wide))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
