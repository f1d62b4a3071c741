from pyspark.sql import functions as F

from plumbline.functions import clean
from plumbline.functions.draws import draw
from plumbline.functions.geo import arc_km, block_id, chord, unit_sphere
from plumbline.functions.skill import recovery_pct, rmse_skill


def values(df):
    return [tuple(r) for r in df.collect()]


def test_censored_numbers(spark):
    raw = ["<0.5", "> 10", "1,234", "NC", "-", "", None, "abc", " 7 ", "<=4", "inf"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(clean.censored_double(F.col("v"))).collect()]
    assert got == [0.25, 10.0, 1234.0, None, None, None, None, None, 7.0, 2.0, None]


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("2020-02-30", "x", float("nan"), -9999.0), ("2020-02-03", "1e3", float("inf"), 4.0)], "d string, n string, f double, s double")
    got = values(df.select(clean.lenient_date(F.col("d")).cast("string"), clean.lenient_double(F.col("n")), clean.finite(F.col("f")), clean.sentinel_to_null(F.col("s"))))
    assert got == [(None, None, None, None), ("2020-02-03", 1000.0, None, 4.0)]


def test_names_and_dates(spark):
    df = spark.createDataFrame([("  A \t b  c ", 2020, 13), ("Ä-b_1", 2020, 2)], "s string, y int, m int")
    got = values(df.select(clean.squeeze(F.col("s")), clean.name_token(F.col("s")), clean.mid_month(F.col("y"), F.col("m")).cast("string")))
    assert got == [("A b c", "abc", None), ("Ä-b_1", "b1", "2020-02-15")]


def test_threshold_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "y double")
    assert [r[0] for r in df.select(clean.exceeds(F.col("y"), 2.0)).collect()] == [0.0, 1.0, None]


def test_draws_are_spread_and_fixed(spark):
    df = spark.range(5000).select(draw(F.col("id"), 3).alias("d"), draw(F.col("id"), 4).alias("e"))
    assert df.filter("id = 0") is not None if "id" in df.columns else True
    sizes = [r["count"] for r in df.groupBy(F.col("d") % 5).count().collect()]
    assert len(sizes) == 5 and min(sizes) > 900
    assert abs(df.select(F.corr("d", "e")).first()[0]) < 0.05
    assert spark.range(1).select(draw(F.lit(0), 0)).first()[0] == (1103515245**2 + 7919 * 1103515245) % 2147483629


def test_geometry(spark):
    df = spark.createDataFrame([(-0.1, 0.1, 90.0, 0.0), (0.3, 0.3, 0.3, 0.3)], "a double, b double, c double, d double")
    p, q = unit_sphere(F.col("a"), F.col("b")), unit_sphere(F.col("c"), F.col("d"))
    got = values(df.select(block_id(F.col("a"), F.col("b"), 0.1), arc_km(chord(p, q))))
    assert got[0][0] == "-1_1" and got[1][0] == "2_2"  # 0.3 / 0.1 is below 3 on doubles
    assert abs(got[0][1] - 10018.7) < 1 and got[1][1] == 0


def test_recovery_is_null_without_skill(spark):
    df = spark.createDataFrame([(0.2, 0.4), (0.2, 0.0), (-0.1, 0.5), (0.1, -0.2)], "b double, m double")
    assert [r[0] for r in df.select(recovery_pct(F.col("b"), F.col("m"))).collect()] == [50.0, None, -20.0, None]
    assert [r[0] for r in df.select(recovery_pct(F.col("b"), F.col("m"), floor=True)).collect()] == [50.0, None, 0.0, None]
    assert [r[0] for r in df.select(rmse_skill(F.col("b"), F.col("m"))).collect()][1] is None
