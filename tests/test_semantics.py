import math

import pytest
from pyspark.sql import functions as F

from gridvalue.functions import (
    Tally, ieee_div, if_known, is_number, label, null_safe_join, number_rows, prefix_sum, sql_div,
    text_flag, top_rows,
)


def test_label_spells_out_missing_parts(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, None)], "x string, y int")
    assert [r[0] for r in df.select(label("x", "y")).collect()] == ["a-1", "NA-2", "NA-NA"]


@pytest.mark.parametrize("num,den,expected", [
    (1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, math.nan), (None, 0.0, None),
    (1.0, None, None), (3.0, 2.0, 1.5),
])
def test_ratios_follow_ieee(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "n double, d double")
    row = df.select(ieee_div(F.col("n"), F.col("d")), F.expr(sql_div("n", "d"))).first()
    for got in row:
        if expected is not None and math.isnan(expected):
            assert math.isnan(got)
        else:
            assert got == expected


def test_zero_ratios_after_fill(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "n double")
    out = df.select(ieee_div(F.col("n"), F.lit(0.0)).alias("r")).na.fill(0)
    assert [r[0] for r in out.collect()] == [math.inf, -math.inf, 0.0, 0.0]


def test_unknown_condition_stays_unknown(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    out = df.select(if_known(F.col("c"), F.lit(1), F.lit(0))).collect()
    assert [r[0] for r in out] == [1, 0, None]


def test_text_flag_is_case_sensitive_and_zero_on_missing(spark):
    df = spark.createDataFrame([("a Shotgun b",), ("shotgun",), (None,)], "t string")
    assert [r[0] for r in df.select(text_flag("t", "Shotgun")).collect()] == [1, 0, 0]


def test_nan_is_not_a_number(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double")
    assert [r[0] for r in df.select(is_number(F.col("x"))).collect()] == [True, False, False]


def test_sums(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "x int, w int")
    t, w = Tally(), Tally("w")
    row = df.agg(t.total(F.col("x")), t.strict_total(F.col("x")), w.total(F.col("x")), w.rows(),
                 w.rows_where(F.col("x") > 0), t.rows()).first()
    assert tuple(row) == (1, None, 2, 5, 2, 2)
    assert df.where("x > 9").agg(t.total(F.col("x"))).first()[0] == 0


def test_null_safe_join_matches_missing_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), (None, 4)], "k string, b int")
    left = sorted(tuple(r) for r in null_safe_join(a, b, ["k"]).select("a", "b").collect())
    assert left == [(1, None), (2, 4)]
    full = null_safe_join(a, b, ["k"], "full").select("k", "a", "b").collect()
    assert sorted(map(tuple, full), key=repr) == [("x", 1, None), ("y", None, 3), (None, 2, 4)]
    anti = null_safe_join(a, b, ["k"], "left_anti").collect()
    assert [tuple(r) for r in anti] == [("x", 1)]


def test_prefix_sum_over_a_hot_group(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i}", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    out = prefix_sum(df, ["g"], [F.col("v")], F.col("v"), "before")
    got = {r["v"]: r["before"] for r in out.where("g = 'hot'").collect()}
    assert got == {i: i * (i - 1) // 2 for i in range(3000)}
    numbered = number_rows(df, ["g"], [F.col("v")], "n")
    assert numbered.where("g = 'hot' and n = v + 1").count() == 3000
    assert numbered.where("g <> 'hot' and n = 1").count() == 50


def test_prefix_sum_orders_missing_first(spark):
    df = spark.createDataFrame([("a", None), ("a", 2), ("a", 1)], "g string, v int")
    out = number_rows(df, ["g"], [F.col("v")], "n").collect()
    assert {r["v"]: r["n"] for r in out} == {None: 1, 1: 2, 2: 3}


def test_top_rows_trims_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id as v")
    top = top_rows(df, ["g"], [F.desc("v")], 2, "rank")
    assert sorted(r["v"] for r in top.collect()) == [94, 95, 96, 97, 98, 99]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
