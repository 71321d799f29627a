"""Balances at the borders of units, ties and large ones, each as the SQL has them."""

import pandas as pd
from pyspark.sql import functions as F

from rivulet.functions import numbers
from rivulet.plans import catalogue
from tests.oracle import connect

BALANCES = [None, 0.0, 9.99, 10.0, 12.5, 13.5, -12.5, 9999.49, 9999.5, 9999.8, 9999.99, -9999.99, 10000.0, 9999500.0, 12345678.9, 5764696959.27, 6000000000.01, 87177145732.69]


def test_money_helpers_equal_sql_at_the_borders(spark, tmp_path):
    pd.DataFrame({"c_custkey": range(len(BALANCES)), "c_acctbal": BALANCES}).to_parquet(tmp_path / "customer.parquet")
    got = catalogue.queries()["money_helpers"](spark, str(tmp_path)).orderBy("c_custkey").collect()
    want = connect(tmp_path).execute(catalogue.oracle_sql()["money_helpers"] + " ORDER BY c_custkey").fetchall()  # not through pandas, where longs beside a null are doubles
    assert [tuple(r) for r in got] == want


def test_thousands_are_not_grouped(spark):
    rows = spark.createDataFrame([(999_949,), (999_950,), (999_999,), (1_000_000,), (1_234_567_890,)], "c long").select(numbers.compact(F.col("c")).alias("v"))
    assert [r.v for r in rows.collect()] == ["999.9K", "1000.0K", "1000.0K", "1.0M", "1234.6M"]


def test_longs_are_not_rounded(spark):
    rows = spark.createDataFrame([(2**53 + 1,), (-(2**53) - 1,), (2**63 - 1,)], "c long").select(numbers.half_up(F.col("c")).alias("v"))
    assert [r.v for r in rows.collect()] == [2**53 + 1, -(2**53) - 1, 2**63 - 1]
    assert spark.range(1).select(numbers.cents_to_micro(F.lit(576_469_695_927)).alias("v")).first().v == 576_469_695_927_000_000
