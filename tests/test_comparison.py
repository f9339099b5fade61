"""Guarded comparison and series, on hand-made values."""

from pyspark.sql import functions as F

from ledgerlens.functions.comparison import period_ordinal, with_comparison
from ledgerlens.functions.numeric import exact_medians, parse_decimal_text
from ledgerlens.operators import temporal, time_quality

CASES = [
    (100.0, 120.0, 20.0, 20.0, None), (100.0, 80.0, -20.0, -20.0, None), (0.0, 100.0, 100.0, None, "zero_reference"),
    (100.0, 0.0, -100.0, -100.0, None), (1.0, 100000.0, 99999.0, None, "low_reference_base"), (-100.0, -50.0, 50.0, None, "negative_reference"),
    (-100.0, -150.0, -50.0, None, "negative_reference"), (-100.0, 100.0, 200.0, None, "negative_reference"),
    (100.0, -100.0, -200.0, None, "sign_change"), (100.0, 100.0, 0.0, 0.0, None), (None, 1.0, None, None, "invalid_value"),
    (float("inf"), 1.0, None, None, "invalid_value"),
]


def test_decision_table(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, a double, b double")
    rows = with_comparison(df, F.col("a"), F.col("b")).orderBy("i").collect()
    for row, (_, _, delta, percent, reason) in zip(rows, CASES):
        assert (row["absolute_change"], row["percentage_change"], row["reason"]) == (delta, percent, reason)


def test_period_positions(spark):
    df = spark.createDataFrame([("2025-01",), ("2025-13",), ("0000-01",), ("x",)], "p string")
    assert [r[0] for r in df.select(period_ordinal(F.col("p"))).collect()] == [24300, None, None, None]


def test_gap_is_not_bridged(spark):
    s = spark.createDataFrame([("m", "2025-01", 100.0, 5), ("m", "2025-03", 120.0, 5), ("m", "2025-04", 90.0, 5)],
                              "metric string, period string, value double, records long")
    rows = temporal.compare_series(s).orderBy("ord").collect()
    assert [r["reason"] for r in rows] == ["non_consecutive_periods", None]
    assert rows[1]["percentage_change"] == -25.0


def _dates(spark, years):
    rows = [(f"{y:04d}-06-{(i % 28) + 1:02d}", 10.0) for y, n in years for i in range(n)]
    return spark.createDataFrame(rows, "d string, v double").select(F.to_timestamp("d").alias("Data"), "v")


def test_outlying_years(spark):
    core = [(y, 60) for y in range(2017, 2021)]
    far = time_quality.anomaly_report(_dates(spark, core + [(1017, 1), (2048, 1)]), "Data").first()
    assert (far["start_year"], far["end_year"], far["flagged_dates"]) == (2017, 2020, 2)
    edge = time_quality.anomaly_report(_dates(spark, core + [(2016, 2)]), "Data").first()
    assert edge["flagged_dates"] == 2
    wide = _dates(spark, [(2020, 80), (2025, 20)])
    assert time_quality.without_anomalies(wide, "Data").count() == 100


def test_exact_median_even_odd_and_repeats(spark):
    for values, want in (([3.0, 1.0, 2.0], 2.0), ([1.0, 2.0, 3.0, 10.0], 2.5), ([0.0] * 5 + [-1.0, 7.0], 0.0), ([-5.0, 5.0], 0.0)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert exact_medians(df, ["v"]).first()["v"] == want


def test_decimal_text(spark):
    df = spark.createDataFrame([("R$ 1.250,90",), ("128,70",), ("12%",), ("abc",), ("1250.90",)], "t string")
    assert [r[0] for r in df.select(parse_decimal_text(F.col("t"))).collect()] == [1250.9, 128.7, 12.0, None, 1250.9]
