import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from paceframe.functions import dates, geo, numbers, text
from paceframe.operators.correlation import correlation_long, correlation_vector


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize("given, expected", [
    ("1.5", 1.5), ("abc", 0.0), ("", 0.0), (None, 0.0), ("NaN", 0.0), ("Infinity", 0.0), ("-7", -7.0),
])
def test_parse_number(spark, given, expected):
    assert one(spark, given, numbers.parse_number(F.col("x"))) == expected


@pytest.mark.parametrize("given, expected", [("3", 3), ("3.0", 3), ("3.5", None), ("x", None), (None, None), ("1e30", None)])
def test_parse_integer(spark, given, expected):
    assert one(spark, given, numbers.parse_integer(F.col("x"))) == expected


@pytest.mark.parametrize("given, expected", [(0.5, 1), (-0.5, 0), (2.5, 3), (-2.6, -3)])
def test_round_half_up(spark, given, expected):
    assert one(spark, given, numbers.round_half_up(F.col("x")), "double") == expected


def test_clamp_keeps_null(spark):
    assert one(spark, None, numbers.clamp(F.col("x"), 0.0, 1.0), "double") is None
    assert one(spark, 7.0, numbers.clamp(F.col("x"), 0.0, 1.0), "double") == 1.0


@pytest.mark.parametrize("bpm, zone", [
    (119, "z1_recovery"), (120, "z2_aerobic"), (140, "z3_tempo"), (160, "z4_threshold"), (175, "z5_vo2max"), (None, None),
])
def test_zone_limits_are_exclusive(spark, bpm, zone):
    assert one(spark, bpm, numbers.heart_rate_zone(F.col("x")), "int") == zone


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (45.0, 9.0, 45.0, 9.0), (None, None, 1.0, 1.0)], "a double, b double, c double, d double")
    half, same, missing = [r[0] for r in df.select(geo.haversine_m(*[F.col(c) for c in "abcd"])).collect()]
    assert half == pytest.approx(math.pi * 6_371_000)
    assert same == 0.0
    assert missing is None


@pytest.mark.parametrize("given, expected", [("AT-012", 12), ("x", None), ("", None), ("AT-0", None), (None, None), (" 7b8 ", 7)])
def test_first_positive_int(spark, given, expected):
    assert one(spark, given, text.first_positive_int(F.col("x"))) == expected


def test_code_keeps_long_ids_and_name_skips_null(spark):
    assert one(spark, 1234, text.athlete_code(F.col("x")), "bigint") == "AT-1234"
    assert one(spark, 7, text.athlete_code(F.col("x")), "bigint") == "AT-007"
    assert one(spark, None, text.full_name(F.lit("Ada"), F.col("x"))) == "Ada "


@pytest.mark.parametrize("given, expected", [
    (" Relational", "relational"), ("CH", "analytical"), (None, "relational"), ("", "relational"), ("other", None), ("  ", None),
])
def test_normalise_choice(spark, given, expected):
    aliases = {"relational": "relational", "ch": "analytical"}
    assert one(spark, given, text.normalise_choice(F.col("x"), aliases, "relational")) == expected


@pytest.mark.parametrize("given, expected", [("30s", True), (" 2m ", True), ("1h", True), ("1d", False), ("s", False), (None, False)])
def test_duration(spark, given, expected):
    assert one(spark, given, text.is_duration(F.col("x"))) is expected


@pytest.mark.parametrize("week, monday", [("2024-52", "2024-12-23"), ("2025-01", "2024-12-30"), ("2020-53", "2020-12-28")])
def test_iso_weeks(spark, week, monday):
    assert one(spark, week, dates.iso_week_monday(F.col("x")).cast("string")) == monday
    assert one(spark, monday, dates.iso_week_id(F.to_date("x"))) == week


def test_weekday(spark):
    assert one(spark, "2024-01-07", dates.weekday_name(dates.weekday_number(F.to_date("x")))) == "Dom"


def test_parse_iso(spark):
    assert one(spark, "2024-01-02T03:04:05Z", dates.parse_iso(F.col("x"))).hour == 3
    assert one(spark, "soon", dates.parse_iso(F.col("x"))) is None


def test_correlation_of_constant_is_null_and_empty_is_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0), (None, 1.0, 5.0)], "a double, b double, c double")
    found = {(r.x, r.y): r for r in correlation_long(df, ["a", "b", "c"]).collect()}
    assert found["a", "b"].r == pytest.approx(0.9979, abs=1e-3) and found["a", "b"].n == 3
    assert found["a", "c"].r is None and found["c", "c"].r == 1.0
    assert rows(correlation_long(df.filter("a > 9"), ["a", "b"])) == []
    assert rows(correlation_vector(df.filter("a > 9"), ["a", "b"])) == []


@pytest.mark.parametrize("given, expected", [("9007199254740993", 9007199254740993), ("1723456789012345679", 1723456789012345679), ("9007199254740993.0", 9007199254740993), ("9223372036854775808", None), (" 12 ", 12), ("1e3", 1000), ("1.5", None)])
def test_whole_numbers_are_exact(spark, given, expected):
    assert one(spark, given, numbers.parse_integer(F.col("x"))) == expected
