import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from shizuku.functions import censoring, naming, periods


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("<0.5", ("below_lod", 0.5)), (" <2 ", ("below_lod", 2.0)), ("1未満", ("below_lod", 1.0)), ("ND", ("not_detected", None)), (">100", ("above_lod", 100.0)), ("3.2", ("none", None)), (None, ("none", None)), ("abc", ("none", None))])
def test_censoring(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "r string").select(censoring.classify(F.col("r")).alias("x")).first().x
    assert (got.censoring, got.censoring_limit) == want


def test_unreadable_limit_is_an_error(spark):
    with pytest.raises(SparkRuntimeException):
        one(spark, censoring.classify(F.col("r")), r="<abc")


def test_two_series(spark):
    rows = [("none", 3.0, None), ("below_lod", None, 0.5), ("not_detected", None, None), ("above_lod", None, 9.0), ("unknown", None, None)]
    df = spark.createDataFrame(rows, "c string, v double, l double")
    z, v = censoring.zero_series(F.col("c"), F.col("v")), censoring.limit_series(F.col("c"), F.col("v"), F.col("l"))
    got = [tuple(r) for r in df.select(z, v, censoring.is_member(z, F.col("c"))).collect()]
    assert got == [(3.0, 3.0, True), (0.0, 0.5, True), (None, None, True), (None, None, False), (None, None, False)]


PERIODS = [
    ("2024", "year", ("2024-01-01", "2024-12-31")), ("2024", "fiscal_year", ("2024-04-01", "2025-03-31")), ("2024-02", "month", ("2024-02-01", "2024-02-29")), ("2023-02", "month", ("2023-02-01", "2023-02-28")),
    ("2024-05-06", "day", ("2024-05-06", "2024-05-06")), ("2024-03-01T00:00:00+09:00", "hour", ("2024-02-29T23:00:00", "2024-03-01T00:00:00")), ("2024-03-01T12:30:00+09:00", "instant", ("2024-03-01T12:30:00", "2024-03-01T12:30:00")),
]


@pytest.mark.parametrize(("label", "grain", "want"), PERIODS)
def test_label_periods(spark, label, grain, want):
    assert tuple(one(spark, periods.label_period(F.col("l"), F.col("g")), l=label, g=grain)) == want


@pytest.mark.parametrize("label", ["202", "2024-03-01T00:00:00+00:00", "2024-3-1"])
def test_bad_labels_are_errors(spark, label):
    with pytest.raises(SparkRuntimeException):
        one(spark, periods.label_period(F.col("l"), F.col("g")), l=label, g="hour")


OBSERVED = [
    ("2020-05-01", "day", "2020-05-01", "2020-05-01"), ("2020-05-01T10:11:12", "instant", "2020-05-01T10:11:12", "2020-05-01T10:11:12"), ("2020-05-01T10:11", "instant", "2020-05-01T10:11:00", "2020-05-01T10:11:00"),
    ("2020-05-01/2021-06-02", "survey_period", "2020-05-01", "2021-06-02"), ("2020", "year", "2020-01-01", "2020-12-31"), ("2020-02", "month", "2020-02-01", "2020-02-29"), ("2019/2021", "survey_period", "2019-01-01", "2021-12-31"),
    ("2020-05-01T20:00Z", "instant", "2020-05-02T05:00:00", "2020-05-02T05:00:00"), ("2020-05-01T01:02:03.999Z", "instant", "2020-05-01T10:02:03", "2020-05-01T10:02:03"), ("2020-05-01T01:02:03Z", "instant", "2020-05-01T10:02:03", "2020-05-01T10:02:03"),
    ("2020-05-01T01:00Z/2020-05-01T20:00Z", "survey_period", "2020-05-01T10:00:00", "2020-05-02T05:00:00"), ("2020-01/2020-02", "survey_period", "2020-01-01", "2020-02-29"),
]


def test_all_twelve_shapes(spark):
    df = spark.createDataFrame([(x[0],) for x in OBSERVED] + [(None,)], "v string")
    got = [r.p for r in periods.with_observed_period(df, "v", "p").collect()]
    assert [(g.period_grain, g.period_start, g.period_end) for g in got[:-1]] == [x[1:] for x in OBSERVED]
    assert len({g.shape for g in got[:-1]}) == 12 and got[-1].shape is None


@pytest.mark.parametrize("value", ["2020-13", "20-01-01", "2021/2019", "2020-12-31T20:00Z", "2020-02-30/2020-03-01T"])
def test_bad_observation_dates_are_errors(spark, value):
    with pytest.raises(Exception):
        periods.with_observed_period(spark.createDataFrame([(value,)], "v string"), "v", "p").collect()


def test_eras(spark):
    assert one(spark, periods.era_month(F.col("t")), t="令和元年5月") == "2019-05"
    assert one(spark, periods.era_month(F.col("t")), t="2021年12月") == "2021-12"
    assert one(spark, periods.era_fiscal_year(F.col("t")), t="平成30年度") == 2018
    assert one(spark, periods.fiscal_year_of(F.col("t")), t="2024-03-31") == 2023


def test_names_and_numbers(spark):
    assert one(spark, naming.binomial(F.col("t")), t=" Cervus  nippon centralis ") == "Cervus nippon"
    assert one(spark, naming.binomial(F.col("t")), t="Cervus") is None
    assert one(spark, naming.bare_name(F.col("t")), t="Rosa (Sub) multiflora var. adenochaeta Thunb.") == "Rosa multiflora adenochaeta"
    assert one(spark, naming.number_of(F.col("t")), t="１，２３４．５") == 1234.5
    assert tuple(one(spark, naming.count_pair(F.col("t")), t="5(1)")) == (5, 1)
    assert tuple(one(spark, naming.count_pair(F.col("t")), t="12")) == (12, None)
    assert one(spark, naming.row_label(F.col("t")), t="a|b | c ") == "c" and one(spark, naming.row_label(F.col("t")), t="a| ") == "a| "
    assert one(spark, naming.escaped_id(F.col("t")), t="a b/é-1.2_Z") == "a%20b%2F%C3%A9-1.2_Z"
    assert one(spark, naming.significant(F.col("t")), t=123456.7890123456) == 123456.789012
    assert one(spark, naming.picked_label(F.lit(None).cast("string"), F.lit(" "), F.lit("x"))) == "x"


def test_grid_and_distances(spark):
    assert one(spark, naming.grid_id(F.col("a"), F.col("b")), a=-0.001, b=139.006) == "grid01:-1,13900"
    assert tuple(one(spark, naming.grid_of_place(F.lit("common:place:grid01.3520_-13900")))) == (35.2, -139.0)
    assert abs(one(spark, naming.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.195) < 0.01
    x, y = one(spark, naming.mercator_pixel(F.lit(0.0), F.lit(0.0), 1))
    assert (round(x, 6), round(y, 6)) == (256.0, 256.0)
    ring = one(spark, naming.square(F.lit(35.0), F.lit(139.0)))
    assert ring[0] == ring[4] and len(ring) == 5


def test_ranks(spark):
    order = ["high", "medium", "low"]
    assert one(spark, naming.weakest(order, F.lit("high"), F.lit("low"), F.lit("high"))) == "low"
    assert one(spark, naming.weakest(order, F.lit("high"), F.lit("odd"))) == order[-1] == one(spark, naming.weakest(order, F.lit("high"), F.lit(None).cast("string"))) == one(spark, naming.weakest(order))
    got = [one(spark, naming.direction(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((None, 1), (2, 1), (1, 2), (1, 1), (1, None))]
    assert got == ["new", "up", "down", "same", "same"]
    assert one(spark, naming.basis_of(F.lit("year"), F.lit("day"))) == "day" and one(spark, naming.basis_of(F.lit("fiscal_year"), F.lit("month"))) == "fiscal_year"
