import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from eventbook.functions import scalar


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_week_diff_counts_sundays(spark):
    rng = random.Random(7)
    first = dt.date(1960, 1, 1)
    pairs = [(first + dt.timedelta(rng.randrange(30000)), first + dt.timedelta(rng.randrange(30000))) for _ in range(40)]
    pairs += [(dt.date(2020, 3, 7), dt.date(2020, 3, 8)), (dt.date(2020, 3, 8), dt.date(2020, 3, 14))]

    def sundays(a, b):
        low, high = min(a, b), max(a, b)
        n = sum((low + dt.timedelta(i)).weekday() == 6 for i in range(1, (high - low).days + 1))
        return n if a <= b else -n

    df = spark.createDataFrame(pairs, "a date, b date").select("a", "b", scalar.week_diff(F.col("a"), F.col("b")).alias("w"))
    for a, b, w in df.collect():
        assert w == sundays(a, b), (a, b)
    assert sundays(*pairs[-2]) == 1 and sundays(*pairs[-1]) == 0


def test_money_text(spark):
    texts = {"€1.88": "1.8800", "$2.34": "2.3400", "$1,234.50": "1234.5000", "-3": "-3.0000", "free": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.parse_money(F.col("t")))
    assert {t: v if v is None else str(v) for t, v in df.collect()} == texts


def test_clock_text(spark):
    texts = {
        "8:11 AM": 8 * 3600 + 11 * 60,
        "00:30 AM": 1800,
        "12:30 AM": 1800,
        "12:30 PM": 12 * 3600 + 1800,
        "1:00 pm": 13 * 3600,
        "17:05": 17 * 3600 + 300,
        "17:05:09": 17 * 3600 + 309,
        "24:00": None,
        "13:00 PM": None,
        "9:61": None,
        "noon": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.parse_clock(F.col("t")))
    assert dict(df.collect()) == texts


def test_integer_conversions_differ(spark):
    price = F.lit(Decimal("2.5000"))
    assert one(spark, scalar.round_to_int(price)) == 3
    assert one(spark, scalar.cut_to_int(price)) == 2


def test_price_label(spark):
    assert one(spark, scalar.price_label(F.lit(Decimal("0.0000")))) == "darmowa"
    assert one(spark, scalar.price_label(F.lit(Decimal("7.3350")))) == "7.34"


def test_clock_text_output(spark):
    assert one(spark, scalar.clock_text(F.lit(29471))) == "08:11:11"
