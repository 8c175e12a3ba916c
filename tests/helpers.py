from datetime import date, datetime, timedelta
from decimal import Decimal

BAR = ("series bigint, session date, open bigint, high bigint, low bigint, close bigint, volume bigint, "
       "traded_value decimal(24,2)")
CAL = "exchange string, session date, is_trading_day boolean, open_s int, close_s int"
ACT = ("id bigint, series bigint, type string, ex_date date, num decimal(18,8), den decimal(18,8), available_at timestamp, "
       "supersedes_id bigint")


def ticks(x):
    return int(round(Decimal(str(x)) * 10000))


def days(n, start=date(2025, 1, 1)):
    return [start + timedelta(days=i) for i in range(n)]


def calendar(spark, sessions):
    return spark.createDataFrame([("X", s, True, 33300, 55800) for s in sessions], CAL)


def actions(spark, rows=()):
    return spark.createDataFrame(list(rows), ACT)


def action(id_, series, kind, ex, num, den, known, supersedes=None):
    return (id_, series, kind, ex, Decimal(num), Decimal(den), known, supersedes)


def bar(series, day, o, h, lo, c, volume=1000, value=None):
    return (series, day, ticks(o), ticks(h), ticks(lo), ticks(c), volume, None if value is None else Decimal(value))


def noon(day):
    return datetime(day.year, day.month, day.day, 6, 30)
