import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import BOOLEAN_CODES, FEATURE_CODES
from tapewright.operators.features import feature_frame
from tapewright.operators.latest import latest_frame

BAR = "series long, session date, open long, high long, low long, close long, volume long, traded_value decimal(24,2), available_at long"


def tape(spark):
    """Series of every length that a code asks for, and one that never moves, one without values, one with a zero price."""
    r, rows = random.Random(5), []
    for series, n in enumerate((1, 2, 14, 15, 20, 21, 22, 50, 61, 64, 101, 127, 200, 201, 260)):
        for i in range(n):
            o, c = r.randint(900, 1100) * 100, r.randint(900, 1100) * 100
            rows.append((series, i, o, max(o, c) + r.randint(0, 50), min(o, c) - r.randint(0, 50), c, r.randint(0, 900), r.randint(1, 9) * 100 if series % 3 else None))
    rows += [(100, i, 5, 5, 5, 5, 0, 1) for i in range(80)] + [(101, i, 9 - i % 3, 9, 0, 0 if i == 77 else 5, 4, 1) for i in range(80)]
    r.shuffle(rows)
    made = [(s, date(2001, 1, 1) + timedelta(i), *rest, i) for s, i, *rest in rows]
    return spark.createDataFrame([(*m[:7], None if m[7] is None else Decimal(m[7]), m[8]) for m in made], BAR)


def rows_of(frame):
    return {r.series: r for r in frame.collect()}


def test_the_newest_row_of_the_whole_frame(spark):
    bars = tape(spark)
    newest = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("session")))
    want = rows_of(feature_frame(bars, keep=("available_at",)).withColumn("_n", newest).where("_n = 1").drop("_n"))
    got = rows_of(latest_frame(bars, keep=("available_at",)))
    assert set(got) == set(want)
    for series, row in want.items():
        for name in row.asDict():
            if name.startswith("VOLATILITY") and row[name] is not None:
                assert got[series][name] == pytest.approx(row[name], rel=1e-12, abs=1e-15)
            else:
                assert got[series][name] == row[name], (series, name)


def test_plan_has_one_exchange_and_neither_window_nor_python(spark):
    bars = tape(spark)
    for codes in (FEATURE_CODES, ("RSI_14",), BOOLEAN_CODES):
        plan = latest_frame(bars, codes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Python" not in plan and "InArrow" not in plan
    assert latest_frame(bars, ("RSI_14", "SMA_20")).columns == ["series", "session", "n_obs", "RSI_14", "SMA_20"]
    assert latest_frame(bars.limit(0)).count() == 0
    with pytest.raises(ValueError):
        latest_frame(bars, ("SMA_21",))
