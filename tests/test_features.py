from decimal import Decimal
from statistics import stdev

import pytest
from tests.helpers import BAR, actions, bar, calendar, days, noon, action
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import CORE_CODES, FEATURE_CODES
from tapewright.operators.asof_features import historical_features
from tapewright.operators.features import feature_frame, unavailable_reasons


def golden(spark, n, start=1, close=lambda i: i, traded=True):
    rows = [bar(1, d, close(i) - 0.5, close(i) + 2, close(i) - 2, close(i), 1000 + i, close(i) * (1000 + i) if traded else None)
            for i, d in zip(range(start, start + n), days(n))]
    return spark.createDataFrame(rows, BAR)


def frame(spark, bars, codes=FEATURE_CODES):
    return feature_frame(bars, codes).orderBy("session").collect()


def test_catalog():
    assert len(CORE_CODES) == 36 and len(FEATURE_CODES) == 38


def test_golden_vector(spark):
    last = frame(spark, golden(spark, 220))[-1]
    assert last["RET_1D"] == pytest.approx(220 / 219 - 1)
    assert last["RET_20D"] == pytest.approx(0.1)
    assert last["MOM_6M_126D"] == pytest.approx(220 / 94 - 1)
    assert last["SMA_20"] == 210.5e4 and last["SMA_200"] == 120.5e4
    assert last["EMA_20"] == pytest.approx(210.5e4) and last["EMA_50"] == pytest.approx(195.5e4)
    assert last["RSI_14"] == 100 and last["TRUE_RANGE"] == 4e4 and last["ATR_14"] == pytest.approx(4e4)
    assert last["ATR_PCT_14"] == pytest.approx(4 / 220)
    expected = stdev([d / (d - 1) - 1 for d in range(201, 221)]) * 252**0.5
    assert last["VOLATILITY_20"] == pytest.approx(expected)
    assert last["AVG_VOLUME_20"] == 1210.5
    assert last["AVG_TRADED_VALUE_20"] == pytest.approx(sum(d * (1000 + d) for d in range(201, 221)) / 20)
    assert last["GAP_PCT_1D"] == pytest.approx(219.5 / 219 - 1) and last["CLOSE_LOCATION"] == 0.5
    assert all(last[c] is True for c in ("ABOVE_SMA_20", "ABOVE_SMA_50", "ABOVE_SMA_200", "SMA_20_ABOVE_50", "SMA_50_ABOVE_200"))
    assert last["PRIOR_HIGH_20"] == 221e4


def test_warm_up_boundaries(spark):
    rows = frame(spark, golden(spark, 201))
    for code, first in (("SMA_20", 19), ("RSI_14", 14), ("ATR_14", 13), ("VOLATILITY_20", 20), ("SMA_200", 199), ("PRIOR_HIGH_20", 20)):
        assert rows[first - 1][code] is None and rows[first][code] is not None


def test_rsi_edges(spark):
    assert frame(spark, golden(spark, 16, close=lambda i: 50), ("RSI_14",))[-1]["RSI_14"] == 50
    assert frame(spark, golden(spark, 16, close=lambda i: 100 - i), ("RSI_14",))[-1]["RSI_14"] == 0


def test_zero_denominators_are_null(spark):
    zero = spark.createDataFrame([bar(1, d, 0, 0, 0, 0, 0) for d in days(21)], BAR)
    last = frame(spark, zero)[-1]
    for code in ("RET_1D", "ATR_PCT_14", "VOLUME_RATIO_20", "INTRADAY_RETURN", "RANGE_PCT", "CLOSE_LOCATION", "AVG_TRADED_VALUE_20",
                 "VOLATILITY_20", "DISTANCE_SMA_20"):
        assert last[code] is None


def test_selected_codes_equal_full_frame_and_order_of_rows_is_irrelevant(spark):
    bars = golden(spark, 230, close=lambda i: 100 + (i % 11) * 17.25)
    codes = ("RSI_14", "ATR_PCT_14", "SMA_50", "ABOVE_SMA_200")
    full = [tuple(r[c] for c in codes) for r in frame(spark, bars)]
    some = [tuple(r[c] for c in codes) for r in frame(spark, bars.orderBy(F.rand(3)), codes)]
    assert full == some


def test_unavailable_reason(spark):
    codes = ("SMA_20", "CLOSE_LOCATION")
    flat = spark.createDataFrame([bar(1, d, 5, 5, 5, 5) for d in days(20)], BAR)
    rows = unavailable_reasons(feature_frame(flat, codes), codes).orderBy("session").collect()
    assert rows[0]["unavailable"] == {"SMA_20": "Requires 20 observations", "CLOSE_LOCATION": "Undefined for available inputs"}
    assert set(rows[19]["unavailable"]) == {"CLOSE_LOCATION"}


def test_one_shuffle_for_all_window_features(spark, tmp_path):
    path = str(tmp_path / "bars")
    golden(spark, 30).write.parquet(path)
    plan = feature_frame(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("cut", [120, 150, 180])
def test_later_rows_and_revisions_never_change_earlier_history(spark, cut):
    sessions = days(200)
    rows = [bar(1, d, 100 + i % 7, 103 + i % 7, 98 + i % 5, 100 + i % 9, 1000 + i) for i, d in enumerate(sessions)]
    acts = [action(1, 1, "STOCK_SPLIT", sessions[100], "2", "1", noon(sessions[90])),
            action(2, 1, "STOCK_SPLIT", sessions[100], "5", "2", noon(sessions[140]), 1),
            action(3, 1, "BONUS", sessions[160], "1", "1", noon(sessions[170]))]
    codes = ("RET_20D", "SMA_50", "EMA_20", "ATR_14", "AVG_VOLUME_20")

    def run(upto):
        kept = [a for a in acts if a[6] <= noon(sessions[upto])]
        out = historical_features(
            spark.createDataFrame(rows[:upto + 1], BAR), calendar(spark, sessions), actions(spark, kept), start=sessions[0],
            end=sessions[cut], codes=codes)
        return {r["session"]: tuple(r[c] for c in codes) for r in out.where(F.col("session") <= sessions[cut]).collect()}

    assert run(cut) == run(199)


def test_recursive_codes_ship_and_compute_only_what_is_asked(spark):
    plan = feature_frame(golden(spark, 30), ["RSI_14"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    for unread in ("stddev_samp", "_sum_volume", "_sum_close", "_high20", "_lag20"):
        assert unread not in plan, unread
