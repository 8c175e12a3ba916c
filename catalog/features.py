"""Feature queries (F1-F38, FX1, FX4) and their SQL."""

from __future__ import annotations

from catalog.sql import part, r8, sql
from pyspark.sql import functions as F

from tapewright.functions import numbers
from tapewright.functions.fixed_values import BOOLEAN_CODES, FEATURE_CODES, MIN_OBSERVATIONS
from tapewright.operators import features as ops
from tapewright.sources import adapters as src

def _avg(col: str, n: int) -> str:
    return (f"CASE WHEN n_obs >= {n} THEN CAST(sum({col}) OVER "
            f"(PARTITION BY series ORDER BY session ROWS {n - 1} PRECEDING) AS DOUBLE) / {n} END")


def _vol(n: int) -> str:
    over = f"OVER (PARTITION BY series ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(ret) {over} = {n} THEN stddev_samp(ret) {over} * sqrt(252e0) END"


_A20, _A50 = "CAST(2 AS DOUBLE) / 21", "CAST(2 AS DOUBLE) / 51"
_RSI = """CASE WHEN n_obs < 15 THEN NULL WHEN l = 0 THEN CASE WHEN g = 0 THEN 50e0 ELSE 100e0 END
  WHEN g = 0 THEN 0e0 ELSE 100e0 - 100e0 / (1e0 + g / l) END"""


def feature_parts(base: str) -> str:
    """Register the window steps over relation `base`; return the recursive step and `features` itself."""
    part(f"lagged_{base}", (base,), f"""
  SELECT *, row_number() OVER w AS n_obs, lag(close, 1) OVER w AS pc, lag(close, 5) OVER w AS c5,
         lag(close, 10) OVER w AS c10, lag(close, 20) OVER w AS c20, lag(close, 21) OVER w AS c21,
         lag(close, 63) OVER w AS c63, lag(close, 126) OVER w AS c126
  FROM {base} WINDOW w AS (PARTITION BY series ORDER BY session)""")
    part(f"stepped_{base}", (f"lagged_{base}",), f"""
  SELECT *, close / nullif(pc, 0) - 1e0 AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM lagged_{base}""")
    part(f"averaged_{base}", (f"stepped_{base}",), f"""
  SELECT *, {', '.join(f'{_avg("close", n)} AS "SMA_{n}"' for n in (20, 50, 100, 200))},
         {', '.join(f'{_avg("volume", n)} AS "AVG_VOLUME_{n}"' for n in (20, 50))},
         CASE WHEN count(traded_value) OVER (PARTITION BY series ORDER BY session ROWS 19 PRECEDING) = 20
              THEN {_avg("traded_value", 20)} END AS "AVG_TRADED_VALUE_20",
         {_vol(20)} AS "VOLATILITY_20", {_vol(60)} AS "VOLATILITY_60",
         CASE WHEN n_obs > 20 THEN max(high) OVER (PARTITION BY series ORDER BY session
              ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS ph
  FROM stepped_{base}""")
    smooth = f"""smooth AS (
  SELECT series, n_obs, close, CAST(close AS DOUBLE) AS s20, CAST(close AS DOUBLE) AS s50,
         CAST(NULL AS DOUBLE) AS e20, CAST(NULL AS DOUBLE) AS e50, 0e0 AS g, 0e0 AS l,
         CAST(tr AS DOUBLE) AS a
  FROM stepped_{base} WHERE n_obs = 1
  UNION ALL
  SELECT b.series, b.n_obs, b.close, s20 + b.close, s50 + b.close,
         CASE WHEN b.n_obs < 20 THEN NULL WHEN b.n_obs = 20 THEN (s20 + b.close) / 20
              ELSE {_A20} * b.close + (1e0 - {_A20}) * e20 END,
         CASE WHEN b.n_obs < 50 THEN NULL WHEN b.n_obs = 50 THEN (s50 + b.close) / 50
              ELSE {_A50} * b.close + (1e0 - {_A50}) * e50 END,
         CASE WHEN b.n_obs < 15 THEN g + greatest(b.close - s.close, 0)
              WHEN b.n_obs = 15 THEN (g + greatest(b.close - s.close, 0)) / 14
              ELSE (g * 13e0 + greatest(b.close - s.close, 0)) / 14e0 END,
         CASE WHEN b.n_obs < 15 THEN l + greatest(s.close - b.close, 0)
              WHEN b.n_obs = 15 THEN (l + greatest(s.close - b.close, 0)) / 14
              ELSE (l * 13e0 + greatest(s.close - b.close, 0)) / 14e0 END,
         CASE WHEN b.n_obs < 14 THEN a + b.tr WHEN b.n_obs = 14 THEN (a + b.tr) / 14
              ELSE (a * 13e0 + b.tr) / 14e0 END
  FROM smooth s JOIN stepped_{base} b ON b.series = s.series AND b.n_obs = s.n_obs + 1
)"""
    return smooth + f""",
features AS (
  SELECT series, session, n_obs, open, high, low, close, volume, traded_value,
    close / nullif(pc, 0) - 1e0 AS "RET_1D", close / nullif(c5, 0) - 1e0 AS "RET_5D",
    close / nullif(c10, 0) - 1e0 AS "RET_10D", close / nullif(c20, 0) - 1e0 AS "RET_20D",
    close / nullif(c21, 0) - 1e0 AS "MOM_1M_21D", close / nullif(c63, 0) - 1e0 AS "MOM_3M_63D",
    close / nullif(c126, 0) - 1e0 AS "MOM_6M_126D",
    "SMA_20", "SMA_50", "SMA_100", "SMA_200", e20 AS "EMA_20", e50 AS "EMA_50",
    close / nullif("SMA_20", 0) - 1e0 AS "DISTANCE_SMA_20", close / nullif("SMA_50", 0) - 1e0 AS "DISTANCE_SMA_50",
    close / nullif("SMA_200", 0) - 1e0 AS "DISTANCE_SMA_200",
    {_RSI} AS "RSI_14", CAST(tr AS DOUBLE) AS "TRUE_RANGE",
    CASE WHEN n_obs >= 14 THEN a END AS "ATR_14", CASE WHEN n_obs >= 14 THEN a / nullif(close, 0) END AS "ATR_PCT_14",
    "VOLATILITY_20", "VOLATILITY_60", "AVG_VOLUME_20", "AVG_VOLUME_50",
    volume / nullif("AVG_VOLUME_20", 0) AS "VOLUME_RATIO_20", volume / nullif("AVG_VOLUME_50", 0) AS "VOLUME_RATIO_50",
    "AVG_TRADED_VALUE_20", open / nullif(pc, 0) - 1e0 AS "GAP_PCT_1D", close / nullif(open, 0) - 1e0 AS "INTRADAY_RETURN",
    (high - low) / nullif(close, 0) AS "RANGE_PCT", (close - low) / nullif(high - low, 0) AS "CLOSE_LOCATION",
    close > "SMA_20" AS "ABOVE_SMA_20", close > "SMA_50" AS "ABOVE_SMA_50", close > "SMA_200" AS "ABOVE_SMA_200",
    "SMA_20" > "SMA_50" AS "SMA_20_ABOVE_50", "SMA_50" > "SMA_200" AS "SMA_50_ABOVE_200",
    CAST(ph AS DOUBLE) AS "PRIOR_HIGH_20", close / nullif(ph, 0) - 1e0 AS "BREAKOUT_PCT_20"
  FROM averaged_{base} JOIN (SELECT series, n_obs, e20, e50, g, l, a FROM smooth) USING (series, n_obs)
)"""


def with_features(body: str, *needs: str, base: str = "bars", more: str = "") -> str:
    recursive = feature_parts(base)
    return sql(body, f"averaged_{base}", *needs, recursive=recursive + more)


def out_columns(codes) -> str:
    return ", ".join(f'"{c}"' if c in BOOLEAN_CODES else f'{r8(chr(34) + c + chr(34))} AS "{c}"' for c in codes)


def rounded(df, codes):
    keep = [c for c in df.columns if c not in codes]
    return df.select(*keep, *[F.col(c) if c in BOOLEAN_CODES else numbers.r8(F.col(c)).alias(c) for c in codes])


GROUPS = {
    "f01_f04_returns": ("RET_1D", "RET_5D", "RET_10D", "RET_20D"),
    "f05_f07_momentum": ("MOM_1M_21D", "MOM_3M_63D", "MOM_6M_126D"),
    "f08_f11_sma": ("SMA_20", "SMA_50", "SMA_100", "SMA_200"),
    "f12_f13_ema": ("EMA_20", "EMA_50"),
    "f14_f16_distance_sma": ("DISTANCE_SMA_20", "DISTANCE_SMA_50", "DISTANCE_SMA_200"),
    "f17_rsi_14": ("RSI_14",),
    "f18_f20_true_range_atr": ("TRUE_RANGE", "ATR_14", "ATR_PCT_14"),
    "f21_f22_volatility": ("VOLATILITY_20", "VOLATILITY_60"),
    "f23_f27_liquidity": ("AVG_VOLUME_20", "AVG_VOLUME_50", "VOLUME_RATIO_20", "VOLUME_RATIO_50",
                          "AVG_TRADED_VALUE_20"),
    "f28_f31_session": ("GAP_PCT_1D", "INTRADAY_RETURN", "RANGE_PCT", "CLOSE_LOCATION"),
    "f32_f36_trend_state": BOOLEAN_CODES,
    "f37_f38_price_structure": ("PRIOR_HIGH_20", "BREAKOUT_PCT_20"),
    "fx1_feature_frame": FEATURE_CODES,
}


def _group(codes):
    def run(spark, sf_dir):
        frame = rounded(ops.feature_frame(src.bars(spark, sf_dir), codes), codes)
        return frame.withColumn("session", F.col("session").cast("string"))
    return run


def _unavailable(spark, sf_dir):
    codes = ("RET_20D", "SMA_200", "RSI_14", "AVG_TRADED_VALUE_20", "CLOSE_LOCATION")
    frame = ops.unavailable_reasons(ops.feature_frame(src.bars(spark, sf_dir), codes), codes)
    rows = frame.select("series", "session", F.explode("unavailable").alias("code", "reason"))
    return rows.groupBy("code", "reason").agg(
        F.count(F.lit(1)).alias("rows"), F.min("session").cast("string").alias("first_session"),
        F.countDistinct("series").alias("series_count"),
    )


QUERIES = {**{name: _group(codes) for name, codes in GROUPS.items()}, "fx4_unavailable_reason": _unavailable}
ORACLES = {
    name: with_features(f"SELECT series, CAST(session AS VARCHAR) AS session, n_obs, {out_columns(codes)} FROM features")
    for name, codes in GROUPS.items()
}
ORACLES["fx4_unavailable_reason"] = with_features(
    "SELECT code, reason, count(*) AS rows, CAST(min(session) AS VARCHAR) AS first_session,"
    " count(DISTINCT series) AS series_count FROM ("
    + " UNION ALL ".join(
        f"""SELECT series, session, '{c}' AS code, CASE WHEN n_obs < {MIN_OBSERVATIONS[c]}
            THEN 'Requires {MIN_OBSERVATIONS[c]} observations' ELSE 'Undefined for available inputs' END AS reason
            FROM features WHERE "{c}" IS NULL"""
        for c in ("RET_20D", "SMA_200", "RSI_14", "AVG_TRADED_VALUE_20", "CLOSE_LOCATION")
    ) + ") GROUP BY code, reason")
