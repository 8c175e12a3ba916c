"""Universe scan end to end: latest features of every series, then predicates, ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.asof_features import latest_features
from tapewright.operators.pit import members_as_of
from tapewright.operators.scan import market_scan


def scan_universe(
    bars: DataFrame, calendar: DataFrame, actions: DataFrame, memberships: DataFrame, filters: Sequence[tuple],
    observation_date, as_of: Column, policy: str = "ADJUSTED",
) -> DataFrame:
    """One status per member on the date. Only the features the filters name are computed."""
    codes = list(dict.fromkeys(f[0] for f in filters))
    rows = latest_features(bars, calendar, actions, as_of=as_of, observation_date=observation_date, policy=policy, codes=codes)
    return market_scan(members_as_of(memberships, observation_date), rows, filters, observation_date)


def ranked_matches(scanned: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """All matches in order; a limit is the page a caller asks for."""
    ranked = scanned.where(F.col("status") == "MATCHED").orderBy(F.col(by).desc(), "series")
    return ranked if limit is None else ranked.limit(limit)
