"""Corporate actions: revision chains, factors, adjusted prices and point-in-time adjusted features.

A series has few actions; they travel as one small array beside its bars (same shuffle key as the feature
windows), so adjusting never multiplies rows except for the regimes of A4 that differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import FEATURE_CODES
from tapewright.operators.features import feature_frame
from tapewright.operators.pit import without_superseded
from tapewright.session import cut_lineage

PRICE_COLUMNS = ("open", "high", "low", "close")
FACTOR = "decimal(19,18)"
SHARE_CHANGES = ("STOCK_SPLIT", "BONUS")


# --- revision chains ----------------------------------------------------------------------------------------
def resolve_revisions(actions: DataFrame) -> DataFrame:
    return without_superseded(actions, "id", "supersedes_id")


def actions_as_of(actions: DataFrame, as_of: Column, after=None, through=None) -> DataFrame:
    """Known by `as_of`, revisions resolved first, then cut to ex dates in (after, through]."""
    rows = resolve_revisions(actions.where(F.col("available_at") <= as_of))
    if after is not None:
        rows = rows.where(F.col("ex_date") > F.lit(after).cast("date"))
    if through is not None:
        rows = rows.where(F.col("ex_date") <= F.lit(through).cast("date"))
    return rows


def chain_roots(actions: DataFrame) -> DataFrame:
    """(id, root, cyclic): pointer doubling over the supersedes links, one join per doubling of the chain length.

    In every round the unresolved row nearest to a root resolves, so a round that resolves nothing has only rows
    of a cycle left.
    """
    present = actions.select("id")
    links = actions.select("id", F.col("supersedes_id").alias("up"))
    kept = links.join(present.withColumnRenamed("id", "up"), "up", "left_semi").select("id", "up")
    state = cut_lineage(
        present.join(kept, "id", "left")
        .select("id", F.coalesce("up", "id").alias("root"), F.col("up").isNull().alias("done"))
    )
    unresolved, before = state.where(~F.col("done")).count(), -1
    while unresolved and unresolved != before:
        target = state.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("done").alias("next_done"))
        moved = state.where(~F.col("done")).join(target, "root").select(
            "id", F.col("next").alias("root"), F.col("next_done").alias("done")
        )
        state = cut_lineage(state.where("done").unionByName(moved))
        unresolved, before = state.where(~F.col("done")).count(), unresolved
    return state.select("id", F.when(F.col("done"), F.col("root")).alias("root"), (~F.col("done")).alias("cyclic"))


def revision_violations(actions: DataFrame) -> DataFrame:
    """Self links, links across series, and cycles."""
    prior = actions.select(F.col("id").alias("supersedes_id"), F.col("series").alias("prior_series"))
    linked = actions.join(prior, "supersedes_id")
    own = actions.where(F.col("id") == F.col("supersedes_id")).select("id", F.lit("SELF_LINK").alias("violation"))
    cross = linked.where(F.col("series") != F.col("prior_series")).select(
        "id", F.lit("SERIES_CHANGED").alias("violation"))
    cycle = chain_roots(actions).where("cyclic").select("id", F.lit("CYCLE").alias("violation"))
    return own.unionByName(cross).unionByName(cycle)


def chain_closure(actions: DataFrame, end) -> DataFrame:
    """Actions of every chain that has at least one member with an ex date up to `end`."""
    rooted = actions.join(chain_roots(actions), "id")
    wanted = rooted.groupBy("root").agg(F.min("ex_date").alias("_first")).where(
        F.col("_first") <= F.lit(end).cast("date")).select("root")
    return rooted.join(wanted, "root", "left_semi").select(*actions.columns)


# --- factors and adjusted prices ------------------------------------------------------------------------------
def factor(kind: Column, num: Column, den: Column) -> Column:
    bad = num.isNull() | den.isNull() | (num <= 0) | (den <= 0)
    made = F.when(kind == "STOCK_SPLIT", (den / num).cast(FACTOR)).when(
        kind == "BONUS", (den / (den + num)).cast(FACTOR)).otherwise(F.lit(1).cast(FACTOR))
    return F.when(bad, F.raise_error(F.lit("action needs a positive ratio")).cast(FACTOR)).otherwise(made)


def action_factor(actions: DataFrame) -> DataFrame:
    return actions.withColumn("factor", factor(F.col("type"), F.col("num"), F.col("den")))


def _arrays(actions: DataFrame, *fields: str) -> DataFrame:
    changes = action_factor(actions.where(F.col("type").isin(*SHARE_CHANGES)))
    return changes.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("ex_date", "available_at", "id", "factor", *fields))).alias("_actions")
    )


def _apply(bars: DataFrame, listed: Column) -> DataFrame:
    product = F.aggregate(
        F.filter(F.coalesce(listed, F.array()), lambda a: F.col("session") < a["ex_date"]),
        F.lit(1).cast(FACTOR), lambda acc, a: (acc * a["factor"]).cast(FACTOR),
    )
    scaled = bars.withColumn("adjustment_factor", product)
    f = F.col("adjustment_factor")
    return scaled.withColumns({
        **{c: F.round(F.col(c).cast("decimal(19,0)") * f, 0).cast("bigint") for c in PRICE_COLUMNS},
        "volume": F.round(F.col("volume").cast("decimal(19,0)") / f, 0).cast("bigint"),
    })


def adjust_prices(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Every listed split and bonus applied to the sessions before its ex date; traded value is left alone."""
    joined = bars.join(_arrays(actions), "series", "left")
    return _apply(joined, F.col("_actions")).select(*bars.columns, "adjustment_factor")


def adjusted_view(bars: DataFrame, actions: DataFrame, as_of: Column, start, end) -> DataFrame:
    """Prices of [start, end] seen with the actions known now, after the first and through the last price shown."""
    shown = bars.where(
        (F.col("session") >= F.lit(start).cast("date")) & (F.col("session") <= F.lit(end).cast("date")))
    bounds = shown.groupBy("series").agg(F.min("session").alias("_from"), F.max("session").alias("_to"))
    known = actions_as_of(actions, as_of).join(bounds, "series").where(
        (F.col("ex_date") > F.col("_from")) & (F.col("ex_date") <= F.col("_to")))
    return adjust_prices(shown, known)


# --- point-in-time adjusted features ----------------------------------------------------------------------------
def action_regimes(bars: DataFrame, actions: DataFrame, resolved: bool = False) -> DataFrame:
    """Add `regime`: the share changes that count on each day.

    `resolved=False` (a series over time): known at the day's own close, and not replaced by a revision known
    then. `resolved=True` (one request): `actions` are already those known at the request's as_of.
    """
    later = actions.where(F.col("supersedes_id").isNotNull()).groupBy(F.col("supersedes_id").alias("id")).agg(
        F.min("available_at").alias("replaced_at"))
    listed = _arrays(actions.join(later, "id", "left"), "replaced_at")
    close = F.col("available_at")

    def counts(a: Column) -> Column:
        by_date = a["ex_date"] <= F.col("session")
        if resolved:
            return by_date
        return by_date & (a["available_at"] <= close) & (a["replaced_at"].isNull() | (a["replaced_at"] > close))

    regime = F.filter(F.coalesce(F.col("_actions"), F.array()), counts)
    return bars.join(listed, "series", "left").withColumn("regime", regime).drop("_actions").withColumn(
        "regime_id", F.concat_ws(",", F.transform("regime", lambda a: a["id"].cast("string"))))


def pit_adjusted_frame(
    bars: DataFrame, actions: DataFrame, codes: Sequence[str] = FEATURE_CODES, resolved: bool = False,
) -> DataFrame:
    """Features of day D on prices adjusted only by what counted on D; earlier rows are never rewritten.

    `bars` needs `available_at` (the close). A series' history is repeated once per regime it went through, up to
    that regime's last day, and each regime keeps its own days.
    """
    marked = action_regimes(bars, actions, resolved)
    regimes = marked.groupBy("series", "regime_id").agg(
        F.max("session").alias("_until"), F.any_value("regime").alias("_regime"))
    history = marked.drop("regime").withColumnRenamed("regime_id", "_own").join(regimes, "series").where(
        F.col("session") <= F.col("_until"))
    adjusted = _apply(history, F.col("_regime"))
    frame = feature_frame(adjusted, codes, keys=("series", "regime_id"), keep=("_own", "available_at"))
    return frame.where(F.col("_own") == F.col("regime_id")).drop("_own")
