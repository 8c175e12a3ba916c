"""Predicates, universe scans, rule sets and N-of-M consensus on feature rows.

A missing feature is a third outcome everywhere: statuses are explicit columns, never a bare filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.fixed_values import BOOLEAN_CODES, FEATURE_CODES, RULE_SETS

Filter = tuple  # (feature, operator, value[, upper value])
Rule = tuple[str, str, object]
INSUFFICIENT = "INSUFFICIENT_FEATURE_HISTORY"
COMPARE = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
}


def _all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


# --- S1: predicates ---------------------------------------------------------------------------------------
def predicate(feature: str, operator: str, value, upper=None) -> Column:
    """Null when the feature is null. Booleans take only `=` and a boolean value, numbers only a number."""
    if feature not in FEATURE_CODES:
        raise ValueError(f"unknown feature {feature}")
    flag = feature in BOOLEAN_CODES
    if flag and (operator != "=" or not isinstance(value, bool)):
        raise ValueError(f"{feature} supports only = with a boolean value")
    if not flag and isinstance(value, bool):
        raise ValueError(f"{feature} needs a numeric value")
    col = F.col(feature)
    if flag:
        return col == F.lit(value)
    if operator == "between":
        if upper is None or float(value) > float(upper):
            raise ValueError("between needs value <= upper value")
        return (col >= float(value)) & (col <= float(upper))
    if operator not in COMPARE:
        raise ValueError(f"unknown operator {operator}")
    return COMPARE[operator](col, F.lit(float(value)))


# --- S2: scan -----------------------------------------------------------------------------------------------
def market_scan(members: DataFrame, features: DataFrame, filters: Sequence[Filter], observation_date) -> DataFrame:
    """One row per member: MATCHED, NOT_MATCHED, or UNAVAILABLE (no row on the date, or a null feature)."""
    codes = list(dict.fromkeys(f[0] for f in filters))
    on_date = features.where(F.col("session") == F.lit(observation_date).cast("date"))
    joined = members.select("index_id", "series").distinct().join(
        on_date.select("series", *codes, F.lit(True).alias("_row")), "series", "left")
    unknown = F.col("_row").isNull() | _any([F.col(c).isNull() for c in codes])
    hit = _all([predicate(*f) for f in filters])
    status = F.when(unknown, "UNAVAILABLE").when(hit, "MATCHED").otherwise("NOT_MATCHED")
    return joined.withColumn("status", status).select("index_id", "series", *codes, "status")


def scan_results(scanned: DataFrame, securities: DataFrame) -> DataFrame:
    """Matches only, by case-folded symbol and then key."""
    named = scanned.where(F.col("status") == "MATCHED").join(securities.select("series", "symbol"), "series")
    return named.orderBy(F.lower("symbol"), "series")


def scan_summary(scanned: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return scanned.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("members"), (n("MATCHED") + n("NOT_MATCHED")).alias("evaluated"),
        n("UNAVAILABLE").alias("unavailable"), n("MATCHED").alias("matched"),
    )


# --- S6: parameters -----------------------------------------------------------------------------------------
def rules_for(rule_set: str, overrides: Mapping[str, object] | None = None) -> list[Rule]:
    """(feature, operator, expected) with defaults overlaid; unknown names and values out of bounds are refused."""
    overrides = dict(overrides or {})
    rows = RULE_SETS[rule_set]
    unknown = set(overrides) - {r[2] for r in rows}
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    rules = []
    for feature, operator, name, default, lowest, highest in rows:
        value = overrides.get(name, default)
        if isinstance(default, bool):
            if not isinstance(value, bool):
                raise ValueError(f"{name} needs a boolean")
        else:
            if isinstance(value, bool):
                raise ValueError(f"{name} needs a number")
            value = Decimal(str(value))
            if not value.is_finite() or not Decimal(lowest) <= value <= Decimal(highest):
                raise ValueError(f"{name} must lie in [{lowest}, {highest}]")
        rules.append((feature, operator, value))
    return rules


def required_codes(*rule_lists: Sequence[Rule]) -> list[str]:
    return list(dict.fromkeys(r[0] for rules in rule_lists for r in rules))


def observed_on(members: DataFrame, features: DataFrame, observation_date) -> DataFrame:
    """Members with their feature row of exactly that date; a member without one keeps null features."""
    on_date = features.where(F.col("session") == F.lit(observation_date).cast("date"))
    return members.select("index_id", "series").distinct().join(on_date, "series", "left")


# --- S3-S5: rule sets -----------------------------------------------------------------------------------------
def _number(value) -> float:
    return float(value)


def conditions(rules: Sequence[Rule]) -> Column:
    """array<struct<feature, operator, expected, actual, passed>>; null never passes, booleans show as 1 and 0."""
    return F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit(op).alias("operator"), F.lit(_number(v)).alias("expected"),
            F.col(f).cast("double").alias("actual"), F.coalesce(predicate(f, op, v), F.lit(False)).alias("passed"),
        )
        for f, op, v in rules
    ])


def evaluate_rules(features: DataFrame, rules: Sequence[Rule], name: str) -> DataFrame:
    """Add conditions, passed count, missing codes, matched and a one-line explanation."""
    codes = required_codes(rules)
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in codes]), lambda c: c.isNotNull())
    out = features.withColumn("conditions", conditions(rules)).withColumns({
        "missing": missing,
        "passed_count": F.size(F.filter("conditions", lambda c: c["passed"])),
        "matched": F.forall("conditions", lambda c: c["passed"]),
        "_failed": F.try_element_at(F.filter("conditions", lambda c: ~c["passed"]), F.lit(1)),
    })
    shown = lambda c: F.format_number(c, 8)
    explanation = (
        F.when(F.col("matched"), F.format_string(f"Matched because %d of {len(rules)} {name} conditions passed.",
                                                 F.col("passed_count")))
        .when(F.col("_failed.actual").isNull(), "Not matched because required feature history was unavailable.")
        .otherwise(F.concat(
            F.lit("Not matched because "), F.col("_failed.feature"), F.lit(" was "), shown(F.col("_failed.actual")),
            F.lit(" while the rule requires "), F.col("_failed.operator"), F.lit(" "),
            shown(F.col("_failed.expected")), F.lit("."),
        ))
    )
    return out.withColumn("explanation", explanation).drop("_failed")


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("matched").alias("matched"),
        F.count_if(F.size("missing") > 0).alias("unavailable"),
    )


# --- S10-S12: consensus -----------------------------------------------------------------------------------------
def rule_status(rules: Sequence[Rule]) -> Column:
    missing = _any([F.col(c).isNull() for c in required_codes(rules)])
    hit = _all([predicate(*r) for r in rules])
    return F.when(missing, INSUFFICIENT).when(hit, "MATCHED").otherwise("NOT_MATCHED")


def consensus(statuses: Sequence[Column], required: int) -> Column:
    matched = sum((s == "MATCHED").cast("int") for s in statuses)
    unknown = sum((s == INSUFFICIENT).cast("int") for s in statuses)
    return F.when(matched >= required, "MATCHED").when(matched + unknown >= required, INSUFFICIENT).otherwise(
        "NOT_MATCHED")


def evaluate_composition(rows: DataFrame, components: Mapping[str, Sequence[Rule]], required: int) -> DataFrame:
    """Add one status column per component, the counts and the consensus `status`."""
    if not 2 <= len(components) <= 10 or not 1 <= required <= len(components):
        raise ValueError("a composition has 2-10 components and needs 1..m of them")
    out = rows.withColumns({f"status_{n.lower()}": rule_status(r) for n, r in components.items()})
    statuses = [F.col(f"status_{n.lower()}") for n in components]
    return out.withColumns({
        "matched_count": sum((s == "MATCHED").cast("int") for s in statuses),
        "insufficient_count": sum((s == INSUFFICIENT).cast("int") for s in statuses),
        "status": consensus(statuses, required),
    })


# --- S13-S15: history ---------------------------------------------------------------------------------------------
def historical_signals(history: DataFrame, members: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Setups (index_id, series, session): members with a feature row of that day that passes every rule.

    The rules run before the join, so only matches meet the membership grid.
    """
    hits = history.where(rule_status(rules) == "MATCHED").select("series", "session", "available_at")
    return members.join(hits, ["series", "session"])


def historical_composition(
    history: DataFrame, members: DataFrame, components: Mapping[str, Sequence[Rule]], required: int,
) -> DataFrame:
    """An outcome for every session and active member; a member without a row that day is insufficient."""
    codes = required_codes(*components.values())
    rows = members.join(history.select("series", "session", *codes), ["series", "session"], "left")
    return evaluate_composition(rows, components, required).drop(*codes)


def signal_diagnostics(outcomes: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(
        F.count(F.lit(1)).alias("evaluated"), n("MATCHED").alias("matched"), n("NOT_MATCHED").alias("non_matches"),
        n(INSUFFICIENT).alias("insufficient"),
    )


def signal_preview(outcomes: DataFrame, limit: int) -> DataFrame:
    """The first outcomes by session, series and index (a limit per partition before the shuffle), each with `truncated`: are there more?"""
    order = [c for c in ("session", "series", "index_id") if c in outcomes.columns]
    some = outcomes.orderBy(*order).limit(limit + 1)
    return (some.withColumns({"_k": F.row_number().over(Window.orderBy(*order)), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
            .where(F.col("_k") <= limit).withColumn("truncated", F.col("_n") > limit).drop("_k", "_n"))
