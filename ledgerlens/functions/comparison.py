"""Guarded comparison of two amounts, usable on any pair of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import finite

# Fixed value: a base under this share of the series magnitude gives no percentage.
LOW_BASE_SHARE = 0.05


def month_ordinal(ts: Column) -> Column:
    """Month number on a continuous axis."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_label(ordinal: Column) -> Column:
    """``yyyy-MM`` text of a month number."""
    return F.format_string(
        "%04d-%02d",
        F.floor(ordinal / 12).cast("int"),
        (ordinal - F.floor(ordinal / 12) * 12 + 1).cast("int"),
    )


def period_ordinal(period: Column, granularity: str = "M") -> Column:
    """Position of a month, quarter or year label; NULL when malformed."""
    text = period.cast("string")
    year = F.substring(text, 1, 4).try_cast("int")
    if granularity == "M":
        valid = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
        value = year * 12 + F.substring(text, 6, 2).try_cast("int") - 1
    elif granularity == "Q":
        valid = text.rlike(r"^\d{4}Q[1-4]$")
        value = year * 4 + F.substring(text, 6, 1).try_cast("int") - 1
    elif granularity in ("Y", "A"):
        valid = text.rlike(r"^\d{4}$")
        value = year
    else:
        raise ValueError(f"unknown granularity {granularity!r}")
    return F.when(valid & (year > 0), value)


def pair_magnitude(a: Column, b: Column) -> Column:
    """Median of the non-zero absolute values of a pair."""
    x, y = F.abs(a), F.abs(b)
    return (
        F.when((a != 0) & (b != 0), x / 2 + y / 2)
        .when(a != 0, x)
        .when(b != 0, y)
        .otherwise(F.lit(0.0))
    )


COMPARISON_FIELDS = (
    "previous_value", "current_value", "absolute_change", "direction", "percentage_change", "percentage_valid",
    "comparable", "reason", "continuous", "reference_magnitude",
)


def with_comparison(
    df: DataFrame,
    previous: Column,
    current: Column,
    reference: Column | None = None,
    previous_ordinal: Column | None = None,
    current_ordinal: Column | None = None,
    require_consecutive: bool = False,
) -> DataFrame:
    """Adds change, direction, percentage and the reason a percentage is withheld.

    Period positions are optional; when given, the later one must follow the
    earlier one, and directly so if ``require_consecutive``. Values are computed
    in steps, each a column of its own: one big expression would repeat its
    parts in every field and outgrow the code size limit of a stage.
    """
    dated = previous_ordinal is not None and current_ordinal is not None
    unknown = F.lit(None).cast("boolean")
    before, after, delta = F.col("_before"), F.col("_after"), F.col("_delta")
    usable, ordered, successive = delta.isNotNull(), F.col("_ordered"), F.col("_successive")
    known = F.coalesce(finite(reference), F.lit(0.0)) if reference is not None else F.lit(0.0)

    out = df.withColumns({
        "_before": finite(previous), "_after": finite(current), "_known": known,
        "_ordered": F.coalesce(current_ordinal > previous_ordinal, F.lit(False)) if dated else F.lit(True),
        "_successive": current_ordinal == previous_ordinal + 1 if dated else unknown,
    })
    out = out.withColumn("_delta", finite(after - before))
    fits = ordered & F.coalesce(successive, F.lit(False)) if dated and require_consecutive else ordered
    out = out.withColumns({
        "_comparable": usable & fits,
        "_continuous": F.when(usable & ordered, successive) if dated else unknown,
        "_percent": finite(F.try_divide(delta, before) * 100),
    })
    out = out.withColumn(
        "_magnitude", F.when(F.col("_comparable"), F.greatest(pair_magnitude(before, after), F.col("_known"))))
    reason = F.when(~usable, "invalid_value").when(~ordered, "invalid_period")
    if dated and require_consecutive:
        reason = reason.when(~successive, "non_consecutive_periods")
    reason = (
        reason.when(before == 0, "zero_reference")
        .when(before < 0, "negative_reference")
        .when(after < 0, "sign_change")
        .when(before < F.col("_magnitude") * LOW_BASE_SHARE, "low_reference_base")
        .when(F.col("_percent").isNull(), "invalid_percentage")
    )
    out = out.withColumn("_reason", reason)
    valid = F.col("_comparable") & F.col("_reason").isNull()
    direction = F.when(delta > 0, "increase").when(delta < 0, "decrease").when(usable, "stable")
    return out.withColumns({
        "previous_value": before, "current_value": after, "absolute_change": delta, "direction": direction,
        "percentage_change": F.when(valid, F.round("_percent", 2)), "percentage_valid": valid,
        "comparable": F.col("_comparable"), "reason": F.col("_reason"), "continuous": F.col("_continuous"),
        "reference_magnitude": F.col("_magnitude"),
    }).drop("_before", "_after", "_known", "_ordered", "_successive", "_delta", "_comparable", "_continuous", "_percent",
            "_magnitude", "_reason")
