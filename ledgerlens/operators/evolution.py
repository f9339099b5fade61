"""Entity-by-month aggregates, matched comparison windows and contributions.

Rows are reduced once to (entity, month). Consecutive months of an entity are
paired by ``lead`` over that reduced frame, so no self-join is needed, and an
entity contributes at most one row per calendar month to any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comparison import month_label, month_ordinal, with_comparison
from ..functions.numeric import finite
from .rankings import labelled_groups
from .temporal import compare_series

# Fixed values.
MIN_COVERAGE = 0.95
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 1e-9, 1e-6
STABLE_ID, CONFIRMED_ALIAS, TEXT = "stable_id", "confirmed_alias", "text"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def entity_months(
    df: DataFrame, date: str, metrics: dict[str, str], id_column: str | None, label_column: str | None
) -> DataFrame:
    """(entity, ord, label, records, per metric ``s_``/``n_``).

    Rows without identity form the NULL entity and rows without date the NULL
    month, so coverage and undated shares come from this frame, not from the rows.
    """
    identity = _c(id_column or label_column)
    if dict(df.dtypes)[id_column or label_column] == "string":
        identity = F.when(F.trim(identity) != "", identity)
    label = _c(label_column).cast("string") if label_column else F.lit(None).cast("string")
    slim = df.select(
        identity.alias("entity"), month_ordinal(_c(date)).alias("ord"), label.alias("label"),
        *[finite(_c(c).try_cast("double")).alias(m) for m, c in metrics.items()],
    )
    aggs = [("records", F.count(F.lit(1)), F.sum)]
    for m in metrics:
        aggs += [(f"s_{m}", F.sum(m), F.sum), (f"n_{m}", F.count(m), F.sum)]
    keys = {"entity": F.col("entity"), "ord": F.col("ord")}
    return labelled_groups(slim, keys, F.col("label") if label_column else None, None, aggs)


def with_identity(months: DataFrame, has_id: bool, has_label: bool, merged: DataFrame | None = None) -> DataFrame:
    """Adds one label per entity and where its identity comes from.

    ``merged`` lists canonical values confirmed by a merge decision.
    """
    text = F.col("entity").cast("string")
    whole = Window.partitionBy("entity")
    label = F.coalesce(F.min("label").over(whole), text) if has_id and has_label else text
    out = months.withColumn("label", label)
    if has_id:
        return out.withColumn("identity_source", F.lit(STABLE_ID))
    if merged is None:
        return out.withColumn("identity_source", F.lit(TEXT))
    known = merged.select(F.col("canonical_value").alias("_canon")).distinct()
    return out.join(known, text == F.col("_canon"), "left").withColumn(
        "identity_source", F.when(F.col("_canon").isNotNull(), CONFIRMED_ALIAS).otherwise(TEXT)).drop("_canon")


def _entries(metrics: list[str], *fields: str) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{f}_{m}").alias(f) for f in fields]) for m in metrics]))


def period_coverage(months: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, ord): records, valid and identified values, population, sum and negative groups."""
    long = months.where(F.col("ord").isNotNull()).select("entity", "ord", "records", _entries(metrics, "s", "n"))
    known = F.col("entity").isNotNull()
    return long.groupBy("metric", "ord").agg(
        F.sum("records").alias("records"), F.sum("n").alias("valid"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("identified_valid"),
        F.count_if(known).alias("population"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("sum"),
        F.count_if(F.col("s") < 0).alias("negative_groups"),
    )


def comparison_windows(coverage: DataFrame, series: DataFrame, undated_share: Column) -> DataFrame:
    """Consecutive months whose entity sums reconcile with the global series; one row each."""
    cov = lambda s: coverage.select("metric", F.col("ord").alias(f"ord_{s}"),
                                    *[F.col(c).alias(f"{c}_{s}") for c in coverage.columns if c not in ("metric", "ord")])
    steps = compare_series(series).where(F.col("comparable") & F.col("continuous")).select(
        "metric", F.col("ord").alias("ord_after"), (F.col("ord") - 1).alias("ord_before"),
        "previous_period", "current_period", "series_magnitude", F.col("reference_magnitude").alias("global_magnitude"),
        F.col("previous_value").alias("global_before"), F.col("current_value").alias("global_after"),
        F.col("absolute_change").alias("global_change"),
    )

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * RELATIVE_TOLERANCE, F.lit(ABSOLUTE_TOLERANCE))

    joined = steps.join(cov("before"), ["metric", "ord_before"]).join(cov("after"), ["metric", "ord_after"])
    full = lambda s: (F.col(f"records_{s}") > 0) & (F.try_divide(F.col(f"identified_valid_{s}"), F.col(f"records_{s}")) >= MIN_COVERAGE)
    return joined.where(
        close(F.col("sum_before"), F.col("global_before")) & close(F.col("sum_after"), F.col("global_after"))
    ).withColumn("complete_fields", full("before") & full("after") & (undated_share <= 1 - MIN_COVERAGE))


def series_of(months: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, ord, period, value, records) of all entities together, from their months instead of the rows."""
    sums = months.where(F.col("ord").isNotNull()).groupBy("ord").agg(
        *[F.sum(f"s_{m}").alias(f"s_{m}") for m in metrics], *[F.sum(f"n_{m}").alias(f"n_{m}") for m in metrics])
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"s_{m}").alias("value"), F.col(f"n_{m}").alias("records")) for m in metrics])
    return sums.select("ord", F.inline(entries)).where("records > 0").select("metric", "ord", month_label(F.col("ord")).alias("period"), "value", "records")


def matched_pairs(months: DataFrame, metrics: list[str]) -> DataFrame:
    """(entity, metric, before, after) for entities seen in two adjacent months."""
    w = Window.partitionBy("entity").orderBy("ord")
    whole = Window.partitionBy("entity")

    def magnitude(m: str) -> Column:
        size = F.abs(F.col(f"s_{m}"))
        return F.coalesce(F.median(F.when(size > 0, size)).over(whole), F.lit(0.0)).alias(f"ref_{m}")

    # an entity's magnitude comes from the rows that are shuffled for the steps anyway
    seen = months.where(F.col("entity").isNotNull() & F.col("ord").isNotNull())
    stepped = seen.select(
        "entity", "label", "identity_source", "ord", "records", F.lead("ord").over(w).alias("next_ord"),
        F.lead("records").over(w).alias("records_b"), *[magnitude(m) for m in metrics],
        *[F.col(f"s_{m}").alias(f"a_{m}") for m in metrics], *[F.col(f"n_{m}").alias(f"va_{m}") for m in metrics],
        *[F.lead(f"s_{m}").over(w).alias(f"b_{m}") for m in metrics], *[F.lead(f"n_{m}").over(w).alias(f"vb_{m}") for m in metrics],
    ).where(F.col("next_ord") == F.col("ord") + 1)
    return stepped.select(
        "entity", "label", "identity_source", F.col("ord").alias("ord_before"),
        F.col("records").alias("records_before"), F.col("records_b").alias("records_after"),
        _entries(metrics, "a", "b", "va", "vb", "ref"),
    )


def entity_changes(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Guarded change of every matched entity inside every accepted window, with shares.

    The windows are one row per metric and month, a size set by the calendar.
    """
    keep = [c for c in windows.columns if not c.startswith("records_")]
    rows = pairs.join(F.broadcast(windows.select(*keep)), ["metric", "ord_before"])
    share = lambda v, total, neg: F.when((F.col(total) > 0) & (F.col(neg) == 0), F.col(v) / F.col(total) * 100)
    compared = with_comparison(rows, F.col("a"), F.col("b"), F.col("ref"), F.col("ord_before"), F.col("ord_after"), True)
    return compared.where("comparable").select(
        "metric", "entity", "label", "identity_source", "previous_period", "current_period", "ord_before",
        "records_before", "records_after", F.col("va").alias("valid_before"), F.col("vb").alias("valid_after"),
        "previous_value", "current_value", "absolute_change", "percentage_change", "percentage_valid", "reason",
        share("a", "global_before", "negative_groups_before").alias("previous_share"),
        share("b", "global_after", "negative_groups_after").alias("current_share"),
        "series_magnitude", "global_magnitude", "global_before", "global_after", "global_change", "complete_fields",
    )


def window_movements(changes: DataFrame) -> DataFrame:
    """(metric, window): gross matched growth and decline and what they leave unexplained."""
    d = F.col("absolute_change")
    sums = changes.groupBy("metric", "ord_before").agg(
        F.sum(F.when(d > 0, d).otherwise(0.0)).alias("gross_growth"),
        (-F.sum(F.when(d < 0, d).otherwise(0.0))).alias("gross_decline"),
        F.count(F.lit(1)).alias("matched"), F.first("global_change").alias("global_change"),
        F.first("previous_period").alias("previous_period"), F.first("current_period").alias("current_period"),
    )
    return sums.withColumn("unexplained", F.col("global_change") - (F.col("gross_growth") - F.col("gross_decline")))


def window_absences(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """(metric, window): entities new, gone or without a value. Absence is never a zero."""
    matched = pairs.groupBy("metric", "ord_before").agg(
        F.count(F.lit(1)).alias("both"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing_metric"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return windows.join(matched, ["metric", "ord_before"], "left").select(
        "metric", "ord_before", "previous_period", "current_period",
        (F.col("population_after") - zero("both")).alias("newly_observed"),
        (F.col("population_before") - zero("both")).alias("not_observed_current"),
        zero("missing_metric").alias("missing_metric"),
    )


def undated_share(months: DataFrame) -> DataFrame:
    """Share of records without a date, one row."""
    return months.agg(F.try_divide(F.sum(F.when(F.col("ord").isNull(), F.col("records")).otherwise(0)), F.sum("records")).alias("share"))
