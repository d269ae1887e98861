"""How good the detector is: confusion, slices, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.histogram import is_attack, pr_auc, precision_at_budget


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Counts per (truth, predicted) over all true labels, empty cells included.

    Predictions that are no true label are dropped.
    """
    pairs = scored.groupBy(F.col("label").alias("truth"), F.col("predicted_type").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # A handful of labels, so every pair of them fits in one row.
    labels = pairs.agg(F.sort_array(F.collect_set("truth")).alias("labels"))
    cells = labels.select(F.explode("labels").alias("truth"), "labels").select("truth", F.explode("labels").alias("predicted"))
    return cells.join(pairs, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def ratio4(hits: Column, of: Column) -> Column:
    return S.round4(F.coalesce(F.try_divide(hits, of), F.lit(0.0)))


def cold_warm_slice(scored: DataFrame, threshold: float = C.SLICE_THRESHOLD) -> DataFrame:
    """Precision and recall at the threshold, for cold and warm events apart."""
    attack, alarm = is_attack(F.col("label")) == 1, F.col("risk_score") > threshold
    counts = scored.groupBy("is_cold_start").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(attack & alarm).alias("both"),
        F.count_if(alarm).alias("alarms"), F.count_if(attack).alias("attacks"),
    )
    # A slice without events is there with count 0.
    slices = scored.sparkSession.createDataFrame([(False,), (True,)], "is_cold_start boolean")
    return slices.join(counts, "is_cold_start", "left").select(
        "is_cold_start",
        F.coalesce("n", F.lit(0)).alias("n_events"),
        ratio4(F.col("both"), F.col("alarms")).alias("precision"),
        ratio4(F.col("both"), F.col("attacks")).alias("recall"),
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Count and percentage of every value."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per value
    return counts.select("value", "n", S.round_to(F.col("n") * 100.0 / total, 2).alias("pct"))


def attack_distribution(scored: DataFrame) -> DataFrame:
    """Predicted and actual types side by side, in long form."""
    predicted = distribution(scored, "predicted_type").withColumn("side", F.lit("predicted"))
    actual = distribution(scored, "label").withColumn("side", F.lit("actual"))
    return predicted.unionByName(actual).select("side", "value", "n", "pct")


def risk_timeline(scored: DataFrame, entity_id=None, threshold: float = C.SLICE_THRESHOLD) -> DataFrame:
    """An entity's risk over time; by default that of the first insider drift event."""
    if entity_id is None:
        order = F.struct(F.col("label") != "insider_drift", F.col("event_us"), F.col("session_id"))
        entity = scored.agg(F.min_by("entity_id", order)).scalar()
    else:
        entity = F.lit(entity_id)
    return (
        scored.filter(F.col("entity_id") == entity)
        .select(
            "entity_id", "session_id", "event_us", "risk_score",
            (F.col("risk_score") > threshold).alias("above_threshold"),
        )
        .orderBy("event_us", "session_id")
    )


def budget_precision_estimate(budget_table: DataFrame) -> DataFrame:
    """Precision in percent over a grid of budgets from 0.1 % to 10 %.

    Linear between the measured budgets, with fixed slopes outside them.
    """
    shares = sorted(C.BUDGETS)
    at = [F.max(F.when(F.col("budget") == b, F.col("precision"))) * 100 for b in shares]
    points = budget_table.agg(*[p.alias(f"p{i}") for i, p in enumerate(at)])
    grid = points.select("*", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("tenths"))
    pct = F.col("tenths") / 10.0
    known = [(100 * b, F.col(f"p{i}")) for i, b in enumerate(shares)]
    (first, first_p), (last, last_p) = known[0], known[-1]
    below, above = C.BUDGET_SLOPES
    estimate = F.when(pct <= first, first_p + (first - pct) * below)
    for (x, p), (y, q) in zip(known, known[1:]):
        estimate = estimate.when(pct <= y, p + (q - p) * ((pct - x) / (y - x)))
    beyond = F.greatest(F.lit(C.BUDGET_PRECISION_FLOOR), last_p - (pct - last) * above)
    return grid.select(pct.alias("pct"), S.round4(estimate.otherwise(beyond)).alias("estimated_precision"))


def metrics_summary(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every evaluation number as ``metric, key, value``."""

    def rows(df: DataFrame, key: Column, **metrics: Column) -> DataFrame:
        entries = [
            F.struct(F.lit(m).alias("metric"), key.alias("key"), v.cast("double").alias("value"))
            for m, v in metrics.items()
        ]
        return df.select(F.inline(F.array(*entries)))

    n, nothing = F.count(F.lit(1)).alias("n"), F.lit("")
    share = F.concat(F.lit("top_"), F.format_string("%.1f", F.col("budget") * 100), F.lit("%"))
    kind = F.when(F.col("is_cold_start"), "cold_start").otherwise("warm")
    parts = [
        rows(scored.agg(n), nothing, total_test_events=F.col("n")),
        rows(alerts.agg(n), nothing, total_alerts_generated=F.col("n")),
        rows(pr_auc(scored), nothing, pr_auc=S.round4(F.col("pr_auc"))),
        rows(
            precision_at_budget(scored), share,
            top_k_count=F.col("top_k_count"), budget_precision=F.col("precision"), budget_recall=F.col("recall"),
        ),
        rows(
            cold_warm_slice(scored), kind,
            slice_events=F.col("n_events"), slice_precision=F.col("precision"), slice_recall=F.col("recall"),
        ),
    ]
    shares = attack_distribution(scored)
    parts.append(shares.select(F.concat(F.lit("attack_distribution_"), "side").alias("metric"),
                               F.col("value").alias("key"), F.col("n").cast("double").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
