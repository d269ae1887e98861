"""Questions about a ranking, answered from the histogram of rounded scores.

Risk scores have four decimals, so there are at most 10,001 distinct values.
Ranks, thresholds and curves come from that small table instead of a global
sort or an unpartitioned row number over the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.session import materialize

TIE_ROWS = 1_000_000  # of equal score that one task puts in order


def is_attack(label: Column) -> Column:
    return (label != C.NORMAL).cast("long")


def score_histogram(scored: DataFrame, score: str = "risk_score", truth: Column | None = None) -> DataFrame:
    """``score, n, tp, cum_n, cum_tp`` by descending score."""
    truth = is_attack(F.col("label")) if truth is None else truth
    bins = scored.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(truth.cast("long")).alias("tp")
    )
    falling = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumns({"cum_n": F.sum("n").over(falling), "cum_tp": F.sum("tp").over(falling)})


def top_count(total: Column, share: Column) -> Column:
    """Rows in the top share, at least one."""
    return F.greatest(F.lit(1), F.floor(total * share)).cast("long")


def top_pct_threshold(scored: DataFrame, pct: float, score: str = "risk_score") -> DataFrame:
    """One row: the score of the last event inside the top ``pct`` percent."""
    hist = score_histogram(scored, score, F.lit(0))
    k = top_count(F.max("cum_n").over(Window.partitionBy()), F.lit(pct / 100.0))
    return (
        hist.withColumn("k", k)
        .filter(F.col("cum_n") >= F.col("k"))
        .agg(F.max("score").alias("threshold"), F.max("k").alias("k"))
    )


def pr_curve_points(
    scored: DataFrame, score: str = "risk_score", truth: Column | None = None
) -> DataFrame:
    """Precision and recall at every distinct score, from the highest down."""
    hist = score_histogram(scored, score, truth)
    positives = F.max("cum_tp").over(Window.partitionBy())
    return hist.select(
        "score", "cum_n", "cum_tp",
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
        F.coalesce(F.try_divide(F.col("cum_tp"), positives), F.lit(1.0)).alias("recall"),
    )


def pr_auc(scored: DataFrame, score: str = "risk_score", truth: Column | None = None) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, starting at (0, 1)."""
    falling = Window.orderBy(F.desc("score"))
    step = pr_curve_points(scored, score, truth).select(
        (F.col("recall") - F.lag("recall", 1, 0.0).over(falling)).alias("width"),
        ((F.col("precision") + F.lag("precision", 1, 1.0).over(falling)) / 2).alias("height"),
    )
    return step.agg(F.coalesce(F.sum(F.col("width") * F.col("height")), F.lit(0.0)).alias("pr_auc"))


def precision_at_budget(
    scored: DataFrame, budgets: list[float] = C.BUDGETS, score: str = "risk_score", tie: str = "session_id"
) -> DataFrame:
    """Precision and recall within the top k for each budget share.

    Events above the k-th score count whole.  Of those that share the k-th
    score, the ones with the smallest id fill the remaining places, numbers and
    texts alike.  They are counted in ranges of the id, and one range is put in
    order, so even a score shared by a third of all events needs no global sort.
    """
    hist = score_histogram(scored, score)
    everything = Window.partitionBy()
    shares = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")
    ranked = hist.withColumns(
        {"total": F.max("cum_n").over(everything), "positives": F.max("cum_tp").over(everything)}
    ).select("*", shares)
    k = top_count(F.col("total"), F.col("budget"))
    # One row per budget: the bin in which the k-th event lies.
    edge = (
        ranked.withColumn("k", k)
        .filter((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
        .select(
            "budget", "k", "positives", F.col("score").alias("edge"), "n",
            (F.col("cum_tp") - F.col("tp")).alias("tp_above"),
            (F.col("k") - (F.col("cum_n") - F.col("n"))).alias("places"),
        )
    )
    edges = edge.collect()  # one row per budget
    spark = scored.sparkSession
    places = spark.createDataFrame(edges, edge.schema)
    ties = {r.edge: r.n for r in edges if r.places < r.n}
    tied = scored.filter(F.col(score).isin(list(ties))).select(
        F.col(score).alias("edge"), F.col(tie).alias("tie"), is_attack(F.col("label")).alias("tp")
    )
    whole = places.filter(F.col("places") == F.col("n")).join(
        hist.select(F.col("score").alias("edge"), F.col("tp").alias("hit")), "edge"
    ).select("budget", "hit")
    cut = _first_of_ties(tied, places, sum(ties.values())) if ties else whole.limit(0)
    inside = whole.unionByName(cut).groupBy("budget").agg(F.sum("hit").alias("tp_tied"))
    hits = F.col("tp_above") + F.coalesce(F.col("tp_tied"), F.lit(0))
    return places.join(inside, "budget", "left").select(
        "budget",
        F.col("k").alias("top_k_count"),
        S.round4(hits / F.col("k")).alias("precision"),
        S.round4(hits / F.greatest(F.lit(1), F.col("positives"))).alias("recall"),
    )


def _first_of_ties(tied: DataFrame, places: DataFrame, rows: int) -> DataFrame:
    """``budget, hit``: attacks among the first ``places`` rows of each budget's edge, by id.

    The tied rows are stored once in ranges of the id, cut by its quantiles, so
    every range holds about ``TIE_ROWS`` of them whatever the ids look like.
    Ranges before the cut count whole; only the one that it divides is ordered.
    """
    ranges = max(1, -(-rows // TIE_ROWS))
    stored = materialize(
        tied.repartitionByRange(ranges, "edge", "tie").withColumn("range", F.spark_partition_id()), "ties"
    )
    counts = stored.groupBy("edge", "range").agg(F.count(F.lit(1)).alias("m"), F.sum("tp").alias("hit"))
    earlier = Window.partitionBy("edge").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    # A few rows on both sides: budgets, and ranges of the tied scores.
    placed = before.join(F.broadcast(places.select("budget", "edge", "places")), "edge").withColumn(
        "left", F.col("places") - F.col("before")
    )
    whole = placed.filter(F.col("left") >= F.col("m")).select("budget", "hit")
    cut = placed.filter((F.col("left") > 0) & (F.col("left") < F.col("m"))).select("budget", "edge", "range", "left")
    rest = stored.join(F.broadcast(cut), ["edge", "range"])  # at most one row per budget
    rank = F.row_number().over(Window.partitionBy("budget").orderBy("tie"))
    last = rest.withColumn("rank", rank).filter(F.col("rank") <= F.col("left"))
    return whole.unionByName(last.select("budget", F.col("tp").alias("hit")))
