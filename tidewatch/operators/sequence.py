"""Resource transition models and the scores they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.features import ORDER, off_hours_rate, with_previous_resource
from tidewatch.operators.timeline import HotKeys, join_by_key, join_counted, rows_back, running
from tidewatch.session import materialize, together

N = C.SEQUENCE_LENGTH
STEP = ["entity_type", "prev_resource", "resource_accessed"]


# --- fitting -------------------------------------------------------------------


def session_chunks(normal_events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Number each entity's events in runs of ten; single leftovers are dropped.

    A run has a second event exactly when its first event is not the entity's
    last one, so only a run's first event needs to look ahead.
    """
    numbered = running(
        normal_events, ["entity_id"], ORDER,
        sums={"row": F.lit(1)}, lasts={"prev_resource": F.col("resource_accessed")}, hot=hot,
    )
    placed = numbered.withColumns(
        {
            "chunk": F.floor((F.col("row") - 1) / N),
            "position": (F.col("row") - 1) % N,
        }
    )
    # Only the last row of an entity can be a run of its own.
    if hot is None:
        after = F.lead(F.lit(True)).over(Window.partitionBy("entity_id").orderBy(*ORDER))
        seen = placed.withColumn("_more", after)
        return seen.filter((F.col("position") > 0) | F.col("_more").isNotNull()).drop("_more")
    sizes = normal_events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    lonely = sizes.filter((F.col("n") - 1) % N == 0).select("entity_id", F.col("n").alias("row"))
    return placed.join(lonely, ["entity_id", "row"], "left_anti")


def transitions(normal_events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Transition counts inside runs of ten: ``entity_type, prev, cur, c, c_start``.

    ``c_start`` counts the transitions that open a run.  Every run of two or
    more events opens with one, so starts, vocabulary and the number of runs
    all follow from this table.
    """
    numbered = running(
        normal_events, ["entity_id"], ORDER,
        sums={"row": F.lit(1)}, lasts={"_prev": F.struct(F.col("resource_accessed").alias("resource"))}, hot=hot,
    ).withColumn("prev", F.col("_prev.resource"))
    # All runs of an entity belong to the type of its first event.
    typed = normal_events.groupBy("entity_id").agg(
        F.min_by("entity_type", F.struct(*ORDER)).alias("_first_type")
    )
    position = (F.col("row") - 1) % N
    return (
        join_by_key(numbered, typed, "entity_id", hot)
        .withColumn("entity_type", F.coalesce("_first_type", "entity_type"))
        .filter(position > 0)
        .groupBy("entity_type", "prev", F.col("resource_accessed").alias("cur"))
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(position == 1).alias("c_start"))
    )


def states(pairs: DataFrame) -> DataFrame:
    """Per type and resource: outgoing transitions ``t`` and run starts ``starts``."""
    leaving = pairs.select("entity_type", F.col("prev").alias("resource"), F.col("c").alias("t"), "c_start")
    entering = pairs.select(
        "entity_type", F.col("cur").alias("resource"), F.lit(0).alias("t"), F.lit(0).alias("c_start")
    )
    return (
        leaving.unionByName(entering)
        .groupBy("entity_type", "resource")
        .agg(F.sum("t").alias("t"), F.sum("c_start").alias("starts"))
    )


def model_stats(state: DataFrame) -> DataFrame:
    """Per type: vocabulary size ``v`` and number of runs ``n_seq``."""
    return state.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("v"), F.sum("starts").alias("n_seq")
    )


@dataclass(frozen=True)
class SequenceTables:
    """The fitted sequence model: counts only, probabilities follow from them."""

    pairs: DataFrame
    states: DataFrame
    stats: DataFrame
    rates: DataFrame


def fit_sequences(normal_events: DataFrame, hot: HotKeys | None = None) -> SequenceTables:
    pairs, rates = together(
        lambda: materialize(transitions(normal_events, hot), "transitions"),
        lambda: materialize(off_hours_rate(normal_events), "rates"),
    )
    state, stats = together(
        lambda: materialize(states(pairs), "states"),
        lambda: materialize(model_stats(states(pairs)), "stats"),
    )
    return SequenceTables(pairs, state, stats, rates)


def lazy_sequences(normal_events: DataFrame, hot: HotKeys | None = None) -> SequenceTables:
    """The same tables left inside the plan; for one-off use."""
    pairs = transitions(normal_events, hot)
    state = states(pairs)
    return SequenceTables(pairs, state, model_stats(state), off_hours_rate(normal_events))


# --- probabilities -------------------------------------------------------------


def smoothed_log(count: Column, total: Column, v: Column) -> Column:
    alpha = F.lit(C.LAPLACE_ALPHA)
    p = (count + alpha) / (total + alpha * v)
    return F.ln(F.greatest(p, F.lit(C.PROBABILITY_FLOOR)))


def unknown_log(v: Column) -> Column:
    """Log-probability of a step that leaves the vocabulary."""
    alpha = F.lit(C.LAPLACE_ALPHA)
    return F.ln(alpha / (alpha * v))


def log_probabilities(model: SequenceTables) -> DataFrame:
    """Observed transitions, per-state unseen steps and starts, as log-probabilities."""
    st, stats = model.states, model.stats
    totals = st.select("entity_type", F.col("resource").alias("prev"), "t")
    seen = model.pairs.join(totals, ["entity_type", "prev"]).join(stats, "entity_type")
    observed = seen.select(
        "entity_type", F.lit("transition").alias("kind"), "prev", "cur",
        smoothed_log(F.col("c"), F.col("t"), F.col("v")).alias("log_p"),
    )
    known = st.join(stats, "entity_type")
    unseen = known.select(
        "entity_type", F.lit("unseen").alias("kind"), F.col("resource").alias("prev"), F.lit("*").alias("cur"),
        smoothed_log(F.lit(0), F.col("t"), F.col("v")).alias("log_p"),
    )
    start = known.select(
        "entity_type", F.lit("start").alias("kind"), F.lit("*").alias("prev"), F.col("resource").alias("cur"),
        smoothed_log(F.col("starts"), F.col("n_seq"), F.col("v")).alias("log_p"),
    )
    outside = stats.select(
        "entity_type", F.lit("unknown").alias("kind"), F.lit("*").alias("prev"), F.lit("*").alias("cur"),
        unknown_log(F.col("v")).alias("log_p"),
    )
    return observed.unionByName(unseen).unionByName(start).unionByName(outside)


def step_logs(steps: DataFrame, model: SequenceTables) -> DataFrame:
    """``log_trans`` of (previous, current) and ``log_start`` of the current resource, row by row.

    An unseen pair inside the vocabulary is smoothed; a pair with a resource
    outside it has the type's default.  Both are null when the type has no
    model, and ``log_trans`` is null on an entity's first event.
    """
    pairs = model.pairs.select(
        "entity_type", F.col("prev").alias("prev_resource"), F.col("cur").alias("resource_accessed"), "c"
    )
    leaving = model.states.select("entity_type", F.col("resource").alias("prev_resource"), "t")
    arriving = model.states.select("entity_type", F.col("resource").alias("resource_accessed"), "starts")
    joined = (
        steps.join(model.stats, "entity_type", "left")
        .join(pairs, STEP, "left")
        .join(leaving, ["entity_type", "prev_resource"], "left")
        .join(arriving, ["entity_type", "resource_accessed"], "left")
    )
    v, inside = F.col("v"), F.col("t").isNotNull() & F.col("starts").isNotNull()
    trans = F.when(inside, smoothed_log(F.coalesce("c", F.lit(0)), F.col("t"), v)).otherwise(unknown_log(v))
    start = F.when(F.col("starts").isNotNull(), smoothed_log(F.col("starts"), F.col("n_seq"), v)).otherwise(
        F.ln(F.lit(1.0) / v)
    )
    return joined.withColumns(
        {
            "log_trans": F.when(F.col("prev_resource").isNotNull(), trans),
            "log_start": start,
        }
    ).drop("v", "n_seq", "c", "t", "starts")


def transition_lookup(events: DataFrame, model: SequenceTables, steps: DataFrame | None = None) -> DataFrame:
    """Attach ``log_trans`` and ``log_start`` (see :func:`step_logs`) to events.

    The distinct steps are counted first, combined before the shuffle, and resolved
    against the model once each. The events meet that one table in one join, in
    which frequent steps are salted by their counts. ``steps`` may give the events'
    types, previous and current resources from a narrower plan than ``events``.
    """
    counted = (events if steps is None else steps).groupBy(*STEP).agg(F.count(F.lit(1)).alias("n"))
    resolved = step_logs(counted, model).select(*STEP, "n", "log_trans", "log_start")
    return join_counted(events, materialize(resolved, "steps"), STEP)


# --- scores --------------------------------------------------------------------


def markov_columns(nll: Column) -> dict[str, Column]:
    score = S.at_most(nll / C.MAX_NLL, 1.0)
    return {"markov_nll": S.round4(nll), "markov_raw": score, "markov_score": S.round4(score)}


def markov_last_transition(
    events: DataFrame, model: SequenceTables, hot: HotKeys | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """Negative log-likelihood of the step from the previous resource; 0 for the first."""
    if "prev_resource" not in events.columns:
        events = with_previous_resource(events, hot)
    looked_up = transition_lookup(events, model, steps)
    nll = F.coalesce(-F.col("log_trans"), F.lit(0.0))
    return looked_up.withColumns(markov_columns(nll)).drop("log_trans", "log_start")


def markov_window(events: DataFrame, model: SequenceTables, hot: HotKeys | None = None) -> DataFrame:
    """Length-normalised NLL over the entity's last ten resources."""
    if "prev_resource" not in events.columns:
        events = with_previous_resource(events, hot)
    looked_up = transition_lookup(events, model)

    def over_last_ten(window):
        steps = F.sum("log_trans").over(window.rowsBetween(-(N - 2), 0))
        start = F.first("log_start").over(window.rowsBetween(-(N - 1), 0))
        length = F.count(F.lit(1)).over(window.rowsBetween(-(N - 1), 0))
        return F.when((length >= 2) & start.isNotNull(), -(start + steps) / length).otherwise(0.0)

    done = rows_back(looked_up, ["entity_id"], ORDER, N - 1, {"_nll": over_last_ten}, hot)
    return done.withColumns(markov_columns(F.col("_nll"))).drop("_nll", "log_trans", "log_start")


def arrays_nll(recent: DataFrame, model: SequenceTables) -> DataFrame:
    """NLL of explicit sequences: rows ``session_id, entity_type, recent array<string>``.

    For at most ten resources per row, so the explosion is bounded.
    """
    at = lambda i: F.element_at("recent", i)
    steps = F.transform(
        F.sequence(F.lit(1), F.size("recent")),
        lambda i: F.struct(
            F.when(i > 1, at(F.greatest(i - 1, F.lit(1)))).alias("prev_resource"), at(i).alias("resource_accessed")
        ),
    )
    paired = recent.select(
        "session_id", "entity_type", F.size("recent").alias("length"), F.explode(steps).alias("s")
    ).select("session_id", "entity_type", "length", "s.*")
    looked_up = step_logs(paired, model)
    cost = F.when(F.col("prev_resource").isNull(), F.col("log_start")).otherwise(F.col("log_trans"))
    length = F.max("length")
    nll = F.when((length >= 2) & F.sum(cost).isNotNull(), -F.sum(cost) / length).otherwise(0.0)
    summed = looked_up.groupBy("session_id").agg(nll.alias("_nll"))
    return summed.withColumns(markov_columns(F.col("_nll"))).drop("_nll")
