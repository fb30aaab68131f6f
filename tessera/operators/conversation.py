"""Conversations (K1-K3) over whole logs: transitions, reuse of results, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# State, command -> next state. Anything else is an invalid command.
TRANSITIONS = {
    ("idle", "ask"): "idle",
    ("idle", "manual_ask"): "awaiting_selection",
    ("awaiting_selection", "select"): "idle",
}


def next_state(state: Column, command: Column) -> Column:
    """The state after a command; an invalid one leaves the state."""
    out = state
    for (at, given), then in TRANSITIONS.items():
        out = F.when((state == at) & (command == given), F.lit(then)).otherwise(out)
    return out


def transitions(commands: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, command, state_before, state_after, valid) of every command of a log.

    A conversation awaits a selection exactly after a ``manual_ask`` that no ``select`` has answered, so the fold
    is a running count in a window: nothing is collected.
    """
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    opening = F.when(F.col("command").isin("manual_ask", "select"), F.col("command"))
    waiting = F.coalesce(F.last(opening, ignorenulls=True).over(before) == "manual_ask", F.lit(False))
    state = F.when(waiting, F.lit("awaiting_selection")).otherwise(F.lit("idle"))
    valid = F.when(waiting, F.col("command") == "select").otherwise(F.col("command").isin("ask", "manual_ask"))
    rows = commands.select(conversation, turn, "command", state.alias("state_before"), valid.alias("valid"))
    return rows.withColumn("state_after", next_state(F.col("state_before"), F.col("command")))


def reused_results(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", results: str = "results") -> DataFrame:
    """Adds ``used_results``: the first turn searches, later ones use what it found."""
    return turns.withColumn("used_results", F.first(results).over(Window.partitionBy(conversation).orderBy(turn)))


def histories(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", found: str = "n_results") -> DataFrame:
    """Adds ``history_start``, ``history_turns`` to a log of answered turns: the first turn that the history after this one still holds, and
    how many turns it holds.

    A turn adds its question and answer to the history; where the session held no results before it (at its start, or since the turn before
    found none) the history starts anew. ``found`` counts the results that a turn left in the session.
    """
    order = Window.partitionBy(conversation).orderBy(turn)
    anew = F.coalesce(F.lag(found).over(order), F.lit(0)) == 0
    start = F.last(F.when(anew, F.col(turn)), ignorenulls=True).over(order)
    placed = turns.withColumn("__n", F.row_number().over(order)).withColumn("history_start", start)
    first = F.last(F.when(anew, F.col("__n")), ignorenulls=True).over(order)
    return placed.withColumn("history_turns", F.col("__n") - first + 1).drop("__n")
