"""The state of running conversations over a stream of commands (K1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from tessera.operators.conversation import TRANSITIONS

OUTPUT = "conv_id string, turn bigint, command string, state_before string, state_after string, valid boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at = state.get[0] if state.exists else "idle"
    # the commands of one conversation in one micro-batch, in order whatever batches of rows they came in
    rows = []
    for turn, command in pd.concat(batches).sort_values("turn")[["turn", "command"]].itertuples(index=False):
        then = TRANSITIONS.get((at, command))
        rows.append((key[0], turn, command, at, then or at, then is not None))
        at = then or at
    yield pd.DataFrame(rows, columns=["conv_id", "turn", "command", "state_before", "state_after", "valid"])
    state.update((at,))


def running_transitions(commands: DataFrame) -> DataFrame:
    """Transitions of a stream of (conv_id, turn, command); only a state per conversation is kept."""
    return commands.groupBy("conv_id").applyInPandasWithState(_step, OUTPUT, "state string", "append", "NoTimeout")
