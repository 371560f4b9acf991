"""Session memory as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id bigint, turn bigint, role string, text string, n_prior bigint, history array<string>"
STATE = "n bigint, history array<string>"
NUMBERED = "conv_id bigint, turn bigint, role string, text string, position bigint"


def session_memory(messages: DataFrame, keep: int = 20, ttl_ms: int | None = None) -> DataFrame:
    """Emit every message with its number of earlier messages and the last ``keep`` of them.

    State per conversation is one counter and at most ``keep`` messages, whatever
    the length of the conversation; an idle conversation is forgotten after
    that time, which suits continuously triggered streams only, because state
    timeouts keep an ``availableNow`` stream running. Messages of a conversation must arrive in turn order across
    batches.
    """

    def update(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, history = state.get if state.exists else (0, [])
        history = list(history)
        rows = pd.concat(list(parts)).sort_values("turn")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            out.append((key[0], turn, role, text, count, list(history)))
            history = (history + [f"{role}: {text}"])[-keep:]
            count += 1
        state.update((count, history))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "n_prior", "history"])

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy("conv_id").applyInPandasWithState(
        update, OUTPUT, STATE, "append", timeout
    )


def session_messages(messages: DataFrame) -> DataFrame:
    """Emit every message once, with its 0-based position in its conversation.

    State per conversation is one counter. The rows hold the whole history: what came before
    a message is in the rows of its conversation with a smaller position (``operators.sessions.full_history``).
    Messages of a conversation must arrive in turn order across batches.
    """

    def update(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(parts)).sort_values("turn", kind="stable")
        rows["position"] = range(count, count + len(rows))
        state.update((count + len(rows),))
        yield rows[["conv_id", "turn", "role", "text", "position"]]

    return messages.groupBy("conv_id").applyInPandasWithState(update, NUMBERED, "n bigint", "append", GroupStateTimeout.NoTimeout)
