"""A circuit breaker for each provider: opens at so many consecutive failures, closes after a cooldown or a success."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "user_id long, n_events long, n_open long, n_rejected long"
_STATE = "run long, opened double, n_events long, n_open long, n_rejected long"


def _advance(state: tuple, events: list[tuple[float, bool]], failures: int, cooldown: float) -> tuple:
    run, opened, n, n_open, rejected = state
    for ts, failed in events:
        n += 1
        if opened >= 0 and ts - opened >= cooldown:
            run, opened = 0, -1.0
        if opened >= 0:
            rejected += 1
        elif failed:
            run += 1
            if run >= failures:
                opened, n_open = ts, n_open + 1
        else:
            run = 0
    return run, opened, n, n_open, rejected


def _prepared(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.col("event_type") == "error").alias("failed"))


def _ordered(pdf: pd.DataFrame) -> list[tuple[float, bool]]:
    pdf = pdf.sort_values(["us", "event_id"])
    return list(zip(pdf["us"] / 1e6, pdf["failed"], strict=True))


def replay(events: DataFrame, failures: int, cooldown_s: float) -> DataFrame:
    """user_id, n_events, n_open and n_rejected of a batch in order of time."""

    def run(key: tuple[Any], pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, n, n_open, rejected = _advance((0, -1.0, 0, 0, 0), _ordered(pdf), failures, cooldown_s)
        return pd.DataFrame([(key[0], n, n_open, rejected)], columns=["user_id", "n_events", "n_open", "n_rejected"])

    return _prepared(events).groupBy("user_id").applyInPandas(run, SCHEMA)


def stream(events: DataFrame, failures: int, cooldown_s: float) -> DataFrame:
    """The same over a stream, whose micro-batches come in order of time; a row for each user and batch."""

    def run(key: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (0, -1.0, 0, 0, 0)
        new = _advance(tuple(old), _ordered(pd.concat(list(parts))), failures, cooldown_s)
        state.update(tuple(new))
        yield pd.DataFrame([(key[0], *new[2:])], columns=["user_id", "n_events", "n_open", "n_rejected"])

    return _prepared(events).groupBy("user_id").applyInPandasWithState(run, SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)
