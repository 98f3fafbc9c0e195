"""Stateful job monitoring on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "phase string, done bigint, since bigint"
OUT = "job_id string, kind string, phase string, done bigint, idle_seconds double"


def _watch(key, batches: Iterator[pd.DataFrame], state: GroupState, seconds: float) -> Iterator[pd.DataFrame]:
    """The rows of one job in this trigger, in order of time whatever pieces they come in; ``since`` is in microseconds."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_no"], ignore_index=True)
    phase, done, since = state.get if state.exists else (None, -1, 0)
    at = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)
    phases, dones = rows["phase"].to_numpy(object), rows["done"].to_numpy(np.int64)
    moved = np.flatnonzero((phases != np.concatenate(([phase], phases[:-1]))) | (dones != np.concatenate(([done], dones[:-1]))))
    if not len(moved):
        return
    before = np.concatenate(([phase], phases[moved][:-1])), np.concatenate(([done], dones[moved][:-1])), (at[moved] - np.concatenate(([since], at[moved][:-1]))) / 1e6
    late = before[2] > seconds
    late[0] &= phase is not None
    told = [("stalled", before[0][late], before[1][late], before[2][late]), ("advance", phases[moved], dones[moved], 0.0)]
    state.update((phases[moved[-1]], int(dones[moved[-1]]), int(at[moved[-1]])))
    yield pd.concat([pd.DataFrame({"job_id": key[0], "kind": k, "phase": p, "done": n, "idle_seconds": i}, index=range(len(p))) for k, p, n, i in told if len(p)], ignore_index=True)


def stall_stream(events: DataFrame, seconds: float) -> DataFrame:
    """Advances and stalls of jobs in a stream of (job_id, ts, event_no, phase, done)."""
    return events.groupBy("job_id").applyInPandasWithState(lambda k, b, s: _watch(k, b, s, seconds), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
