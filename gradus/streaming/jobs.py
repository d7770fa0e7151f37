"""Job updates as a stream: of each job only rising revisions, and nothing after its terminal state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradus.operators.jobs import TERMINAL

SCHEMA = "job_id string, revision long, state string"


def rising_revisions(updates: DataFrame, after: int = -1) -> DataFrame:
    """``updates``: job_id, revision, state, a stream. State: the last revision sent and whether the job has ended."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (after, False)
        rows = pd.concat(list(batches)).sort_values("revision", kind="stable")
        out = []
        for revision, name in zip(rows["revision"], rows["state"]):
            if not ended and revision > last:
                out.append((key[0], int(revision), name))
                last, ended = int(revision), name in TERMINAL
        state.update((last, ended))
        yield pd.DataFrame(out, columns=["job_id", "revision", "state"])

    return updates.groupBy("job_id").applyInPandasWithState(step, SCHEMA, "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)
