"""Resumable evaluation as a stream of attempts: what to do after each one, with state that outlives a restart.

Two steps, each keyed as finely as its rule allows. By provider and example: retries with their delays, regenerations, and successes that stay. By provider, over the few numbers
that the first step hands on: the budget of requests, rate limits in a row, and the breaker of a full run. The session's state store has to be RocksDB
(``spark.sql.streaming.stateStore.providerClass``), which keeps state in the query's checkpoint. Timers run by the clock, so
a query with the trigger ``availableNow`` ends only with ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false; retries are then due with the next data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradus.operators.providers import RETRYABLE

#: What an attempt has to carry. ``sequence`` orders a provider's attempts; a prediction is a ``label``.
ATTEMPT = "provider string, example_id string, sequence long, api_success boolean, label string, error_class string, retry_after_seconds double, rate_limit_dimension string"
_STEP = ATTEMPT + ", attempt int, status string, action string, delay_seconds double, first boolean"
DECISION = "provider string, example_id string, sequence long, attempt int, status string, action string, delay_seconds double, stop_reason string"

# Failures that a new generation may mend, and reasons to stop.
REGENERATED = ("PARSE_ERROR", "SCHEMA_VALIDATION_ERROR")
BUDGET, QUOTA, BLOCKED, UNRELIABLE = "REQUEST_BUDGET_EXHAUSTED", "DAILY_QUOTA_EXHAUSTED", "RATE_LIMIT_STILL_BLOCKING", "FULL_RUN_TECHNICAL_RELIABILITY_REGRESSION"


class _Examples(StatefulProcessor):
    """State of an example: retries and regenerations of this session, whether it has been seen, whether it succeeded, and the attempt that a timer waits for."""

    def __init__(self, retries: int, regenerations: dict[str, int], interval: float):
        self.retries, self.regenerations, self.interval = retries, regenerations, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("example", "retried int, regenerated int, seen boolean, done boolean, waits_for long, due_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        retried, regenerated, seen, done, waits, due = self.state.get() if self.state.exists() else (0, 0, False, False, -1, -1)
        provider, out = key[0], []
        for row in pd.concat(list(rows)).sort_values("sequence", kind="stable").to_dict("records"):
            label, error = _some(row["label"]), _some(row["error_class"])
            delay, attempt = None, retried + regenerated + 1
            if done:
                status, action = "SUCCESS", "SKIP"
            elif label is not None:
                status, action, done = "SUCCESS", "DONE", True
            elif row["api_success"] and error in REGENERATED and regenerated < self.regenerations.get(provider, 0):
                status, action = None, "REGENERATE"
                regenerated += 1
            elif error in RETRYABLE and retried < self.retries:
                status, action = "FAILED", "RETRY"
                retried += 1
                asked = _some(row["retry_after_seconds"])
                delay = max(self.interval, asked or 0.0) if error == "API_RATE_LIMIT" else min(2.0, 0.1 * 2 ** (retried - 1))
                waits, due = int(row["sequence"]), timerValues.getCurrentProcessingTimeInMs() + int(1000 * delay)
                self.handle.registerTimer(due)
            else:
                status, action = "FAILED", "GIVE_UP"
                retried = regenerated = 0  # another session begins anew
            if action != "RETRY":
                waits = due = -1
            first = status is not None and action != "SKIP" and not seen
            seen = seen or first
            out.append({**row, "attempt": attempt, "status": status, "action": action, "delay_seconds": delay, "first": first})
        self.state.update((retried, regenerated, seen, done, waits, due))
        yield _frame(out, _STEP)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The time of a retry has come, if nothing else was tried meanwhile."""
        retried, regenerated, seen, done, waits, due = self.state.get()
        out = []
        if waits >= 0 and expiredTimerInfo.getExpiryTimeInMs() == due:
            self.state.update((retried, regenerated, seen, done, -1, -1))
            out.append({"provider": key[0], "example_id": key[1], "sequence": waits, "attempt": retried + regenerated + 1, "action": "DUE"})
        yield _frame(out, _STEP)

    def close(self) -> None:
        pass


class _Providers(StatefulProcessor):
    """State of a provider: requests, rate limits in a row, failed records, examples with a record, valid ones, and why it stopped."""

    def __init__(self, budget: int | None, streak: int, failures: int, least_valid: float, after: int):
        self.budget, self.streak, self.failures, self.least_valid, self.after = budget, streak, failures, least_valid, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("provider", "used long, streak int, failed long, examples long, valid long, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        used, streak, failed, examples, valid, reason = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, "")
        out = []
        for row in pd.concat(list(rows)).sort_values("sequence", kind="stable").to_dict("records"):
            action, status, error = row["action"], _some(row["status"]), _some(row["error_class"])
            if action not in ("DUE", "SKIP") and not reason:
                if self.budget is not None and used >= self.budget:
                    reason = BUDGET
                else:
                    used += 1
                    streak = streak + 1 if error == "API_RATE_LIMIT" else 0
                    if streak and _some(row["rate_limit_dimension"]) == "RPD":
                        reason = QUOTA
                    elif streak >= self.streak:
                        reason = BLOCKED
                    examples, valid, failed = examples + bool(row["first"]), valid + (status == "SUCCESS"), failed + (status == "FAILED")
                    if not reason and (failed >= self.failures or examples >= self.after and valid / examples < self.least_valid):
                        reason = UNRELIABLE
            out.append({**row, "stop_reason": reason or None})
        self.state.update((used, streak, failed, examples, valid, reason))
        yield _frame(out, DECISION)

    def close(self) -> None:
        pass


def _some(value):
    return None if value is None or value != value else value  # noqa: PLR0124  a missing number


def _frame(rows: list[dict], ddl: str) -> pd.DataFrame:
    """Nullable columns of the kinds of ``ddl``."""
    kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean", "double": "float64", "string": "object"}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pd.DataFrame({name: pd.Series([_some(r.get(name)) for r in rows], dtype=kinds[kind]) for name, kind in fields})


def steps(attempts: DataFrame, *, retries: int = 2, regenerations: dict[str, int] | None = None, interval: float = 10.0) -> DataFrame:
    """``attempts``, a stream (columns of ATTEMPT), with attempt, status, action, delay_seconds and first (the example's first record).

    Actions: DONE, REGENERATE, RETRY (after delay_seconds, when a row DUE follows), GIVE_UP, and SKIP for attempts after a success, which stays."""
    return attempts.groupBy("provider", "example_id").transformWithStateInPandas(_Examples(retries, dict(regenerations or {}), interval), _STEP, "Append", "ProcessingTime")


def decisions(stepped: DataFrame, *, budget: int | None = None, streak: int = 3, failures: int = 10, least_valid: float = 0.98, after: int = 100) -> DataFrame:
    """``steps`` as a stream, with stop_reason from the attempt on that ended a provider's run: over budget, a day's requests used up, rate limits in a row, too many failed records, or too few valid examples."""
    return stepped.groupBy("provider").transformWithStateInPandas(_Providers(budget, streak, failures, least_valid, after), DECISION, "Append", "None")
