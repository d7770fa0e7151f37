"""State logs of jobs: legality of transitions, revisions, latest states and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# From which state a job may go where.
NEXT = {
    "QUEUED": ("VALIDATING", "CANCELLED", "FAILED"),
    "VALIDATING": ("EVALUATING", "FAILED", "CANCELLED", "INTERRUPTED"),
    "EVALUATING": ("ANALYZING", "FAILED", "CANCELLED", "INTERRUPTED"),
    "ANALYZING": ("WRITING_ARTIFACT", "FAILED", "CANCELLED", "INTERRUPTED"),
    "WRITING_ARTIFACT": ("COMPLETE", "FAILED", "CANCELLED", "INTERRUPTED"),
    "COMPLETE": (), "FAILED": (), "CANCELLED": (), "INTERRUPTED": (),
}
TERMINAL = tuple(s for s, n in NEXT.items() if not n)


def fsm_violations(log: DataFrame) -> DataFrame:
    """(job_id, revision, code) of a log with job_id, revision, state, cancel_requested: revisions that skip or repeat, moves out of a
    terminal state, moves that are not allowed, cancel requests that are withdrawn, and entries that change nothing."""
    w = Window.partitionBy("job_id").orderBy("revision")
    rows = log.withColumns({"was": F.lag("state").over(w), "last": F.lag("revision").over(w), "asked": F.lag("cancel_requested").over(w)})
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, n in NEXT.items() for b in n])
    moved = F.col("was") != F.col("state")
    rules = F.array(
        F.when(F.col("was").isNull() & (F.col("state") != "QUEUED"), "BAD_START"), F.when(F.col("revision") != F.col("last") + 1, "STALE_REVISION"),
        F.when(F.col("was").isin(*TERMINAL), "TERMINAL"), F.when(moved & ~F.col("was").isin(*TERMINAL) & ~F.array_contains(allowed, F.concat_ws(">", "was", "state")), "ILLEGAL_TRANSITION"),
        F.when(F.col("asked") & ~F.col("cancel_requested"), "CANCEL_WITHDRAWN"), F.when(~moved & (F.col("asked") == F.col("cancel_requested")), "NO_CHANGE"),
    )
    return rows.select("job_id", "revision", F.explode(F.array_compact(rules)).alias("code"))


def latest_per_run(log: DataFrame) -> DataFrame:
    """(run_id, job_id, state): the job created last of each run, the greater id at ties, in its last state."""
    last = log.groupBy("run_id", "job_id").agg(F.max_by(F.struct("state", "created_at"), "revision").alias("r")).select("run_id", "job_id", "r.state", "r.created_at")
    return last.groupBy("run_id").agg(F.max_by(F.struct("job_id", "state"), F.struct("created_at", "job_id")).alias("r")).select("run_id", "r.job_id", "r.state")


def recovery(log: DataFrame) -> DataFrame:
    """(job_id, action) after a restart: queued jobs go back to the queue, others that had not ended are interrupted."""
    last = log.groupBy("job_id").agg(F.max_by("state", "revision").alias("state"))
    return last.where(~F.col("state").isin(*TERMINAL)).select("job_id", F.when(F.col("state") == "QUEUED", "REQUEUE").otherwise("INTERRUPT").alias("action"))
