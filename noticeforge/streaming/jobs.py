"""The states of jobs, folded from their events: claims with leases, starts, heartbeats, ends, and what a clock ends.

An event is (job_id, action, at, outcome): queue, claim, start, heartbeat, finish, tick. A claim holds if the job is
pending and unclaimed or its claim has run out; a start, once, if it is pending; a finish if it is running; all other
events are refused and change nothing. A tick, or a running job's lease that ends before the next event, fails the
job. The same step makes the batch and the stream, so both give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that a claim and a run hold, and the states that may follow each.
CLAIM_S, RUN_S = 120, 1800
FOLLOWS = {"pending": {"running", "failed"}, "running": {"succeeded", "failed", "partial"}, "succeeded": {"succeeded"}, "failed": {"failed"}, "partial": {"partial"}}

EVENT = "job_id long, action string, at long, outcome string"
STATE = "status string, queued_at long, picked_at long, started_at long, heartbeat_at long, timeout_at long, finished_at long"
OUT = f"job_id long, at long, action string, accepted boolean, {STATE}"
_FIELDS = [c.split()[0] for c in STATE.split(", ")]


def may_follow(before: str, after: str) -> bool:
    return after in FOLLOWS.get(before, set())


def step(state: dict | None, action: str, at: int, outcome: str | None = None, claim_s: int = CLAIM_S, run_s: int = RUN_S) -> tuple[dict | None, bool]:
    """The state after an event, and whether the event was accepted. Times are seconds."""
    if state is None:
        return (dict.fromkeys(_FIELDS) | {"status": "pending", "queued_at": at}, True) if action == "queue" else (None, False)
    s = dict(state)
    over = s["timeout_at"] is not None and s["timeout_at"] <= at
    if s["status"] == "running" and over:  # the lease ended before this event
        s |= {"status": "failed", "finished_at": s["timeout_at"]}
        return s, action == "tick"
    if action == "claim" and s["status"] == "pending" and (s["picked_at"] is None or s["timeout_at"] is None or over):
        return s | {"picked_at": at, "heartbeat_at": at, "timeout_at": at + claim_s}, True
    if action == "start" and s["status"] == "pending":
        return s | {"status": "running", "picked_at": s["picked_at"] if s["picked_at"] is not None else at, "started_at": at if s["started_at"] is None else s["started_at"], "heartbeat_at": at, "timeout_at": at + run_s, "finished_at": None}, True
    if action == "heartbeat" and s["status"] in ("pending", "running"):
        return s | {"picked_at": at if s["picked_at"] is None else s["picked_at"], "heartbeat_at": at, "timeout_at": at + run_s}, True
    if action == "finish" and outcome in FOLLOWS and may_follow(s["status"], outcome) and s["status"] in ("pending", "running"):
        return s | {"status": outcome, "finished_at": at}, True
    return s, False


def _rows(job_id: int, state: dict | None, events: pd.DataFrame) -> tuple[dict | None, list[dict]]:
    out = []
    for at, action, outcome in sorted(zip(events["at"].tolist(), events["action"].tolist(), events["outcome"].tolist()), key=lambda e: e[0]):
        state, accepted = step(state, action, int(at), outcome)
        out.append({"job_id": job_id, "at": int(at), "action": action, "accepted": accepted} | (state or dict.fromkeys(_FIELDS)))
    return state, out


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["job_id", "at", "action", "accepted", *_FIELDS])
    return df.astype({c: "Int64" for c in _FIELDS if c != "status"})


def fold_jobs(events: DataFrame) -> DataFrame:
    """Each event with whether it was accepted and the state after it. A job has a few dozen events."""
    return events.groupBy("job_id").applyInPandas(lambda key, pdf: _frame(_rows(int(key[0]), None, pdf)[1]), OUT)


def fold_stream(events: DataFrame) -> DataFrame:
    """The same as a stream, the state of each job kept between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(_FIELDS, kept.get)) if kept.exists else None
        state, out = _rows(int(key[0]), state, pd.concat(list(batches), ignore_index=True))
        if state is not None:
            kept.update(tuple(state[f] for f in _FIELDS))
        yield _frame(out)

    return events.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def snapshot(folded: DataFrame) -> DataFrame:
    """The last state of each job."""
    last = F.max_by(F.struct(*_FIELDS), F.struct("at", F.col("accepted").cast("int"), F.col("started_at").isNotNull(), F.col("finished_at").isNotNull()))
    return folded.filter(F.col("status").isNotNull()).groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
