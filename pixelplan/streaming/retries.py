"""Tries of a download as a stream: what each answer means for its tile, with a timer for answers that never come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"

#: Retries of one session, tries above it, seconds of the first waits, and what a session tries again.
SESSION, TRIES, BACKOFF, PAUSE = 5, 3, 0.5, 1.0
AGAIN = (429, 500, 502, 503, 504)
#: Seconds after which a missing answer counts as an exception.
TIMEOUT = 30.0

ANSWERS = "tile long, n int, status int, image boolean"
OUTCOMES = "tile long, outcome string, answers int, waited double"
_STATE = "next int, tries int, retries int, waited double, early array<struct<n: int, status: int, image: boolean>>, done boolean"


def after(tries: int, retries: int, waited: float, status: int | None, image: bool | None) -> tuple[int, int, float, str | None]:
    """What an answer leads to: tries and retries used up, seconds waited, and the outcome if there is one.

    A status that a session tries again is retried at once, then after 1, 2, 4 ... seconds, five times; then, as after an
    exception (null), a second passes and a new session begins, three in all. 200 with an image is a tile, all else is missing.
    """
    if status in AGAIN and retries < SESSION:
        return tries, retries + 1, waited + (BACKOFF * 2**retries if retries else 0.0), None
    if status is None or status in AGAIN:
        return tries + 1, 0, waited + PAUSE, "missing" if tries + 1 == TRIES else None
    return tries, retries, waited, "tile" if status == 200 and image else "missing"


def outcomes(answers: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """tile, outcome, answers (used) and waited of each tile once it is settled, from a stream of answers (tile, n from 0, status, image).

    Answers may come in any order: those ahead of their turn are held in the tile's state, which is as small as its tries. A tile
    without an answer for its waiting time and `timeout` seconds of processing time has an exception. Of a settled tile
    only that it is settled is remembered, so later answers to it are left out. Repeated answers count once.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tries, retries, waited, early, done = state.get if state.exists else (0, 0, 0, 0.0, [], False)
        held = {x["n"]: x for x in (e.asDict() if hasattr(e, "asDict") else dict(e) for e in early)}
        if state.hasTimedOut and not done:
            held[at] = {"n": at, "status": None, "image": None}
        for batch in batches:
            for n, status, image in zip(batch["n"], batch["status"], batch["image"], strict=True):
                held.setdefault(int(n), {"n": int(n), "status": None if pd.isna(status) else int(status), "image": None if pd.isna(image) else bool(image)})
        outcome = None
        while not done and outcome is None and at in held:
            x = held.pop(at)
            at += 1
            tries, retries, waited, outcome = after(tries, retries, waited, x["status"], x["image"])
        done = done or outcome is not None
        early = [] if done else [(n, held[n]["status"], held[n]["image"]) for n in sorted(held) if n >= at]
        state.update((at, tries, retries, waited, early, done))
        if not done:
            pause = BACKOFF * 2 ** (retries - 1) if retries > 1 else PAUSE if tries and not retries else 0.0
            state.setTimeoutDuration(int(1000 * (timeout + pause)))
        if outcome:
            yield pd.DataFrame({"tile": [key[0]], "outcome": [outcome], "answers": [at], "waited": [waited]})

    return answers.groupBy("tile").applyInPandasWithState(step, OUTCOMES, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def replayed(sink: DataStreamWriter) -> None:
    """Runs a stream of outcomes() over what is there and ends; no batches without data are made, so no timer goes off."""
    spark = sink._spark
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, False)
    try:
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
