"""Caller-supplied functions over planned batches: the one place where Python runs on executors by design."""

from __future__ import annotations

import heapq
import inspect
import time
from collections.abc import Callable
from itertools import count, groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuelake.operators.passes import ordered_pass

TRANSIENT = ("429", "502", "503", "504", "timeout", "timed out", "connection", "network")


class Call(NamedTuple):
    """What a service may want to know of the batch it is given: a service of two parameters gets it as the second."""

    video_id: int
    batch: int
    attempt: int
    service: str | None


def with_retry(fn: Callable[[list[str], int], list[str]], attempts: int = 3, wait_s: float = 1.0, sleep: Callable[[float], None] | None = None):
    """``fn(texts, attempt)`` wrapped: transient errors are tried again after a doubling wait; returns (result, attempts, seconds waited).

    Nothing is remembered from one call to the next, so the result does not depend on what else a task has seen.
    """

    def call(texts: list[str]):
        waited = 0.0
        for k in range(1, attempts + 1):
            try:
                return fn(texts, k), k, waited
            except Exception as e:
                pause = _pause(e, k, attempts, wait_s)
                if pause is None:
                    e.attempts, e.waited_s = k, waited  # for a caller that goes on without this batch
                    raise
                (sleep or time.sleep)(pause)
                waited += pause
        raise AssertionError("unreachable")

    return call


def _pause(e: Exception, k: int, attempts: int, wait_s: float) -> float | None:
    """Seconds to wait after the k-th attempt failed with ``e``, or none if it failed for good."""
    if k == attempts or not any(t in str(e).lower() for t in TRANSIENT):
        return None
    return wait_s * 2 ** (k - 1)


#: batches of a task that may wait for their next attempt while it goes on with others
MOST_WAITING = 1000


def map_batches(
    rows: DataFrame, fn: Callable | None = None, out_col: str = "result", concurrency: int | None = None, attempts: int = 3, wait_s: float = 1.0,
    services: dict[str, Callable] | None = None, default: str | None = None, service_col: str = "service", keep_failed: bool = False,
) -> DataFrame:
    """One call for each (video_id, batch), its texts in order of ``pos``; at most ``concurrency`` calls at once.

    The function is ``fn``, or that of ``services`` which the batch names in ``service_col``; an unknown or null name calls
    ``default``.  It takes the texts, and a ``Call`` if it has a second parameter, and must return as many texts.  ``attempts``
    and ``waited_s`` say how often a batch was tried and how long it waited in between.  A batch that fails for good raises,
    or with ``keep_failed`` keeps its source texts, ``failed`` being true, and costs no other batch.  A task makes one call at a
    time, and goes on with other batches while some wait for their next attempt.
    """
    if (fn is None) == (services is None) or (services is not None and default not in services):
        raise ValueError("give either fn, or services and the name of the default one")
    given = ["video_id", "batch", "pos", "text"]
    known = {None: fn} if services is None else services
    told = {name: len(inspect.signature(f).parameters) > 1 for name, f in known.items()}

    def one(video, batch, places, texts, name, k, waited):
        """The rows of a batch after its k-th attempt, or the seconds until the next."""
        failed = False
        try:
            got = known[name](list(texts), Call(video, batch, k, name)) if told[name] else known[name](list(texts))
        except Exception as e:
            pause = _pause(e, k, attempts, wait_s)
            if pause is not None:
                return None, pause
            if not keep_failed:
                raise
            got, failed = texts, True
        if len(got) != len(texts):
            if not keep_failed:
                raise ValueError(f"{len(got)} results for {len(texts)} texts")
            got, failed, k, waited = texts, True, 1, 0.0
        return [(video, batch, p, t, g, k, waited, failed) for p, t, g in zip(places, texts, got, strict=True)], None

    def rule(rows):
        waiting, serial = [], count()
        groups = groupby(rows, key=lambda r: r[:2])

        def due(least: int):
            """What is due of those that wait; it is slept until no more than ``least`` wait."""
            while waiting and (len(waiting) > least or waiting[0][0] <= time.monotonic()):
                at, _, own = heapq.heappop(waiting)
                time.sleep(max(0.0, at - time.monotonic()))
                yield from tried(own)

        def tried(own):
            made, pause = one(*own)
            if made is None:
                heapq.heappush(waiting, (time.monotonic() + pause, next(serial), (*own[:-2], own[-2] + 1, own[-1] + pause)))
            else:
                yield from made

        for (video, batch), lines in groups:
            _, _, places, texts, *names = zip(*lines, strict=True)
            name = None if services is None else names[0][0] if names[0][0] in services else default
            yield from tried((video, batch, places, texts, name, 1, 0.0))
            yield from due(MOST_WAITING)
        yield from due(0)

    dealt = rows.select(*given, *([service_col] if services is not None else []))
    schema = StructType.fromDDL(f"video_id bigint, batch bigint, pos int, text string, {out_col} string, attempts int, waited_s double, failed boolean")
    return ordered_pass(dealt, ["video_id", "batch"], ["pos"], rule, schema, concurrency)


def measured(rows: DataFrame, fn: Callable[[float, float], float | None], out_col: str = "energy_db") -> DataFrame:
    """A caller's measure of (start, end) seconds; an exception is a null."""

    @F.pandas_udf("double")
    def run(start: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(start, end, strict=True):
            try:
                out.append(fn(a, b))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype="float64")

    return rows.withColumn(out_col, run(F.col("start_ms") / 1000, F.col("end_ms") / 1000))
