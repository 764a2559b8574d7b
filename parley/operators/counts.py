"""What a run read, left out and offered to the archive, counted by the jobs that write it.

Rows pass through ``Counts.rows`` with a reason each for being left out; the counting rides
along in the plan (an observation), so a table is read for it only where that fails. The jobs
of a run complete the numbers. A stage that is run again after a lost executor may count its rows twice."""

from __future__ import annotations

import uuid
from contextlib import suppress
from functools import reduce
from threading import Thread

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Seconds to wait for a count of a table that was already written.
PATIENCE = 30.0


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason that holds, null if none does."""
    why = F.lit(None).cast("string")
    return reduce(lambda rest, r: F.when(r[1], r[0]).otherwise(rest), reversed(reasons.items()), why)


def _read(watch: Observation, into: dict) -> None:
    with suppress(Py4JJavaError):  # no row: the observed part was not run
        into.update(watch.get)


class Counts:
    def __init__(self) -> None:
        self.seen: dict[str, tuple[Observation, list[str], DataFrame]] = {}

    def rows(self, name: str, df: DataFrame, reasons: dict[str, Column], orphan: Column | None = None) -> DataFrame:
        """Rows without a reason; reasons, attempts and orphans (kept rows without a chat) are counted."""
        watch = Observation(f"{name}-{uuid.uuid4().hex}")
        why, kept = F.col("_why"), F.col("_why").isNull()
        metrics = [F.count(F.lit(1)).alias("read"), F.count_if(kept).alias("attempts")]
        metrics += [F.count_if(why == r).alias(f"r{k}") for k, r in enumerate(reasons)]
        metrics.append(F.count_if(kept & (F.lit(False) if orphan is None else F.coalesce(orphan, F.lit(False)))).alias("orphans"))
        told = df.withColumn("_why", first_reason(reasons))
        self.seen[name] = (watch, list(reasons), told.agg(*metrics))
        return told.observe(watch, *metrics).where(kept).drop("_why")

    def values(self) -> dict[str, dict]:
        """By name: read, attempts, orphans, and skipped rows by reason. What no job brought along
        is counted now: a job that Spark cuts short, since what its rows are joined with is
        empty, brings nothing, and only the first job of some rows is heard."""
        out = {}
        for name, (watch, reasons, count) in self.seen.items():
            got: dict = {}
            wait = Thread(target=_read, args=(watch, got), daemon=True)
            wait.start()
            wait.join(PATIENCE)
            got = got or count.first().asDict()
            skipped = {r: got[f"r{k}"] for k, r in enumerate(reasons) if got[f"r{k}"]}
            out[name] = {"read": got["read"], "attempts": got["attempts"], "orphans": got["orphans"], "skipped": skipped}
        return out
