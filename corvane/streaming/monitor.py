"""Stateful streams: change detection, throttling, session logs, upserts and the tiered monitor.

Each state machine is a pure function of (state, event), so the stream and the
replay over a table give the same rows; ``replay`` runs any of them in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# Interval in milliseconds and block size of the tiers, and the counts that move a block between them.
TIERS = [(8000, 65536), (2000, 4096), (400, 256), (80, 32), (16, 16)]
PROMOTE, DEMOTE, THROTTLE, SUMMARY = 2, 15, 3, 20


def step(state: tuple[int, int, int, int], changed: bool) -> tuple[tuple[int, int, int, int], str | None]:
    """(tier, changes in a row, stable in a row, changes in all) after one look at a block, and what is told.

    Two changes in a row go a tier down in block size, fifteen stable looks one up;
    after three changes only every twentieth is told, as a summary.
    """
    tier, hot, cold, total = state
    if not changed:
        cold += 1
        if cold >= DEMOTE and tier > 0:
            return (tier - 1, 0, 0, total), "demote"
        return (tier, 0, cold, total), None
    hot, total = hot + 1, total + 1
    said = "change" if total <= THROTTLE else "summary" if total % SUMMARY == 0 else None
    if hot >= PROMOTE and tier < len(TIERS) - 1:
        return (tier + 1, 0, 0, total), "promote"
    return (tier, hot, 0, total), said


STATE = "tier int, hot int, cold int, total int, digest string"
OUT = "block bigint, seq bigint, tier int, event string"


def _advance(key: tuple, pdf: pd.DataFrame, state: tuple[int, int, int, int, str | None]) -> tuple[tuple, list[tuple]]:
    *s, digest = state
    rows = []
    for seq, d in zip(pdf["seq"], pdf["digest"], strict=True):
        if digest is not None:  # the first reading is the baseline
            s, said = step(tuple(s), d != digest)
            if said:
                rows.append((key[0], seq, s[0], said))
        digest = d
    return (*s, digest), rows


#: Milliseconds after which the state of a block that is no longer seen is dropped.
FORGET_MS = 3_600_000


def _stateful(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    now = state.get if state.exists else (0, 0, 0, 0, None)
    pdf = pd.concat(list(frames)).sort_values("seq")
    now, rows = _advance(key, pdf, now)
    state.update(now)
    state.setTimeoutDuration(FORGET_MS)
    yield pd.DataFrame(rows, columns=["block", "seq", "tier", "event"])


def monitored(stream: DataFrame) -> DataFrame:
    """Events of a stream of (block, seq, digest); blocks unseen for an hour lose their state."""
    return stream.groupBy("block").applyInPandasWithState(_stateful, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(readings: DataFrame) -> DataFrame:
    """The same events from a table; the readings of one block are one group, as long as its history."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_advance(key, pdf.sort_values("seq"), (0, 0, 0, 0, None))[1], columns=["block", "seq", "tier", "event"])

    return readings.groupBy("block").applyInPandas(run, OUT)


def changes(readings: DataFrame) -> DataFrame:
    """(block, seq, n): readings whose content differs from the one before, numbered; the first is the baseline."""
    w = Window.partitionBy("block").orderBy("seq")
    c = readings.withColumn("_d", F.md5("content")).withColumn("_p", F.lag("_d").over(w)).filter("_p is not null and _d != _p")
    return c.select("block", "seq", F.row_number().over(w).alias("n"))


def throttled(changed: DataFrame) -> DataFrame:
    """``changes`` told one by one up to the third, then as a summary at every twentieth."""
    kind = F.when(F.col("n") <= THROTTLE, "change").when(F.col("n") % SUMMARY == 0, "summary")
    return changed.withColumn("event", kind).filter("event is not null")


def session_log(events: DataFrame) -> DataFrame:
    """Observations that count: within a session, of 16 bytes that are not all zero; ``module_offset`` only when plausible.

    ``events`` has (session, event, block as hexadecimal text, offset).  Works on
    streams and tables alike.
    """
    ok = F.col("session").isNotNull() & (F.col("event") == "observation") & F.col("block").rlike("^[0-9a-fA-F]{32}$") & ~F.col("block").rlike("^0+$")
    offset = F.when((F.col("offset") > 0) & (F.col("offset") < 0x40000000), F.col("offset"))
    return events.filter(ok).withColumn("module_offset", offset)


def upsert_stream(stream: DataFrame, folder: str, combine: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start a query that keeps ``folder`` at ``combine`` of all rows so far.

    Raw rows are appended per batch under its number, so that a batch that runs again
    replaces itself, and the facts are recomputed from all of them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/raw/batch={number}")
        spark = batch.sparkSession
        combine(spark.read.parquet(f"{folder}/raw").drop("batch")).write.mode("overwrite").parquet(f"{folder}/facts/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
