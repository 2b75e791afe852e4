"""Sessions and ingest as streams (ST4, ST5): the same operators on micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import merge_upsert

OUT = "id string, state string, at timestamp"
STATE = "expires_at timestamp"


def expiring_sessions(events: DataFrame, hours: int = 1, delay: str = "10 minutes") -> DataFrame:
    """id, state ('open', then 'expired'), at: each session expires ``hours`` after its creation, without sliding.

    ``events``: id, created_at. Later events of a session change nothing; what comes after the watermark is late.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (end,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "expired", end)], columns=["id", "state", "at"])
            return
        first = min((f["created_at"].min() for f in frames), default=None)
        if first is None or state.exists:
            return
        end = first + timedelta(hours=hours)
        state.update((end,))
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], "open", first)], columns=["id", "state", "at"])

    marked = events.withWatermark("created_at", delay)
    return marked.groupBy("id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], keys: list[str], order: str):
    """ST5. A stream writer that works each micro-batch into a table: last row a key, then ``merge_upsert``.

    ``store`` gets the new table and the batch's number; it must ignore a number it has stored already.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        store(merge_upsert(load(), last, keys), number)

    return stream.writeStream.foreachBatch(run)
