"""Streams of events: accepted states by key, sessions, and runs that stop between batches and go on later."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators.passes import CHANGE_SHARE, KEPT_SHARE

STOPPED = "the run was asked to stop"


def state_changes(events: DataFrame, key: str, order: list[str], ident: str, value: str, share: float = CHANGE_SHARE, kept: float = KEPT_SHARE) -> DataFrame:
    """Each key's values against the last accepted one, over a stream: key, ident, change.

    What ``passes.changes`` does to an array: a value that differs by ``share`` of
    the last accepted one is accepted, as ``added`` if at least ``kept`` of the old
    one is left, else as ``replaced``. The last accepted value is the key's state;
    batches must come in order, rows within a batch are put in order.
    """
    kinds = dict(events.dtypes)

    def go(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)  # one key's rows of one batch
        out = []
        for x in rows[value].tolist():
            kind = None
            if last is None or abs(x - last) >= share * max(1.0, abs(last)):
                kind = "added" if last is None or x >= kept * last else "replaced"
                last = x
            out.append(kind)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [keys[0]] * len(rows), ident: rows[ident].tolist(), "change": out})

    return events.groupBy(key).applyInPandasWithState(go, f"{key} {kinds[key]}, {ident} {kinds[ident]}, change string", "last double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Event-time sessions of a stream by key, closed by ``gap`` and a watermark: key, start, end, n."""
    met = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return met.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run(stream: DataFrame, path: str, checkpoint: str, stop: Callable[[], bool] = lambda: False) -> bool:
    """Take what is there, batch by batch, into ``path``; whether all was taken.

    ``stop`` is asked before each batch: once it says so, the batches so far are
    kept and the run ends. A run with the same checkpoint goes on behind them. A
    batch that is run again replaces what it wrote.
    """

    def take(rows: DataFrame, batch: int) -> None:
        if stop():
            raise InterruptedError(STOPPED)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if STOPPED not in str(e):
            raise
        return False
    return True
