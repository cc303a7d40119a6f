"""Numbers for the events of a capture across the micro-batches of a stream.

A keyed state holds how many events of each capture have been numbered. In a
micro-batch a capture's new events are put in order and go on from there, so a
stream over files that arrive in order gives the numbers, and so the ids, that
one batch over all of them gives. State and progress are committed together by
Spark, so a restart or a replayed micro-batch numbers as before.

A capture's events of one micro-batch meet in one task, as its number is one
counter; a trigger's size bounds how many. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Counter(StatefulProcessor):
    def __init__(self, order: list[str], start: int):
        self.order, self.start = order, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        known = self.count.get()
        first = known[0] if known else self.start
        self.count.update((first + len(new),))
        yield new.assign(index=range(first, first + len(new)))

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, order: list[str], key: str = "capture_id", start: int = 0) -> DataFrame:
    """``stream`` with ``index``: the place of an event in its capture, by micro-batch and then by ``order``.

    Columns must be of types that pandas holds without loss; raw events stay text.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    return stream.groupBy(F.col(key)).transformWithStateInPandas(_Counter(order, start), f"{schema}, index long", "Append", "None")
