"""The first arrival of each slug, remembered across batches and restarts in keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ARRIVED = "slug string, path string, content binary"
# State is kept by key in RocksDB, so a batch touches the keys it meets and not all there are.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstPath(StatefulProcessor):
    """Lets the least path of a slug's first batch through and holds back all that come later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.taken.exists():
            return
        best = None
        for frame in rows:
            least = frame.loc[[frame["path"].idxmin()], ["slug", "path", "content"]]
            if best is None or least["path"].iloc[0] < best["path"].iloc[0]:
                best = least
        self.taken.update((best["path"].iloc[0],))
        yield best

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.taken.update((initialState["path"].min(),))

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def first_arrivals(arrived: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(slug, path, content) of a stream, one row per slug ever: that of the least path of its first batch.

    ``known`` (slug, path) is what counts as taken when the stream starts for the first time; later batches
    do not read it.  State and output of a batch are committed together, so a batch that failed is repeated with
    the state it had.  Start the query within ``keyed_state``.
    """
    return arrived.select("slug", "path", "content").groupBy("slug").transformWithStateInPandas(
        FirstPath(), ARRIVED, "Update", "None", None if known is None else known.select("slug", "path").groupBy("slug")
    )
