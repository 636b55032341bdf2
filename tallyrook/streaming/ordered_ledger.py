"""The ledger on a stream whose events come in any order within the watermark.

Events wait in a draft's state until the watermark has passed them; a timer of event time then applies them in (ts, event_id) order,
which no later arrival can change any more. So the outcomes are those of the batch fold, however the events were shuffled over
micro-batches; what comes behind the watermark is dropped, and Spark counts it. The price is the delay of the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.ledger import Draft, begin, step
from .ledger_stream import OUT, STATE

WAITING = "us long, event_id long, action string, sha string, reviewable boolean, expected long"
_COLUMNS = ("us", "event_id", "action", "sha", "reviewable", "expected")
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """One draft: its state after all events that the watermark has passed, and the events that wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            events = [tuple(None if pd.isna(x) else x for x in row) for row in frame[list(_COLUMNS)].astype(object).itertuples(index=False, name=None)]
            self.waiting.appendList([(int(e[0]), int(e[1]), e[2], e[3], e[4] if e[4] is None else bool(e[4]), e[5] if e[5] is None else int(e[5])) for e in events])
            self._wake(min(int(e[0]) for e in events))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []
        due, rest = [e for e in events if e[0] <= passed], [e for e in events if e[0] > passed]
        if not due:
            return
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        first = not self.draft.exists()
        draft, out = (None if first else Draft(*self.draft.get())), []
        for _, event_id, action, sha, reviewable, expected in due:
            draft = draft or begin(sha, reviewable)
            draft, outcome, detail = step(draft, first, action, sha, reviewable, expected)
            first = False
            out.append((key[0], event_id, outcome, detail, draft.revision))
        self.draft.update(tuple(draft))
        yield pd.DataFrame(out, columns=["draft_id", "event_id", "outcome", "detail", "revision"])

    def close(self) -> None:
        pass


def outcomes(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A streaming log (operators.ledger.log) to a stream of outcomes, one row an event, once the watermark has passed it. The state lies in
    RocksDB, which transformWithState asks for; the session's setting is changed where it names another store."""
    spark = log.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)
    ts = F.col("ts").cast("timestamp")
    rows = log.select("draft_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), *_COLUMNS[1:]).withWatermark("ts", late)
    return rows.groupBy("draft_id").transformWithStateInPandas(Ordered(), OUT, "append", "EventTime")
