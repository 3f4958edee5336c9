"""Streams that apply a key's events in the order of their own time, however they arrive.

An event waits in the key's state until the watermark has passed its time, so that none that is earlier can come
any more; then all that wait up to there are applied in order. Timers do this, tell that a key fell silent, and
end its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

Step = Callable[[tuple, tuple], tuple[tuple, tuple]]
#: The state store that such streams need; a session sets it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(micros: int) -> int:
    """The first millisecond at which all of a time's microseconds have passed."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Folds a key's events in order.

    step takes the state and an event's fields and gives the next state and an output row. quiet, if given, takes
    the state and gives when (in microseconds) silence changes it, or None; at that time silent takes the state
    and gives the next one and an output row. After ``forget`` microseconds without an event the key starts anew.
    """

    def __init__(self, fields: str, held: str, start: tuple, step: Step, columns: list[str], quiet: Callable[[tuple], int | None] | None, silent: Callable[[tuple], tuple[tuple, tuple]] | None, forget: int):
        self._fields, self._held, self._start, self._step, self._columns = fields, held, start, step, columns
        self._kinds = [f.split(" ")[1] for f in fields.split(", ")]
        self._quiet, self._silent, self._forget = quiet, silent, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "at long, seq long", self._fields)
        self._state = handle.getValueState("state", self._held)
        self._last = handle.getValueState("last", "at long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            for at, seq, *fields in part.itertuples(index=False, name=None):
                self._waiting.updateValue((int(at), int(seq)), tuple(_plain(f, k) for f, k in zip(fields, self._kinds, strict=True)))
                least = int(at) if least is None else min(least, int(at))
        if least is not None:
            self._wake(_millis(least))
        yield pd.DataFrame(columns=self._columns)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._applied(key, timerValues.getCurrentWatermarkInMs() * 1000), columns=self._columns)

    def _wake(self, millis: int) -> None:
        """See that a timer goes off at this time or before."""
        last, timer = tuple(self._last.get()) if self._last.exists() else (None, None)
        if timer is None or millis < timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(millis)
            self._last.update((last, millis))

    def _applied(self, key: tuple, passed: int) -> list[tuple]:
        state = tuple(self._state.get()) if self._state.exists() else self._start
        last = self._last.get()[0] if self._last.exists() else None
        waiting = sorted((tuple(k), tuple(v)) for k, v in self._waiting.iterator()) if self._waiting.exists() else []
        out = []

        def silence(upto: int) -> None:
            nonlocal state, last
            while self._quiet and (then := self._quiet(state)) is not None and then <= upto:
                state, row = self._silent(state)
                out.append((*key, *row))
            if last is not None and last + self._forget <= upto:
                state, last = self._start, None

        rest = None
        for (at, seq), fields in waiting:
            if at > passed:
                rest = at
                break
            silence(at)
            state, row = self._step(state, (at, seq, *fields))
            out.append((*key, *row))
            last = at
            self._waiting.removeKey((at, seq))
        silence(passed)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._last.update((last, None))
        if last is None and rest is None:
            self._state.clear()
            self._last.clear()
            return out
        self._state.update(state)
        more = [rest, self._quiet(state) if self._quiet else None, None if last is None else last + self._forget]
        self._wake(min(_millis(m) for m in more if m is not None))
        return out

    def close(self) -> None:
        pass


def _plain(value: Any, kind: str) -> Any:
    """A field as the state store takes it: None for what is missing, no floats for whole numbers (a column with missing ones has such), no NumPy values."""
    if pd.isna(value):
        return None
    return int(value) if kind == "long" else value.item() if hasattr(value, "item") else value


def in_order(
    events: DataFrame, key: str, order: str, fields: list[str], late: str, out: str, held: str, start: tuple, step: Step,
    quiet: Callable[[tuple], int | None] | None = None, silent: Callable[[tuple], tuple[tuple, tuple]] | None = None, forget: int = 30 * 86_400_000_000, at: str = "at",
) -> DataFrame:
    """(key, out...) as events of the stream pass the watermark, ``late`` after which none counts.

    Events of one key are applied by (at, order), and of equal ones the last that came. Event fields that are
    missing are None. Null times are left out.
    """
    kinds = dict(events.dtypes)
    spark = events.sparkSession
    if spark.conf.get(PROVIDER[0], "") != PROVIDER[1]:
        spark.conf.set(*PROVIDER)
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, late).select(key, at, F.unix_micros(at).alias("_micros"), F.col(order).cast("long").alias("_order"), *fields)
    schema = StructType.fromDDL(f"{key} {kinds[key]}, {out}")
    processor = InOrder(", ".join(f"{f} {_wide(kinds[f])}" for f in fields), held, start, step, schema.fieldNames(), quiet, silent, forget)
    return rows.select(key, "_micros", "_order", *[F.col(f).cast(_wide(kinds[f])).alias(f) for f in fields], at).groupBy(key).transformWithStateInPandas(_Fields(processor, key, at), schema, "Append", "EventTime")


def _wide(kind: str) -> str:
    return "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind


class _Fields(StatefulProcessor):
    """Hands a processor only an event's time in microseconds, its order and its fields."""

    def __init__(self, of: InOrder, key: str, at: str):
        self._of, self._drop = of, [key, at]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._of.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return self._of.handleInputRows(key, (r.drop(columns=self._drop) for r in rows), timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._of.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self._of.close()
