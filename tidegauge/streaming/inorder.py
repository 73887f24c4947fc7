"""Per-key state machines that see their rows in event-time order.

Rows may arrive late and out of order.  Each key keeps them by time slot until
the watermark has passed them and only then feeds them, sorted, to the machine,
so the outcome does not depend on arrival and equals the batch result on the
same rows.  What waits is bounded by the watermark delay.

A slot's rows are stored as Arrow bytes, one piece for each arrival; adding rows
reads none, and a timer reads the pieces of its own slot only, however many rows
wait in others.  Timers fire in the order of time: when the one at ``now`` is
handled, all rows before ``now`` have been fed to the machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.functions.timing import as_micros

#: Width of a slot.  A timer reads the rows of one slot, so many rows in a short time want narrow slots.
SLOT = timedelta(hours=6)

#: Arriving rows of a key that are dealt to their slots at a time.
GATHERED = 100_000

# Rows carry their time as microseconds next to a tie-breaker and a value.
ROW_NAMES = ("us", "tie", "value")


def packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def _gathered(parts: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows in fewer parts, each of ``GATHERED`` rows or a little more: a slot then gets few pieces of an arrival."""
    held, rows = [], 0
    for part in parts:
        if len(part):
            held.append(part[columns])
            rows += len(part)
        if rows >= GATHERED:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


class SlotBuffer:
    """Waiting rows by slot: ``pieces`` (slot, number) -> bytes, ``counts`` slot -> pieces."""

    def __init__(self, pieces, counts, width_us: int, order: list[str]):
        self._pieces, self._counts, self._width, self._order = pieces, counts, width_us, order

    def add(self, rows: pd.DataFrame) -> list[int]:
        """Store the rows; the earliest time in each slot they fall into."""
        earliest = []
        for slot, part in rows.groupby(rows["us"] // self._width, sort=False):
            self._append(int(slot), part)
            earliest.append(int(part["us"].min()))
        return earliest

    def due(self, us: int, upto: int) -> tuple[pd.DataFrame | None, int | None]:
        """Sorted rows up to ``upto`` of the slot that ``us`` lies in, and the time of the slot's next row."""
        slot = us // self._width
        known = self._counts.getValue((slot,))
        if known is None:
            return None, None
        parts = [unpacked(self._pieces.getValue((slot, i))[0]) for i in range(known[0])]
        rows = (parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)).sort_values(self._order, kind="stable", ignore_index=True)
        for i in range(known[0]):
            self._pieces.removeKey((slot, i))
        self._counts.removeKey((slot,))
        ready = int(rows["us"].searchsorted(upto, side="right"))
        later = rows.iloc[ready:]
        if later.empty:
            return rows, None
        self._append(slot, later)
        return rows.iloc[:ready], int(later["us"].iloc[0])

    def slots(self, upto: int) -> list[int]:
        """Slots with waiting rows that begin at ``upto`` or before, in order."""
        return sorted(slot for (slot,) in self._counts.keys() if slot * self._width <= upto)

    def _append(self, slot: int, rows: pd.DataFrame) -> None:
        known = self._counts.getValue((slot,))
        number = known[0] if known is not None else 0
        self._pieces.updateValue((slot, number), (packed(rows),))
        self._counts.updateValue((slot,), (number + 1,))


class InOrder(StatefulProcessor):
    """A machine fed in event-time order.

    Subclasses keep their state in ``open``, and in ``advance`` take the rows
    that are due (maybe none) and return output rows or None.  ``wakes`` names
    times after the rows at which the machine wants to be called again.
    """

    def __init__(self, keys: list[str], columns: list[str], order: list[str], slot: timedelta):
        self._keys, self._columns, self._order = keys, columns, order
        # Timers are kept to the millisecond, so slots are cut there too.
        self._width = max(1, as_micros(slot) // 1000) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        pieces = handle.getMapState("pieces", "slot bigint, number int", "rows binary")
        counts = handle.getMapState("counts", "slot bigint", "n int")
        self._buffer = SlotBuffer(pieces, counts, self._width, self._order)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def advance(self, rows: pd.DataFrame | None, now: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def wakes(self, rows: pd.DataFrame) -> Iterable[int]:
        return ()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in _gathered(rows, self._columns):
            for us in self._buffer.add(part):
                self._handle.registerTimer(us // 1000 + 1)
            for us in self.wakes(part):
                self._handle.registerTimer(-(-us // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows, following = self._buffer.due((now - 1) * 1000, timerValues.getCurrentWatermarkInMs() * 1000)
        if following is not None:
            self._handle.registerTimer(following // 1000 + 1)
        yield from self._keyed(key, self.advance(rows, now * 1000))

    def _keyed(self, key, output: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        if output is not None and len(output):
            for name, value in zip(self._keys, key):
                output.insert(0, name, value)
            yield output

    def close(self) -> None:
        pass


class Folded(InOrder):
    """``fold(state, rows) -> (state, output rows)`` with one small state per key, None at the start."""

    def __init__(self, keys: list[str], state_schema: str, fold: Callable, slot: timedelta = SLOT):
        super().__init__(keys, list(ROW_NAMES), ["us", "tie"], slot)
        self._state_schema, self._fold = state_schema, fold

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", self._state_schema)

    def advance(self, rows, now):
        if rows is None or rows.empty:
            return None
        state, output = self._fold(self._state.get() if self._state.exists() else None, rows)
        self._state.update(state)
        return output


def run_in_order(stream: DataFrame, keys: list[str], machine: InOrder, output_schema: str, event_time: str = "") -> DataFrame:
    """``stream`` has the keys, a watermarked ``ts`` and the columns that the machine takes."""
    key_types = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.groupBy(*keys).transformWithStateInPandas(
        machine, f"{key_types}, {output_schema}", "Append", "EventTime", eventTimeColumnName=event_time
    )
