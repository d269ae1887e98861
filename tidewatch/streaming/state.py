"""Per-entity memory of a stream.

The processors only remember and emit earlier values; every score is then
computed from them with the same column expressions as in batch.  Rows of one
micro-batch are handled in time order per entity.

With ``idle_us`` an entity without events for longer than that starts anew: what it
remembers from before such a pause does not count, and an
event-time timer clears its state once the watermark has passed that time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StringType, TimestampType

from tidewatch.constants import LOW_SLOW_DAYS, SEQUENCE_LENGTH
from tidewatch.settings import DAY, HOUR

# Part of the state's key: a query that goes on needs the number it began with.
BUCKETS = 1024
FRAME_ROWS = 10_000
SLOT_SPANS = 288  # a day of five minutes


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """An entity's rows by time, then id. Most entities have a few rows, so every step on a frame counts."""
    parts = list(rows)
    batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    times = batch["event_us"].to_numpy()
    if times.dtype == np.int64:  # without gaps and ties the times alone tell the order
        if (times[1:] > times[:-1]).all():
            return batch
        order = np.argsort(times, kind="stable")
        if (np.diff(times[order]) > 0).all():
            return batch.take(order)
    return batch.sort_values(["event_us", "session_id"])


class Memory(StatefulProcessor):
    """Base of the processors: rows in, the same rows with remembered values out."""

    ADDED: str
    _kept: list[str]

    def __init__(self, stream: DataFrame, idle_us: int | None = None) -> None:
        """The stream's own columns are passed through."""
        kept = [f for f in stream.schema.fields if f.name != "entity_id"]
        key = stream.schema["entity_id"].dataType.simpleString()
        self._kept = [f.name for f in kept]
        self.idle_us = idle_us
        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
        self.OUTPUT = f"entity_id {key}, {own}, {self.ADDED}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.idle_us is not None:
            self.seen = handle.getValueState("seen", "us bigint")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        own = {name: batch[name].array for name in self._kept}
        yield pd.DataFrame({"entity_id": [key[0]] * len(batch), **own, **self.look_back(batch, self._paused(batch))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of an earlier event does nothing if the entity has been seen since.
        if self.seen.exists() and self._expiry(self.seen.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
            self.forget()
        yield pd.DataFrame()

    def _expiry(self, us: int) -> int:
        return (us + self.idle_us) // 1000 + 1

    def _paused(self, batch: pd.DataFrame) -> np.ndarray:
        """Whether a row comes after a pause of its entity; notes when the entity was seen."""
        times = batch["event_us"].to_numpy(np.int64)
        if self.idle_us is None:
            return np.zeros(len(times), bool)
        before = self.seen.get()[0] if self.seen.exists() else None
        latest = int(times[-1])
        # Rows out of order do not bring the last time back.
        if before is None or latest > before:
            self.seen.update((latest,))
            self.handle.registerTimer(self._expiry(latest))
        return np.diff(times, prepend=times[0] if before is None else before) > self.idle_us

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def look_back(self, batch: pd.DataFrame, paused: np.ndarray) -> dict[str, object]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class PreviousEvent(Memory):
    """Adds time and coordinates of the entity's previous event."""

    ADDED = "prev_us bigint, prev_lat double, prev_lon double"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint, lat double, lon double")

    def forget(self):
        self.last.clear()

    def look_back(self, batch, paused):
        seen = self.last.get() if self.last.exists() else (None, None, None)
        times = [seen[0], *batch["event_us"].tolist()]
        lats, lons = ([seen[i], *batch[c].tolist()] for i, c in ((1, "lat"), (2, "lon")))
        known = [None if v is None or pd.isna(v) else float(v) for v in (lats[-1], lons[-1])]
        self.last.update((int(times[-1]), *known))
        out = {
            "prev_us": pd.array(times[:-1], dtype="Int64"),
            "prev_lat": pd.array(lats[:-1], dtype="Float64"),
            "prev_lon": pd.array(lons[:-1], dtype="Float64"),
        }
        for values in out.values():
            values[paused] = pd.NA
        return out


class RecentResources(Memory):
    """Adds the entity's last ten resources, the current one last."""

    ADDED = "recent array<string>"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "resource string")

    def forget(self):
        self.recent.clear()

    def look_back(self, batch, paused):
        before = [row[0] for row in self.recent.get()]
        path = before + batch["resource_accessed"].tolist()
        ends = np.arange(len(before) + 1, len(path) + 1)
        # A path begins at the last pause, if there was one.
        starts = np.maximum.accumulate(np.where(paused, ends - 1, 0))
        starts = np.maximum(starts, ends - SEQUENCE_LENGTH)
        self.recent.put([(resource,) for resource in path[starts[-1] :]])
        return {"recent": [path[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]}


class BucketResources(RecentResources):
    """The same for all entities of a bucket at once, for streams whose state is kept for good.

    Every call of a processor makes frames and an Arrow batch of its own, which for an
    entity of a few dozen rows costs far more than the rows. A bucket's entities share
    them; each still has its own ten resources in the state, found by its name.
    """

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "entity_id string", "resources array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["_entity"] = pd.factorize(batch["entity_id"], use_na_sentinel=False)[0]
        batch = batch.sort_values(["_entity", "event_us", "session_id"])
        names, resources = batch["entity_id"].tolist(), batch["resource_accessed"].tolist()
        edges = [0, *(np.flatnonzero(np.diff(batch["_entity"].to_numpy())) + 1).tolist(), len(batch)]
        recent: list[list] = []
        for a, b in zip(edges, edges[1:]):
            held = self.recent.getValue((names[a],))
            before = list(held[0]) if held is not None else []
            path = before + resources[a:b]
            recent += [path[max(0, end - SEQUENCE_LENGTH) : end] for end in range(len(before) + 1, len(path) + 1)]
            self.recent.updateValue((names[a],), (path[-SEQUENCE_LENGTH:],))
        for a in range(0, len(batch), FRAME_ROWS):
            part = batch.iloc[a : a + FRAME_ROWS]
            own = {name: part[name].array for name in self._kept}
            yield pd.DataFrame({"entity_id": names[a : a + FRAME_ROWS], **own, "recent": recent[a : a + FRAME_ROWS]})


class OffHoursCount(Memory):
    """Adds how many off-hours events the entity had within the last seven days.

    Times are kept per hour, oldest hours first to go, so a micro-batch reads
    only the hour that is arriving and the hour that is leaving the window. Every
    call to the state is a message to the JVM: the hours that are kept are asked for
    once, and hours without events, however long a pause, are never asked for.
    """

    ADDED = "off_hours_n bigint"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "n bigint, oldest bigint")
        self.times = handle.getMapState("times", "hour bigint", "us array<bigint>")

    def forget(self):
        self.span.clear()
        self.times.clear()

    def look_back(self, batch, paused):
        n, oldest = self.span.get() if self.span.exists() else (0, None)
        stored = {key[0] for key in self.times.keys()} if n else set()
        filled = sorted(stored)  # a heap of the hours that may hold times
        open_hours: dict[int, list[int]] = {}

        def hour(h: int) -> list[int]:
            if h not in open_hours:
                open_hours[h] = list(self.times.getValue((h,))[0]) if h in stored else []
            return open_hours[h]

        counts = []
        for us, off in zip(batch["event_us"].tolist(), batch["off_hours"].tolist()):
            if not off:
                counts.append(0)
                continue
            h = us // HOUR
            if not hour(h):
                heapq.heappush(filled, h)
            hour(h).append(us)
            n += 1
            oldest = h if oldest is None else min(oldest, h)
            start = us - LOW_SLOW_DAYS * DAY
            while filled[0] < start // HOUR:
                gone = heapq.heappop(filled)
                n -= len(hour(gone))
                open_hours[gone] = []
            oldest = max(oldest, start // HOUR)
            if oldest == start // HOUR:
                kept = [t for t in hour(oldest) if t >= start]
                n -= len(hour(oldest)) - len(kept)
                open_hours[oldest] = kept
            counts.append(n)
        for h, times in open_hours.items():
            if times:
                self.times.updateValue((h,), (times,))
            elif h in stored:
                self.times.removeKey((h,))
        if oldest is not None:
            self.span.update((n, oldest))
        return {"off_hours_n": counts}


class EntityMemory(Memory):
    """All three memories of an entity in one pass, for scoring events as they come."""

    PARTS = (PreviousEvent, RecentResources, OffHoursCount)
    ADDED = ", ".join(part.ADDED for part in PARTS)

    def __init__(self, stream: DataFrame, idle_us: int | None = None) -> None:
        super().__init__(stream, idle_us)
        self.parts = [part(stream) for part in self.PARTS]

    def open(self, handle: StatefulProcessorHandle) -> None:
        for part in self.parts:
            part.open(handle)

    def forget(self):
        for part in self.parts:
            part.forget()

    def look_back(self, batch, paused):
        found = {}
        for part in self.parts:
            found |= part.look_back(batch, paused)
        return found


def remember(stream: DataFrame, kind: type[Memory], idle: int | None = None) -> DataFrame:
    """``idle`` (microseconds) needs a stream with a watermark; without it state is kept for good."""
    if idle is not None and kind in (OffHoursCount, EntityMemory) and idle < LOW_SLOW_DAYS * DAY:
        raise ValueError("off-hours events count for seven days, so state has to be kept as long")
    if idle is not None:
        return _remembered(stream, kind(stream, idle), "EventTime")
    # Without timers nothing in the processor needs timestamps: as numbers they cost each frame less.
    times = [f.name for f in stream.schema.fields if isinstance(f.dataType, TimestampType)]
    plain = stream.withColumns({c: F.unix_micros(c) for c in times})
    own = stream.schema["entity_id"].dataType
    if kind is RecentResources and isinstance(own, (StringType, IntegralType)):
        # Names as text, so that missing ones do not turn numbers into floats.
        named = plain.withColumn("entity_id", F.col("entity_id").cast("string"))
        out = _remembered(dealt(named), BucketResources(named), "None", "_bucket").withColumn("entity_id", F.col("entity_id").cast(own))
    else:
        out = _remembered(plain, kind(plain), "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def dealt(stream: DataFrame) -> DataFrame:
    return stream.withColumn("_bucket", F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)))


def _remembered(stream: DataFrame, processor: Memory, time_mode: str, key: str = "entity_id") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode=time_mode
    )


class FailureNeighbours(StatefulProcessor):
    """Emits each failure with the number of its entity's failures within ``width`` of it, before and after.

    Time is cut into spans of the width. Once the watermark has passed the span after a
    failure's own, no neighbour can come any more and the failure is emitted; one
    width later, when the next span does not need it either, it is dropped. So
    an entity keeps a few spans, and none when idle.

    A key is a bucket of entities, as in :class:`BucketResources`. It has one event-time
    timer, for whatever comes first, and a call settles all that is due by then. Rows
    are stored by slots of many spans, so neither the calls to the state nor
    the timers grow with the failures.
    """

    def __init__(self, stream: DataFrame, width: int) -> None:
        if width % 1000:
            raise ValueError("timers need a width in whole milliseconds")
        self.width = width
        self.kinds = {c: stream.schema[c].dataType.simpleString() for c in ("entity_id", "session_id")}
        self.OUTPUT = ", ".join(f"{c} {kind}" for c, kind in self.kinds.items()) + ", event_us bigint, fails bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names, ids = (f"array<{self.kinds[c]}>" for c in ("entity_id", "session_id"))
        self.slots = handle.getMapState("slots", "slot bigint", f"names {names}, ids {ids}, us array<bigint>, emitted array<boolean>")
        self.due = handle.getValueState("due", "ms bigint")

    def _expiry(self, span: int) -> int:
        return int(span) * self.width // 1000 + 1

    def _wake(self, ms: int) -> None:
        self.due.update((ms,))
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        soonest = due
        for part in rows:
            us = part["event_us"].to_numpy(np.int64)
            columns = [part["entity_id"], part["session_id"], pd.Series(us)]
            for slot, at in part.groupby(us // self.width // SLOT_SPANS).indices.items():
                slot = int(slot)
                new = [c.iloc[at].tolist() for c in columns] + [[False] * len(at)]
                held = self.slots.getValue((slot,))
                if held is not None:
                    new = [[*old, *more] for old, more in zip(held, new, strict=True)]
                self.slots.updateValue((slot,), tuple(new))
            first = self._expiry(us.min() // self.width + 2)
            soonest = first if soonest is None else min(first, soonest)
        if soonest != due:
            self._wake(soonest)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if not self.due.exists() or self.due.get()[0] > now:  # an earlier call has done it
            yield pd.DataFrame()
            return
        edge = (now - 1) * 1000 // self.width  # failures are due up to the span two before it
        stored = sorted(k[0] for k in self.slots.keys())
        slots = [s for s in stored if s <= (edge - 1) // SLOT_SPANS]
        wake = [self._expiry(s * SLOT_SPANS + 2) for s in stored[len(slots) : len(slots) + 1]]
        read: dict[int, list] = {}
        begin = 0
        while begin < len(slots):
            # Some slots at once, with their neighbours as they were.
            end, n = begin, 0
            while end < len(slots) and n < FRAME_ROWS:
                n += len(self._read(read, slots[end])[2])
                end += 1
            around = slots[max(0, begin - 1) : end + 1]
            names, ids, us, emitted = (list(chain.from_iterable(self._read(read, s)[k] for s in around)) for k in range(4))
            slot = np.repeat(around, [len(read[s][2]) for s in around])
            us, emitted = np.array(us, np.int64), np.array(emitted, bool)
            span = us // self.width
            own = (slot >= slots[begin]) & (slot <= slots[end - 1])
            out = np.flatnonzero(own & ~emitted & (span <= edge - 2))
            fails = neighbours(pd.factorize(np.array(names, object), use_na_sentinel=False)[0], us, self.width)
            for a in range(0, len(out), FRAME_ROWS):
                at = out[a : a + FRAME_ROWS]
                yield pd.DataFrame({"entity_id": [names[k] for k in at], "session_id": [ids[k] for k in at], "event_us": us[at], "fails": fails[at]})
            emitted[out] = True
            needed = own & (span >= edge - 2)
            for s in slots[begin:end]:
                kept = np.flatnonzero(needed & (slot == s)) if s >= (edge - 2) // SLOT_SPANS else ()
                if len(kept):
                    self.slots.updateValue((s,), ([names[k] for k in kept], [ids[k] for k in kept], us[kept].tolist(), emitted[kept].tolist()))
                    wake.append(self._expiry((span[kept] + np.where(emitted[kept], 3, 2)).min()))
                else:
                    self.slots.removeKey((s,))
            begin = end
            for s in [s for s in read if begin < len(slots) and s < slots[begin - 1]]:
                del read[s]
        if wake:
            self._wake(min(wake))
        else:
            self.due.clear()
        yield pd.DataFrame()

    def _read(self, read: dict[int, list], slot: int) -> list:
        if slot not in read:
            read[slot] = [list(x) for x in self.slots.getValue((slot,))]
        return read[slot]

    def close(self) -> None:
        pass


def neighbours(entity: np.ndarray, us: np.ndarray, width: int) -> np.ndarray:
    """How many rows of the same entity lie within ``width`` of each row, itself included."""
    times = np.unique(us)
    base = entity * (len(times) + 1)
    low, high = np.searchsorted(times, us - width, "left"), np.searchsorted(times, us + width, "right")
    placed = np.sort(base + np.searchsorted(times, us))
    return np.searchsorted(placed, base + high) - np.searchsorted(placed, base + np.minimum(low, high))
