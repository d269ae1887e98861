"""The off-hours memory asks the state for little: every call is a message between two processes."""

import pandas as pd

from tidewatch.settings import DAY, HOUR, MINUTE
from tidewatch.streaming import state


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map:
    def __init__(self):
        self.held, self.calls = {}, 0

    def keys(self):
        self.calls += 1
        return iter(list(self.held))

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


def off_hours_count():
    memory = state.OffHoursCount.__new__(state.OffHoursCount)
    memory.span, memory.times = Value(), Map()
    return memory


def counted(memory, times):
    rows = pd.DataFrame({"event_us": times, "off_hours": [True] * len(times)})
    return memory.look_back(rows, None)["off_hours_n"]


def test_pauses_cost_no_state_calls():
    """One event in 30 days, then two in a row: the hours in between are not asked for."""
    memory = off_hours_count()
    assert counted(memory, [0, 30 * DAY, 30 * DAY + HOUR]) == [1, 1, 2]
    assert memory.times.calls <= 4
    assert counted(memory, [60 * DAY]) == [1]
    assert memory.times.calls <= 12


def test_leaving_hours_and_late_rows():
    """The window's edge inside an hour, an hour that empties, and a row from before the oldest hour."""
    memory = off_hours_count()
    assert counted(memory, [10 * DAY, 10 * DAY + 5]) == [1, 2]
    assert counted(memory, [17 * DAY + 3]) == [2]
    assert counted(memory, [2 * DAY]) == [3]
    assert counted(memory, [17 * DAY + 6]) == [2]
    assert {h: list(us) for (h,), (us,) in memory.times.held.items()} == {17 * 24: [17 * DAY + 3, 17 * DAY + 6]}


def test_entities_of_a_bucket_share_a_call():
    """Two hundred entities, one frame out; each goes on from its own resources, the one without a name too."""
    memory = state.BucketResources.__new__(state.BucketResources)
    memory._kept, memory.recent = ["session_id", "event_us", "resource_accessed"], Names()
    names = [None, *(f"u{i}" for i in range(199))]
    for turn in range(12):
        rows = [(n, t, 10 * t, f"{n}/{t}") for t in (2 * turn + 1, 2 * turn) for n in names]
        frame = pd.DataFrame(rows, columns=["entity_id", "session_id", "event_us", "resource_accessed"])
        (out,) = memory.handleInputRows((7,), iter([frame[:150], frame[150:]]), None)
        assert len(out) == 400
        for row in out.itertuples():
            name = row.entity_id if isinstance(row.entity_id, str) else None
            assert row.recent == [f"{name}/{i}" for i in range(max(0, row.session_id - 9), row.session_id + 1)]


class Names(Map):
    def getValue(self, key):
        return self.held.get(key)


class Timers:
    def __init__(self):
        self.set, self.calls, self.now = set(), 0, 0

    def registerTimer(self, ms):
        self.calls += 1
        self.set.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.at

    def fire(self, memory, now):
        """All timers up to a new watermark, one after the other; returns what was emitted."""
        self.now, out = now, []
        for self.at in sorted(t for t in self.set if t <= now):
            self.set.remove(self.at)
            out += [f for f in memory.handleExpiredTimer((7,), self, self) if len(f)]
        return [tuple(r) for f in out for r in f[["entity_id", "session_id", "fails"]].itertuples(index=False)]


class Cleared(Value):
    def clear(self):
        self.value = None


def failure_neighbours(width):
    memory = state.FailureNeighbours.__new__(state.FailureNeighbours)
    memory.width, memory.slots, memory.due, memory.handle = width, Names(), Cleared(), Timers()
    return memory, memory.handle


def failures(*rows):
    return pd.DataFrame(rows, columns=["entity_id", "session_id", "event_us"])


def test_failures_of_a_bucket_share_a_timer():
    """Failures of 200 entities over a day: one timer and one call settle all, none is left behind."""
    memory, timers = failure_neighbours(5 * MINUTE)
    names = [None, *(f"u{i}" for i in range(199))]
    rows = [(n, f"{n}/{k}", DAY + k * 4 * MINUTE + 7) for k in range(300) for n in names]
    list(memory.handleInputRows((7,), iter([failures(*rows)]), None))
    assert timers.calls == 1 and memory.slots.calls <= 4
    got = timers.fire(memory, 10 * DAY // 1000)
    assert sorted(s for _, s, _ in got) == sorted(s for _, s, _ in rows)
    assert {n for s, n in ((s, n) for _, s, n in got) if not s.endswith(("/0", "/299"))} == {3}
    assert {n for _, s, n in got if s.endswith(("/0", "/299"))} == {2}
    assert {e is None for e, s, _ in got if s.startswith("None/")} == {True}
    assert memory.slots.held == {} and memory.due.value is None and not timers.set


def test_failures_are_emitted_when_no_neighbour_can_come():
    """The span after a failure's own has to pass; what the next span needs stays a width longer."""
    width, base = 5 * MINUTE, state.SLOT_SPANS * 5 * MINUTE * 100
    ms = lambda us: us // 1000
    memory, timers = failure_neighbours(width)
    edge = base - MINUTE  # the last span of one slot and the first of the next
    list(memory.handleInputRows((7,), iter([failures(("a", "1", edge), ("b", "2", edge + 2 * MINUTE))]), None))
    assert timers.fire(memory, ms(base + width)) == []
    list(memory.handleInputRows((7,), iter([failures(("a", "3", base + MINUTE), ("a", "4", base + width + MINUTE))]), None))
    assert timers.fire(memory, ms(base + width) + 1) == [("a", "1", 2)]
    assert timers.fire(memory, ms(base + 2 * width)) == []
    assert sorted(timers.fire(memory, ms(base + 2 * width) + 1)) == [("a", "3", 3), ("b", "2", 1)]
    assert [list(v[1]) for v in memory.slots.held.values()] == [["2", "3", "4"]]
    assert timers.fire(memory, ms(base + 9 * width)) == [("a", "4", 2)]
    assert memory.slots.held == {} and not timers.set
