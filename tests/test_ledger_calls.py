"""A ledger's calls to its state go with the keys of a batch, not with its rows."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from pressmark.streaming.stateful import Ledger

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


class State:
    """A value, a map and timers that count what is asked of them."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, [], 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "values": lambda: iter(self.map.values()), "iterator": lambda: iter(self.map.items()),
            "containsKey": lambda k: k in self.map, "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "registerTimer": self.timers.append, "getValueState": lambda *_: self, "getMapState": lambda *_: self,
        }[name]


def entry(k, kind, usd, name="call"):
    return Row(id=k, ts=START + timedelta(seconds=k), name=name, kind=kind, usd=usd)


def test_a_thousand_entries_of_a_key(spark):
    state = State()
    ledger = Ledger("ts", "id", "user", "name", "kind", "usd", 60.0)
    ledger.init(state)
    rows = [entry(k, ("reserve", "spend", "release", "reserve")[k % 4], 1.0 + k) for k in range(1000)]
    state.calls = 0
    [told] = ledger.handleInputRows(("a",), iter(rows[::-1]), None)
    assert (told.n, told.spent, told.reserved) == (1000, sum(1.0 + k for k in range(1, 1000, 4)), 1000.0)
    assert state.calls < 10 and state.timers == [int((START.timestamp() + 999 + 60) * 1000)]
    more = [entry(1000, "release", None), entry(1001, "reserve", 2.0, "x"), entry(1002, "reserve", 3.0, "y"), entry(1003, "release", None, "x"), entry(1004, "release", None, "z")]
    [told] = ledger.handleInputRows(("a",), iter(more), None)
    assert (told.n, told.reserved, set(state.map)) == (1005, 3.0, {("y",)})
