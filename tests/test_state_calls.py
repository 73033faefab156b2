"""An ordered rule calls the state's process a few times per key and batch, not per event."""

import pandas as pd

from shelfwright.streaming import ordered as O


class Store:
    """State of one key in memory; ``calls`` counts what would go to the state's process."""

    def __init__(self):
        self.calls, self.value, self.list, self.map, self.timers = 0, None, [], {}, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"getListState": self, "getValueState": self, "getMapState": self}.get(name) or getattr(type(self), "_" + name)(self, *args)
        return call

    def _exists(self): return self.value is not None or bool(self.list)
    def _update(self, v): self.value = v
    def _appendValue(self, v): self.list.append(v)
    def _appendList(self, v): self.list += v
    def _put(self, v): self.list = list(v)
    def _clear(self): self.value, self.list = None, []
    def _get(self): return self.value if self.value is not None else iter(self.list)
    def _registerTimer(self, at): self.timers.append(at)
    def _containsKey(self, k): return k in self.map
    def _getValue(self, k): return self.map.get(k)
    def _updateValue(self, k, v): self.map[k] = v
    def _removeKey(self, k): self.map.pop(k)


class Handle(Store):
    def __init__(self):
        super().__init__()
        self.parts = {}

    def __getattr__(self, name):
        if name in ("getListState", "getValueState", "getMapState"):
            return lambda state, *_: self.parts.setdefault((name, state), Value() if name == "getValueState" else Store())
        return super().__getattr__(name)

    def total(self):
        return self.calls + sum(p.calls for p in self.parts.values())


class Value(Store):
    def _get(self): return self.value


class Clock:
    def __init__(self, ms): self.ms = ms
    def getCurrentWatermarkInMs(self): return self.ms


def test_completions_in_few_calls():
    rows = [(t * 1000, t, t * 7 % 50, "completed" if t % 3 else "open") for t in range(1, 3001)]
    want, last = [], {}
    for _, event, scan, status in rows:
        if status == "completed" and last.get(scan) != "completed":
            want.append((5, scan, event))
        last[scan] = status
    rule, handle = O.Completions(), Handle()
    rule.init(handle)
    got = []
    for k in range(0, 3000, 1000):
        frame = pd.DataFrame(rows[k:k + 1000], columns=["at", "event_id", "scan_id", "status"]).sample(frac=1, random_state=k)
        list(rule.handleInputRows((5,), iter([frame]), None))
        for out in rule.handleExpiredTimer((5,), Clock(k + 900), None):
            got += list(out.itertuples(index=False, name=None))
    for out in rule.handleExpiredTimer((5,), Clock(3000), None):
        got += list(out.itertuples(index=False, name=None))
    assert got == want
    assert handle.total() < 100
