"""Rules that depend on the order of events: rows wait in the state until the watermark has passed them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Processors of this kind need state that is kept per key and column family.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MICROS = 1_000_000
#: Completed scans of an organisation are kept in blocks of so many neighbouring numbers.
SCANS = 1 << 14
_TYPES = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "array<long>": T.ArrayType(T.LongType()), "binary": T.BinaryType()}


def fields(text: str) -> T.StructType:
    """A schema from ``name type, …``; state is set up in workers, which have no session to parse it."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


class InOrder(StatefulProcessor):
    """Takes the rows of a key by event time, then event_id, however they are dealt over batches.

    A row is kept in a list until the watermark has passed it; a timer on the oldest waiting row wakes the key. So the list holds the rows of the
    watermark's delay only, and a batch's size or order changes nothing. A rule gives ``step`` for each row and, where time alone
    has effects, ``tick`` for the watermark; both return output rows. Rule state is one value per key. Each use of the state is a call to the
    state's process, so values are read once and written where
    they changed, the rows of a batch wait as one value, and nothing is sent out where there are no rows.
    """

    waiting = "at long, event_id long"
    state = "last long"
    out: list[str] = []
    types: dict[str, str] = {}

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", fields("rows binary"))
        self.next = handle.getValueState("next", fields("at long"))
        self.memory = handle.getValueState("memory", fields(self.state))
        self.names = fields(self.waiting).fieldNames()

    def start(self) -> tuple:
        return (None,)

    def step(self, key, state: tuple, row: tuple, out: list) -> tuple:
        raise NotImplementedError

    def steps(self, key, state: tuple, rows: list, out: list) -> tuple:
        for row in rows:
            state = self.step(key, state, row, out)
        return state

    def tick(self, key, state: tuple, now: int, out: list) -> tuple[tuple, int | None]:
        """Called when the watermark is at ``now``; returns the state and when to be called again."""
        return state, None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = (self.next.get() or (None,))[0]
        for part in rows:
            new = list(zip(*(part[n].tolist() for n in self.names), strict=True))
            if new:
                self.rows.appendValue((pickle.dumps(new),))
                low = int(part["at"].min())
                if first is None or low < first:
                    first = low
                    self._wake(low)
        return iter(())

    def _wake(self, at: int) -> None:
        self.next.update((at,))
        self.handle.registerTimer(-(-at // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r for (part,) in self.rows.get() for r in pickle.loads(part))
        ready = [r for r in waiting if r[0] <= now]
        rest = waiting[len(ready):]
        before, out = tuple(self.memory.get() or self.start()), []
        state = self.steps(key, before, ready, out)
        state, call = self.tick(key, state, now, out)
        if ready and rest:
            self.rows.put([(pickle.dumps(rest),)])
        elif ready:
            self.rows.clear()
        if state != before:
            self.memory.update(state)
        wake = min([rest[0][0]] if rest else [], default=None)
        if call is not None:
            wake = call if wake is None else min(wake, call)
        if wake is None:
            self.next.clear()
        elif (self.next.get() or (None,))[0] != wake:
            self._wake(wake)
        return iter([pd.DataFrame(out, columns=self.out).astype(self.types)] if out else [])

    def close(self) -> None:
        pass


def in_order(events: DataFrame, keys: list[str], rule: InOrder, schema: str) -> DataFrame:
    """``rule`` over ``events`` (keys, event_id, ts with a watermark, and the rule's own columns)."""
    events.sparkSession.conf.set(*STORE)
    return events.withColumn("at", F.unix_micros("ts")).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=rule, outputStructType=fields(schema), outputMode="Append", timeMode="EventTime")


class RateLimit(InOrder):
    state = "hits array<long>"
    out, types = ["org_id", "event_id", "allowed"], {"org_id": "int64", "event_id": "int64", "allowed": "bool"}

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * MICROS

    def start(self):
        return ([],)

    def step(self, key, state, row, out):
        hits = [h for h in state[0] if h > row[0] - self.span]
        allowed = len(hits) < self.limit
        out.append((key[0], row[1], allowed))
        return (hits + [row[0]] if allowed else hits,)


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Each hit with its verdict; only accepted hits count against the limit of the last ``seconds``."""
    return in_order(events, ["org_id"], RateLimit(limit, seconds), "org_id long, event_id long, allowed boolean")


class Allowance(InOrder):
    state = "used long, until long"
    out, types = ["org_id", "event_id", "place", "blocked"], {"org_id": "int64", "event_id": "int64", "place": "int32", "blocked": "bool"}

    def __init__(self, limit: int, hours: int):
        self.limit, self.span = limit, hours * 3600 * MICROS

    def start(self):
        return (0, None)

    def step(self, key, state, row, out):
        used, until = state
        if until is not None and row[0] < until:
            out.append((key[0], row[1], 0, True))
            return state
        used += 1
        out.append((key[0], row[1], used, False))
        return (0, row[0] + self.span) if used == self.limit else (used, until)


def allowance_stream(events: DataFrame, limit: int, hours: int) -> DataFrame:
    """Rolling allowance: every completion with its place in the batch, or blocked while it cools down."""
    return in_order(events, ["org_id"], Allowance(limit, hours), "org_id long, event_id long, place int, blocked boolean")


class Overdue(InOrder):
    waiting = "at long, event_id long, opens boolean"
    state = "due long"
    out, types = ["org_id", "due"], {"org_id": "int64", "due": "datetime64[us]"}

    def __init__(self, hours: int):
        self.span = hours * 3600 * MICROS

    def step(self, key, state, row, out):
        if state[0] is not None and state[0] < row[0]:
            out.append((key[0], pd.Timestamp(state[0], unit="us")))
        return (row[0] + self.span if row[2] else None,)

    def tick(self, key, state, now, out):
        due = state[0]
        if due is not None and due < now:
            out.append((key[0], pd.Timestamp(due, unit="us")))
            due = None
        return (due,), None if due is None else due + 1


def overdue_timers(events: DataFrame, hours: int) -> DataFrame:
    """An opening event starts a timer, any other one stops it; an expired timer emits once, when the watermark has passed it."""
    return in_order(events.withColumn("opens", F.col("event_type") == "signup"), ["org_id"], Overdue(hours), "org_id long, due timestamp")


def overdue_behind(events: DataFrame, hours: int, minutes: int) -> DataFrame:
    """Timers that the stream's last watermark has not passed, but that the table at rest shows expired: a later event is known to come after
    the due time, or the due time lies within the watermark's last millisecond (watermarks are whole milliseconds).

    ``events`` is the whole table, not a stream; ``minutes`` the watermark's delay. Only events of the last ``hours`` are windowed.
    """
    span, whole = hours * 3600 * MICROS, F.floor(F.col("end") / 1000) * 1000
    e = events.withColumn("at", F.unix_micros("ts"))
    tail = e.crossJoin(e.agg((F.max("at") - minutes * 60 * MICROS).alias("end"))).where(F.col("at") + span >= whole)
    later = F.lead("at").over(Window.partitionBy("org_id").orderBy("at", "event_id"))
    due = tail.select("org_id", "event_type", (F.col("at") + span).alias("due"), F.coalesce(later, "end").alias("until"))
    return due.where("event_type = 'signup' AND due < until").select("org_id", F.timestamp_micros("due").alias("due"))


class Completions(InOrder):
    waiting = "at long, event_id long, scan_id long, status string"
    out, types = ["org_id", "scan_id", "event_id"], {"org_id": "int64", "scan_id": "int64", "event_id": "int64"}

    def init(self, handle):
        super().init(handle)
        self.done = handle.getMapState("done", fields("block long"), fields("scans array<long>"))

    def steps(self, key, state, rows, out):
        """Scans whose last status is completed are in a map, in blocks of SCANS numbers; a block is read once a call and written where it changed."""
        blocks: dict = {}
        for _, event, scan, status in rows:
            at = scan // SCANS
            if at not in blocks:
                was = frozenset((self.done.getValue((at,)) or ([],))[0])
                blocks[at] = (was, set(was))
            done = blocks[at][1]
            if status != "completed":
                done.discard(scan)
            elif scan not in done:
                done.add(scan)
                out.append((key[0], scan, event))
        for at, (was, done) in blocks.items():
            if not done and was:
                self.done.removeKey((at,))
            elif done != was:
                self.done.updateValue((at,), (sorted(done),))
        return state


def completions(events: DataFrame) -> DataFrame:
    """Emits the moment a scan turns completed from anything else; the completed scans of an organisation are kept in a map."""
    return in_order(events, ["org_id"], Completions(), "org_id long, scan_id long, event_id long")
