"""Limits and ledgers as streams with keyed state that survives a restart and goes when it says nothing any more.

State lies in the state store (RocksDB) and is written to the checkpoint with every batch, so a stream that is started again goes on
where it was. The limits set an event-time timer for the moment from which a key's state is what a new key's would be, and clear
it then: the number of keys kept is that of the keys active of late, and results are the same as if all were kept.

Rows of a key within one batch are taken in the order of time, then id; batches must come in order of time up to the watermark. Nulls
in the key are a key; a row without a time is passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(seconds: float) -> int:
    return int(seconds * 1000)


def _seconds(at: datetime) -> float:
    return (at if at.tzinfo else at.astimezone(timezone.utc)).timestamp()


class _Keyed(StatefulProcessor):
    """One value a key, cleared by the last timer that was set for it."""

    state_ddl = ""

    def __init__(self, ts: str, order: str):
        self.ts, self.order = ts, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_ddl)

    def until(self, seconds: float) -> None:
        """Clears the key's state at a time; earlier timers of the key are taken back."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_ms(seconds))

    def sorted(self, rows: Iterator[Row]) -> list[tuple[float, Row]]:
        timed = [(_seconds(r[self.ts]), r) for r in rows if r[self.ts] is not None]
        return sorted(timed, key=lambda x: (x[0], x[1][self.order]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class TokenBucket(_Keyed):
    """Each event takes a token if there is one; ``rate`` come back each second, ``burst`` at most. Full again, a bucket is as if new."""

    state_ddl = "tokens double, last double"

    def __init__(self, ts: str, order: str, key: str, rate: float, burst: float):
        super().__init__(ts, order)
        self.key, self.rate, self.burst = key, rate, burst

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        tokens, last = self.state.get() if self.state.exists() else (self.burst, None)
        out = []
        for now, r in self.sorted(rows):
            tokens = self.burst if last is None else min(self.burst, tokens + max(0.0, now - last) * self.rate)
            last = now if last is None else max(last, now)
            allowed = tokens >= 1
            tokens -= allowed
            out.append(Row(**{self.key: key[0], self.order: r[self.order], "allowed": allowed}))
        if last is not None:
            self.state.update((tokens, last))
            self.until(last + (self.burst - tokens) / self.rate + 0.001)
        return iter(out)


class DailyBudget(_Keyed):
    """The first ``limit`` events of a key on a day (UTC) are allowed; a day's count goes with the day."""

    state_ddl = "day int, used int"

    def __init__(self, ts: str, order: str, key: str, limit: int):
        super().__init__(ts, order)
        self.key, self.limit = key, limit

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        day, used = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for now, r in self.sorted(rows):
            if day is None or int(now // 86400) > day:
                day, used = int(now // 86400), 0
            used += 1
            out.append(Row(**{self.key: key[0], self.order: r[self.order], "used": used, "within": used <= self.limit}))
        if day is not None:
            self.state.update((day, used))
            self.until((day + 1) * 86400)
        return iter(out)


class Ledger(StatefulProcessor):
    """What a run has spent and what is reserved: a later reservation of the same name takes the place of the earlier, a release ends it.

    Reservations are a map; one that nobody releases ends ``open_for`` seconds after it was made, by a timer. The sum spent stays.
    """

    def __init__(self, ts: str, order: str, key: str, name: str, kind: str, amount: str, open_for: float):
        self.ts, self.order, self.key, self.name, self.kind, self.amount, self.open_for = ts, order, key, name, kind, amount, open_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent double, n long")
        self.reserved = handle.getMapState("reserved", "name string", "amount double, ends double")

    def _told(self, key: Any, spent: float, n: int, reserved: Iterable[tuple[float, float]]) -> Iterator[Row]:
        self.spent.update((spent, n))
        return iter([Row(**{self.key: key[0], "spent": spent, "reserved": float(sum(v[0] for v in reserved)), "n": n})])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """A call to the state costs more than a row, so a batch's changes are made here and only what is left of them is written."""
        known = self.spent.exists()
        spent, n = self.spent.get() if known else (0.0, 0)
        before = {name[0]: tuple(v) for name, v in self.reserved.iterator()} if known else {}
        now = dict(before)
        for r in sorted((r for r in rows if r[self.ts] is not None), key=lambda r: (r[self.ts], r[self.order])):
            n += 1
            name, kind = str(r[self.name]), r[self.kind]
            if kind == "spend":
                spent += r[self.amount] or 0.0
            elif kind == "reserve":
                now[name] = (r[self.amount] or 0.0, _seconds(r[self.ts]) + self.open_for)
            elif kind == "release":
                now.pop(name, None)
        for name, entry in now.items():
            if entry != before.get(name):
                self.reserved.updateValue((name,), entry)
                self.handle.registerTimer(_ms(entry[1]))  # of those that were replaced or released none is needed
        for name in before.keys() - now.keys():
            self.reserved.removeKey((name,))
        return self._told(key, spent, n, (now[name] for name in sorted(now)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ended = [name for name, (_, ends) in list(self.reserved.iterator()) if _ms(ends) <= now]
        if not ended:  # released, or made anew, since the timer was set
            return iter(())
        for name in ended:
            self.reserved.removeKey(name)
        spent, n = self.spent.get()
        return self._told(key, spent, n + 1, self.reserved.values())

    def close(self) -> None:
        pass


def token_bucket(rows: DataFrame, key: str, ts: str, order: str, rate: float, burst: float, late: str = "0 seconds") -> DataFrame:
    """key, order, allowed for every event of a stream; ``order`` is an integer that tells events of one moment apart."""
    out = f"{key} {rows.schema[key].dataType.simpleString()}, {order} long, allowed boolean"
    return rows.withWatermark(ts, late).groupBy(key).transformWithState(TokenBucket(ts, order, key, rate, burst), out, "Append", "EventTime")


def daily_budget(rows: DataFrame, key: str, ts: str, order: str, limit: int, late: str = "0 seconds") -> DataFrame:
    """key, order, used (on that day so far), within."""
    out = f"{key} {rows.schema[key].dataType.simpleString()}, {order} long, used int, within boolean"
    return rows.withWatermark(ts, late).groupBy(key).transformWithState(DailyBudget(ts, order, key, limit), out, "Append", "EventTime")


def ledger(rows: DataFrame, key: str, ts: str, order: str, name: str, kind: str, amount: str, open_for: float = 365 * 86400.0, late: str = "0 seconds") -> DataFrame:
    """key, spent, reserved, n (changes so far) of every key whose entries or timers came; the last row of a key is its state."""
    out = f"{key} {rows.schema[key].dataType.simpleString()}, spent double, reserved double, n long"
    return rows.withWatermark(ts, late).groupBy(key).transformWithState(Ledger(ts, order, key, name, kind, amount, open_for), out, "Append", "EventTime")


def drain(stream: DataFrame, out: str, checkpoint: str, parts: int | None = None) -> dict | None:
    """Everything that has come since the last call, appended to ``out`` as Parquet, each once; gives the last progress.

    parts: over how many partitions a new stream's state is dealt, the session's shuffle partitions unless given; it stays as it was first.
    """
    spark: SparkSession = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def last_of(rows: DataFrame, key: str, n: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), n).alias("r")).select("r.*")
