"""ST1 as a stateful processor: requests wait in the state store, slot by slot, until the watermark has passed."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkwell.operators.limits import DEFAULT_LIMIT, LIMITS, decide

#: Groups of keys that share their state.
GROUPS = 64
#: Slots whose requests lie together in the state store.
SPAN = 8
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers and maps of a stateful processor need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Limiter(StatefulProcessor):
    """Decides the requests of one group of (bucket, client) keys in the order of (time, event id).

    A call to the state store takes far longer than a request, so keys share their state and calls go by group and span of
    slots: ``waiting`` maps a span and a running number to requests of a batch, ``open`` holds the spans that wait, their
    numbers and first slots, ``accepted`` the accepted times of the last window, of each key at most the limit.  A timer
    at the end of the first open slot decides all slots that the watermark has passed; with none left, one after the last
    window forgets the group.  In memory there is one batch of rows or one span of a group at a time.
    """

    def __init__(self, limits: dict[str, int], window: int, slot: int):
        self.limits, self.window, self.slot = limits, window, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", "span long, part int", "buckets array<string>, clients array<string>, us array<long>, events array<long>"
        )
        self.open = handle.getValueState("open", "spans array<long>, parts array<int>, firsts array<long>")
        self.accepted = handle.getValueState("accepted", "buckets array<string>, clients array<string>, us array<long>")

    def _end(self, slot: int) -> int:
        """Milliseconds at which a slot is over, rounded up."""
        return -(-(slot + 1) * self.slot // 1000)

    def _spans(self) -> dict[int, tuple[int, int]]:
        """Number of parts and first slot of each open span."""
        held = self.open.get()
        return {span: (parts, first) for span, parts, first in zip(*held)} if held else {}

    def _wait(self, spans: dict, span: int, first: int, rows: tuple) -> None:
        parts, before = spans.get(span, (0, first))
        spans[span] = parts + 1, min(before, first)
        self.waiting.updateValue((span, parts + 1), rows)

    def _keep(self, spans: dict) -> None:
        self.open.update((list(spans), *(list(x) for x in zip(*spans.values()))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = self._spans()
        before = min((first for _, first in spans.values()), default=None)
        for part in rows:
            us, known = part["us"].to_numpy(np.int64), part["known"].to_numpy(bool)
            order = np.argsort(us, kind="stable")
            cuts = np.flatnonzero(np.diff(us[order] // self.slot // SPAN)) + 1
            buckets, clients = (part[c].astype(object).where(part[c].notna(), None).to_numpy() for c in ("bucket", "client"))
            events = np.where(known, part["event"].to_numpy(object), None)
            for here in np.split(order, cuts):
                first = int(us[here[0]]) // self.slot
                self._wait(spans, first // SPAN, first, tuple(x[here].tolist() for x in (buckets, clients, us, events)))
        self._keep(spans)
        first = min(first for _, first in spans.values())
        if before is None or first < before:
            self.handle.registerTimer(self._end(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        spans = self._spans()
        due = sorted(span for span, (_, first) in spans.items() if self._end(first) <= now)
        if spans and not due:  # the timer of an earlier slot has seen to this one
            return
        recent = defaultdict(deque)
        for bucket, client, at in zip(*(self.accepted.get() or ((), (), ()))):
            recent[bucket, client].append(at)
        for span in due:
            yield self._decided(spans, span, now, recent)
        # no later request is in a slot before this time
        start = (now * 1000 // self.slot - 1) * self.slot
        kept = [(*who, at) for who, times in recent.items() for at in times if at > start - self.window]
        if kept:
            self.accepted.update(tuple(map(list, zip(*kept))))
        else:
            self.accepted.clear()
        if spans:
            self._keep(spans)
            self.handle.registerTimer(self._end(min(first for _, first in spans.values())))
        else:
            self.open.clear()
            if kept:
                self.handle.registerTimer(-(-(max(at for *_, at in kept) + self.window + 2 * self.slot) // 1000))

    def _decided(self, spans: dict, span: int, now: int, recent: dict[tuple, deque]) -> pd.DataFrame:
        """Verdicts on a span's requests whose slots are over; the accepted ones join ``recent``, the other requests go on waiting."""
        rows: tuple = [], [], [], []
        for part in range(1, spans.pop(span)[0] + 1):
            for column, more in zip(rows, self.waiting.getValue((span, part))):
                column += more
            self.waiting.removeKey((span, part))
        buckets, clients, us, events = rows
        order = sorted(range(len(us)), key=lambda i: (us[i], events[i] is None, events[i] or 0))
        over = sum(self._end(us[i] // self.slot) <= now for i in order)  # the first ones, as slots end one after another
        order, later = order[:over], order[over:]
        if later:
            self._wait(spans, span, us[later[0]] // self.slot, tuple([x[i] for i in later] for x in rows))
        verdicts = [
            decide(recent[buckets[i], clients[i]], us[i], self.limits.get(buckets[i], DEFAULT_LIMIT), self.window) for i in order
        ]
        return pd.DataFrame({
            "event_id": pd.array([events[i] for i in order], "Int64"), "bucket": [buckets[i] for i in order],
            "client": [clients[i] for i in order], "accepted": [ok for ok, _ in verdicts],
            "retry_after": pd.array([wait for _, wait in verdicts], dtype="Int32"),
        })

    def close(self) -> None:
        pass


def _as_text(client: Column, kind: str) -> Column:
    """A client as text that stands for it alone and for equal ones."""
    if kind in ("float", "double"):
        client = client + F.lit(0.0).cast(kind)  # one zero
    if kind == "binary":
        return F.hex(client)
    return (F.unix_micros(client) if kind == "timestamp" else client).cast("string")


def _from_text(client: Column, kind: str) -> Column:
    if kind == "binary":
        return F.unhex(client)
    return F.timestamp_micros(client.cast("long")) if kind == "timestamp" else client.cast(kind)


def rate_limit_stream(requests: DataFrame, limits: dict[str, int] | None = None, window_seconds: float = 60,
                      watermark: str = "2 minutes", slot_seconds: float | None = None, groups: int = GROUPS) -> DataFrame:
    """ST1: the replay rule on a live stream, in order of event time however the rows arrive.

    A request is decided once the watermark has passed the end of its slot (an eighth of the window by default), so the
    verdicts do not depend on how rows fall into micro-batches.  Rows later than the watermark and rows without time
    have no verdict.  Start the query inside ``state_on_disk``.

    Keys are dealt over ``groups`` groups by hash; a task decides at least one group, so more of them use more tasks and
    less memory, and take more calls to the state store.  A query that goes on from its checkpoint needs the same number.
    """
    window = int(window_seconds * 1_000_000)
    slot = max(1000, int((slot_seconds or window_seconds / 8) * 1_000_000))
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL").withWatermark("ts", watermark)
    client_type = dict(rows.dtypes)["client"]
    # pandas has no nulls in whole numbers: ids go with a mark, clients as text
    rows = rows.select(
        F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event"), F.col("event_id").isNotNull().alias("known"), "ts",
        _as_text(F.col("client"), client_type).alias("client"), F.col("bucket").cast("string").alias("bucket"), F.unix_micros("ts").alias("us"),
    )
    decided = rows.withColumn("group", F.pmod(F.xxhash64("bucket", "client"), F.lit(groups)).cast("int")).groupBy("group").transformWithStateInPandas(
        Limiter({**LIMITS, **(limits or {})}, window, slot),
        "event_id long, bucket string, client string, accepted boolean, retry_after int", "append", "EventTime",
    )
    return decided.withColumn("client", _from_text(F.col("client"), client_type))
