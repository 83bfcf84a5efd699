"""W9 sliding-window limit replay."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Requests per minute for each bucket.
LIMITS = {"upload": 60, "ai_chat": 30, "cleanup": 10}
DEFAULT_LIMIT = 60
_CHUNK_WINDOWS = 20


def decide(recent: deque, now: int, limit: int, window: int) -> tuple[bool, int | None]:
    """One request against the accepted times of its key (microseconds).

    Refused requests are not remembered.  Returns the verdict and, when
    refused, after how many seconds to retry.
    """
    while recent and recent[0] <= now - window:
        recent.popleft()
    if len(recent) < limit:
        recent.append(now)
        return True, None
    return False, max(1, int((window - (now - recent[0])) / 1_000_000))


def _replayer(window: int):
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by key, run and time; state is one deque, not a group
        key, recent = None, deque()
        for pdf in batches:
            accepted, retry = [], []
            for *row_key, us, limit, certain in zip(*(pdf[c] for c in ("bucket", "client", "_run", "_us", "_limit", "_certain"))):
                if key != row_key:
                    key, recent = row_key, deque()
                if certain:
                    recent.append(us)
                    ok, wait = True, None
                else:
                    ok, wait = decide(recent, us, limit, window)
                accepted.append(ok)
                retry.append(wait)
            out = pdf[["event_id", "ts", "client", "bucket"]].copy()
            out["accepted"] = accepted
            out["retry_after"] = pd.array(retry, dtype="Int32")
            yield out

    return replay


def _in_runs(rows: DataFrame, stretch: int) -> DataFrame:
    """Add ``_run``, the time from which on a row's run goes.

    Runs over a stretch's border are found on one row for each stretch, not on the requests.
    """
    keys = ["bucket", "client", "_chunk"]
    by_chunk = Window.partitionBy("bucket", "client").orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys).agg(F.max("_rested").alias("_last"))
    alone = F.coalesce(F.lag("_chunk").over(by_chunk) < F.col("_chunk") - 1, F.lit(True))
    chunks = chunks.withColumn("_island", F.when(alone, F.col("_chunk") * stretch))
    carried = F.greatest(F.max("_island").over(by_chunk), F.max("_last").over(before))
    chunks = chunks.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), carried.alias("_carried"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    so_far = Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    joined = rows.join(chunks, same)
    return joined.withColumn("_run", F.greatest("_carried", F.max("_rested").over(so_far)))


def replay_limits(requests: DataFrame, limits: dict[str, int] | None = None, window_seconds: float = 60) -> DataFrame:
    """Accept a request if fewer than N accepted ones lie in the last window.

    A request with fewer than N requests of any kind before it in the window
    is certainly accepted, whatever the others' fate; a range count over
    (key, stretch of time) settles those in the JVM, spread over the cluster.
    Only stretches holding an unsettled request, and the stretch before each,
    go through Python, streamed in key order with constant state.

    A client's requests are cut into runs where nothing happened for a window,
    or where stretches are left out; runs are independent and go to tasks of
    their own.  Only a client that keeps on sending beyond its limit, never
    resting for a window, is one run: that is walked by one task in constant
    memory, as each verdict hangs on the one before.
    """
    table = {**LIMITS, **(limits or {})}
    window = int(window_seconds * 1_000_000)
    cap = F.lit(DEFAULT_LIMIT)
    for bucket, n in table.items():
        cap = F.when(F.col("bucket") == bucket, n).otherwise(cap)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    stretch = window * _CHUNK_WINDOWS
    base = requests.select("event_id", "ts", "client", "bucket", us.alias("_us"), cap.alias("_limit")).withColumn(
        "_chunk", F.floor(F.col("_us") / stretch)
    )
    # rows near the end of a stretch also serve as look-back of the next one
    near_end = (F.col("_chunk") + 1) * stretch - F.col("_us") <= window
    spread = base.withColumn(
        "_at", F.explode(F.when(near_end, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(F.array("_chunk")))
    )
    frame = Window.partitionBy("bucket", "client", "_at").orderBy("_us").rangeBetween(-window, 0)
    counted = spread.withColumn("_n", F.count("*").over(frame)).filter("_at = _chunk").drop("_at")
    # a request alone in its window starts anew
    counted = counted.withColumns({
        "_certain": F.col("_n") - 1 < F.col("_limit"), "_rested": F.when(F.col("_n") == 1, F.col("_us")),
    }).drop("_n")

    keys = ["bucket", "client", "_chunk"]
    open_chunks = counted.filter("NOT _certain").select(
        "bucket", "client", F.explode(F.array(F.col("_chunk") - 1, F.col("_chunk"))).alias("_chunk")
    ).distinct()
    replayed = _in_runs(counted.join(open_chunks, keys, "left_semi"), stretch)
    replayed = (
        replayed.select("event_id", "ts", "client", "bucket", "_us", "_limit", "_certain", "_run")
        .repartition("bucket", "client", "_run").sortWithinPartitions("bucket", "client", "_run", "_us", "event_id")
    )
    schema = ", ".join(f"{c} {t}" for c, t in requests.select("event_id", "ts", "client", "bucket").dtypes)
    replayed = replayed.mapInPandas(_replayer(window), schema + ", accepted boolean, retry_after int")
    settled = counted.join(open_chunks, keys, "left_anti").select(
        "event_id", "ts", "client", "bucket", F.lit(True).alias("accepted"), F.lit(None).cast("int").alias("retry_after")
    )
    return settled.unionByName(replayed)
