"""Facts kept from conversations as they go on, and expiry, as Structured Streaming and as batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTPUT = "session_id {kind}, at long, n int, content string"


def auto_retain(messages: DataFrame, every: int = 2, window: int = 6, roles: Sequence[str] = ("user", "assistant"), session: str = "session_id", order: str = "turn") -> DataFrame:
    """(session_id, at, n, content): at every `every`-th counted message, the last `window` messages.

    Only messages of the roles count; the window holds messages of any role up to that one.
    """
    w = W.partitionBy(session).orderBy(order)
    counted = F.col("role").isin(*roles)
    d = messages.withColumn("_c", F.sum(counted.cast("int")).over(w))
    last = w.rowsBetween(-(window - 1), 0)
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.coalesce("content", F.lit("")))
    d = d.withColumn("_w", F.collect_list(line).over(last))
    hit = d.where(counted & (F.col("_c") % every == 0))
    return hit.select(F.col(session).alias("session_id"), F.col(order).cast("long").alias("at"), F.size("_w").alias("n"), F.array_join("_w", "\n").alias("content"))


def auto_retain_stream(messages: DataFrame, every: int = 2, window: int = 6, roles: Sequence[str] = ("user", "assistant"), idle_ms: int | None = None) -> DataFrame:
    """As auto_retain() over a stream of (session_id, turn, role, content): the state of a session is its
    counter and its last messages, a bounded number.  Turns must come in order between batches.  With
    idle_ms, for queries that go on without end, the state of a session that says nothing for so long goes, and
    the session begins anew; without it, as for queries that end with their input, states stay."""
    wanted = set(roles)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["session_id", "at", "n", "content"])
            return
        count, last = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        for turn, role, content in zip(rows["turn"], rows["role"], rows["content"], strict=True):
            last = [*last, f"[{role}] {content or ''}"][-window:]
            if role in wanted:
                count += 1
                if count % every == 0:
                    out.append((key[0], turn, len(last), "\n".join(last)))
        state.update((count, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "at", "n", "content"])

    return messages.groupBy("session_id").applyInPandasWithState(step, OUTPUT.format(kind=dict(messages.dtypes)["session_id"]), "count long, last array<string>", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def last_seen(messages: DataFrame) -> DataFrame:
    """(session_id, updated_at): a session's time is that of its last message."""
    return messages.groupBy("session_id").agg(F.max("created_at").alias("updated_at"))


def expiring(rows: DataFrame, now: Column) -> DataFrame:
    """Rows of a stream or table that have not expired at `now`."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
