"""Rate limits, debounced batches and running scores over streams, and the same folds over bounded tables.

A fold over the events of a key in order is one Python function of state. Batch queries run it over sorted partitions; streams hold events back until the
watermark has passed them, so that they too are folded in order of time, and keep state and events that wait between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept(times: list[float], recent: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which calls of sorted times pass, given recently accepted ones; rejected calls leave no trace."""
    passed = []
    for t in times:
        recent = [r for r in recent if t - r < seconds]
        passed.append(len(recent) < most)
        if passed[-1]:
            recent.append(t)
    return passed, recent


LIMITED = "key long, event_id long, accepted boolean"


class Fold(NamedTuple):
    """A fold over the events (key, event_id, ts, columns) of each key in order of time and id.

    `step` gets the state and an event with t in seconds and gives the new state and finished rows (without the key). `finish` gives the rows left at a key's
    end, and `deadline` the time after which no event can change them, None without any. After `forget` seconds without events a state is as good
    as a new one. States are made of what JSON holds."""

    columns: list[str]
    start: Callable[[], Any]
    step: Callable[[Any, dict], tuple[Any, list[tuple]]]
    schema: str
    finish: Callable[[Any], list[tuple]] | None = None
    deadline: Callable[[Any], float | None] | None = None
    closed: Callable[[Any], Any] | None = None
    forget: float | None = None


def folded(events: DataFrame, fold: Fold) -> DataFrame:
    """The fold over bounded events: keys are hashed to partitions and sorted there, and the state goes from one Arrow batch to the next; so a task holds a
    batch and one state, however many events a key has."""
    columns, start, step, schema, finish = fold[:5]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = events.select("key", seconds.alias("t"), "event_id", *columns).repartition("key").sortWithinPartitions("key", "t", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if not begun or row["key"] != key:
                    if begun and finish:
                        out += [(key, *x) for x in finish(state)]
                    key, state, begun = row["key"], start(), True
                state, done = step(state, row)
                out += [(key, *x) for x in done]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), types)], names=names)
        if begun and finish and (out := [(key, *x) for x in finish(state)]):
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, schema)


class OrderedFold(StatefulProcessor):
    """A fold over a stream: events wait in a list until the watermark is past them; a timer at the earliest of them, at a deadline, or at the
    end of a state's use brings the key up again. Events older than the watermark are late and are left out."""

    def __init__(self, fold: Fold) -> None:
        self.fold = fold
        self.names = [c.split()[0] for c in fold.schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.waiting = handle.getValueState("state", "value string"), handle.getListState("waiting", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [r for pdf in rows for r in pdf.drop(columns=["key", "ts"]).to_dict("records") if r["us"] >= passed]
        if new:
            self.waiting.appendList([(json.dumps({k: v.item() if hasattr(v, "item") else v for k, v in r.items()}),) for r in new])
            self.handle.registerTimer(int(min(r["us"] for r in new)) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, fold = timerValues.getCurrentWatermarkInMs() * 1000, self.fold
        events = sorted((json.loads(r[0]) for r in self.waiting.get()), key=lambda r: (r["us"], r["event_id"]))
        due, later = [r for r in events if r["us"] < passed], [r for r in events if r["us"] >= passed]
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {"state": fold.start(), "last": None}
        state, last, out = kept["state"], kept["last"], []
        for r in due:
            state, done = fold.step(state, r)
            out, last = out + done, r["us"]
        end = fold.deadline(state) if fold.deadline else None
        if end is not None and end * 1e6 < passed:
            out, state, end = out + fold.finish(state), fold.closed(state), None
        stale = fold.forget is not None and last is not None and last + fold.forget * 1e6 < passed
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put([(json.dumps(r),) for r in later])
        if stale and not later:
            self.state.clear()
        elif due or self.state.exists():
            self.state.update((json.dumps({"state": state, "last": last}),))
            again = [r["us"] for r in later[:1]] + ([end * 1e6] if end is not None else [])
            if fold.forget is not None and last is not None and not stale:
                again.append(last + fold.forget * 1e6)
            if again:
                self.handle.registerTimer(int(min(again)) // 1000 + 1)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)

    def close(self) -> None:
        pass


def folded_stream(events: DataFrame, fold: Fold, late: str) -> DataFrame:
    """The fold over a stream of events, of those no later than `late`: its rows equal those of `folded` over them. The session needs RocksDB as its state store."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late).select("key", "ts", "event_id", us.alias("us"), (us / F.lit(1e6)).alias("t"), *fold.columns)
    return rows.groupBy("key").transformWithStateInPandas(OrderedFold(fold), fold.schema, "append", "eventTime")


def limit_fold(most: int, seconds: float) -> Fold:
    def step(recent: list[float], row: dict) -> tuple[list[float], list[tuple]]:
        passed, recent = accept([row["t"]], recent, most, seconds)
        return recent, [(row["event_id"], passed[0])]

    return Fold([], list, step, LIMITED, forget=seconds)


def rate_limited(calls: DataFrame, most: int = 20, seconds: float = 60.0) -> DataFrame:
    """key, event_id, accepted of bounded calls (key, event_id, ts)."""
    return folded(calls, limit_fold(most, seconds))


def bucket_fold(capacity: float, per_second: float) -> Fold:
    def step(state: tuple[float, float | None], row: dict) -> tuple[tuple[float, float], list[tuple]]:
        tokens, last = state
        tokens = min(capacity, tokens + (row["t"] - last) * per_second) if last is not None else tokens
        passed = tokens >= 1 - 1e-9
        return (tokens - passed, row["t"]), [(row["event_id"], passed)]

    return Fold([], lambda: (capacity, None), step, LIMITED, forget=capacity / per_second)  # by then a bucket is full


def token_bucket(calls: DataFrame, capacity: float = 20.0, per_second: float = 20.0) -> DataFrame:
    """key, event_id, accepted of bounded calls (key, event_id, ts): a call takes a token; a bucket starts full and fills again all the time, up to its capacity."""
    return folded(calls, bucket_fold(capacity, per_second))


def token_bucket_stream(calls: DataFrame, capacity: float = 20.0, per_second: float = 20.0, late: str = "10 seconds") -> DataFrame:
    """The same over a stream; a bucket that is full again is forgotten."""
    return folded_stream(calls, bucket_fold(capacity, per_second), late)


#: Calls of the breaker's window, its failure rate in percent, seconds it stays open, calls let through half open.
WINDOW, FAILURE_RATE, OPEN_SECONDS, PROBES = 50, 50, 30.0, 5


def breaker_fold(window: int, rate: float, wait: float, probes: int) -> Fold:
    def step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
        if state["name"] == "open" and row["t"] - state["since"] >= wait:
            state = {"name": "half_open", "recent": [], "since": row["t"]}
        name = state["name"]
        if name == "open":
            return state, [(row["event_id"], name, False)]
        size = window if name == "closed" else probes
        recent = [*state["recent"], bool(row["failed"])][-size:]
        after = {"name": name, "recent": recent, "since": state["since"]}
        if len(recent) == size:
            if 100 * sum(recent) >= rate * size:
                after = {"name": "open", "recent": [], "since": row["t"]}
            elif name == "half_open":
                after = {"name": "closed", "recent": [], "since": row["t"]}
        return after, [(row["event_id"], name, True)]

    return Fold(["failed"], lambda: {"name": "closed", "recent": [], "since": 0.0}, step, "key long, event_id long, state string, allowed boolean")


def circuit_breaker(calls: DataFrame, window: int = WINDOW, rate: float = FAILURE_RATE, wait: float = OPEN_SECONDS, probes: int = PROBES) -> DataFrame:
    """key, event_id, state, allowed of calls (key, event_id, ts, failed). Closed: once the last `window` calls are known and the share of failures reaches the rate, it
    opens. Open: calls are refused until `wait` seconds have passed. Half open: `probes` calls are let through; then it closes if fewer than the rate failed, else it opens again."""
    return folded(calls, breaker_fold(window, rate, wait, probes))


def circuit_breaker_stream(calls: DataFrame, window: int = WINDOW, rate: float = FAILURE_RATE, wait: float = OPEN_SECONDS, probes: int = PROBES, late: str = "10 seconds") -> DataFrame:
    """The same over a stream."""
    return folded_stream(calls, breaker_fold(window, rate, wait, probes), late)


def rate_limited_stream(calls: DataFrame, most: int = 20, seconds: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """The same over a stream; a key's state goes once its window has passed."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = (pdf["ts"].astype("int64") / pd.Timedelta(1, "s").as_unit(pdf["ts"].dt.unit).value).tolist()
        passed, recent = accept(times, recent, most, seconds)
        state.update((recent,))
        state.setTimeoutTimestamp(int((max(times[-1], recent[-1] if recent else 0) + seconds) * 1000) + max(0, state.getCurrentWatermarkMs() - int(times[-1] * 1000)) + 1)
        yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "accepted": passed})

    marked = calls.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(fold, LIMITED, "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_fold(pause: float, longest: float) -> Fold:
    def told(state: dict) -> list[tuple]:
        return [(state["batch"], state["n"], state["first_id"], state["last_id"], state["lead"][1])] if state["n"] else []

    def end(state: dict) -> float | None:
        return min(state["last"] + pause, state["first"] + longest) if state["n"] else None

    def step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
        done = []
        if not state["n"] or row["t"] > end(state):
            done = told(state)
            state = {"batch": state["batch"] + 1, "n": 0, "first": row["t"], "first_id": row["event_id"], "lead": None}
        lead = state["lead"]
        if lead is None or row["priority"] >= lead[0]:
            lead = (row["priority"], row["event_id"])
        return state | {"n": state["n"] + 1, "last": row["t"], "last_id": row["event_id"], "lead": lead}, done

    schema = "key long, batch long, n long, first_id long, last_id long, lead_id long"
    return Fold(["priority"], lambda: {"batch": -1, "n": 0}, step, schema, told, end, lambda state: {"batch": state["batch"], "n": 0})


def debounced(events: DataFrame, pause: float = 0.15, longest: float = 0.5) -> DataFrame:
    """key, batch, n, first and last event and the trigger of the highest priority (the later of equals): a batch closes `pause` after its last event or `longest` after its first."""
    return folded(events, debounce_fold(pause, longest))


def debounced_stream(events: DataFrame, pause: float = 0.15, longest: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """The same over a stream: a batch goes out by a timer, once the watermark is past its end, whether its key has more events or not."""
    return folded_stream(events, debounce_fold(pause, longest), late)


def running_scores_stream(turns: DataFrame) -> DataFrame:
    """session, n and mean of main turns so far, in update mode."""
    main = turns.where(~F.coalesce(F.col("is_follow_up"), F.lit(False)))
    return main.groupBy("session").agg(F.count("*").alias("n"), F.floor(F.avg(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("score", F.lit(0))))) + 0.5).alias("mean"))


def idempotent_stream(requests: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each request once while the watermark remembers it."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and means by tumbling or sliding windows, late events dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
