"""Keyed-state jobs over an append-only stream of events ``run_id, event_id, ts, kind, tokens, props``.

Each job is a function of the streaming DataFrame. State is kept per run by Spark, partitioned by run. What
depends on the order of events waits in the state for the watermark and is taken in event time; a run's last event
takes its state with it. Until then that is a number, or a map entry for each content, besides what waits or is open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with the caller's settings, that keeps the state of its streams in
    RocksDB: state then need not fit in memory, and each entry of a map is read and written by itself. The
    caller's session stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def read_events(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The folder's event files as a stream, at most ``files`` in a trigger, which bounds what a run brings at once;
    event time as a timestamp, as watermarks need it."""
    raw = stateful_session(spark).readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files).parquet(folder)
    return raw.select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
        F.floor(F.col("value") * 100).cast("long").alias("tokens"), "props",
    )


def _marked(stream: DataFrame, late: str, *columns: str | Column) -> DataFrame:
    """``run_id, event_id``, the time in microseconds as ``at`` and ``columns``, under a watermark ``late`` behind the
    newest event. The stateful operators drop rows whose watermarked column is older than that; they are shown a
    null there, which never is, so that no event is lost."""
    mark = F.lit(None).cast("timestamp").alias("mark", metadata={"spark.watermarkDelayMs": 0})
    return stream.withWatermark("ts", late).select("run_id", "event_id", F.unix_micros("ts").alias("at"), *columns, mark)


def in_order(stream: DataFrame, value: Column, ends: Column, step: Callable, start: int, output: str, late: str) -> DataFrame:
    """Fold each run's events in event time through ``step(number, values)``, which takes the state so far and the
    values of some events in order, and returns the next state and ``(place, value)`` of the rows to give out;
    they come out with the event's id.

    Events wait in the run's state, sorted by time and id, until the watermark, ``late`` behind the newest event of
    all runs, has reached them: however they are spread over files and triggers, they are folded in order if none
    is more than ``late`` behind. One that is counts on arrival. An event for which ``ends`` holds is the last of its
    run: the state starts anew, and a run that ended keeps none.
    """

    def of_run(key, frames: Iterator[pd.DataFrame], held: GroupState):
        number, waiting = held.get if held.exists else (start, b"")
        events = [np.frombuffer(waiting, np.int64).reshape(-1, 4)]
        if not held.hasTimedOut:
            events += [f[["at", "event_id", "value", "last"]].to_numpy(np.int64) for f in frames]
        events = np.concatenate(events)
        events = events[np.lexsort((events[:, 1], events[:, 0]))]
        clock = held.getCurrentWatermarkMs()
        ripe = int(np.searchsorted(events[:, 0] // 1000, clock, "right"))
        out, begin = [], 0
        for end in [*(np.flatnonzero(events[:ripe, 3]) + 1).tolist(), ripe]:
            if end > begin:
                number, found = step(number, events[begin:end, 2])
                out += [(int(key[0]), int(events[begin + k, 1]), int(x)) for k, x in found]
                if events[end - 1, 3]:
                    number = start
            begin = end
        rest = events[ripe:]
        if len(rest) or number != start:
            held.update((int(number), rest.tobytes()))
            if len(rest):
                held.setTimeoutTimestamp(max(1, clock, int(rest[0, 0]) // 1000 - 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in output.split(", ")]).astype("int64")

    events = _marked(stream, late, value.cast("long").alias("value"), F.coalesce(ends, F.lit(False)).cast("long").alias("last"))
    return events.groupBy("run_id").applyInPandasWithState(of_run, output, "number long, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def budget_alerts(stream: DataFrame, limit: int, ends: Column, late: str = "0 seconds") -> DataFrame:
    """The event at which a run's tokens reach the limit, once in its life, and the sum by then."""

    def step(held, tokens):
        running = held + np.cumsum(tokens)
        return int(running[-1]), [(k, running[k]) for k in np.flatnonzero((running - tokens < limit) & (running >= limit))]

    return in_order(stream, F.col("tokens"), ends, step, 0, "run_id long, event_id long, running long", late)


def breaker_trips(stream: DataFrame, ends: Column, least: int = 3, late: str = "0 seconds") -> DataFrame:
    """The event that makes ``least`` failures in a row, and how many they are; a success resets the count."""

    def step(held, failed):
        bad, place = failed > 0, np.arange(len(failed))
        good = np.maximum.accumulate(np.where(bad, -1, place))  # the last success so far
        streak = np.where(bad, place - good + np.where(good < 0, held, 0), 0)
        return int(streak[-1]), [(k, least) for k in np.flatnonzero(streak == least)]

    return in_order(stream, F.col("kind") == "error", ends, step, 0, "run_id long, event_id long, failures long", late)


class InOrder(StatefulProcessor):
    """Events of a run in event time, with a map in the run's state that is read by entry. Events wait in a list
    until the watermark reaches them; an event whose ``last`` holds ends the run, and nothing of it is kept.
    ``fold(seen, event)`` gives the rows for an event; ``seen`` reads and writes entries."""

    def __init__(self, fold: Callable):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string, content string, last boolean")
        self.entries = handle.getMapState("entries", "content string", "event_id long")

    def handleInputRows(self, key, rows, timerValues):
        return self._pass(key, [(r.at, r.event_id, r.kind, r.content, r.last) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._pass(key, [], timerValues)

    def _pass(self, key, new: list[tuple], timers):
        clock = timers.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        events = sorted([*held, *new], key=lambda e: e[:2])
        ripe = sum(e[0] // 1000 <= clock for e in events)
        known, put, kept = {}, {}, self.entries.exists()  # an entry is read once in a trigger, and written once

        def seen(content, event_id=None):
            if event_id is not None:
                known[content] = put[content] = event_id
            elif content not in known:
                there = kept and self.entries.containsKey((content,))
                known[content] = self.entries.getValue((content,))[0] if there else None
            return known[content]

        out = []
        for _, event_id, kind, content, last in events[:ripe]:
            out += self.fold(seen, event_id, kind, content)
            if last:
                if kept:
                    self.entries.clear()
                known, put, kept = {}, {}, False
        for content, event_id in put.items():
            self.entries.updateValue((content,), (event_id,))
        rest = events[ripe:]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(1, clock + 1, rest[0][0] // 1000))
        elif held:
            self.waiting.clear()
        for r in out:
            yield Row(run_id=key[0], **r)

    def close(self) -> None:
        pass


def decision_reuse(stream: DataFrame, ends: Column, late: str = "0 seconds") -> DataFrame:
    """Requests (``signup``) whose prompt the run has decided (``purchase``) before in its life: the first decision."""

    def fold(seen, event_id, kind, content):
        first = seen(content) if kind in ("purchase", "signup") else None
        if kind == "purchase" and first is None:
            seen(content, event_id)
        return [{"event_id": event_id, "reused": first}] if kind == "signup" and first is not None else []

    return _with_entries(stream, fold, ends, "run_id long, event_id long, reused long", late)


def content_dedup(stream: DataFrame, ends: Column, late: str = "0 seconds") -> DataFrame:
    """The first event of each content in a run's life, however long that is."""

    def fold(seen, event_id, kind, content):
        if seen(content) is not None:
            return []
        seen(content, event_id)
        return [{"event_id": event_id, "props": content}]

    return _with_entries(stream, fold, ends, "run_id long, event_id long, props string", late)


def _with_entries(stream: DataFrame, fold: Callable, ends: Column, output: str, late: str) -> DataFrame:
    events = _marked(stream, late, "kind", F.coalesce("props", F.lit("")).alias("content"), F.coalesce(ends, F.lit(False)).alias("last"))
    return events.groupBy("run_id").transformWithState(InOrder(fold), output, "append", "EventTime")


def fold_open(stream: DataFrame, begins: str, ends: str, seconds: int, rows: Callable, stays: bool, output: str, late: str) -> DataFrame:
    """Keep all that is open in each run. ``begins`` opens, ``ends`` closes what has been open longest:
    events name a run, not the task. Event time that goes more than ``seconds`` past a beginning closes
    it too, or with ``stays`` leaves it open. ``rows(id, by, over)`` gives the rows for what
    event ``by`` ends, or for what goes over its limit (``by`` is null).

    The timer is the watermark of the whole stream, ``late`` behind its newest event, so that a run
    without further events is timed out as well. Rows older than the watermark still count.
    """
    limit = 1000 * seconds

    def of_run(key, frames: Iterator[pd.DataFrame], held: GroupState):
        # Heaps of [time, id]: within the limit, and over it.
        (fresh, over), out = map(json.loads, held.get if held.exists else ("[]", "[]")), []

        def pass_to(now: int) -> None:
            while fresh and fresh[0][0] + limit < now:
                gone = heappop(fresh)
                out.extend(rows(gone[1], None, True))
                if stays:
                    heappush(over, gone)

        if not held.hasTimedOut:
            events = pd.concat(frames).sort_values(["at", "event_id"])
            for e in events.itertuples(index=False):
                now = int(e.at)
                pass_to(now)
                if e.kind == begins:
                    heappush(fresh, [now, int(e.event_id)])
                elif e.kind == ends:
                    first = min((h for h in (over, fresh) if h), key=lambda h: h[0], default=None)
                    if first and first[0][0] <= now:
                        out.extend(rows(heappop(first)[1], int(e.event_id), first is over))
        clock = held.getCurrentWatermarkMs()
        pass_to(clock)
        if fresh or over:
            held.update((json.dumps(fresh), json.dumps(over)))
            if fresh:
                held.setTimeoutTimestamp(max(1, clock, fresh[0][0] + limit))
        elif held.exists:
            held.remove()
        frame = pd.DataFrame([(int(key[0]), *r) for r in out], columns=[c.split()[0] for c in output.split(", ")])
        yield frame.astype({c.split()[0]: "Int64" for c in output.split(", ") if c.endswith(" long")})

    mark = F.lit(None).cast("timestamp").alias("mark", metadata={"spark.watermarkDelayMs": 0})
    events = stream.withWatermark("ts", late).select("run_id", "event_id", "kind", F.unix_millis("ts").alias("at"), mark)
    return events.groupBy("run_id").applyInPandasWithState(of_run, output, "fresh string, over string", "append", GroupStateTimeout.EventTimeTimeout)


def all_work(stream: DataFrame, slow_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Work that began (``view``) and had not ended (``click``) within ``slow_seconds``: a row ``in progress``
    when event time passes the limit, and a row ``completed`` if an end comes after all."""

    def rows(began, ended, over):
        return [(began, ended, "in progress" if ended is None else "completed")] if over else []

    return fold_open(stream, "view", "click", slow_seconds, rows, True, "run_id long, began long, ended long, status string", late)


def all_approvals(stream: DataFrame, timeout_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Requests (``signup``) and what became of them: resolved by a ``purchase`` of the run, which decides the
    request pending longest, or rejected as timed out when event time passes the limit before that."""

    def rows(request, by, over):
        return [(request, "timeout" if over else "resolved")]

    return fold_open(stream, "signup", "purchase", timeout_seconds, rows, False, "run_id long, request long, outcome string", late)


def orphans(stream: DataFrame, seconds: int, terminal: str, late: str = "0 seconds") -> DataFrame:
    """Runs that gave no sign of life for more than ``seconds``, by their last event, ``run_id, event_id``, as soon as
    event time passes that. An event of kind ``terminal`` ends a run; nothing is kept of one that ended or was
    given out, and a later event begins it anew."""
    limit = 1000 * seconds

    def of_run(key, frames: Iterator[pd.DataFrame], held: GroupState):
        (last, at), out = (held.get if held.exists else (-1, 0)), []
        if not held.hasTimedOut:
            events = pd.concat(frames).sort_values(["at", "event_id"])
            ids, times = np.r_[last, events["event_id"].to_numpy()], np.r_[at, events["at"].to_numpy()]
            alive = np.r_[last >= 0, (events["kind"] != terminal).to_numpy()]
            silent = np.flatnonzero(alive[:-1] & (np.diff(times) > limit))
            out = [(int(key[0]), int(ids[k])) for k in silent]
            last, at = (int(ids[-1]), int(times[-1])) if alive[-1] else (-1, 0)
        clock = held.getCurrentWatermarkMs()
        if last >= 0 and at + limit < clock:
            out.append((int(key[0]), last))
            last = -1
        if last >= 0:
            held.update((last, at))
            held.setTimeoutTimestamp(max(1, clock, at + limit))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=["run_id", "event_id"]).astype("int64")

    mark = F.lit(None).cast("timestamp").alias("mark", metadata={"spark.watermarkDelayMs": 0})
    events = stream.withWatermark("ts", late).select("run_id", "event_id", "kind", F.unix_millis("ts").alias("at"), mark)
    return events.groupBy("run_id").applyInPandasWithState(of_run, "run_id long, event_id long", "last long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def replay(result: DataFrame, folder: str, mode: str = "append", spark: SparkSession | None = None) -> DataFrame:
    """Run a job over what there is now, into Parquet files below ``folder``, and return them, as a table of
    session ``spark`` (the stream's by default).

    Append jobs write each trigger's rows; complete ones the last trigger's state.
    """
    spark, out = spark or result.sparkSession, f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        # A trigger that is run again writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode == "append" else f"{out}/batch=last")

    query = (
        result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/batch=*")
