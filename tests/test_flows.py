"""Streaming jobs against plain folds that keep all that is open."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.plans.bindings import Tables
from spanloom.plans.registry import queries
from spanloom.streaming import flows


def plain(events, begins, ends, seconds, stays):
    """(run, id, by, over): what was ended, or went over the limit (by None), each list scanned whole."""
    out, opened = [], defaultdict(list)

    def pass_to(run, now):
        for x in list(opened[run]):
            if not x[2] and now - x[0] > 1000 * seconds:
                out.append((run, x[1], None, True))
                x[2] = True
                if not stays:
                    opened[run].remove(x)

    ordered = sorted(((int(e.ts.timestamp() * 1_000_000) // 1000, e.event_id, e.run_id, e.kind) for e in events))
    for now, i, run, kind in ordered:
        pass_to(run, now)
        if kind == begins:
            opened[run].append([now, i, False])
        elif kind == ends and opened[run]:
            x = opened[run].pop(0)
            out.append((run, x[1], i, x[2]))
    for run in list(opened):
        pass_to(run, ordered[-1][0])
    return out


def test_all_open_work_is_reported(spark, sf_dir):
    events = Tables(spark, sf_dir).events.collect()
    want = [(r, b, e, "in progress" if e is None else "completed") for r, b, e, over in plain(events, "view", "click", 600, True) if over]
    got = [tuple(r) for r in queries()["str_07_slow_work"](spark, sf_dir).select("run_id", "began", "ended", "status").collect()]
    assert Counter(got) == Counter(want) and len({r[3] for r in got}) == 2


def test_all_requests_have_an_outcome(spark, sf_dir):
    events = Tables(spark, sf_dir).events.collect()
    want = {(r, i): "timeout" if over else "resolved" for r, i, _, over in plain(events, "signup", "purchase", 3600, False)}
    got = queries()["str_01_approvals"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.run_id, r.request): r.outcome for r in got} == want
    asked = {(e.run_id, e.event_id): want.get((e.run_id, e.event_id), "pending") for e in events if e.kind == "signup"}
    # Clicks ask by numbers that no request has.
    asked |= {(e.run_id, -e.event_id): "unknown" for e in events if e.kind == "click"}
    status = queries()["str_02_status"](spark, sf_dir).collect()
    assert len(status) == len(asked) and {(r.run_id, r.request): r.status for r in status} == asked


def arrive(spark, folder, batches):
    """Each batch of (event_id, time, run, kind, value, props) as an event file; yields after each."""
    (folder / "src").mkdir()
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(str(folder / f"w{n}"))
        next((folder / f"w{n}").glob("part-*.parquet")).rename(folder / "src" / f"events-{n}.parquet")
        yield str(folder / "src")


def state_rows(spark, folder, **options):
    reader = flows.stateful_session(spark).read.format("statestore").options(**options)
    return reader.load(f"{folder}/replay/progress").collect()


def ends():
    return F.expr("kind = 'end'")


def by_hand(rows, limit, least=3):
    """What the jobs give, from all events in order."""
    alerts, trips, reused, first = [], [], [], []
    runs = defaultdict(lambda: [0, 0, {}, set()])
    for i, _, run, kind, value, props in sorted(rows, key=lambda e: (e[1], e[0])):
        s = runs[run]
        before, s[0] = s[0], s[0] + int(value * 100)
        if before < limit <= s[0]:
            alerts.append((run, i, s[0]))
        s[1] = s[1] + 1 if kind == "error" else 0
        if s[1] == least:
            trips.append((run, i, least))
        if kind == "signup" and props in s[2]:
            reused.append((run, i, s[2][props]))
        if kind == "purchase":
            s[2].setdefault(props, i)
        if props not in s[3]:
            s[3].add(props)
            first.append((run, i, props))
        if kind == "end":
            del runs[run]
    return {"alerts": alerts, "trips": trips, "reused": reused, "first": first}


JOBS = {
    "alerts": lambda s: flows.budget_alerts(s, 1000, ends(), late="2 days"),
    "trips": lambda s: flows.breaker_trips(s, ends(), late="2 days"),
    "reused": lambda s: flows.decision_reuse(s, ends(), late="2 days"),
    "first": lambda s: flows.content_dedup(s, ends(), late="2 days"),
}


@pytest.mark.parametrize("job", JOBS)
def test_event_order_across_triggers(spark, tmp_path, job):
    """Events of a run in three files, in no order, give what they give in order; runs that ended hold no state."""
    rng = random.Random(7)
    kinds = ["error", "error", "error", "signup", "purchase", "view"]
    rows = [(k, f"2024-01-01 {rng.randrange(24):02}:{rng.randrange(60):02}:00.{rng.randrange(3)}", rng.randrange(1, 4), rng.choice(kinds), rng.choice([0.5, 2.25]), rng.choice("abc")) for k in range(1, 120)]
    rows += [(200 + r, f"2024-01-01 12:00:0{r}", r, "end", 1.0, "z") for r in (1, 2, 3)] + [(210 + r, f"2024-01-02 00:00:0{r}", r, "end", 1.0, "z") for r in (1, 2, 3)]
    rng.shuffle(rows)
    closing = [(900, "2024-03-01 00:00:00", 9, "view", 0.0, "closing")]
    got = None
    for src in arrive(spark, tmp_path, [rows[:50], rows[50:90], rows[90:], closing]):
        got = flows.replay(JOBS[job](flows.read_events(spark, src)), str(tmp_path / "replay"))
    want = by_hand(rows, 1000)[job]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    # Only the closing run waits still.
    options = {"stateVarName": "entries"} if job in ("reused", "first") else {}
    kept = state_rows(spark, tmp_path, **options)
    assert [r.key.run_id for r in kept] == ([9] if not options else [])


def test_breaker_probed_case(spark, tmp_path):
    rows = [(1, "00:00:03", 1, "error"), (2, "00:00:01", 1, "error"), (3, "00:00:02", 1, "view"), (4, "00:00:04", 1, "error"), (5, "00:00:05", 1, "error"), (6, "01:00:00", 2, "view")]
    rows = [(i, f"2024-01-01 {ts}", u, k, 0.0, "{}") for i, ts, u, k in rows]
    for src in arrive(spark, tmp_path, [rows[:1], rows[1:3], rows[3:5], rows[5:]]):
        got = flows.replay(flows.breaker_trips(flows.read_events(spark, src), ends(), late="10 minutes"), str(tmp_path / "replay"))
    assert [tuple(r) for r in got.collect()] == [(1, 5, 3)]


def test_copies_are_known_for_a_run_s_life(spark, tmp_path):
    """A copy after 32 days is one; after the run's end the content is new, and nothing is kept."""
    rows = [(1, "2024-01-01 00:00:00", 1, "view", 0.0, "x"), (2, "2024-02-02 00:00:01", 1, "view", 0.0, "x"), (3, "2024-02-03 00:00:00", 1, "end", 0.0, "x"), (4, "2024-02-04 00:00:00", 1, "view", 0.0, "x")]
    last = [(5, "2024-02-05 00:00:00", 1, "end", 0.0, "x"), (6, "2024-04-01 00:00:00", 2, "view", 0.0, "y")]
    for src in arrive(spark, tmp_path, [rows[:1], rows[1:3], rows[3:], last]):
        got = flows.replay(flows.content_dedup(flows.read_events(spark, src), ends()), str(tmp_path / "replay"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "x"), (1, 4, "x"), (2, 6, "y")]
    assert [r.key.run_id for r in state_rows(spark, tmp_path, stateVarName="entries")] == [2]


def test_quiet_runs_and_later_files(spark, tmp_path):
    """A run without later events is timed out by the others' time; state and timers outlive a trigger, and
    rows that come late are not dropped."""
    batches = [
        [(1, "00:00:00", 1, "signup"), (2, "00:00:10", 1, "signup"), (3, "00:00:20", 1, "purchase"), (4, "00:00:30", 2, "signup"), (5, "00:00:40", 3, "signup")],
        [(6, "00:30:00", 3, "signup"), (7, "00:40:00", 3, "purchase"), (8, "02:00:00", 4, "view")],
        [(9, "02:00:01", 3, "purchase"), (10, "01:59:00", 4, "signup"), (11, "02:00:02", 4, "purchase")],
    ]
    src, got = tmp_path / "src", []
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(i, f"2024-01-01 {ts}", u, k, 0.0, "{}") for i, ts, u, k in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        src.mkdir(exist_ok=True)
        next((tmp_path / f"w{n}").glob("part-*.parquet")).rename(src / f"events-{n}.parquet")
        got = flows.replay(flows.all_approvals(flows.read_events(spark, str(src)), 3600), str(tmp_path / "replay"))
    want = [(1, 1, "resolved"), (1, 2, "timeout"), (2, 4, "timeout"), (3, 5, "resolved"), (3, 6, "timeout"), (4, 10, "resolved")]
    assert sorted(map(tuple, got.collect())) == want


def test_orphans_are_given_out_once(spark, tmp_path):
    """A run that falls silent is given out by the others' time; one that ended is not; one that comes back begins anew."""
    batches = [
        [(1, "00:00:00", 1, "view"), (2, "00:00:10", 2, "view"), (3, "00:00:20", 2, "purchase"), (4, "00:30:00", 3, "view")],
        [(5, "01:10:00", 3, "click"), (6, "02:00:00", 1, "view")],
        [(7, "02:05:00", 1, "purchase"), (8, "04:00:00", 4, "view")],
    ]
    src, got = tmp_path / "src", None
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(i, f"2024-01-01 {ts}", u, k, 0.0, "{}") for i, ts, u, k in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        src.mkdir(exist_ok=True)
        next((tmp_path / f"w{n}").glob("part-*.parquet")).rename(src / f"events-{n}.parquet")
        got = flows.replay(flows.orphans(flows.read_events(spark, str(src)), 3600, "purchase"), str(tmp_path / "replay"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 5)]
