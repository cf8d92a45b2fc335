"""Keyed streams by buckets of keys: the state's key is no row's key, and many keys a bucket give what a state a key would."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from cuelake.sources.streams import latest, run_available
from cuelake.streaming import jobs, stateful
from tests.test_streams import END, T0, closed, stream_of


def dealt(stream):
    return "__bucket" in stream._jdf.queryExecution().analyzed().toString()


def test_redemption_of_tokens_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    issues = [(t, at(t)) for t in range(40)]
    uses = [(100 * t + k, t, at(t + 1 + 400 * (t % 2) + k)) for t in range(41) for k in range(2)]
    left = stream_of(spark, str(tmp_path / "a"), closed([issues], lambda d: (END, T0 + d)), "token long, ts timestamp")
    right = stream_of(spark, str(tmp_path / "b"), closed([uses[::2], uses[1::2]], lambda d: (END, END, T0 + d)), "use_id long, token long, ts timestamp")
    stream = stateful.redeem_tokens(left, right)
    assert dealt(stream)
    got = {x.use_id: x.verdict for x in run_available(stream).where(f"token <> {END}").collect()}
    assert got == {u: "invalid" if t == 40 else "used" if u % 100 else "expired" if t % 2 else "ok" for u, t, _ in uses}


def test_spotter_of_videos_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    rows = [(v, k, 600 * k, 600 * k + 100, "end." if k % 4 == v % 4 else "so", T0 + dt.timedelta(milliseconds=600 * k)) for v in range(30) for k in range(9)]
    batches = closed([rows[::2], rows[1::2]], lambda d: (END, 0, 0, 1, "", T0 + d))
    stream = stateful.spot(stream_of(spark, str(tmp_path / "s"), batches, "video_id long, pos long, s_ms long, e_ms long, w string, ts timestamp"))
    assert dealt(stream)
    got = sorted((x.video_id, x.first_pos, x.last_pos) for x in run_available(stream).where(f"video_id <> {END}").collect())
    ends = {v: [k for k in range(9) if k % 4 == v % 4 or k == 8] for v in range(30)}
    assert got == sorted((v, a, b) for v in range(30) for a, b in zip([0, *(k + 1 for k in ends[v])], ends[v]))


def test_view_of_keys_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    day = lambda d: T0 + dt.timedelta(days=d)
    batches = [[(k, day(k % 20), float(k)) for k in range(100)], [(k, day(k % 20 - 1), -1.0) for k in range(100)], [(200, day(25), 2.0)]]
    stream = stateful.retention(stream_of(spark, str(tmp_path / "s"), batches, "event_id long, created_at timestamp, value double"), "event_id", 10)
    assert dealt(stream)
    got = {x.event_id: x.value for x in stateful.shown(run_available(stream), "event_id").collect()}
    assert got == {k: float(k) for k in range(100) if k % 20 > 14} | {200: 2.0}


def test_status_of_tasks_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    row = lambda i, t, s, p, m: (i, t, T0 + dt.timedelta(minutes=s), 0, p, m)
    batches = [[row(t, t, 5, t, "view") for t in range(50)], [row(100 + t, t, t % 2 * 9, 100, "error" if t == 7 else "view") for t in range(50)], [row(300, 9, 0, None, "view")]]
    stream = jobs.latest_status(stream_of(spark, str(tmp_path / "s"), batches, "event_id long, task_id long, ts timestamp, step_index int, progress long, message string"))
    assert dealt(stream)
    got = {x.task_id: (x.progress, x.status) for x in latest(run_available(stream, "update"), ["task_id", "step_index"]).collect()}
    assert got == {t: (100, "error" if t == 7 else "completed") if t % 2 else (t, "in_progress" if t else "waiting") for t in range(50)}


def test_rows_reach_a_processor_as_frames(spark, tmp_path):
    """Rows are packed before they are dealt, whatever their order, and rows without event time stay."""
    schema = "task_id long, ts timestamp, event_id long, bytes long"
    rows = [(t, None if k == 3 else T0 + dt.timedelta(seconds=(7 * k) % 11), 100 * t + k, k) for k in range(11) for t in range(6)]
    stream = stateful.transfer_speed(stream_of(spark, str(tmp_path / "s"), [rows], schema))
    assert "MapInArrow" in stream._jdf.queryExecution().analyzed().toString()
    processor = stateful.InOrder("task_id bigint", "event_id bigint, bytes bigint", (), None, [], 0)
    given = spark.createDataFrame(rows, schema).withColumn("__bucket", (F.col("task_id") % 2).cast("int"))
    frames = given.coalesce(1).mapInArrow(stateful._framed(processor.schema), "__bucket int, ts timestamp, early bigint, frame binary").collect()
    assert [x["__bucket"] for x in frames] == [0, 1] and {x.early for x in frames} == {stateful.NO_TIME}
    assert {x.ts.replace(tzinfo=dt.timezone.utc) for x in frames} == {T0 + dt.timedelta(seconds=9)}
    got = [r for x in frames for r in stateful._unpacked(x.frame).select(["task_id", "event_id", "bytes"]).to_pylist()]
    assert sorted(tuple(r.values()) for r in got) == sorted((t, e, b) for t, _, e, b in rows)


def test_late_rows_of_a_frame_are_left_out(spark, tmp_path):
    """A row that the bucket is past doesn't come in with one in time that shares its frame."""
    schema = "task_id long, event_id long, ts timestamp, tokens long"
    at = lambda d: T0 + dt.timedelta(days=d)
    batches = [[(1, 1, at(0), 5)], [(1, 2, at(10), 5)], [(1, 3, at(20), 5)], [(1, 4, at(1), 5), (1, 5, at(21), 5)], *([(END, END, at(d), 0)] for d in (9000, 9001, 9002))]
    got = run_available(stateful.admit_requests(stream_of(spark, str(tmp_path / "s"), batches, schema))).where(f"task_id <> {END}").collect()
    assert sorted(x.event_id for x in got) == [1, 2, 3, 5]


def test_newest_rows_of_a_bucket_are_found_by_arrays(spark):
    r = random.Random(7)
    step = stateful.Newest("task_id bigint, step_index int", "event_id bigint, progress bigint, error boolean", 0, sticky=("error",), every=True)
    some = lambda n, most: None if r.random() < 0.1 else r.randrange(n, most)
    rows = lambda n, low: [(some(0, 6), r.randrange(3), r.randrange(low, 9), some(0, 3), some(0, 3), r.choice([True, False, None])) for _ in range(n)]
    table = lambda x: pa.table([pa.array(c, f.type) for c, f in zip(zip(*x, strict=True), step.schema, strict=True)], schema=step.schema) if x else step.schema.empty_table()
    order = lambda x: [(c is not None, c or 0) for c in x[2:5]]
    for n, m in [(1, 0), (1, 1), (40, 0), (40, 15), (3, 15)] * 5:
        fresh, old = rows(n, 2), list({x[:2]: x for x in rows(m, 0)}.values())
        best, told = step._merged(table(fresh), table(old))
        want = {}
        for is_new, x in [*((True, x) for x in fresh), *((False, x) for x in old)]:
            was = want.get(x[:2], (None, x, None))
            error = None if x[5] is None and was[2] is None else bool(x[5]) or bool(was[2])
            want[x[:2]] = (is_new or bool(was[0]), max(was[1], x, key=order), error)
        got = {x[:2]: (t, x) for x, t in zip(zip(*best.to_pydict().values(), strict=True), told.tolist(), strict=True)}
        assert got == {k: (t, (*x[:5], e)) for k, (t, x, e) in want.items()}
