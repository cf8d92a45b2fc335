"""Keyed streams over small files: order of arrival, restarts, late rows and replays against the batch forms."""

import datetime as dt
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.operators import jobstats, words
from cuelake.sources.streams import into_table, latest, run_available, table_of
from cuelake.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
END = -(1 << 62)


def put_files(spark, folder, batches, schema, first=0):
    """The given lists of rows as part files, numbered and dated in order."""
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(batches, first):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            if name.endswith(".parquet"):
                os.rename(f"{folder}/{k}/{name}", f"{folder}/part{k}.parquet")
                os.utime(f"{folder}/part{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def stream_of(spark, folder, batches, schema):
    """A stream whose micro-batches are the given lists of rows, in order."""
    put_files(spark, folder, batches, schema)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*.parquet").parquet(folder)


def dealt(rows, parts, seed):
    """Rows in random order and unequal parts."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    edges = sorted(random.Random(seed + 1).sample(range(1, len(rows)), parts - 1))
    return [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)])]


def closed(rows, like):
    """With two files of marks that are far ahead."""
    return [*rows, [like(dt.timedelta(days=9000))], [like(dt.timedelta(days=9001))], [like(dt.timedelta(days=9002))]]


def test_microbatches_of_unsorted_files(spark, tmp_path):
    schema = "video_id long, pos long, text string, ts timestamp"
    rows = [(v, k, f"t{k}", T0 + dt.timedelta(seconds=3 * k + 7 * v)) for v, n in ((1, 45), (2, 20), (3, 3)) for k in range(n)]
    batches = closed(dealt(rows, 4, 1), lambda d: (END, 0, "", T0 + d))
    got = run_available(stateful.microbatches(stream_of(spark, str(tmp_path / "s"), batches, schema))).where(f"video_id <> {END}").collect()
    assert sorted((x.video_id, x.batch, x.pos, x.text) for x in got) == sorted((v, k // 20, k, t) for v, k, t, _ in rows)


def test_full_batches_do_not_wait_and_the_rest_follows_after_a_silence(spark, tmp_path):
    schema = "video_id long, pos long, text string, ts timestamp"
    first = [(1, k, f"t{k}", T0 + dt.timedelta(seconds=k)) for k in range(45)]
    later = [[(2, 0, "other", T0 + dt.timedelta(seconds=45 + 600))], [(2, 1, "more", T0 + dt.timedelta(hours=3))], [(3, 0, "end", T0 + dt.timedelta(hours=6))]]
    got = run_available(stateful.microbatches(stream_of(spark, str(tmp_path / "s"), [first, *later], schema))).collect()
    own = {x.pos: (x.batch, x.batch_id) for x in got if x.video_id == 1}
    assert {p: b for p, (b, _) in own.items()} == {k: k // 20 for k in range(45)}
    assert max(own[p][1] for p in range(40)) < min(own[p][1] for p in range(40, 45))


@pytest.mark.parametrize("terminals", [True, False])
def test_spotter_equals_the_batch_form(spark, tmp_path, terminals):
    r = random.Random(3)
    schema, rows = "video_id long, pos long, s_ms long, e_ms long, w string, ts timestamp", []
    for video in range(12):
        at = 0
        for pos in range(r.choice([1, 3, 7, 8, 9, 30])):
            at += r.choice([0, 40, 100, 349, 350, 800])
            length = r.choice([20, 60, 300])
            ends = terminals and r.random() < (0.05 if video % 3 else 0.3)
            rows.append((video, pos, at, at + length, r.choice(["word", "so,"]) + ("." if ends else ""), T0 + dt.timedelta(milliseconds=at)))
            at += length
    batches = closed(dealt(rows, 3, 2), lambda d: (END, 0, 0, 1, "", T0 + d))
    got = run_available(stateful.spot(stream_of(spark, str(tmp_path / "s"), batches, schema))).where(f"video_id <> {END}").collect()
    groups = words.sentence_groups(spark.createDataFrame(rows, schema)).groupBy("video_id", "sent_id").agg(F.min("pos"), F.max("pos"), F.min("s_ms"), F.max_by("e_ms", F.struct("s_ms", "pos")))
    assert sorted(tuple(x)[:6] for x in got) == sorted(map(tuple, groups.collect()))


def test_words_in_arrays_are_words(spark, tmp_path):
    """A row of many words gives what rows of one word do; stretches meet across rows, batches and files."""
    r = random.Random(13)
    rows = []
    for video in range(9):
        at = 0
        for pos in range(r.choice([1, 5, 40])):
            at += r.choice([10, 400, 700, 701, 2000])
            rows.append((video, pos, at, at + r.choice([20, 60]), r.choice(["word", "so.", "end!"]), T0 + dt.timedelta(milliseconds=at)))
    schema, many = "video_id long, pos long, s_ms long, e_ms long, w string, ts timestamp", "video_id long, pos array<long>, s_ms array<long>, e_ms array<long>, w array<string>, ts array<timestamp>"
    cut = [[x for x in rows if x[0] == v and x[1] % 3 // 2 == k] for v in range(9) for k in range(2)]  # a video's rows interleave
    lists = [(own[0][0], *(list(c) for c in list(zip(*own, strict=True))[1:])) for own in cut if own]
    mark = lambda d: (END, 0, 0, 1, "", T0 + d)
    ones, arrays = closed([rows], mark), closed([lists], lambda d: (END, *([x] for x in mark(d)[1:])))
    for name, make in (("spot", stateful.spot), ("islands", lambda x: stateful.speech_islands(x.select("video_id", "ts")))):
        got = [sorted(tuple(x)[: len(x) - 1] for x in run_available(make(stream_of(spark, str(tmp_path / f"{name}{k}"), b, s))).where(f"video_id <> {END}").collect()) for k, (b, s) in enumerate([(ones, schema), (arrays, many)])]
        assert got[0] == got[1] and len(got[0]) > 9


def test_frames_hold_what_came_to_a_bucket(monkeypatch):
    """One frame a bucket and task, however often rows are packed, until much is held."""
    monkeypatch.setattr(stateful, "FRAME_ROWS", 50)
    schema = pa.schema([("video_id", pa.int64()), ("at", pa.int64()), ("pos", pa.int64())])
    batches = [pa.RecordBatch.from_pydict({"__bucket": pa.array([k % 3 for k in range(50)], pa.int32()), "ts": pa.array(range(b * 50, b * 50 + 50), pa.timestamp("us", "UTC")), "video_id": pa.array([k % 3 for k in range(50)]), "pos": pa.array([b] * 50)}) for b in range(20)]
    frames = [x for b in stateful._framed(schema)(iter(batches)) for x in b.to_pylist()]
    assert len(frames) == 3 and sorted(x["early"] for x in frames) == [0, 1, 2]
    rows = [stateful._unpacked(x["frame"]) for x in frames]
    assert sum(x.num_rows for x in rows) == 1000 and {x["pos"].to_pylist()[-1] for x in rows} == {19}
    monkeypatch.setattr(stateful, "HELD_BYTES", 1)
    assert len([x for b in stateful._framed(schema)(iter(batches)) for x in b.to_pylist()]) == 60


def test_status_ignores_late_arrivals(spark, tmp_path):
    schema = "event_id long, task_id long, ts timestamp, step_index int, progress long, message string"
    a = [(5, 1, T0 + dt.timedelta(minutes=5), 0, 100, "view")]
    b = [(3, 1, T0, 0, 40, "view"), (4, 2, T0, 0, 0, "error")]
    emitted = run_available(jobs.latest_status(stream_of(spark, str(tmp_path / "s"), [a, b], schema)), "update")
    assert {x.task_id: (x.progress, x.status) for x in latest(emitted, ["task_id", "step_index"]).collect()} == {1: (100, "completed"), 2: (0, "error")}


def test_admission_and_speed_equal_a_plain_loop(spark, tmp_path):
    r = random.Random(7)
    schema = "task_id long, event_id long, ts timestamp, tokens long, bytes long"
    rows = [(r.randrange(4), i, T0 + dt.timedelta(milliseconds=r.randrange(400_000)), r.randrange(1, 60), r.randrange(10_000)) for i in range(300)]
    folder, base = str(tmp_path / "s"), str(tmp_path / "base")
    batches = closed(dealt(rows, 5, 5), lambda d: (END, END, T0 + d, 0, 0))
    put_files(spark, folder, batches[:2], schema)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*.parquet").parquet(folder)
    run_available(stateful.admit_requests(source(), 60, 100, 3), base=base)
    put_files(spark, folder, batches[2:], schema, 2)  # a restart goes on from the checkpoint
    got = {x.event_id: x.admitted for x in run_available(stateful.admit_requests(source(), 60, 100, 3), base=base).collect() if x.task_id != END}
    want, speeds = {}, []
    for task in range(4):
        window, used, n, last, ema = None, 0, 0, None, None
        for _, i, ts, tokens, size in sorted((x for x in rows if x[0] == task), key=lambda x: (x[2], x[1])):
            own = int(ts.timestamp() // 60)
            if own != window:
                window, used, n = own, 0, 0
            want[i] = used + tokens <= 100 and n < 3
            if want[i]:
                used, n = used + tokens, n + 1
            if last is None or ((ts - last[0]).total_seconds() >= 2 and size > last[1]):
                if last is not None:
                    v = (size - last[1]) / (ts - last[0]).total_seconds()
                    ema = v if ema is None else 0.3 * v + 0.7 * ema
                    speeds.append((i, round(ema, 6)))
                last = (ts, size)
    assert got == want
    moved = run_available(stateful.transfer_speed(source())).where(f"task_id <> {END}").collect()
    assert sorted((x.event_id, round(x.speed, 6)) for x in moved) == sorted(speeds)


def test_redemption_equals_the_batch_form(spark, tmp_path):
    """Unsorted files of both sides, deliveries that come twice, and a use that comes too late to be seen."""
    r = random.Random(11)
    issues = [(t, T0 + dt.timedelta(seconds=r.randrange(3000))) for t in range(60)]
    uses = [(i, r.randrange(70), T0 + dt.timedelta(seconds=r.randrange(4000))) for i in range(200)]
    a, b = "token long, ts timestamp", "use_id long, token long, ts timestamp"
    far = lambda d: T0 + d
    left = stream_of(spark, str(tmp_path / "a"), closed(dealt(issues + issues[:9], 3, 1), lambda d: (END, far(d))), a)
    late = [(900, 3, T0 + dt.timedelta(seconds=10))]
    batches = closed(dealt(uses + uses[:20], 4, 2), lambda d: (END, END, far(d)))
    right = stream_of(spark, str(tmp_path / "b"), [*batches, late, [(END, END, far(dt.timedelta(days=9003)))]], b)
    stream = stateful.redeem_tokens(left, right, delay="2 hours")
    got = run_available(stream).where(f"token <> {END}").collect()
    want = jobstats.redeem_tokens(spark.createDataFrame(issues, a), spark.createDataFrame(uses, b)).collect()
    assert sorted((x.use_id, x.token, x.verdict) for x in got) == sorted((x.use_id, x.token, x.verdict) for x in want)
    assert {x.verdict for x in want} == {"ok", "used", "expired", "invalid"}


def test_rows_leave_the_view_as_time_goes_on(spark, tmp_path):
    schema, folder, base = "event_id long, created_at timestamp, value double", str(tmp_path / "s"), str(tmp_path / "base")
    day = lambda d: T0 + dt.timedelta(days=d)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*.parquet").parquet(folder)
    view = lambda: {x.event_id: x.value for x in stateful.shown(run_available(stateful.retention(source(), "event_id", 10), base=base), "event_id").collect()}
    put_files(spark, folder, [[(1, day(0), 1.0), (2, day(5), 2.0)], [(1, day(3), 1.5)]], schema)
    assert view() == {1: 1.5, 2: 2.0}
    put_files(spark, folder, [[(3, day(14.5), 3.0)]], schema, 2)
    assert view() == {2: 2.0, 3: 3.0}
    put_files(spark, folder, [[(4, day(40), 4.0)]], schema, 3)
    assert view() == {4: 4.0}


def test_daily_summary_after_uneven_batches_and_a_replay(spark, tmp_path):
    r = random.Random(13)
    schema, folder, base = "created_at timestamp, status string, transcription_model string, translation_service string, translation_cost_usd double, total_duration double", str(tmp_path / "s"), str(tmp_path / "base")
    row = lambda: (T0 + dt.timedelta(hours=r.randrange(100)), r.choice(["success", "failure", "running"]), r.choice(["tiny", None]), r.choice(["a", "b", None]), r.randrange(100) / 4, r.randrange(1000) / 8)
    rows = [row() for _ in range(120)]
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*.parquet").parquet(folder)
    put_files(spark, folder, [rows[:5], rows[5:90]], schema)
    jobs.daily_summary(source(), base)
    put_files(spark, folder, [rows[90:]], schema, 2)
    asked = spark.createDataFrame([(T0.date() + dt.timedelta(days=d),) for d in range(8)], "date date")
    flat = lambda df: sorted((x.date, x.total, x.succeeded, x.failed, x.cost_usd, x.total_time, x.avg_time, tuple(sorted(x.by_model.items())), tuple(sorted(x.by_translation_service.items()))) for x in df.collect())
    want = flat(jobstats.daily_summary(spark.createDataFrame(rows, schema), asked))
    assert flat(jobs.daily_summary(source(), base, asked)) == want and want[-1][1:6] == (0, 0, 0, 0.0, 0.0) and want[-1][6] is None
    again = spark.createDataFrame(rows[5:90], schema)
    into_table(base, jobstats.daily_partials)(again, 1)
    parts = table_of(spark, base, jobstats.daily_partials(again).schema)
    assert flat(jobstats.days_of(jobstats.merged_days(parts), asked)) == want
