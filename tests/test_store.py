"""The keyed store: upserts, pruned reads, failed commits and writers that meet; glossary and sweep against plain loops."""

import datetime as dt
import random

import pytest

from cuelake.operators import jobstats, text
from cuelake.plans import registry
from cuelake.sources import store

SCHEMA = "task_id string, created_at timestamp, status string, transcription_model string, translation_service string"


def day(n, h=0):
    return dt.datetime(2024, 1, n, h)


def save(spark, path, rows):
    return store.save_stats(spark.createDataFrame(rows, SCHEMA), path)


def test_upserts_and_pruned_reads(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        store.read_stats(spark, path)
    assert save(spark, path, [("a", day(1), "old", "m", "x"), ("b", day(1), "b1", None, "x"), (None, day(1), "x", "m", "x"), ("a", day(1, 2), "new", "m", "y"), ("d", day(5), "d", "k", None)]) == 1
    assert save(spark, path, [("a", day(3), "moved", "m", "x"), ("c", day(2), "c", "n", "y"), ("b", day(1), "b0", None, "x")]) == 2
    own = store.read_stats(spark, path)
    assert {(x.task_id, x.status) for x in own.collect()} == {("a", "moved"), ("b", "b1"), ("c", "c"), ("d", "d")}
    assert save(spark, path, [("d", day(6), "d2", "k", "x")]) == 3  # its old day is left empty
    state = store.manifest(spark, path)
    assert sorted(state["days"]) == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-06"]
    few = store.read_stats(spark, path, "2024-01-02", "2024-01-03")
    assert {x.task_id for x in few.collect()} == {"a", "c"}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    opened = lambda df: {f.split("date=")[1][:10] for f in df.inputFiles()}
    assert opened(few) == {"2024-01-02", "2024-01-03"}
    assert opened(store.read_stats(spark, path, models=["m"])) == {"2024-01-03"}
    assert {x.task_id for x in store.read_stats(spark, path, services=["x"], statuses=["moved", "d2"]).collect()} == {"a", "d"}
    assert store.read_stats(spark, path, models=["none"]).count() == 0
    assert {x.status for x in store.read_stats(spark, path, version=1).collect()} == {"new", "b1", "d"}
    assert save(spark, path, [(None, day(9), "x", "m", "x")]) == 3  # nothing to save
    assert jobstats.latest_per_task(spark.createDataFrame([("q", None, "s", None, None)], SCHEMA)).first().date is not None


def test_of_rows_of_one_time_the_first_wins(spark, tmp_path):
    """Within an upsert and over two, whatever the other values are; as the SQL's engine takes a tie."""
    at = [dt.datetime(2024, 1, 6, 0, 0, 0, 5)] * 2 + [dt.datetime(2024, 1, 6, 0, 0, 0, 6)] * 2
    rows = [(2 * k + j, at[j + 1 if k > 5 else j], 3 * k, ("view", "error")[(k + j) % 2], (60.0, 70.0, 40.0)[(k // 2 + j) % 3], f'{{"k": {j}}}') for k in range(8) for j in range(2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    won = [rows[2 * k + (k > 5)] for k in range(8)]
    status = {"view": "running", "error": "failure"}
    want = [(str(x[0] // 2), x[1], status[x[3]], x[4]) for x in won]
    got = registry.QUERIES["s03_save_stats"](spark, str(tmp_path)).collect()
    assert sorted((x.task_id, x.created_at, x.status, x.total_duration) for x in got) == sorted(want)
    read = registry.QUERIES["s03_read_indexed"](spark, str(tmp_path)).collect()
    assert sorted((x.task_id, x.status, x.translation_service) for x in read) == sorted((str(x[0] // 2), status[x[3]], "beta" if x[0] % 2 else "alpha") for x in won)


def test_a_failed_commit_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    save(spark, path, [("a", day(1), "old", "m", "x"), ("b", day(2), "b", "m", "x")])
    commit = store._commit

    def fails(*_):
        raise OSError("lost the driver")

    monkeypatch.setattr(store, "_commit", fails)
    with pytest.raises(OSError):
        save(spark, path, [("a", day(2), "new", "m", "x"), ("b", day(3), "b2", "m", "x")])
    assert {(x.task_id, x.status) for x in store.read_stats(spark, path).collect()} == {("a", "old"), ("b", "b")}

    def overtaken(spark_, path_, state):
        monkeypatch.setattr(store, "_commit", commit)
        save(spark, path, [("c", day(4), "c", "m", "x")])  # another writer is first
        commit(spark_, path_, state)

    monkeypatch.setattr(store, "_commit", overtaken)
    with pytest.raises(store.CommitConflict):
        save(spark, path, [("a", day(2), "new", "m", "x")])
    save(spark, path, [("a", day(2), "new", "m", "x")])
    assert {(x.task_id, x.status) for x in store.read_stats(spark, path).collect()} == {("a", "new"), ("b", "b"), ("c", "c")}


def test_many_upserts_equal_the_latest_rows(spark, tmp_path):
    r, path, every = random.Random(5), str(tmp_path / "store"), []
    for turn in range(4):
        rows = [(f"t{r.randrange(40)}", day(1 + r.randrange(9), r.randrange(24)), f"s{turn}-{i}", r.choice(["m", "n", None]), "x") for i in range(30)]
        every += rows
        save(spark, path, rows)
    want = jobstats.latest_per_task(spark.createDataFrame(every, SCHEMA)).collect()
    key = lambda x: (x.task_id, x.created_at, x.status, x.transcription_model or "", x.date)
    assert sorted(map(key, store.read_stats(spark, path).collect())) == sorted(map(key, want))


def test_terms_inside_words_and_over_several_automata(spark):
    cues = [(1, 1, "The ANDes and the sea", "die ANDEN"), (1, 2, "Undone", None), (1, 3, None, "x"), (2, 1, "éclair.", "ECLAIR"), (2, 2, "", "")]
    terms = [("and", "AND"), ("and", "und"), ("SEA", "Meer"), ("the sea", "das Meer"), ("é", "e"), ("", "x"), (None, "y"), ("the", None), (".", ".")]
    a = spark.createDataFrame(cues, "video_id long, cue_id int, text string, translated_text string")
    b = spark.createDataFrame(terms, "term string, rendering string")
    want = sorted({(v, c, t, r) for v, c, x, y in cues if x and y is not None for t, r in terms if t and r and t.lower() in x.lower() and r.lower() not in y.lower()})
    for most in (50_000, 2):
        assert sorted(map(tuple, text.glossary_check(a, b, most).collect())) == want
    assert text.glossary_check(a, b.where("false")).count() == 0


def test_sweep_over_slots(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, None]), t, t + r.choice([0, 5, 50, 400])) for t in (r.randrange(-300, 1000) for _ in range(300))]
    got = {x.k: x.most_open for x in jobstats.concurrency(spark.createDataFrame(rows, "k int, start long, stop long"), "k", slot=100).collect()}
    for k in (1, 2, None):
        edges = sorted([(s, 1) for q, s, _ in rows if q == k] + [(e, -1) for q, _, e in rows if q == k])
        now = most = -10**9
        now = 0
        for _, d in edges:
            now += d
            most = max(most, now)
        assert got[k] == most


def test_old_versions_go(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    for n in range(1, 5):
        save(spark, path, [("a", day(n), f"s{n}", "m", "x"), (f"b{n}", day(1), "b", "m", "x")])
    monkeypatch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        save(spark, path, [("z", day(9), "z", "m", "x")])
    want = sorted(map(tuple, store.read_stats(spark, path).collect()))
    assert store.vacuum(spark, path) == 0 and len(store.versions(spark, path)) == 2
    assert store.vacuum(spark, path, keep=1, min_age_s=-5) > 4
    assert store.versions(spark, path) == [4] and sorted(map(tuple, store.read_stats(spark, path).collect())) == want
    folders = {f.rsplit("/", 2)[1] for f in store.read_stats(spark, path).inputFiles()}
    assert folders == {p.name for p in (tmp_path / "store" / "data").glob("commit=*/date=*")}
