"""Row-level rules against plain versions; sketches against exact figures; streams of files across a restart."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cuelake.operators import jobstats, media, reflow, replies, text
from cuelake.sources.logs import merged_metrics, metric_sketches
from cuelake.sources.streams import read_stream, run_available
from cuelake.streaming import stateful

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plain_name(name):
    name = re.sub(r'[<>:"/\\|?*]', "_", name).strip(". ")
    if len(name) > 255:
        stem, _, extension = name.rpartition(".")
        name = f"{stem[: 255 - len(extension) - 1]}.{extension}" if stem or extension != name else name[:255]
    return name


def test_safe_file_names(spark):
    r = random.Random(1)
    names = ["".join(r.choice('ab.. /\\:*?"<>|é') for _ in range(r.randrange(40))) for _ in range(300)]
    names += ["x" * 300, "x" * 300 + ".mp4", "a." + "y" * 300, "." * 5, "", "é" * 254 + ".m", "q" * 251 + ".mkv", "b" * 20 + "." + "z" * 254]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.safe_file_name(F.col("n")).alias("s"), text.allowed_extension(F.col("n"), ["mp4", "b"]).alias("ok")).collect()
    for x in rows:
        assert x.s == plain_name(x.n), x.n
        assert x.ok == ("." in x.n and x.n.rsplit(".", 1)[1].lower() in ("mp4", "b"))


def test_clock_columns(spark):
    rows = [(1, "1:02:03.5", "9"), (2, "90", "1:61"), (3, " ", "0:59"), (4, "1:x", None), (5, "1:2:3:4", "-1"), (6, " 7 : 8 ", "59:59:59")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    values, rejects = text.parse_clock_columns(df, "k", ["a", "b"], lenient=True)
    assert [tuple(x) for x in values.orderBy("k").collect()] == [(1, 3723.5, 9.0), (2, 90.0, 121.0), (3, None, 59.0), (4, None, None), (5, None, -1.0), (6, 428.0, 215999.0)]
    assert sorted(map(tuple, rejects.collect())) == [(3, "a", " ", "empty"), (4, "a", "1:x", "number"), (4, "b", None, "empty"), (5, "a", "1:2:3:4", "format")]
    strict, bad = text.parse_clock_columns(df, "k", ["a", "b"])
    assert {(x.key, x.column, x.reason) for x in bad.collect()} >= {(1, "a", "number"), (2, "b", "range")}


def test_replies_by_position_and_all_missing_ids(spark):
    asked = spark.createDataFrame([(1, 0, k, f"s{k}") for k in range(4)] + [(1, 1, 9, "s9"), (2, 0, 1, "z")], "video_id long, chunk int, id int, text string")
    given = spark.createDataFrame([(1, 0, ["a", None]), (1, 1, ["b", "c", "d"])], "video_id long, chunk int, texts array<string>")
    got = {(x.video_id, x.chunk, x.id): (x.reply, x.filled, x.excess, x.shortage) for x in replies.fill_by_position(asked, given).collect()}
    assert got == {(1, 0, 0): ("a", False, 0, 2), (1, 0, 1): (None, False, 0, 2), (1, 0, 2): ("s2", True, 0, 2), (1, 0, 3): ("s3", True, 0, 2), (1, 1, 9): ("b", False, 2, 0), (2, 0, 1): ("z", True, 0, 1)}
    items = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 1, 9, 0, "b"), (2, 0, 1, 0, "c")], "video_id long, chunk int, id int, ord int, text string")
    with pytest.raises(Exception, match="ids 1, 2, 3 of video 1, chunk 0"):
        replies.fill_or_fail(asked, items, strict=True).collect()
    assert replies.fill_or_fail(asked.where("id in (0, 9) or video_id = 2"), items, strict=True).where("filled").count() == 0


def test_flags_and_descriptions(spark):
    m = spark.createDataFrame([("on", " 2.5", "odd"), ("what", "x", "Clean"), (None, "", None)], "a string, n string, style string")
    got = text.normalise_flags(m, ["a"], "style", {"n": 7}).collect()
    assert [(x.a, x.n, x.style, x.unparsed) for x in got] == [(True, 2.5, "clean", 0), (False, 7.0, "clean", 1), (False, 7.0, "clean", 0)]
    counts = {x.flag: (x.given, x.unparsed) for x in text.unparsed_by_flag(m, ["a"], "style", ["n"]).collect()}
    assert counts == {"a": (2, 1), "n": (3, 1), "style": (2, 1)}
    d = spark.createDataFrame([("é ok! <b>*" + "x" * 300,), ("short;",), (None,)], "t string").select(media.safe_description(F.col("t")).alias("d")).collect()
    assert [x.d for x in d] == ["é ok! b" + "x" * 190 + "...", "short", ""]


def test_transfer_without_total(spark):
    rows = [(1, T0 + dt.timedelta(seconds=3 * k), k, 100 * k, total) for k, total in enumerate([400, 400, None, 0, 350])]
    out = reflow.transfer_speed(spark.createDataFrame(rows, "task_id long, ts timestamp, event_id long, bytes long, total_bytes long")).orderBy("event_id").collect()
    assert [(x.event_id, x.percent, None if x.eta_s is None else round(x.eta_s, 6)) for x in out] == [(1, 25.0, 9.0), (2, None, None), (3, None, None), (4, 100.0, 0.0)]


def test_limits_together_and_exempt_routes(spark):
    rows = [(1, T0 + dt.timedelta(seconds=10 * k), "poll" if k % 2 else "get") for k in range(30)]
    got = jobstats.route_budgets(spark.createDataFrame(rows, "task_id long, ts timestamp, route string"), {"1 minute": 2, "1 hour": 14}, "1 minute", ["poll"]).collect()
    assert {x.width for x in got} == {"1 minute", "1 hour"} and max(x.requests for x in got if x.width == "1 hour") == 15 and all(x.requests == 3 for x in got if x.width == "1 minute")


def test_sketches_over_days(spark):
    r = random.Random(9)
    rows = [("t", d, float(r.randrange(100_000)) / 10, f"w{r.randrange(30_000)}") for d in range(6) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "test string, date int, batch_s double, worker string")
    out = merged_metrics(metric_sketches(df)).first()
    assert out.batches == len(rows) and out.min_s == min(x[2] for x in rows) and out.max_s == max(x[2] for x in rows)
    workers, times = len({x[3] for x in rows}), sorted(x[2] for x in rows)
    assert abs(out.workers / workers - 1) < 0.05
    for share, value in zip((0.5, 0.9, 0.99), out.quantiles, strict=True):
        assert abs(sum(x <= value for x in times) / len(times) - share) < 0.04


def test_streams_of_json_lines_go_on_after_a_restart(spark, tmp_path):
    folder, base = tmp_path / "usage", str(tmp_path / "base")
    folder.mkdir()

    def put(name, lines):
        (folder / name).write_text("\n".join(lines))

    line = lambda k, t: json.dumps({"key": f"k{k}", "ts": (T0 + dt.timedelta(seconds=t)).isoformat(), "tokens": t})
    put("a.json", [line(1, 5), "", "no json", line(2, 6)])
    source = lambda: read_stream(spark, "usage", str(folder))
    first = run_available(source(), base=base).collect()
    put("b.json", [line(1, 7), json.dumps({"key": "k9", "ts": T0.isoformat(), "tokens": "many"})])
    every = run_available(source(), base=base).collect()
    assert sorted((x.key, x.tokens) for x in first) == [("k1", 5), ("k2", 6)]
    assert sorted((x.key, x.tokens or 0) for x in every) == [("k1", 5), ("k1", 7), ("k2", 6), ("k9", 0)]
    usage = read_stream(spark, "usage", str(folder)).selectExpr("cast(substr(key, 2) as bigint) as task_id", "ts", "tokens as event_id", "tokens")
    assert stateful.admit_requests(usage).isStreaming
    with pytest.raises(ValueError):
        read_stream(spark, "usage", str(folder), "csv")


def test_plain_text_keeps_what_stands_at_the_edges_of_a_line(spark):
    from cuelake.sources.tracks import srt_plain_text

    lines = ["0 zero 0", "1 at 171", "2 of 22", "3 and 3", "4", "a --> b"]
    got = srt_plain_text(spark.createDataFrame([(1, "\n".join(lines))], "video_id long, body string")).first().plain
    assert got == " ".join(lines[:4])
