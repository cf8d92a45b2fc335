"""Every query with SQL has one, the flagship runs, streams equal batches, batches call the given function."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuelake.operators import batches, jobstats
from cuelake.plans import bindings, registry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 90 and len(registry.ORACLES) > 80


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(0 <= x.share_ok <= 1 for x in rows)


def test_stream_equals_batch(spark):
    stream = registry.QUERIES["t01_stream_budget_windows"](spark, SF).collect()
    usage = bindings.progress_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = jobstats.budget_windows(usage, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch))


def test_retry_waits_and_gives_up():
    waits = []

    def fails_twice(texts, attempt):
        if attempt < 3:
            raise RuntimeError("503 try later")
        return texts

    assert batches.with_retry(fails_twice, 3, 1.0, waits.append)(["a"]) == (["a"], 3, 3.0) and waits == [1.0, 2.0]
    assert batches.with_retry(fails_twice, 3, 1.0, waits.append)(["a"]) == (["a"], 3, 3.0)  # nothing is remembered


def test_failed_batches_cost_no_other(spark):
    rows = spark.createDataFrame([(1, b, k, f"t{b}{k}") for b in range(6) for k in range(3)], "video_id long, batch long, pos int, text string").withColumn("service", F.when(F.col("batch") > 3, "shout"))

    def odd(texts, call):
        if call.batch % 2:
            raise ValueError("not transient") if call.batch == 1 else RuntimeError("HTTP 503")
        return [f"{call.attempt}{t}" for t in texts]

    got = {(x.batch, x.pos): x for x in batches.map_batches(rows, services={"plain": odd, "shout": lambda ts: [t.upper() for t in ts]}, default="plain", wait_s=0.001, keep_failed=True).collect()}
    assert got[0, 1].result == "1t01" and got[5, 2].result == "T52" and not got[4, 0].failed
    assert (got[1, 0].result, got[1, 0].failed, got[1, 0].attempts, got[1, 0].waited_s) == ("t10", True, 1, 0.0)
    assert (got[3, 0].failed, got[3, 0].attempts, round(got[3, 0].waited_s, 6)) == (True, 3, 0.003)


def test_map_batches(spark):
    rows = spark.createDataFrame([(1, 0, k, f"t{k}") for k in range(5)], "video_id long, batch long, pos int, text string")
    got = batches.map_batches(rows, lambda ts: [str(len(ts)) + t for t in ts], concurrency=2).orderBy("pos").collect()
    assert [x.result for x in got] == [f"5t{k}" for k in range(5)]
