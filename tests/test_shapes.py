"""What the plans of large queries move, and what their steps cost."""

import datetime as dt
import random
import re
import time

from pyspark.sql import functions as F

from cuelake.operators import batches, words
from cuelake.plans import bindings, registry
from cuelake.sources import tracks
from cuelake.operators import words as W
from cuelake.sources.streams import run_available
from cuelake.streaming import stateful
from tests.test_streams import T0, stream_of

SF = "/root/testdata/sf0.001"


def moved(df):
    """How often the plan shuffles, and how often rows go through Python."""
    plan = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (hash|range)", plan[1].split("== Initial Plan ==")[0])), plan[0].count("MapInArrow")


def test_statistics_of_large_ids_and_without_durations(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    big = (1 << 60) + 2
    rows = [(big + k, at(k), 1, "click", None if k > 3 else 60.0, '{"k": 1}') for k in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["s03_save_stats"](spark, str(tmp_path)).collect()
    assert sorted((x.task_id, x.created_at, x.total_duration) for x in got) == [(str(big // 2 + k), at(2 * k + 1), 60.0 if k < 2 else None) for k in range(4)]


def test_batches_go_on_while_others_wait(spark):
    rows = spark.createDataFrame([(1, b, 0, f"t{b}") for b in range(100)], "video_id long, batch long, pos int, text string")

    def late(texts, call):
        if call.attempt < 3:
            raise RuntimeError("HTTP 503")
        return texts

    began = time.time()
    got = batches.map_batches(rows, late, wait_s=0.2, concurrency=1).collect()
    assert time.time() - began < 30  # a hundred batches that wait 0.6 s each
    assert len(got) == 100 and {(x.attempts, round(x.waited_s, 6), x.result == x.text) for x in got} == {(3, 0.6, True)}


def test_groups_are_made_where_the_words_are(spark):
    for name in ("w03_split_long", "w04_merge_short", "w05_merge_same_instant", "w06_enforce_min_duration"):
        assert moved(registry.QUERIES[name](spark, SF)) == (1, 1), name


def test_words_are_sorted_seldom(spark):
    """By position for their times, by time for sentences and turns, and by part for the dash."""
    for name in ("w02_turn_groups", "w03_split_long", "w05_merge_same_instant", "w10_spot_cues"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"\bSort \[", plan)) <= 3 + (name == "w10_spot_cues") and len(re.findall(r"\bWindow \[", plan)) <= 6, plan  # the cues' join with videos may sort once more


def test_turns_of_parts_that_ask(spark):
    """Sentences that end at a silence, parts within a sentence, questions at either, and videos of one word."""
    said = {
        1: [("so", 0, 100), ("you?", 200, 300), ("yes", 1000, 1100), ("no?", 1200, 1300), ("why.", 2000, 2100), ("end", 2900, 3000), ("it?", 3700, 3800)],
        2: [("what?", 0, 100), ("what?", 900, 930), ("go", 1700, 1800), ("on", 2500, 2600)],
        3: [("one?", 0, 10)],
    }
    rows = [(v, k, s, e, w) for v, x in said.items() for k, (w, s, e) in enumerate(x)]
    got = words.turn_groups(words.sentence_groups(spark.createDataFrame(rows, "video_id long, pos int, s_ms long, e_ms long, w string")))
    for v, x in said.items():
        parts, sent = [], 0  # (sentence, turn, words)
        for k, (w, s, e) in enumerate(x):
            ended = k and w_before[-1] in ".!?" and e_before - s_before >= 50
            sent += bool(ended)
            if not k or ended:
                parts.append((sent, False, [w]))
            elif s - e_before >= 700:
                parts.append((sent, True, [w]))
            else:
                parts[-1][2].append(w)
            w_before, s_before, e_before = w, s, e
        asks = [p[2][-1].endswith("?") for p in parts]
        dash = [(asks[i] and i + 1 < len(parts) and parts[i + 1][1]) or (parts[i][1] and i > 0 and asks[i - 1]) for i in range(len(parts))]
        want = [(s, i, t, bool(dash[i]), w) for i, (s, t, ws) in enumerate(parts) for w in ws]
        assert [(r.sent_id, r.part_id, r.turn, r.dash, r.w) for r in got.where(f"video_id = {v}").orderBy("pos").collect()] == want


def test_groups_in_one_pass_equal_the_steps(spark):
    parts = words.turn_groups(words.sentence_groups(bindings.words(spark, SF).where("video_id < 40"))).localCheckpoint()
    steps = words.group_summaries(words.split_long(parts))
    forms = {(): steps.withColumn("compromise", F.lit(False)), ("short",): words.merge_short(steps), ("instant",): words.merge_same_instant(steps), ("short", "instant", "floor"): words.merge_groups(steps)}
    for merges, want in forms.items():
        got = words.groups_in_one_pass(parts, merges)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())), merges


def test_words_move_as_texts(spark):
    for name in ("p01_clean_words", "w02_turn_groups", "w08_lead_out", "w10_spot_cues"):
        assert moved(registry.QUERIES[name](spark, SF).select("video_id"))[0] <= 2, name
    assert moved(bindings.words(spark, SF))[0] == 1


def test_cues_have_the_statistics_of_their_words(spark):
    grouped = words.sentence_groups(bindings.words(spark, SF).where("video_id < 40")).withColumn("cue_id", F.col("sent_id") + 1)
    names = ["video_id", "cue_id", "words", "degenerate", "degenerate_run", "min_word_dur_ms"]
    got, want = words.cues_of(grouped, dashed=False).select(*names), words.word_stats(grouped, ["video_id", "cue_id"]).select(*names)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_transcript_is_not_carried_beside_each_of_its_marks(spark):
    docs = spark.createDataFrame([(1, "[00:01] a [00:03] b", 9), (2, "plain", 9)], "video_id long, text string, duration_s long")
    got = tracks.read_stamped_transcripts(docs)
    assert sorted((x.video_id, x.pos, x.start_s, x.end_s, x.text) for x in got.collect()) == [(1, 0, 1, 3, "a"), (1, 1, 3, 8, "b"), (2, 0, 0, 9, "plain")]
    assert "RLIKE" in got._jdf.queryExecution().optimizedPlan().toString()
    assert moved(registry.QUERIES["s07_stamped_transcripts"](spark, SF))[0] == 1


def test_times_are_read_once_for_each_word_that_is_kept_or_not(spark):
    raw = spark.range(3).selectExpr("id as video_id", "0 as pos", "'w' as w", "cast(id / 7 as string) as s", "cast(id as string) as e")
    plan = W.clean_words(raw)._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.split("\n") if "Filter" in line]
    assert conditions and all(line.lower().count("isnan") == 0 for line in conditions)
    rows = [(1, 0, "a", "0.5", "inf"), (1, 1, "b", "NaN", "1"), (1, 2, "c", "1", "nan"), (1, 3, "d", None, "1"), (1, 4, " ", "1", "2"), (1, 5, "e", "-inf", "x"), (1, 6, "f", "2", None), (1, 7, "g", "-3", "-1")]
    got = W.clean_words(spark.createDataFrame(rows, "video_id int, pos int, w string, s string, e string")).collect()
    assert sorted((x.w, x.s_ms) for x in got) == [("f", 2000), ("g", 0)]


def test_speech_islands_are_made_before_they_are_dealt(spark, tmp_path):
    rows = [(v, T0 + dt.timedelta(milliseconds=400 * k + 5000 * (k // 10))) for v in range(3) for k in range(40)]
    stream = stateful.speech_islands(stream_of(spark, str(tmp_path / "s"), [rows, [(9, T0 + dt.timedelta(days=9))], [(9, T0 + dt.timedelta(days=19))]], "video_id long, ts timestamp"))
    got = run_available(stream)
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "true"
    assert sorted((x.video_id, x.words) for x in got.where("video_id < 9").collect()) == [(v, 10) for v in range(3) for _ in range(4)]


def test_spans_are_those_of_the_collected_words(spark):
    """Over random videos, some without terminals and with pauses, of one word, of equal times, and of no id."""
    r = random.Random(5)
    rows = []
    for v in [None, *range(60)]:
        at, said = 0, ["a", "bc", "d,", "é"] if v is not None and v % 3 == 0 else ["a.", "bc", 'd?"', "é", "f!", ""]
        for k in range(r.choice([1, 2, 7, 8, 9, 40])):
            length = r.choice([0, 20, 49, 50, 300])
            rows.append((v, k, at, at + length, r.choice(said)))
            at += length + r.choice([0, 0, 100, 349, 350, 900])
    table = spark.createDataFrame(rows, "video_id long, pos int, s_ms long, e_ms long, w string")
    want = W.cues_of(W.sentence_groups(table).withColumn("cue_id", F.col("sent_id") + 1), dashed=False)
    got = W.sentence_spans(table)
    names = ["video_id", "cue_id", "start_ms", "end_ms"]
    key = lambda x: (x[0] is None, *(y for y in x if y is not None))
    assert sorted(map(tuple, got.select(*names, "chars").collect()), key=key) == sorted(map(tuple, want.select(*names, F.length("text")).collect()), key=key)
    said = table.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("said"))
    texts = W.texts_of(got, said).select(*names, "text")
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, want.where("video_id is not null").select(*names, "text").collect()))


def test_words_of_sentence_cues_are_not_collected(spark):
    for name in ("w08_lead_out", "w09_clamp_to_end", "flagship"):
        assert "collect_list" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name


def test_sentence_cues_of_shared_and_missing_ids_are_whole(spark, tmp_path):
    rows = [(1, "One two. Three four.", "en", "s", 20), (1, "Five.", "de", "s", 5), (None, "Six seven.", "en", "s", 10), (2, " ", "en", "s", 1), (3, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["w08_lead_out"](spark, str(tmp_path)).collect()
    assert sorted(w for x in got for w in x.text.split()) == sorted("One two. Three four. Five. Six seven.".split())
    assert [x.text for x in got if x.video_id is None] == ["Six seven."] and [x.text for x in got if x.video_id == 2] == [""]


def test_reading_speed_takes_no_text_and_one_row_a_video(spark, tmp_path):
    """Documents that share an id are one video, which the SQL's one join meets once for each of them."""
    plan = registry.QUERIES["flagship"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 1 and "array_join" not in plan
    rows = [(1, "One two. Three four.", "en", "s", 20), (1, "Five.", "de", "s", 5), (2, " ", "en", "s", 1), (None, "Six seven.", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    n = registry.QUERIES["w08_lead_out"](spark, str(tmp_path)).where("video_id = 1").count()
    got = {x.source_lang: (x.cues, x.longest) for x in registry.QUERIES["flagship"](spark, str(tmp_path)).collect()}
    assert got["de"][0] == n and got["en"][0] == n + 1
