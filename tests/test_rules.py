"""Typography, bidi runs, legacy marks, condensation and the keyed store, each against a plain version."""

import datetime as dt
import random
import time
import unicodedata

from pyspark.sql import functions as F

from cuelake.operators import jobstats, reflow, text
from cuelake.sources import archive, tracks

LETTERS = [chr(c) for c in [*range(0x5D0, 0x5EB), *range(0x5EF, 0x5F3)]]
PIECES = ["שלום", "צה", "ל", "ב", "ג", "ץ", '"', '"', "'", "’", "״", "׳", "?", ".", " ", " ", "OK", "don't", "Charles'", "3.5", "50%", "$25", "AT&T", "café", "Ελλάδα", "Москва", "٣", "مرحبا", "(", ")", "-", "2020 COVID-19", "é", "\u05b0", "\u064b", "\u200f", "  ", "\t", "x", "…", "₪"]


def samples(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(12))) for _ in range(n)]


def rewritten(spark, fn, texts):
    rows = fn(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()
    return [x.t for x in sorted(rows, key=lambda x: x.i)]


def plain_typography(t):
    """The three rules, letter by letter."""
    marks = '"״'
    out, at = "", 0
    while at < len(t):
        before = t[at - 1] if at else " "
        k = at + 1 if t[at] in "בהוכלמש" and at + 1 < len(t) and t[at + 1] in marks else at
        if t[k] in marks and not (before.isalnum() or before == "_" or before in LETTERS):
            end = next((j for j in range(k + 1, len(t)) if t[j] in marks or t[j] == "\n"), None)
            if end is not None and t[end] in marks and any(c in LETTERS for c in t[k + 1 : end]) and (t[end + 1 : end + 2] or " ") not in LETTERS:
                out += t[at:k] + "״" + t[k + 1 : end] + "״"
                at = end + 1
                continue
        out += t[at]
        at += 1
    t = "".join("״" if c == '"' and 0 < i < len(out) - 1 and out[i - 1] in LETTERS and out[i + 1] in LETTERS else c for i, c in enumerate(out))
    return "".join("׳" if c in "'’" and i and t[i - 1] in "גזצץ" else c for i, c in enumerate(t))


def test_typography(spark):
    texts = samples(3000, 1) + ['ב"פחד גורם"?', 'מ"הישרדות".', 'דו"חות', 'מפכ"ל', "ג'ורג'", 'he said "hi"', "דבר'", None]
    got = rewritten(spark, text.repair_typography, texts)
    assert got == [None if t is None else plain_typography(t) for t in texts]
    assert got[3000:3006] == ["ב״פחד גורם״?", "מ״הישרדות״.", "דו״חות", "מפכ״ל", "ג׳ורג׳", 'he said "hi"']


def plain_isolates(line):
    kind = [unicodedata.bidirectional(c) for c in line]
    if not {"R", "AL"} & set(kind):
        return line
    inside = [False] * len(line)
    for i, k in enumerate(kind):
        if k in ("L", "EN", "AN"):
            inside[i] = True
            j = i + 1
            while j < len(line) and kind[j] not in ("R", "AL", "L", "EN", "AN"):
                j += 1
            if j < len(line) and kind[j] not in ("R", "AL"):
                inside[i : j + 1] = [True] * (j + 1 - i)
    for step in (1, -1):
        for i in range(len(line))[::step]:
            if kind[i] == "ET" and 0 <= i - step < len(line) and inside[i - step]:
                inside[i] = True
    out = ""
    for i, c in enumerate(line):
        out += ("⁦" if inside[i] and not (i and inside[i - 1]) else "") + c + ("⁩" if inside[i] and not (i + 1 < len(line) and inside[i + 1]) else "")
    return "⁧" + out + "⁩"


def test_bidi_runs(spark):
    texts = samples(3000, 2) + ["שלום AT&T 50% café Microsoft Azure", "no letter", "ב-ICC ב-2026\nsecond 3.5", None]
    assert rewritten(spark, text.isolate_bidi, texts) == [None if t is None else "\n".join(map(plain_isolates, t.split("\n"))) for t in texts]


def plain_marks(t):
    import re

    t = unicodedata.normalize("NFC", " ".join(t.split()))
    for quote, mark in (('"', "״"), ("'", "׳")):
        at = [i for i, c in enumerate(t) if c == quote]
        paired = set(at[: len(at) // 2 * 2])
        t = "".join(mark if i in paired else c for i, c in enumerate(t))
    t = "".join(c for c in t if not "\u064b" <= c <= "\u0652" and not "\u202a" <= c <= "\u202e" and c not in "\u200e\u200f")
    kinds = set(map(unicodedata.bidirectional, t))
    if not t or not kinds & {"R", "AL"}:
        return t
    if "L" in kinds:
        t = re.sub(r"[a-zA-Z0-9](?:[a-zA-Z0-9 ._,-]*[a-zA-Z0-9])", lambda m: "\u202a" + m[0] + "\u202c\u200e", t)
    t = "".join("\u200f" + c if c in ".!?:;," and i and "א" <= t[i - 1] <= "ת" else c for i, c in enumerate(t))
    return re.sub(r"\(([^)]*)\)", "(\u200f\\1\u200f)", "\u202b" + t + "\u202c")


def test_legacy_marks(spark):
    texts = samples(3000, 3) + ['"english only"', "שלום (world) 12, ok.", "", "   "]
    assert rewritten(spark, text.mark_rtl, texts) == [plain_marks(t) for t in texts]


def test_condensation(spark):
    cases = [
        ("לצה״ל יש מוניטין קשוח. הם נחשבים קשוחים.", "לצה״ל יש מוניטין קשוח. הם נחשבים מאוד.", "lost_content"),
        ("לצה״ל יש מוניטין קשוח. הם נחשבים קשוחים.", "לצה״ל מוניטין קשוח. והם קשוחים.", None),
        ("הכינו את עצמכם!", "הכינו!", "lost_content"),
        ("הכינו את עצמכם לקרב!", "הכינו לקרב!", "lost_negation"),
        ("איפה אתם?", "איפה את", "changed_mark"),
        ("Wait…", "Wait.", None),
        ("One, two,", "One, two", "lost_mark"),
        ("— Go home.", "Go home.", "lost_dash"),
        ("He went to Rome.", "He went to Rome", "changed_mark"),
        ("It has 12 rooms.", "It has rooms.", "lost_number"),
        ("Rome of", "Rome of", "weak_end"),
        ("Rome", " ", "empty"),
        ("Rome", "...", "no_words"),
        (None, "x", None),
        ("the", None, "empty"),
    ]
    d = spark.createDataFrame([c[:2] for c in cases], "original string, candidate string")
    assert [x.reason for x in reflow.condensation_check(d).collect()] == [c[2] for c in cases]


def test_files_and_retention(spark, tmp_path):
    for name, size in (("a.txt", 3), ("sub/b.txt", 5)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = archive.file_inventory(spark, str(tmp_path), "*.txt")
    assert sorted((x.path.rsplit("/", 1)[1], x.length) for x in files.collect()) == [("a.txt", 3), ("b.txt", 5)]
    newest = files.agg(F.max("modificationTime")).first()[0]
    later = F.lit(newest + dt.timedelta(days=8))
    assert sorted(tuple(x)[1:] for x in archive.retention_report(files, 7, later).collect()) == [(1, 3), (1, 5)]
    assert archive.retention_report(files, 9, later).count() == 0


def test_script(spark):
    cues = spark.createDataFrame([(1, 2, 3_000, 4_560, "second {b}"), (1, 1, 1_000, 2_000, 'שלום "לך" OK')], "video_id long, cue_id int, start_ms long, end_ms long, text string")
    videos = spark.createDataFrame([(1, 1280, 720)], "video_id long, width int, height int")
    lines = tracks.write_ass(cues, videos, rtl=True).first().body.split("\n")
    assert lines[2:4] == ["PlayResX: 1280", "PlayResY: 720"] and any(x.startswith("Style: Default,Noto Sans Hebrew,44,2,60,60,86") for x in lines)
    assert lines[-3:] == ["Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,⁧שלום ״לך״ ⁦OK⁩⁩", "Dialogue: 0,0:00:03.00,0:00:04.56,Default,,0,0,0,,second (b)", ""]


def test_transcript_marks(spark):
    d = spark.createDataFrame([(1, "[0:05] a [12] b [1:00:07] c [5] no [::] no [1:2:3:4] no", 5000)], "video_id long, text string, duration_s long")
    assert [(x.start_s, x.text.split()[0]) for x in tracks.read_stamped_transcripts(d).orderBy("pos").collect()] == [(5, "a"), (12, "b"), (3607, "c")]
    e, bad = tracks.read_ranged_transcripts(spark.createDataFrame([(1, "[00:01 - 1:02:03] x\n[1:2 - 3:4] y\n[00:01-00:02]z")], "video_id long, text string"))
    assert [(x.start_s, x.end_s, x.text) for x in e.orderBy("entry").collect()] == [(1, 3723, "x"), (1, 2, "z")] and bad.count() == 1


def test_condensation_of_a_long_line_of_numbers(spark):
    """Each number is looked up, not compared with every word; a conjunction in front of either is no difference."""
    n = 12_000
    own = " ".join(f"{k}a" for k in range(n))
    rows = [(0, f"{own} end", " ".join(f"ו{k}a" for k in range(n)) + " end"), (1, f"{own} end", " ".join(f"{k}b" for k in range(n)) + " end"), (2, "ו7 end", "7 end"), (3, "not 7 end", "7 end"), (4, "7 end", "ו7 end")]
    began = time.time()
    got = reflow.condensation_check(spark.createDataFrame(rows, "id long, original string, candidate string")).orderBy("id").collect()
    assert [x.reason for x in got] == [None, "lost_number", None, "lost_negation", None]
    assert time.time() - began < 20


def test_a_quotation_that_is_never_closed_costs_no_square(spark):
    line = '"' + "א" * 200_000
    began = time.time()
    got = text.repair_typography(spark.createDataFrame([(line,), ('ב"שלום" "abc" "x א" ד"ר ג\'',), (None,)], "t string"), "t").collect()
    assert time.time() - began < 15
    assert [tuple(x) for x in got] == [(line, 0, 0, 0), ('ב״שלום״ "abc" ״x א״ ד״ר ג׳', 2, 1, 1), (None, None, None, None)]


def test_legacy_marks_look_up_each_letter_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(text.unicodedata, "bidirectional", lambda c, was=unicodedata.bidirectional: asked.append(c) or was(c))
    import pandas as pd

    got = text._composed.func(pd.Series(["שלום ‫OK" * 1000, None, "é" * 500 + "‏"]))
    assert got["rtl"].tolist() == [True, False, False] and got["ltr"].tolist() == [True, False, True]
    assert got["text"].tolist()[1:] == [None, "é" * 500 + "‏"] and len(asked) < 20
